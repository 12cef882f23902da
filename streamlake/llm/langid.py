"""Language of texts by interpolated Kneser-Ney character models, one per language.

Characters are lower-cased letters; everything between them is one blank. A 4-gram is four 16-bit
character codes in one 64-bit integer, so its hash is exact, its suffix the lower bits. The models
of all languages share sorted arrays of these hashes; beside each hash stands its probability
under every language. Arrays of many grams are cut into parts, used one after the other. A text gets the language of the lowest cross-entropy per character. How far entropies
of a language's own texts vary, at any length, is learned too, and bounds what is accepted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlake.llm.common import fetched, keep_table, sample_of

ORDER = 4
CODE_BITS = 16
BLANK = 32
FAR_LETTER = 0xFFFF  # stands for any letter beyond the basic plane
SEGMENT = 1 << 20  # characters worked on at once
DENSE = 1 << 24  # grams are numbered directly while the batch's alphabet allows so many
PART_GRAMS = 1_000_000  # about so many counted grams are fitted and broadcast as one part of the model
HELD_PARTS = 4  # parts of the model that a process holds at once
CALIBRATION_ROWS = 8_000  # labelled rows that the acceptance is fitted on
CALIBRATION_BYTES = 10_000  # a longer text is not sampled
UNDETERMINED = "und"
MOST_DEVIATIONS = 5.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16))
    return _LETTER[0]


def codes(text: str) -> np.ndarray:
    """Lower-case letters as 16-bit codes, each run of anything else as one blank, a blank in front
    and behind. No letter gives no code."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    far = points > 0xFFFF
    if far.any():
        points = points.copy()
        for point in np.unique(points[far]):
            points[points == point] = FAR_LETTER if chr(point).isalpha() else BLANK
    low = points.astype(np.uint16)
    letter = _letters()[low] | (low == FAR_LETTER)
    if not letter.any():
        return np.zeros(0, np.uint16)
    low = np.where(letter, low, np.uint16(BLANK))
    low = np.concatenate([[np.uint16(BLANK)], low, [np.uint16(BLANK)]])
    blank = low == BLANK
    return low[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]


def numbered(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of all sequences, the number of each 4-gram among these, and where the
    sequences begin."""
    padded = []
    for sequence in sequences:
        padded += [np.full(ORDER - 2, BLANK, np.uint16), sequence]
    flat = np.concatenate(padded)
    lengths = np.array([len(s) - 1 for s in sequences])  # 4-grams of each
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    used = np.flatnonzero(np.bincount(flat, minlength=1 << CODE_BITS))
    # The 4-gram ending at each place; those across two sequences are dropped.
    ends = np.ones(len(flat), bool)
    sequence_starts = np.cumsum([0, *(len(s) + ORDER - 2 for s in sequences)])[:-1]
    for i in range(ORDER - 1):
        ends[sequence_starts + i] = False
    if len(used) ** ORDER <= DENSE:
        local = np.zeros(1 << CODE_BITS, np.int32)
        local[used] = np.arange(len(used))
        digit = local[flat]
        number = np.zeros(len(flat) - ORDER + 1, np.int32)
        for i in range(ORDER):
            number = number * np.int32(len(used)) + digit[i:i + len(number)]
        number = number[ends[ORDER - 1:]]
        present = np.zeros(len(used) ** ORDER, bool)
        present[number] = True
        distinct = np.flatnonzero(present)
        place = np.empty(len(present), np.int32)
        place[distinct] = np.arange(len(distinct), dtype=np.int32)
        keys, rest = np.zeros(len(distinct), np.uint64), distinct
        for i in range(ORDER):
            keys |= used[rest % len(used)].astype(np.uint64) << np.uint64(CODE_BITS * i)
            rest = rest // len(used)
        return keys, place[number], begins
    wide = flat.astype(np.uint64)
    key = np.zeros(len(flat) - ORDER + 1, np.uint64)
    for i in range(ORDER):
        key = (key << np.uint64(CODE_BITS)) | wide[i:i + len(key)]
    keys, number = np.unique(key[ends[ORDER - 1:]], return_inverse=True)
    return keys, number, begins


def _segments(text: str | None):
    """The codes of a text in runs of bounded length, each with blanks around it."""
    for at in range(0, len(text or ""), SEGMENT):
        run = codes(text[at:at + SEGMENT])
        if len(run) > 1:
            yield run


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over ``docs (text, lang)``, summed within a task ahead of the shuffle."""
    def counted(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)
                for at in range(0, len(keys), 50_000):
                    some = keys[at:at + 50_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some)), pa.array(some), pa.array(n[at:at + 50_000])],
                        ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            waiting: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                runs = waiting.setdefault(lang, [])
                for run in _segments(text):
                    runs.append(run)
                    if sum(map(len, runs[-64:])) > SEGMENT or len(runs) >= 1024:
                        held.setdefault(lang, []).append(_count(runs))
                        runs.clear()
            for lang, runs in waiting.items():
                if runs:
                    held.setdefault(lang, []).append(_count(runs))
            size = sum(len(k) for parts in held.values() for k, _ in parts)
            if size > 4_000_000:
                yield from flush()
        yield from flush()

    return (docs.select("text", "lang").mapInArrow(counted, "lang string, gram bigint, n bigint")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _count(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, number, _ = numbered(runs)
    return keys, np.bincount(number, minlength=len(keys)).astype(np.float64)


@dataclass
class Model:
    """``seen[k]``: sorted hashes of the grams of ``k`` characters; ``known[k]``: their log
    probability under each language; ``contexts[k]`` and ``weights[k]``: the same for what a
    context of ``k`` characters passes on to the next lower order."""

    languages: list[str]
    seen: dict[int, np.ndarray]
    known: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]
    weights: dict[int, np.ndarray]
    unseen: float
    sharpness: float = 1.0
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None  # variance = spread[0] + spread[1] / characters

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Of each 4-gram's last character after the others, a column per language."""
        out = np.zeros((len(keys), len(self.languages)))
        left = np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            gram = keys[left] & np.uint64((1 << (CODE_BITS * k)) - 1) if k < ORDER else keys[left]
            at = np.minimum(np.searchsorted(self.seen[k], gram), max(len(self.seen[k]) - 1, 0))
            found = self.seen[k][at] == gram if len(self.seen[k]) else np.zeros(len(gram), bool)
            out[left[found]] += self.known[k][at[found]]
            left, gram = left[~found], gram[~found]
            if not len(left):
                return out
            context = gram >> np.uint64(CODE_BITS)
            held = self.contexts[k - 1]
            at = np.minimum(np.searchsorted(held, context), max(len(held) - 1, 0))
            there = held[at] == context if len(held) else np.zeros(len(context), bool)
            out[left[there]] += self.weights[k - 1][at[there]]
        out[left] += self.unseen
        return out


@dataclass
class PartedModel:
    """A model whose grams are dealt over parts by their third character, then their second: by these
    two all grams and contexts that the last character's probability can fall back to are in one part,
    but for single characters, which are in each. ``cuts`` are the first places of all parts but one."""

    languages: list[str]
    cuts: np.ndarray
    parts: list  # broadcasts of a Model each
    unseen: float
    sharpness: float = 1.0
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    held: list[int] = field(default_factory=list)

    def part(self, i: int) -> Model:
        if i not in self.held:
            if len(self.held) >= HELD_PARTS:
                of = self.parts[self.held.pop(0)]
                if of._path is not None:  # it can be read again
                    vars(of).pop("_value", None)
            self.held.append(i)
        return self.parts[i].value

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        if len(self.parts) == 1:
            return self.part(0).log_probabilities(keys)
        low = np.uint64((1 << CODE_BITS) - 1)
        second, third = (keys >> np.uint64(2 * CODE_BITS)) & low, (keys >> np.uint64(CODE_BITS)) & low
        which = np.searchsorted(self.cuts, (third << np.uint64(CODE_BITS)) | second, side="right")
        out = np.empty((len(keys), len(self.languages)))
        needed = np.unique(which).tolist()
        for i in sorted(needed, key=lambda i: i not in self.held):
            out[which == i] = self.part(i).log_probabilities(keys[which == i])
        return out

    def __getstate__(self):
        return {**vars(self), "held": []}


def _rows_of(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Kneser-Ney over ``{language: (hashes, counts)}`` of 4-grams.

    The top order counts occurrences, lower ones the distinct characters seen in front. Each order
    is discounted by ``n1 / (n1 + 2 n2)``, and what that frees goes to the next lower order.
    """
    languages = sorted(counts)
    grams_of: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    discounts = {}
    for lang in languages:
        keys, n = counts[lang]
        order = np.argsort(keys)
        by = {ORDER: (keys[order], n[order].astype(np.float64))}
        for k in range(ORDER - 1, 0, -1):
            tails = by[k + 1][0] & np.uint64((1 << (CODE_BITS * k)) - 1)
            kept, n = np.unique(tails, return_counts=True)
            by[k] = kept, n.astype(np.float64)
        grams_of[lang] = by
        for k, (_, n) in by.items():
            discounts[lang, k] = _discount(np.count_nonzero(n == 1), np.count_nonzero(n == 2))
    return _fitted(languages, grams_of, discounts)


def _discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def _fitted(languages: list[str], grams_of: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]],
            discounts: dict[tuple[str, int], float]) -> Model:
    """The model of all grams, or of a part of them, by language and order: sorted hashes and counts."""
    one = np.uint64(CODE_BITS)
    seen = {k: np.unique(np.concatenate([grams_of[x][k][0] for x in languages])) for k in range(1, ORDER + 1)}
    contexts = {k: np.unique(seen[k + 1] >> one) for k in range(ORDER)}
    alphabet = len(seen[1]) + 1
    known = {k: np.empty((len(seen[k]), len(languages))) for k in seen}
    weights = {k: np.zeros((len(contexts[k]), len(languages))) for k in contexts}
    for column, lang in enumerate(languages):
        lower = None
        for k in range(1, ORDER + 1):
            keys, n = grams_of[lang][k]
            discount = discounts[lang, k]
            at, _ = _rows_of(contexts[k - 1], keys >> one)
            total = np.bincount(at, n, len(contexts[k - 1]))
            kinds = np.bincount(at, minlength=len(contexts[k - 1]))
            has = total > 0
            share = np.ones(len(total))
            share[has] = discount * kinds[has] / total[has]
            weights[k - 1][:, column] = np.log(share)
            context, _ = _rows_of(contexts[k - 1], seen[k] >> one)
            own, there = _rows_of(keys, seen[k])
            mass = np.zeros(len(own))
            mass[there] = np.maximum(n[own[there]] - discount, 0)
            p = np.divide(mass, total[context], out=np.zeros(len(mass)), where=has[context])
            if k == 1:
                below = np.full(len(p), 1 / alphabet)
            else:
                tail, _ = _rows_of(seen[k - 1], seen[k] & np.uint64((1 << (CODE_BITS * (k - 1))) - 1))
                below = lower[tail]
            lower = p + share[context] * below
            known[k][:, column] = np.log(lower)
    return Model(languages, seen, known, contexts, weights, float(np.log(1 / alphabet)))


def entropies(texts: list[str | None], model: Model | PartedModel) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character under each language, and the number of characters."""
    total = np.zeros((len(texts), len(model.languages)))
    length = np.zeros(len(texts), np.int64)

    def add(rows: list[int], runs: list[np.ndarray]) -> None:
        keys, number, begins = numbered(runs)
        table = model.log_probabilities(keys)
        for column in range(table.shape[1]):
            sums = np.add.reduceat(np.ascontiguousarray(table[:, column])[number], begins)
            np.add.at(total[:, column], rows, sums)
        np.add.at(length, rows, [len(r) - 1 for r in runs])

    rows, runs, size = [], [], 0
    for row, text in enumerate(texts):
        for run in _segments(text):
            rows.append(row)
            runs.append(run)
            size += len(run)
            if size > SEGMENT:
                add(rows, runs)
                rows, runs, size = [], [], 0
    if runs:
        add(rows, runs)
    return -total / np.maximum(length, 1)[:, None], length


def calibrate(model: Model | PartedModel, texts: list[str], langs: list[str]) -> Model | PartedModel:
    """Fit the sharpness of scores and the acceptance on labelled texts."""
    entropy, length = entropies(texts, model)
    own = np.array([model.languages.index(x) for x in langs])
    use = length > 0
    entropy, length, own = entropy[use], length[use], own[use]
    if not len(own):
        return model
    rows = np.arange(len(own))

    def loss(sharpness: float) -> float:
        return -np.log(np.maximum(posterior(entropy, length, sharpness)[rows, own], 1e-12)).mean()

    model.sharpness = min((2.0 ** i for i in range(-4, 7)), key=loss)
    # Of the language that fits best, as in use: a wrong label says nothing about the text.
    which = entropy.argmin(axis=1)
    mine = entropy[rows, which]
    model.centre = np.array([np.median(mine[which == i]) if (which == i).any() else np.median(mine)
                             for i in range(len(model.languages))])
    off = (mine - model.centre[which]) ** 2
    design = np.stack([np.ones(len(off)), 1 / length], axis=1)
    fitted = np.linalg.lstsq(design * length[:, None] ** 0.5, off * length ** 0.5, rcond=None)[0]
    model.spread = np.maximum(fitted, [1e-4, 1e-2])
    return model


def too_far(model: Model | PartedModel, entropy: np.ndarray, length: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Is the text in none of the languages? Its entropy must lie nearer to that of letters drawn at random
    than to what texts of the language have, and further off than chance allows at its length. So texts
    of two languages, lists, and texts that hold codes or repeat themselves are accepted."""
    if model.centre is None:
        return np.zeros(len(entropy), bool)
    off = entropy - model.centre[which]
    return (off > (-model.unseen - model.centre[which]) / 2) & (off > MOST_DEVIATIONS * np.sqrt(
        model.spread[0] + model.spread[1] / np.maximum(length, 1)))


def posterior(entropy: np.ndarray, length: np.ndarray, sharpness: float) -> np.ndarray:
    """Shares of the languages; evidence grows with the root of the length, as neighbouring
    characters are not independent."""
    logit = -sharpness * np.sqrt(np.maximum(length, 1))[:, None] * entropy
    logit -= logit.max(axis=1, keepdims=True)
    share = np.exp(logit)
    return share / share.sum(axis=1, keepdims=True)


def fit_table(counts: DataFrame) -> PartedModel | None:
    """``fit`` over all rows of ``counts (lang, gram, n)``, None if there are none. The counts of every order
    stay in Spark; the driver fits and sends one part after the other."""
    spark = counts.sparkSession
    total = counts.count()
    if not total:
        return None
    code = (1 << CODE_BITS) - 1
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        tails = F.col("gram").bitwiseAND(F.lit((1 << (CODE_BITS * k)) - 1))
        orders[k] = keep_table(orders[k + 1].groupBy("lang", tails.alias("gram")).agg(
            F.count(F.lit(1)).alias("n")), "langid-grams")
    discounts = {}
    for k, table in orders.items():
        for r in table.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"),
                                           F.count_if(F.col("n") == 2).alias("twos")).collect():
            discounts[r["lang"], k] = _discount(r["ones"], r["twos"])
    languages = sorted({lang for lang, _ in discounts})
    third = F.shiftright("gram", CODE_BITS).bitwiseAND(F.lit(code))
    second = F.shiftright("gram", 2 * CODE_BITS).bitwiseAND(F.lit(code))
    place = F.shiftleft(third, CODE_BITS).bitwiseOR(second)
    wanted = -(-total // PART_GRAMS)
    cuts: list[int] = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        cuts = sorted(set(counts.select(F.percentile_approx(place, shares, max(10_000, 100 * wanted))).first()[0]))

    def by_language(table: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for lang, rows in fetched(table.select("lang", "gram", "n")).groupby("lang"):
            keys = rows["gram"].to_numpy().view(np.uint64)
            order = np.argsort(keys)
            out[lang] = keys[order], rows["n"].to_numpy()[order].astype(np.float64)
        return out

    none = np.zeros(0, np.uint64), np.zeros(0)
    single = by_language(orders[1])
    alphabet = len(np.unique(np.concatenate([keys for keys, _ in single.values()]))) + 1
    parts = []
    for begin, end in zip([None, *cuts], [*cuts, None], strict=True):
        own = F.lit(True) if begin is None else place >= begin
        own &= F.lit(True) if end is None else place < end
        # Pairs go with their first character, which several parts may share.
        pair = F.lit(True) if begin is None else third >= begin >> CODE_BITS
        pair &= F.lit(True) if end is None else third <= (end - 1) >> CODE_BITS
        found = {k: by_language(orders[k].where(pair if k == 2 else own)) for k in range(2, ORDER + 1)} | {1: single}
        parts.append(spark.sparkContext.broadcast(_fitted(
            languages, {x: {k: found[k].get(x, none) for k in found} for x in languages}, discounts)))
    return PartedModel(languages, np.array(cuts, np.uint64), parts, float(np.log(1 / alphabet)))


def train(docs: DataFrame) -> PartedModel | None:
    """Models of the languages of ``docs (doc_id, text, lang)``, from the texts of labelled rows that are
    not held out; None if there are none. Grams are counted over all of these rows, and all are kept."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                          & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    model = fit_table(keep_table(gram_counts(labelled), "langid-grams"))
    if model is None:
        return None
    short = labelled.where(F.octet_length("text") <= CALIBRATION_BYTES)
    sample = fetched(sample_of(short, CALIBRATION_ROWS, F.col("doc_id")).select("text", "lang"))
    sample = sample[sample["lang"].isin(model.languages)]
    return calibrate(model, sample["text"].tolist(), sample["lang"].tolist())


def predict(docs: DataFrame, model: PartedModel | None, keep: str = "doc_id") -> DataFrame:
    """Language of ``docs (text)``: ``keep`` (a column passed on), ``lang_pred, score, rejected``.

    ``lang_pred`` is the learned language of the lowest cross-entropy per character, the first by name of
    equals, and ``score`` its calibrated share. A text that is null or holds no letter is ``und`` with
    score 0, as is every text where nothing was learned. ``rejected`` are these and texts that are
    ``too_far`` from every language. Only the text is looked at.
    """
    kind = docs.select(keep).schema[0].dataType.simpleString()

    def judged(batches):
        learned = model
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            rejected = np.ones(len(texts), bool)
            if learned is not None and texts:
                entropy, length = entropies(texts, learned)
                best = entropy.argmin(axis=1)
                rows = np.arange(len(texts))
                some = length > 0
                names = [learned.languages[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)]
                score = np.where(some, posterior(entropy, length, learned.sharpness)[rows, best], 0.0)
                rejected = ~some | too_far(learned, entropy[rows, best], length, best)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                [keep, "lang_pred", "score", "rejected"])

    return docs.select(keep, "text").mapInArrow(
        judged, f"`{keep}` {kind}, lang_pred string, score double, rejected boolean")
