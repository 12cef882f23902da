"""Grouping of spelling variants by a frequency-vector trie.

Words are the letter runs of all texts (optionally shortened by one letter, as the contract deals it),
counted over the whole corpus by Spark. A word is described by its counts of ``GROUPS`` letter groups,
taken one group after the other: these are the levels of a trie whose leaves hold the words of one
vector. Two words one insertion, deletion or replacement apart differ in at most one count by +1 (a
surplus) and at most one by -1 (a deficit), so a depth-first search that may spend a surplus budget of
one and a deficit budget of one along its path reaches every such word; what it reaches at the leaves is
verified letter by letter.

At scale the trie is cut at its first two levels: a word is a member of the subtree of its own two first
counts, and is sent as a query to every subtree within budget, carrying what budget is left. A subtree of
more than ``BLOCK`` members, or with more than ``BLOCK`` queries, is dealt out in blocks of members and
queries, every query meeting every member block once; so no task holds more than ``BLOCK`` of each,
however large the group. Forms and roots are Spark aggregates and pointer-doubling rounds.

Defined cases: a null text has no runs; a run of a row with a null ``doc_id`` is kept whole (the hash has
no id to read); words are compared by code points; ties of the largest count go to the smaller word in
code-point order. A word without near words has ``n_near`` 0 and no form; forms strictly grow in count,
so following them always ends. Other input columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlake.llm.common import keep_table, partitions_for, runs

# Fixed values of the contract.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIVISOR = 97
SHORTEST = 5
LEAST_COUNT = 3
FORM_FACTOR = 2

GROUPS = 16  # letter groups, by code point modulo GROUPS; the trie's levels in this order
TOP_LEVELS = 2  # levels that choose the subtree a task searches
BLOCK = 200_000  # members of one trie, at most
QUERY_BLOCK = 1_000_000  # queries of one subtree handled by one task, at most
BROADCAST_KEYS = 100_000  # subtrees whose block counts are sent to every task; more are joined by shuffle
LETTERS = [chr(c) for c in range(ord("a"), ord("z") + 1)] + [chr(c) for c in range(0xC0, 0x100)]


def _group_pattern(group: int) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in LETTERS if ord(c) % GROUPS == group) + "]"


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: the distinct words of at least ``SHORTEST`` code points met at least ``LEAST_COUNT``
    times, over all texts."""
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.explode(F.regexp_extract_all(F.col("text"), F.lit(RUN), 0)).alias("run"))
    run = F.translate("run", UPPER, LOWER)
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    shortened = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2, F.char_length(run)))
    word = F.when(h % DIVISOR == 0, shortened).otherwise(run)
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.char_length("word") >= SHORTEST) & (F.col("n") >= LEAST_COUNT))


def described(words: DataFrame) -> DataFrame:
    """``words`` with ``counts``: the counts of the letter groups of the top levels (the levels below
    are counted where the trie is built)."""
    counts = F.array(*[F.regexp_count("word", F.lit(_group_pattern(g))) for g in range(TOP_LEVELS)])
    return words.withColumn("counts", counts)


def _within_budget() -> list[tuple[tuple[int, ...], int, int]]:
    """Moves over the top levels with the surplus and deficit they spend."""
    moves = [((0,) * TOP_LEVELS, 0, 0)]
    for up in range(TOP_LEVELS):
        step = [0] * TOP_LEVELS
        step[up] = 1
        moves.append((tuple(step), 1, 0))
        step[up] = -1
        moves.append((tuple(step), 0, 1))
        for down in range(TOP_LEVELS):
            if down != up:
                both = [0] * TOP_LEVELS
                both[up], both[down] = 1, -1
                moves.append((tuple(both), 1, 1))
    return moves


def _top(counts: Column) -> Column:
    return F.slice(counts, 1, TOP_LEVELS)


def one_edit(a: str, b: str) -> bool:
    """Exactly one insertion, deletion or replacement of a code point turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = (a, b) if len(a) < len(b) else (b, a)
    i = 0
    while i < len(short) and short[i] == long_[i]:
        i += 1
    return short[i:] == long_[i + 1:]


def _counts(words: list[str]) -> np.ndarray:
    """The letter-group counts of each word, one row per word (all letters of ``RUN`` lie below 256)."""
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    return np.bincount(owner * GROUPS + codes % GROUPS, minlength=len(words) * GROUPS).reshape(-1, GROUPS)


class _Trie:
    """The members' count vectors below the top levels as a trie: per level, the sorted keys
    ``parent * width + count`` of its nodes (a node's number is its key's place), and per leaf its
    members."""

    def __init__(self, words: list[str], width: int):
        self.words, self.width, self.known = words, width, _Words(words)
        self.column = pa.array(words, pa.string())
        counts = _counts(words)[:, TOP_LEVELS:]
        node = np.zeros(len(words), np.int64)
        self.levels = []
        for level in range(counts.shape[1]):
            keys, node = np.unique(node * width + counts[:, level], return_inverse=True)
            self.levels.append(keys)
        self.members = np.argsort(node, kind="stable")
        self.starts = np.searchsorted(node[self.members], np.arange(len(self.levels[-1]) + 1))


def _walk(trie: _Trie, asked: np.ndarray, more: np.ndarray, less: np.ndarray):
    """Every (query vector, leaf) the search reaches: at each level a vector goes on with its own
    count, one more (spending its surplus budget) or one less (spending its deficit budget), where the
    trie has such a node. All vectors are walked together, level by level."""
    group, node = np.arange(len(asked)), np.zeros(len(asked), np.int64)
    for level, keys in enumerate(trie.levels):
        own = asked[group, level]
        moved = []
        for step, spends_more, spends_less in ((0, 0, 0), (1, 1, 0), (-1, 0, 1)):
            ok = (more >= spends_more) & (less >= spends_less) & (own + step >= 0) & (own + step < trie.width)
            key = node[ok] * trie.width + own[ok] + step
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            moved.append((group[ok][hit], at[hit], more[ok][hit] - spends_more, less[ok][hit] - spends_less))
        group, node, more, less = (np.concatenate(parts) for parts in zip(*moved))
    return group, node


def _spread(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries ``which`` of a list of runs ``starts``: (entry number, item) of every item."""
    sizes = starts[which + 1] - starts[which]
    entry = np.repeat(np.arange(len(which)), sizes)
    item = np.arange(entry.size) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which][entry]
    return entry, item


def _one_edit_rows(short: np.ndarray, long_: np.ndarray) -> np.ndarray:
    """Row-wise: is ``short`` one edit from ``long_``? Replacement when the widths agree, else the
    shorter is the longer's first ``p`` and last ``s`` code points with ``p + s`` at least its length."""
    if short.shape[1] == long_.shape[1]:
        return (short != long_).sum(axis=1) == 1
    n = short.shape[1]
    head = np.logical_and.accumulate(short == long_[:, :n], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((short == long_[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= n


class _Words:
    """Words with their code points in one matrix per length, for checks in arrays."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.row = np.empty(len(words), np.int64)
        self.codes = {}
        for length in np.unique(self.lengths).tolist():
            which = np.flatnonzero(self.lengths == length)
            self.row[which] = np.arange(len(which))
            text = "".join([words[i] for i in which]).encode("latin-1")
            self.codes[length] = np.frombuffer(text, np.uint8).reshape(len(which), length)


def _verified(queries: _Words, members: _Words, qi: np.ndarray, mi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs ``(queries[qi], members[mi])``, those one edit apart, checked in arrays by lengths."""
    q_len, m_len = queries.lengths[qi], members.lengths[mi]
    shift = m_len - q_len + 1  # 0, 1 or 2: the search only reaches lengths one apart
    kept = []
    for lq in np.unique(q_len).tolist():
        same = q_len == lq
        for lm in (lq - 1, lq, lq + 1):
            chosen = np.flatnonzero(same & (shift == lm - lq + 1))
            if not len(chosen):
                continue
            qa = queries.codes[lq][queries.row[qi[chosen]]]
            mb = members.codes[lm][members.row[mi[chosen]]]
            kept.append(chosen[_one_edit_rows(qa, mb) if lq <= lm else _one_edit_rows(mb, qa)])
    good = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return qi[good], mi[good]


PAIRS_AT_ONCE = 2_000_000  # candidate pairs verified in one array operation, at most


def _search(trie: _Trie, queries: list[str], surplus: np.ndarray, deficit: np.ndarray):
    """The queries' near words among the trie's members. Queries of one count vector and budget share
    one walk; the members of every leaf reached are verified against all of them."""
    asked_words = _Words(queries)
    counts = _counts(queries)[:, TOP_LEVELS:]
    labels = np.column_stack([counts, surplus, deficit])
    alike, which = np.unique(labels, axis=0, return_inverse=True)
    which = which.ravel()
    order = np.argsort(which, kind="stable")
    starts = np.searchsorted(which[order], np.arange(len(alike) + 1))
    group, leaf = _walk(trie, alike[:, :-2], 1 - alike[:, -2], 1 - alike[:, -1])
    sizes = (trie.starts[leaf + 1] - trie.starts[leaf]) * (starts[group + 1] - starts[group])
    total = np.cumsum(sizes)
    begin = 0
    while begin < len(group):
        done = total[begin - 1] if begin else 0
        end = max(int(np.searchsorted(total, done + PAIRS_AT_ONCE, side="right")), begin + 1)
        entry, member = _spread(trie.starts, leaf[begin:end])
        pair, asked = _spread(starts, group[begin:end][entry])
        yield _verified(asked_words, trie.known, order[asked], trie.members[member[pair]])
        begin = end


def _searched(batches):
    """Blocks arrive sorted, each with its members before its queries: the members make the trie,
    the queries stream past it batch by batch."""
    block, members, trie = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("block").to_numpy()
        roles = batch.column("role").to_numpy()
        words = batch.column("word").to_pylist()
        surplus = batch.column("surplus").to_numpy()
        deficit = batch.column("deficit").to_numpy()
        cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (roles[1:] != roles[:-1])) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
            if ids[begin] != block:
                block, members, trie = ids[begin], [], None
            if roles[begin] == 0:
                members.extend(words[begin:end])
                continue
            if trie is None:
                trie = _Trie(members, max(map(len, members)) + 2)
            asked = words[begin:end]
            for qi, mi in _search(trie, asked, surplus[begin:end], deficit[begin:end]):
                if len(qi):
                    yield pa.RecordBatch.from_pydict({
                        "word": pa.array(asked, pa.string()).take(pa.array(qi)),
                        "near": trie.column.take(pa.array(mi))})


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, near``: every ordered pair of words one edit apart."""
    moves = F.array(*[F.struct(F.array(*[F.lit(c) for c in step]).alias("step"),
                               F.lit(more).alias("surplus"), F.lit(less).alias("deficit"))
                      for step, more, less in _within_budget()])
    members = words.select("word", _top(F.col("counts")).alias("key"))
    queries = (members.select("word", "key", F.explode(moves).alias("move"))
               .select("word", F.zip_with("key", "move.step", lambda c, s: c + s).alias("key"),
                       "move.surplus", "move.deficit")
               .where(F.forall("key", lambda c: c >= 0)))
    sizes = (members.groupBy("key").agg(F.count("*").alias("m"))
             .join(queries.groupBy("key").agg(F.count("*").alias("q")), "key"))
    parts = keep_table(sizes.select("key", F.ceil(F.col("m") / BLOCK).alias("m_parts"),
                                    F.ceil(F.col("q") / QUERY_BLOCK).alias("q_parts")), "spelling-parts")
    if parts.count() <= BROADCAST_KEYS:  # one row per subtree: measured before it is broadcast
        parts = F.broadcast(parts)
    spread = F.xxhash64(F.lit("spelling"), "word")
    dealt_members = (members.join(parts, "key")
                     .select("word", "key", F.pmod(spread, "m_parts").alias("m_part"),
                             F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_parts") - 1)).alias("q_part"),
                             F.lit(0).alias("role"), F.lit(0).alias("surplus"), F.lit(0).alias("deficit")))
    dealt_queries = (queries.join(parts, "key")
                     .select("word", "key",
                             F.explode(F.sequence(F.lit(0).cast("long"), F.col("m_parts") - 1)).alias("m_part"),
                             F.pmod(spread, "q_parts").alias("q_part"),
                             F.lit(1).alias("role"), "surplus", "deficit"))
    blocks = (dealt_members.unionByName(dealt_queries)
              .select("word", F.xxhash64("key", "m_part", "q_part").alias("block"), "role",
                      F.col("surplus").cast("int").alias("surplus"), F.col("deficit").cast("int").alias("deficit")))
    placed = blocks.repartition(partitions_for(words.sparkSession), "block").sortWithinPartitions("block", "role")
    return placed.mapInArrow(_searched, "word string, near string")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: forms followed to their end, by pointer doubling over written rounds."""
    step = forms.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        step = keep_table(step, "spelling-roots")
        later = step.alias("a").join(step.alias("b"), F.col("a.root") == F.col("b.word"), "left").select(
            F.col("a.word").alias("word"), F.coalesce(F.col("b.root"), F.col("a.root")).alias("root"),
            (F.col("b.root").isNotNull() & (F.col("b.root") != F.col("a.root"))).alias("moved"))
        later = keep_table(later, "spelling-roots")
        if not later.where("moved").limit(1).count():
            return later.select("word", "root")
        step = later.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the corpus."""
    words = keep_table(described(word_counts(docs)), "spelling-words")
    pairs = keep_table(near_pairs(words), "spelling-pairs")
    counts = words.select("word", "n")
    scored = pairs.join(counts.withColumnRenamed("word", "near").withColumnRenamed("n", "near_n"), "near")
    best = scored.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near"))).alias("best"))
    joined = counts.join(best, "word", "left")
    chosen = F.col("best.minus_n") <= -FORM_FACTOR * F.col("n")
    forms = keep_table(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("best.near")).alias("form"),
        F.when(chosen, -F.col("best.minus_n")).cast("long").alias("form_n")), "spelling-forms")
    return forms.join(_roots(forms.select("word", "form")), "word").select(
        "word", "form", "root", F.col("n").cast("long").alias("n"), "n_near", "form_n")
