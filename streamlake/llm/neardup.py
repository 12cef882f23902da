"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A signature is ``CHUNKS * CHUNK_SLOTS`` slots of ``SLOT_BITS`` bits, each from the smallest of the
set's shingles under a hash function of its own, so two slots agree with a probability equal to the sets'
similarity. Their distance is the number of slots that differ. By pigeonhole, signatures at
most ``2 * CHUNKS - 1`` apart have a chunk in which at most one slot differs. The join enumerates that
error: every chunk is indexed once for each slot, with this slot left out. So every pair within that
distance meets, and of pairs at a similarity of 0.75, whose distance varies about a quarter of the slots,
all but about one in a million have such a chunk. Links are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamlake.llm.common import in_blocks, keep_table, runs, to_every_task
from streamlake.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY = 75  # per cent
CHUNKS, CHUNK_SLOTS, SLOT_BITS = 18, 6, 16
SLOTS = CHUNKS * CHUNK_SLOTS
WIDE_BITS = 4096
# A pair at the similarity bound exceeds these distances with a probability below 1e-7: a quarter of the
# slots plus 5.4 deviations, and an eighth of the bits plus as many, as half of the bits of
# unequal minima agree by chance.
MOST_DIFFERENT_SLOTS = 51
MOST_DIFFERENT_BITS = 626
COMPARED_ROWS = 2000  # of a key, compared with each other in one task
CACHED_WORDS = 300_000
VERIFY_BLOCK = 64  # documents compared with one other per task entry

FEATURES = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, signature binary"


def _constants(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit numbers."""
    return np.random.default_rng(seed).integers(
        0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_MULTIPLIERS = _constants(SLOTS, 11)
_OFFSETS = _constants(SLOTS, 12)
_SLOT_WEIGHTS = _constants(SLOTS, 13).reshape(CHUNKS, CHUNK_SLOTS)
_WIDE_MULTIPLIERS = _constants(WIDE_BITS, 15).astype(np.uint32)
_KEY_SALTS = _constants(SLOTS, 14).reshape(CHUNKS, CHUNK_SLOTS)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """64-bit hashes of the distinct word shingles of texts, sorted."""

    def __init__(self, words: int = SHINGLE_WORDS):
        import xxhash

        self.words, self.digest, self.known = words, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = text.encode().lower().split() if text else []  # of bytes: A-Z and ASCII space
        if not tokens:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for token in set(tokens).difference(known):
            known[token] = self.digest(token)
        hashes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        span = min(self.words, len(hashes))
        n = len(hashes) - span + 1
        rolled = np.full(n, np.uint64(span))
        for i in range(span):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + n]
        return np.unique(_mixed(rolled))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of slots for each non-empty set."""
    flat = np.concatenate(sets)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), SLOTS), np.uint16)
    for i in range(SLOTS):
        least = np.minimum.reduceat((flat ^ _OFFSETS[i]) * _MULTIPLIERS[i], begins)
        out[:, i] = (_mixed(least) >> np.uint64(64 - SLOT_BITS)).astype(np.uint16)
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """For each row, chunk and slot of it: a key of the chunk's other slots."""
    slots = signature.reshape(-1, CHUNKS, CHUNK_SLOTS).astype(np.uint64)
    weighted = _mixed(slots + _SLOT_WEIGHTS) * _SLOT_WEIGHTS
    rest = weighted.sum(axis=2, dtype=np.uint64)[:, :, None] - weighted
    return _mixed(rest + _KEY_SALTS).reshape(len(signature), SLOTS).view(np.int64)


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, signature`` per row: set size, 128-bit digest of the set, and its
    signature (null where the set is empty)."""
    def computed(batches):
        shingler = Shingler()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                sets, size, begin = [], 0, at
                while at < len(texts) and size < 60_000:  # so that a working array stays in cache
                    sets.append(shingler(texts[at].as_py()))
                    size += len(sets[-1])
                    at += 1
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full)) if full else iter(())
                digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8")
                           for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, at - begin), pa.array(map(len, sets), pa.int64()),
                     pa.array([d[0] for d in digests], pa.int64()),
                     pa.array([d[1] for d in digests], pa.int64()),
                     pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["doc_id", "n_shingles", "d1", "d2", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        computed, FEATURES)


def _index(nodes: DataFrame) -> DataFrame:
    """``key, entry, node, n``: the entries of every class in the index."""
    def entries(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                slots = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, SLOTS)
                keys = chunk_keys(slots).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.tile(np.arange(SLOTS, dtype=np.int16), len(slots))),
                     pa.array(np.repeat(part.column(0).to_numpy(), SLOTS)),
                     pa.array(np.repeat(part.column(1).to_numpy(), SLOTS))],
                    ["key", "entry", "node", "n"])

    return nodes.select("node", "n", "signature").mapInArrow(
        entries, "key bigint, entry smallint, node bigint, n bigint")


def _wide(bodies: DataFrame) -> DataFrame:
    """``node, wide``: signatures of many one-bit slots, which tell similarities apart more finely."""
    def widened(batches):
        shingler = Shingler()
        for batch in batches:
            cells = []
            for text in batch.column(1):
                own = (shingler(text.as_py()) >> np.uint64(32)).astype(np.uint32)
                least = np.empty(WIDE_BITS, np.uint32)
                step = max(1, min(64, (1 << 16) // len(own)))  # so that a working array stays in cache
                for begin in range(0, WIDE_BITS, step):
                    np.min(own * _WIDE_MULTIPLIERS[begin:begin + step, None], axis=1,
                           out=least[begin:begin + step])
                cells.append(np.packbits(_mixed(least.astype(np.uint64)) >> np.uint64(63) > 0).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())],
                                             ["node", "wide"])

    return bodies.mapInArrow(widened, "node bigint, wide binary")


def _across(apart: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of different labels that meet in a key, each at the first key it meets in, near
    by signature and by wide signature.

    ``apart``: ``key, entry, held, node, n, label, signature, wide``. A key is compared in blocks.
    """
    def compared(batches):
        for group in runs(batches, ["key", "low", "high"]):
            if group.num_rows < 2:
                continue
            node, n, label, part = (group.column(c).to_numpy() for c in ("node", "n", "label", "part"))
            entry, low, high = (group.column(c)[0].as_py() for c in ("entry", "low", "high"))
            slots = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint16).reshape(
                -1, SLOTS)
            wide = np.frombuffer(b"".join(group.column("wide").to_pylist()), np.uint64).reshape(
                len(node), -1)
            found = []
            for i in range(len(node) - 1):
                j = np.arange(i + 1, len(node))
                small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                j = j[(label[j] != label[i]) & (100 * small >= SIMILARITY * large)
                      & ((part[j] != part[i]) if low != high else True)]
                if not len(j):
                    continue
                equal = slots[j] == slots[i]
                near = SLOTS - equal.sum(axis=1) <= MOST_DIFFERENT_SLOTS
                j, equal = j[near], equal[near].reshape(-1, CHUNKS, CHUNK_SLOTS)
                j = j[_first_entry(equal) == entry]
                j = j[np.bitwise_count(wide[j] ^ wide[i]).sum(axis=1) <= MOST_DIFFERENT_BITS]
                found += [(min(node[i], x), max(node[i], x)) for x in node[j]]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in found], pa.int64()),
                     pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return (in_blocks(apart, F.col("held"), COMPARED_ROWS, F.xxhash64("node"))
            .repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
            .mapInArrow(compared, "a bigint, b bigint"))


def _first_entry(equal: np.ndarray) -> np.ndarray:
    """The first entry of the index that two signatures share, from where their slots are equal:
    in the first chunk with at most one error, the one that leaves out this error."""
    errors = CHUNK_SLOTS - equal.sum(axis=2)
    chunk = (errors <= 1).argmax(axis=1)
    slot = np.take_along_axis(~equal, chunk[:, None, None], axis=1)[:, 0].argmax(axis=1)
    return chunk * CHUNK_SLOTS + slot


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose signatures differ in few enough slots."""
    def close(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16)
                           .reshape(-1, SLOTS) for i in (2, 3))
            keep = pa.array((left != right).sum(axis=1) <= MOST_DIFFERENT_SLOTS)
            yield batch.select(["a", "b"]).filter(keep)

    left = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
            .mapInArrow(close, "a bigint, b bigint"))


def _confirmed(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that are similar enough by their full sets.

    Texts are dealt out by ``a`` and a block of its partners, so a document with many partners is
    compared in many tasks and no text stands in one row for each of its pairs.
    """
    # Written, so that the join is of two plain tables, which Spark splits where one ``a`` is hot.
    partners = keep_table(pairs.groupBy(F.col("a").alias("of")).count(), "neardup-partners")
    wide = pairs.join(partners, F.col("a") == F.col("of"))
    dealt = wide.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / VERIFY_BLOCK))
                        .alias("block"))
    asked = (dealt.select("a", "block", F.col("b").alias("node"), F.lit(1).alias("role"))
             .union(dealt.select("a", "block", F.col("a").alias("node"), F.lit(0).alias("role"))
                    .distinct()))

    def compared(batches):
        shingler, place, sets, linked = Shingler(), None, [], None
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                a, block, role, node = (batch.column(i)[row].as_py() for i in range(4))
                own = shingler(batch.column(4)[row].as_py())
                if (a, block) != place:
                    place, sets = (a, block), []
                if role == 0:
                    sets.append(own)
                elif (a, block, node) != linked:
                    for other in sets:
                        small, large = sorted((len(own), len(other)))
                        if 100 * small < SIMILARITY * large:
                            continue
                        common = len(np.intersect1d(own, other, assume_unique=True))
                        if 100 * common >= SIMILARITY * (small + large - common):
                            found.append((a, node))
                            linked = (a, block, node)
                            break
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in found], pa.int64()),
                     pa.array([y for _, y in found], pa.int64())], ["u", "v"])

    return (asked.join(bodies, "node").repartition("a", "block")
            .sortWithinPartitions("a", "block", "role", "node")
            .select("a", "block", "role", "node", "text").mapInArrow(compared, "u bigint, v bigint"))


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text``: the rows of ``docs`` whose id is among ``nodes``."""
    wanted = to_every_task(keep_table(nodes, "neardup-wanted"))
    return docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(wanted, "node", "left_semi")


def classes(docs: DataFrame) -> DataFrame:
    """Near-duplicate classes of ``docs (doc_id, text)``.

    Returns, per row, ``doc_id, n_shingles, component_id, kept``. Sets hold the distinct 5-word
    shingles, or the whole sequence of fewer words. Rows are linked where the intersection is at
    least three quarters of the union; ``component_id`` is the smallest id that links reach, and
    ``kept`` says that the row has it. Null, empty and blank texts have no shingles and are linked
    with nothing; a row without id is linked with nothing and kept; rows of one id share a place in
    the graph, whatever their texts. Other columns are ignored.

    Rows with equal sets are one class, named after its smallest id, before anything is indexed.
    Within a key of the index every class is first compared with the smallest only, which joins
    large groups of copies with few comparisons. What remains are keys that hold classes still apart: their
    pairs across components are compared by signature, in blocks, and only near ones leave the
    task, once each. So no link between components is lost, while copies are not expanded into all
    pairs.
    """
    rows = keep_table(features(docs), "neardup-features")
    nodes = keep_table(
        rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n"),
             F.first("signature").alias("signature")), "neardup-nodes")
    of_key = Window.partitionBy("key")
    shared = keep_table(
        _index(nodes).withColumn("first", F.min(F.struct("node", "n")).over(of_key))
        .withColumn("held", F.count(F.lit(1)).over(of_key)).where("held > 1")
        .select("key", "entry", "node", "n", F.col("first.node").alias("lead"), F.col("first.n").alias("lead_n"),
                "held"), "neardup-shared")
    bodies = keep_table(_texts(docs, shared.select("node").distinct()), "neardup-bodies")

    def comparable(a: str, b: str):
        return 100 * F.least(a, b) >= SIMILARITY * F.greatest(a, b)

    tried = keep_table(
        shared.where((F.col("node") != F.col("lead")) & comparable("n", "lead_n"))
        .select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "neardup-tried")
    links = keep_table(_confirmed(_near(tried, nodes), bodies), "neardup-links")
    labels = keep_table(components(links), "neardup-labels")

    labelled = (shared.where("held > 2").select("key", "entry", "held", "node", "n").alias("s")
                .join(labels.alias("l"), F.col("s.node") == F.col("l.node"), "left")
                .select("key", "entry", "held", "s.node", "n",
                        F.coalesce("l.component", "s.node").alias("label")))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(
        "low != high").select(F.col("key").alias("mixed_key"))
    apart = keep_table(labelled.join(mixed, F.col("key") == F.col("mixed_key"), "left_semi"),
                       "neardup-apart")
    asked = apart.select("node").distinct()
    wide = (_wide(bodies.join(asked, "node", "left_semi")).join(
        nodes.select(F.col("node").alias("of"), "signature"), F.col("node") == F.col("of")).drop("node"))
    met = _across(apart.join(wide, F.col("node") == F.col("of")).drop("of"))
    rest = keep_table(met.distinct().join(tried, ["a", "b"], "left_anti"), "neardup-rest")
    if not rest.isEmpty():
        more = keep_table(_confirmed(rest, bodies), "neardup-links")
        if not more.isEmpty():
            labels = keep_table(components(links.union(more)), "neardup-labels")
    named = nodes.select("d1", "d2", "node").alias("c").join(
        labels.alias("l"), F.col("c.node") == F.col("l.node"), "left").select(
        F.col("c.d1").alias("e1"), F.col("c.d2").alias("e2"),
        F.coalesce("l.component", "c.node").alias("class_id"))
    own = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(own, F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id"))
    return (rows.drop("signature")
            .join(named, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
            .select("doc_id", "n_shingles", component.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
