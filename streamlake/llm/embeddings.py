"""Near-duplicate vectors by a pivot permutation index.

A vector is described by the ``NEAREST`` of ``PIVOTS`` reference vectors that lie nearest to it, in
order. Near vectors see nearly the same pivots nearest. The inverted lists of the index hold, for every
``SHARED`` pivots, the vectors that have them all among their nearest: two vectors meet in a list
exactly if they share that many. What meets is verified by its cosine.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlake.llm.common import in_blocks, keep_table, runs, sample_of
from streamlake.llm.components import components

PIVOTS = 256
SAMPLE = 8 * PIVOTS  # vectors the pivots are chosen from; every vector is indexed
NEAREST = 6
SHARED = 3
COSINE = 0.98
COMPARED_ROWS = 1000  # of a list, compared with each other in one task
SUBSETS = np.array(list(combinations(range(NEAREST), SHARED)))
PIVOT_BITS = 12


def described(rows: DataFrame) -> DataFrame:
    """``vec_id, label, vector, usable, d1, d2``: a vector is usable with an id, a label, no null or
    non-finite component, and not all zero; ``d1, d2`` are a digest of label and vector."""
    vector = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))  # -0 becomes 0
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    wanted = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
              & sound & F.exists("vector", lambda x: x != 0))
    return (rows.select(F.col("vec_id").cast("long").alias("vec_id"),
                        F.col("label").cast("string").alias("label"), vector.alias("vector"))
            .withColumn("usable", F.coalesce(wanted, F.lit(False)))
            .withColumn("d1", F.xxhash64("label", "vector"))
            .withColumn("d2", F.xxhash64(F.lit(1), "vector", "label")))


def _unit(column) -> list[np.ndarray]:
    """Vectors scaled to length 1, without overflow or underflow on the way."""
    out = []
    for cell in column:
        v = np.asarray(cell.values.to_numpy(), np.float64)
        v = v / np.abs(v).max()
        out.append(v / np.sqrt(v @ v))
    return out


def choose_pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Reference vectors by dimension, each the one furthest from those before it, out of about ``SAMPLE``
    vectors: so a large group of copies gives one pivot and not many."""
    sample = sample_of(vectors, SAMPLE, F.col("vec_id"))
    by_size: dict[int, list] = {}
    for v in _unit(sample.select("vector").toArrow().column(0)):
        by_size.setdefault(len(v), []).append(v)
    chosen = {}
    for size, vectors in by_size.items():
        table = np.stack(vectors)
        nearest, picked = np.full(len(table), -2.0), [0]
        while len(picked) < min(PIVOTS, len(table)):
            nearest = np.maximum(nearest, table @ table[picked[-1]])
            nearest[picked] = 2
            picked.append(int(nearest.argmin()))
        chosen[size] = table[picked]
    return chosen


def nearest_pivots(nodes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``nodes`` with ``nearest``, the ordered nearest pivots as packed 16-bit numbers; null where the
    dimension has too few pivots."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)

    def ranked(batches):
        known = shared.value
        for batch in batches:
            cells = []
            for v in _unit(batch.column(0)):
                references = known.get(len(v), ())
                cells.append(np.argsort(-(references @ v), kind="stable")[:NEAREST].astype("<u2").tobytes()
                             if len(references) >= NEAREST else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.binary())], [*batch.schema.names, "nearest"])

    return nodes.select("vector", *(c for c in nodes.columns if c != "vector")).mapInArrow(
        ranked, T.StructType([nodes.schema["vector"], *(f for f in nodes.schema if f.name != "vector"),
                              T.StructField("nearest", T.BinaryType())]))


def list_numbers(nearest: np.ndarray) -> np.ndarray:
    """The inverted lists of rows of nearest pivots, a column for each subset of ``SHARED`` ranks of
    the pivots in ascending order."""
    subset = np.sort(nearest.astype(np.int64), axis=1)[:, SUBSETS]
    number = np.zeros(subset.shape[:2], np.int64)
    for i in range(SHARED):
        number = (number << PIVOT_BITS) | subset[:, :, i]
    return number


def inverted(nodes: DataFrame) -> DataFrame:
    """``node, list, key`` for each list a vector is in; ``key`` stands for the list, the label and the
    dimension. Without pivots, all vectors of a label and dimension are in list -1."""
    def listed(batches):
        for batch in batches:
            has = batch.column(1).is_valid()
            for part, known in ((batch.filter(has), True), (batch.filter(pc.invert(has)), False)):
                if not part.num_rows:
                    continue
                numbers = list_numbers(np.frombuffer(
                    b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, NEAREST)) if known \
                    else np.full((part.num_rows, 1), -1)
                at = pa.array(np.repeat(np.arange(len(numbers)), numbers.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), pa.array(numbers.ravel())], ["node", "list"])

    described_node = F.struct("node", "label", F.size("vector").alias("size")).alias("node")
    lists = nodes.select(described_node, "nearest").mapInArrow(
        listed, "node struct<node:bigint,label:string,size:int>, list bigint")
    return lists.select("node.node", "list",
                        F.xxhash64("list", "node.label", "node.size").alias("key"))


def _compared(batches):
    """For each list, in blocks: ``node, links, root``. A pair counts in the first list it shares;
    ``links`` counts the vectors, copies included, that a node is linked with here, and ``root``
    is the least node that these links reach."""
    for group in runs(batches, ["key", "low", "high"]):
        if group.num_rows < 2:
            continue
        node, copies, part = (group.column(c).to_numpy() for c in ("node", "copies", "part"))
        number, low, high = (group.column(c)[0].as_py() for c in ("list", "low", "high"))
        label = np.array(group.column("label").to_pylist(), object)
        units = _unit(group.column("vector"))
        if len({len(u) for u in units}) > 1:  # two kinds of vectors under one hash
            continue
        units = np.stack(units)
        linked = np.triu(units @ units.T >= COSINE, 1)
        linked &= (label[:, None] == label[None, :]) & (node[:, None] != node[None, :])
        if low != high:
            linked &= part[:, None] != part[None, :]
        a, b = np.nonzero(linked)
        if number >= 0 and len(a):
            pivots = np.frombuffer(b"".join(group.column("nearest").to_pylist()), "<u2").reshape(
                -1, NEAREST)
            ranks = np.sort(pivots, axis=1)
            keep = []
            for begin in range(0, len(a), 100_000):
                x, y = ranks[a[begin:begin + 100_000]], ranks[b[begin:begin + 100_000]]
                common = (x[:, :, None] == y[:, None, :]).any(axis=2)
                first = np.argsort(~common, axis=1, kind="stable")[:, :SHARED]
                chosen = np.take_along_axis(x, first, axis=1).astype(np.int64)
                own = np.zeros(len(x), np.int64)
                for i in range(SHARED):
                    own = (own << PIVOT_BITS) | chosen[:, i]
                keep.append(own == number)
            keep = np.concatenate(keep)
            a, b = a[keep], b[keep]
        if not len(a):
            continue
        links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
        root, before = node.copy(), None
        while before is None or (root != before).any():
            before = root.copy()
            np.minimum.at(root, a, before[b])
            np.minimum.at(root, b, before[a])
        rows = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[rows]), pa.array(links[rows].astype(np.int64)), pa.array(root[rows])],
            ["node", "links", "root"])


def classes(rows: DataFrame) -> DataFrame:
    """Near-duplicate classes of ``rows (vec_id, embedding, label)``.

    Returns, per row, ``vec_id, n_links, component_id, kept``. Rows with equal labels are linked where
    their cosine, in double precision, is ``COSINE`` or more: ``n_links`` counts the other rows a
    row is linked with, ``component_id`` is the smallest id that links reach, and ``kept`` says that
    the row has it. Vectors that are null, zero or hold null or non-finite components, and rows
    without label or id, are linked with nothing; vectors of different dimensions are not compared.
    Other columns are ignored.

    Rows of equal label and vector are one node, so copies are neither indexed nor compared; rows of
    one id and several vectors share their component. A list is compared in blocks of a bounded
    size; what leaves a block is a row per node, not the pairs.
    """
    known = described(rows)
    nodes = keep_table(nearest_pivots(
        known.where("usable").groupBy("d1", "d2").agg(
            F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"),
            F.first("label").alias("label"), F.first("vector").alias("vector")),
        choose_pivots(known.where("usable").select("vec_id", "vector"))), "vectors")
    sizes = inverted(nodes)
    lists = keep_table(
        sizes.join(sizes.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
                   .withColumnRenamed("key", "of"), F.col("key") == F.col("of")).drop("of"), "lists")
    told = lists.join(nodes.select(F.col("node").alias("of"), "copies", "label", "vector", "nearest"),
                      F.col("node") == F.col("of")).drop("of")
    met = keep_table(
        in_blocks(told, F.col("held"), COMPARED_ROWS, F.xxhash64("node"))
        .repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        .mapInArrow(_compared, "node bigint, links bigint, root bigint"), "links")
    labels = components(met.select(F.col("node").alias("u"), F.col("root").alias("v")))
    sums = met.groupBy("node").agg(F.sum("links").alias("links"))
    named = (nodes.select("d1", "d2", "node", "copies").alias("n")
             .join(sums.alias("s"), F.col("n.node") == F.col("s.node"), "left")
             .join(labels.alias("l"), F.col("n.node") == F.col("l.node"), "left")
             .select(F.col("d1").alias("e1"), F.col("d2").alias("e2"),
                     (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("l.component", "n.node").alias("class_id")))
    joined = known.select("vec_id", "usable", "d1", "d2").join(
        named, F.col("usable") & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
