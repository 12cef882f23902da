"""Mixing of sources to target weights by nested hash thresholds.

Every document has a fixed 60-bit position, the leading digits of a digest of its id. A source takes
its documents below a threshold on that scale, so nothing is sorted and a larger budget takes what a
smaller one does, but for the last few small documents that fill it up. The threshold is found from sums of words by source and hash bucket; only the
bucket that holds the boundary is opened into finer buckets, ``LEVELS`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamlake.llm.common import keep_table, spaced_word_count

POSITION_BITS = 60
LEVEL_BITS = 12
LEVELS = 4  # 48 bits: the last buckets hold one document each up to 10^13 documents of a source
MAX_REPEATS = 3
WEIGHTS = (5, 2, 1)


def position(doc_id: Column) -> Column:
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, POSITION_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
            max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Word budget per source from ``(source, source_size)``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all
    sizes. No budget passes ``max_repeats`` times its source; what is cut off goes to the others by
    weight. That is a water level: the share per weight at which the capped budgets add up to the
    total. Ordered by the share at which they reach their cap, the level is the largest of the
    shares left over after each prefix of capped sources.
    """
    everything = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    earlier = Window.orderBy("cap_share", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    total, weighed = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    left = total - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    share = left.cast("double") / (
        weighed - F.coalesce(F.sum("weight").over(earlier), F.lit(0))).cast("double")
    return (sizes.withColumn("weight", weight.cast("long"))
            .withColumn("cap", F.col("source_size") * max_repeats)
            .withColumn("cap_share", F.col("cap").cast("double") / F.col("weight"))
            .withColumn("share", share)
            .withColumn("level", F.max("share").over(everything))
            .withColumn("target", F.least(F.col("cap").cast("double"),
                                          F.col("weight") * F.col("level")))
            .select("source", "source_size", "target"))


def _search(sized: DataFrame, bounds: DataFrame, nearest: bool) -> DataFrame:
    """``bounds (source, rest, ...)`` with ``limit``, the position below which the documents of ``sized`` hold
    ``rest`` words, and ``rest`` less these. The document at the limit is left out, or with ``nearest``
    taken when that comes nearer."""
    kept = [c for c in bounds.columns if c not in ("rest", "limit", "open")]
    bounds = bounds.withColumn("limit", F.lit(0).cast("long")).withColumn("open", F.col("rest") > 0)
    for level in range(1, LEVELS + 1):
        shift = POSITION_BITS - LEVEL_BITS * level
        at_boundary = bounds.where("open").select(
            F.col("source").alias("of"), F.col("limit").alias("from_here"))
        opened = sized.join(at_boundary, F.col("source").eqNullSafe(F.col("of")) & (
            F.shiftright("position", shift + LEVEL_BITS)
            == F.shiftright("from_here", shift + LEVEL_BITS)))
        sums = (opened.groupBy("source", F.shiftright("position", shift).alias("bucket"))
                .agg(F.sum("size").alias("words")))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        steps = sums.withColumn("upto", running).withColumn("below", F.col("upto") - F.col("words"))
        ends = F.col("b.rest") < F.col("upto")
        if nearest and level == LEVELS:
            ends &= F.col("upto") - F.col("b.rest") > F.col("b.rest") - F.col("below")
        found = (bounds.alias("b").join(steps.alias("s"),
                                        F.col("b.source").eqNullSafe(F.col("s.source")), "left")
                 .groupBy(*(F.col(f"b.{c}") for c in bounds.columns))
                 .agg(F.min(F.when(ends, F.col("s.bucket"))).alias("cut"),
                      F.max(F.when(~ends, F.col("s.upto"))).alias("under"),
                      F.max("s.bucket").alias("last")))
        # No cut: the budget reaches the end of what was opened.
        limit = F.when(F.col("cut").isNotNull(), F.shiftleft("cut", shift)).when(
            F.col("last").isNotNull(), F.shiftleft(F.col("last") + 1, shift)).otherwise(
            F.col("limit"))
        # A row per source: written, so that the plans of the levels do not pile up.
        bounds = keep_table(found.select(
            *kept, F.when(F.col("open"), F.col("rest") - F.coalesce("under", F.lit(0)))
            .otherwise(F.col("rest")).alias("rest"),
            F.when(F.col("open"), limit).otherwise(F.col("limit")).alias("limit"),
            (F.col("open") & F.col("cut").isNotNull()).alias("open")), "mix-level")
    return bounds


def thresholds(sized: DataFrame, budgets: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, target, repeats, limit, left, small_limit)``, written: every document of the
    source is taken ``repeats`` times, those positioned below ``limit`` once more. What the document at
    the limit is too large for, ``left`` words, goes by a second threshold to documents behind it that
    are not larger: those below ``small_limit``."""
    epochs = F.when(F.col("source_size") > 0, F.least(
        F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))).otherwise(0)
    wanted = (budgets.withColumn("repeats", epochs.cast("long"))
              .withColumn("rest", F.when(F.col("repeats") >= max_repeats, 0.0).otherwise(
                  F.col("target") - F.col("repeats") * F.col("source_size"))))
    first = _search(sized, wanted, nearest=False)
    ends = first.select(F.col("source").alias("of"), F.col("limit").alias("end"), F.col("rest").alias("left"))
    small = (sized.join(ends, F.col("source").eqNullSafe(F.col("of")))
             .where((F.col("position") >= F.col("end")) & (F.col("size") <= F.col("left")))
             .select("source", "size", "position"))
    again = first.select("source", "source_size", "target", "repeats", F.col("limit").alias("first_limit"),
                         F.col("rest").alias("left"), "rest")
    return _search(small, again, nearest=True).select(
        "source", "source_size", "target", "repeats", F.col("first_limit").alias("limit"), "left",
        F.col("limit").alias("small_limit"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS,
         max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """The sizes of ``docs (doc_id, source, text)``, ``doc_id, source, size, position``, and the thresholds
    of the sources, both written."""
    sized = keep_table(docs.select(
        "doc_id", "source", spaced_word_count(F.col("text")).alias("size"),
        position(F.col("doc_id")).alias("position")), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    budgets = keep_table(targets(sizes, weights, max_repeats), "mix-targets")
    return sized, thresholds(sized, budgets, max_repeats)


def with_repeats(rows: DataFrame, bounds: DataFrame, size: Column) -> DataFrame:
    """``rows (source, position)`` with ``source_size, target, repeats`` of the mix. ``size`` is only worked
    out between the two limits."""
    of_source = bounds.select(F.col("source").alias("of"), "source_size", "target",
                              F.col("repeats").alias("epochs"), "limit", "left", "small_limit")
    once_more = F.when(F.col("position") < F.col("limit"), 1).when(
        F.col("position") < F.col("small_limit"), F.when(size <= F.col("left"), 1).otherwise(0)).otherwise(0)
    return rows.join(of_source, F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "repeats", F.col("epochs") + once_more).drop("of", "epochs", "limit", "left", "small_limit")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS,
        max_repeats: int = MAX_REPEATS) -> DataFrame:
    """How often the mix takes each document.

    Returns ``doc_id, size, source, source_size, target, repeats, taken``: ``size`` is the number of
    words, ``taken`` those the mix takes, ``size * repeats``. A null or empty text has size 0; a
    null source is a source of its own; a null id is an id of its own. Rows of one id in a source
    are taken or left together. Other columns of ``docs`` are ignored. An empty table gives an empty
    result.

    The texts are read once; sums are combined before each shuffle, so that a source with most of
    the documents is a few rows per task, and the budgets are a row per source.
    """
    sized, bounds = plan(docs, weights, max_repeats)
    return with_repeats(sized, bounds, F.col("size")).drop("position").withColumn(
        "taken", F.col("size") * F.col("repeats"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS,
          max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken."""
    _, bounds = plan(docs, weights, max_repeats)
    rows = docs.select(F.struct("*").alias("row"), "source",
                       position(F.col("doc_id")).alias("position"))
    size = spaced_word_count(F.col("row.text"))
    taken = with_repeats(rows, bounds, size).where("repeats > 0").select(
        "row", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias("copy"))
    return taken.select("row.*")
