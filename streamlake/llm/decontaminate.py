"""Benchmark passages in documents, found by winnowing.

Of each run of ``w`` consecutive k-gram hashes of a text the smallest is a fingerprint. Two texts that
share ``k + w - 1`` consecutive words share such a run and so a fingerprint of it: joined on their
fingerprints, no common passage of that length is missed. Each meeting is then extended: every window of
the document around it is looked up, word by word, among the windows of the benchmark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlake.llm.common import keep_table

# What a word is, after A-Z are lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WINDOW_WORDS = 10
AROUND = "struct<n:int,low:int,high:int>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row, though ``body`` uses it many times."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    # `lower` is the faster way to lower-case A-Z, but changes other letters, too.
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(
        F.lower(text))

    def trimmed(parts: Column) -> Column:  # only the first and the last part can be empty
        front = F.when(parts[0] == "", 1).otherwise(0)
        back = F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
        return F.slice(parts, front + 1, F.greatest(F.size(parts) - front - back, F.lit(0)))

    return let(F.split(F.coalesce(plain, F.lit("")), NO_WORD), trimmed)


def sliding(array: Column, width: int, op) -> Column:
    """``op`` over every run of ``width`` elements, from runs of half the width that may overlap."""
    def pairs(shift: int):
        def paired(of: Column) -> Column:
            n = F.greatest(F.size(of) - shift, F.lit(0))
            return F.zip_with(F.slice(of, 1, n), F.slice(of, shift + 1, n),
                              lambda a, b: op(a, b))
        return paired

    have = 1
    while 2 * have <= width:
        array = let(array, pairs(have))
        have *= 2
    return let(array, pairs(width - have)) if have < width else array


def gram_length(length: int) -> int:
    """Words in a k-gram, for passages of ``length`` words: about half of it."""
    return (length + 1) // 2


def fingerprints(all_words: Column, length: int) -> Column:
    """For each k-gram, by the place of its first word: its hash if it is the smallest of some window
    of them, else null. Empty if there are fewer than ``length`` words."""
    k = gram_length(length)
    w = length - k + 1
    edge = F.array_repeat(F.lit(-(1 << 63)), w - 1)

    def chosen(h: Column) -> Column:
        minima = sliding(h, w, F.least)
        largest = sliding(F.concat(edge, minima, edge), w, F.greatest)
        return F.zip_with(h, largest, lambda own, best: F.when(own == best, own))

    none = F.array().cast("array<bigint>")
    return let(all_words, lambda of: F.when(F.size(of) < length, none).otherwise(
        let(sliding(F.transform(of, lambda x: F.xxhash64(x)), k, F.xxhash64), chosen)))


def _windows(bench: DataFrame, length: int) -> DataFrame:
    """``item_id, n, window``: the windows of each item, of ``length`` words or all of a shorter
    item's."""
    rows = bench.select(F.col("item_id").cast("string").alias("item_id"),
                        F.explode(F.array(words(F.col("text")))).alias("words"))
    n = F.least(F.size("words"), F.lit(length))
    return (rows.where(F.size("words") > 0)
            .select("item_id", n.alias("n"), F.explode(F.transform(
                F.sequence(F.lit(1), F.size("words") - n + 1),
                lambda i: F.array_join(F.slice("words", i, n), " "))).alias("window"))
            .distinct())


def find(docs: DataFrame, bench: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """Which words of each document lie in a passage of the benchmark.

    A window is ``length`` consecutive words of an item, or all words of a shorter one. Returns, for
    each row of ``docs (doc_id, text)``, ``doc_id, n_words, spans, n_hit, items``: ``spans`` are the
    word ranges ``(begin, end)`` of window occurrences in order, ``n_hit`` the words any of them
    covers, ``items`` the ids (as strings, in order) of the items they belong to, both empty where
    nothing occurs. A null or empty text has no words and no hit; null document ids are kept; items
    of a null id cover words, but are not listed; repeated rows get equal results, repeated items
    count once. Other columns are ignored. An empty benchmark hits nothing.

    The texts are not shuffled for the search: only fingerprints that meet one of the benchmark
    leave a scan when its fingerprints fit a broadcast, and all fingerprints, two of ``w + 1``
    k-grams, are joined by hash otherwise. Texts travel once to meet what was found in them.
    What is gathered per document is bounded by its number of words.
    """
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    windows = keep_table(_windows(bench, length), "benchmark-windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # 1 to `length`
    split = texts.select("doc_id", "text_key",
                         F.explode(F.array(words(F.col("text")))).alias("words"))
    entries = [split.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"),
                            F.lit(None).cast(AROUND).alias("around"))] if not lengths else []
    for n in lengths:
        wanted = (windows.where(F.col("n") == n).select("window").distinct()
                  .select(F.explode(fingerprints(F.split("window", " "), n)).alias("wanted"))
                  .where("wanted IS NOT NULL").distinct())
        # In front of a text's fingerprints stands one entry for the text itself.
        listed = split.select(
            "doc_id", "text_key", F.size("words").cast("long").alias("n_words"), F.posexplode(
                F.concat(F.array("text_key"), fingerprints(F.col("words"), n))).alias("at", "hash"))
        itself = (F.col("at") == 0) & F.lit(n == lengths[0])
        first, back = F.col("at") - 1, n - gram_length(n)
        entries.append(
            listed.where(F.col("hash").isNotNull())
            .join(wanted, F.col("hash") == F.col("wanted"), "left")
            .where(itself | ((F.col("at") > 0) & F.col("wanted").isNotNull()))
            .select("doc_id", "text_key", F.when(itself, F.col("n_words")).alias("n_words"),
                    F.when(F.col("at") > 0, F.struct(
                        F.lit(n).alias("n"), F.greatest(first - back, F.lit(0)).alias("low"),
                        first.alias("high"))).alias("around")))
    met = entries[0]
    for more in entries[1:]:
        met = met.union(more)
    met = keep_table(met.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"),
        F.collect_set("around").alias("around")), "passages-met")
    no_spans = F.array().cast("array<struct<begin:int,end:int>>")
    around = met.where(F.size("around") > 0).select(
        F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"), "around")
    here = (texts.join(around, F.col("doc_id").eqNullSafe(F.col("of_doc"))
                       & (F.col("text_key") == F.col("of_text")))
            .select("doc_id", "text_key", F.explode(F.array(F.struct(
                words(F.col("text")).alias("words"), "around"))).alias("x")))
    # Begin and length of a window in one number, of which Spark finds the distinct ones by hashing.
    base = length + 1

    def begins(a: Column) -> Column:
        last = F.least(a["high"], F.size("x.words") - a["n"])
        return F.transform(F.when(a["low"] <= last, F.sequence(a["low"], last)).otherwise(
            F.array().cast("array<int>")), lambda s: s.cast("long") * base + a["n"])

    starts = F.array_distinct(F.flatten(F.transform(F.col("x.around"), begins)))
    tried = here.select("doc_id", "text_key", "x.words", F.explode(starts).alias("start")).select(
        "doc_id", "text_key", "words", F.expr(f"start DIV {base}").cast("int").alias("begin"),
        (F.col("start") % base).cast("int").alias("n")).select(
        "doc_id", "text_key",
        F.struct("begin", (F.col("begin") + F.col("n")).alias("end")).alias("span"),
        F.array_join(F.slice("words", F.col("begin") + 1, F.col("n")), " ").alias("tried"))
    found = keep_table(tried.join(windows.select("window").distinct(),
                                  F.col("tried") == F.col("window"), "left_semi"), "passages")
    listed = (found.select("doc_id", "text_key", "tried").distinct()
              .join(windows.where("item_id IS NOT NULL").select("window", "item_id"),
                    F.col("tried") == F.col("window"))
              .groupBy("doc_id", "text_key")
              .agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    covered = F.aggregate(
        F.col("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda c, s: F.struct(
            (c["n"] + F.greatest(s["end"] - F.greatest(s["begin"], c["upto"]), F.lit(0)))
            .alias("n"), F.greatest(c["upto"], s["end"]).alias("upto")), lambda c: c["n"])
    spans = (found.groupBy("doc_id", "text_key")
             .agg(F.array_sort(F.collect_set("span")).alias("spans"))
             .select("doc_id", "text_key", "spans", covered.cast("long").alias("n_hit")))

    def same(a: str, b: str) -> Column:
        return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(
            f"{a}.text_key").eqNullSafe(F.col(f"{b}.text_key"))

    return (met.alias("c").join(spans.alias("s"), same("c", "s"), "left")
            .join(listed.alias("i"), same("c", "i"), "left")
            .select("c.doc_id", "c.n_words", F.coalesce("s.spans", no_spans).alias("spans"),
                    F.coalesce("s.n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("i.items", F.array().cast("array<string>")).alias("items"),
                    F.explode(F.sequence(F.lit(1).cast("long"), F.col("c.copies"))).alias("copy"))
            .drop("copy"))
