"""A training corpus from raw documents: language, near-duplicates, benchmark passages, mix, token files.

Every stage takes the documents the one before it kept, all of them, and applies its operator's decision.
Between the stages the documents are Parquet below the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlake.llm import decontaminate, langid, mixing, neardup, tokens
from streamlake.llm.common import keep_table, prepare, to_every_task
from streamlake.llm.queries import vocabulary
from streamlake.sources.tables import load


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from their labels; those the model rejects go."""
    prepare(spark)
    rows = docs.select("text", F.struct("*").alias("row"))
    return langid.predict(rows, langid.train(docs), keep="row").where("NOT rejected").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id, one without id last. Rows are
    told apart by id and text, so texts of a repeated id are judged each for itself. Texts without
    words are nobody's duplicate and stay."""
    prepare(spark)
    key = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")
    named = keep_table(
        neardup.classes(docs.select(key.alias("doc_id"), "text"))
        .groupBy(F.col("doc_id").alias("of"), "component_id")
        .agg(F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies")), "pipeline-classes")
    ids = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("id")).distinct()
    first = (named.where("n > 0").join(ids, F.col("of") == F.col("key")).groupBy("component_id")
             .agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "key", "copies")).alias("first")))
    chosen = keep_table(first.select(F.col("first.key").alias("of"), F.col("first.copies").alias("copies"))
                        .union(named.where("n = 0").select("of", F.lit(1).cast("long"))), "pipeline-chosen")
    # Few go or stand several times, most stay: the texts of these are not shuffled.
    several = chosen.where("copies > 1").select("of", F.lit(True).alias("stays"))
    gone = named.where("n > 0").select("of").distinct().join(chosen, "of", "left_anti")
    singled_out = keep_table(several.union(gone.select("of", F.lit(False))), "pipeline-singled-out")
    rows = docs.select(key.alias("key"), F.struct("*").alias("row"))
    others = rows.join(to_every_task(singled_out.select("of")), F.col("key") == F.col("of"), "left_anti")
    # Only rows that are there several times are brought together, one of each task.
    once = (rows.join(to_every_task(singled_out.where("stays").select("of")), F.col("key") == F.col("of"), "left_semi")
            .groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row")))
    return others.select("row.*").unionByName(once.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Rows are told apart by id and text."""
    prepare(spark)
    key = F.struct("doc_id", F.xxhash64("text").alias("text"))
    found = decontaminate.find(docs.select(key.alias("doc_id"), "text"), load(spark, sf_dir, "benchmark"))
    hit = keep_table(found.where("n_hit > 0").select(F.col("doc_id").alias("hit")).distinct(),
                     "pipeline-contaminated")
    rows = docs.select(key.alias("key"), F.struct("*").alias("row"))
    return rows.join(hit, F.col("key") == F.col("hit"), "left_anti").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it."""
    prepare(spark)
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of the mix, written and read back: a row per written document."""
    prepare(spark)
    return tokens.digests(spark, tokens.write(docs, vocabulary()))


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_duplicates),
          ("benchmark decontamination", decontamination), ("mixing to target weights", mixture),
          ("token files", token_files)]

# Entropies of learned models and token ids are not SQL; tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep_table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
