"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlake.llm import (
    decontaminate,
    embeddings,
    extract,
    langid,
    licenses,
    mixing,
    neardup,
    sharding,
    spelling,
    tokens,
    toxicity,
    warc,
    whitening,
)
from streamlake.llm.common import prepare
from streamlake.sources.tables import load


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    prepare(spark)
    pages = load(spark, sf_dir, "pages")
    rows = pages.select("html", F.struct("page_id", "url").alias("row"))
    texts = extract.extract(rows, extract.train(pages), keep="row")
    return texts.select("row.page_id", "row.url", "text",
                        F.char_length("text").cast("long").alias("n_chars"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those not held out."""
    prepare(spark)
    docs = load(spark, sf_dir, "documents")
    told = langid.predict(docs.select("text", F.struct("doc_id").alias("row")),
                          langid.train(docs), keep="row")
    return told.select("row.doc_id", langid.held_out(F.col("row.doc_id")).alias("held_out"),
                       "lang_pred", "score")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back."""
    prepare(spark)
    records = warc.read(spark, warc.write(load(spark, sf_dir, "pages")))
    return records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
                          "payload_digest", "record_type", "refers_to")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    prepare(spark)
    found = decontaminate.find(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    prepare(spark)
    return neardup.classes(load(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of all documents: the best one, and how many there are of which licences."""
    prepare(spark)
    found = licenses.scan(load(spark, sf_dir, "documents"))
    best = F.when(F.size("matches") > 0, F.col("matches")[0])
    names = F.array_sort(F.array_distinct(F.col("matches")["license"]))
    return found.select("doc_id", best["license"].alias("license"), best["dice"].alias("dice"),
                        F.size("matches").cast("long").alias("n_matches"),
                        F.array_join(names, ",").alias("licenses"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    prepare(spark)
    return mixing.mix(load(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all vectors."""
    prepare(spark)
    return embeddings.classes(load(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, from the files of the shards."""
    prepare(spark)
    docs = load(spark, sf_dir, "documents")
    written = sharding.read_shards(spark, sharding.shard(docs), docs.schema)
    checked = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return written.select(
        "doc_id", sharding.text_bytes(F.col("text")).alias("size"),
        F.crc32(checked).alias("text_crc32"), F.lit(sharding.LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    prepare(spark)
    return tokens.digests(spark, tokens.write(load(spark, sf_dir, "documents"), vocabulary()))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every usable vector on the 16 leading components."""
    prepare(spark)
    return whitening.whiten(load(spark, sf_dir, "embeddings")).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of those not held out."""
    prepare(spark)
    docs = load(spark, sf_dir, "documents")
    model = toxicity.train(docs, load(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("text", F.struct("doc_id").alias("row")), model)
    return scored.select("row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"),
                         "score", "predicted")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of every word of all documents, with their forms and roots."""
    prepare(spark)
    return spelling.variants(load(spark, sf_dir, "documents"))


QUERIES = {"op1_extract": op1_extract, "op6_licenses": op6_licenses, "op2_langid": op2_langid, "op4_decontaminate": op4_decontaminate, "op5_neardup": op5_neardup,
           "op3_warc": op3_warc, "op7_mixing": op7_mixing, "op8_embeddings": op8_embeddings, "op9_sharding": op9_sharding,
           "op10_tokens": op10_tokens, "op11_whitening": op11_whitening, "op12_toxicity": op12_toxicity,
           "op13_spelling": op13_spelling}
