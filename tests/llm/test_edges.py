"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from streamlake.llm import (
    common,
    decontaminate,
    embeddings,
    extract,
    langid,
    licenses,
    mixing,
    neardup,
    sharding,
    tokens,
    warc,
)
from streamlake.llm.queries import vocabulary
from streamlake.sources.tables import load

# Names the operators use inside, as further columns of the input.
CLASHING = ["text_key", "words", "hash", "at", "around", "of_doc", "copies", "node", "key", "label", "d1", "d2",
            "signature", "n_shingles", "component_id", "kept", "size", "position", "repeats", "of", "limit", "target",
            "bucket", "slot", "shard", "place", "row", "score", "rejected", "lang_pred", "matches", "found", "id", "turn",
            "chosen", "hit", "copy", "source_size", "start", "n_tokens"]
LONG = "a long text of many words that goes on and on " * 5_000
DOCS = [(1, "the cat sat on the mat and looked at the dog", "en", "a", 1), (2, None, "en", "b", None),
        (3, "", None, None, 0), (4, " \n\t ", "de", "a", 4), (None, "no identifier here at all", "en", "a", 1),
        (5, LONG, "en", "b", 9), (6, "Der Hund und die Katze sitzen auf der Matte", "de", "c", 1),
        (6, "Der Hund und die Katze sitzen auf der Matte", "de", "c", 1), (7, "…  – ★", None, "c", 1),
        (8, "the cat sat on the mat and looked at the dog", "en", None, 1), (9, "12 345", "de", "a", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def with_clashes(df):
    return df.withColumns({c: F.lit(f"other {c}") for c in CLASHING})


@pytest.fixture(scope="module", params=["plain", "clashing"])
def docs(request, spark):
    df = spark.createDataFrame(DOCS, SCHEMA)
    return with_clashes(df) if request.param == "clashing" else df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, out.values())) == len(DOCS)
    return out


def test_language(docs, empty):
    model = langid.train(docs)
    got = {}
    for r in langid.predict(docs.select("text", F.struct("doc_id").alias("row")), model, keep="row").collect():
        got.setdefault(r.row.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(DOCS)
    for i in (2, 3, 4, 7, 9):  # null, empty, blank, no letter
        assert (got[i][0].lang_pred, got[i][0].score, got[i][0].rejected) == ("und", 0.0, True)
    assert got[1][0].lang_pred == got[8][0].lang_pred == "en" and len(got[6]) == 2
    assert all(0 <= r.score <= 1 for rows in got.values() for r in rows)
    assert langid.train(empty) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_archive(spark):
    rows = [(1, None, "x"), (2, "http://a/\r\nWARC-Type: evil", None), (3, "u", ""), (4, "u", "x"), (4, "u", "x"),
            (None, "u", "x"), (5, "é", LONG), (None, None, "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit(1) for c in ("address", "payload", "header", "first_id", "bytes", "holder", "head")})
    got = warc.read(spark, warc.write(pages)).collect()
    assert len(got) == len(rows)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got)
    assert kinds == [(0, "response", 0), (0, "response", 0), (1, "response", 0), (2, "response", 0),
                     (3, "revisit", 2), (4, "revisit", 1), (4, "revisit", 1), (5, "response", 0)]
    assert all(b"\r\nWARC-Type: evil" not in bytes(r.record) for r in got)
    larger = warc.read(spark, warc.write(pages, least_shared_bytes=2)).collect()
    assert {r.record_type for r in larger} == {"response"}
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


def test_passages(spark, docs, empty):
    bench = spark.createDataFrame(
        [(1, "cat sat on the mat"), (2, None), (3, "!!"), (None, "looked AT the dog"), (1, "cat sat on the mat"),
         (4, "a long text of many words that goes on and on a")], "item_id long, text string").withColumn(
        "window", F.lit(1))
    got = by_id(decontaminate.find(docs, bench))
    assert [got[i][0].n_words for i in (1, 2, 3, 4)] == [11, 0, 0, 0]
    assert (got[1][0].n_hit, got[1][0].items) == (9, ["1"])  # the item without id covers words only
    assert got[8][0].n_hit == 9 and got[None][0].n_hit == 0 and len(got[6]) == 2
    assert got[5][0].n_hit == 55_000 and got[5][0].items == ["4"]
    assert decontaminate.find(empty, bench).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.find(docs, bench.limit(0)).collect())


def test_near_duplicates(docs, empty):
    got = by_id(neardup.classes(docs))
    for i in (2, 3, 4):
        assert (got[i][0].n_shingles, got[i][0].component_id, got[i][0].kept) == (0, i, True)
    assert (got[8][0].component_id, got[8][0].kept) == (1, False)
    assert [r.component_id for r in got[6]] == [6, 6]
    assert got[None][0].component_id is None and got[None][0].kept
    assert neardup.classes(empty).count() == 0


def test_near_duplicates_pick_texts_without_shuffling_all(spark, monkeypatch):
    # Beyond the planner's own broadcast threshold all texts were shuffled to find the few that share a key.
    docs = spark.createDataFrame([(i % 50 if i % 7 else None, f"text {i}") for i in range(200)], "doc_id int, text string")
    nodes = spark.createDataFrame([(3,), (8,), (49,), (77,)], "node long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, join in ((2_500_000, "BroadcastHashJoin"), (3, "SortMergeJoin")):
            monkeypatch.setattr(common, "BROADCAST_IDS", most, raising=False)
            found = neardup._texts(docs, nodes)
            assert join in found._jdf.queryExecution().executedPlan().toString()
            assert sorted((r.node, r.text) for r in found.collect()) == sorted(
                (i % 50, f"text {i}") for i in range(200) if i % 7 and i % 50 in (3, 8, 49))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("most", [2_500_000, 0])
def test_pipeline_drops_near_duplicates_without_shuffling_all(spark, sf_dir, monkeypatch, most):
    # The texts that stay were all shuffled as soon as their ids were beyond the planner's own threshold.
    monkeypatch.setattr(common, "BROADCAST_IDS", most, raising=False)
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(60))
    rows = [(i, text(i), "a") for i in range(20)] + [(20 + i, text(i) + " more", "b") for i in range(5)]
    rows += [(3, text(3), "a"), (7, text(7), "a"), (40, None, "a"), (40, None, "a"), (None, "  ", "a"), (None, text(50), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
        assert ("BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()) == (most > 0)
        assert decided(out) == sorted([*((i, text(i), "a") for i in range(20)), (40, "", "a"), (40, "", "a"), (0, "  ", "a"), (0, text(50), "b")])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_licences(docs, empty, spark):
    assert all(r.matches == [] for rows in by_id(licenses.scan(docs)).values() for r in rows)
    assert licenses.scan(empty).count() == 0
    notice = spark.createDataFrame([(1, "x.\nreleased under the mit license\ny"), (2, None)], "doc_id long, text string")
    assert {m.license for m in licenses.scan(notice).where("doc_id = 1").first().matches} == {"MIT"}


def test_mix(docs, empty):
    got = by_id(mixing.mix(docs))
    assert got[2][0]["size"] == got[3][0]["size"] == 0 and got[5][0]["size"] == 55_000
    assert {len({r.repeats for r in rows}) for rows in got.values()} == {1}
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(empty).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, [0.0, 0.0], 1), (5, None, 1),
            (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1),
            (10, [1.0, -0.0], 1), (10, [1.0, 0.0], 1), (11, [], 1), (12, [0.0, 1.0], 1), (13, [1.0, 0.01], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns(
        {c: F.lit(1) for c in ("node", "vector", "d1", "usable", "copies", "key", "list")})
    got = {}
    for r in embeddings.classes(df).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert sum(map(len, got.values())) == len(rows)
    assert got[1] == [(3, 1, True)] and got[2] == [(3, 1, False)] and got[10] == [(3, 1, False)] * 2
    for i in (3, 4, 5, 6, 7, 8, 9, 11, 12, 13):
        assert got[i] == [(0, i, True)]
    assert got[None] == [(0, None, True)]
    assert embeddings.classes(df.limit(0)).count() == 0


def test_shards(spark, docs, empty):
    rows = sharding.read_shards(spark, sharding.shard(docs, shards=3, bucket_bytes=100_000), docs.schema).collect()
    assert len(rows) == len(DOCS)
    assert sorted(((r.doc_id or 0), r.text or "~") for r in rows) == sorted(((i or 0), t or "~") for i, t, *_ in DOCS)
    for s in range(3):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (3, 4)
    assert sharding.read_shards(spark, sharding.shard(empty), empty.schema).count() == 0
    few = docs.limit(2)
    assert sharding.read_shards(spark, sharding.shard(few), few.schema).count() == 2


def test_token_files(spark, docs, empty):
    folder = tokens.write(docs, vocabulary(), block_tokens=50)
    rows = tokens.read(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([d[0] for d in DOCS], key=lambda i: (i is not None, i))
    at = 0
    for r in rows:
        assert r.start == at and r.ids[-1] == 1
        at += len(r.ids)
    assert [r.ids for r in rows if r.doc_id in (2, 3, 4)] == [[1]] * 3
    crcs = {r.doc_id: r.ids_crc32 for r in tokens.digests(spark, folder).collect()}
    assert crcs[2] == zlib.crc32(b"\x01\0\0\0")
    assert tokens.read(spark, tokens.write(empty, vocabulary())).count() == 0


def test_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain words only"), (4, "u", "<p>open <b>bold"),
            (5, "u", "<article><p>" + LONG + "</p></article>"), (None, "u", "<script>var x='<p>no</p>'</script>"),
            (6, "u", "< not a tag <3 &amp; &#233; &nope; <"), (6, "u", "</p></div></html>"),
            (7, "u", "<div " + "class='a' " * 2000 + ">x</div>"), (8, "u", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("other"))
    got = {}
    for r in extract.extract(pages, extract.train(pages)).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert sum(map(len, got.values())) == len(rows)
    assert got[1] == got[2] == got[None] == [""] and got[3] == ["plain words only"]
    assert got[5] == [LONG.strip()] and "& é &nope;" in got[6][0]
    none = pages.limit(0)
    assert extract.extract(none, extract.train(none)).count() == 0


def test_pipeline_stages(spark, docs, empty, sf_dir):
    for table in (docs, empty):
        rows = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf_dir)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == table.columns
                rows = out
            out.collect()


def decided(df):
    return sorted(((r.doc_id or 0, r.text or "", r.source) for r in df.collect()))


def test_pipeline_decides_rows_not_ids(spark, sf_dir):
    passage = load(spark, sf_dir, "benchmark").where("size(split(text, ' ')) >= 10").first().text
    clean, other = (" ".join(f"{w}{i}" for i in range(60)) for w in ("word", "other"))
    docs = spark.createDataFrame(
        [(None, passage, "a"), (None, clean, "a"), (7, passage, "a"), (7, other, "a"), (None, other, "b"), (8, None, "a"),
         (None, None, "a")], "doc_id long, text string, source string")
    assert decided(corpus_pipeline.decontamination(spark, docs, sf_dir)) == sorted(
        [(0, clean, "a"), (7, other, "a"), (0, other, "b"), (8, "", "a"), (0, "", "a")])
    third = " ".join(f"third{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(5, clean, "a"), (5, other, "a"), (6, clean + " more", "a"), (None, other, "a"), (None, third, "a"),
         (None, third, "a"), (9, "", "a"), (None, None, "a"), (None, None, "a"), (4, other + " more", "a")],
        "doc_id long, text string, source string")
    assert decided(corpus_pipeline.near_duplicates(spark, docs, sf_dir)) == sorted(
        [(5, clean, "a"), (4, other + " more", "a"), (0, third, "a"), (9, "", "a"), (0, "", "a"), (0, "", "a")])
