"""Whitening, toxicity and spelling variants: brute force, held-out accuracy and defined edge cases."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from streamlake.llm import spelling, toxicity, whitening
from streamlake.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_whitening(rows):
    """Numpy's dense eigensolver over the same quantised fit list."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    if not kept:
        return {}, 0, np.zeros(0)
    d = Counter(len(v) for _, v in kept).most_common()
    d = max(k for k, c in d if c == d[0][1])
    kept = [(i, np.floor(64 * np.asarray(v, np.float64)).astype(np.int64) + 1_000_000) for i, v in kept if len(v) == d]
    fit = np.unique(np.stack([x for _, x in kept]), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    keep = values > 1e-12 * values.sum()
    values, vectors = values[keep], vectors[:, keep]
    out = {}
    for i, x in kept:
        w = (x - s / n) @ vectors / np.sqrt(values)
        dev = int(((n * x - s) ** 2).sum())
        out.setdefault(i, []).append((dev, w))
    return out, n, values / np.trace(centred.T @ centred / n)


def test_whitening_equals_dense_solver(spark, sf_dir):
    got = QUERIES["op11_whitening"](spark, sf_dir).toPandas()
    table = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pydict()
    expected, n, explained = brute_whitening(list(zip(table["vec_id"], table["embedding"])))
    assert set(got.vec_id) == set(expected) and (got.n == n).all()
    assert len(got) == sum(len(v) for v in expected.values()) * len(explained)
    assert np.allclose(got.groupby("component").explained.first().to_numpy(), explained, rtol=1e-4)
    assert got.identity_error.max() <= 1e-4
    for vec_id, rows in got.groupby("vec_id"):
        dev, w = expected[vec_id][0]
        assert (rows.deviation == dev).all()
        mine = rows.sort_values("component").whitened.to_numpy()
        assert np.allclose(np.abs(mine), np.abs(w), atol=1e-6)


def test_feast_finds_ties_and_counts_by_inertia():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    values = np.array([9.0, 9.0, 9.0, 5.0, 4.0] + [1.0] * 15)
    matrix = q @ np.diag(values) @ q.T
    found, vectors = whitening.feast(matrix, 4)
    assert np.allclose(found, [9, 9, 9, 5])
    assert np.allclose(matrix @ vectors, vectors * found, atol=1e-10)
    assert whitening.count_below(matrix, 4.5) == 16


def test_whitening_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0, 0.5], 0), (2, [0.0, 1.0, 0.25], 0), (2, [0.0, 1.0, 0.25], 0), (3, None, 1),
            (4, [1.0, None, 0.0], 1), (5, [inf, 0.0, 0.0], 1), (6, [nan, 0.0, 0.0], 1), (7, [], 1),
            (8, [1.0, 2.0], 1), (None, [0.5, 0.5, 0.0], 2), (9, [-1.0, 0.0, -0.5], None)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ["x", "n", "at", "d", "whitened"]})
    got = whitening.whiten(df).toPandas()
    assert set(got.vec_id.dropna()) == {1, 2, 9} and got.vec_id.isna().any()
    assert (got.groupby("component").size() == 5).all()  # rows 1, 2, 2, null, 9 on each component
    assert got.identity_error.max() <= 1e-4
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    one = spark.createDataFrame([(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)], VECTORS)
    assert whitening.whiten(one).count() == 0  # one distinct vector: no variance to whiten


def brute_spelling(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall(spelling.RUN, text or ""):
            low = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            word = low
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{low}".encode())
                if h % 97 == 0:
                    word = low[:h % len(low)] + low[h % len(low) + 1:]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = defaultdict(list)
    for a in words:
        for b in words:
            if spelling.one_edit(a, b):
                near[a].append(b)
    out = {}
    for w, n in words.items():
        best = sorted(near[w], key=lambda v: (-words[v], v))
        form = best[0] if best and words[best[0]] >= 2 * n else None
        out[w] = [form, n, len(near[w]), words[form] if form else None]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w].append(root)
    return out


def test_spelling_equals_brute_force(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    expected = brute_spelling(zip(table["doc_id"], table["text"]))
    got = {r.word: [r.form, r.n, r.n_near, r.form_n, r.root] for r in QUERIES["op13_spelling"](spark, sf_dir).collect()}
    assert got == expected


def test_spelling_edges(spark):
    text = "Colour colour colour color color color color color color colr colr colr Zebra"
    docs = [(1, text), (2, None), (None, "colour colour colour"), (3, ""), (4, "ÀÉÎÕÜ àéîõü àéîõü àéîõü"),
            (1, text), (5, "tieaa tieaa tieaa tieab tieab tieab tieac tieac tieac")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ["word", "counts", "key", "block", "n", "role", "root"]})
    got = {r.word: r for r in spelling.variants(df).collect()}
    expected = brute_spelling(docs)
    assert {w: [r.form, r.n, r.n_near, r.form_n, r.root] for w, r in got.items()} == expected
    assert got["tieaa"].form is None and got["tieaa"].n_near == 2  # ties of equal counts never form
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spelling_blocks_split_a_hot_subtree(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 3)
    monkeypatch.setattr(spelling, "QUERY_BLOCK", 4)
    monkeypatch.setattr(spelling, "PAIRS_AT_ONCE", 2)
    docs = [(i, " ".join([w] * 3)) for i, w in enumerate(["abcde", "abcdf", "abcdg", "abcdh", "abcdi", "abcdei", "bbcde"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.word: [r.form, r.n, r.n_near, r.form_n, r.root] for r in spelling.variants(df).collect()}
    assert got == brute_spelling(docs)


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op12_toxicity"](spark, sf).toPandas()
    table = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id"]).to_pydict()
    assert sorted(got.doc_id) == sorted(table["doc_id"])
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas().merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert (held.predicted == held.toxic).mean() >= 0.9


def test_toxicity_locates_the_offending_sentence(spark):
    clean = ["The weather is fine today.", "We walked to the river and back.", "Tea was served at four."]
    insults = ["Idiot!", "Such an idiot.", "What an idiot."]
    texts = [" ".join(clean[:2]) + " " + insults[k % 3] for k in range(30)] + [" ".join(clean)] * 30
    labels = [1] * 30 + [0] * 30
    model = toxicity.fit(texts, labels)
    score, p = model.score("Nice garden. You idiot. Lovely roses.")
    assert score >= 0.5 and list(np.flatnonzero(p >= 0.5)) == [1]
    assert model.score(" ".join(clean))[0] < 0.5
    empty = model.score(None)[0]
    assert empty == model.score("")[0] == model.score("12 345 ...")[0] and 0 <= empty < 0.5
    rows = spark.createDataFrame([(1, "You idiot."), (2, None), (None, ""), (1, "You idiot.")],
                                 "doc_id long, text string").withColumns({c: F.lit(0) for c in ["row", "score", "offending"]})
    out = toxicity.score(rows.select("text", F.struct("doc_id", F.col("score").alias("score")).alias("row")), model)
    got = out.select("row.doc_id", "score", "offending", "predicted").collect()
    assert len(got) == 4 and [r.predicted for r in got if r.doc_id == 1] == [1, 1]
    assert all(r.offending == [] for r in got if r.doc_id != 1)


LONG = "Thecolour of the harbour was grey. " * 20_000


def test_long_and_empty_inputs(spark):
    model = toxicity.fit([], [])
    assert model.score("anything at all")[0] < 0.01 and not model.weights
    trained = toxicity.fit([LONG + " You idiot.", LONG] * 5, [1, 0] * 5)
    score, p = trained.score(LONG + " You idiot.")
    assert len(p) == 20_001 and 0 <= score <= 1
    rows = [(1, LONG), (2, LONG), (3, "harbour harbor harbour")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: [r.form, r.n, r.n_near, r.form_n, r.root] for r in spelling.variants(docs).collect()}
    assert got == brute_spelling(rows) and got["harbour"][1] >= 40_000
    assert spelling.variants(docs.limit(0)).count() == 0
