"""Toxicity by multiple-instance learning: sentences are the instances, documents the labelled bags.

A sentence's probability of being offending is a logistic function of the words it holds; a document is
toxic when any of its sentences is, combined by noisy-or with a learned leak term ``p0``:
``P(doc) = 1 - (1 - p0) * prod(1 - p_s)``. Only documents carry labels; the weights are fitted by
maximising the likelihood of those labels under the noisy-or (full-batch Adam, L2 penalty); word
weights are kept non-negative, so a word can add evidence of offence but never hide it. The fitted
model then locates the offending sentences of every document: those with ``p_s >= 0.5``.

The fit sees at most ``TRAIN_ROWS`` labelled, not held-out documents, chosen by a hash of id and text
(a documented sample bound); their whole texts are used. Scoring runs in Spark over every document, in
Arrow batches, with the word weights broadcast (their number is bounded by the sample's vocabulary).

Defined cases: a null or empty text, or one without words, has no sentences and scores ``p0``; a very
long text is scored whole. Without labelled texts the model has no word weights; a sentence and the leak count 0.001 each. Labels are joined by ``doc_id``: a null id is never labelled, a label row of a
missing or null ``toxic`` is ignored, several label rows of one id each count. Repeated rows score alike
(the score depends on the text only). Other input columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlake.llm.common import fetched, keep_table, sample_of

HELD_OUT_MODULUS = 5  # fixed value of the contract: crc32 of the id as text, remainder 0 is held out
TRAIN_ROWS = 20_000  # labelled documents the weights are fitted on, at most
ITERATIONS = 300
LEARNING_RATE = 0.1
PENALTY = 0.1  # L2 on the word weights, against the summed log-likelihood
LEAST_DOCUMENTS = 3  # a word is a feature when that many training texts hold it
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MODULUS == 0, F.lit(False))


def sentences(text: str | None) -> list[set[str]]:
    """The distinct lower-case words of each sentence that has any."""
    if not text:
        return []
    out = []
    for part in SENTENCE_END.split(text):
        words = set(WORD.findall(part.lower()))
        if words:
            out.append(words)
    return out


class Model:
    """Word weights, the sentence bias and the leak term of a fitted noisy-or."""

    def __init__(self, weights: dict[str, float], bias: float, leak: float):
        self.weights, self.bias, self.leak = weights, bias, leak

    def sentence_scores(self, text: str | None) -> np.ndarray:
        get = self.weights.get
        z = np.array([self.bias + sum(get(w, 0.0) for w in s) for s in sentences(text)])
        return 1 / (1 + np.exp(-z))

    def score(self, text: str | None) -> tuple[float, np.ndarray]:
        p = self.sentence_scores(text)
        log_clean = -np.logaddexp(0, self.leak) + np.log1p(-np.minimum(p, 1 - 1e-16)).sum()
        return float(-np.expm1(log_clean)), p


def _fit_arrays(words: list[str], features: np.ndarray, owner: np.ndarray, docs: np.ndarray,
                y: np.ndarray) -> Model:
    """Maximum likelihood of the documents' labels under the noisy-or of their sentences: sentence
    ``owner[k]`` holds word ``features[k]``; sentence ``s`` belongs to document ``docs[s]``."""
    count = len(docs)
    if not len(y):  # no labelled text: no word weights, a sentence and the leak at 0.001 each
        return Model({}, float(np.log(1e-3 / (1 - 1e-3))), float(np.log(1e-3 / (1 - 1e-3))))
    rate = float(y.mean())
    w, bias, leak = np.zeros(len(words)), -3.0, float(np.log(max(rate, 1e-3) / max(1 - rate, 1e-3)))
    params = [w, np.array([bias]), np.array([leak])]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for step in range(1, ITERATIONS + 1):
        z = params[1][0] + np.bincount(owner, params[0][features], minlength=count)
        p = 1 / (1 + np.exp(-z))
        log_clean = -np.logaddexp(0, params[2][0]) - np.bincount(docs, np.logaddexp(0, z), minlength=len(y))
        clean = np.exp(log_clean)
        toxic = np.maximum(-np.expm1(log_clean), 1e-300)
        # derivative of the negative log-likelihood by each instance's logit
        pull = np.where(y == 1, -clean / toxic, 1.0)
        p0 = 1 / (1 + np.exp(-params[2][0]))
        g_z = p * pull[docs]
        grads = [np.bincount(features, g_z[owner], minlength=len(words)) + PENALTY * params[0],
                 np.array([g_z.sum()]), np.array([(p0 * pull).sum()])]
        for k, (param, grad) in enumerate(zip(params, grads)):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            param -= LEARNING_RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        np.maximum(params[0], 0, out=params[0])  # a word only ever adds evidence of offence
    kept = np.flatnonzero(np.abs(params[0]) > 1e-6)
    return Model({words[i]: float(params[0][i]) for i in kept}, float(params[1][0]), float(params[2][0]))


def _arrays(sizes: list[list[int]], ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat ``features, owner, docs`` from each document's sentence sizes and word ids (-1: no feature)."""
    per_doc = np.fromiter(map(len, sizes), np.int64, len(sizes))
    docs = np.repeat(np.arange(len(sizes)), per_doc)
    flat_sizes = np.concatenate([np.asarray(s, np.int64) for s in sizes]) if len(docs) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(flat_sizes)), flat_sizes)
    features = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
    known = features >= 0
    return features[known], owner[known], docs


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """The noisy-or fitted on texts in memory (a small sample; ``train`` fits a table's sample)."""
    split = [sentences(text) for text in texts]
    held: dict[str, int] = {}
    for parts in split:
        for w in set().union(*parts):
            held[w] = held.get(w, 0) + 1
    words = sorted(w for w, k in held.items() if k >= LEAST_DOCUMENTS)
    index = {w: i for i, w in enumerate(words)}
    sizes = [[len(s) for s in parts] for parts in split]
    ids = [np.array([index.get(w, -1) for s in parts for w in sorted(s)], np.int64) for parts in split]
    features, owner, docs = _arrays(sizes, ids)
    return _fit_arrays(words, features, owner, docs, np.asarray(labels, np.float64))


def _featurised(batches):
    """Each text as its sentences' sizes and their distinct words, in order."""
    for batch in batches:
        sizes, words = [], []
        for text in batch.column("text").to_pylist():
            parts = sentences(text)
            sizes.append([len(s) for s in parts])
            words.append([w for s in parts for w in sorted(s)])
        yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "sizes": pa.array(sizes, pa.list_(pa.int32())),
                                          "words": pa.array(words, pa.list_(pa.string()))})


def _numbered(batches, index: dict[str, int]):
    for batch in batches:
        ids = [[index.get(w, -1) for w in ws] for ws in batch.column("words").to_pylist()]
        yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "sizes": batch.column("sizes"),
                                          "ids": pa.array(ids, pa.list_(pa.int32()))})


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled documents that are not held out, at most ``TRAIN_ROWS`` of them. Sentences
    and words are taken apart by the executors and the vocabulary is counted by Spark; the driver
    receives word numbers and sentence sizes as arrays."""
    labelled = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                .where(~held_out(F.col("doc_id")))
                .join(labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                                    F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull()),
                      "doc_id"))
    sample = sample_of(labelled, TRAIN_ROWS, F.col("doc_id"), F.col("text")).select("text", "toxic")
    parts = keep_table(sample.mapInArrow(_featurised, "toxic int, sizes array<int>, words array<string>"),
                       "toxicity-sample")
    known = (parts.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count()
             .where(F.col("count") >= LEAST_DOCUMENTS).select("word").orderBy("word"))
    words = list(fetched(known)["word"])
    shared = parts.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    table = parts.mapInArrow(lambda b: _numbered(b, shared.value),
                             "toxic int, sizes array<int>, ids array<int>").toArrow()
    y = table.column("toxic").to_numpy().astype(np.float64)
    size_lists = table.column("sizes").to_pylist()
    ids = [np.asarray(chunk, np.int64) for chunk in table.column("ids").to_numpy(zero_copy_only=False)]
    del table
    features, owner, docs_of = _arrays(size_lists, ids)
    return _fit_arrays(words, features, owner, docs_of, y)


def _scored(batches, model: Model):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        scores, where = [], []
        for text in texts:
            score, p = model.score(text)
            scores.append(score)
            where.append([int(i) for i in np.flatnonzero(p >= 0.5)])
        yield pa.RecordBatch.from_pydict({
            "row": batch.column("row"), "score": pa.array(scores, pa.float64()),
            "offending": pa.array(where, pa.list_(pa.int32()))})


def score(rows: DataFrame, model: Model, keep: str = "row") -> DataFrame:
    """``keep, score, offending, predicted``: the noisy-or probability of each text, the numbers
    (from 0) of its sentences with ``p_s >= 0.5``, and the decision at 0.5."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = f"row {rows.schema[keep].dataType.simpleString()}, score double, offending array<int>"
    prepared = rows.select(F.col("text"), F.col(keep).alias("row"))
    out = prepared.mapInArrow(lambda b: _scored(b, shared.value), schema)
    return out.select(F.col("row").alias(keep), "score", "offending",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
