"""Operators against plain Python on small, awkward inputs."""

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamlake.llm import decontaminate, embeddings, langid, mixing, neardup, rans, tokens
from streamlake.llm.components import components
from streamlake.llm.queries import vocabulary


def least_reached(nodes, links):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


# --- range coder and tokens ----------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=3000), st.integers(1, 40), st.integers(1, 9))
def test_blocks_decode_to_what_was_encoded(symbols, lanes, every):
    symbols = np.array(symbols, np.uint32)
    kinds, counts = np.unique(symbols, return_counts=True)
    table = rans.Table(kinds, rans.scaled(counts))
    block = rans.encode(symbols, table, lanes, every)
    assert (rans.decode(block, table) == symbols).all()
    entries = rans.checkpoints(block)
    parts = [rans.decode(block, table, at, 1) for at in range(entries)]
    assert (np.concatenate([np.zeros(0, np.uint32), *parts]) == symbols).all()


def test_damage_and_foreign_symbols_are_found():
    symbols = np.arange(5000, dtype=np.uint32) % 7
    table = rans.Table(np.arange(7), rans.scaled(np.bincount(symbols)))
    block = bytearray(rans.encode(symbols, table))
    block[-5] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.decode(bytes(block), table)
    with pytest.raises(ValueError, match="not in the table"):
        rans.encode(np.array([9], np.uint32), table)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aBcÉßé'’sTrevlmd019.,!#<|>_ \t\n\x0b\x1c\x85  ́​ΣσжЖ日ﬁª×÷µİ😀"), max_size=40))
def test_pieces_give_the_tokenizers_ids(text):
    coder = tokens.encoder(vocabulary())
    assert coder.encode([text])[0].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_small_caches_give_the_same_ids():
    small, texts = tokens.PieceEncoder(vocabulary(), 5), ["one two three", "two four", "<|endoftext|> five", ""] * 5
    large = tokens.encoder(vocabulary())
    for text in texts:
        assert small.encode([text])[0].tolist() == large.encode([text])[0].tolist()


# --- passages ------------------------------------------------------------------------------

def passages(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


@pytest.mark.parametrize("seed", range(3))
def test_passages_equal_brute_force(spark, seed):
    draw = random.Random(seed)

    def text(low, high):
        return draw.choice(" .-\n").join(draw.choice(["a", "B", "é", "É", "1"]) for _ in range(draw.randint(low, high)))

    docs = [(i, text(0, 60)) for i in range(60)]
    bench = [(i, text(*draw.choice([(0, 3), (4, 9), (10, 14)]))) for i in range(12)]
    for i in range(0, 60, 3):  # planted passages
        docs[i] = (i, f"{docs[i][1]} {draw.choice(bench)[1]} {text(0, 5)}")
    windows = [(item, w[at:at + min(len(w), 10)]) for item, t in bench for w in [passages(t)] if w
               for at in range(len(w) - min(len(w), 10) + 1)]
    got = {r.doc_id: r for r in decontaminate.find(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(bench, "item_id long, text string")).collect()}
    for doc_id, t in docs:
        words, hit, items = passages(t), set(), set()
        for item, window in windows:
            for at in range(len(words) - len(window) + 1):
                if words[at:at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    items.add(str(item))
        r = got[doc_id]
        assert (r.n_words, r.n_hit, r["items"]) == (len(words), len(hit), sorted(items))


# --- near-duplicates -----------------------------------------------------------------------

def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    n = min(5, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


@pytest.mark.parametrize("seed, block", [(0, 2000), (1, 3)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, seed, block):
    """Texts around the bound: families of edited copies, with a passage most of them share."""
    monkeypatch.setattr(neardup, "COMPARED_ROWS", block)
    draw = random.Random(seed)

    def words(n):
        return [f"w{draw.randrange(5000)}" for _ in range(n)]

    common, docs = words(30), []
    for _ in range(12):
        base = words(draw.randint(6, 80)) + (common if draw.random() < 0.7 else [])
        for _ in range(draw.randint(1, 14)):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(copy) // 25))):
                copy[draw.randrange(len(copy))] = words(1)[0]
            docs.append((len(docs), " ".join(copy[draw.randint(0, 3):])))
    sets = {i: shingles(t) for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = least_reached(sets, links)
    assert 10 < len(set(want.values())) < len(docs) - 10
    got = neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def test_signatures_in_the_guaranteed_distance_share_an_entry():
    draw = np.random.default_rng(3)
    a = draw.integers(0, 1 << 16, (200, neardup.SLOTS), dtype=np.uint16)
    b = a.copy()
    for row in range(200):  # 2 * CHUNKS - 1 differing slots, as evenly as can be
        slots = np.concatenate([c * neardup.CHUNK_SLOTS + draw.permutation(neardup.CHUNK_SLOTS)[:2]
                                for c in range(neardup.CHUNKS)])
        b[row, np.delete(slots, draw.integers(len(slots)))] ^= np.uint16(1 + draw.integers(1 << 15))
    assert ((a != b).sum(axis=1) == 2 * neardup.CHUNKS - 1).all()
    assert (neardup.chunk_keys(a) == neardup.chunk_keys(b)).any(axis=1).all()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=30))
def test_components_of_any_graph(spark, edges):
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == least_reached(nodes, [e for e in edges if e[0] != e[1]])


# --- vectors -------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [1000, 4])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "COMPARED_ROWS", block)
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(60, 24))
    rows = [(i, (centres[i % 60] + draw.normal(size=24) * draw.choice([0.0, 0.05, 0.15])).astype(np.float32).tolist(),
             int(draw.integers(3))) for i in range(700)]
    v = np.array([r[1] for r in rows], np.float64)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(rows), dtype=bool)
    want = least_reached(range(len(rows)), np.argwhere(np.triu(linked)).tolist())
    got = {r.vec_id: r for r in embeddings.classes(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    found = sum(r.n_links for r in got.values())
    assert found >= 0.98 * linked.sum() and all(got[i].n_links <= linked[i].sum() for i in got)
    if found == linked.sum():
        assert {i: r.component_id for i, r in got.items()} == want


# --- language models and the mix -----------------------------------------------------------

def test_probabilities_of_every_context_add_up_to_one():
    texts = {"x": "abab abba baab aab", "y": "cd dc ccd abc dd"}
    counts = {}
    for lang, text in texts.items():
        keys, number, _ = langid.numbered([langid.codes(text)])
        counts[lang] = keys, np.bincount(number)
    model = langid.fit(counts)
    letters = [ord(c) for c in " abcd"]
    for context in ("   ", " ab", "bab", "ccc", "zzz", "azb"):
        base = 0
        for c in context:
            base = (base << 16) | ord(c)
        keys = np.array([(base << 16) | c for c in [*letters, ord("q")]], np.uint64)
        total = np.exp(model.log_probabilities(keys)).sum(axis=0)
        assert np.allclose(total, 1, atol=1e-9)


def test_dense_and_sorted_numbering_agree(monkeypatch):
    runs = [langid.codes(t) for t in ("the cat", "Der Ölberg — 12 Äpfel", "日本 x", "a")]
    dense = langid.numbered(runs)
    monkeypatch.setattr(langid, "DENSE", 0)
    by_sorting = langid.numbered(runs)
    assert (dense[0][dense[1]] == by_sorting[0][by_sorting[1]]).all() and (dense[2] == by_sorting[2]).all()


def test_budgets_share_out_everything(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 0), ("d", 400), (None, 30)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weight, left, target = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, 1440.0, {}
    size = dict(sizes)
    while True:  # hand out what is left by weight, cut at three times the size, and go on
        open_ = [s for s in size if s not in target]
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share > 3 * size[s]]
        if not over:
            target |= {s: weight[s] * share for s in open_}
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(3.0 * size[s] for s in over)
    assert got == pytest.approx(target)


def test_language_model_of_several_parts_keeps_every_gram(spark, monkeypatch):
    for name in ("MODEL_GRAMS", "PART_GRAMS"):
        monkeypatch.setattr(langid, name, 10, raising=False)
    many = ["the cat sat on the mat and looked at the dog", "der hund und die katze sitzen auf der matte"]
    rows = [(i, many[i % 2], ("en", "de")[i % 2]) for i in range(60)] + [
        (i, "\u4eca\u5929\u5929\u6c14\u5f88\u597d \U00020000", "zh") for i in range(60, 64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == ["de", "en", "zh"]
    counted = langid.gram_counts(docs.where(~langid.held_out(F.col("doc_id")))).toPandas()
    whole = langid.fit({lang: (part["gram"].to_numpy().view(np.uint64), part["n"].to_numpy())
                        for lang, part in counted.groupby("lang")})
    texts = [*many, rows[-1][1], "xyz \u5929\u6c14 mat \u0436\u0443\u043a", "q", "", None]
    got, length = langid.entropies(texts, model)
    expected, _ = langid.entropies(texts, whole)
    assert np.allclose(got, expected, rtol=0, atol=1e-12) and len(model.parts) > langid.HELD_PARTS
    told = langid.predict(docs.repartition(3), model).collect()
    assert {(r.doc_id, r.lang_pred) for r in told} == {(i, lang) for i, _, lang in rows}
