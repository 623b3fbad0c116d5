"""Ranked search, language identification and whitening against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import language_id, lexical_search, whitening

TERM = re.compile(lexical_search.TERM)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def ranked(docs, items, k):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    held = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs if t is not None]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    frequency = Counter(t for _, c in held for t in c)
    texts = {}
    for i, t in items:
        if t is not None:
            texts.setdefault(i, set()).add(t)
    out = []
    for item, some in texts.items():
        asked = Counter(t for x in some for t in TERM.findall(lower(x)))
        found = []
        for doc_id, c in held:
            m = 100 - 25 + 25 * c.total() * n_docs // n_terms
            score = 0
            for t, times in asked.items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[t] + 1)))
                    score += times * w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        found.sort(key=lambda x: x[:3])
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def random_texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["The", "of", "Straße", "ÉTÉ", "été", "a1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("block", [7, 4096])
def test_search_equals_scoring_every_document(spark, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    texts = random_texts(300, 1)
    docs = [(i, t) for i, t in enumerate(texts)] + [(500, texts[0]), (500, texts[0]), (None, texts[1]), (501, None), (502, ""), (503, "?! \n")]
    items = [(i, t) for i, t in enumerate(random_texts(25, 2))] + [(90, None), (91, ""), (92, "nowhere"), (93, "w1 w1 w2"), (93, "w3"), (93, "w3")]
    got = lexical_search.search(
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("n", F.lit(1)).withColumn("item_id", F.lit(2)).repartition(3),
        spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("x")).withColumn("c", F.lit(1)),
        k=5,
    )
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == ranked(docs, items, 5)


def test_search_in_slices_and_from_thresholds(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ENTRIES", 400)
    monkeypatch.setattr(lexical_search, "PRIME", 60)
    monkeypatch.setattr(lexical_search, "WIDTH", 6)
    docs, items = list(enumerate(random_texts(300, 3))), list(enumerate(random_texts(20, 4)))
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert sorted([tuple(r) for r in got.collect()], key=str) == ranked(docs, items, 5)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(items.withColumnRenamed("item_id", "doc_id"), none.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_pairs_tighten_the_bound_and_skip_documents():
    # two terms that never meet: a document reaches no more than the larger of both
    terms, times = np.arange(3), np.ones(3, dtype=np.int64)
    single = np.array([10, 12, 40])
    joint = np.diag(single)
    every = ~np.eye(3, dtype=bool)
    plan = lexical_search.combine(terms, times, single, joint, every)
    assert plan.bound.tolist() == [0, 10, 12, 52]
    assert lexical_search.combine(terms, times, single, joint, np.zeros((3, 3), dtype=bool)).bound.tolist() == [0, 10, 22, 62]
    # a threshold of 15 lies between: only with pairs is the third term alone essential
    weights = np.ones(3, dtype=np.int64)
    n = 50
    block = lexical_search.Block(np.arange(n), np.full(n, 4), np.ones(n, dtype=np.int64), np.array([0] * 25 + [1] * 24 + [2]), np.ones(n, dtype=np.int64), weights, (n, 4 * n))
    block.impact = single[np.repeat([0, 1, 2], [25, 24, 1])]
    looked = {}
    for name, pairs in (("pairs", every), ("singles", np.zeros((3, 3), dtype=bool))):
        best = lexical_search.Best(1, 15)
        looked[name] = lexical_search.search_block(block, lexical_search.combine(terms, times, single, joint, pairs), best)
        assert best.score.tolist() == [40]
    assert looked == {"pairs": 1, "singles": 25}


def test_forward_backward_equals_all_paths(monkeypatch):
    monkeypatch.setattr(language_id, "CHUNK", 3)
    rng = np.random.default_rng(1)
    k, lengths = 3, np.array([1, 4, 3, 7])
    score, change, start = rng.normal(size=(15, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    post, expected, log_z = language_id.marginals(score, lengths, change, start)
    all_post, all_expected, all_log, at = np.zeros((15, k)), np.zeros((k, k)), 0.0, 0
    for n in lengths:
        z, p, e = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(n)):
            w = np.exp(start[path[0]] + sum(score[at + i, path[i]] for i in range(n)) + sum(change[path[i], path[i + 1]] for i in range(n - 1)))
            z += w
            for i in range(n):
                p[i, path[i]] += w
            for i in range(n - 1):
                e[path[i], path[i + 1]] += w
        all_post[at : at + n], all_expected, all_log, at = p / z, all_expected + e / z, all_log + np.log(z), at + n
    assert np.allclose(post, all_post, atol=1e-12) and np.allclose(expected, all_expected, atol=1e-12) and abs(all_log - log_z) < 1e-9


def speech(rng, lang, n):
    parts = {"xx": ["ka", "ro", "mi", "tu"], "yy": ["sch", "elt", "ung", "ber"], "zz": ["éo", "ñu", "ía", "lló"]}[lang]
    return [("".join(rng.choices(parts, k=rng.randint(1, 4)))) for _ in range(n)]


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(3)
    rows = []
    for i in range(240):
        lang = ("xx", "yy", "zz")[i % 3]
        words = speech(rng, lang, rng.randint(1, 120))
        rows.append((i, " ".join(words).capitalize() + ".", lang if i % 7 else None))
    return rows


def test_language_of_held_out_and_awkward_rows(spark, spoken):
    rng = random.Random(4)
    awkward = [(900, None, "xx"), (901, "", None), (902, "12 + 3 ²!", "yy"), (None, "karo mitu", None), (903, "Karo", None), (903, "Karo", None), (904, " ".join(speech(rng, "yy", 30_000)), None)]
    docs = spark.createDataFrame(spoken + awkward, "doc_id long, text string, lang string").withColumn("held_out", F.lit("x")).withColumn("score", F.lit(1)).withColumn("words", F.lit(1))
    got = language_id.identify(docs.repartition(3)).collect()
    assert len(got) == len(spoken) + len(awkward) and list(got[0].asDict()) == ["doc_id", "held_out", "lang_pred", "score"]
    by_id = {r["doc_id"]: r for r in got}
    truth = {i: ("xx", "yy", "zz")[i % 3] for i in range(240)}
    assert all(by_id[i]["lang_pred"] == t for i, t in truth.items())
    assert {(by_id[i]["lang_pred"], by_id[i]["score"]) for i in (900, 901, 902)} == {("und", 0.0)}
    assert by_id[None]["lang_pred"] == "xx" and not by_id[None]["held_out"] and by_id[904]["lang_pred"] == "yy"
    assert len({tuple(r) for r in got if r["doc_id"] == 903}) == 1
    assert all(0 <= r["score"] <= 1 for r in got)
    from zlib import crc32

    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)


def test_held_out_labels_and_ids_are_no_inputs(spark, spoken):
    from zlib import crc32

    other = [(i, t, "wrong" if crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in spoken]
    a, b = (language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).orderBy("doc_id").collect() for rows in (spoken, other))
    assert a == b


def test_code_switched_text_gets_runs(spark, spoken):
    rng = random.Random(5)
    text = " ".join(speech(rng, "xx", 25) + speech(rng, "zz", 30) + speech(rng, "yy", 20))
    docs = spark.createDataFrame(spoken, "doc_id long, text string, lang string")
    runs = language_id.label_runs(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string"), language_id.fit(docs)).orderBy("run").collect()
    assert [(r["lang"], r["first_word"], r["n_words"]) for r in runs] == [("xx", 0, 25), ("zz", 25, 30), ("yy", 55, 20)]


def test_language_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "karo", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(docs).collect()} == {("und", 0.0)}
    assert language_id.identify(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["spread", "equal", "pairs", "line", "one"])
def test_leading_components(kind):
    rng = np.random.default_rng(2)
    d = {"one": 1, "line": 5}.get(kind, 40)
    x = rng.normal(size=(300, d)) * np.linspace(1, 9, d)
    if kind == "pairs":
        x[:, :20] = x[:, 20:]
    v = np.cov(x.T, bias=True).reshape(d, d)
    if kind == "equal":
        v = np.eye(d) * 3
        v[0, 0] = 5
    if kind == "line":
        v = np.ones((d, d))
    values, vectors = whitening.leading_components(v, 16)
    k = min(16, d)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:k], atol=1e-12 * values[0])
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12) and np.allclose(v @ vectors, vectors * values, atol=1e-12 * values[0])


def test_whitening_against_dense_algebra(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(200, 20)) * np.linspace(0.2, 3, 20)).astype(np.float32)
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)] + [(200, [float(c) for c in x[0]]), (201, None), (202, []), (203, [float("nan")] * 20), (204, [None] * 20), (205, [float("inf")] * 20), (None, [float(c) for c in x[1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit("x")).withColumn("n", F.lit("x")).withColumn("component", F.lit(0))
    got = whitening.whiten(df.repartition(3)).toPandas()
    whole = np.floor(64 * x.astype(np.float64)).astype(np.int64) + 1_000_000
    once = np.unique(whole, axis=0)
    n, sums = len(once), once.sum(axis=0)
    v = np.cov(once.T, bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    assert len(got) == 202 * 16 and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    own = got[got["vec_id"] < 200].sort_values(["vec_id", "component"])
    white = own["whitened"].to_numpy().reshape(200, 16)
    expected = (whole - sums / n) @ vectors / np.sqrt(values)
    sign = np.sign((white * expected).sum(axis=0))
    assert np.allclose(white, expected * sign, atol=1e-7)
    assert np.allclose(own["explained"].to_numpy().reshape(200, 16)[0], values / np.trace(v), rtol=1e-9)
    exact = [int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True))) for r in whole]
    assert [int(t) for t in own["deviation"].to_numpy().reshape(200, 16)[:, 0]] == exact
    assert got["vec_id"].isna().sum() == 16


def test_whitening_of_few_or_huge_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    got = whitening.whiten(make([(1, [1.0, 2.0]), (2, [3.0, 2.0])])).orderBy("vec_id").collect()
    assert [(r["vec_id"], r["component"], abs(round(r["whitened"], 9))) for r in got] == [(1, 1, 1.0), (2, 1, 1.0)]
    huge = whitening.whiten(make([(1, [2e9, 0.0]), (2, [-2e9, 0.0])])).first()
    assert int(huge["deviation"]) == (2 * 64 * 2_000_000_000) ** 2
    with pytest.raises(ValueError):
        whitening.whiten(make([(1, [1.0]), (2, [1.0, 2.0])]))
