"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

*Voters.* A lexicon voter fires on a whole word, a pattern voter on words that begin with a
stem. Both are mined from a bounded sample of labelled training rows: a word or stem is a
candidate if nearly all its training documents are toxic, and enough of them, counted by
distinct sketch so that copies of one document count once. A greedy cover picks voters until
none explains ``MIN_GAIN`` more toxic documents.

Three more voters look at all of these at once: *silence*, where none fires, and *sparse*, where few words of
the text do, vote for clean; *dense*, where many do, votes for toxic.

*Label model.* A two-class mixture in which each voter fires with a class's own rate; that one doesn't fire is
evidence too, by the same rates. EM estimates the rates from votes alone: the labels give it a start, the share
of toxic rows, and in the end a calibration (a logistic curve from its log odds), but no vote. Voters that fire
together more often within a class than their rates explain are correlated; each voter's evidence is divided by
the number of voters it is correlated with, itself included.

*Classifier.* Logistic regression of the calibrated posteriors on the voters' counts (logarithms),
the number of voters that fire, and the share of words that fire. It scores every whole text in
one pass: an Aho-Corasick automaton finds the voters, so the cost doesn't grow with their number.
The same function counts in the training sample and in scoring, so short and long texts are
scored by inputs of the kind that the weights have seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.text import text_of
from fleetlens.plans.shared import bounded_batches, release_memory, table

#: Labelled training rows that models are fitted on, at most (those of the smallest hashes).
SAMPLE = 20_000
MIN_DOCS = 6
MIN_PRECISION = 0.9
MIN_GAIN = 3
STEMS = (4, 5, 6)
#: Candidates and voters, at most; the model is sent to every task.
MOST_CANDIDATES = 5000
MOST_VOTERS = 400
FOLDS = 5
#: Shares of a text's words that fire: below the first the sparse voter fires, from the second on the dense one.
SPARSE, DENSE = 0.001, 0.004
#: Correlation within a class from which on two voters share their evidence.
CORRELATED = 0.5
SPACES = " \n\t"


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text is 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class Model:
    """Voters with a trailing ``*`` are stems, the others whole words."""

    voters: list[str]
    weights: np.ndarray
    bias: float
    rates: np.ndarray | None = None
    groups: np.ndarray | None = None


def features_of(words: Column) -> Column:
    """The candidate voters of a document: its distinct words, and stems of longer words."""

    def stem(n: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    stems = [stem(n) for n in STEMS]
    return F.array_distinct(F.concat(words, *stems))


def sample_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled training documents, ``SAMPLE`` at most: (y, text, words, cluster).

    Labels that aren't 0 or 1 are left out; of rows with one id the one with the least text counts.
    The cluster is the smallest hash over the document's word triples: copies, and mostly near
    copies, share it.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(few), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = rows.select("y", "text", F.array_remove(F.split(F.lower("text"), r"[^\p{L}]+"), "").alias("words"))
    triples = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    return rows.select("y", "text", F.array_distinct("words").alias("words"), F.array_min(triples).alias("cluster"))


def mine(sample: DataFrame) -> list[str]:
    """The voters that a greedy cover of the sample's toxic documents picks."""
    rows = sample.select("y", "cluster", features_of(F.col("words")).alias("f"))
    seen = rows.select("y", "cluster", F.explode("f").alias("f")).groupBy("f", "cluster").agg(F.max("y").alias("y"), F.min("y").alias("low"))
    stats = seen.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("low") == 1, 1).otherwise(0)).alias("pos"))
    good = stats.where((F.col("n") >= MIN_DOCS) & (F.col("pos") >= F.col("n") * MIN_PRECISION))
    candidates = table(good.orderBy(F.desc("pos"), F.length("f"), "f").limit(MOST_CANDIDATES).select("f"), "candidates")
    # at most SAMPLE rows; of each, the candidates that fire
    hits = rows.where("y = 1").select("cluster", F.explode("f").alias("f")).join(F.broadcast(candidates), "f")
    cover: dict[str, set[int]] = {}
    for d in hits.groupBy("cluster").agg(F.collect_set("f").alias("f")).collect():
        for f in d["f"]:
            cover.setdefault(f, set()).add(d["cluster"])
    voters: list[str] = []
    left = set().union(*cover.values()) if cover else set()
    # longer support first; among equals the shorter, hence more general, form
    order = sorted(cover, key=lambda f: (-len(cover[f]), len(f), f))
    while left and len(voters) < MOST_VOTERS and order:
        gains = [(len(cover[f] & left), -i) for i, f in enumerate(order)]
        gain, at = max(gains)
        if gain < MIN_GAIN:
            break
        voters.append(order[-at])
        left -= cover[order[-at]]
    return voters


def observed(sample: DataFrame, voters: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sample's voter counts, numbers of words and labels, counted just as scoring counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(voters)
        for b in batches:
            found = [count((t.as_py() or "").lower()) for t in b.column("text")]
            fired = [np.flatnonzero(c) for c, _ in found]
            cells = [pa.array(fired, pa.list_(pa.int64())), pa.array([c[f] for (c, _), f in zip(found, fired, strict=True)], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("y").cast(pa.int32()), *cells, pa.array([n for _, n in found], pa.int64())], ["y", "at", "n", "words"])

    rows = sample.select("y", "text").mapInArrow(run, "y int, at array<long>, n array<double>, words long").collect()  # SAMPLE rows at most
    counts = np.zeros((len(rows), len(voters)))
    for i, r in enumerate(rows):
        counts[i, r["at"]] = r["n"]
    return counts, np.array([r["words"] for r in rows], dtype=np.float64), np.array([r["y"] for r in rows], dtype=np.float64)


def votes_of(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The votes of each row: of every word and stem, then of silence, sparse and dense."""
    share = counts.sum(axis=1) / np.maximum(words, 1)
    return np.column_stack([counts > 0, (counts > 0).sum(axis=1) == 0, share < SPARSE, share >= DENSE]).astype(np.float64)


def correlated(votes: np.ndarray, weights: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """With how many voters each fires together within a class beyond what rates explain, itself included."""
    most = np.zeros((votes.shape[1],) * 2)
    for w, r in zip(weights, rates, strict=True):
        centred = (votes - r) * np.sqrt(w)[:, None]
        cov = centred.T @ centred / max(w.sum(), 1)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        most = np.maximum(most, cov / sd[:, None] / sd[None, :])
    np.fill_diagonal(most, 0)
    return 1 + (most > CORRELATED).sum(axis=1)


def label_model(votes: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated posterior of each row, the voters' rates by class (clean, toxic), and their correlations.

    The labels ``y`` aren't votes: they start EM, give the share of toxic rows, and calibrate.
    """
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    post = np.where(y > 0.5, 0.95, 0.05)
    count = odds = rates = None
    for _ in range(rounds):
        w = np.stack([1 - post, post])
        rates = np.clip((w @ votes + 0.05) / (w.sum(axis=1, keepdims=True) + 1), 1e-4, 1 - 1e-4)
        if count is None:
            count = correlated(votes, w, rates)
        fire, still = np.log(rates[1] / rates[0]) / count, np.log((1 - rates[1]) / (1 - rates[0])) / count
        odds = np.clip(np.log(share / (1 - share)) + votes @ fire + (1 - votes) @ still, -30, 30)
        post = 1 / (1 + np.exp(-odds))
    slope, shift = fit_linear(odds[:, None], y)
    return 1 / (1 + np.exp(-np.clip(odds * slope[0] + shift, -30, 30))), rates, count


def inputs_of(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The classifier's inputs: log counts, number of voters that fire, share of words that fire."""
    total = counts.sum(axis=1)
    return np.column_stack([np.log1p(counts), np.minimum((counts > 0).sum(axis=1), 5), np.sqrt(total / np.maximum(words, 1))])


def fit_linear(x: np.ndarray, target: np.ndarray, rounds: int = 60, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - target) + reg * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(reg)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample. Without voters the score is the training rows' share of toxic ones."""
    sample = table(sample_rows(docs, labels), "sample")
    voters = mine(sample)
    counts, words, y = observed(sample, voters)
    if not len(y):
        return Model([], np.zeros(2), 0.0)
    if not voters:
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        return Model([], np.zeros(2), float(np.log(share / (1 - share))))
    post, rates, groups = label_model(votes_of(counts, words), y)
    weights, bias = fit_linear(inputs_of(counts, words), post)
    return Model(voters, weights, bias, rates, groups)


def counter(voters: list[str]):
    """A function from a text to each voter's count and the number of words."""
    import ahocorasick

    trie = ahocorasick.Automaton()
    for i, v in enumerate(voters):
        key = v.rstrip("*")
        trie.add_word(key, [*trie.get(key, []), (i, len(key), v.endswith("*"))])
    if voters:
        trie.make_automaton()

    def count(text: str) -> tuple[np.ndarray, int]:
        counts = np.zeros(len(voters))
        if voters:
            for end, found in trie.iter(text):
                for i, n, stem in found:
                    before, after = text[end - n : end - n + 1] if end >= n else "", text[end + 1 : end + 2]
                    if not before.isalpha() and after.isalpha() == stem:
                        counts[i] += 1
        return counts, sum(map(text.count, SPACES)) + 1

    return count


def probabilities(model: Model, count, texts: pa.Array) -> np.ndarray:
    """How likely each text is toxic."""
    found = [count((t.as_py() or "").lower()) for t in texts]
    counts = np.array([c for c, _ in found]).reshape(len(found), len(model.voters))
    x = inputs_of(counts, np.array([n for _, n in found], dtype=np.float64))
    return 1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -30, 30)))


def scorer(model: Model):
    """Batches of (doc_id, held_out, text) to (doc_id, held_out, score, predicted)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model.voters)
        for b in batches:
            p = probabilities(model, count, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return score


def score_documents(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Score every whole text for toxicity.

    Input ``docs(doc_id, text, ...)`` and ``labels(doc_id, toxic, ...)``; other columns are
    ignored, and neither labels nor ids are inputs of a score. Null text is empty; an empty text
    gets the score of a text in which no voter fires. A null id isn't held out. Repeated rows
    get equal scores. Without labels every score is 0.5; an empty table gives an empty result.

    Returns ``doc_id, held_out, score, predicted``.
    """
    model = model or fit(docs, labels)
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(scorer(model), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with their own columns."""
    model = fit(docs, labels)
    bounded_batches(docs.sparkSession)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model.voters)
        for b in batches:
            yield b.filter(pa.array(probabilities(model, count, b.column("text")) < 0.5)) if model.voters else b
        release_memory()

    return docs.mapInArrow(pick, docs.schema)

