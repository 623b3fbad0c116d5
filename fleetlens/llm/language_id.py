r"""Language identification by a linear-chain conditional random field over words.

*Features* of a word (letters, lower-cased): affixes and character n-grams of one to four letters,
hashed into ``BUCKETS``; an affix is an n-gram that holds the word's start or end mark. Lexicon
features count how far the word is typical of each language's training windows. A word's features
don't depend on its neighbours, so its emission is computed once for each distinct word of a task.

*Transitions* between labels, and a first label, are learned with the weights. Documents have one
label each, so switches are shown to the model by training sequences that join half windows of two
documents; half of the windows stay whole.

*Fit.* A bounded sample: ``SAMPLE`` distinct texts a language, about, by a hash of the text, and of
each text ``WINDOWS`` windows of ``WINDOW`` words. Maximum likelihood with a ridge, by Adam over all
sequences; the gradient is forward-backward's expectation.

*Inference.* Forward-backward in probabilities, scaled. Long texts aren't cut: words go in chunks
whose transfer matrices are multiplied along the text, so every chunk knows what stands before and
behind it. The marginals of all words of a text add up to its languages' shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.text import text_of
from fleetlens.plans.shared import bounded_batches, release_memory

FOLDS, HELD = 3, 1
#: Distinct texts of a language that the model is fitted on, about.
SAMPLE = 600
WINDOWS, WINDOW = 2, 64
#: Languages; a column with more distinct values raises.
MOST_LANGUAGES = 64
BUCKETS = 1 << 18
LONGEST = 4
#: Words of a text go in chunks of so many.
CHUNK = 32
#: Words that inference holds at a time, and emissions that a task keeps.
WORDS, KEPT = 200_000, 300_000
ROUNDS = 40
NO_LANGUAGE = "und"


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def splitter():
    """A function from a text to its words: runs of letters, lower-cased."""
    import regex

    words = regex.compile(r"\p{L}+")
    return lambda text: words.findall(text.lower())


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram of each word, and where each word's buckets begin."""
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    marked = "".join(f"\x02{w}\x03" for w in words)
    c = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(c))
    word = np.repeat(np.arange(len(words)), sizes)
    found, owner = [], []
    h = np.zeros(len(c), dtype=np.uint64)
    for n in range(1, LONGEST + 2):  # a mark takes one place of an affix
        h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
        whole = at[: len(h)] + n <= ends[: len(h)]
        if n == 1:
            whole &= (c != 2) & (c != 3)
        if n == LONGEST + 1:
            whole &= (c[: len(h)] == 2) | (c[n - 1 :] == 3)
        mixed = (h + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
        found.append(((mixed >> np.uint64(40)) % np.uint64(BUCKETS))[whole].astype(np.int64))
        owner.append(word[: len(h)][whole])
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


@dataclass
class Model:
    """``weights`` by bucket and language; ``lexicon`` maps words to their share by language."""

    languages: list[str]
    weights: np.ndarray
    lexicon: dict[str, np.ndarray]
    of_lexicon: np.ndarray
    bias: np.ndarray
    change: np.ndarray
    start: np.ndarray

    def lexical(self, words: list[str]) -> np.ndarray:
        none = np.zeros(len(self.languages))
        return np.array([self.lexicon.get(w, none) for w in words]).reshape(len(words), -1)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word by language."""
        if not words:
            return np.zeros((0, len(self.languages)))
        at, first = hashed(words)
        sums = np.add.reduceat(self.weights[at], first[:-1], axis=0)
        return sums / np.maximum(np.diff(first), 1)[:, None] ** 0.5 + self.lexical(words) @ self.of_lexicon + self.bias


def marginals(score: np.ndarray, lengths: np.ndarray, change: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over sequences that stand one behind the other in ``score``.

    ``lengths`` are at least 1. Returns the words' marginals, the expected number of each transition,
    and the log of the partition functions' product.
    """
    k = score.shape[1]
    chunks = -(-lengths // CHUNK)
    total, most = int(chunks.sum()), int(chunks.max())
    owner = np.repeat(np.arange(len(lengths)), chunks)
    nth = np.arange(total) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = np.repeat(np.cumsum(lengths) - lengths, chunks) + nth * CHUNK
    size = np.minimum(CHUNK, lengths[owner] - nth * CHUNK)
    place = begin[:, None] + np.minimum(np.arange(CHUNK), size[:, None] - 1)
    used = np.arange(CHUNK) < size[:, None]
    top = score.max(axis=1)
    p = np.exp(score - top[:, None])[place]  # (chunks, CHUNK, k)
    a = np.exp(change)
    # chunk by chunk: a matrix from the label before the chunk to the label of its last word
    first = nth == 0
    through = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    begins = np.exp(start)
    log = np.zeros(total)
    for t in range(CHUNK):
        step = through @ a
        if t == 0:
            step[first] = begins  # nothing stands before: the first label's own weights
        step = step * p[:, t, None, :]
        norm = step.max(axis=(1, 2))
        step /= norm[:, None, None]
        through = np.where(used[:, t, None, None], step, through)
        log += np.where(used[:, t], np.log(norm), 0)
    # along each text: what comes into a chunk from before and from behind
    before, behind = np.zeros((total, k)), np.ones((total, k))
    offset = np.cumsum(chunks) - chunks
    now = np.full((len(lengths), k), 1.0 / k)
    log_z = np.zeros(len(lengths))
    for j in range(most):
        live = chunks > j
        at = offset[live] + j
        before[at] = now[live]
        out = (now[live, None, :] @ through[at])[:, 0]
        norm = out.sum(axis=1)
        now[live] = out / norm[:, None]
        log_z[live] += np.log(norm) + log[at]
    now = np.ones((len(lengths), k))
    for j in range(most - 1, -1, -1):
        live = chunks > j
        at = offset[live] + j
        behind[at] = now[live]
        out = (through[at] @ now[live, :, None])[:, :, 0]
        now[live] = out / out.max(axis=1, keepdims=True)
    # within the chunks
    forward = np.zeros((total, CHUNK, k))
    now = before
    for t in range(CHUNK):
        came = now @ a
        if t == 0:
            came[first] = begins
        came = came * p[:, t]
        came /= came.sum(axis=1, keepdims=True)
        forward[:, t] = came
        now = np.where(used[:, t, None], came, now)
    backward = np.ones((total, CHUNK, k))
    now = behind
    expected = np.zeros((k, k))
    for t in range(CHUNK - 1, -1, -1):
        backward[:, t] = now
        came = now * p[:, t]
        earlier = forward[:, t - 1] if t else before
        pairs = earlier[:, :, None] * a * came[:, None, :]
        pairs /= pairs.sum(axis=(1, 2), keepdims=True)
        counts = used[:, t] & ~(first & (t == 0))
        expected += pairs[counts].sum(axis=0)
        came = came @ a.T
        came /= came.max(axis=1, keepdims=True)
        now = np.where(used[:, t, None], came, now)
    both = forward * backward
    both /= both.sum(axis=2, keepdims=True)
    return both[used], expected, float(log_z.sum() + top.sum())


def train(windows: list[list[str]], label: np.ndarray, languages: list[str]) -> Model:
    """Fit on windows of words, each in one language."""
    k = len(languages)
    rng = np.random.default_rng(5)
    order = rng.permutation(len(windows))
    joined, labels = [], []
    for i, w in enumerate(order):
        if i % 2 and i + 1 < len(order):  # half a window, then half of another
            other = order[i + 1]
            halves = windows[w][: WINDOW // 2], windows[other][WINDOW // 2 :] or windows[other][: WINDOW // 2]
            joined.append(halves[0] + halves[1])
            labels.append([label[w]] * len(halves[0]) + [label[other]] * len(halves[1]))
        else:
            joined.append(windows[w])
            labels.append([label[w]] * len(windows[w]))
    lengths = np.array([len(x) for x in joined])
    flat = [x for s in joined for x in s]
    y = np.concatenate([np.array(x) for x in labels])
    names: dict[str, int] = {}
    ids = np.array([names.setdefault(x, len(names)) for x in flat])
    words = list(names)
    counts = np.zeros((len(words), k))
    np.add.at(counts, (ids, y), 1)
    share = (counts + 0.1) / (counts.sum(axis=0) + 0.1 * len(words))
    often = counts.sum(axis=1) >= 3
    typical = share / share.sum(axis=1, keepdims=True)
    lexicon = {w: typical[i] for i, w in enumerate(words) if often[i]}
    model = Model(languages, np.zeros((BUCKETS, k)), lexicon, np.zeros((k, k)), np.zeros(k), np.zeros((k, k)), np.zeros(k))
    at, first = hashed(words)
    buckets, at = np.unique(at, return_inverse=True)  # only those that occur are fitted
    word_of = np.repeat(np.arange(len(words)), np.diff(first))
    scale = 1 / np.maximum(np.diff(first), 1) ** 0.5
    lexical = model.lexical(words)
    params = {"w": np.zeros((len(buckets), k)), "x": np.eye(k), "b": np.zeros(k), "c": np.zeros((k, k)), "s": np.zeros(k)}
    m = {n: np.zeros_like(p) for n, p in params.items()}
    v = {n: np.zeros_like(p) for n, p in params.items()}
    starts = np.cumsum(lengths) - lengths
    inner = np.ones(len(y), dtype=bool)
    inner[starts] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    truth = np.eye(k)[y]
    for turn in range(1, ROUNDS + 1):
        of_word = np.add.reduceat(params["w"][at], first[:-1], axis=0) * scale[:, None] + lexical @ params["x"] + params["b"]
        post, expected, _ = marginals(of_word[ids], lengths, params["c"], params["s"])
        off = post - truth
        by_word = np.stack([np.bincount(ids, weights=off[:, j], minlength=len(words)) for j in range(k)], axis=1)
        spread = (by_word * scale[:, None])[word_of]
        grad = {
            "w": np.stack([np.bincount(at, weights=spread[:, j], minlength=len(buckets)) for j in range(k)], axis=1),
            "x": lexical.T @ by_word,
            "b": by_word.sum(axis=0),
            "c": expected - seen,
            "s": off[starts].sum(axis=0),
        }
        for n, p in params.items():
            g = grad[n] / len(y) + 1e-6 * p
            m[n] = 0.9 * m[n] + 0.1 * g
            v[n] = 0.99 * v[n] + 0.01 * g * g
            p -= 0.2 * (m[n] / (1 - 0.9**turn)) / (np.sqrt(v[n] / (1 - 0.99**turn)) + 1e-10)
    model.weights[buckets] = params["w"]
    model.of_lexicon, model.bias, model.change, model.start = params["x"], params["b"], params["c"], params["s"]
    return model


def fit(docs: DataFrame) -> Model | None:
    """Fit on the training rows of ``docs(doc_id, text, lang)``; None where there is no labelled word."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return None
    # equal texts count once, and a hash of the text picks them, so copies can't flood the sample
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    most = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, math.ceil(min(1.0, SAMPLE / n) * (1 << 30)))])
    some = known.where(draw < most[F.col("lang")])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = splitter()
        for b in batches:
            lang, out = [], []
            for name, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                words = words_of(text.as_py())
                places = max(1, -(-len(words) // WINDOW))
                for i in sorted({places * j // WINDOWS for j in range(WINDOWS)}):
                    if part := words[i * WINDOW : (i + 1) * WINDOW]:
                        lang.append(name)
                        out.append(" ".join(part))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.string())], ["lang", "words"])
        release_memory()

    bounded_batches(docs.sparkSession)
    # about SAMPLE * WINDOWS rows a language, of WINDOW words each
    rows = some.mapInArrow(windows, "lang string, words string").distinct().orderBy("lang", "words").collect()
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    place = {x: i for i, x in enumerate(languages)}
    return train([r["words"].split(" ") for r in rows], np.array([place[r["lang"]] for r in rows]), languages)


class Tagger:
    """Marginals of the words of texts; emissions are kept by word, ``KEPT`` at most."""

    def __init__(self, model: Model):
        self.model, self.words_of = model, splitter()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages)))

    def emissions(self, words: list[str]) -> np.ndarray:
        if len(self.known) > KEPT:
            self.forget()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            n = len(self.known)
            if n + len(part) > len(self.scores):
                grown = np.zeros((2 * (n + len(part)), self.scores.shape[1]))
                grown[:n] = self.scores[:n]
                self.scores = grown
            self.scores[n : n + len(part)] = self.model.emissions(part)
            for w in part:
                self.known[w] = len(self.known)
        known = self.known
        return self.scores[[known[w] for w in words]]

    def texts(self, texts: Iterator[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Each text's words and their marginals, in order."""
        held: list[list[str]] = []
        n = 0
        for text in texts:
            held.append(self.words_of(text))
            n += len(held[-1])
            if n >= WORDS:
                yield from self._marginals(held)
                held, n = [], 0
        yield from self._marginals(held)

    def _marginals(self, held: list[list[str]]) -> Iterator[tuple[list[str], np.ndarray]]:
        lengths = np.array([len(w) for w in held], dtype=np.int64)
        full = lengths[lengths > 0]
        if len(full):
            score = self.emissions([w for words in held for w in words])
            post, _, _ = marginals(score, full, self.model.change, self.model.start)
        ends = np.cumsum(lengths)
        for words, e in zip(held, ends, strict=True):
            yield words, post[e - len(words) : e] if words else np.zeros((0, len(self.model.languages)))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The language of every whole text of ``docs(doc_id, text, lang, ...)``.

    The language whose marginals, summed over all words, are largest (ties: the first by name), and
    its share of the words as ``score``. A text that is null or has no letter is ``und`` with score
    0, and so is every text where nothing is labelled. Other columns are ignored; ``lang`` serves the
    fit only. Repeated rows get equal results; a null doc_id isn't held out. An empty table gives an
    empty result.

    Returns ``doc_id, held_out, lang_pred, score``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_of().alias("text"))
    model = model or fit(docs)
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(NO_LANGUAGE).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for b in batches:
            lang, score = [], []
            for words, post in tagger.texts(t.as_py() for t in b.column("text")):
                if not words:
                    lang.append(NO_LANGUAGE)
                    score.append(0.0)
                    continue
                share = post.sum(axis=0) / len(words)
                best = int(np.argmax(share))
                lang.append(model.languages[best])
                score.append(float(min(1.0, share[best])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        release_memory()

    bounded_batches(docs.sparkSession)
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def label_runs(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Code-switched text as runs of words in one language: ``doc_id, run, lang, first_word, n_words, score``.

    A word's label is its likeliest one; ``score`` is the mean of the labels' marginals. Texts without a
    letter have no run.
    """
    model = model or fit(docs)
    schema = "doc_id long, run int, lang string, first_word long, n_words long, score double"
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for b in batches:
            out: list[tuple] = []
            for doc_id, (words, post) in zip(b.column("doc_id").to_pylist(), tagger.texts(t.as_py() for t in b.column("text")), strict=True):
                if words:
                    label = post.argmax(axis=1)
                    starts = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
                    ends = np.append(starts[1:], len(label))
                    sure = np.add.reduceat(post[np.arange(len(label)), label], starts) / (ends - starts)
                    out += [(doc_id, i, model.languages[label[s]], int(s), int(e - s), float(p)) for i, (s, e, p) in enumerate(zip(starts, ends, sure, strict=True))]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "run", "lang", "first_word", "n_words", "score"])
        release_memory()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)
