r"""Ranked lexical search: MaxScore whose bounds are tightened by what pairs of terms reach together.

*Terms* are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased;
on UTF-8 bytes that is one byte class.

*Index.* One pass over whole texts gives each document's length and its counts of the terms that
the items ask for; statistics (documents, lengths, document frequencies) are aggregates over all
documents. A second pass holds blocks of documents as posting lists and intersects, within each
item, the lists of two terms, the shorter one leading: each pair gets the length of its
intersection and the largest joint impact in it; each term its own largest impact.

*Query.* An item's terms stand in order of their largest impacts. The bound of the first ``j``
terms is the sum of their maxima, less what pairs save: no document scores more on a pair than the
larger of its joint maximum and the two single maxima. Each new term is paired with the free
earlier one that saves most. Terms whose bound stays under the score of the ``k``-th best document
so far are not essential: documents that hold no other term are never looked at. The rest are
scored term by term from the other end and leave once their score and the remaining bound are under
that threshold. Thresholds start from a hash sample of documents (``PRIME``) and rise within a task.
They decide what is skipped, never what is returned: results equal an exhaustive search.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.text import lower_ascii
from fleetlens.plans.shared import Scratch, bounded_batches, release_memory, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Documents whose posting lists a task holds at a time.
BLOCK = 4096
#: Terms and pairs of the items that are searched in one pass over the index; more items, more passes.
ENTRIES = 500_000
#: Of an item, the terms found in the fewest documents form pairs.
WIDTH = 64
#: Pairs of terms that both stand in more than this share of the documents save next to nothing.
COMMON = 0.25
#: Documents that thresholds start from, about.
PRIME = 20_000
FORWARD = "doc_id long, n long, term array<int>, tf array<int>"


@dataclass
class Items:
    """A slice of the items: their ids, and each one's terms (numbers) and how often it holds them."""

    ids: list[int | None] = field(default_factory=list)
    terms: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, c): how often an item holds a term; an item's distinct texts count together."""
    once = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    found = once.select("item_id", F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), 0)).alias("term"))
    return found.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("c"))


def slices_of(entries: DataFrame) -> Iterator[Items]:
    """The items in slices of about ``ENTRIES`` terms and pairs each."""
    few = F.least("n", F.lit(WIDTH))
    size = entries.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") + few * (few - 1) / 2)).first()[0]
    count = math.ceil((size or 0) / ENTRIES)
    for s in range(count):
        own = entries.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == s)
        rows = own.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "c"))).alias("t")).orderBy("item_id").collect()
        if sum(len(r["t"]) for r in rows) > 4 * ENTRIES:
            raise ValueError(f"an item has more than {ENTRIES} terms")
        out = Items()
        for r in rows:
            out.ids.append(r["item_id"])
            out.terms.append(np.array([out.vocabulary.setdefault(t["term"].encode(), len(out.vocabulary)) for t in r["t"]], dtype=np.int64))
            out.times.append(np.array([t["c"] for t in r["t"]], dtype=np.int64))
        yield out


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Each document's number of terms, and its counts of the vocabulary's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, terms, counts = [], [], []
            for t in b.column("text"):
                words = TERM_BYTES.findall((t.as_py() or b"").lower())
                held = Counter(map(vocabulary.get, words))
                held.pop(None, None)
                n.append(len(words))
                terms.append(list(held.keys()))
                counts.append(list(held.values()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "n", "term", "tf"])
        release_memory()

    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, FORWARD)


class Block:
    """Posting lists of some documents: positions in the block and impacts, by term."""

    def __init__(self, doc_id: np.ndarray, n: np.ndarray, lengths: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, total: tuple[int, int]):
        documents, words = total
        self.doc_id = doc_id
        norm = 100 - 25 + 25 * n * documents // words
        at = np.repeat(np.arange(len(n)), lengths)
        order = np.argsort(term, kind="stable")
        self.at, term, tf = at[order], term[order], tf[order]
        self.impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * norm[self.at]))
        self.first = np.searchsorted(term, np.arange(len(weights) + 1))

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        where = slice(self.first[term], self.first[term + 1])
        return self.at[where], self.impact[where]


#: Stands for a null doc_id, which comes last among equal scores.
NULL_ID = np.iinfo(np.int64).max


def blocks(batches: Iterator[pa.RecordBatch], weights: np.ndarray, total: tuple[int, int]) -> Iterator[Block]:
    """The documents of a task as blocks of about ``BLOCK``."""

    def made(rows: list[pa.RecordBatch]) -> Block:
        t = pa.Table.from_batches(rows).combine_chunks()
        flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = pc.list_value_length(t.column("term")).to_numpy().astype(np.int64)
        ids = t.column("doc_id").fill_null(int(NULL_ID)).to_numpy()
        return Block(ids, t.column("n").to_numpy(), lengths, flat("term"), flat("tf"), weights, total)

    held: list[pa.RecordBatch] = []
    for b in batches:
        if len(b):
            held.append(b)
        if sum(map(len, held)) >= BLOCK:
            yield made(held)
            held = []
    if held:
        yield made(held)


def pair_lists(block: Block, terms: np.ndarray, times: np.ndarray, rank: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Joint maximum impacts and lengths of the intersections of an item's terms within a block.

    ``rank`` orders the positions of the terms that form pairs, rarest first, and the first ``lead`` of
    them lead a pair; all others have zeros.
    """
    k = len(terms)
    top, length = np.zeros((k, k), dtype=np.int64), np.zeros((k, k), dtype=np.int64)
    dense = np.zeros((len(block.doc_id), len(rank)), dtype=np.int64)
    for col, i in enumerate(rank):
        at, impact = block.of(terms[i])
        dense[at, col] = times[i] * impact
    for col, i in enumerate(rank[: min(lead, len(rank) - 1)]):
        at, impact = block.of(terms[i])
        if len(at):
            other = dense[at, col + 1 :]
            both = other > 0
            top[i, rank[col + 1 :]] = np.where(both, other + times[i] * impact[:, None], 0).max(axis=0)
            length[i, rank[col + 1 :]] = both.sum(axis=0)
    return np.maximum(top, top.T), length + length.T


@dataclass
class Plan:
    """An item's terms by rising maximum; ``bound[j]`` is the most that the first ``j`` of them add up to."""

    terms: np.ndarray
    times: np.ndarray
    bound: np.ndarray
    threshold: int = 0


def combine(terms: np.ndarray, times: np.ndarray, single: np.ndarray, joint: np.ndarray, paired: np.ndarray) -> Plan:
    """Bounds of an item from its terms' maxima and, where ``paired``, its pairs' joint maxima."""
    order = np.argsort(single, kind="stable")
    single, joint, paired = single[order], joint[np.ix_(order, order)], paired[np.ix_(order, order)]
    pair = np.maximum(joint, np.maximum(single[:, None], single[None, :]))
    saved = np.where(paired, single[:, None] + single[None, :] - pair, 0)
    free = np.ones(len(order), dtype=bool)
    bound = np.zeros(len(order) + 1, dtype=np.int64)
    for j in range(len(order)):
        save = 0
        if j:
            gains = np.where(free[:j], saved[:j, j], 0)
            i = int(np.argmax(gains))
            save = int(gains[i])
            if save > 0:
                free[i] = free[j] = False
        # all earlier pairs still stand, so the bound of a longer prefix adds to that of the shorter
        bound[j + 1] = bound[j] + single[j] - save
    return Plan(terms[order], times[order], np.maximum.accumulate(bound))


class Best:
    """The ``k`` best documents of an item so far: by score, then by smaller id."""

    def __init__(self, k: int, threshold: int):
        self.k, self.threshold = k, threshold
        self.score, self.doc_id = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, score: np.ndarray, doc_id: np.ndarray) -> None:
        score, doc_id = np.concatenate([self.score, score]), np.concatenate([self.doc_id, doc_id])
        order = np.lexsort((doc_id, -score))[: self.k]
        self.score, self.doc_id = score[order], doc_id[order]
        if len(order) == self.k:
            self.threshold = max(self.threshold, int(self.score[-1]))


def search_block(block: Block, plan: Plan, best: Best) -> int:
    """Let the block's documents compete; returns how many were looked at."""
    split = max(0, int(np.searchsorted(plan.bound, best.threshold, "left")) - 1)
    score = np.zeros(len(block.doc_id), dtype=np.int64)
    for i in range(split, len(plan.terms)):
        at, impact = block.of(plan.terms[i])
        score[at] += plan.times[i] * impact
    at_all = np.flatnonzero(score)
    left = at_all
    for i in range(split - 1, -1, -1):
        left = left[score[left] + plan.bound[i + 1] >= best.threshold]
        if not len(left):
            return len(at_all)
        at, impact = block.of(plan.terms[i])
        if len(at):
            where = np.minimum(np.searchsorted(at, left), len(at) - 1)
            score[left] += np.where(at[where] == left, plan.times[i] * impact[where], 0)
    left = left[score[left] >= max(best.threshold, 1)]
    if len(left):
        best.add(score[left], block.doc_id[left])
    return len(at_all)


def run_plans(index: DataFrame, ids: list, plans: list[Plan], weights: np.ndarray, total: tuple[int, int], k: int) -> DataFrame:
    """(item, score, doc_id): the best ``k`` documents of each item, of each task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, p.threshold) for p in plans]
        for block in blocks(batches, weights, total):
            for plan, b in zip(plans, best, strict=True):
                search_block(block, plan, b)
        item = np.repeat(np.arange(len(plans)), [len(b.score) for b in best])
        if len(item):
            doc_id = np.concatenate([b.doc_id for b in best])
            named = pa.array(ids, pa.int64()).take(pa.array(item))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), named, pa.array(np.concatenate([b.score for b in best])), pa.array(doc_id, mask=doc_id == NULL_ID)], ["item", "item_id", "score", "doc_id"])
        release_memory()

    bounded_batches(index.sparkSession)
    return index.mapInArrow(run, "item int, item_id long, score long, doc_id long")


def maxima(index: DataFrame, items: Items, weights: np.ndarray, frequency: np.ndarray, total: tuple[int, int]) -> list[Plan]:
    """The items' plans, from the maxima of terms and pairs over all documents."""
    ranks = []
    for terms in items.terms:
        rank = np.argsort(frequency[terms], kind="stable")[:WIDTH]
        ranks.append(rank[frequency[terms[rank]] > 0])
    leads = [int((frequency[t[r]] <= COMMON * total[0]).sum()) for t, r in zip(items.terms, ranks, strict=True)]
    starts = np.concatenate([[0], np.cumsum([len(t) ** 2 for t in items.terms])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(starts[-1], dtype=np.int64)
        length = np.zeros(starts[-1], dtype=np.int64)
        for block in blocks(batches, weights, total):
            for s, e, terms, times, rank, lead in zip(starts, starts[1:], items.terms, items.times, ranks, leads, strict=False):
                t, n = pair_lists(block, terms, times, rank, lead)
                for i in range(len(terms)):
                    at, impact = block.of(terms[i])
                    t[i, i], n[i, i] = times[i] * impact.max(initial=0), len(at)
                top[s:e] = np.maximum(top[s:e], t.ravel())
                length[s:e] += n.ravel()
        at = np.flatnonzero(length)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(top[at]), pa.array(length[at])], ["at", "top", "n"])
        release_memory()

    bounded_batches(index.sparkSession)
    lists = index.mapInArrow(run, "at long, top long, n long").groupBy("at").agg(F.max("top").alias("top"), F.sum("n").alias("n")).toPandas()
    top = np.zeros(starts[-1], dtype=np.int64)
    top[lists["at"].to_numpy(dtype=np.int64)] = lists["top"].to_numpy(dtype=np.int64)
    plans = []
    for s, e, terms, times, rank, lead in zip(starts, starts[1:], items.terms, items.times, ranks, leads, strict=False):
        joint = top[s:e].reshape(len(terms), -1)
        paired = np.zeros_like(joint, dtype=bool)
        paired[np.ix_(rank[:lead], rank)] = True
        plans.append(combine(terms, times, np.diag(joint).copy(), joint, paired | paired.T))
    return plans


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` documents that score highest for each item: ``docs(doc_id, text, ...)``, ``items(item_id, text, ...)``.

    Other columns are ignored. Null and empty texts, and texts without a term, are no documents and
    score for no item; an item without a term gets no row. Repeated documents compete as rows of
    their own; rows of one item_id are one item with the terms of its distinct texts. Equal scores
    come by rising doc_id, a null doc_id last. An empty table gives an empty result.

    Returns ``item_id, rank, doc_id, score``.
    """
    spark = docs.sparkSession
    entries = table(item_terms(items), "item_terms")
    scratch, out, total = Scratch(spark), None, None
    for part in slices_of(entries):
        index = scratch.table(forward(docs, part.vocabulary), "forward")
        if total is None:
            total = index.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()[:2]
        if not total[0]:
            break
        frequency = np.zeros(len(part.vocabulary), dtype=np.int64)
        for r in index.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect():  # a slice's terms at most
            frequency[r["term"]] = r["n"]
        weights = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * f + 1))) for f in frequency.tolist()], dtype=np.int64)
        held = index.where(F.size("term") > 0)
        plans = maxima(held, part, weights, frequency, total)
        if total[0] > 2 * PRIME:
            some = held.where(F.pmod(F.xxhash64("doc_id"), F.lit(total[0])) < PRIME)
            first = run_plans(some, part.ids, [Plan(p.terms, p.times, p.bound) for p in plans], weights, total, k)
            ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"))))
            for r in ranked.where(F.col("rank") == k).select("item", "score").collect():  # one row an item of the slice
                plans[r["item"]].threshold = r["score"]
        found = run_plans(held, part.ids, plans, weights, total, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        found = table(found, "ranked")
        out = found if out is None else out.unionByName(found)
    scratch.drop("forward")
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
