"""Near-duplicate detection: MinHash bands, odd sketches, and exact confirmation on full sets.

1. One pass over all whole texts turns each into its set of hashed word shingles (JVM), and
   that into ``PERMS`` MinHash samples: ``BANDS`` bucket keys and an odd sketch. The odd sketch
   (Mitzenmacher, Pagh and Pham, 2014) folds the samples into a bitmap by parity: each sample
   (number, value) flips one bit. The population count of two bitmaps' XOR estimates the
   symmetric difference of the samples, hence the similarity, most precisely when it is high.
2. Documents with the same words in the same order are one *class* from here on, so a group of
   copies is one row.
3. Rounds link classes. In a bucket, every member is paired with a centre drawn anew in each
   round (a star: as many pairs as members), or, in buckets of at most ``SMALL`` members, with
   the other members. Only pairs of different components count, so a group of thousands of near
   copies needs about one verified pair a member. Pairs pass the size test, then the odd
   sketches, then the exact test ``100 * |A & B| >= 80 * |A | B|`` on the full sets.
4. Large buckets that still hold several components after the star rounds are compared in
   blocks, sketches against sketches as numpy matrices, and what passes on the full sets:
   nothing is capped, and only links leave a task.

Two sets of similarity 0.8 share no bucket with probability (1 - 0.8^5)^32 = 3e-6; what bands
lose beyond that is what no candidate search by bands can see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.exact_dedup import keep_rows
from fleetlens.llm.text import lower_ascii, text_of, words_of
from fleetlens.plans.components import connected_components
from fleetlens.plans.shared import Scratch, bounded_batches, release_memory, table

BANDS, WIDTH = 32, 5
PERMS = BANDS * WIDTH
SKETCH_BITS = 1024
SMALL = 24
STAR_ROUNDS = 2
#: A block holds so many members, or so many shingles, about.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: So many ids (8 bytes each) are broadcast to pick out the texts to verify.
BROADCAST_IDS = 1_000_000


def shingles_of(words: Column, k: int) -> Column:
    """The set of hashed ``k``-word shingles; fewer words are one shingle, none are none."""
    n = F.size(words)
    grams = F.transform(F.slice(words, 1, n - (k - 1)), lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array_distinct(grams))


def with_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, class key (None without words), shingle set."""
    w = docs.select("doc_id", words_of(lower_ascii(text_of())).alias("words"))
    joined = F.array_join("words", " ")
    return w.select("doc_id", F.when(F.size("words") > 0, F.unhex(F.sha2(joined, 256))).alias("key"), shingles_of(F.col("words"), k).alias("sh"))


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, PERMS, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, key, sh) to (doc_id, key, n, bands, sketch). Empty sets have no bands."""
    a = _multipliers()
    step = 1 << 18  # shingles at a time: bounds memory for any text
    for b in (x.slice(at, 2048) for x in batches for at in range(0, x.num_rows, 2048)):
        sets = b.column("sh")
        lengths = np.asarray(sets.value_lengths().fill_null(0))
        x = _mix(np.asarray(sets.flatten()).view(np.uint64))
        docs = len(lengths)
        mins = np.full((docs, PERMS), np.iinfo(np.uint64).max, dtype=np.uint64)
        owner_start = np.concatenate([[0], np.cumsum(lengths)])
        for lo in range(0, len(x), step):
            hi = min(lo + step, len(x))
            first = int(np.searchsorted(owner_start, lo, side="right")) - 1
            last = int(np.searchsorted(owner_start, hi, side="left"))
            rows = np.arange(first, last)
            rows = rows[lengths[rows] > 0]
            at = np.maximum(owner_start[rows], lo) - lo
            part = x[lo:hi]
            for p in range(PERMS):
                low = np.minimum.reduceat((part * a[p]) >> np.uint64(16), at)
                mins[rows, p] = np.minimum(mins[rows, p], low)
        bands = np.zeros((docs, BANDS), dtype=np.uint64)
        for j in range(WIDTH):
            bands = _mix(bands + mins[:, j::WIDTH] * np.uint64(2 * j + 3))
        bands = bands ^ np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        bit = (_mix(mins + np.arange(PERMS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(SKETCH_BITS)).astype(np.int64)
        flips = np.bincount((np.arange(docs)[:, None] * SKETCH_BITS + bit).ravel(), minlength=docs * SKETCH_BITS)
        sketch = np.packbits((flips & 1).astype(np.uint8).reshape(docs, SKETCH_BITS), axis=1)
        offsets = np.concatenate([[0], np.cumsum(np.where(lengths > 0, BANDS, 0))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"), b.column("key"), pa.array(lengths.astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[lengths > 0].ravel().view(np.int64))),
                pa.array([s.tobytes() for s in sketch], pa.binary()),
            ],
            ["doc_id", "key", "n", "bands", "sketch"],
        )
    release_memory()


@F.pandas_udf(T.DoubleType())
def odd_similarity(a, b):
    """The similarity that two odd sketches of ``PERMS`` samples suggest."""
    import pandas as pd

    if not len(a):
        return pd.Series([], dtype="float64")
    x = np.frombuffer(b"".join(a), dtype=np.uint64).reshape(len(a), -1) ^ np.frombuffer(b"".join(b), dtype=np.uint64).reshape(len(a), -1)
    return pd.Series(_estimate(np.bitwise_count(x).sum(axis=1)))


def _estimate(ones: np.ndarray) -> np.ndarray:
    ratio = np.minimum(2.0 * ones / SKETCH_BITS, 0.999)
    return 1.0 + SKETCH_BITS / 4.0 * np.log1p(-ratio) / PERMS


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _sets_of(ids: DataFrame, docs: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(doc_id, sh) of the documents with the given ids; only their texts are read again."""
    few = ids.count() <= BROADCAST_IDS  # else texts are shuffled to the ids
    sets = with_sets(docs.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left_semi"), k).select("doc_id", "sh")
    return scratch.table(sets.dropDuplicates(["doc_id"]), "sets")


def _verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of representatives whose full sets pass."""
    ids = scratch.table(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    sets = _sets_of(ids, docs, k, scratch)
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("sh").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("sh").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b")


def dealt(members: DataFrame, scratch: Scratch, rows: int = BLOCK, weight: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``members(bucket, rep, n, comp)`` once for each block pair that they take part in.

    A block holds so many ``rows``, or so much of the ``weight`` that ``n`` counts, about.

    In each bucket the members of its largest component are the *home* side. They needn't be
    compared with each other, so a home block meets only the blocks of the others, and these meet
    each other: with few others, a home row stands in one block pair.
    """
    comps = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    whole = comps.groupBy("bucket").agg(F.max(F.struct("m", "w", "comp")).alias("home"), F.sum("m").alias("m"), F.sum("w").alias("w"))
    blocks = lambda m, w: F.greatest(F.ceil(m / rows), F.ceil(w / weight), F.lit(1)).cast("int")
    sizes = whole.select("bucket", F.col("home.comp").alias("home"), blocks(F.col("home.m"), F.col("home.w")).alias("kh"), blocks(F.col("m") - F.col("home.m"), F.col("w") - F.col("home.w")).alias("kr"))
    m = members.join(scratch.table(sizes, "blocks"), "bucket").withColumn("at_home", F.col("comp") == F.col("home"))
    m = m.withColumn("i", F.pmod(F.xxhash64("rep", F.lit("block")), F.when(F.col("at_home"), F.col("kh")).otherwise(F.col("kr"))).cast("int"))
    m = m.withColumn("z", F.explode(F.sequence(F.lit(0), F.when(F.col("at_home"), F.col("kr")).otherwise(F.col("kh") + F.col("kr")) - 1)))
    j, meets_home = F.col("z") - F.col("kh"), F.col("z") < F.col("kh")
    pick = lambda home, rest_home, rest: F.when(F.col("at_home"), home).when(meets_home, rest_home).otherwise(rest)
    return m.select(
        "bucket", pick(F.col("i"), F.col("z"), F.col("kh") + F.least("i", j)).alias("x"), pick(F.col("z"), F.col("i"), F.greatest("i", j)).alias("y"),
        pick(F.lit(False), F.lit(True), F.col("i") <= j).alias("left"), pick(F.lit(True), F.lit(False), F.col("i") >= j).alias("right"), "rep", "n", "comp",
    )


def _blocks(members: DataFrame, full: DataFrame, loosest: float, percent: int, scratch: Scratch) -> DataFrame:
    """Links between components within a bucket, block against block, confirmed on full sets.

    ``members(bucket, rep, n, comp)``, ``full(rep, sketch, bands, sh)``. Within a block pair,
    components that a link has joined aren't compared again, so it returns fewer links than it has
    members.
    """
    m = dealt(members, scratch).join(full, "rep")

    def compare(t: pa.Table) -> pa.Table:
        left, right = t.filter(t["left"]), t.filter(t["right"])
        words = lambda s: np.frombuffer(b"".join(s["sketch"].to_pylist()), dtype=np.uint64).reshape(s.num_rows, -1)
        sets = lambda s: [np.sort(np.asarray(x.values)) for x in s["sh"]]
        col = lambda s, c: s[c].to_numpy()
        bands = lambda s: np.array([np.asarray(x.values) for x in s["bands"]])
        found: list[tuple[int, int]] = []
        here = t["bucket"][0].as_py()
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        if left.num_rows and right.num_rows:
            r, rn, rc, rid, rs, rb = words(right), col(right, "n"), col(right, "comp"), col(right, "rep"), sets(right), bands(right)
            for w, n, c, a, own, wb in zip(words(left), col(left, "n"), col(left, "comp").tolist(), col(left, "rep").tolist(), sets(left), bands(left), strict=True):
                near = (_estimate(np.bitwise_count(r ^ w).sum(axis=1)) >= loosest) & (rc != c) & (np.minimum(rn, n) * 100 >= np.maximum(rn, n) * percent)
                near = np.flatnonzero(near)
                near = near[wb[(rb[near] == wb).argmax(axis=1)] == here]  # a pair belongs to its first common bucket
                for i in near.tolist():
                    if find(c) == find(int(rc[i])):
                        continue
                    common = int((np.searchsorted(rs[i], own, "right") > np.searchsorted(rs[i], own, "left")).sum())
                    if common * 100 >= (len(own) + len(rs[i]) - common) * percent:
                        root[find(c)] = find(int(rc[i]))
                        found.append((a, int(rid[i])))
        return pa.table({"a": pa.array([min(f) for f in found], pa.int64()), "b": pa.array([max(f) for f in found], pa.int64())})

    return m.groupBy("bucket", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def near_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Classes of equal word sequences and their components.

    Returns ``members(doc_id, key, n)``, one row per input row, and ``classes(key, rep, comp)``,
    where ``rep`` is a class's smallest doc_id and ``comp`` the smallest doc_id reachable over
    links. Texts without words and null ids belong to no class.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    signed = table(with_sets(docs, k).mapInArrow(sign, "doc_id long, key binary, n long, bands array<long>, sketch binary"), "signatures")
    members = signed.select("doc_id", "key", "n")
    reps = signed.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = table(reps, "classes")
    sketches = reps.select("rep", "sketch")
    buckets = reps.select(F.explode("bands").alias("bucket"), "rep", "n")
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket")
    buckets = scratch.table(buckets.join(shared, "bucket", "left_semi"), "buckets")
    loosest = percent / 100 - 0.18
    comps = checked = None

    def labelled() -> DataFrame:
        if comps is None:
            return buckets.withColumn("comp", F.col("rep"))
        return buckets.join(comps, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("comp"))

    def grow(found: DataFrame) -> None:
        """Join the components that the found links connect."""
        nonlocal comps
        if not found.isEmpty():
            links = found if comps is None else found.union(comps.select("node", "component"))
            comps = scratch.table(connected_components(links), "components")

    def confirm(pairs: DataFrame) -> None:
        """Verify pairs on full sets, remember them, and add the links they bring."""
        nonlocal checked
        checked = scratch.table(pairs if checked is None else checked.union(pairs), "checked")
        grow(scratch.table(_verify(pairs, docs, k, percent, scratch), "links"))

    def unsettled(pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are still in different components and weren't verified."""
        if comps is not None:
            at = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
            pairs = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").where("ca is null or cb is null or ca <> cb").drop("ca", "cb")
        return pairs.join(checked, ["a", "b"], "left_anti") if checked is not None else pairs

    for turn in range(STAR_ROUNDS + 1):
        m = labelled()
        # one order of the representatives for all buckets: those of one group mostly share their centre
        centre = F.min_by(F.struct("rep", "n", "comp"), F.xxhash64("rep", F.lit(turn)))
        state = m.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"), centre.alias("centre"))
        state = scratch.table(state.where("lo <> hi").select("bucket", "m", "centre"), "state")
        large = F.col("m") > SMALL
        if turn == STAR_ROUNDS:
            m = scratch.table(m.join(state.where(large).select("bucket"), "bucket", "left_semi"), "large")
            ids = scratch.table(m.select(F.col("rep").alias("doc_id")).distinct(), "ids")
            full = reps.select("rep", "sketch", "bands").join(_sets_of(ids, docs, k, scratch).withColumnRenamed("doc_id", "rep"), "rep")
            grow(scratch.table(_blocks(m, full, loosest, percent, scratch), "links"))
            break
        star = m.join(state, "bucket")
        pairs = star.where("comp <> centre.comp").where(_sizes_allow("n", "centre.n", percent)).select(F.least("rep", "centre.rep").alias("a"), F.greatest("rep", "centre.rep").alias("b"))
        if turn:  # small buckets: every pair of members, at most SMALL a row
            few = star.where(~large).select("bucket", "rep", "n", "comp")
            two = few.join(few.toDF("bucket", "rep2", "n2", "comp2"), "bucket").where("rep < rep2 and comp <> comp2").where(_sizes_allow("n", "n2", percent))
            pairs = pairs.union(two.select(F.col("rep").alias("a"), F.col("rep2").alias("b")))
        s = lambda c: sketches.select(F.col("rep").alias(c), F.col("sketch").alias(f"s{c}"))
        pairs = scratch.table(unsettled(pairs.distinct()), "candidates")
        pairs = pairs.join(s("a"), "a").join(s("b"), "b").withColumn("est", odd_similarity("sa", "sb")).where(F.col("est") >= loosest).select("a", "b", "est")
        pairs = scratch.table(pairs, "pairs")
        if not turn and not pairs.isEmpty():  # first the likeliest partner of each, which settles most
            confirm(scratch.table(pairs.groupBy("a").agg(F.max_by("b", F.struct("est", -F.col("b"))).alias("b")), "first"))
            pairs = scratch.table(unsettled(pairs.select("a", "b")), "rest")
        if not pairs.isEmpty():
            confirm(pairs.select("a", "b"))
    scratch.drop("buckets", "checked", "state", "large", "ids", "sets", "blocks", "links", "candidates", "pairs", "first", "rest")
    classes = reps.select("key", "rep")
    if comps is None:
        return members, classes.withColumn("comp", F.col("rep"))
    return members, classes.join(comps, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Group near duplicates: shingle sets of ``k`` words with similarity of ``percent`` or more.

    Input ``docs(doc_id, text, ...)``; other columns are ignored. Null text is empty. Texts
    without words have an empty set and link with nothing, so each keeps itself. Texts with
    fewer than ``k`` words are one shingle. Equal texts are linked. Repeated rows (same id and
    text) come back as often as they came. A null id joins no group: its component is null and
    ``kept`` is true. An empty table gives an empty result.

    Returns ``doc_id, n_shingles, component_id, kept``: the component is the smallest doc_id
    reachable over links, and that document is kept.
    """
    members, classes = near_classes(docs, k, percent)
    # classes of more than one row in a thousand are broadcast (at most 1000); others join by key
    sizes = members.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    total = members.count()
    heavy = classes.join(sizes.where(F.col("size") * 1000 > total).select("key"), "key", "left_semi").select("key", "comp")
    light = members.join(F.broadcast(heavy), "key", "left_anti")
    # a text without words has no key: a key of its own keeps such rows from meeting in one task
    light = light.withColumn("key", F.coalesce("key", F.unhex(F.sha2(F.concat(F.lit("none"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 224))))
    out = members.join(F.broadcast(heavy), "key").select("doc_id", "n", "comp").unionByName(light.join(classes.select("key", "comp"), "key", "left").select("doc_id", "n", "comp"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each group, with their own columns; null ids all stay."""
    verdict = table(near_dedup(docs, k, percent).where("doc_id is not null").select(F.col("doc_id").alias("__near_id"), "kept"), "near_verdict")
    ids = verdict.groupBy("__near_id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    return keep_rows(docs, ids.where("not kept"), ids.where("kept and n > 1"), {"__near_id": F.col("doc_id")}, most=BROADCAST_IDS)
