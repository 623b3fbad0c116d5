"""Line deduplication by a segment-partition edit join.

Lines (trimmed) that are equal, or within ``edits`` edits of each other, are one line; its first
occurrence in (doc_id, position) order stays. For the join (Li, Deng, Wang and Feng, 2011) a line
of length *n* is split into ``edits + 1`` even segments. Two lines within ``edits`` edits share
one of them, at a place that the lengths bound: the shorter line's segments are the index, and
a line probes the indexes of its own length and of up to ``edits`` less, each with the few
substrings that the shift bounds allow. Candidates are verified by a banded bit-parallel
automaton (Wu and Manber, 1992): one bit for each diagonal of the band and one mask for each
number of edits, for all pairs of a batch at once.

1. Signatures are hashes. One aggregate, combined before its shuffle, finds those that different
   lines share, so that no signature gathers its lines in a task. They are few; a second pass
   over the lines keeps their rows only.
2. In a signature of at most ``SMALL`` lines the index lines are paired with the others. In a
   larger one every line is paired with one centre: as many pairs as lines.
3. Large signatures whose lines that leaves in several components are compared block against
   block: letter counts first, then the automaton, and no two lines that links have joined.
   A block pair returns fewer links than it has lines. Nothing is capped and no task holds a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.near_dedup import dealt
from fleetlens.llm.text import text_of
from fleetlens.plans.components import connected_components
from fleetlens.plans.shared import Scratch, bounded_batches, table

EDITS = 2
#: Shorter lines are only compared exactly: in them two edits can change the meaning.
MIN_LENGTH = 24
#: Signatures with more lines are linked by a centre, then in blocks of so many lines or bytes, about.
SMALL = 32
BLOCK, BLOCK_BYTES = 1024, 1 << 20
HEAVY = 1000
#: So many hashes (16 bytes each at most) are broadcast to pick out shared signatures or texts to verify.
BROADCAST_HASHES = 1_000_000
#: So many cells (4 bytes each, twice) of characters are compared at once; a single pair may take more.
CELLS = 1 << 21


def places(edits: int) -> list[tuple[int, int, int]]:
    """The signatures of a line: (characters less, segment, shift). The index is that without less and shift."""
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            lo, hi = max(-i, less - (edits - i)), min(i, less + (edits - i))
            out += [(less, i, shift) for shift in range(lo, hi + 1)]
    return out


def signatures(lines: DataFrame, edits: int) -> DataFrame:
    """``lines(text, n_chars, ...)`` with hash, sig, index, once for each index signature and each probe.

    Segments are even; the last ones take the remainder. In a line of ASCII, characters are
    bytes, which are cut without a walk over the line; the hash of equal bytes is the same.
    """
    parts = edits + 1
    spec = F.explode(F.array(*[F.struct(F.lit(x).alias("less"), F.lit(i).alias("i"), F.lit(at).alias("shift")) for x, i, at in places(edits)]))
    plain = (F.octet_length("text") == F.col("n_chars")).alias("plain")
    rows = lines.select("*", F.xxhash64("text").alias("hash"), plain, spec.alias("s"))
    rows = rows.select("*", (F.col("n_chars") - F.col("s.less")).alias("length"), F.col("s.i").alias("i")).where(F.col("length") >= MIN_LENGTH)
    # so many segments have the base length
    base, short = ((F.col("length") - F.col("length") % parts) / parts).cast("int"), parts - F.col("length") % parts
    at = F.col("i") * base + F.greatest(F.col("i") - short, F.lit(0)) + 1 + F.col("s.shift")
    rows = rows.select("*", at.alias("at"), (base + (F.col("i") >= short).cast("int")).alias("size"))
    in_bytes = F.substring(F.col("text").cast("binary"), F.col("at"), F.col("size"))
    cut = F.when(F.col("plain"), in_bytes).otherwise(F.substring("text", F.col("at"), F.col("size")).cast("binary"))
    fits = (F.col("at") >= 1) & (F.col("at") + F.col("size") - 1 <= F.col("n_chars"))
    index = (F.col("s.less") == 0) & (F.col("s.shift") == 0)
    return rows.where(fits).select(*lines.columns, "hash", F.xxhash64("length", "i", cut).alias("sig"), index.alias("index")).where("sig is not null")


def within(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """For pairs of strings: whether at most ``edits`` edits lead from one to the other."""
    pairs = len(a)
    if not pairs:
        return np.zeros(0, dtype=bool)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows = max(int(lb.max()), 1)
    pad = edits
    ca = np.full((max(rows, int(la.max())) + 2 * pad + 1, pairs), 0xFFFFFFFF, dtype=np.uint32)
    cb = np.full((rows, pairs), 0xFFFFFFFE, dtype=np.uint32)
    for p, (x, y) in enumerate(zip(a, b, strict=True)):
        ca[pad : pad + la[p], p] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        cb[: lb[p], p] = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    width = 2 * edits + 1
    full = np.uint32((1 << width) - 1)
    # bit d: i characters of b and i + d - edits of a are consumed
    masks = [np.full(pairs, ((1 << (edits + e + 1)) - 1) & ~((1 << edits) - 1), dtype=np.uint32) for e in range(edits + 1)]
    done = np.zeros(pairs, dtype=bool)
    goal = la - lb + edits
    for i in range(rows + 1):
        at_end = lb == i
        if at_end.any():
            for m in masks:
                done |= at_end & (goal >= 0) & (goal < width) & ((m >> np.clip(goal, 0, width - 1).astype(np.uint32)) & 1).astype(bool)
        if i == rows or not any(m.any() for m in masks):
            break
        same = np.zeros(pairs, dtype=np.uint32)
        for d in range(width):
            same |= (ca[i + d] == cb[i]).astype(np.uint32) << np.uint32(d)
        new = []
        for e in range(edits + 1):
            m = masks[e] & same
            if e:
                m |= masks[e - 1] | (masks[e - 1] >> np.uint32(1)) | ((new[e - 1] << np.uint32(1)) & full)
            new.append(m)
        masks = new
    return done


def near_pairs(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """``within`` for any number of pairs of any lengths, in batches of like length and at most ``CELLS`` cells."""
    fine = np.zeros(len(a), dtype=bool)
    longest = [max(len(x), len(y)) for x, y in zip(a, b, strict=True)]
    order = sorted(range(len(a)), key=longest.__getitem__)
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * (longest[order[hi]] + 2 * edits + 1) <= CELLS:
            hi += 1
        some = order[lo:hi]
        fine[some] = within([a[i] for i in some], [b[i] for i in some], edits)
        lo = hi
    return fine


def verifier(edits: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = near_pairs(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), edits)
            yield batch.select(["a", "b"]).filter(pa.array(fine))

    return verify


def letter_counts(texts: list[str]) -> np.ndarray:
    """Counts of characters, by their number modulo 64: an edit changes two of them at most, by one each."""
    out = np.zeros((len(texts), 64), dtype=np.int32)
    for i, t in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % 64, minlength=64)
    return out


def block_links(edits: int, rows: int = 16):
    """Links (a, b) of one block pair between lines of different components, each of which joins two."""

    def compare(t: pa.Table) -> pa.Table:
        left, right = t.filter(t["left"]), t.filter(t["right"])
        found: list[tuple[int, int]] = []
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        if left.num_rows and right.num_rows:
            (la, ta, ca), (lb, tb, cb) = ([side[c].to_pylist() for c in ("rep", "text", "comp")] for side in (left, right))
            na, nb = letter_counts(ta), letter_counts(tb)
            for at in range(0, len(la), rows):
                gaps = np.abs(na[at : at + rows, None, :] - nb[None]).sum(axis=2)
                pairs = [(at + int(i), int(j)) for i, j in zip(*np.nonzero(gaps <= 2 * edits), strict=True)]
                pairs = [(i, j) for i, j in pairs if find(ca[i]) != find(cb[j])]
                fine = near_pairs([ta[i] for i, _ in pairs], [tb[j] for _, j in pairs], edits)
                for (i, j), near in zip(pairs, fine.tolist(), strict=True):
                    if near and (x := find(ca[i])) != (y := find(cb[j])):
                        root[x] = y
                        found.append((min(la[i], lb[j]), max(la[i], lb[j])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return compare


def name_of_line() -> Column:
    """128 bits of ``text``."""
    return F.unhex(F.md5("text"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, text, n_chars): trimmed lines that aren't blank."""
    rows = docs.select("doc_id", F.posexplode(F.split(text_of(), "\n")).alias("pos", "raw"))
    rows = rows.select("doc_id", "pos", F.btrim("raw", F.lit(" \t\r\x0b\x0c")).alias("text")).where("text <> ''")
    return rows.select("doc_id", "pos", "text", F.char_length("text").alias("n_chars"))


def candidate_lines(lines: DataFrame, edits: int, scratch: Scratch) -> DataFrame:
    """(no, line, text, sigs): the lines with signatures that different lines share, an index one among them.

    One row a line; ``no`` is a number for it, and ``sigs`` holds the shared signatures (sig, index).
    """
    long_enough = lines.select("text", "n_chars").where(F.col("n_chars") >= MIN_LENGTH)
    each = signatures(long_enough, edits)
    shared = each.groupBy("sig").agg(F.max("index").alias("has"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
    shared = scratch.table(shared.where("has and lo <> hi").select("sig"), "shared")
    sigs = F.collect_set(F.struct("sig", "index")).alias("sigs")
    if shared.count() <= BROADCAST_HASHES:
        hits = each.select("text", "sig", "index").join(F.broadcast(shared), "sig", "left_semi")
        found = hits.groupBy(name_of_line().alias("line")).agg(F.first("text").alias("text"), sigs)
    else:  # names are shuffled to the signatures, and texts once to the names that remain
        named = long_enough.withColumn("line", name_of_line())
        once = signatures(named, edits).groupBy("sig", "line").agg(F.max("index").alias("index"))
        of = scratch.table(once.join(shared.hint("merge"), "sig", "left_semi").groupBy("line").agg(sigs), "of")
        texts = named.select("line", "text").join(of.select("line").hint("merge"), "line", "left_semi").dropDuplicates(["line"])
        found = texts.join(of, "line")
    return scratch.table(found.select(F.monotonically_increasing_id().alias("no"), "line", "text", "sigs"), "found")


def similar_lines(lines: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """Lines (no, line) and links (a, b) of their numbers, between different lines within ``edits`` edits.

    ``lines(text, n_chars, ...)``, repeated rows allowed. Lines without a link may be among those
    returned; the links are enough to connect all such pairs.
    """
    bounded_batches(lines.sparkSession)
    scratch = Scratch(lines.sparkSession)
    found = candidate_lines(lines, edits, scratch)
    texts = found.select("no", "text")
    met = found.select("no", F.explode("sigs").alias("s")).groupBy(F.col("s.sig").alias("sig"), "no").agg(F.max("s.index").alias("index"))
    met = scratch.table(met, "met")
    state = met.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min_by("no", F.xxhash64("no")).alias("centre"))
    met = met.join(scratch.table(state, "state"), "sig")
    few, many = met.where(F.col("n") <= SMALL), scratch.table(met.where(F.col("n") > SMALL).select("sig", "no", "centre"), "many")
    index = few.where("index").select("sig", F.col("no").alias("other"))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    pairs = few.select("sig", "no").join(index, "sig").where("no <> other").select(*pair("no", "other"))
    pairs = pairs.union(many.where("no <> centre").select(*pair("no", "centre"))).distinct()
    named = lambda c: texts.select(F.col("no").alias(c), F.col("text").alias(f"t{c}"))
    both = pairs.join(named("a"), "a").join(named("b"), "b").where(F.abs(F.char_length("ta") - F.char_length("tb")) <= edits)
    links = scratch.table(both.select("a", "b", "ta", "tb").mapInArrow(verifier(edits), "a long, b long"), "links")
    numbers = found.select("no", "line")
    if many.isEmpty():
        return numbers, links
    comps = connected_components(links)
    members = many.select("sig", "no").join(comps, F.col("no") == F.col("node"), "left").select("sig", "no", F.coalesce("component", "no").alias("comp"))
    apart = members.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
    members = members.join(apart, "sig", "left_semi").join(texts.select("no", F.octet_length("text").cast("long").alias("n")), "no")
    members = scratch.table(members.select(F.col("sig").alias("bucket"), F.col("no").alias("rep"), "n", "comp"), "apart")
    blocks = dealt(members, scratch, BLOCK, BLOCK_BYTES).join(texts.withColumnRenamed("no", "rep"), "rep")
    more = blocks.groupBy("bucket", "x", "y").applyInArrow(block_links(edits), "a long, b long")
    return numbers, links.union(scratch.table(more.distinct(), "more"))


def line_verdicts(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """Which lines of each document repeat an earlier one.

    Input ``docs(doc_id, text, ...)``; other columns are ignored. Null and empty texts have no
    lines. Lines are trimmed; blank lines are neither counted nor dropped; lines under
    ``MIN_LENGTH`` characters only repeat equal ones. Similarity is transitive here: a chain of
    similar lines is one group, and its first occurrence (doc_id, then position; null ids
    first) stays. Rows with one id are one document to this operator: their equal lines at
    equal positions share their verdict. An empty table gives an empty result.

    Returns ``doc_id, n_lines, n_dropped, dropped`` (positions from 0, ascending).
    """
    lines = lines_of(docs)
    places = table(lines.select("doc_id", "pos", name_of_line().alias("line")), "places")
    total = places.count()
    firsts = table(places.groupBy("line").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    numbers, links = similar_lines(lines, edits)
    groups = connected_components(links).join(numbers, F.col("node") == F.col("no")).select("line", "component")
    linked = table(groups.join(firsts.select("line", "first"), "line"), "linked")
    best = linked.groupBy("component").agg(F.min("first").alias("keep"))
    moved = linked.join(best, "component").where(~F.col("first").eqNullSafe(F.col("keep"))).select("line", "keep")
    verdict = table(firsts.join(moved, "line", "left").select("line", F.coalesce("keep", "first").alias("keep"), "n"), "verdict")
    heavy = verdict.where(F.col("n") * HEAVY > total).select("line", "keep")  # at most HEAVY rows
    rest = places.join(F.broadcast(heavy.select("line")), "line", "left_anti")
    judged = places.join(F.broadcast(heavy), "line").unionByName(rest.join(verdict.select("line", "keep"), "line"))
    drop = ~(F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("pos") == F.col("keep.pos")))
    per_doc = judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_set(F.when(drop, F.col("pos")))).alias("dropped"))
    all_docs = docs.select("doc_id").distinct()
    out = all_docs.join(per_doc.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"))


def drop_repeated_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """The documents, with their own columns, without the lines that repeat an earlier one.

    A null text stays null. Columns may have any names but ``__line_id`` and ``__line_dropped``.
    """
    verdict = line_verdicts(docs, edits).where("n_dropped > 0").select(F.col("doc_id").alias("__line_id"), F.col("dropped").alias("__line_dropped"))
    joined = docs.join(verdict, F.col("doc_id").eqNullSafe(F.col("__line_id")), "left")
    kept = F.filter(F.split(F.col("text"), "\n"), lambda x, i: ~F.array_contains(F.col("__line_dropped"), i))
    text = F.when(F.col("__line_dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
    return joined.select(*[text if c == "text" else F.col(c) for c in docs.columns])
