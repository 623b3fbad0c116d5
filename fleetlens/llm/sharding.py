"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells; a document's cell comes from the hash of its text, so equal texts
stand at one place. Every shard owns the cells before each of its virtual nodes. A shard takes
at most its share of rows (``rows // shards``, one more for the first ``rows % shards`` shards);
rows beyond it continue clockwise to the next virtual node of a shard with room. Since the
shares add up to the number of rows, counts are at most one apart, and only overflowing rows
leave their owner.

Only counts per cell decide: at most ``CELLS`` numbers reach the driver, whatever the input.
Rows are numbered by two levels of counts, (cell, sub-cell) and then the row's rank within its
sub-cell, where the sub-cell comes from the hash of the id: a third of all rows with one text
lie in one cell but in ``SUB`` sub-cells.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.text import text_of
from fleetlens.plans.shared import cut

CELLS = 4096
VIRTUAL_NODES = 64
SUB = 128


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """The virtual nodes as (cell, shard), clockwise. A shard's places depend on its number alone."""
    at = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % cells
    return sorted((at(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def place(counts: dict[int, int], shards: int, cells: int = CELLS) -> list[tuple[int, int, int, int]]:
    """Split every cell's rows over shards: (cell, first row in it, shard, first slot there).

    First each shard admits the rows of its own cells, clockwise, up to its share; then what
    is over continues clockwise from its cell.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slot = [0] * shards
    nodes = ring(shards, cells=cells)
    places = [c for c, _ in nodes]
    first_node = {c: bisect_left(places, c) % len(nodes) for c in counts}
    out, over, taken = [], [], dict.fromkeys(counts, 0)

    def admit(cell: int, shard: int, n: int) -> None:
        out.append((cell, taken[cell], shard, slot[shard]))
        taken[cell] += n
        slot[shard] += n
        room[shard] -= n

    for cell in sorted(counts):
        shard = nodes[first_node[cell]][1]
        if n := min(counts[cell], room[shard]):
            admit(cell, shard, n)
        if counts[cell] > n:
            over.append((cell, counts[cell] - n))
    for cell, left in over:
        at = first_node[cell]
        while left:
            at = (at + 1) % len(nodes)
            if n := min(left, room[nodes[at][1]]):
                admit(cell, nodes[at][1], n)
                left -= n
    return out


def shard_rows(docs: DataFrame, shards: int = 8, text: Column | None = None) -> DataFrame:
    """Give every row a shard and a slot in it; the law is ``rows`` (counts at most one apart).

    Input ``docs(doc_id, text, ...)``; other columns are ignored. Null text has size 1 and the
    crc of nothing. Null ids and repeated rows are rows like any other; ties within a sub-cell
    are broken by id, then crc, then arbitrarily among equal rows. Fewer rows than shards leave
    the last shards empty; an empty table gives an empty result.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` (null: the law ``key``
    isn't the one that holds).
    """
    spark = docs.sparkSession
    t = text_of() if text is None else text
    rows = docs.select(
        "doc_id",
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(F.encode(t, "UTF-8")).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(t), F.lit(CELLS)).cast("int").alias("cell"),
        F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sub-cell")), F.lit(SUB)).cast("int").alias("sub"),
    )
    rows = cut(rows)
    subs = cut(rows.groupBy("cell", "sub").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["cell"]: r["n"] for r in subs.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("pieces", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])))])
    by_cell: dict[int, list[tuple[int, int, int]]] = {}
    for cell, first, shard, slot in place(counts, shards):
        by_cell.setdefault(cell, []).append((first, shard, slot))
    pieces = spark.createDataFrame(list(by_cell.items()), schema)
    # at most CELLS x SUB rows of counts, CELLS rows of pieces: bounded, whatever the input
    before = F.sum("n").over(Window.partitionBy("cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))
    subs = subs.withColumn("before", F.coalesce(before, F.lit(0))).drop("n").join(F.broadcast(pieces), "cell")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("cell", "sub").orderBy("doc_id", "text_crc32")) - 1)
    placed = ranked.join(F.broadcast(subs), ["cell", "sub"]).withColumn("n", F.col("before") + F.col("r"))
    piece = F.element_at(F.filter("pieces", lambda p: p["first"] <= F.col("n")), -1)
    placed = placed.withColumn("p", piece)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("p.shard").alias("shard"),
        (F.col("p.slot") + F.col("n") - F.col("p.first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
