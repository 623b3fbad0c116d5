"""Token ids in bit-plane files: encode, write, read back.

Format. A table of chunks, written and read by Spark's Parquet source, so it lives wherever
Spark can write. A shard is a run of documents in ascending doc_id order; its ids are cut into
chunks of ``CHUNK`` ids (the last is shorter). A chunk's ids, 32 bits each, are shuffled: plane
*p* holds byte *p* of every id (``bits=False``), or bit *p* (``bits=True``), and each plane is
compressed by zstandard on its own; an all-zero plane is stored as empty. A chunk's row is also
its index entry: shard, number in the shard, ids before it in the shard, id count, and the ids
and lengths of the documents that begin in it.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import tokens
from fleetlens.llm.text import text_of
from fleetlens.plans.shared import bounded_batches, release_memory, table

CHUNK = 1 << 16
LEVEL = 3
#: Bytes of text in a shard, about; the number of shards follows the table's size.
SHARD_BYTES = 32 << 20
SCHEMA = "shard int, chunk long, first_id long, n_ids int, bits boolean, planes array<binary>, doc_ids array<long>, doc_tokens array<long>"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Transpose ids into byte or bit planes and compress each."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=LEVEL)
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if bits:
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)
    else:
        planes = raw.T
    return [pack.compress(np.ascontiguousarray(p).tobytes()) if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The ids of a chunk."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    width = -(-n // 8) if bits else n
    rows = np.stack([np.frombuffer(unpack.decompress(p), dtype=np.uint8) if p else np.zeros(width, dtype=np.uint8) for p in planes])
    raw = np.packbits(np.unpackbits(rows, axis=1, count=n).T, axis=1, bitorder="little") if bits else np.ascontiguousarray(rows.T)
    return raw.reshape(-1).view("<u4")


def chunk_writer(path: str, end_id: int, bits: bool, chunk: int = CHUNK) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turn sorted batches of (doc_id, shard, text) into chunk rows; holds one slice and one open chunk."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.ByteLevel(path)
        held: list[np.ndarray] = []
        n_held = number = 0
        docs: list[tuple[int, int | None, int]] = []  # id number where it begins, doc_id, length
        total = 0
        shard = 0

        def rows(n: int) -> pa.RecordBatch:
            nonlocal held, n_held, number, docs
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            first = number * chunk
            here = [d for d in docs if d[0] < first + n]
            docs = docs[len(here) :]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([first], pa.int64()), pa.array([n], pa.int32()), pa.array([bits]),
                    pa.array([to_planes(ids[:n], bits)], pa.list_(pa.binary())), pa.array([[d[1] for d in here]], pa.list_(pa.int64())), pa.array([[d[2] for d in here]], pa.list_(pa.int64())),
                ],
                ["shard", "chunk", "first_id", "n_ids", "bits", "planes", "doc_ids", "doc_tokens"],
            )
            held, n_held, number = [ids[n:]], len(ids) - n, number + 1
            return out

        for b in batches:
            names = b.column("doc_id").to_pylist()
            if b.num_rows:
                shard = b.column("shard")[0].as_py()
            for row, ids, ends in encoder.rows(b.column("text")):
                with_end = np.insert(ids, ends[1:], np.uint32(end_id))  # each document's ids, then the end id
                for k in range(len(ends) - 1):
                    n = int(ends[k + 1] - ends[k]) + 1
                    docs.append((total, names[row + k], n))
                    total += n
                held.append(with_end)
                n_held += len(with_end)
                while n_held >= chunk:
                    yield rows(chunk)
        if n_held:
            yield rows(n_held)
        del encoder
        release_memory()

    return write


def write_tokens(docs: DataFrame, path: str, end_id: int, bits: bool = False) -> DataFrame:
    """Encode whole texts in ascending doc_id order and write the chunk table; returns it as read back."""
    bounded_batches(docs.sparkSession, 8000)
    rows = docs.select("doc_id", text_of().alias("text"), F.xxhash64(text_of()).alias("mix"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # the hash parts rows of one id (or of none) between shards
    sorted_docs = rows.repartitionByRange(int(size // SHARD_BYTES) + 1, "doc_id", "mix").sortWithinPartitions("doc_id", "mix")
    numbered = sorted_docs.select("doc_id", F.spark_partition_id().alias("shard"), "text")
    return table(numbered.mapInArrow(chunk_writer(path, end_id, bits), SCHEMA), "token_chunks")


def read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream a shard's chunks in order into one row per document: place in the shard, length, crc32."""
    shard = None
    waiting: deque[list] = deque()  # [doc_id, start, length, left, crc]
    start = 0
    for b in batches:
        out: list[tuple] = []
        for c in b.to_pylist():
            if c["shard"] != shard:
                shard, start = c["shard"], 0
                waiting.clear()
            for d, n in zip(c["doc_ids"], c["doc_tokens"], strict=True):
                waiting.append([d, start, n, n, 0])
                start += n
            raw = memoryview(from_planes(c["planes"], c["n_ids"], c["bits"]).tobytes())
            at = 0
            while at < len(raw):
                doc = waiting[0]
                take = min(4 * doc[3], len(raw) - at)
                doc[4] = zlib.crc32(raw[at : at + take], doc[4])
                doc[3] -= take // 4
                at += take
                if not doc[3]:
                    waiting.popleft()
                    out.append((doc[0], shard, doc[1], doc[2], doc[4]))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds, strict=True)], ["doc_id", "shard", "at", "n_tokens", "ids_crc32"])


def token_index(chunks: DataFrame) -> DataFrame:
    """Read the files back: one row per document with its place in the whole, length and crc32.

    Shards are read in parallel, each as a stream of chunks: one chunk in memory at a time.
    Returns ``doc_id, start, n_tokens, ids_crc32``.
    """
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("shard", before.alias("before"))  # one row a shard
    streams = chunks.repartition("shard").sortWithinPartitions("shard", "chunk")
    found = streams.mapInArrow(read_documents, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long")
    return found.join(totals, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, path: str, end_id: int = 2, bits: bool = False) -> DataFrame:
    """Write the ids of all documents and index them from the files.

    Input ``docs(doc_id, text, ...)``; other columns are ignored. Null text is empty: its ids are
    the end id alone. Null ids come first; rows with one id (repeated or not) stand together,
    ordered by the text's hash. An empty table writes no chunk and gives an empty result.
    """
    return token_index(write_tokens(docs, path, end_id, bits))
