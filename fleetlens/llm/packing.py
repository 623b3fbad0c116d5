"""Packing token streams into fixed windows by bounded-space online best fit.

Each partition keeps ``OPEN`` windows. A document's ids come in one run; whole windows are cut
off its front, and the rest goes, in one piece, to the open window with the least room that
still takes it. When none does, the fullest window is filled with the front of the piece and
emitted, and the piece's remainder is placed anew: an emitted window is always full. The windows
still open at a partition's end are leftovers; groups of ``GROUP`` partitions merge theirs
(longest first) in the same way, level by level, until one group is left.

Pieces keep the document, the place in it and the crc of their ids, so a piece that is cut
carries its ids along until its window is emitted or merged: a partition holds at most ``OPEN``
windows of ids plus one slice of an Arrow batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import tokens
from fleetlens.llm.text import text_of
from fleetlens.plans.shared import bounded_batches, release_memory, table

WINDOW = 2048
OPEN = 16
GROUP = 16
#: Sequence numbers of one partition and level.
STRIDE = 1 << 36

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
LEFT = PIECE + ", ids binary"

Piece = tuple[int | None, int, int, np.ndarray]  # document, start, tokens of the document, ids


def padded(length: int, window: int = WINDOW) -> int:
    """A sequence's length with padding: up to the window, except at a power of two."""
    return length if length & (length - 1) == 0 else window


class Packer:
    """Bounded-space best fit over pieces; emits rows of full windows."""

    def __init__(self, first_sequence: int, window: int = WINDOW, most_open: int = OPEN, step: int = 1):
        self.window, self.most_open, self.next, self.step = window, most_open, first_sequence, step
        self.open: list[tuple[int, list[Piece]]] = []  # ids held, pieces
        self.rows: list[tuple] = []

    def emit(self, pieces: list[Piece], keep_ids: bool = False) -> None:
        at = 0
        for doc, start, of, ids in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids), of, self.next, at, ids.tobytes() if keep_ids else None))
            at += len(ids)
        self.next += self.step

    def add(self, doc: int | None, start: int, of: int, ids: np.ndarray) -> None:
        while len(ids) >= self.window:
            self.emit([(doc, start, of, ids[: self.window])])
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            fits = [(n, i) for i, (n, _) in enumerate(self.open) if n + len(ids) <= self.window]
            if fits:
                n, i = max(fits)
                self.open[i] = (n + len(ids), [*self.open[i][1], (doc, start, of, ids)])
                if self.open[i][0] == self.window:
                    self.emit(self.open.pop(i)[1])
                return
            if len(self.open) < self.most_open:
                self.open.append((len(ids), [(doc, start, of, ids)]))
                return
            i = max(range(len(self.open)), key=lambda j: self.open[j][0])
            n, pieces = self.open.pop(i)
            cut = self.window - n
            self.emit([*pieces, (doc, start, of, ids[:cut])])
            start, ids = start + cut, ids[cut:]

    def flush(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[]] * 8
        self.rows = []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.int64()) for c in cols[:7]), pa.array(list(cols[7]), pa.binary())], names)


def pack_partition(path: str, end_id: int, window: int, most_open: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Encode and pack a partition's documents; leftovers come last and carry their ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = tokens.Spaced(path)
        packer = Packer((TaskContext.get().partitionId() + 1) * STRIDE, window, most_open)
        end = np.array([end_id], dtype="<u4")
        for b in batches:
            names = b.column("doc_id").to_pylist()
            for row, ids, ends in encoder.rows(b.column("text")):
                ids = ids.astype("<u4")
                for k in range(len(ends) - 1):
                    own = np.concatenate([ids[ends[k] : ends[k + 1]], end])
                    packer.add(names[row + k], 0, len(own), own)
                if len(packer.rows) > 20_000:
                    yield packer.flush()
        for _, pieces in packer.open:
            packer.emit(pieces, keep_ids=True)
        yield packer.flush()
        del encoder
        release_memory()

    return pack


def merge_leftovers(level: int, window: int, most_open: int) -> Callable[[pa.Table], pa.Table]:
    """Pack the leftover windows of one group of partitions: longest first, pieces whole where they fit."""

    def merge(t: pa.Table) -> pa.Table:
        group = t["grp"][0].as_py()
        packer = Packer(-((group + 1) * STRIDE + (level << 32)), window, most_open, step=-1)
        rows = t.drop_columns(["grp"]).to_pylist()
        for r in sorted(rows, key=lambda r: (-r["length"], r["sequence_id"], r["offset"])):
            packer.add(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], dtype="<u4"))
        # the open windows are less than full: pour them into each other until one at most is partial
        still = sorted(packer.open, key=lambda w: -w[0])
        packer.open, packer.most_open = [], 1
        for _, pieces in still:
            for p in pieces:
                packer.add(*p)
        for _, pieces in packer.open:
            packer.emit(pieces, keep_ids=True)
        return pa.Table.from_batches([packer.flush()])

    return merge


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, most_open: int = OPEN) -> DataFrame:
    """Pack every id of every document, each in exactly one piece, into windows of ``window`` ids.

    Input ``docs(doc_id, text, ...)``; other columns are ignored. Null text is empty: its ids are
    the end id alone. Null ids and repeated rows are documents like any other (their pieces
    can be told apart by the sequence). Documents longer than a window are cut. All sequences
    but the last are full. An empty table gives an empty result.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select("doc_id", text_of().alias("text"))
    packed = table(texts.mapInArrow(pack_partition(path, end_id, window, most_open), LEFT), "packed")
    done = packed.where("ids is null")
    left = packed.where("ids is not null")
    part = F.floor(F.abs("sequence_id") / STRIDE) - 1  # the partition, or the group of the level before
    parts = (left.agg(F.max(part)).first()[0] or 0) + 1
    level = 0
    while True:
        left = left.withColumn("grp", F.floor(part / GROUP))
        left = table(left.groupBy("grp").applyInArrow(merge_leftovers(level, window, most_open), LEFT), "leftovers")
        parts = -(-parts // GROUP)
        if parts <= 1:
            break
        done = done.unionByName(left.where("ids is null"))
        left, level = left.where("ids is not null"), level + 1
    return done.unionByName(left).drop("ids")
