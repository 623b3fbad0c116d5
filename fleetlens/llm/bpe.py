"""Byte-level BPE: ranked merges folded by Spark's higher-order functions over distinct words.

Everything but the choice of shared words happens where the texts are read; no text is shuffled.

1. A text is cut into pieces by the public pattern in the JVM. A text with code points that this
   JVM doesn't know (its Unicode is older than the library's) is cut in step 2.
2. A task names its distinct words by numbers. A row for each batch carries the words that the
   task hasn't met, and the documents as lists of numbers.
3. Each new word is encoded once in a task, by a fold of ranked merges over its bytes
   (``encode_word``). The ranks are a literal: a perfect hash of all pairs of tokens whose
   concatenation is a token, so a step looks up two numbers, not strings. Words that are tokens
   are looked up; words of over ``LONGEST_FOLD`` bytes (unspaced blobs) are merged by a heap, in
   time that grows with their length and not its square.
4. The task's documents are put together from their words' ids, and decoded by concatenating the
   ids' byte pieces.

Before that, the words that occur at least twice in a hash sample of ``SAMPLE`` distinct texts, ``MOST_SHARED``
of them at most, are folded once for the whole job and sent to every task, so a task folds only what they
leave, where it occurs. The sample decides what is folded where, never a result.

A task remembers ``MOST_WORDS`` words and then starts anew, so memory doesn't follow the corpus.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.text import text_of
from fleetlens.llm.tokens import PIECES, byte_level_pieces, gather, row_slices
from fleetlens.plans.shared import bounded_batches, release_memory, table

#: Distinct words that a task remembers, beside the shared ones.
MOST_WORDS = 300_000
#: Texts that shared words are looked for in, about; shared words at most, and the longest (bytes), which bounds what is sent.
SAMPLE, MOST_SHARED, LONGEST_SHARED = 40_000, 400_000, 48
#: The fold's work grows with the square of a word's length; longer words (bytes) take ``merge_long``.
LONGEST_FOLD = 512
#: Sizes of the perfect hash: displacements and slots.
DISPLACED, SLOTS = 1 << 15, 1 << 18
#: No token: stands at both ends of a word, so that every pair has neighbours.
EDGE = (1 << 16) - 1
#: The rank of a pair that isn't a token.
NONE = 1 << 16
NEW = pa.struct([("word", pa.string()), ("ids", pa.list_(pa.int32()))])


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def token_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """(left, right, rank) of every two tokens whose concatenation is a token."""
    assert max(ranks.values()) < EDGE
    out = [(left, right, rank) for token, rank in ranks.items() for at in range(1, len(token)) if (left := ranks.get(token[:at])) is not None and (right := ranks.get(token[at:])) is not None]
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def _places(left, right):
    """The displacement's number and the slot before displacement, not yet reduced."""
    return left * 40503 + right * 30011, left * 10007 + right * 48271


@lru_cache(maxsize=2)
def perfect_hash(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Displacements, and slots that hold ``pair << 16 | rank`` (0: none), without collisions."""
    pairs = token_pairs(load_ranks(path))
    group, base = _places(pairs[:, 0], pairs[:, 1])
    group = group % DISPLACED
    entry = ((pairs[:, 0] << 16 | pairs[:, 1]) << 16) | pairs[:, 2]
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(DISPLACED + 1))
    shift, slots = np.zeros(DISPLACED, np.int64), np.zeros(SLOTS, np.int64)
    rng = np.random.default_rng(3)
    for g in np.argsort(-np.diff(bounds), kind="stable"):  # the fullest groups first
        mine = order[bounds[g] : bounds[g + 1]]
        while len(mine):
            at = (base[mine] + shift[g]) % SLOTS
            if not slots[at].any() and len(np.unique(at)) == len(at):
                slots[at] = entry[mine]
                break
            shift[g] = rng.integers(SLOTS)
    return shift, slots


def rank_literal(path: str) -> tuple[Column, ...]:
    """The rank map as literals: displacements, slots, the ranks of all pairs of bytes, the ids of the bytes."""
    shift, slots = perfect_hash(path)
    ranks = load_ranks(path)
    first = [ranks.get(bytes([i, j]), NONE) for i in range(256) for j in range(256)]
    whole = lambda x: F.from_json(F.lit("[" + ",".join(map(str, x)) + "]"), "array<bigint>")
    return whole(shift.tolist()), whole(slots.tolist()), whole(first), whole([ranks[bytes([b])] for b in range(256)])


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode_word(word: Column, literal: tuple[Column, ...]) -> Column:
    """The ids of one non-empty word, as a fold of ranked merges over its bytes.

    The state is one array with a number for each token: the rank of its pair with the next token
    (``NONE``: no token), where it begins, and its id, in this order of bits. So the least number is
    the first pair of the lowest rank. A step merges it and looks up the two ranks beside it;
    steps after the last merge do nothing.
    """
    shift, slots, first, of_byte = literal
    low16, low28 = F.lit(0xFFFF).cast("bigint"), F.lit((1 << 28) - 1).cast("bigint")
    begins = F.lit(0xFFF0000).cast("bigint")
    none = F.lit(NONE).cast("bigint")

    def rank(left: Column, right: Column) -> Column:
        group, base = _places(left, right)
        at = (base + F.get(shift, group.bitwiseAND(F.lit(DISPLACED - 1).cast("bigint")).cast("int"))).bitwiseAND(F.lit(SLOTS - 1).cast("bigint"))
        # a slot is pair << 16 | rank: what is left of it without the pair is small only if the pair is the same
        return F.least(F.get(slots, at.cast("int")).bitwiseXOR(F.shiftleft(F.shiftleft(left, 16) + right, 16)), none)

    def step(e: Column) -> Column:
        def merge(low: Column) -> Column:
            new = F.shiftright(low, 28)

            def at(p: Column) -> Column:  # tokens p and p + 1, counted from 1, become one
                left, right = F.get(e, p - 2), F.get(e, p + 1)
                beside = F.array(
                    F.shiftleft(rank(left.bitwiseAND(low16), new), 28) + left.bitwiseAND(low28),
                    F.shiftleft(rank(new, right.bitwiseAND(low16)), 28) + low.bitwiseAND(begins) + new,
                )
                return F.concat(F.slice(e, F.lit(1), p - 2), beside, F.slice(e, p + 2, F.size(e)))

            return F.when(low >= (NONE << 28), e).otherwise(_bind(F.array_position(e, low).cast("int"), at))

        return _bind(F.array_min(e), merge)

    def fold(v: Column) -> Column:
        pair = lambda x, i: F.coalesce(F.get(first, (x * 256 + F.get(v, i + 1))), none)
        tokens = F.transform(v, lambda x, i: F.shiftleft(pair(x, i), 28) + F.shiftleft((i + 1).cast("bigint"), 16) + F.get(of_byte, x))
        edge = F.array(F.lit((NONE << 28) + EDGE).cast("bigint"))
        folded = F.aggregate(F.sequence(F.lit(1), F.size(v)), F.concat(edge, tokens, edge), lambda e, _: step(e))
        return _bind(folded, lambda e: F.transform(F.slice(e, 2, F.size(e) - 2), lambda x: x.bitwiseAND(low16).cast("int")))

    return _bind(F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.ascii(c)), fold)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long word: the same merges in the same order, by a heap over a linked list."""
    n = len(word)
    start, end = list(range(n)), list(range(1, n + 1))  # token that begins at i: its end; token before
    before = [i - 1 for i in range(n)]
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def push(i: int, to: int) -> None:
        if (r := ranks.get(word[i:to])) is not None:
            heapq.heappush(heap, (r, i, to))

    while heap:
        _, i, to = heapq.heappop(heap)
        middle = end[i]
        if not alive[i] or middle >= n or end[middle] != to:  # one of the two has merged since
            continue
        end[i], alive[middle] = to, False
        if to < n:
            before[to] = i
            push(i, end[to])
        if before[i] >= 0:
            push(before[i], to)
    return [ranks[word[i : end[i]]] for i in start if alive[i]]


def shared_words(text: DataFrame, literal: tuple[Column, ...]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Frequent words of ``text(t)``, their flat ids, and how many ids each has."""
    n = text.count()
    draw = F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
    words = text.where(draw).select("t").distinct().select(F.explode(byte_level_pieces(F.col("t"), PIECES)).alias("word"))
    words = words.where((F.octet_length("word") > 1) & (F.octet_length("word") <= LONGEST_SHARED))
    counts = table(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "word_counts")
    # the least count that at most MOST_SHARED words reach; a row for each count that occurs
    least, held = 1, 0
    for r in sorted(counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["n"]):
        held += r["words"]
        if held > MOST_SHARED:
            break
        least = r["n"]
    rows = counts.where(F.col("n") >= (least if least > 1 else 1 << 62)).select("word", encode_word(F.col("word"), literal).alias("ids"))
    got = table(rows, "shared_words").toArrow().combine_chunks()  # MOST_SHARED rows at most
    ids = got.column("ids").combine_chunks()
    return got.column("word").to_pylist(), np.asarray(ids.flatten()).astype(np.int32), np.asarray(ids.value_lengths()).astype(np.int64)


def namer(path: str, shared):
    """Batches of (doc_id, pieces, text) to a row each: words new to the task, and documents as numbers.

    ``shared`` is a broadcast of the shared words; their numbers come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import regex

        ranks = load_ranks(path)
        pattern = regex.compile(public_tokenizers.PATTERN)
        common = {w: i for i, w in enumerate(shared.value)}
        known: dict[str, int] = {}

        def row(ids: pa.Array, counts: np.ndarray, words: pa.Array) -> pa.RecordBatch:
            anew = len(known) > MOST_WORDS
            if anew:
                known.clear()
            coded = words.dictionary_encode()
            words_here, at_first = coded.dictionary.to_pylist(), len(common)
            first = at_first + len(known)
            names = [k if (k := common.get(w)) is not None else known.setdefault(w, at_first + len(known)) for w in words_here]
            new = []
            for w, k in zip(words_here, names, strict=True):
                if k >= first:
                    raw = w.encode()
                    rank = ranks.get(raw)
                    done = [rank] if rank is not None else merge_long(raw, ranks) if len(raw) > LONGEST_FOLD else None
                    new.append({"word": w if done is None else None, "ids": done})
            codes = np.array(names, dtype=np.int32)[np.asarray(coded.indices)] if len(names) else np.zeros(0, np.int32)
            cell = lambda x, kind: pa.array([x], pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [pa.array([anew]), cell(new, NEW), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), cell(counts.astype(np.int32), pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), pa.array(codes))],
                ["anew", "new", "doc_ids", "counts", "codes"],
            )

        for b in batches:
            here, late = b.filter(b.column("text").is_null()), b.filter(b.column("text").is_valid())
            pieces = here.column("pieces")
            offsets = np.concatenate([[0], np.cumsum(np.asarray(pieces.value_lengths().fill_null(0)).astype(np.int64))])
            flat = pieces.flatten()
            for at, to in row_slices(offsets) if here.num_rows else ():
                yield row(here.column("doc_id").slice(at, to - at), np.diff(offsets[at : to + 1]), flat.slice(offsets[at], offsets[to] - offsets[at]))
            for i in range(late.num_rows):
                words = pattern.findall(late.column("text")[i].as_py())
                yield row(late.column("doc_id").slice(i, 1), np.array([len(words)]), pa.array(words, pa.string()))
        release_memory()

    return run


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[pa.Array, pa.Array]:
    """Of each id: its bytes, and its decimal digits with a comma."""
    ranks = load_ranks(path)
    pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return pa.array(pieces, pa.binary()), pa.array([f"{i},".encode() for i in range(len(pieces))], pa.binary())


def _joined(values: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The concatenation of the ids' values, and where each begins."""
    taken = values.take(pa.array(ids))
    offsets = np.frombuffer(taken.buffers()[1], dtype=np.int32)[taken.offset : taken.offset + len(taken) + 1]
    return memoryview(taken.buffers()[2]) if taken.buffers()[2] else memoryview(b""), offsets


def digests(path: str, shared):
    """Rows of ``namer`` with their words' ids to a row for each document; ``shared`` is a broadcast of the shared words' ids and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, digits = _pieces(path)
        common, common_lengths = shared.value
        flat, lengths = [common], common_lengths

        for b in batches:
            for k in range(b.num_rows):
                if b.column("anew")[k].as_py():
                    flat, lengths = [common], common_lengths
                new = b.column("ids")[k].values
                flat = [np.concatenate([*flat, np.asarray(new.flatten())])]
                lengths = np.concatenate([lengths, np.asarray(new.value_lengths()).astype(np.int64)])
                starts = np.cumsum(lengths) - lengths
                codes = np.asarray(b.column("codes")[k].values)
                offsets = np.concatenate([[0], np.cumsum(np.asarray(b.column("counts")[k].values).astype(np.int64))])
                names = b.column("doc_ids")[k].values
                n_ids, ids_sha, text_sha = [], [], []
                for row, to in row_slices(offsets):
                    at = codes[offsets[row] : offsets[to]]
                    n = lengths[at]
                    ids = gather(flat[0], starts[at], n)
                    ends = np.concatenate([[0], np.cumsum(n)])[offsets[row : to + 1] - offsets[row]]
                    text, t_at = _joined(pieces, ids)
                    digit, d_at = _joined(digits, ids)
                    for lo, hi in zip(ends, ends[1:]):
                        n_ids.append(int(hi - lo))
                        ids_sha.append(hashlib.sha256(digit[d_at[lo] : max(d_at[hi] - 1, d_at[lo])]).hexdigest())
                        text_sha.append(hashlib.sha256(text[t_at[lo] : t_at[hi]]).hexdigest())
                yield pa.RecordBatch.from_arrays([names, pa.array(n_ids, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        release_memory()

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every whole text by the ranks in ``path``, without special tokens.

    Input ``docs(doc_id, text, ...)``; other columns are ignored. Null text is empty and has no
    ids: both digests are those of nothing. Null ids and repeated rows are documents like any
    other. An empty table gives an empty result. A word of any length ends: see ``merge_long``.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``.
    """
    bounded_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("t"))
    late = (F.octet_length("t") > F.char_length("t")) & F.col("t").rlike(r"\p{Cn}")
    cut = text.select("doc_id", F.when(~late, byte_level_pieces(F.col("t"), PIECES)).alias("pieces"), F.when(late, F.col("t")).alias("text"))
    context = docs.sparkSession.sparkContext
    literal = rank_literal(path)
    words, ids, lengths = shared_words(text, literal)
    named = cut.mapInArrow(namer(path, context.broadcast(words)), "anew boolean, new array<struct<word:string,ids:array<int>>>, doc_ids array<long>, counts array<int>, codes array<int>")
    coded = named.select("anew", F.transform("new", lambda x: F.coalesce(x["ids"], encode_word(x["word"], literal))).alias("ids"), "doc_ids", "counts", "codes")
    return coded.mapInArrow(digests(path, context.broadcast((ids, lengths))), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
