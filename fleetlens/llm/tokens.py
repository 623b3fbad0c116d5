"""Tokenising whole texts by their distinct pieces.

A text is cut at places where no token of the vocabulary can lie across. Within an Arrow batch
each distinct piece that the task hasn't met is encoded once, and the ids are put together by
numpy. A task remembers a bounded number of pieces, so memory doesn't follow the corpus.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the public vocabularies' patterns see it (the Unicode property White_Space).
SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The pattern of the byte-level vocabularies, for Java's regular expressions.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: A space beside other white space, for Arrow's regular expressions.
SPACE_RUN = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] | [\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Words that can be encoded between line ends, and between ones.
ONE_WORD, NO_ONE = re.compile(r" ?\S+"), re.compile(r"[^1\s]+")
#: Distinct words that a task remembers.
MOST_WORDS = 600_000
#: Words put together at a time.
SLICE = 1 << 19


def byte_level_pieces(text: Column, pattern: str = PIECES) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """A public tokenizer of the ``tokenizers`` library, once a worker; special strings in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _encode_each(t, pieces: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, dtype=np.uint32) for e in t.encode_batch_fast(pieces, add_special_tokens=False)]


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable Latin-1 as itself, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


#: Letters of alphabets that every Unicode version knows alike; with ASCII, what ``PlainWords`` takes.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0391-\u03a1\u03a3-\u03f5\u0400-\u0481\u048a-\u051f"
#: A line end between two words of a line each is a piece of its own.
PLAIN = re.compile(rf" ?[!-~{LETTERS}]+(?:\n[!-~{LETTERS}]+)*")
PLAIN_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\n")
MOST_PIECES = 200_000


class PlainWords:
    """Words in plain letters, cut by the byte-level pattern; their pieces go straight to the library's model.

    A word and the same word before a comma share a piece, which is encoded once.
    """

    def __init__(self, t):
        self.tokenize, self.known = t.model.tokenize, {}

    def piece(self, piece: str) -> bytes:
        """The ids of one piece, four bytes each."""
        if len(self.known) > MOST_PIECES:
            self.known.clear()
        spelt = piece.replace(" ", BYTE_LETTERS[32]) if piece.isascii() and piece != "\n" else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = self.known[piece] = array("I", [x.id for x in self.tokenize(spelt)]).tobytes()
        return ids

    def encode(self, words: list[str]) -> tuple[list[int], list[bytes], list[int]]:
        """The plain words' numbers and ids, and the other words' numbers."""
        plain, pieces, get, one = PLAIN.fullmatch, PLAIN_PIECE.findall, self.known.get, self.piece
        done, found, left = [], [], []
        for i, w in enumerate(words):
            if w.isascii() and w[1:].isalpha() and (w[0] == " " or w[0].isalpha()):
                done.append(i)
                found.append(get(w) or one(w))
            elif plain(w):
                parts = pieces(w)
                done.append(i)
                found.append((get(w) or one(w)) if len(parts) == 1 else b"".join([get(x) or one(x) for x in parts]))
            else:
                left.append(i)
        return done, found, left


def encode_words(t, words: list[str], separator: str, fit: re.Pattern, plain: PlainWords | None = None, run: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of many words: the words' numbers in the order encoded, flat ids, and how many each has.

    ``plain`` encodes the words that it can. Of the others, those that ``fit`` are encoded as one
    text each ``run`` words, parted by ``separator``, whose one id can't come from such words; this
    saves the library's cost of a call for each word. The rest are encoded one by one.
    """
    mark = t.encode(separator, add_special_tokens=False).ids
    assert len(mark) == 1, separator
    fits = fit.fullmatch
    order, easy, hard = [], [], []
    flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    left = range(len(words))
    if plain is not None:
        order, found, left = plain.encode(words)
        flat.append(np.frombuffer(b"".join(found), dtype=np.uint32))
        lengths.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4)
    for i in left:
        (easy if fits(words[i]) else hard).append(i)
    for at in range(0, len(easy), run):
        some = easy[at : at + run]
        ids = np.array(t.encode_batch_fast([separator.join([words[i] for i in some])], add_special_tokens=False)[0].ids, dtype=np.uint32)
        marks = np.flatnonzero(ids == mark[0])
        if len(marks) != len(some) - 1:
            hard += some
            continue
        order += some
        flat.append(np.delete(ids, marks))
        lengths.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
    if hard:
        each = _encode_each(t, [words[i] for i in hard])
        order += hard
        flat += each
        lengths.append(np.array([len(x) for x in each], dtype=np.int64))
    return np.array(order, dtype=np.int64), np.concatenate(flat), np.concatenate(lengths)


def gather(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``ids[start : start + length]`` of each word."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def row_slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` words each (one row at least)."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, to
        row = to


Rows = Iterator[tuple[int, np.ndarray, np.ndarray]]


def _assemble(lists: pa.Array, encode: Callable[[pa.Array, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Rows:
    """For slices of rows: first row, flat ids, and each row's bounds in them.

    ``encode`` gets the flat words and the rows' offsets; it returns ids, the words' lengths and
    the code of every word.
    """
    offsets = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64))])
    ids, lengths, index = encode(lists.flatten(), offsets)
    starts = np.cumsum(lengths) - lengths
    for row, to in row_slices(offsets):
        at = index[offsets[row] : offsets[to]]
        n = lengths[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        yield row, gather(ids, starts[at], n), ends[offsets[row : to + 1] - offsets[row]]


class Words:
    """The ids of the distinct words met so far in a task; starts anew beyond ``MOST_WORDS``."""

    def __init__(self, t, separator: str, fit: re.Pattern, prefix: str = "", plain: PlainWords | None = None):
        self.t, self.separator, self.fit, self.prefix, self.plain = t, separator, fit, prefix, plain
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def codes(self, words: pa.Array) -> np.ndarray:
        """Each word's place among the known ones; unknown words are encoded first."""
        if len(self.known) > MOST_WORDS:
            self.clear()
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        place = np.fromiter((self.known.get(w, -1) for w in names), dtype=np.int64, count=len(names))
        new = np.flatnonzero(place < 0)
        if len(new):
            some = [names[i] for i in new]
            order, ids, lengths = encode_words(self.t, [self.prefix + w for w in some] if self.prefix else some, self.separator, self.fit, self.plain)
            at = len(self.known) + np.arange(len(new))
            place[new[order]] = at
            self.known.update(zip([some[i] for i in order], at.tolist(), strict=True))
            self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
        return place[np.asarray(coded.indices)]


class Spaced:
    """For vocabularies that drop white space: the distinct parts between ASCII white space."""

    def __init__(self, path: str):
        self.words = Words(tokenizer(path), " 1 ", NO_ONE)

    def rows(self, texts: pa.Array) -> Rows:
        def encode(words: pa.Array, _: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            index = self.words.codes(words)
            return self.words.ids, self.words.lengths, index

        yield from _assemble(pc.ascii_split_whitespace(texts), encode)


class ByteLevel:
    """For byte-level vocabularies: a token never lies across a single space between two words.

    So a text is cut before such spaces and its distinct parts are encoded. A text in which a
    space stands beside other white space is encoded in one piece.
    """

    def __init__(self, path: str):
        self.t = tokenizer(path)
        plain = PlainWords(self.t)
        self.words, self.heads = Words(self.t, "\n", ONE_WORD, " ", plain), Words(self.t, "\n", ONE_WORD, plain=plain)

    def _encode(self, words: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        index = self.words.codes(words)
        first = offsets[:-1]  # a text's first part has no space before it; every text has a first part
        index[first] = self.heads.codes(words.take(pa.array(first))) + len(self.words.known)
        return np.concatenate([self.words.ids, self.heads.ids]), np.concatenate([self.words.lengths, self.heads.lengths]), index

    def rows(self, texts: pa.Array) -> Rows:
        whole = np.asarray(pc.match_substring_regex(texts, SPACE_RUN))
        lists = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
        if not whole.any():
            yield from _assemble(lists, self._encode)
            return
        parts: list[np.ndarray] = []
        for _, ids, ends in _assemble(lists, self._encode):
            parts += np.split(ids, ends[1:-1])
        found = dict(zip(np.flatnonzero(~whole).tolist(), parts, strict=True))
        hard = np.flatnonzero(whole).tolist()
        found |= dict(zip(hard, _encode_each(self.t, texts.take(pa.array(hard)).to_pylist()), strict=True))
        bounds = np.concatenate([[0], np.cumsum([len(found[i]) for i in range(len(texts))])]).astype(np.int64)
        for row, to in row_slices(bounds):
            yield row, np.concatenate([found[i] for i in range(row, to)]), bounds[row : to + 1] - bounds[row]
