"""Numpy views of text batches, shared by the operators that score text inside Arrow batches.

A batch of texts is laid out as blocks of at most ``limit`` code points; a text longer than that spans several pieces, cut after a
whitespace where one is near. So memory in a task is bounded by the block, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np

BLOCK_CHARS = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def char_tables() -> dict[str, np.ndarray]:
    """Per code point: lower-case code point, and whether it is a letter, upper case, a digit, white space, alphanumeric."""
    size, step = 0x110000, 1 << 14
    lower = np.arange(size, dtype=np.uint32)
    tests = {"alpha": str.isalpha, "upper": str.isupper, "digit": str.isdigit, "space": str.isspace, "alnum": str.isalnum}
    out = {name: np.zeros(size, bool) for name in tests}
    for first in range(0, size, step):  # in slices, as every Python worker builds the tables and strings are large
        chars = [chr(i) for i in range(first, first + step)]
        for i, c in enumerate(chars, first):
            low = c.lower()
            if low != c and len(low) == 1:
                lower[i] = ord(low)
        for name, test in tests.items():
            out[name][first : first + step] = np.fromiter(map(test, chars), bool, step)
    return {"lower": lower, **out}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    up, down = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, _ODD), out=up[1:])
    np.multiply.accumulate(np.full(n, inverse), out=down[1:])
    return up, down


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``codes[start:end]`` for each run: equal runs hash alike wherever they stand."""
    size = 1 << max(16, int(len(codes)).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Block:
    """Pieces of texts, each followed by a newline in ``codes``. rows: the text of each piece; begin: where the piece starts in its text."""

    rows: np.ndarray
    begin: np.ndarray
    at: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray

    @cached_property
    def lower(self) -> np.ndarray:
        return char_tables()["lower"][self.codes]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and piece numbers of the maximal runs where ``inside`` holds; the newline after a piece never is inside."""
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return starts, ends, np.searchsorted(self.at, starts, side="right") - 1

    def words(self, table: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of characters of a table; "~space" takes those outside the table "space"."""
        flags = char_tables()[table.lstrip("~")][self.codes]
        flags = ~flags if table[0] == "~" else flags
        flags[self.at + self.lengths] = False
        return self.runs(flags)


def _cut(text: str, limit: int, whole_words: bool) -> Iterator[tuple[int, str]]:
    start = 0
    while len(text) - start > limit:
        end = start + limit
        space = max(text.rfind(" ", start + limit // 2, end), text.rfind("\n", start + limit // 2, end))
        if space < 0 and whole_words:
            space = min([k for k in (text.find(" ", end), text.find("\n", end)) if k >= 0], default=len(text) - 1)
        end = space + 1 if space >= 0 else end
        yield start, text[start:end]
        start = end
    yield start, text[start:] if start else text


def blocks(texts: list[str], limit: int = BLOCK_CHARS, whole_words: bool = False) -> Iterator[Block]:
    """Blocks over all texts, in order; an empty text is a piece of length 0. whole_words: a piece may exceed the limit by part of a word."""

    def build(pieces: list[tuple[int, int, str]]) -> Block:
        lengths = np.fromiter((len(p[2]) for p in pieces), np.int64, len(pieces))
        at = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
        joined = "\n".join(p[2] for p in pieces) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        return Block(np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64), at, lengths, codes)

    held, size = [], 0
    for row, text in enumerate(texts):
        for begin, piece in _cut(text, limit, whole_words):
            if held and size + len(piece) > limit:
                yield build(held)
                held, size = [], 0
            held.append((row, begin, piece))
            size += len(piece) + 1
    if held:
        yield build(held)


def as_texts(column) -> list[str]:
    """A pandas or Arrow column as a list in which null is the empty text."""
    values = column.to_pylist() if hasattr(column, "to_pylist") else column.tolist()
    return [v if isinstance(v, str) else "" for v in values]
