"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

Tokens come from a public tokenizer, an end id closes each document. Whole windows are cut off documents longer than a window; the rests of
a block of documents, in parts of at most ``GRAIN`` tokens, are then divided among windows: differencing keeps partial partitions, merges
the two of the largest imbalance by pairing the fullest windows of the one with the emptiest of the other, and ends with near-equal
windows. It starts with as many windows as the sum needs; whenever one exceeds its capacity the count rises by one and all are divided
again, with finer parts where these are too alike to level. So the padding of a block is what its count rose by, spread over its windows.

Blocks are formed inside a task from the rows as they come, with a bound on their tokens; no shuffle and no global order are needed, and a
lost task makes the same windows again.

Defined cases: a null or empty text is the end id alone; equal rows are packed separately; parts of equal size are dealt in the order of
rows; very long texts are tokenized in parts at places where the tokenizer's pattern always splits; sequence ids are unique, not gapless;
an empty table gives no rows. Only doc_id and the named text column are read, so other columns may have any names.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import small_batches

WINDOW = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 20
BLOCK_ITEMS = 1024
#: Rests of documents are dealt in parts of at most so many tokens: the smaller the parts, the nearer to equal the windows.
GRAIN = 512
#: So many rests for each window have a part that halves down to this many tokens.
FINE, LEAST = 0.5, 16
#: Where parts are too alike, so that windows would take more than this many times their tokens, finer ones level them.
MOST_RISE = 1.005

#: A single space between two other characters: the tokenizer's pattern always splits before it.
_PLACE = re.compile(r"(?<=\S)(?= \S)")
PART_CHARS = 1 << 20


def public_tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Coder:
    """Ids as the ``tokenizers`` file at ``path`` gives them without special tokens added.

    The file's own vocabulary is read into ``tiktoken``, which gives the same ids (a test compares the two) in a fifth of the time.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
        self.special = tuple(special)
        self.encoding = tiktoken.Encoding(Path(path).stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def _ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.encoding.encode(text, allowed_special="all")
        return self.encoding.encode_ordinary(text)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= PART_CHARS:
            return np.array(self._ids(text), "<u4")
        parts, start = [], 0
        while start < len(text):
            place = _PLACE.search(text, start + PART_CHARS)
            end = place.start() if place else len(text)
            parts.append(np.array(self._ids(text[start:end]), "<u4"))
            start = end
        return np.concatenate(parts)


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Item numbers of ``windows`` near-equal groups, by Karmarkar-Karp differencing.

    A partial partition is its loads, descending and relative to the least. The two of the largest imbalance are merged, the fullest groups of
    the one with the emptiest of the other. The groups are read off the merges afterwards, from the last to the first.
    """
    if windows <= 1 or not sizes:
        return [list(range(len(sizes)))] + [[] for _ in range(windows - 1)]
    # (negative imbalance, order, loads); groups beyond those listed are empty and have load 0.
    heap = [(-size, k, np.array([size], np.int32)) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    merges, number = [], len(heap)
    while len(heap) > 1:
        (_, a, la), (_, b, lb) = heapq.heappop(heap), heapq.heappop(heap)
        width = min(windows, len(la) + len(lb))
        loads = np.zeros(width, np.int32)
        loads[: len(la)] = la
        loads[width - len(lb) :] += lb[::-1]
        order = np.argsort(-loads, kind="stable")
        loads = loads[order]
        if width == windows:
            loads -= loads[-1]
        merges.append((a, len(la), b, len(lb), order))
        heapq.heappush(heap, (-int(loads[0]), number, loads))
        number += 1
    held = {heap[0][1]: np.arange(len(heap[0][2]))}  # the group of each load of a partition
    for k in range(len(merges) - 1, -1, -1):
        a, na, b, nb, order = merges[k]
        group = np.empty(len(order), np.int64)
        group[order] = held.pop(len(sizes) + k)
        held[a], held[b] = group[:na], group[len(order) - nb :][::-1]
    groups: list[list[int]] = [[] for _ in range(windows)]
    for item, group in sorted(held.items()):
        groups[int(group[0])].append(item)
    return groups


def parts_of(rest: int, fine: bool, grain: int = GRAIN, least: int = LEAST) -> list[int]:
    """Sizes of the parts in which a rest is dealt: of like size and at most ``grain`` tokens; of a ``fine`` one the last part halves down to ``least``."""
    number = -(-rest // grain)
    parts = [rest * (i + 1) // number - rest * i // number for i in range(number)]
    while fine and parts[-1] >= 2 * least:
        parts[-1:] = [parts[-1] - parts[-1] // 2, parts[-1] // 2]
    return parts


def _cut(lengths: list[int], window: int, grain: int, share: float, least: int) -> list[tuple[int, int, int]]:
    """(item, start, length) of the parts of the rests; ``share`` rests for each window have a part that halves down to ``least``."""
    parts, total, fine = [], 0, 0
    for k, n in enumerate(lengths):
        rest = n % window
        if rest:
            at, level = n - rest, fine * window < total * share
            for size in parts_of(rest, level, grain, least):
                parts.append((k, at, size))
                at += size
            total, fine = total + rest, fine + level
    return parts


def pack(lengths: list[int], window: int = WINDOW, grain: int = GRAIN) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length): every token of every item lies in exactly one piece, in windows of at most ``window`` tokens.

    Whole windows are cut off long items. The rests, in parts, are divided by ``difference`` into as few windows as their sum needs. Where one
    exceeds its capacity, its excess over the mean tells how many windows would hold all, and the count rises to that. If that is more than
    ``MOST_RISE`` of the sum, the parts are too alike to level: a rest for each window is then cut down to single tokens, and all are divided again.
    """
    out = [[(k, a, window)] for k, n in enumerate(lengths) for a in range(0, n - window + 1, window)]
    total = sum(n % window for n in lengths)
    if not total:
        return out
    windows, level = -(-total // window), True
    rests = _cut(lengths, window, grain, FINE, LEAST)
    while True:
        groups = difference([r[2] for r in rests], windows)
        largest = max(sum(rests[i][2] for i in group) for group in groups)
        if largest <= window:
            break
        excess = largest - total / windows
        needed = max(windows + 1, int(total / (window - excess)) if excess < window / 2 else 0)
        if level and (needed * window > total * MOST_RISE or excess >= window / 2):
            level, rests = False, _cut(lengths, window, grain, 1, 1)
        else:
            windows = needed
    for group in groups:
        held: list[tuple[int, int, int]] = []
        for k, a, n in sorted(rests[i] for i in group):
            if held and held[-1][0] == k and held[-1][1] + held[-1][2] == a:  # parts that met again are one piece
                held[-1] = (k, held[-1][1], held[-1][2] + n)
            else:
                held.append((k, a, n))
        out.append(held)
    return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack_documents(documents: DataFrame, tokenizer_path: str | None = None, text: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, the piece's token ids."""
    path = tokenizer_path or public_tokenizer_path()
    fields = _SCHEMA.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = coder(path).encode, TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        held = 0
        end = np.array([END_ID], "<u4")

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for sequence_pieces in pack([len(t) for t in tokens], window):
                offset = 0
                for k, a, n in sequence_pieces:
                    piece = tokens[k][a : a + n]
                    rows.append((ids[k], a, n, zlib.crc32(piece.tobytes()), len(tokens[k]), sequence, offset, *([piece.astype(np.int32)] if with_ids else [])))
                    offset += n
                sequence += 1
            ids.clear(), tokens.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), fields.types)], schema=fields)

        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for row in range(batch.num_rows):
                got = np.concatenate([encode(texts[row].as_py() or ""), end])
                ids.append(names[row].as_py())
                tokens.append(got)
                held += len(got)
                if held >= BLOCK_TOKENS or len(ids) >= BLOCK_ITEMS:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, schema)
