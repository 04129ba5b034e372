"""Best-fit packing planned on the histogram of lengths.

A document is tokenized once and, where it is longer than a sequence, cut into whole ones after a shorter first piece, so what its pieces
are follows from its length alone. Spark counts the pieces of each length; best fit, longest first, is then run over these counts: bins of
the same content are one group, and a whole group takes items at once. The plan has at most four groups a length, whatever the number of
documents. In the plan each length has runs of ranks, each with its first sequence and its offset; a piece finds its run by its rank within
its length.

Ranks need no global order: a task numbers the pieces of each length as it tokenizes, and the tasks' counts are summed up by Spark, so a
length that a third of all pieces share is no more work than another. Tokens are not kept: of each piece only its place, length and checksum
go on, in a checkpoint from which lost tasks read the same numbers again.

Defined cases: a null or empty text is the end id alone; equal rows and rows without an id are packed each by itself; pieces of equal length
take their slots in the order of tasks and rows; very long texts are tokenized in parts at places where the tokenizer's pattern always
splits; an empty table gives no rows. Only doc_id and the named text column are read, so other columns may have any names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import checkpointed, small_batches
from flowlens.llm.packing import coder, public_tokenizer_path

SEQUENCE = 1024
END_ID = 2
#: Pieces that a task holds before it passes them on.
HELD_PIECES = 1 << 15
#: A plan's key is the length above so many bits of rank.
RANK_BITS = 48


def cuts(tokens: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences at the end, what is left over first."""
    first = tokens % sequence or min(tokens, sequence)
    return [(0, first)] + [(a, sequence) for a in range(first, tokens, sequence)]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64())])
_SQL_SCHEMA = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, place long"


def pieces(documents: DataFrame, tokenizer_path: str | None = None, text: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and its ``place`` among the pieces of its length in task ``part``."""
    path = tokenizer_path or public_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = coder(path).encode, TaskContext.get().partitionId(), Counter()
        end, rows = np.array([end_id], "<u4"), []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)
            rows.clear()
            return batch

        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for row in range(batch.num_rows):
                ids = np.concatenate([encode(texts[row].as_py() or ""), end])
                for number, (start, length) in enumerate(cuts(len(ids), sequence)):
                    rows.append((names[row].as_py(), number, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length]))
                    seen[length] += 1
                if len(rows) >= HELD_PIECES:
                    yield flush()
        if rows:
            yield flush()

    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, _SQL_SCHEMA)


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, over counts: (number of sequences, [(length, how many of it in each)]) of each group of like sequences.

    An item goes where it leaves least room. A sequence with the least sufficient room keeps it until the next item of this length does not
    fit any more, so it takes as many as fit; all sequences of a group do so together, and at most one group is divided for each length.
    """
    groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []

    def put(room: int, number: int, content: list[tuple[int, int]]) -> None:
        if number:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((number, content))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, number, content = sequence, -(-left // (sequence // length)), []  # as many new ones as the rest needs
            else:
                room = rooms[at]
                number, content = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            each = room // length
            full = min(number, left // each)
            rest = left - full * each if full < number else 0
            put(room - each * length, full, [*content, (length, each)])
            if rest:
                put(room - rest * length, 1, [*content, (length, rest)])
            put(room, number - full - (rest > 0), content)
            left -= full * each + rest
    return [group for room in rooms for group in groups[room]]


def runs(groups: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """A plan as rows (key, first rank, how many in a sequence, first sequence, offset), by key: length above rank."""
    rows, taken, sequence = [], Counter(), 0
    for number, content in groups:
        offset = 0
        for length, each in content:
            rows.append((length << RANK_BITS | taken[length], taken[length], each, sequence, offset))
            taken[length] += number * each
            offset += length * each
        sequence += number
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def slot_column(table: np.ndarray, session, length: str | Column, rank: str | Column) -> Column:
    """struct(sequence_id, offset) of the piece of this rank within its length."""
    shared = session.sparkContext.broadcast(table)

    @F.pandas_udf("sequence_id long, offset long")
    def slot(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        key, first, each, sequence, offset = shared.value.T
        size, rank = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        at = np.searchsorted(key, size << RANK_BITS | rank, "right") - 1
        behind = rank - first[at]
        return pd.DataFrame({"sequence_id": sequence[at] + behind // each[at], "offset": offset[at] + behind % each[at] * size})

    return slot(length, rank)


def pack_documents(documents: DataFrame, tokenizer_path: str | None = None, text: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    What comes to the driver is a count a length; what is broadcast has at most four groups a length, of which each holds no more different
    lengths than sum to a sequence (44 for 1,024).
    """
    rows = checkpointed(pieces(documents, tokenizer_path, text, sequence, end_id))
    by_task = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    slot = slot_column(runs(plan(histogram, sequence)), documents.sparkSession, "length", F.col("before") + F.col("place"))
    placed = rows.join(counted, ["part", "length"]).withColumn("slot", slot)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", "slot.sequence_id", "slot.offset")
