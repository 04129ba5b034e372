"""Filter interaction audit: what each filter of a chain removes, in every order in which the chain can be run.

Words, capitals, code points and symbols of a text come from one pass of a finite-state transducer over its UTF-8 bytes. Its states are
"between words" and "in a word"; a table maps a byte to its class, and a state and a class to the next state and to what is counted. As
the next state depends on the class alone, a block of bytes is passed by numpy at once. The spans of words it gives go into an
open-addressing hash table by (text, word): a span that meets a taken slot is compared with the word there, byte by byte in pieces of eight,
and moves on where they differ, so distinct words are exact whatever the hash.

Copies are told by SHA-256 of the text. A group of copies is counted by (digest, part, labels) before it meets in one place, so a group with
a third of all rows is as many rows as it has parts. All that is left is, for each part, a count by which of the five filters fail; the
orders are a product of these counts with a fixed matrix.

Defined cases: a null text is empty; an empty text fails A (unless another text is equal, E too); a null source is the part ""; rows without
an id are no copies and make none, and have no labels; rows that share an id and a text are originals together; a document that is labelled
twice counts as its largest label; very long texts are passed in pieces cut after white space; an empty table gives no rows. Only doc_id,
text and source are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.blocks import mix
from flowlens.llm.common import small_batches
from flowlens.llm.utf8 import SLACK, utf8

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = "#$%&*|"
#: Bytes that are passed at once; a longer text is cut after white space.
BLOCK_BYTES = 1 << 20

# Classes of bytes: each has what it counts as in its bits.
SPACE, CAPITAL, SYMBOL, INNER = 1, 2, 4, 8


def byte_classes(symbols: str = SYMBOLS) -> np.ndarray:
    """Class of each byte: white space, capital letter, symbol, or a byte within a code point; 0 for all others."""
    table = np.zeros(256, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = SPACE
    table[ord("A") : ord("Z") + 1] = CAPITAL
    table[[ord(c) for c in symbols]] = SYMBOL
    table[0x80:0xC0] = INNER
    return table


#: State (0 between words, 1 in a word) after a byte by its class, and whether the step from a state begins a word.
NEXT = np.array([0 if c & SPACE else 1 for c in range(16)], np.uint8)
BEGINS = np.array([NEXT, np.zeros(16)], bool)


@dataclass
class Counts:
    """Per text: words, distinct words, capitals, code points, symbols."""

    words: np.ndarray
    distinct: np.ndarray
    capitals: np.ndarray
    points: np.ndarray
    symbols: np.ndarray


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end. A view, read at the places asked for."""
    padded = np.concatenate([data, np.zeros(SLACK, np.uint8)])
    return np.ndarray(len(data), "<u8", padded, strides=(1,))


def spans(classes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of the texts that ``bounds`` divides; each text begins between words."""
    after = NEXT[classes]
    before = np.concatenate([np.zeros(1, np.uint8), after])
    fresh = bounds[:-1][bounds[:-1] < bounds[1:]]
    closed = fresh[before[fresh] == 1]  # a word at the end of the text before
    before[fresh] = 0
    starts = np.flatnonzero(BEGINS[before[:-1], classes])
    ends = np.flatnonzero((before[:-1] == 1) & (after == 0))
    last = [len(classes)] if len(classes) and after[-1] == 1 else []
    return starts, np.sort(np.concatenate([ends, closed, last]).astype(np.int64))


def distinct_spans(data: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places, in ``starts``, of one span for each distinct (text, bytes): those that own a slot of the table in the end."""
    eights, sizes = _eights(data), ends - starts
    first = eights[starts] & _MASKS[np.minimum(sizes, 8)]
    hashes = mix(first ^ mix(text.astype(np.uint64) << np.uint64(32) | sizes.astype(np.uint64)))

    def further(of: np.ndarray, k: int) -> np.ndarray:
        return eights[starts[of] + 8 * k] & _MASKS[np.minimum(sizes[of] - 8 * k, 8)]

    longer, k = np.flatnonzero(sizes > 8), 1
    while len(longer):
        hashes[longer] = mix(hashes[longer] ^ further(longer, k) + np.uint64(k))
        k += 1
        longer = longer[sizes[longer] > 8 * k]

    def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = (first[a] == first[b]) & (sizes[a] == sizes[b]) & (text[a] == text[b])
        check, k = np.flatnonzero(out & (sizes[a] > 8)), 1
        while len(check):
            alike = further(a[check], k) == further(b[check], k)
            out[check[~alike]] = False
            k += 1
            check = check[alike & (sizes[a[check]] > 8 * k)]
        return out

    mask = (1 << max(4, (2 * len(starts)).bit_length())) - 1
    table = np.full(mask + 1, -1, np.int32)
    slot = (hashes & np.uint64(mask)).astype(np.int64)
    waiting, owners = np.arange(len(starts)), []
    while len(waiting):
        at = slot[waiting]
        free = table[at] < 0
        table[at[free]] = waiting[free]  # of several the last one stays; the others meet it below
        there = table[at]
        owners.append(waiting[there == waiting])
        waiting = waiting[~equal(waiting, there)]
        slot[waiting] = (slot[waiting] + 1) & mask
    return np.concatenate(owners) if owners else waiting


def _between(places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(places, bounds))


def _pass(table: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> tuple[Counts, np.ndarray, np.ndarray]:
    """Counts of the texts of one block, with the span of each distinct word."""
    classes = table[data]
    starts, ends = spans(classes, bounds)
    text = np.searchsorted(bounds, starts, "right") - 1
    own = distinct_spans(data, text, starts, ends)
    of = lambda kind: _between(np.flatnonzero(classes == kind), bounds)
    size = len(bounds) - 1
    found = Counts(np.bincount(text, minlength=size), np.bincount(text[own], minlength=size), of(CAPITAL), np.diff(bounds) - of(INNER), of(SYMBOL))
    return found, starts[own], ends[own]


def _long(table: np.ndarray, data: np.ndarray, block: int) -> tuple[int, ...]:
    """The counts of one long text, in pieces that end after white space; its distinct words meet in a set."""
    totals, words, at = np.zeros(4, np.int64), set(), 0
    while at < len(data):
        end = min(at + block, len(data))
        gap = np.flatnonzero(table[data[at + block // 2 : end]] == SPACE)
        if end < len(data) and len(gap):
            end = at + block // 2 + int(gap[-1]) + 1
        while end < len(data) and table[data[end - 1]] != SPACE:  # a word longer than a piece
            gap = np.flatnonzero(table[data[end : end + block]] == SPACE)
            end = min(end + (int(gap[0]) + 1 if len(gap) else block), len(data))
        piece = data[at:end]
        got, starts, ends = _pass(table, piece, np.array([0, len(piece)]))
        words.update(piece[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist()))
        totals += [int(c[0]) for c in (got.words, got.capitals, got.points, got.symbols)]
        at = end
    return int(totals[0]), len(words), *totals[1:].tolist()


def count_texts(data: np.ndarray, bounds: np.ndarray, symbols: str = SYMBOLS, block: int = BLOCK_BYTES) -> Counts:
    """Counts of the texts ``data[bounds[i]:bounds[i + 1]]`` in UTF-8; at most a block, or one word if that is longer, is worked on at once."""
    table, rows = byte_classes(symbols), len(bounds) - 1
    out, row = np.zeros((rows, 5), np.int64), 0
    while row < rows:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + block, "right")) - 1)
        part = data[bounds[row] : bounds[end]]
        if len(part) > block:
            out[row] = _long(table, part, block)
        else:
            got = _pass(table, part, bounds[row : end + 1] - bounds[row])[0]
            out[row:end] = np.stack([got.words, got.distinct, got.capitals, got.points, got.symbols], axis=1)
        row = end
    return Counts(*out.T)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary())] + [(c, pa.int64()) for c in ("words", "distinct", "capitals", "points", "symbols")])
_SQL_SCHEMA = "doc_id long, part string, digest binary, words long, distinct long, capitals long, points long, symbols long"


def statistics(documents: DataFrame, text: str = "text", part: str = "source") -> DataFrame:
    """A row per document: doc_id, part, the digest of its text, and its numbers of words, distinct words, capitals, code points and symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = count_texts(*utf8(batch.column(3)))
            columns = [pa.array(c, pa.int64()) for c in (got.words, got.distinct, got.capitals, got.points, got.symbols)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), batch.column(2).cast(pa.binary()), *columns], schema=_SCHEMA)

    small_batches(documents.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(whole, 256)).alias("digest"), whole.alias("text"))
    return rows.mapInArrow(run, _SQL_SCHEMA)


def failing() -> Column:
    """Bits of the filters A to D that the counts of a text fail."""
    fails = [
        F.col("words") < LEAST_WORDS, 100 * F.col("distinct") < LEAST_DISTINCT * F.col("words"), 100 * F.col("capitals") > MOST_CAPITALS * F.col("points"), F.col("symbols") > 0,
    ]
    return sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0)).cast("int")


def failure_counts(documents: DataFrame, labels: DataFrame, text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): documents by which filters they fail (bit k of mask: filter k) and by their labels."""
    rows = statistics(documents, text, part).select("doc_id", "part", "digest", failing().alias("mask"))
    # Rows alike in all are counted first: what goes on has each (text, id, part) once.
    rows = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.coalesce(F.max("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("toxic"))
    # Rows without an id are spread by their text; they meet no label.
    key = F.coalesce("doc_id", F.xxhash64("digest", "part"))
    rows = rows.withColumn("_key", key).join(known, (F.col("_key") == F.col("_id")) & F.col("doc_id").isNotNull(), "left").na.fill(False, ["good", "toxic"])
    has_id = F.col("doc_id").isNotNull()
    groups = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(has_id, F.col("n"))), F.lit(0)).alias("_ids"), F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("_first"),
    )
    first = F.min("_first.doc_id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("_least", first).withColumn("_copies", F.col("_ids") - F.when(F.col("_first.doc_id") == F.col("_least"), F.col("_first.n")).otherwise(0))
    both = F.array(F.struct("mask", (F.col("n") - F.col("_copies")).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("_copies").alias("n")))
    counted = groups.select("part", "good", "toxic", F.explode(both).alias("c")).where("c.n > 0")
    return counted.groupBy("part", F.col("c.mask").alias("mask"), "good", "toxic").agg(F.sum("c.n").alias("n"))


def order_matrices(filters: str = FILTERS) -> tuple[list[str], list[str], dict[str, np.ndarray]]:
    """(orders, the filter of each (order, step), per figure a 0/1 matrix from masks to (order, step))."""
    orders = ["".join(o) for o in permutations(filters)]
    masks = np.arange(1 << len(filters))
    figures: dict[str, list[np.ndarray]] = {"kept": [], "removed": [], "redundant": [], "unique_fails": []}
    at = []
    for order in orders:
        earlier = 0
        for letter in order:
            bit = 1 << filters.index(letter)
            fails, gone = masks & bit > 0, masks & earlier > 0
            earlier |= bit
            for name, column in (("kept", masks & earlier == 0), ("removed", fails & ~gone), ("redundant", fails & gone), ("unique_fails", masks == bit)):
                figures[name].append(column)
            at.append(letter)
    return orders, at, {name: np.array(columns, np.int64).T for name, columns in figures.items()}


_OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(documents: DataFrame, labels: DataFrame, text: str = "text", part: str = "source") -> DataFrame:
    """A row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    steps = len(FILTERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        orders, at, m = order_matrices()
        which = np.array([FILTERS.index(letter) for letter in at])
        for pdf in batches:
            counts = np.zeros((3, len(pdf), 1 << steps), np.int64)  # all, good, toxic
            for row, cells in enumerate(pdf["cells"]):
                for cell in cells:
                    counts[:, row, cell["mask"]] += np.array([1, cell["good"], cell["toxic"]], np.int64) * cell["n"]
            out = {name: counts[0] @ matrix for name, matrix in m.items()}
            out |= {"good_lost": counts[1] @ m["removed"], "toxic_lost": counts[2] @ m["removed"]}
            by_filter = np.stack([out["removed"][:, which == k].sum(axis=1) for k in range(steps)], axis=1)
            out["shapley"] = by_filter[:, which]
            for row, name in enumerate(pdf["part"]):
                figures = {k: v[row] for k, v in out.items()}
                yield pd.DataFrame({"part": name, "filter_order": np.repeat(orders, steps), "step": np.tile(np.arange(1, steps + 1), len(orders)), **figures})

    cells = failure_counts(documents, labels, text, part).groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
    return cells.mapInPandas(run, _OUT)
