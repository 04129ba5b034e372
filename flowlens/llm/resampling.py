"""Importance resampling towards a target distribution over hashed words and pairs of words.

A feature is a word or two words in a row; its bucket is the CRC-32 of its bytes. Words come in a head and a tail: the words that are most
frequent in the documents are counted by Spark and broadcast with the exact state of the CRC after them, and pairs of the most frequent of
these with their buckets, ready made. Any other word takes its CRC from its bytes, any other pair goes on from the state of its first word
over the bytes of the second. Both give the same bucket, so the head decides on speed alone, and the totals of buckets are exact.

Documents are then weighted by the mean gain of their features, and drawn without replacement by the largest sums of weight and Gumbel
noise, which depends on the id alone. Sums are whole numbers in a range that does not grow with the documents, so the driver sees only how
many documents have each; ranks are counted on by Spark within one sum.

Defined cases: a null text has no words; a text without words has weight 0; rows without an id draw the noise of an empty one and come
first among equals; rows that share an id draw the same noise, and among equal scores follow each other by their features and weight; very
long texts are read in pieces; without a target text gains are those of an empty one; an empty table gives no rows. Only doc_id and the text
are read, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import checkpointed, small_batches
from flowlens.llm.utf8 import utf8

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: So many words have a state, so many of these a bucket for each pair of them (8 MB).
HEAD_WORDS, HEAD_PAIRS = 1 << 16, 1 << 11
#: Words that are worked on at once, bytes of a text that are split at once, different words that a task counts before it passes them on.
HELD_WORDS, PIECE_BYTES, HELD_COUNTS = 1 << 18, 1 << 20, 1 << 17

#: Capitals become small letters; what is in no word becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(data: np.ndarray, bounds: np.ndarray, piece: int = PIECE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(text, words) in order; a long text comes in several pieces, cut between words."""
    for row in range(len(bounds) - 1):
        text = data[bounds[row] : bounds[row + 1]].tobytes().translate(_FOLD)
        at = 0
        while at < len(text):
            end = len(text) if len(text) - at <= piece else text.find(b" ", at + piece)
            end = end if end >= 0 else len(text)
            yield row, text[at:end].split()
            at = end


def _after_space(crc: np.ndarray) -> np.ndarray:
    """CRC-32 of texts of which ``crc`` is known, with a space put after each."""
    state = crc.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    return _space_table()[(state & np.uint32(0xFF)) ^ np.uint32(32)] ^ (state >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)


def _space_table() -> np.ndarray:
    """The step of the CRC for each low byte, from the rule of its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


@dataclass
class Head:
    """Frequent words, most frequent first, with the bucket of each, the state of the CRC after it and a space, and buckets of the first pairs."""

    words: list[bytes]
    buckets: int = BUCKETS
    most_pairs: int = HEAD_PAIRS
    place: dict[bytes, int] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.place = {word: k for k, word in enumerate(self.words)}
        crc = np.fromiter(map(crc32, self.words), np.uint32, len(self.words))
        self.bucket = (crc % self.buckets).astype(np.int32)
        self.state = _after_space(crc) if len(crc) else crc
        self.paired = min(self.most_pairs, len(self.words))
        self.pair = self._pairs()

    def _pairs(self) -> np.ndarray:
        """Buckets of all pairs of the first words: the states of all of them go on over the bytes of each second word."""
        table, out = _space_table(), np.zeros((self.paired, self.paired), np.uint16 if self.buckets <= 1 << 16 else np.int32)
        for k, word in enumerate(self.words[: self.paired]):
            state = self.state[: self.paired] ^ np.uint32(0xFFFFFFFF)
            for byte in word:
                state = table[(state & np.uint32(0xFF)) ^ np.uint32(byte)] ^ (state >> np.uint32(8))
            out[:, k] = (state ^ np.uint32(0xFFFFFFFF)) % self.buckets
        return out

    def features(self, words: list[bytes], row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of each word, places of the first words of pairs, bucket of each pair); words of one row in a row are a pair."""
        n = len(words)
        known = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, n)
        bucket, state = np.zeros(n, np.int64), np.zeros(n, np.uint32)
        head, tail = known >= 0, np.flatnonzero(known < 0)
        if len(self.words):
            bucket[head], state[head] = self.bucket[known[head]], self.state[known[head]]
        if len(tail):
            crc = np.fromiter((crc32(words[k]) for k in tail.tolist()), np.uint32, len(tail))
            bucket[tail], state[tail] = crc % self.buckets, _after_space(crc)
        first = np.flatnonzero(row[1:] == row[:-1])
        a, b = known[first], known[first + 1]
        ready = (a >= 0) & (b >= 0) & (a < self.paired) & (b < self.paired)
        pair = np.zeros(len(first), np.int64)
        if ready.any():
            pair[ready] = self.pair[a[ready], b[ready]]
        rest = np.flatnonzero(~ready)
        if len(rest):
            at = first[rest]
            pair[rest] = np.fromiter((crc32(words[k + 1], s) for k, s in zip(at.tolist(), state[at].tolist())), np.uint32, len(rest)) % self.buckets
        return bucket, first, pair


def blocks(column: pa.Array, held: int = HELD_WORDS, piece: int = PIECE_BYTES) -> Iterator[tuple[list[bytes], np.ndarray, int]]:
    """(words, the text of each, how many come from the block before): the last word before a cut in a text comes again, for its pair."""
    words: list[bytes] = []
    rows, sizes, again, last = [], [], 0, None
    for row, found in pieces(*utf8(column), piece):
        if words and len(words) + len(found) > held:
            yield words, np.repeat(rows, sizes), again
            again = int(last == row)
            words, rows, sizes = (words[-1:], [row], [1]) if again else ([], [], [])
        words += found
        rows.append(row)
        sizes.append(len(found))
        last = row if found else last
    if words:
        yield words, np.repeat(rows, sizes), again


def word_counts(documents: DataFrame, text: str = "text", held: int = HELD_COUNTS) -> DataFrame:
    """(word, n): how often each word occurs, counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for _, words in pieces(*utf8(batch.column(0))):
                counts.update(words)
                if len(counts) > held:
                    yield as_batch()
                    counts.clear()
        if counts:
            yield as_batch()

    small_batches(documents.sparkSession)
    return documents.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = HEAD_WORDS) -> list[bytes]:
    """At most ``most`` of the most frequent words, found by a histogram of counts in steps of an eighth of an octave, so no sort of all words."""
    step = F.floor(F.log2("n") * 8).cast("int")
    rows = checkpointed(counts.withColumn("step", step))
    above, least = 0, None
    for r in sorted(rows.groupBy("step").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"]):
        above += r["words"]
        if above > most:
            break
        least = r["step"]
    if least is None:
        return []
    kept = rows.where(F.col("step") >= least).select("word", "n").collect()
    return [bytes(r["word"]) for r in sorted(kept, key=lambda r: (-r["n"], bytes(r["word"])))]


def bucket_totals(documents: DataFrame, head, text: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket; ``head`` is a broadcast ``Head``. A task passes on one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Head = head.value
        total = np.zeros(own.buckets, np.int64)
        for batch in batches:
            for words, row, again in blocks(batch.column(0)):
                bucket, _, pair = own.features(words, row)
                total += np.bincount(bucket[again:], minlength=own.buckets) + np.bincount(pair, minlength=own.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(head.value.buckets, np.int64)
    for r in documents.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln) of its share in the target over that in the source, one added to each bucket."""
    buckets = len(source)
    all_source, all_target = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_target))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def weigh(documents: DataFrame, head, gain: np.ndarray, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document; the weight is the floored mean of its features' gains."""
    shared = documents.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, gain = head.value, shared.value
        for batch in batches:
            rows = batch.num_rows
            n_words, n_pairs, total = np.zeros((3, rows), np.int64)
            for words, row, again in blocks(batch.column(1)):
                bucket, first, pair = own.features(words, row)
                n_words += np.bincount(row[again:], minlength=rows)
                n_pairs += np.bincount(row[first], minlength=rows)
                # Sums of a block stay far below 2**53, so these doubles are exact.
                total += (np.bincount(row[again:], gain[bucket[again:]], rows) + np.bincount(row[first], gain[pair], rows)).astype(np.int64)
            features = n_words + n_pairs
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in (n_words, features, weight)]], names=["doc_id", "n_words", "n_features", "weight"])

    return documents.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of SHA-256 of ``seed:id``."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))


def drawn(weighted: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Adds ``rank`` to rows with doc_id, n_words, n_features, weight and score: 1, 2, ... for the drawn, null for the others.

    Scores are whole numbers within about 115,000 of each other whatever the table: gains lie within 1,000 ln(2**63) of zero and the noise
    between -3,200 and 22,900. The driver counts them; rows of one score, of which the noise leaves no more than a part in 2,700, are then
    numbered where they meet.
    """
    may = F.col("n_words") >= least_words
    counted = weighted.where(may).groupBy("score").agg(F.count("*").alias("n")).collect()
    counted = sorted(((r["score"], r["n"]) for r in counted), reverse=True)
    size = sum(n for _, n in counted) * percent // 100
    before, above = [], 0
    for score, n in counted:
        if above >= size:
            break
        before.append((score, above))
        above += n
    least = before[-1][0] if before else None
    if least is None:
        return weighted.withColumn("rank", F.lit(None).cast("long"))
    starts = weighted.sparkSession.createDataFrame(before, "score long, _above long")
    among = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_features", "weight")
    inside = may & (F.col("score") >= least)
    ranked = weighted.where(inside).withColumn("_place", F.row_number().over(among)).join(F.broadcast(starts), "score").withColumn("rank", F.col("_above") + F.col("_place"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= size, F.col("rank"))).select(*weighted.columns, "rank")
    return ranked.unionByName(weighted.where(~inside).withColumn("rank", F.lit(None).cast("long")))


def resample(documents: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS, head_words: int = HEAD_WORDS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each document; ``target`` holds texts of the distribution that is wanted."""
    session = documents.sparkSession
    head = session.sparkContext.broadcast(Head(frequent(word_counts(documents, text), head_words), buckets))
    gain = gains(bucket_totals(documents, head, text), bucket_totals(target, head, target_text))
    weighted = checkpointed(weigh(documents, head, gain, text).withColumn("score", F.col("weight") + noise("doc_id", seed)))
    return drawn(weighted, least_words, percent)
