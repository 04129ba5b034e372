"""I-Match document fingerprints.

Terms of a text are kept if their inverse document frequency lies in a band; the sorted distinct terms are hashed once for each of several
randomised subsets of the lexicon. Subsets come in ``GROUPS`` nested families that keep 1/2, 1/4, ... of the lexicon, so that texts of any
length have subsets in which only a few of their terms stand; a fingerprint holds one byte (two hex digits) per subset, 00 where a text has
no term in it. Likeness compares subsets that are not empty on both sides, the sparsest of a family counting most.

A term is its hash bucket of ``BITS`` bits, wide enough for the vocabulary of a large corpus. Document frequencies are counted over all
documents by Spark; what is broadcast is one bit a bucket, 8 MB however large the corpus is.

Defined cases: a null text counts as empty; a text without a term in the band is fingerprinted by all its terms; texts without terms have
an all-zero fingerprint, alike only to its equal; very long texts are read whole; of rows that share an id, and of rows without one, which
come first of all, the one whose text sorts first comes first, so repeated rows follow each other; the only row of a table is its own
successor; an empty table gives no rows. Only doc_id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.blocks import as_texts, blocks, mix, run_hashes
from flowlens.llm.common import checkpointed, small_batches

BITS = 26
GROUPS, LEVELS = 16, 10
#: Terms are kept that stand in at least two documents and in at most this share of them.
LEAST_DOCUMENTS, MOST_SHARE = 2, 0.05
#: What a task holds at once, at most by one text or batch more: terms of documents, characters of texts.
HELD_PAIRS, HELD_CHARS = 1 << 22, 1 << 20
#: Slots hold about so many characters, and more where that would make more slots than the driver should keep the bounds of.
SLOT_CHARS, MOST_SLOTS = 1 << 24, 20_000


def term_pairs(texts: list[str]) -> np.ndarray:
    """Sorted distinct (row << BITS | term) of the alphanumeric tokens, lower-cased."""
    found = []
    for block in blocks(texts):
        starts, ends, piece = block.words("alnum")
        term = (run_hashes(block.lower, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
        found.append(np.unique(block.rows[piece] << BITS | term))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def document_frequencies(documents: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): in how many documents each term stands; as term -1 the number of documents, as term -2 that of their characters.

    Summed in each task over ``HELD_PAIRS`` terms of documents first, then by Spark.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, rows, chars = [], 0, 0, 0

        def flush() -> pd.DataFrame:
            seen, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"term": seen, "n": n})

        for pdf in batches:
            texts = as_texts(pdf.iloc[:, 0])
            held.append(term_pairs(texts) & ((1 << BITS) - 1))
            size, rows, chars = size + len(held[-1]), rows + len(texts), chars + sum(map(len, texts))
            if size > HELD_PAIRS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        yield pd.DataFrame({"term": [-1, -2], "n": [rows, chars]})

    return documents.select(text).mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def band(frequencies: DataFrame, least: int = LEAST_DOCUMENTS, most: float = MOST_SHARE) -> np.ndarray:
    """The kept terms, a bit each: idf between ln(1 / most) and ln(n / least). Spark builds the bitmaps; what comes to the driver has a fixed size."""
    n = frequencies.where("term = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    number = F.col("term").cast("long") + 1  # Spark's bitmaps begin with 1
    kept = frequencies.where((F.col("term") >= 0) & F.col("n").between(least, most * n))
    maps = kept.groupBy(F.bitmap_bucket_number(number).alias("place")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in maps.toLocalIterator():
        bits = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["place"] - 1) * len(bits) : r["place"] * len(bits)] = bits
    return out


def _is_kept(term: np.ndarray, kept: np.ndarray) -> np.ndarray:
    return (kept[term >> 3] >> (term & 7).astype(np.uint8)) & 1 == 1


@lru_cache(maxsize=1)
def _ones() -> np.ndarray:
    """For any ``LEVELS`` bits the sparsest subset of a family that a term with these bits belongs to (0: none)."""
    return np.array([LEVELS, *[(k & -k).bit_length() - 1 for k in range(1, 1 << LEVELS)]], np.uint8)


def fingerprints(texts: list[str], kept: np.ndarray) -> np.ndarray:
    """(texts, GROUPS, LEVELS) bytes: hashes of each text's terms in each subset, from the half of the lexicon to its 1/2**LEVELS."""
    pairs = term_pairs(texts)
    row, term = pairs >> BITS, pairs & ((1 << BITS) - 1)
    inside = _is_kept(term, kept)
    use = inside | (np.bincount(row, inside, len(texts)) == 0)[row]
    row, term = row[use], term[use].astype(np.uint64)
    value = (mix(term + np.uint64(1 << 60)) >> np.uint64(32)).astype(np.float64) + 1
    out = np.zeros((len(texts), GROUPS, LEVELS), np.uint8)
    per_hash = 64 // LEVELS
    for g in range(GROUPS):
        if g % per_hash == 0:
            drawn = mix(term + np.uint64((g + 1) << 32))
        level = _ones()[((drawn >> np.uint64(g % per_hash * LEVELS)) & np.uint64((1 << LEVELS) - 1)).astype(np.int64)]
        on = level > 0
        # Sums of 32-bit hashes of distinct terms are exact in a double; they do not depend on the order of terms.
        sums = np.bincount(row[on] * LEVELS + level[on] - 1, value[on], len(texts) * LEVELS).reshape(len(texts), LEVELS)
        sums = sums[:, ::-1].cumsum(axis=1)[:, ::-1]
        hashed = mix(sums.astype(np.uint64) + np.uint64(g << 56)) % np.uint64(255) + np.uint64(1)
        out[:, g] = np.where(sums > 0, hashed, 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of fingerprints; 1 exactly if they are equal."""
    live = (a > 0) | (b > 0)
    rank = live[:, :, ::-1].cumsum(axis=2)[:, :, ::-1]  # 1 for the sparsest subset in use
    weight = np.where(live, 0.5**rank, 0)
    total = weight.sum(axis=(1, 2))
    alike = np.divide((weight * (a == b)).sum(axis=(1, 2)), total, out=np.zeros(len(a)), where=total > 0)
    return np.where((a == b).all(axis=(1, 2)), 1.0, np.minimum(alike, 1 - 1e-9))


def as_hex(prints: np.ndarray) -> list[str]:
    flat = prints.reshape(len(prints), -1)
    return [row.tobytes().hex() for row in flat]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edit(texts: list[str], following: list[str]) -> list[str]:
    return [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following)]


def compare_with_next(documents: DataFrame, text: str = "text") -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document by id.

    Documents are dealt by ranges of ids into slots of about ``SLOT_CHARS`` characters; only the first document of a slot is sent twice, to
    serve as the last one's successor in the slot before. The texts are shuffled once, sorted by Spark, and streamed through a task.
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce(text, F.lit("")).alias("text"))
    session = small_batches(docs.sparkSession)
    frequencies = checkpointed(document_frequencies(docs))
    kept = session.sparkContext.broadcast(band(frequencies))
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))

    chars = frequencies.where("term = -2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = int(session.conf.get("spark.sql.shuffle.partitions"))
    slots = min(MOST_SLOTS, max(4 * tasks, chars // SLOT_CHARS))  # several a task, so that tasks get alike
    cuts = docs.agg(F.percentile_approx(order, [k / slots for k in range(1, slots)] or [0.5], F.lit(10 * slots)).alias("cuts")).first()["cuts"]
    cuts = np.unique(np.array(cuts if cuts and slots > 1 else [], np.int64))

    @F.pandas_udf("int")
    def slot_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64)), dtype="int32")

    firsts = sorted((r["slot"], r["first"]) for r in docs.groupBy(slot_of(order).alias("slot")).agg(F.min(order).alias("first")).collect())
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}  # the slot before it; the last one for the first

    @F.pandas_udf("array<int>")
    def slots_of(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, ids.to_numpy(np.int64))
        # A copy for the slot before is written as -1 - slot.
        return pd.Series([[int(s), -1 - before[i]] if i in before else [int(s)] for i, s in zip(ids, own)], dtype=object)

    dealt = docs.withColumn("_at", F.explode(slots_of(order))).select(F.when(F.col("_at") < 0, -1 - F.col("_at")).otherwise(F.col("_at")).alias("slot"), (F.col("_at") < 0).alias("copy"), "doc_id", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows in order, of which the last has yet to meet its successor
        size = 0

        def flush() -> pa.RecordBatch:
            here, own = [r[3] for r in held], [k for k in range(len(held) - 1) if not held[k][1]]
            edited = _edit([here[k] for k in own], [here[k + 1] for k in own])
            plain, other = fingerprints(here, kept.value), fingerprints(edited, kept.value)
            mine, after = plain[own], plain[[k + 1 for k in own]]
            columns = [[held[k][2] for k in own], [len(here[k]) for k in own], [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], as_hex(mine), as_hex(other), likeness(mine, other).tolist(), likeness(mine, after).tolist()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[3])
                if size > HELD_CHARS:
                    yield flush()
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield flush()

    return dealt.repartition(max(tasks, slots // 4), "slot").sortWithinPartitions("slot", "copy", order, "text").mapInArrow(compare, _SCHEMA)


_NAMES = [part.split()[0] for part in _SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
