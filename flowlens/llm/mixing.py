"""Mixing sources to target weights by capped water-filling.

Sources share the total size by weight; a source stops at ``max_epochs`` times its size and what it leaves over is shared by weight among
the others. The level at which that settles has a closed form over the sources in order of cap per weight, so no iteration is needed.
Documents are then repeated: the whole part of target / size as whole repetitions, and the rest as one more repetition of a seeded part
of the source's documents, the last of them in part, so that a source meets its target to within a few words.

Defined cases: null or empty texts have size 0 and are taken 0 times; a null source is a source of its own, last in order; a source of
size 0 has target 0; an empty table gives no rows. Results depend on (seed, doc_id, size) alone, so reruns agree; rows that share an id
and size are treated alike. Other columns are kept as they are; names that begin with an underscore are the operator's own.
"""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import checkpointed

MAX_EPOCHS = 3
WEIGHTS = (5, 2, 1)
BINS = 4096
#: Sources up to this number are broadcast; beyond it they are joined by shuffle.
BROADCAST_SOURCES = 50_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_count(text: str | Column) -> Column:
    r"""Number of runs of ``[^\x20\x09-\x0D]``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """Adds ``weight``: the weights in turn over the sources in code point order, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long"))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight) -> the same with ``target``. One row per source."""
    by_ratio = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        sources.withColumn("_cap", F.col("source_size") * max_epochs)
        .withColumn("_level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("_free", F.col("_level") * F.col("weight") <= F.col("_cap"))
        .withColumn("_settled", F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("weight"), F.col("_level")))).over(everything)["_level"])
    )
    share = F.col("_settled") * F.col("weight")
    return filled.withColumn("target", F.when(F.col("_settled").isNull() | (share > F.col("_cap")), F.col("_cap").cast("double")).otherwise(share)).drop("_cap", "_level", "_free", "_settled")


def with_size(documents: DataFrame, text: str = "text", seed: int = 17) -> DataFrame:
    """Adds ``size`` and ``_bin``, the place of the document in the seeded order of its source."""
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")), F.lit(BINS)).cast("int")
    return documents.withColumn("size", word_count(text)).withColumn("_bin", place)


def mixing_plan(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple = WEIGHTS) -> DataFrame:
    """From (source, size, _bin): a row per source with its target, its whole repetitions and where its last, partial repetition ends.

    Sizes are summed by (source, bin of a seeded hash) before any shuffle, so a source with a third of all rows costs no more than another.
    """
    bins = checkpointed(sizes.groupBy("source", "_bin").agg(F.sum("size").alias("bin_size")))
    sources = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = water_fill(cyclic_weights(sources, weights), max_epochs).withColumn("_whole", whole).withColumnRenamed("source", "_source")
    extra = F.col("target") - F.col("_whole") * F.col("source_size")
    run = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    left = extra - F.coalesce(F.sum("bin_size").over(run), F.lit(0))
    cut = bins.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_left", left).where((F.col("_left") > 0) & (F.col("_left") <= F.col("bin_size")))
    cut = cut.select(F.col("source").alias("_cut_source"), F.col("_bin").alias("_cut_bin"), (F.col("_left") / F.col("bin_size")).alias("_cut_share"))
    return checkpointed(targets.join(cut, F.col("_source").eqNullSafe(F.col("_cut_source")), "left").drop("_cut_source", "weight"))


def with_taken(sized: DataFrame, plan: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``taken`` to rows that have source, size and _bin."""
    hint = F.broadcast if plan.count() <= BROADCAST_SOURCES else (lambda df: df)
    part = (
        F.when(F.col("_cut_bin").isNull() | (F.col("_bin") > F.col("_cut_bin")), F.lit(0))
        .when(F.col("_bin") < F.col("_cut_bin"), F.col("size"))
        .otherwise(F.floor(F.col("size") * F.col("_cut_share") + F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)))
    )
    taken = F.least(F.col("_whole") * F.col("size") + F.least(part, F.col("size")), F.col("size") * max_epochs).cast("long")
    return sized.join(hint(plan), F.col("source").eqNullSafe(F.col("_source"))).withColumn("taken", taken).drop("_source", "_whole", "_cut_bin", "_cut_share", "_bin")


def mix(documents: DataFrame, text: str = "text", max_epochs: int = MAX_EPOCHS, weights: tuple = WEIGHTS, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every document. The text is read once; sizes are checkpointed."""
    sizes = checkpointed(with_size(documents.select("doc_id", "source", F.col(text).alias("text")), "text", seed).drop("text"))
    return with_taken(sizes, mixing_plan(sizes, max_epochs, weights), max_epochs, seed)


def repeat_column(text: str | Column, size: str | Column, taken: str | Column) -> Column:
    """The texts that a document gives to the mix: whole repetitions, then its first words up to what is left of ``taken``."""

    @F.pandas_udf("array<string>")
    def repeat(texts: pd.Series, sizes: pd.Series, takes: pd.Series) -> pd.Series:
        out = []
        for text, size, take in zip(texts, sizes, takes):
            whole, rest = divmod(int(take), int(size)) if size else (0, 0)
            copies = [text] * whole
            if rest:
                last = next(itertools.islice(_WORD.finditer(text), rest - 1, None))
                copies.append(text[: last.end()])
            out.append(copies)
        return pd.Series(out, dtype=object)

    return repeat(text, size, taken)
