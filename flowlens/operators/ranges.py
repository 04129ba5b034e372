"""Look-ups of numbers, addresses among them, in tables of ranges, as equi-joins.

A range is cut into aligned blocks, whose lengths are powers of two: at most two of each length, so at most 2 x 63 however wide it is. A number
lies in exactly one block of each length, so it meets a range by (length, block), and only lengths that occur are asked for. Numbers are looked
up once however often they occur, and of the ranges that share a block only the first choice is kept, so a number meets at most one range a length.
Lengths with few blocks, which many numbers may share, are broadcast; the others are joined by shuffle. Rows without a number are dealt out evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An IPv4 address in dots. Pseudonyms (hex digits) are none and so are in no range.
_DOTTED = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"


def address_number(address: str | Column) -> Column:
    """An IPv4 address as a number; null for anything else, pseudonyms among it, and for parts beyond 255."""
    column = F.col(address) if isinstance(address, str) else address
    parts = [F.regexp_extract(column, _DOTTED, k).try_cast("long") for k in range(1, 5)]
    number = sum((part * (1 << 8 * (3 - k)) for k, part in enumerate(parts)), F.lit(0))
    return F.when(F.greatest(*parts) <= 255, number)


def is_pseudonym(address: str | Column) -> Column:
    """Whether an address is a hash: marked as one, longer than any address, or 32 hex digits or more."""
    column = F.col(address) if isinstance(address, str) else address
    return column.startswith("hash:") | (F.length(column) > 39) | column.rlike("^[0-9a-fA-F]{32,}$")


def block_column(first: str | Column, last: str | Column, bits: int = 62) -> Column:
    """array<struct<bits, block>>: the aligned blocks that make up [first, last]; block ``b`` of ``bits`` holds [b << bits, b + 1 << bits)."""
    low, high = (F.col(c) if isinstance(c, str) else c for c in (first, last))
    start = F.struct(low.cast("long").alias("low"), (high.cast("long") + 1).alias("high"), F.array().cast("array<struct<bits:int,block:long>>").alias("blocks"))

    def step(state: Column, k: Column) -> Column:
        k = k.cast("int")
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        odd = lambda v: F.call_function("shiftright", v, k) % 2 != 0
        from_low = odd(state["low"]) & (state["low"] < state["high"])
        low = F.when(from_low, state["low"] + size).otherwise(state["low"])
        from_high = odd(state["high"]) & (low < state["high"])
        high = F.when(from_high, state["high"] - size).otherwise(state["high"])
        block = lambda v: F.array(F.struct(k.alias("bits"), F.call_function("shiftright", v, k).alias("block")))
        none = F.array().cast("array<struct<bits:int,block:long>>")
        made = F.concat(state["blocks"], F.when(from_low, block(state["low"])).otherwise(none), F.when(from_high, block(high)).otherwise(none))
        return F.struct(low.alias("low"), high.alias("high"), made.alias("blocks"))

    # No block is longer than the range, so the lengths end with the highest bit of its size.
    longest = F.least(F.length(F.bin(high.cast("long") - low.cast("long") + 1)) - 1, F.lit(bits))
    return F.when(low <= high, F.aggregate(F.sequence(F.lit(0), longest), start, step, lambda state: state["blocks"]))


#: Blocks of a length up to which they are broadcast, with those of other such lengths at most 63 times as many.
FEW_BLOCKS = 2_000


def locate(numbers: DataFrame, ranges: DataFrame, number: str = "number") -> DataFrame:
    """(number, first, last, and what else ``ranges`` has) of each distinct number that lies in a range: the narrowest, then the first of them.

    numbers: a column of integers that are not negative; ranges: first, last, both included. Nulls and ranges that end before they begin
    match nothing.
    """
    kept = ranges.where("first <= last AND first >= 0")
    payload = F.struct((F.col("last") - F.col("first")).alias("_width"), *kept.columns)
    blocks = kept.select(F.explode(block_column("first", "last")).alias("b"), payload.alias("_range")).select(F.col("b.bits").alias("_bits"), F.col("b.block").alias("_block"), "_range")
    lengths = {r["_bits"]: r["count"] for r in blocks.groupBy("_bits").count().collect()}  # at most 63
    asked = numbers.select(F.col(number).cast("long").alias("number")).where("number >= 0").distinct()

    def meet(of: list[int], how: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(k).alias("_bits"), F.shiftright("number", k).alias("_block")) for k in sorted(of)]) if of else F.array().cast("array<struct<_bits:int,_block:long>>")
        # Dealt out first, so that what a task sorts has the size of its part, not of the file that it reads.
        first = blocks.where(F.col("_bits").isin(of)).repartition("_bits", "_block").groupBy("_bits", "_block").agg(F.min("_range").alias("_range"))
        return asked.select("number", F.explode(keys).alias("k")).select("number", "k.*").join(first.hint(how), ["_bits", "_block"])

    few, many = [k for k, n in lengths.items() if n <= FEW_BLOCKS], [k for k, n in lengths.items() if n > FEW_BLOCKS]
    parts = [meet(of, how) for of, how in ((few, "broadcast"), (many, "merge")) if of] or [meet([], "broadcast")]
    met = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return met.groupBy("number").agg(F.min("_range").alias("r")).select("number", *[F.col(f"r.{c}").alias(c) for c in kept.columns])


def with_range(rows: DataFrame, ranges: DataFrame, number: str = "number") -> DataFrame:
    """All ``rows``, with the columns of ``ranges`` for the range their number lies in, null where there is none.

    Rows without a number match nothing; they get keys below 0, one by one, for a null key would send all of them to one task.
    """
    own = [c for c in rows.columns if c != number]
    key = F.coalesce(F.when(F.col(number) >= 0, F.col(number)).cast("long"), -1 - F.pmod(F.xxhash64(F.lit(0), *own), F.lit(2**40)))
    found = locate(rows, ranges, number).withColumnRenamed("number", "_number")
    return rows.withColumn("_key", key).join(found, F.col("_key") == F.col("_number"), "left").drop("_key", "_number")
