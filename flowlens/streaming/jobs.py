"""The operators on streams. Event time is a timestamp column ``ts``; windows are aligned to the epoch; state is keyed, never shared."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlens.operators.rollups import latest_by_key
from flowlens.operators.severity import validate


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = 1) -> DataFrame:
    """The driver's events as a stream of files: event_id, ts, us, user_id, event_type, value, k.

    With None all files that are there make one micro-batch, so that none of a stored table comes late, in whatever order its files are.
    """
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return rows.select("event_id", F.timestamp_micros(us).alias("ts"), us.alias("us"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def rollup(stream: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Incremental rollup: counts and sums per window and source, distinct targets by sketch (within about 2 %).

    Exact distinct counts cannot be kept up in a stream with bounded state; sums of partial ones would count twice.
    """
    return (
        stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "user_id")
        .agg(F.count("*").alias("connections"), F.sum("value").alias("bytes_total"), F.hll_sketch_estimate(F.hll_sketch_agg("k")).alias("unique_targets"))
        .select(F.col("w.start").alias("start"), "user_id", "connections", "bytes_total", "unique_targets")
    )


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions by inactivity, from the built-in session window."""
    grouped = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("alerts"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "alerts")


def sliding(stream: DataFrame, window: int, least: int = 2, delay: str = "1 hour", idle: int | None = None) -> DataFrame:
    """Per event the size of its source's closed window [us - window, us] if at least ``least``: keyed state of counts by distinct time.

    An event is counted with all of its own and earlier batches, however many a source has; times go once the watermark passes them by the
    window, a source's state once it passes its last event by the window.
    """
    hold = (idle or window) // 1000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, held_counts = (np.array(x, np.int64) for x in (state.get if state.exists else ([], [])))
        rows = pd.concat(list(parts)).sort_values(["us", "event_id"])
        us = rows["us"].to_numpy(np.int64)
        # Ties in time belong to each other's windows, as in a frame by range.
        times, place = np.unique(np.concatenate([held, us]), return_inverse=True)
        counts = np.zeros(len(times), np.int64)
        np.add.at(counts, place, np.concatenate([held_counts, np.ones(len(us), np.int64)]))
        upto = np.concatenate([[0], np.cumsum(counts)])
        size = upto[np.searchsorted(times, us, "right")] - upto[np.searchsorted(times, us - window, "left")]
        live = times >= state.getCurrentWatermarkMs() * 1000 - window
        state.update((times[live].tolist(), counts[live].tolist()))
        state.setTimeoutTimestamp(int(times[-1]) // 1000 + hold)
        enough = size >= least
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy()[enough], "user_id": key[0], "size": size[enough]})

    keyed = stream.withWatermark("ts", delay).groupBy("user_id")
    return keyed.applyInPandasWithState(step, "event_id long, user_id long, size long", "times array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def deduplicated(stream: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def with_scores(votes: DataFrame, scores: DataFrame, delay: str = "10 minutes", reach: str = "10 minutes") -> DataFrame:
    """Votes joined to the scores of their event within ``reach``; watermarks bound the state of both sides."""
    v, s = votes.withWatermark("ts", delay).alias("v"), scores.withWatermark("ts", delay).alias("s")
    return v.join(s, F.expr(f"v.event_id = s.event_id AND s.ts BETWEEN v.ts - INTERVAL {reach} AND v.ts + INTERVAL {reach}")).select("v.event_id", "v.label", "s.score")


def split_sink(checks: dict, accept: Callable[[DataFrame], None], reject: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: valid rows to one sink, the others with their failed checks to the dead letters."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        good, bad = validate(batch, checks)
        accept(good)
        reject(bad)
        batch.unpersist()

    return write


def drain(stream: DataFrame, folder: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there, into Parquet under ``folder``, and reads it back; with keys the newest version of each."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/data/batch-{number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{folder}/data/*")
    if mode == "complete":
        return rows.where(F.col("_batch") == rows.agg(F.max("_batch")).first()[0]).drop("_batch")
    if keys:
        return latest_by_key(rows, keys, ["_batch"]).drop("_batch")
    return rows.drop("_batch")
