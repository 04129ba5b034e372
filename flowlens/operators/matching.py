"""Nearest-in-time joins between events and labels at the same pair of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, JITTER = 60_000_000, 30_000_000


def match_confidence(distance, reach: int):
    """1 - distance / reach, not below 0; with no reach 1 at distance 0 and else 0."""
    if reach <= 0:
        return F.when(distance == 0, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), 1 - distance / reach)


def _near(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """Pairs at the same addresses at most ``reach`` apart, as an equi-join.

    Time is cut into buckets of ``reach``: a right row goes to its own bucket and its two neighbours, so each left row meets its candidates
    in its own bucket alone. The join key spreads a busy pair of addresses over its buckets, and no pair of rows is made beyond them.
    """
    bucket = lambda c: F.floor(F.col(c) / max(1, reach))
    spread = right.withColumn("_bucket", F.explode(F.array(*[bucket("right_us") + i for i in (-1, 0, 1)])))
    joined = left.withColumn("_bucket", bucket("us")).join(spread, ["src_ip", "dst_ip", "_bucket"])
    return joined.withColumn("distance", F.abs(F.col("us") - F.col("right_us"))).where(F.col("distance") <= reach).drop("_bucket")


def align_labels(events: DataFrame, labels: DataFrame, window: int = WINDOW, jitter: int = JITTER) -> DataFrame:
    """Every event with its nearest label: event_id, label, label_id, distance_us, match_confidence.

    Ties go to the earlier label, then to the smaller id; a label may serve several events; an event without one is labelled false. The
    nearest label is chosen by aggregation, so candidates are never sorted.
    """
    reach = window + jitter
    right = labels.select("src_ip", "dst_ip", F.col("us").alias("right_us"), "label_id", F.col("label").alias("_label"))
    best = _near(events.select("event_id", "us", "src_ip", "dst_ip"), right, reach).groupBy("event_id").agg(F.min(F.struct("distance", "right_us", "label_id", "_label")).alias("b"))
    joined = events.select("event_id", "us", "src_ip", "dst_ip").join(best, "event_id", "left")
    distance = F.col("b.distance")
    confidence = F.when(distance.isNull(), 0.0).otherwise(match_confidence(distance, reach))
    return joined.select("event_id", F.coalesce("b._label", F.lit(False)).alias("label"), F.col("b.label_id").alias("label_id"), distance.alias("distance_us"), confidence.alias("match_confidence"))


def match_events(labels: DataFrame, events: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every label that has an event within ``window``, with the nearest: label_id, event_id, distance_us. Ties go to the earlier event."""
    right = events.select("src_ip", "dst_ip", F.col("us").alias("right_us"), "event_id")
    best = _near(labels.select("label_id", "us", "src_ip", "dst_ip"), right, window).groupBy("label_id").agg(F.min(F.struct("distance", "right_us", "event_id")).alias("b"))
    return best.select("label_id", F.col("b.event_id").alias("event_id"), F.col("b.distance").alias("distance_us"))


def alignment_summary(aligned: DataFrame) -> DataFrame:
    """One row: events, matched, unmatched, match rate, mean distance and confidence of the matched."""
    matched = F.count("label_id")
    guarded = F.greatest(matched, F.lit(1))
    return aligned.agg(F.count("*").alias("total"), matched.alias("matched"), (F.count("*") - matched).alias("unmatched"), (matched / F.greatest(F.count("*"), F.lit(1))).alias("match_rate"), (F.coalesce(F.sum("distance_us"), F.lit(0)) / guarded).alias("avg_distance_us"), (F.sum("match_confidence") / guarded).alias("avg_confidence"))


def dedup_labels(labels: DataFrame) -> DataFrame:
    """The first label of each (src, dst, second), seconds rounded half to even; first by time, then by id."""
    keyed = labels.withColumn("_second", F.bround(F.col("us") / 1_000_000))
    first = keyed.groupBy("src_ip", "dst_ip", "_second").agg(F.min(F.struct("us", "label_id")).alias("f"))
    return first.select("src_ip", "dst_ip", F.col("f.label_id").alias("label_id"), F.col("f.us").alias("us"))


def in_range(rows: DataFrame, start_us: int, end_us: int, closed: bool = False) -> DataFrame:
    """Rows of [start, end), or of [start, end] if ``closed``."""
    us = F.col("us")
    return rows.where((us >= start_us) & ((us <= end_us) if closed else (us < end_us)))


def in_list(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` stands in a look-up list, however often it stands there."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def nearby_consensus(fused: DataFrame, agreed: DataFrame, within: int = WINDOW) -> DataFrame:
    """Each (us, src_ip) with the first consensus of its source, by (us, event_id), less than ``within`` away: label, confidence, null without.

    An equi-join on source and time bucket, as ``_near``; agreed: event_id, us, src_ip, label, confidence.
    """
    bucket = lambda c: F.floor(F.col(c) / within)
    spread = agreed.select("src_ip", F.col("us").alias("_at"), "event_id", "label", "confidence").withColumn("_bucket", F.explode(F.array(*[bucket("_at") + i for i in (-1, 0, 1)])))
    met = fused.select("us", "src_ip").withColumn("_bucket", bucket("us")).join(spread, ["src_ip", "_bucket"]).where(F.abs(F.col("us") - F.col("_at")) < within)
    first = met.groupBy("us", "src_ip").agg(F.min(F.struct("_at", "event_id", "label", "confidence")).alias("c"))
    return fused.join(first, ["us", "src_ip"], "left").withColumn("label", F.col("c.label")).withColumn("confidence", F.col("c.confidence")).drop("c")
