"""Rollups, panels and top-k over flows and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def truncated(us: str | Column, width: int) -> Column:
    """The start of the epoch-aligned interval of ``width`` microseconds."""
    us = F.col(us) if isinstance(us, str) else us
    return us - F.pmod(us, F.lit(width))


def hourly(flows: DataFrame, key: str, width: int = HOUR) -> DataFrame:
    """Per interval and ``key``: connections, bytes, packets and exact distinct peers and ports.

    Distinct counts are recomputed from flows: sums of earlier distinct counts would count peers twice.
    """
    peer = "dst_ip" if key == "src_ip" else "src_ip"
    rows = flows.groupBy(truncated("us", width).alias("bucket_us"), key).agg(
        F.count("*").alias("connections"), F.sum(F.col("orig_bytes") + F.col("resp_bytes")).alias("bytes_total"), F.sum(F.col("orig_pkts") + F.col("resp_pkts")).alias("pkts_total"),
        F.countDistinct(peer).alias("unique_peers"), F.countDistinct("dst_port").alias("unique_ports"),
    )
    return rows


def historical(flows: DataFrame) -> DataFrame:
    """Per destination: first seen, p99 and sum of bytes sent, deviation of the sum from p99."""
    rows = flows.groupBy("dst_ip").agg(F.min("us").alias("first_seen_us"), F.percentile("orig_bytes", 0.99).alias("bytes_p99"), F.sum("orig_bytes").alias("bytes_sum"))
    return rows.withColumn("deviation", F.when(F.col("bytes_p99") > 0, F.col("bytes_sum") / F.col("bytes_p99")).otherwise(0.0))


def historical_of_source(flows: DataFrame) -> DataFrame:
    """Per source the history of the destination that it sent most to: dst_ip, first seen, p99 and sum of bytes sent, deviation of the sum from p99.

    Ties go to the smaller address. A row per pair meets in the second aggregation.
    """
    pairs = flows.groupBy("src_ip", "dst_ip").agg(F.min("us").alias("first_seen_us"), F.percentile("orig_bytes", 0.99).alias("bytes_p99"), F.sum("orig_bytes").alias("bytes_sum"))
    top = pairs.groupBy("src_ip").agg(F.min(F.struct(-F.col("bytes_sum"), "dst_ip", "first_seen_us", "bytes_p99", "bytes_sum")).alias("t"))
    rows = top.select("src_ip", "t.dst_ip", "t.first_seen_us", "t.bytes_p99", "t.bytes_sum")
    return rows.withColumn("deviation", F.when(F.col("bytes_p99") > 0, F.col("bytes_sum") / F.col("bytes_p99")).otherwise(0.0))


def top_peer(flows: DataFrame) -> DataFrame:
    """Per source the destination that it sent most to; ties go to the smaller address. Sums first, so the window sees a row per pair."""
    sums = flows.groupBy("src_ip", "dst_ip").agg(F.sum("orig_bytes").alias("bytes_sum"))
    return sums.groupBy("src_ip").agg(F.max_by(F.struct("dst_ip", "bytes_sum"), F.struct("bytes_sum", -F.col("dst_ip"))).alias("t")).select("src_ip", "t.dst_ip", "t.bytes_sum")


METRICS = {"count": lambda c: F.count("*"), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "cardinality": F.countDistinct}


def panel(rows: DataFrame, metric: str, field: str | None = None, by: tuple[str, ...] = (), interval: int | None = None, size: int | None = None, where: str | None = None) -> DataFrame:
    """A dashboard panel: ``metric`` of ``field`` by terms and, if asked for, by time; with ``size`` the terms with most rows.

    where: a condition that restricts the metric, not the groups.
    """
    keys = [F.col(c) for c in by]
    if interval:
        keys = [truncated("us", interval).alias("bucket_us"), *keys]
    value = F.when(F.expr(where), F.col(field) if field else F.lit(1)) if where else (F.col(field) if field else F.lit(1))
    made = F.count(value) if metric == "count" else METRICS[metric](value)
    out = rows.groupBy(*keys).agg(made.alias("metric"), F.count("*").alias("doc_count"))
    return out.orderBy(F.desc("doc_count"), *by).limit(size) if size else out


def nested_terms(rows: DataFrame, field: str, size: int | None = None) -> DataFrame:
    """(term, doc_count) over the values of an array: a row counts once for each of its distinct values; the most frequent first."""
    out = rows.select(F.explode(F.array_distinct(F.col(field))).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("doc_count"))
    return out.orderBy(F.desc("doc_count"), "term").limit(size) if size else out


def histogram(rows: DataFrame, field: str, step: float = 0.05) -> DataFrame:
    """Rows by interval of ``step``, numbered from 0."""
    return rows.groupBy(F.floor(F.col(field) / step).alias("bin")).agg(F.count("*").alias("n"))


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by one aggregation, so that a busy key is combined before the shuffle."""
    newest = rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_newest"))
    return newest.select("_newest.*")


def latest(rows: DataFrame, n: int, by: str = "us", tie: str = "alert_id") -> DataFrame:
    return rows.orderBy(F.desc(by), F.desc(tie)).limit(n)


def retained(rows: DataFrame, days: int, now_us: int) -> DataFrame:
    """Rows younger than the retention."""
    return rows.where(F.col("us") > now_us - days * 24 * HOUR)


def edges(flows: DataFrame) -> DataFrame:
    """Directed pairs with flows and bytes; no loops."""
    return flows.where("src_ip <> dst_ip").groupBy("src_ip", "dst_ip").agg(F.count("*").alias("connections"), F.sum(F.col("orig_bytes") + F.col("resp_bytes")).alias("bytes_total"), F.max("conn_state").alias("conn_state"))


def device_edges(pairs: DataFrame, devices: DataFrame) -> DataFrame:
    """Edges between known devices: both ends are looked up, unknown ends and loops go."""
    a, b = devices.select(F.col("ip").alias("src_ip"), F.col("device").alias("from_device")), devices.select(F.col("ip").alias("dst_ip"), F.col("device").alias("to_device"))
    joined = pairs.join(a, "src_ip").join(b, "dst_ip").where("from_device <> to_device")
    return joined.groupBy("from_device", "to_device").agg(F.sum("connections").alias("connections"), F.sum("bytes_total").alias("bytes_total"))


def devices(flows: DataFrame) -> DataFrame:
    """Every address that occurs at either end, with how often."""
    ends = flows.select(F.col("src_ip").alias("ip"), F.lit(1).alias("as_src"), F.lit(0).alias("as_dst")).unionByName(flows.select(F.col("dst_ip").cast("long").alias("ip"), F.lit(0).alias("as_src"), F.lit(1).alias("as_dst")))
    return ends.groupBy("ip").agg(F.sum("as_src").alias("as_src"), F.sum("as_dst").alias("as_dst"))
