"""Features of flows: per host, per event and per window, and their scaling."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.scalars import day_of_week, hour_of_day, is_common_port, is_nxdomain, share_sent

WINDOW = 300_000_000
HOST_COLUMNS = ("unique_destinations", "unique_ports", "dns_queries_count", "nxdomain_ratio", "avg_dns_query_length")
#: The columns of the event vector in order, first the numeric ones, then the flags.
NUMERIC_COLUMNS = (
    "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "bytes_total", "bytes_ratio", "dst_port", "hour_of_day", "day_of_week", "unique_destinations", "unique_ports", "dns_queries_count", "nxdomain_ratio",
    "avg_dns_query_length",
)
FLAG_COLUMNS = ("is_common_port", "is_weekend")
EVENT_COLUMNS = NUMERIC_COLUMNS + FLAG_COLUMNS


def host_aggregates(conn: DataFrame, dns: DataFrame) -> DataFrame:
    """Per host that occurs in flows or look-ups: distinct destinations and ports, look-ups, share of failed ones, mean query length."""
    flows = conn.groupBy("src_ip").agg(F.countDistinct("dst_ip").alias("unique_destinations"), F.countDistinct("dst_port").alias("unique_ports"))
    queries = dns.groupBy("src_ip").agg(F.count("*").alias("dns_queries_count"), F.avg(is_nxdomain("rcode").cast("int")).alias("nxdomain_ratio"), F.avg(F.length("query")).alias("avg_dns_query_length"))
    joined = flows.join(queries, "src_ip", "full_outer")
    return joined.select("src_ip", *[F.coalesce(c, F.lit(0)).alias(c) for c in HOST_COLUMNS])


def event_features(conn: DataFrame, dns: DataFrame) -> DataFrame:
    """One row per flow. The host side is a row per source, which Spark broadcasts while it is small and joins by shuffle once it is not."""
    total = F.col("orig_bytes") + F.col("resp_bytes")
    rows = conn.join(host_aggregates(conn, dns), "src_ip", "left").withColumn("bytes_total", total).withColumn("bytes_ratio", share_sent("orig_bytes", F.col("bytes_total")))
    rows = rows.withColumn("is_common_port", is_common_port("dst_port")).withColumn("hour_of_day", hour_of_day("us")).withColumn("day_of_week", day_of_week("us")).withColumn("is_weekend", F.col("day_of_week") >= 5)
    return rows.select("uid", "us", "src_ip", "dst_ip", *[F.coalesce(c, F.lit(0)).alias(c) if c in HOST_COLUMNS else F.col(c) for c in EVENT_COLUMNS])


def as_vector(rows: DataFrame, columns: tuple[str, ...] = EVENT_COLUMNS) -> DataFrame:
    """Adds ``vector``: the columns in order as doubles."""
    return rows.withColumn("vector", F.array(*[F.col(c).cast("double") for c in columns]))


def anchored(rows: DataFrame, origin: DataFrame, width: int = WINDOW) -> DataFrame:
    """Adds ``window_us``: the window of ``width`` that holds a row, counted from the one-row ``origin``; rows before it get earlier windows."""
    return rows.crossJoin(F.broadcast(origin)).withColumn("window_us", F.col("us") - F.pmod(F.col("us") - F.col("origin_us"), F.lit(width))).drop("origin_us")


def window_features(conn: DataFrame, dns: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per source and window, windows counted from the first flow. Windows with look-ups alone are left out."""
    origin = conn.agg(F.min("us").alias("origin_us"))
    flows = anchored(conn, origin, width).groupBy("src_ip", "window_us").agg(
        F.sum("orig_bytes").alias("bytes_out"), F.sum("resp_bytes").alias("bytes_in"), F.sum(F.col("orig_pkts") + F.col("resp_pkts")).alias("pkts_total"), F.countDistinct("dst_ip").alias("unique_destinations"),
        F.countDistinct("dst_port").alias("unique_ports"), F.avg("duration").alias("avg_duration"), F.count("*").alias("connection_count"),
    )
    queries = anchored(dns, origin, width).groupBy("src_ip", "window_us").agg(F.count("*").alias("dns_queries"), F.avg(is_nxdomain("rcode").cast("int")).alias("nxdomain_ratio"))
    joined = flows.join(queries, ["src_ip", "window_us"], "left")
    return joined.withColumn("dns_queries", F.coalesce("dns_queries", F.lit(0))).withColumn("nxdomain_ratio", F.coalesce("nxdomain_ratio", F.lit(0.0)))


def fit_scaler(rows: DataFrame, columns: tuple[str, ...]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; a deviation of 0 counts as 1."""
    got = rows.agg(*[x for c in columns for x in (F.avg(F.col(c).cast("double")).alias(f"m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}"))]).first()
    return {c: (got[f"m_{c}"] or 0.0, got[f"s_{c}"] or 1.0) for c in columns}


def scale(rows: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({c: (F.col(c).cast("double") - m) / s for c, (m, s) in scaler.items()})


def scaler_artifact(scaler: dict[str, tuple[float, float]]) -> str:
    """A scaler as JSON, in the order of its columns."""
    return json.dumps({"columns": list(scaler), "mean": [m for m, _ in scaler.values()], "sd": [s for _, s in scaler.values()]})


def scaler_from_artifact(text: str) -> dict[str, tuple[float, float]]:
    fields = json.loads(text)
    return {c: (m, s) for c, m, s in zip(fields["columns"], fields["mean"], fields["sd"], strict=True)}


def model_columns(rows: DataFrame, names: list[str], suffix: str = "_norm") -> list[str]:
    """The normalized column of each name where there is one, else the raw one."""
    return [f"{n}{suffix}" if f"{n}{suffix}" in rows.columns else n for n in names]
