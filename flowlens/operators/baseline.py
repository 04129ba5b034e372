"""Statistical baselines per host and service, and events against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("orig_bytes", "resp_bytes", "duration", "pkts")
CONSTANTS = ("unique_destinations", "unique_ports", "dns_queries")
STATS = ("mean", "std", "min_val", "max_val", "p50", "p95", "p99")


def known_service():
    return F.when(F.coalesce(F.col("service"), F.lit("")) == "", "unknown").otherwise(F.col("service"))


def baselines(conn: DataFrame, dns: DataFrame) -> DataFrame:
    """(src_ip, service, metric, mean, std, min_val, max_val, p50, p95, p99, sample_count); no service counts as "unknown".

    Four metrics vary by flow; three are constants of the group, for which deviation is 0 and all percentiles are equal. One shuffle by
    (src_ip, service) serves them all.
    """
    rows = conn.select("src_ip", known_service().alias("service"), "dst_ip", "dst_port", *[F.col(m).cast("double").alias(m) for m in METRICS[:3]], (F.col("orig_pkts") + F.col("resp_pkts")).cast("double").alias("pkts"))
    stats = [F.struct(F.lit(m).alias("metric"), F.avg(m).alias("mean"), F.stddev_pop(m).alias("std"), F.min(m).alias("min_val"), F.max(m).alias("max_val"), F.percentile(m, [0.5, 0.95, 0.99]).alias("p")).alias(f"s_{m}") for m in METRICS]
    grouped = rows.groupBy("src_ip", "service").agg(*stats, F.count("*").alias("sample_count"), F.countDistinct("dst_ip").alias("unique_destinations"), F.countDistinct("dst_port").alias("unique_ports"))
    grouped = grouped.join(dns.groupBy("src_ip").agg(F.count("*").alias("dns_queries")), "src_ip", "left").withColumn("dns_queries", F.coalesce("dns_queries", F.lit(0)))

    def constant(name: str):
        v = F.col(name).cast("double")
        return F.struct(F.lit(name).alias("metric"), v.alias("mean"), F.lit(0.0).alias("std"), v.alias("min_val"), v.alias("max_val"), F.array(v, v, v).alias("p"))

    one = grouped.select("src_ip", "service", "sample_count", F.explode(F.array(*[F.col(f"s_{m}") for m in METRICS], *[constant(c) for c in CONSTANTS])).alias("s"))
    return one.select("src_ip", "service", "s.metric", "s.mean", "s.std", "s.min_val", "s.max_val", F.col("s.p")[0].alias("p50"), F.col("s.p")[1].alias("p95"), F.col("s.p")[2].alias("p99"), "sample_count")


def compare(conn: DataFrame, base: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Each flow's metrics against its host's baseline for its service: z, ratio to p99, and whether it is anomalous.

    Without a baseline, or with a deviation of 0, z is 0 and nothing is anomalous. No service counts as "unknown", as in the baseline.
    """
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in (("orig_bytes", F.col("orig_bytes")), ("resp_bytes", F.col("resp_bytes")), ("duration", F.col("duration")), ("pkts", F.col("orig_pkts") + F.col("resp_pkts")))])).alias("m")
    rows = conn.select("uid", "src_ip", known_service().alias("service"), values).select("uid", "src_ip", "service", "m.*")
    joined = rows.join(base.select("src_ip", "service", "metric", "mean", "std", "p99"), ["src_ip", "service", "metric"], "left")
    z = F.when(F.col("std") > 0, (F.col("value") - F.col("mean")) / F.col("std")).otherwise(0.0)
    ratio = F.when(F.col("p99") > 0, F.col("value") / F.col("p99")).otherwise(0.0)
    return joined.select("uid", "metric", "value", z.alias("z"), ratio.alias("ratio"), F.coalesce(F.col("std") > 0, F.lit(False)).alias("_varies")).withColumn("is_anomalous", F.col("_varies") & ((F.abs("z") > sigmas) | (F.col("ratio") > 1))).drop("_varies")


def of_hosts(base: DataFrame, asked: DataFrame) -> DataFrame:
    """The baselines of hosts: asked has src_ip, and service, null or empty for all services of the host. A baseline that is asked for twice comes once."""
    wanted = asked.where("src_ip IS NOT NULL").select("src_ip", F.nullif("service", F.lit("")).alias("service")).distinct()
    every = base.join(wanted.where("service IS NULL").select("src_ip"), "src_ip", "left_semi")
    named = base.join(wanted.where("service IS NOT NULL"), ["src_ip", "service"], "left_semi")
    return every.unionByName(named.join(wanted.where("service IS NULL").select("src_ip"), "src_ip", "left_anti"))


def to_artifact(base: DataFrame, window_hours: int = 24) -> DataFrame:
    """Baselines as JSON lines (column ``value``), each with the width of the window they were taken over."""
    return base.select(F.to_json(F.struct(F.lit(window_hours).alias("window_hours"), *base.columns)).alias("value"))


def from_artifact(lines: DataFrame) -> DataFrame:
    """What ``to_artifact`` wrote, as baselines; lines that are none give null fields."""
    schema = "window_hours int, src_ip long, service string, metric string, mean double, std double, min_val double, max_val double, p50 double, p95 double, p99 double, sample_count long"
    return lines.select(F.from_json("value", schema).alias("b")).select("b.*").drop("window_hours")
