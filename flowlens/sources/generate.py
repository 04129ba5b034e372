"""Seeded synthetic logs as Spark jobs: every column is a hash of (seed, row), so any number of rows comes without state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T0 = 1_782_864_000_000_000  # 2026-07-01 00:00 UTC in microseconds
DAY = 86_400_000_000


def uniform(seed: int, name: str) -> Column:
    """A number in [0, 1) for each ``id``."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(1 << 30)) / float(1 << 30)


def flows(spark: SparkSession, n: int = 5000, seed: int = 42, anomalies: float = 0.02, hosts: int = 50, days: int = 7) -> DataFrame:
    """Flows with ``kind``: normal, or one of four anomalies in equal parts: scan, exfiltration, beacon, lateral."""
    u = lambda name: uniform(seed, name)
    kind = F.when(u("odd") >= anomalies, "normal").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("scan", "exfiltration", "beacon", "lateral")]), (F.floor(u("kind") * 4) + 1).cast("int")))
    rows = spark.range(n).withColumn("kind", kind)
    pick = lambda normal, scan, exfil, beacon, lateral: F.when(F.col("kind") == "scan", scan).when(F.col("kind") == "exfiltration", exfil).when(F.col("kind") == "beacon", beacon).when(F.col("kind") == "lateral", lateral).otherwise(normal)
    whole = lambda c: F.floor(c)
    return rows.select(
        F.col("id").alias("uid"), (F.lit(T0) + whole(u("t") * days * DAY)).alias("us"), whole(u("src") * hosts).alias("src_ip"), whole(u("dst") * 4 * hosts).alias("dst_ip"),
        pick(F.element_at(F.array(F.lit(443), F.lit(80), F.lit(53), F.lit(22)), (whole(u("port") * 4) + 1).cast("int")).cast("long"), whole(u("port") * 65535), F.lit(443).cast("long"), F.lit(8443).cast("long"), F.lit(445).cast("long")).alias("dst_port"),
        pick(u("d") * 10, u("d") * 0.05, 100 + u("d") * 300, F.lit(1.0), u("d") * 5).alias("duration"), pick(whole(u("o") * 10_000), whole(u("o") * 100), whole(10_000_000 + u("o") * 50_000_000), whole(200 + u("o") * 20), whole(u("o") * 50_000)).alias("orig_bytes"),
        pick(whole(u("r") * 50_000), F.lit(0).cast("long"), whole(u("r") * 1000), whole(200 + u("r") * 20), whole(u("r") * 50_000)).alias("resp_bytes"), "kind",
    )


def lookups(spark: SparkSession, n: int = 2000, seed: int = 42, anomalies: float = 0.02, hosts: int = 50, days: int = 7) -> DataFrame:
    u = lambda name: uniform(seed, f"dns-{name}")
    tunnel = u("odd") < anomalies
    query = F.when(tunnel, F.concat(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 40), F.lit(".tunnel.example"))).otherwise(F.concat(F.lit("host"), F.floor(u("q") * 200).cast("string"), F.lit(".example.com")))
    return spark.range(n).select(F.col("id").alias("uid"), (F.lit(T0) + F.floor(u("t") * days * DAY)).alias("us"), F.floor(u("src") * hosts).alias("src_ip"), query.alias("query"), F.when(tunnel | (u("r") < 0.05), "NXDOMAIN").otherwise("NOERROR").alias("rcode"))


def model_scores(spark: SparkSession, n: int = 500, seed: int = 42, positives: float = 0.05) -> DataFrame:
    """Scores with a truth: high for positives, low for the others."""
    u = lambda name: uniform(seed, f"score-{name}")
    label = u("label") < positives
    return spark.range(n).select(F.col("id").alias("event_id"), label.alias("label"), F.when(label, 1 - u("s") ** 2 * 0.4).otherwise(u("s") ** 2 * 0.6).alias("score"))


#: Shares of event kinds that a simulated sensor sends.
EVENT_MIX = (("conn", 0.35), ("dns", 0.20), ("http", 0.15), ("ssl", 0.10), ("alert", 0.12), ("host", 0.08))


def sensor_stream(spark: SparkSession, rows_per_second: int = 10, seed: int = 42) -> DataFrame:
    """A stream of event kinds in the mix, one row an event."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().withColumnRenamed("value", "id")
    u = uniform(seed, "mix")
    kind, upto = None, 0.0
    for name, share in EVENT_MIX:
        upto += share
        kind = F.when(u < upto, name) if kind is None else kind.when(u < upto, name)
    return rows.select("timestamp", "id", kind.otherwise(EVENT_MIX[-1][0]).alias("kind"))
