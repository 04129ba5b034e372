"""The logical tables of the engine as views over the driver tables, with the same views as SQL for the oracle.

Times are epoch microseconds (``us``), so results do not depend on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.scalars import micros

HOUR, DAY = 3_600_000_000, 86_400_000_000
PORTS = (80, 443, 22, 53, 25, 445, 3389, 8080, 9000, 1234)
ALERT_TYPES = {"view": "scan", "purchase": "exfiltration", "error": "c2_beaconing", "click": "lateral_movement", "signup": "dns_tunneling"}
SEVERITIES = ("low", "medium", "high", "critical")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    return rows.select("event_id", micros("ts").alias("us"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


EVENTS = "ev AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows: uid, us, src_ip, dst_ip, dst_port, service, duration, orig_bytes, resp_bytes, orig_pkts, resp_pkts, conn_state."""
    port = F.element_at(F.array(*[F.lit(p) for p in PORTS]), (F.col("k") % len(PORTS) + 1).cast("int"))
    return (
        events(spark, sf_dir)
        .where(F.col("event_type").isin("view", "click", "purchase"))
        .select(
            F.col("event_id").alias("uid"), "us", F.col("user_id").alias("src_ip"), F.col("k").alias("dst_ip"), port.alias("dst_port"), F.col("event_type").alias("service"), (F.col("value") / 10).alias("duration"),
            F.floor(F.col("value") * 100).alias("orig_bytes"), F.floor(F.col("value") * 10).alias("resp_bytes"), (F.floor("value") + 1).alias("orig_pkts"), F.floor(F.col("value") / 2).alias("resp_pkts"), F.when(F.col("k") % 7 == 0, "S0").otherwise("SF").alias("conn_state"),
        )
    )


CONN = (
    f"{EVENTS}, conn AS (SELECT event_id AS uid, us, user_id AS src_ip, k AS dst_ip, (ARRAY[{', '.join(map(str, PORTS))}])[k % {len(PORTS)} + 1] AS dst_port, event_type AS service, value / 10 AS duration, "
    "CAST(floor(value * 100) AS BIGINT) AS orig_bytes, CAST(floor(value * 10) AS BIGINT) AS resp_bytes, CAST(floor(value) AS BIGINT) + 1 AS orig_pkts, CAST(floor(value / 2) AS BIGINT) AS resp_pkts, "
    "CASE WHEN k % 7 = 0 THEN 'S0' ELSE 'SF' END AS conn_state FROM ev WHERE event_type IN ('view', 'click', 'purchase'))"
)


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups: uid, us, src_ip, query, rcode."""
    rcode = F.when(F.col("k") % 5 == 0, "NXDOMAIN").when(F.col("k") % 5 == 1, "SERVFAIL").otherwise("NOERROR")
    return events(spark, sf_dir).where("event_type = 'signup'").select(F.col("event_id").alias("uid"), "us", F.col("user_id").alias("src_ip"), F.concat(F.lit("q"), F.col("k").cast("string")).alias("query"), rcode.alias("rcode"))


DNS = "dns AS (SELECT event_id AS uid, us, user_id AS src_ip, concat('q', CAST(k AS VARCHAR)) AS query, CASE k % 5 WHEN 0 THEN 'NXDOMAIN' WHEN 1 THEN 'SERVFAIL' ELSE 'NOERROR' END AS rcode FROM ev WHERE event_type = 'signup')"


def _mapped(column: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[column]


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts: alert_id, us, src_ip, dst_ip, event_type, source_type, severity, confidence, host, scheduled, backup."""
    source = F.element_at(F.array(F.lit("anomaly"), F.lit("signature"), F.lit("host")), (F.col("k") % 3 + 1).cast("int"))
    return events(spark, sf_dir).select(
        F.col("event_id").alias("alert_id"), "us", F.col("user_id").alias("src_ip"), F.col("k").alias("dst_ip"), _mapped(F.col("event_type"), ALERT_TYPES).alias("event_type"), source.alias("source_type"),
        F.least(F.lit(100), F.floor(F.col("value") / 5)).cast("int").alias("severity"), (F.col("k") / 100).alias("confidence"), F.concat(F.lit("srv-"), (F.col("k") % 10).cast("string")).alias("host"), (F.col("k") % 4 == 0).alias("scheduled"), (F.col("k") % 50 == 0).alias("backup"),
    )


ALERTS = (
    f"{EVENTS}, alerts AS (SELECT event_id AS alert_id, us, user_id AS src_ip, k AS dst_ip, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALERT_TYPES.items()) + " END AS event_type, "
    "(ARRAY['anomaly', 'signature', 'host'])[k % 3 + 1] AS source_type, CAST(least(100, floor(value / 5)) AS INTEGER) AS severity, k / 100 AS confidence, concat('srv-', CAST(k % 10 AS VARCHAR)) AS host, k % 4 = 0 AS scheduled, k % 50 = 0 AS backup FROM ev)"
)

MODELS = ("autoencoder", "hmm", "isolation_forest")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model scores, long: event_id, us, src_ip, dst_ip, model_name, score."""
    value, k = F.col("value"), F.col("k")
    score = {"isolation_forest": F.least(F.lit(1.0), value / 500), "autoencoder": k / 100, "hmm": F.least(F.lit(1.0), value / 1000 + k / 200)}
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model_name"), score[m].alias("score")) for m in MODELS]))
    return events(spark, sf_dir).select("event_id", "us", F.col("user_id").alias("src_ip"), F.col("k").alias("dst_ip"), rows.alias("s")).select("event_id", "us", "src_ip", "dst_ip", "s.*")


SCORES = (
    f"{EVENTS}, scores AS (SELECT event_id, us, user_id AS src_ip, k AS dst_ip, 'isolation_forest' AS model_name, least(1.0, value / 500) AS score FROM ev "
    "UNION ALL SELECT event_id, us, user_id, k, 'autoencoder', k / 100 FROM ev UNION ALL SELECT event_id, us, user_id, k, 'hmm', least(1.0, value / 1000 + k / 200) FROM ev)"
)


#: What label records hold, by k: categories, rule groups, tags, vendor categories and tactics.
CATEGORIES = ("Network Scan", "Trojan Activity", "Other", "Data Exfiltration", "Attempted User Privilege Gain", "DNS Tunneling", "Attempted Administrator Privilege Gain", "Malware Command and Control Activity Detected")
GROUPS = (("ossec", "syscheck"), ("auth", "web"), ("rootcheck",), ("unknown",), ("malware",), ("sql_injection", "xss"))
TAGS = (("c2",), ("scan", "botnet"), ("exfiltration",), ("recon",), ("tor",), ())
VENDOR_CATEGORIES = ("exfiltration", "c2_beaconing", "lateral_movement", "dns_tunneling", "scan", "other")
TACTICS = ("Command and Control", "Lateral Movement", "Exfiltration over C2", "Discovery", "Credential Access", "Impact")
SEVERITY_NAMES = ("low", "medium", "high", "critical", "Critical")


def _by_k(values: tuple) -> Column:
    one = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, tuple) else F.lit(v)
    return F.element_at(F.array(*map(one, values)), (F.col("k") % len(values) + 1).cast("int"))


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels at a time and place: label_id, us, src_ip, dst_ip, label, confidence, severity (1 to 4), level (0 to 15) and what sources read."""
    k = F.col("k")
    return events(spark, sf_dir).where("event_type = 'error'").select(
        F.col("event_id").alias("label_id"), "us", F.col("user_id").alias("src_ip"), k.alias("dst_ip"), (k % 3 != 0).alias("label"), (k / 100).alias("confidence"), (k % 4 + 1).alias("severity"), (k % 16).alias("level"),
        _by_k(CATEGORIES).alias("category"), _by_k(GROUPS).alias("groups"), (k % 10).alias("agent_id"), (k % 5).alias("threat_level"), _by_k(TAGS).alias("tags"), _by_k(VENDOR_CATEGORIES).alias("vendor_category"), _by_k(TACTICS).alias("tactic"), _by_k(SEVERITY_NAMES).alias("severity_name"),
    )


def host_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label records of host agents, some without addresses."""
    return label_rows(spark, sf_dir).withColumn("src_ip", F.when(F.col("dst_ip") % 7 != 0, F.col("src_ip"))).withColumn("dst_ip", F.when((F.col("dst_ip") % 7 != 0) & (F.col("dst_ip") % 5 != 0), F.col("dst_ip")))


LABELS = (
    "lab AS (SELECT event_id AS label_id, us, user_id AS src_ip, k AS dst_ip, k % 3 <> 0 AS label, k / 100 AS confidence, k % 4 + 1 AS severity, k % 16 AS level, k, "
    "(ARRAY['scan', 'c2_beaconing', 'anomaly', 'exfiltration', 'lateral_movement', 'dns_tunneling', 'lateral_movement', 'c2_beaconing'])[k % 8 + 1] AS ids_type, "
    "(ARRAY['file_integrity', 'auth_anomaly', 'rootkit', 'anomaly', 'malware', 'sql_injection'])[k % 6 + 1] AS hids_type, "
    "CASE WHEN k % 16 >= 12 THEN 0.95::DOUBLE WHEN k % 16 >= 9 THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END * CASE WHEN k % 7 = 0 THEN 0.7::DOUBLE ELSE 1 END AS hids_conf, "
    "(ARRAY['c2_beaconing', 'c2_beaconing', 'exfiltration', 'scan', 'threat_intel_match', 'threat_intel_match'])[k % 6 + 1] AS intel_type, "
    "(ARRAY[0.6, 0.95, 0.85, 0.7, 0.6]::DOUBLE[])[k % 5 + 1] AS intel_conf, "
    "(ARRAY['exfiltration', 'c2_beaconing', 'lateral_movement', 'dns_tunneling', 'scan', 'anomaly'])[k % 6 + 1] AS vendor_type, "
    "(ARRAY[0.5, 0.7, 0.9, 1.0, 0.5]::DOUBLE[])[k % 5 + 1] AS vendor_conf, "
    "(ARRAY['c2_beaconing', 'lateral_movement', 'exfiltration', 'scan', 'credential_theft', 'anomaly'])[k % 6 + 1] AS tactic_type, "
    "CASE severity WHEN 1 THEN 0.95::DOUBLE WHEN 2 THEN 0.80::DOUBLE WHEN 3 THEN 0.60::DOUBLE ELSE 0.5::DOUBLE END AS ids_conf "
    "FROM (SELECT *, k % 4 + 1 AS severity FROM ev) WHERE event_type = 'error')"
)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with a truth, from the labelled documents: id, model_name, score, label, confidence."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id")
    score = F.array(F.struct(F.lit("length").alias("model_name"), F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("score")), F.struct(F.lit("hash").alias("model_name"), ((F.col("doc_id") * 7919 % 1000) / 1000).alias("score")))
    return rows.select(F.col("doc_id").alias("id"), F.explode(score).alias("s"), (F.col("toxic") == 1).alias("label"), (0.5 + F.col("doc_id") % 50 / 100).alias("confidence")).select("id", "s.*", "label", "confidence")


JUDGED = (
    "judged AS (SELECT doc_id AS id, 'length' AS model_name, least(1.0, n_chars / 5000) AS score, toxic = 1 AS label, 0.5::DOUBLE + doc_id % 50 / 100 AS confidence FROM documents JOIN labels USING (doc_id) "
    "UNION ALL SELECT doc_id, 'hash', (doc_id * 7919 % 1000) / 1000, toxic = 1, 0.5::DOUBLE + doc_id % 50 / 100 FROM documents JOIN labels USING (doc_id))"
)


def flows_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large flows: us (day), src_ip, dst_ip, dst_port, bytes."""
    return read(spark, sf_dir, "lineitem").select(micros("l_shipdate").alias("us"), F.col("l_suppkey").alias("src_ip"), F.col("l_partkey").alias("dst_ip"), F.col("l_linenumber").alias("dst_port"), F.floor("l_extendedprice").alias("bytes"))


LINES = "line AS (SELECT epoch_us(l_shipdate) AS us, l_suppkey AS src_ip, l_partkey AS dst_ip, l_linenumber AS dst_port, CAST(floor(l_extendedprice) AS BIGINT) AS bytes FROM lineitem)"
