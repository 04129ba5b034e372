"""Queries that run models, streams and log parsers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import detectors as D
from flowlens.operators import features
from flowlens.operators import labels as L
from flowlens.operators.correlate import known_false_positive
from flowlens.functions.scalars import hour_of_day
from flowlens.session import shared_folder
from flowlens.plans import correlation, tuning
from flowlens.sources import adapters as A
from flowlens.sources import changelog, generate, logs
from flowlens.streaming import correlator, jobs, questions, votes

FORM = ["duration", "orig_bytes", "resp_bytes", "bytes_ratio", "unique_destinations", "unique_ports"]
STATES = ["bytes_out", "unique_destinations", "unique_ports", "connection_count", "avg_duration"]


def _folder(spark: SparkSession) -> str:
    root = shared_folder(spark)
    return f"{root}/stream-{uuid.uuid4().hex}"


def _events(s: SparkSession, d: str) -> DataFrame:
    return features.event_features(A.conn(s, d), A.dns(s, d))


def hmm_states(s: SparkSession, d: str) -> DataFrame:
    windows = features.window_features(A.conn(s, d), A.dns(s, d), 6 * A.HOUR).persist()
    return D.score_sequences(windows, STATES, D.fit_hmm_windows(windows, STATES))


def _detected(name: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        fit, transform = D.DETECTORS[name]
        rows = _events(s, d).select("uid", *FORM).persist()
        return transform(rows, FORM, fit(rows, FORM, "uid"), "uid")

    return run


def zeek_parse(s: SparkSession, d: str) -> DataFrame:
    """The flows as lines of a tab-separated log, parsed."""
    rows = A.conn(s, d).select(F.concat_ws("\t", (F.col("us") / 1_000_000).cast("decimal(20,6)").cast("string"), F.col("uid").cast("string"), F.concat(F.lit("10.0.0."), F.col("src_ip").cast("string")), F.col("dst_port").cast("string"), F.col("duration").cast("string"), F.when(F.col("service") == "view", "-").otherwise(F.col("service"))).alias("value"))
    head = s.createDataFrame([("#separator \\x09",), ("#fields\tts\tuid\tid.orig_h\tid.resp_p\tduration\tservice",), ("#types\ttime\tstring\taddr\tport\tinterval\tstring",)], "value string")
    parsed, _ = logs.read_tsv(head.unionByName(rows))
    return parsed.select(F.col("uid").cast("long").alias("uid"), "src_ip", "dst_port", F.coalesce("service", F.lit("")).alias("service"))


def eve_parse(s: SparkSession, d: str) -> DataFrame:
    """The alerts as EVE lines, parsed."""
    alert = F.struct(F.col("event_type").alias("signature"), F.col("source_type").alias("category"), F.col("severity").cast("int").alias("severity"), F.col("alert_id").alias("signature_id"), F.array(F.array(F.lit("mitre_attack_id"), F.concat(F.lit("T"), F.col("dst_ip").cast("string")))).alias("metadata"))
    kind = F.when(F.col("backup"), "stats").otherwise("alert")
    lines = A.alerts(s, d).select(F.to_json(F.struct(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), kind.alias("event_type"), F.col("src_ip").cast("string").alias("src_ip"), F.lit("TCP").alias("proto"), F.col("alert_id").alias("flow_id"), alert.alias("alert"))).alias("value"))
    return logs.read_eve(lines.unionByName(s.createDataFrame([("{broken",), ("",)], "value string"))).select("flow_id", "src_ip", "alert_signature", "alert_severity", "mitre_attack_id")


def stream_rollup(s: SparkSession, d: str) -> DataFrame:
    rows = jobs.drain(jobs.rollup(jobs.event_stream(s, d, None)), _folder(s), "update", ["start", "user_id"])
    return rows.select(F.unix_micros("start").alias("bucket_us"), "user_id", "connections", F.round("bytes_total", 6).alias("bytes_total"))


def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    rows = jobs.drain(jobs.sessions(jobs.event_stream(s, d), "12 hours"), _folder(s), "complete")
    return rows.select("user_id", F.unix_micros("start").alias("start_us"), "alerts")


def stream_sliding(s: SparkSession, d: str) -> DataFrame:
    return jobs.drain(jobs.sliding(jobs.event_stream(s, d, None), 6 * A.HOUR), _folder(s), "append")


def _with_rocks(s: SparkSession, made) -> DataFrame:
    """``made()`` with the state stores that lists and timers need; the session's own provider comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(name)
    s.conf.set(name, correlator.ROCKS)
    try:
        return made()
    finally:
        s.conf.set(name, before)


def _stream_alerts(s: SparkSession, d: str) -> DataFrame:
    """The alerts of ``adapters.alerts`` as a stream."""
    k, kinds = F.col("k"), F.create_map(*[F.lit(x) for pair in A.ALERT_TYPES.items() for x in pair])
    rows = jobs.event_stream(s, d, None)
    known = known_false_positive(k % 50 == 0, k % 4 == 0, kinds[F.col("event_type")], hour_of_day("us"))
    return rows.select(F.col("event_id").alias("alert_id"), "us", "ts", F.col("user_id").alias("src_ip"), kinds[F.col("event_type")].alias("event_type"), known.alias("known"))


def stream_alert_groups(s: SparkSession, d: str) -> DataFrame:
    """The groups that alerts bring, by the stream; those of sessions that have ended come without an alert and are left out here."""
    rows = _with_rocks(s, lambda: jobs.drain(correlator.correlate_alerts(_stream_alerts(s, d), 6 * A.HOUR, 12 * A.HOUR), _folder(s), "append"))
    return rows.where("alert_id IS NOT NULL").select("alert_id", "us", "src_ip", "reason", F.coalesce("pattern", F.lit("")).alias("pattern"), F.size("alert_ids").cast("long").alias("size"))


def stream_votes(s: SparkSession, d: str) -> DataFrame:
    """Errors as votes of three sources on the purchases of their source, purchases as scores."""
    k, rows = F.col("k"), jobs.event_stream(s, d, None)
    source = F.element_at(F.array(F.lit("ids"), F.lit("hids"), F.lit("analyst")), (k % 3 + 1).cast("int"))
    key = [F.concat_ws("-", "user_id", k % 5).alias("event_id"), "us", "ts", F.col("event_id").alias("ord"), F.col("user_id").alias("src_ip")]
    cast = rows.where("event_type = 'error'").select(*key, k.alias("dst_ip"), source.alias("source"), (k % 4 != 0).alias("label"), (k / 100).alias("confidence"), F.lit("scan").alias("event_type"), F.lit(None).cast("string").alias("mitre_attack_id"))
    scores = rows.where("event_type = 'purchase'").select(*key, F.least(F.lit(1.0), F.col("value") / 500).alias("score"), (F.col("value") > 350).alias("is_anomaly"))
    weights = {name: source.weight for name, source in L.SOURCES.items()}
    return _with_rocks(s, lambda: jobs.drain(votes.flush_votes(votes.tagged(cast, scores, weights), ttl=12 * A.HOUR, idle=6 * A.HOUR), _folder(s), "append")).drop("sources")


def stream_questions(s: SparkSession, d: str) -> DataFrame:
    rows = jobs.event_stream(s, d)
    value, k = F.col("value"), F.col("k")
    made = {"isolation_forest": F.least(F.lit(1.0), value / 500), "autoencoder": k / 100, "hmm": F.least(F.lit(1.0), value / 1000 + k / 200)}
    scores = rows.select("event_id", F.explode(F.array(*[F.struct(F.lit(m).alias("model_name"), c.alias("score")) for m, c in made.items()])).alias("s")).select("event_id", "s.*")
    return questions.ask_over(scores, _folder(s), 0.5).withColumn("priority", F.round("priority", 6))


def change_log(s: SparkSession, d: str) -> DataFrame:
    """Events as changes of the value that their user had last; an error deletes it."""
    folder = _folder(s)
    changes = changelog.as_changes(jobs.event_stream(s, d), "user_id", "us", F.concat_ws(":", "event_type", "k"), F.col("event_type") == "error")
    query = changes.writeStream.foreachBatch(changelog.append(folder)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    changelog.compact(s, folder)
    return changelog.current(s, folder).select("key", "value", "version")


QUERIES = {
    "iforest_scores": _detected("isolation_forest"),
    "autoencoder_scores": _detected("autoencoder"),
    "hmm_states": hmm_states,
    "zeek_parse": zeek_parse,
    "eve_parse": eve_parse,
    "generate_flows": lambda s, d: generate.flows(s, 5000),
    "generate_lookups": lambda s, d: generate.lookups(s, 2000),
    "generate_scores": lambda s, d: generate.model_scores(s, 500),
    "stream_rollup": stream_rollup,
    "stream_sessions": stream_sessions,
    "stream_sliding": stream_sliding,
    "stream_alert_groups": stream_alert_groups,
    "stream_votes": stream_votes,
    "stream_questions": stream_questions,
    "change_log": change_log,
}
_SESSION = f"WITH {A.ALERTS}, lagged AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY src_ip ORDER BY us) < 43200000000 THEN 0 ELSE 1 END AS fresh FROM alerts), ses AS (SELECT *, sum(fresh) OVER (PARTITION BY src_ip ORDER BY us ROWS UNBOUNDED PRECEDING) AS n FROM lagged)"
SQL = {
    "stream_alert_groups": f"SELECT alert_id, us, src_ip, reason, pattern, size FROM ({correlation.SQL['alert_groups']})",
    "stream_questions": tuning.SQL["al_hybrid_topk"],
    "change_log": f"WITH {A.EVENTS} SELECT CAST(user_id AS VARCHAR) AS key, concat(event_type, ':', k) AS value, us AS version FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_type = 'error' DESC, event_type DESC, k DESC) = 1) WHERE event_type <> 'error'",
    "zeek_parse": f"WITH {A.CONN} SELECT uid, concat('10.0.0.', src_ip) AS src_ip, CAST(dst_port AS BIGINT) AS dst_port, CASE WHEN service = 'view' THEN '' ELSE service END AS service FROM conn",
    "eve_parse": f"WITH {A.ALERTS} SELECT alert_id AS flow_id, CAST(src_ip AS VARCHAR) AS src_ip, event_type AS alert_signature, severity AS alert_severity, concat('T', dst_ip) AS mitre_attack_id FROM alerts WHERE NOT backup",
    "stream_rollup": f"WITH {A.EVENTS} SELECT us - us % 3600000000 AS bucket_us, user_id, count(*) AS connections, round(sum(value), 6) AS bytes_total FROM ev GROUP BY 1, 2",
    "stream_sessions": f"{_SESSION} SELECT src_ip AS user_id, min(us) AS start_us, count(*) AS alerts FROM ses GROUP BY src_ip, n",
    "stream_sliding": f"WITH {A.ALERTS}, w AS (SELECT a.alert_id AS event_id, a.src_ip AS user_id, count(*) AS size FROM alerts a JOIN alerts b ON a.src_ip = b.src_ip AND b.us BETWEEN a.us - 21600000000 AND a.us GROUP BY 1, 2) SELECT * FROM w WHERE size >= 2",
}
