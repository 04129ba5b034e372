"""Queries that join the parts: reports, feedback, filters, look-ups, fused events, alert payloads and what is to be asked next."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import entities as E
from flowlens.operators import baseline
from flowlens.operators import correlate as C
from flowlens.operators import labels as L
from flowlens.operators import matching as M
from flowlens.operators import rollups
from flowlens.operators import severity as S
from flowlens.operators import tuning as T
from flowlens.plans import correlation
from flowlens.plans import tuning as plan
from flowlens.plans.detection import BASE, rounded
from flowlens.sources import adapters as A

T0 = 1_704_067_200_000_000
DAY = A.DAY


def _incidents(s, d):
    """Alerts above 20 stand for this system's incidents, signature alerts for those of the other."""
    rows = A.alerts(s, d)
    mine = rows.where("severity >= 20").select("event_type", (~F.col("backup")).alias("true_positive"), (F.col("severity") * 6.0).alias("ttd_seconds"), (F.col("source_type") != "host").alias("explained"))
    other = rows.where("source_type = 'signature' AND severity >= 10").select("event_type", (F.col("severity") * 9.0).alias("ttd_seconds"))
    return mine, other, rows


def _report(s, d):
    row = S.comparison_report(*_incidents(s, d))
    return row.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in row.dtypes])


def _feedback(s, d):
    k = F.col("dst_ip")
    verdict = F.when(k % 3 == 0, "false_positive").when(k % 3 == 1, "true_positive").otherwise("needs_review")
    adjusted = F.when(k % 4 == 0, (k % 41 - 20).cast("int"))
    rows = A.alerts(s, d).select(F.col("alert_id").alias("incident_id"), verdict.alias("verdict"), F.concat(F.lit("reason "), (k % 5).cast("string")).alias("reason"), F.col("severity").alias("original_severity"), adjusted.alias("severity_adjustment"))
    return rows.withColumn("adjusted_severity", F.when(F.col("severity_adjustment").isNotNull(), S.adjusted(F.col("original_severity"), F.col("severity_adjustment"))))


def _routed(name):
    return lambda s, d: S.route_feedback(_feedback(s, d))[name]


_FEEDBACK = (
    f"WITH {A.ALERTS}, f AS (SELECT alert_id AS incident_id, CASE dst_ip % 3 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'true_positive' ELSE 'needs_review' END AS verdict, concat('reason ', dst_ip % 5) AS reason, severity AS original_severity, "
    "CASE WHEN dst_ip % 4 = 0 THEN CAST(dst_ip % 41 - 20 AS INTEGER) END AS adjustment FROM alerts) "
)


def _results(s, d):
    """Model results keyed by time and source, as detectors give them."""
    return A.scores(s, d).withColumn("us", F.col("us") - F.col("us") % (60 * 1_000_000)).withColumn("is_anomaly", F.col("score") > 0.7)


_RESULTS = f"{A.SCORES}, res AS (SELECT *, us - us % 60000000 AS minute, score > 0.7 AS is_anomaly FROM scores), fus AS (SELECT minute AS us, src_ip, round(avg(score), 8) AS avg_score, count(*) AS models, bool_or(is_anomaly) AS is_anomaly FROM res GROUP BY 1, 2)"


def _agreed(s, d):
    return A.label_rows(s, d).select(F.col("label_id").alias("event_id"), "us", "src_ip", "label", "confidence")


def _fused(s, d):
    weights = {"isolation_forest": 0.4, "autoencoder": 0.4, "hmm": 0.2}
    at = A.scores(s, d).groupBy("event_id").agg(F.first("us").alias("us"), F.first("src_ip").alias("src_ip"), F.first("dst_ip").alias("dst_ip"), F.array_sort(F.collect_set("model_name")).alias("models"))
    return T.fuse(A.scores(s, d), weights, 0.5).join(at, "event_id")


def _payload(s, d):
    rows = T.alert_payload(_fused(s, d).withColumn("fused", F.round("fused", 6)))
    return rows.withColumn("tags", F.concat_ws(",", "tags"))


def _invented(s, d):
    docs = A.read(s, d, "documents").select("doc_id", "text")
    none = F.array().cast("array<string>")
    allowed = F.when(F.col("doc_id") % 2 == 0, E.ips("text")).otherwise(none)
    return docs.select("doc_id", E.invented(F.coalesce("text", F.lit("")), F.coalesce(allowed, none), none, none).alias("v")).select("doc_id", *[F.size(F.col("v")[c]).cast("long").alias(c) for c in ("ips", "hosts", "alert_ids")])


def _unlabelled(s, d):
    labelled = A.label_rows(s, d).select(F.col("label_id").alias("event_id"))
    return T.unlabelled_queries(A.scores(s, d).withColumn("score", F.round("score", 9)), labelled).withColumn("unified_score", F.round("unified_score", 6)).withColumn("uncertainty", F.round("uncertainty", 6))


def _round_trip(s, d):
    made = baseline.from_artifact(baseline.to_artifact(baseline.baselines(A.conn(s, d), A.dns(s, d))))
    return rounded(made, "mean", "std", "min_val", "max_val", "p50", "p95", "p99")


def _trivial(s, d):
    rows = A.alerts(s, d).select("alert_id", "severity", (F.col("dst_ip") % 3 + 1).alias("n"), F.when(F.col("dst_ip") % 5 == 0, "scan").alias("pattern"))
    return rows.where(C.needs_no_explanation(F.col("n"), F.col("severity"), F.col("pattern"))).select("alert_id")


def _explained(s, d):
    """Incidents with explanations for two of three sessions, some of them out of bounds."""
    n = F.col("src_ip") * 7 + F.col("session")
    made = S.incidents(correlation.scored(s, d))
    action = lambda name, auto: F.struct(F.lit(name).alias("action"), F.lit("host").alias("target"), F.lit("high").alias("priority"), F.lit(auto).alias("auto_execute"), F.lit("").alias("justification"))
    said = made.where(n % 3 > 0).select(
        "src_ip", "session", F.concat(F.lit("Explained "), n.cast("string")).alias("title"), F.lit("d").alias("description"), F.lit("why").alias("explanation"), F.lit("r").alias("correlation_reason"), F.lit("f").alias("false_positive_assessment"),
        (n % 51 - 25).cast("int").alias("severity_adjustment"), (n % 10 / 10).alias("confidence"), F.array(action("block_ip", True), action("notify_soc", True), action("create_ticket", False)).alias("recommended_actions"),
    )
    rows = S.with_explanation(made, said, ["src_ip", "session"])
    auto = F.array_join(F.transform(F.filter("recommended_actions", lambda a: a["auto_execute"]), lambda a: a["action"]), ",")
    return rows.select("src_ip", "session", "severity_score", "severity_label", F.when(F.col("xai_available"), F.col("title")).otherwise("").alias("title"), "confidence", "xai_available", auto.alias("automatic"), F.array_join("tags", ",").alias("tags"))


def _nested(s, d):
    rows = C.group_entities(correlation.by_session(s, d), ["src_ip", "session"], "source_type")
    return rollups.nested_terms(rows, "dst_ips").select(F.col("term").cast("long").alias("term"), "doc_count")


def _totals(s, d):
    return S.totals({"flows": A.conn(s, d), "lookups": A.dns(s, d)}, correlation.scored(s, d))


def _truth(s, d):
    """What the first flow of the source within a second says of a result."""
    truth = A.events(s, d).where("event_type IN ('view', 'click', 'purchase')").select("event_id", "us", F.col("user_id").alias("src_ip"), (F.col("k") % 2 == 0).alias("label"), F.lit(1.0).alias("confidence"))
    rows = M.nearby_consensus(A.scores(s, d).where("model_name = 'hmm'").select("us", "src_ip"), truth, 1_000_000)
    return rows.select("us", "src_ip", F.coalesce("label", F.lit(False)).alias("label"), F.col("label").isNotNull().alias("found"))


def _of_hosts(s, d):
    asked = A.read(s, d, "supplier").select(F.col("s_suppkey").alias("src_ip"), F.when(F.col("s_suppkey") % 3 == 0, "view").when(F.col("s_suppkey") % 3 == 1, "").alias("service"))
    return baseline.of_hosts(baseline.baselines(A.conn(s, d), A.dns(s, d)), asked).select("src_ip", "service", "metric", F.round("mean", 9).alias("mean"), F.round("p99", 9).alias("p99"))


QUERIES = {
    "comparison_report": _report,
    "comparison_by_category": lambda s, d: S.by_category(*_incidents(s, d)[:2]),
    "feedback_fp_patterns": _routed("fp_patterns"),
    "feedback_tp_patterns": _routed("tp_patterns"),
    "feedback_review": _routed("review"),
    "feedback_calibrations": _routed("calibrations"),
    "range_half_open": lambda s, d: M.in_range(A.alerts(s, d), T0, T0 + 7 * DAY).select("alert_id", "us"),
    "range_closed": lambda s, d: M.in_range(A.alerts(s, d).withColumn("us", F.col("us") - F.col("us") % DAY), T0, T0 + 7 * DAY, closed=True).select("alert_id", "us"),
    "in_list": lambda s, d: M.in_list(A.alerts(s, d), A.label_rows(s, d).where("severity = 1"), "src_ip").select("alert_id"),
    "no_explanation": _trivial,
    "incident_explained": _explained,
    "incident_terms": _nested,
    "kpi_totals": _totals,
    "nearby_truth": _truth,
    "baseline_of_hosts": _of_hosts,
    "fusion_contributions": lambda s, d: rounded(T.contributions(plan._sparse_scores(s, d), plan.WEIGHTS), "contribution"),
    "fused_by_time_and_source": lambda s, d: T.by_time_and_source(_results(s, d), 8),
    "most_suspicious": lambda s, d: T.most_suspicious(T.by_time_and_source(_results(s, d), 8)),
    "nearby_consensus": lambda s, d: M.nearby_consensus(T.by_time_and_source(_results(s, d), 8), _agreed(s, d)).select("us", "src_ip", F.coalesce("label", F.lit(False)).alias("label"), F.col("label").isNotNull().alias("found")),
    "alert_payload": _payload,
    "tuning_scores": lambda s, d: T.tuning_scores(_results(s, d), 0.7).select("event_id", "model_name", "dst_ip", F.round("score", 6).alias("score"), "features.is_anomaly", "features.threshold"),
    "unlabelled_queries": _unlabelled,
    "baseline_round_trip": _round_trip,
    "invented_entities": _invented,
    "optimal_threshold_weighted": lambda s, d: rounded(T.optimal(T.sweep(A.judged(s, d), weight="confidence"), "cost"), "threshold", "precision", "recall", "f1", "cost", "youden"),
    "vote_totals": lambda s, d: L.source_stats(plan.votes(s, d)).groupBy().agg(F.sum("n").alias("votes"), F.sum("positive").alias("positive")),
}
_INC = f"{A.ALERTS}, mine AS (SELECT event_type, NOT backup AS tp, severity * 6.0::DOUBLE AS ttd, source_type <> 'host' AS ex FROM alerts WHERE severity >= 20), oth AS (SELECT event_type, severity * 9.0::DOUBLE AS ttd FROM alerts WHERE source_type = 'signature' AND severity >= 10)"
SQL = {
    "comparison_report": (
        f"WITH {_INC}, a AS (SELECT count(*) AS n, count(*) FILTER (tp) AS tp, coalesce(avg(ttd), 0) / 60 AS m, count(*) FILTER (ex) AS ex FROM mine), b AS (SELECT count(*) AS o, coalesce(avg(ttd), 0) / 60 AS om FROM oth), c AS (SELECT count(*) AS r FROM alerts) "
        "SELECT n AS incidents, o AS other_incidents, CASE WHEN o > 0 THEN round(n / o * 100, 6) ELSE 100 END AS coverage, CASE WHEN n > 0 THEN round(tp / n * 100, 6) ELSE 0 END AS precision_pct, n - o AS advantage, round(m, 6) AS mttd_minutes, round(om, 6) AS other_mttd_minutes, CASE WHEN om > 0 THEN round((m - om) / om * 100, 6) ELSE 0 END AS mttd_difference, "
        "CASE WHEN n > 0 THEN round((n - tp) / n * 100, 6) ELSE 0 END AS fp_rate, CASE WHEN r > 0 THEN round((r - n) / r * 100, 6) ELSE 0 END AS reduction, CASE WHEN n > 0 THEN round(ex / n * 100, 6) ELSE 0 END AS availability FROM a, b, c"
    ),
    "comparison_by_category": f"WITH {_INC} SELECT t AS event_type, (SELECT count(*) FROM mine WHERE event_type = t) AS incidents, (SELECT count(*) FROM oth WHERE event_type = t) AS other_incidents FROM (VALUES ('exfiltration'), ('c2_beaconing'), ('lateral_movement'), ('dns_tunneling'), ('scan')) v(t)",
    "feedback_fp_patterns": _FEEDBACK + "SELECT incident_id, reason FROM f WHERE verdict = 'false_positive'",
    "feedback_tp_patterns": _FEEDBACK + "SELECT incident_id FROM f WHERE verdict = 'true_positive'",
    "feedback_review": _FEEDBACK + "SELECT incident_id, reason FROM f WHERE verdict = 'needs_review'",
    "feedback_calibrations": _FEEDBACK + "SELECT incident_id, original_severity, CAST(least(100, greatest(0, original_severity + adjustment)) AS INTEGER) AS adjusted_severity, adjustment FROM f WHERE adjustment IS NOT NULL",
    "range_half_open": f"WITH {A.ALERTS} SELECT alert_id, us FROM alerts WHERE us >= {T0} AND us < {T0 + 7 * DAY}",
    "range_closed": f"WITH {A.ALERTS} SELECT alert_id, us - us % {DAY} AS us FROM alerts WHERE us - us % {DAY} BETWEEN {T0} AND {T0 + 7 * DAY}",
    "in_list": f"WITH {A.ALERTS}, {A.LABELS} SELECT alert_id FROM alerts WHERE src_ip IN (SELECT src_ip FROM lab WHERE severity = 1)",
    "incident_explained": (
        f"WITH {correlation.SCORED}, x AS (SELECT *, src_ip * 7 + session AS n, (src_ip * 7 + session) % 51 - 25 AS adj FROM fin), y AS (SELECT *, n % 3 > 0 AND abs(adj) <= 20 AS told FROM x), z AS (SELECT *, CASE WHEN told THEN least(100, greatest(0, severity_score + adj)) ELSE severity_score END AS moved FROM y) "
        "SELECT src_ip, session, CAST(moved AS INTEGER) AS severity_score, CASE WHEN moved >= 80 THEN 'critical' WHEN moved >= 60 THEN 'high' WHEN moved >= 40 THEN 'medium' ELSE 'low' END AS severity_label, CASE WHEN told THEN concat('Explained ', n) ELSE '' END AS title, CASE WHEN told THEN n % 10 / 10 ELSE 0.5 END AS confidence, told AS xai_available, "
        "CASE WHEN told THEN 'notify_soc' ELSE CASE severity_label WHEN 'critical' THEN 'notify_soc,create_ticket' WHEN 'high' THEN 'notify_soc,create_ticket' WHEN 'medium' THEN 'create_ticket' ELSE 'log_only' END END AS automatic, CASE WHEN told THEN '' ELSE 'needs_xai_reprocess' END AS tags FROM z"
    ),
    "incident_terms": f"WITH {correlation.SESSION} SELECT CAST(dst_ip AS BIGINT) AS term, count(*) AS doc_count FROM (SELECT DISTINCT src_ip, session, dst_ip FROM ses) GROUP BY 1",
    "kpi_totals": (
        f"WITH {correlation.SCORED} SELECT 'total' AS kind, 'flows' AS name, count(*) AS n FROM ev WHERE event_type IN ('view', 'click', 'purchase') UNION ALL SELECT 'total', 'lookups', count(*) FROM ev WHERE event_type = 'signup' "
        "UNION ALL SELECT 'total', 'incidents', count(*) FROM fin WHERE severity_label <> 'low' UNION ALL SELECT 'severity', severity_label, count(*) FROM fin WHERE severity_label <> 'low' GROUP BY 2"
    ),
    "nearby_truth": f"WITH {A.EVENTS}, f AS (SELECT us, user_id AS src_ip FROM ev), n AS (SELECT f.us, f.src_ip, e.k % 2 = 0 AS label FROM f JOIN ev e ON e.user_id = f.src_ip AND e.event_type IN ('view', 'click', 'purchase') AND abs(e.us - f.us) < 1000000 QUALIFY row_number() OVER (PARTITION BY f.us, f.src_ip ORDER BY e.us, e.event_id) = 1) SELECT us, src_ip, coalesce(label, false) AS label, label IS NOT NULL AS found FROM f LEFT JOIN n USING (us, src_ip)",
    "baseline_of_hosts": f"WITH {BASE} SELECT src_ip, service, metric, round(mean, 9) AS mean, round(p99, 9) AS p99 FROM base JOIN supplier ON s_suppkey = src_ip WHERE s_suppkey % 3 <> 0 OR service = 'view'",
    "fusion_contributions": f"WITH {A.SCORES} SELECT model_name, round(sum(CASE WHEN event_id % 5 = 0 AND model_name = 'hmm' THEN 0 ELSE score * CASE model_name WHEN 'isolation_forest' THEN 0.5::DOUBLE WHEN 'autoencoder' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END END) / (SELECT count(DISTINCT event_id) FROM scores), 6) AS contribution FROM scores GROUP BY 1",
    "no_explanation": f"WITH {A.ALERTS} SELECT alert_id FROM alerts WHERE dst_ip % 3 = 0 AND severity < 40 AND dst_ip % 5 <> 0",
    "fused_by_time_and_source": f"WITH {_RESULTS} SELECT * FROM fus",
    "most_suspicious": f"WITH {_RESULTS} SELECT * FROM fus ORDER BY avg_score DESC, us, src_ip LIMIT 50",
    "nearby_consensus": f"WITH {_RESULTS}, {A.LABELS}, n AS (SELECT f.us, f.src_ip, l.label FROM fus f JOIN lab l ON l.src_ip = f.src_ip AND abs(l.us - f.us) < 60000000 QUALIFY row_number() OVER (PARTITION BY f.us, f.src_ip ORDER BY l.us, l.label_id) = 1) SELECT us, src_ip, coalesce(label, false) AS label, label IS NOT NULL AS found FROM fus LEFT JOIN n USING (us, src_ip)",
    "alert_payload": (
        f"WITH {A.SCORES}, g AS (SELECT event_id, any_value(us) AS us, any_value(src_ip) AS src_ip, any_value(dst_ip) AS dst_ip, string_agg(DISTINCT model_name, ',' ORDER BY model_name) AS models, sum(CASE model_name WHEN 'hmm' THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END * score) / sum(CASE model_name WHEN 'hmm' THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END) AS raw FROM scores GROUP BY 1), h AS (SELECT *, round(raw, 6) AS f FROM g) "
        "SELECT event_id AS alert_id, us, 'detection_consumer' AS source, 'anomaly' AS source_type, CAST(floor(f * 100) AS INTEGER) AS severity_raw, f AS confidence, CAST(src_ip AS VARCHAR) AS src_ip, CAST(dst_ip AS VARCHAR) AS dst_ip, 'tcp' AS protocol, 'anomaly' AS event_type, models AS ml_model, f AS ml_score, CASE WHEN raw >= 0.5 THEN 'ml_detection,anomaly' ELSE 'ml_detection' END AS tags FROM h"
    ),
    "tuning_scores": f"WITH {A.SCORES} SELECT event_id, model_name, CAST(dst_ip AS VARCHAR) AS dst_ip, round(score, 6) AS score, score > 0.7 AS is_anomaly, 0.7::DOUBLE AS threshold FROM scores",
    "unlabelled_queries": f"WITH {A.SCORES}, {A.LABELS}, g AS (SELECT event_id, avg(round(score, 9)) AS m, count(score) AS models FROM scores WHERE event_id NOT IN (SELECT label_id FROM lab) GROUP BY 1) SELECT event_id, round(m, 6) AS unified_score, models, round(1 - abs(m - 0.5), 6) AS uncertainty, m >= 0.5 AS suggested_label, 'unlabeled' AS reason FROM g ORDER BY m DESC, event_id LIMIT 20",
    "baseline_round_trip": f"WITH {BASE} SELECT src_ip, service, metric, round(mean, 6) AS mean, round(std, 6) AS std, round(min_val, 6) AS min_val, round(max_val, 6) AS max_val, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, sample_count FROM base",
    "invented_entities": (
        r"WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[^\x00-\x7F\P{L}]', '_', 'g'), '[^\x00-\x7F\P{N}]', '_', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE len(list_distinct(list_concat(regexp_extract_all(t, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b'), regexp_extract_all(t, '(?i)\b[0-9a-f]{32,64}\b')))) END AS ips, "
        r"len(list_distinct(regexp_extract_all(t, '\b[A-Z][A-Z0-9-]{2,}(?:\.[A-Za-z0-9-]+)*\b'))) AS hosts, len(list_distinct(regexp_extract_all(t, '(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b'))) AS alert_ids FROM t"
    ),
    "optimal_threshold_weighted": plan.weighted_optimum_sql(),
    "vote_totals": f"WITH {plan.VOTES} SELECT count(*) AS votes, count(*) FILTER (label) AS positive FROM votes",
}
