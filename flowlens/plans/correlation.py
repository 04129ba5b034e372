"""Queries over alerts: groups, sessions, patterns, enrichment, severity, incidents, entities and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import entities as E
from flowlens.functions.scalars import hour_of_day, severity_label, tactic_event_type
from flowlens.operators import correlate as C
from flowlens.operators import ranges as R
from flowlens.operators import rollups
from flowlens.operators import severity as S
from flowlens.plans.detection import rounded
from flowlens.session import cut
from flowlens.sources import adapters as A
from flowlens.sources import sinks

WINDOW, GAP = 6 * A.HOUR, 12 * A.HOUR
HOUR_SQL = "us // 3600000000 % 24"


def by_session(s, d):
    return C.sessions(A.alerts(s, d), GAP)


SESSION = f"{A.ALERTS}, lagged AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY src_ip ORDER BY us, alert_id) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM alerts), ses AS (SELECT * EXCLUDE (fresh), CAST(sum(fresh) OVER (PARTITION BY src_ip ORDER BY us, alert_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM lagged)"


_KEYS = ("src_ip", "session")


def groups(s, d):
    """Sessions of at least three alerts with their metrics, kinds, targets as they first occur, last target, pattern and reason."""
    rows = cut(by_session(s, d))
    target = rows.groupBy(*_KEYS).agg(F.max_by("dst_ip", F.struct("us", "alert_id")).alias("dst_ip"), F.concat_ws(", ", F.array_sort(F.collect_set("event_type"))).alias("kinds"))
    shown = C.attack_patterns(A.alerts(s, d), GAP).select(*_KEYS, "pattern", F.concat(F.lit("attack_pattern_"), "pattern").alias("reason"))
    made = C.group_metrics(rows, list(_KEYS)).where("alerts >= 3").join(target, list(_KEYS)).join(C.in_order(rows, list(_KEYS), "dst_ip", "target_ips"), list(_KEYS))
    return made.join(shown, list(_KEYS), "left").withColumn("reason", F.coalesce("reason", F.lit("shared_source_proximity")))


def _first_of(column, name):
    """The distinct values of a column of each session with the place at which they first occur."""
    return (
        f"{name} AS (SELECT src_ip, session, {column}, row_number() OVER (PARTITION BY src_ip, session ORDER BY f, i) AS place "
        f"FROM (SELECT src_ip, session, {column}, min(us) AS f, arg_min(alert_id, (us, alert_id)) AS i FROM ses GROUP BY 1, 2, 3))"
    )


GROUPS = (
    f"{SESSION}, {_first_of('host', 'fh')}, {_first_of('dst_ip', 'fd')}, ho AS (SELECT src_ip, session, string_agg(host, ',' ORDER BY place) AS hosts FROM fh GROUP BY 1, 2), "
    "gr AS (SELECT src_ip, session, count(*) AS alerts, max(us) - min(us) AS span_us, count(DISTINCT dst_ip) AS targets, "
    "CASE WHEN sum(confidence) > 0 THEN sum(severity * confidence) / sum(confidence) ELSE avg(severity) END AS severity, arg_max(dst_ip, (us, alert_id)) AS dst_ip FROM ses GROUP BY 1, 2 HAVING count(*) >= 3), "
    "grp AS (SELECT gr.*, hosts FROM gr JOIN ho USING (src_ip, session))"
)
INTEL_TAGS = ("c2-server", "scanner", "phishing", "cdn", "botnet")
#: Parts whose names stand for addresses that threat intelligence knows.
KNOWN = "p_name LIKE '%green%'"


def enriched(s, d):
    """The look-ups: suppliers as assets, nations as ranges of targets, parts as threat intelligence, flows as history; some are not answered."""
    assets = A.read(s, d, "supplier").select(F.col("s_suppkey").alias("src_ip"), (F.col("s_suppkey") % 5 + 1).alias("criticality"), (F.col("s_suppkey") % 11 == 0).alias("failed"))
    first = F.col("n_nationkey").cast("long") * 3
    geo = A.read(s, d, "nation").select(first.alias("first"), (first + 1).alias("last"), F.col("n_name").alias("country"))
    tag = F.element_at(F.array(*[F.lit(t) for t in INTEL_TAGS]), (F.col("p_partkey") % len(INTEL_TAGS) + 1).cast("int"))
    parts = A.read(s, d, "part").where(KNOWN)
    intel = parts.select(F.col("p_partkey").alias("ip"), tag.alias("tag"), (F.col("p_partkey") % 3 == 0).alias("failed")).unionByName(parts.where("p_size > 25").select(F.col("p_partkey").alias("ip"), F.lit("seen").alias("tag"), F.lit(False).alias("failed")))
    return S.enrich(groups(s, d), assets, geo, intel, rollups.historical_of_source(A.conn(s, d)))


ENRICHED = (
    f"{GROUPS}, pair AS (SELECT user_id AS src_ip, k AS dst_ip, sum(b) AS total, quantile_cont(b, 0.99) AS p99 FROM (SELECT user_id, k, CAST(floor(value * 100) AS BIGINT) AS b FROM ev WHERE event_type IN ('view', 'click', 'purchase')) GROUP BY 1, 2), "
    "hist AS (SELECT src_ip, CASE WHEN p99 > 0 THEN total / p99 ELSE 0 END AS deviation FROM pair QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY total DESC, dst_ip) = 1), "
    f"intel AS (SELECT p_partkey AS ip, (ARRAY[{', '.join(repr(t) for t in INTEL_TAGS)}])[p_partkey % 5 + 1] AS tag, p_partkey % 3 = 0 AS bad FROM part WHERE {KNOWN} UNION ALL SELECT p_partkey, 'seen', false FROM part WHERE {KNOWN} AND p_size > 25), "
    "kn AS (SELECT ip, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, bool_or(bad) AS bad, bool_or(tag IN ('c2-server', 'botnet', 'malware', 'phishing', 'suspicious')) AS sus FROM intel GROUP BY 1), "
    "addr AS (SELECT src_ip, session, src_ip AS ip, 0 AS place FROM gr UNION ALL SELECT src_ip, session, dst_ip, place FROM fd), "
    "met AS (SELECT src_ip, session, arg_min(tags, place) AS tags, arg_min(bad, place) AS bad, arg_min(sus, place) AS sus FROM addr JOIN kn USING (ip) GROUP BY 1, 2), "
    "cty AS (SELECT src_ip, session, arg_min(n_name, place) AS country FROM fd JOIN nation ON dst_ip BETWEEN n_nationkey * 3 AND n_nationkey * 3 + 1 GROUP BY 1, 2), "
    "en AS (SELECT g.*, CASE WHEN s_suppkey IS NULL OR s_suppkey % 11 = 0 THEN 2 ELSE s_suppkey % 5 + 1 END AS criticality, country, deviation, CASE WHEN NOT m.bad THEN m.tags END AS tags, coalesce(NOT m.bad, false) AS malicious, coalesce(m.sus AND NOT m.bad, false) AS suspicious, "
    "concat_ws(',', CASE WHEN s_suppkey % 11 = 0 THEN 'asset' END, CASE WHEN m.bad THEN 'threat_intel' END) AS failed_sources "
    "FROM grp g LEFT JOIN supplier ON s_suppkey = g.src_ip LEFT JOIN cty c ON c.src_ip = g.src_ip AND c.session = g.session LEFT JOIN hist h ON h.src_ip = g.src_ip LEFT JOIN met m ON m.src_ip = g.src_ip AND m.session = g.session)"
)
SCORED = (
    f"{ENRICHED}, comp AS (SELECT *, severity::DOUBLE AS c_model, least(100, criticality * 20.0::DOUBLE) AS c_asset, CASE WHEN malicious THEN 100.0::DOUBLE WHEN suspicious THEN 50 ELSE 0 END AS c_intel, least(100, coalesce(deviation, 0) * 10.0::DOUBLE) AS c_history, least(100, alerts * 25.0::DOUBLE) AS c_correlation FROM en), "
    "t1 AS (SELECT *, c_model * 0.4::DOUBLE + c_asset * 0.25::DOUBLE + c_intel * 0.15::DOUBLE + c_history * 0.1::DOUBLE + c_correlation * 0.1::DOUBLE AS t FROM comp), t2 AS (SELECT *, CASE WHEN c_intel >= 100 AND c_asset >= 80 THEN least(100, t * 1.2::DOUBLE) ELSE t END AS u FROM t1), "
    "t3 AS (SELECT *, CASE WHEN c_correlation >= 100 AND c_model >= 70 THEN least(100, u * 1.1::DOUBLE) ELSE u END AS v FROM t2), sc AS (SELECT *, CAST(round_even(round(least(100, v), 9), 0) AS INTEGER) AS severity_score FROM t3), "
    "fin AS (SELECT *, CASE WHEN severity_score >= 80 THEN 'critical' WHEN severity_score >= 60 THEN 'high' WHEN severity_score >= 40 THEN 'medium' ELSE 'low' END AS severity_label FROM sc)"
)
def scored(s, d):
    return S.score_groups(enriched(s, d))


#: When the incidents of these tables count as published.
PUBLISHED_US = 1_706_745_600_000_000


def _named(actions, every=True):
    one = lambda a: F.concat(a["action"], F.lit(":"), a["target"], F.lit(":"), a["priority"]) if every else a["action"]
    return F.array_join(F.transform(actions, one), ",")


def _incidents(s, d):
    rows = S.incidents(scored(s, d))
    waiting = F.filter("recommended_actions", lambda a: ~a["auto_execute"])
    return rows.select(
        *_KEYS, "severity_label", "title", "description", "correlation_reason", "false_positive_assessment", _named("recommended_actions").alias("actions"), _named(waiting, False).alias("manual_actions"),
    )


def _payload(s, d):
    """The incidents at their scores and 20 points higher, as an outside adjustment may have them."""
    rows = scored(s, d)
    raised = rows.withColumn("severity_score", S.adjusted(F.col("severity_score"), F.lit(20)).cast("int")).withColumn("severity_label", severity_label("severity_score"))
    made = sinks.action_payload(S.incidents(rows.withColumn("raised", F.lit(False)).unionByName(raised.withColumn("raised", F.lit(True)))))
    return made.select(*_KEYS, "raised", "playbook", _named("auto_execute_actions").alias("auto_execute_actions"), _named("manual_review_actions").alias("manual_review_actions"))


def _timeline(s, d):
    rows = S.timeline(by_session(s, d).withColumn("source", F.col("source_type")), list(_KEYS), PUBLISHED_US)
    return rows.select(*_KEYS, F.array_join(F.transform("timeline", lambda e: F.concat_ws(" ", e["timestamp"], e["event"])), "; ").alias("timeline"))


def _group_entities(s, d):
    rows = C.group_entities(by_session(s, d), list(_KEYS), "source_type")
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return rows.select(*_KEYS, joined("src_hosts"), joined("src_ips"), joined("dst_ips"), "alert_count", F.round("time_span_seconds", 6).alias("time_span_seconds"), "unique_sources", "unique_destinations")


def _alert_groups(s, d):
    known = C.known_false_positive(F.col("backup"), F.col("scheduled"), F.col("event_type"), hour_of_day("us"))
    return C.alert_groups(A.alerts(s, d), known, WINDOW, GAP).withColumn("pattern", F.coalesce("pattern", F.lit("")))


def _located(s, d):
    """Sources as addresses, every third of them a pseudonym, in the ranges that customers stand for; ranges overlap and are of many widths."""
    address = F.concat(F.lit("10.0."), F.floor(F.col("o_orderkey") / 256 % 256).cast("string"), F.lit("."), (F.col("o_orderkey") % 256).cast("string"))
    shown = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("hash:"), address)).otherwise(address)
    asked = A.read(s, d, "orders").select("o_orderkey", shown.alias("address")).withColumn("number", R.address_number("address"))
    first = 10 * 2**24 + F.col("c_custkey") * 7
    table = A.read(s, d, "customer").select(first.alias("first"), (first + F.col("c_custkey") * 13 % 300).alias("last"), "c_custkey")
    found = R.with_range(asked, table).withColumn("width", F.col("last") - F.col("first"))
    return found.select("o_orderkey", "address", F.coalesce("c_custkey", F.lit(-1)).alias("c_custkey"), F.coalesce("width", F.lit(-1)).alias("width"))


def _dedup(s, d):
    """Window and pattern groups over the same sessions: session alerts, and per day; equal sets count once."""
    rows = by_session(s, d)
    a = rows.groupBy("src_ip", "session").agg(F.collect_list("alert_id").alias("alert_ids"), F.min("us").alias("ord")).select("ord", F.lit("shared_source_proximity").alias("reason"), F.lit(None).cast("string").alias("pattern"), "alert_ids")
    b = rows.withColumn("day", rollups.truncated("us", A.DAY)).groupBy("src_ip", "day").agg(F.collect_list("alert_id").alias("alert_ids"), F.min("us").alias("ord")).select((F.col("ord") + 1).alias("ord"), F.lit("pattern").alias("reason"), F.lit("daily").alias("pattern"), "alert_ids")
    return a.unionByName(b)


_DEDUP = f"WITH {SESSION}, a AS (SELECT min(us) AS ord, 'shared_source_proximity' AS reason, NULL AS pattern, string_agg(CAST(alert_id AS VARCHAR), ',' ORDER BY alert_id) AS members FROM ses GROUP BY src_ip, session UNION ALL SELECT min(us) + 1, 'pattern', 'daily', string_agg(CAST(alert_id AS VARCHAR), ',' ORDER BY alert_id) FROM ses GROUP BY src_ip, us - us % {A.DAY}) "


def _valid(s, d):
    return S.validate(A.alerts(s, d), {"severity": F.col("severity").between(5, 90), "confidence": F.col("confidence").between(0.05, 0.95), "event_type": F.col("event_type") != "dns_tunneling"})


def _entities(s, d):
    docs = A.read(s, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.array_join(E.ips("text"), ",").alias("ips"), F.array_join(E.hosts("text"), ",").alias("hosts"), F.size(E.hashes("text")).cast("long").alias("hashes"))


def _made_up(s, d):
    """Words of the assistant's turns that stand in no other turn of their conversation."""
    rows = A.read(s, d, "conversations").where("conv_id IS NOT NULL")
    words = lambda mine: F.array_distinct(F.flatten(F.collect_list(F.when(mine, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[a-z]+"), F.lit(0))))))
    mine = F.col("role").eqNullSafe("assistant")
    text = rows.groupBy("conv_id").agg(words(mine).alias("said"), words(~mine).alias("given"))
    return text.select("conv_id", F.size(E.unsupported("said", "given")).cast("long").alias("unsupported"))


def _tags(s, d):
    tags = F.array(F.col("event_type"), F.col("source_type"))
    return A.alerts(s, d).select("alert_id", F.arrays_overlap(tags, F.array(F.lit("scan"), F.lit("host"))).alias("suspicious"))


def _feedback(s, d):
    verdict = F.when(F.col("backup") | (F.col("severity") < 10), "false_positive").otherwise("true_positive")
    return S.weekly_report(A.alerts(s, d).withColumn("verdict", verdict))


def _fp(s, d):
    kept = C.drop_false_positives(by_session(s, d), list(_KEYS), hour_of_day("us"))
    return kept.groupBy(*_KEYS).agg(F.count("*").alias("alerts"))


_SHOWN = (
    "pl AS (SELECT *, row_number() OVER (PARTITION BY src_ip, session ORDER BY us, alert_id) AS n FROM ses), c AS (SELECT src_ip, session, count(*) AS alerts, max(us) AS end_us, min(n) FILTER (event_type = 'scan') AS sc, min(n) FILTER (event_type = 'exfiltration') AS ex, count(*) FILTER (event_type = 'c2_beaconing') AS c2, count(*) FILTER (event_type IN ('dns_tunneling', 'anomaly')) AS side, count(*) FILTER (event_type = 'lateral_movement') AS lat, count(*) FILTER (event_type = 'scan') AS scans, count(*) FILTER (event_type = 'dns_tunneling') AS dn FROM pl GROUP BY 1, 2 HAVING count(*) >= 2), "
    "p AS (SELECT * FROM (SELECT *, CASE WHEN sc < ex THEN 'scan_to_exfiltration' WHEN c2 > 0 THEN 'c2_beaconing' WHEN scans > 0 AND lat > 0 THEN 'lateral_movement' WHEN dn > 0 THEN 'dns_tunneling' END AS pattern FROM c) WHERE pattern IS NOT NULL)"
)
_PATTERN_COLUMNS = "src_ip, session, alerts, pattern, CASE pattern WHEN 'scan_to_exfiltration' THEN ex - sc + 1 WHEN 'c2_beaconing' THEN c2 + side WHEN 'lateral_movement' THEN scans + lat ELSE dn END AS pattern_alerts, end_us"
_BAD = f"backup OR (event_type = 'exfiltration' AND {HOUR_SQL} BETWEEN 2 AND 4 AND scheduled)"

QUERIES = {
    "sliding_groups": lambda s, d: C.sliding_groups(A.alerts(s, d), WINDOW),
    "session_gap": lambda s, d: C.session_summary(A.alerts(s, d), GAP),
    "session_recent": lambda s, d: C.session_recent(A.alerts(s, d), GAP, WINDOW).select("alert_id", "src_ip", "session"),
    "session_expired": lambda s, d: C.expired(A.alerts(s, d), 1_706_745_600_000_000, GAP),
    "attack_patterns": lambda s, d: C.attack_patterns(A.alerts(s, d), GAP),
    "candidate_groups": lambda s, d: C.candidate_groups(A.alerts(s, d), hour_of_day("us"), WINDOW, GAP).select("src_ip", "session", "reason", F.coalesce("pattern", F.lit("")).alias("pattern"), F.array_join(F.transform("alert_ids", lambda x: x.cast("string")), ",").alias("members")),
    "fp_filter": _fp,
    "group_dedup": lambda s, d: C.group_dedup(_dedup(s, d)).na.fill("", ["pattern"]),
    "group_dedup_prefer_pattern": lambda s, d: C.group_dedup(_dedup(s, d), prefer_pattern=True).na.fill("", ["pattern"]),
    "group_metrics": lambda s, d: groups(s, d).drop("sources", "target_ips", "kinds", "pattern", "reason").withColumn("severity", F.round("severity", 9)),
    "enrich_partial": lambda s, d: enriched(s, d).select(*_KEYS, "criticality", F.coalesce("country", F.lit("")).alias("country"), F.coalesce("tags", F.lit("")).alias("tags"), "failed_sources", "partial"),
    "threat_intel_flags": lambda s, d: enriched(s, d).select(*_KEYS, "malicious", "suspicious"),
    "severity_score": lambda s, d: scored(s, d).select(*_KEYS, "severity_score", "severity_label"),
    "severity_components": lambda s, d: rounded(scored(s, d).select(*_KEYS, "c_model", "c_asset", "c_intel", "c_history", "c_correlation"), "c_history").withColumn("c_model", F.round("c_model", 9)),
    "incident_fallback": _incidents,
    "incident_timeline": _timeline,
    "incident_entities": _group_entities,
    "action_payload": _payload,
    "bonus_applied": lambda s, d: scored(s, d).select(*_KEYS, "bonus_applied"),
    "alert_groups": _alert_groups,
    "range_lookup": _located,
    "entity_extract": _entities,
    "entity_except": _made_up,
    "tag_overlap": _tags,
    "validate_accept": lambda s, d: _valid(s, d)[0].select("alert_id"),
    "validate_reject": lambda s, d: _valid(s, d)[1].select("alert_id", "error"),
    "weekly_report": lambda s, d: rounded(_feedback(s, d), "fp_rate"),
    "tactic_types": lambda s, d: A.read(s, d, "part").select("p_partkey", tactic_event_type(F.element_at(F.array(*[F.lit(x) for x in A.TACTICS]), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("event_type")),
}
_F = "FROM fin"
SQL = {
    "sliding_groups": f"WITH {A.ALERTS}, w AS (SELECT a.alert_id, a.us, a.src_ip, count(*) AS size, min(b.us) AS first_us, count(DISTINCT b.dst_ip) AS targets, count(DISTINCT b.event_type) AS kinds, max(b.severity) AS max_severity FROM alerts a JOIN alerts b ON a.src_ip = b.src_ip AND b.us BETWEEN a.us - {WINDOW} AND a.us GROUP BY 1, 2, 3) SELECT *, us - first_us AS span_us FROM w WHERE size >= 2",
    "session_gap": f"WITH {SESSION} SELECT src_ip, session, min(us) AS start_us, max(us) AS end_us, count(*) AS alerts, count(DISTINCT dst_ip) AS targets FROM ses GROUP BY 1, 2",
    "session_recent": f"WITH {SESSION} SELECT alert_id, src_ip, session FROM ses QUALIFY us >= max(us) OVER (PARTITION BY src_ip, session) - {WINDOW}",
    "session_expired": f"WITH {SESSION}, {_SHOWN} SELECT {_PATTERN_COLUMNS}, concat('session_expired_pattern_', pattern) AS reason FROM p WHERE 1706745600000000 - end_us > {GAP}",
    "attack_patterns": f"WITH {SESSION}, {_SHOWN} SELECT {_PATTERN_COLUMNS} FROM p",
    "candidate_groups": (
        f"WITH {SESSION}, {_SHOWN}, newest AS (SELECT *, max(us) OVER (PARTITION BY src_ip, session) AS nu FROM pl), g AS (SELECT src_ip, session, 'shared_source_proximity' AS reason, '' AS pattern, alert_id, {_BAD} AS bad FROM newest WHERE us >= nu - {WINDOW} "
        f"UNION ALL SELECT pl.src_ip, pl.session, concat('attack_pattern_', pattern), pattern, alert_id, {_BAD} FROM pl JOIN p ON p.src_ip = pl.src_ip AND p.session = pl.session WHERE CASE pattern WHEN 'scan_to_exfiltration' THEN n BETWEEN sc AND ex WHEN 'c2_beaconing' THEN event_type IN ('c2_beaconing', 'dns_tunneling', 'anomaly') WHEN 'lateral_movement' THEN event_type IN ('scan', 'lateral_movement') ELSE event_type = 'dns_tunneling' END), "
        "m AS (SELECT src_ip, session, reason, pattern, string_agg(CAST(alert_id AS VARCHAR), ',' ORDER BY alert_id) AS members FROM g GROUP BY 1, 2, 3, 4 HAVING NOT bool_or(bad) AND (pattern <> '' OR count(*) >= 2)) SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY src_ip, session, members ORDER BY pattern <> '') = 1"
    ),
    "fp_filter": f"WITH {SESSION} SELECT src_ip, session, count(*) AS alerts FROM ses GROUP BY 1, 2 HAVING NOT bool_or({_BAD})",
    "group_dedup": _DEDUP + "SELECT members, ord, reason, coalesce(pattern, '') AS pattern FROM a QUALIFY row_number() OVER (PARTITION BY members ORDER BY ord) = 1",
    "group_dedup_prefer_pattern": _DEDUP + "SELECT members, ord, reason, coalesce(pattern, '') AS pattern FROM a QUALIFY row_number() OVER (PARTITION BY members ORDER BY pattern IS NULL, ord) = 1",
    "group_metrics": f"WITH {GROUPS} SELECT * EXCLUDE (severity), round(severity, 9) AS severity FROM grp",
    "enrich_partial": f"WITH {ENRICHED} SELECT src_ip, session, criticality, coalesce(country, '') AS country, coalesce(tags, '') AS tags, failed_sources, failed_sources <> '' AS partial FROM en",
    "threat_intel_flags": f"WITH {ENRICHED} SELECT src_ip, session, malicious, suspicious FROM en",
    "severity_score": f"WITH {SCORED} SELECT src_ip, session, severity_score, severity_label {_F}",
    "severity_components": f"WITH {SCORED} SELECT src_ip, session, round(c_model, 9) AS c_model, c_asset, c_intel, round(c_history, 6) AS c_history, c_correlation {_F}",
    "incident_fallback": (
        f"WITH {SCORED}, {_SHOWN}, k AS (SELECT src_ip, session, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS kinds FROM ses GROUP BY 1, 2), x AS (SELECT fin.*, kinds, pattern, string_split(fin.hosts, ',')[1] AS host FROM fin JOIN k ON k.src_ip = fin.src_ip AND k.session = fin.session LEFT JOIN p ON p.src_ip = fin.src_ip AND p.session = fin.session) "
        "SELECT src_ip, session, severity_label, concat('Incidente correlacionado: ', kinds, ' (', alerts, ' alertas, severidad ', severity_score, ')') AS title, "
        "concat('Incidente correlacionado por scoring automático (LLM no disponible). ', alerts, ' alertas, severidad ', severity_score, '. Tipos de evento: ', kinds, '. Entidad: ', src_ip, '. ', CASE WHEN pattern IS NULL THEN '' ELSE concat('Patrón detectado: ', pattern, '.') END) AS description, "
        "concat('Las ', alerts, ' alertas comparten la misma entidad (', src_ip, ')', CASE WHEN pattern IS NULL THEN ' y ocurren en proximidad temporal' ELSE concat(' y siguen el patrón de ataque ', pattern) END, '.') AS correlation_reason, "
        "concat('Evaluación automática (sin LLM): ', CASE WHEN malicious THEN 'IP destino marcada como maliciosa en threat intel. FP descartado.' WHEN deviation > 5 THEN 'Desviación significativa del baseline histórico. FP improbable.' ELSE 'Datos insuficientes para evaluación automática. Requiere revisión manual.' END) AS false_positive_assessment, "
        "CASE severity_label WHEN 'critical' THEN concat('notify_soc:soc-team:immediate,create_ticket:thehive:immediate,isolate_host:', host, ':high') WHEN 'high' THEN 'notify_soc:soc-team:high,create_ticket:thehive:high' WHEN 'medium' THEN 'create_ticket:thehive:medium' ELSE 'log_only:opensearch:low' END AS actions, CASE severity_label WHEN 'critical' THEN 'isolate_host' ELSE '' END AS manual_actions FROM x"
    ),
    "incident_timeline": (
        f"WITH {SESSION} SELECT src_ip, session, concat(string_agg(concat(strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S'), CASE WHEN us % 1000000 > 0 THEN concat('.', lpad(CAST(us % 1000000 AS VARCHAR), 6, '0')) ELSE '' END, 'Z ', source_type, ' (', event_type, ') severidad ', severity), '; ' ORDER BY us, alert_id), "
        f"'; ', strftime(make_timestamp({PUBLISHED_US}), '%Y-%m-%dT%H:%M:%SZ'), ' {S.PUBLISHED}') AS timeline FROM ses GROUP BY 1, 2"
    ),
    "incident_entities": (
        f"WITH {SESSION}, {_first_of('host', 'fh')}, ho AS (SELECT src_ip, session, string_agg(host, ',' ORDER BY place) AS src_hosts FROM fh GROUP BY 1, 2), g AS (SELECT src_ip, session, CAST(src_ip AS VARCHAR) AS src_ips, array_to_string(list_transform(list_sort(list(DISTINCT dst_ip)), lambda x: CAST(x AS VARCHAR)), ',') AS dst_ips, count(*) AS alert_count, round((max(us) - min(us)) / 1000000, 6) AS time_span_seconds, "
        "count(DISTINCT source_type) AS unique_sources, count(DISTINCT dst_ip) AS unique_destinations FROM ses GROUP BY 1, 2) SELECT * FROM g JOIN ho USING (src_ip, session)"
    ),
    "action_payload": (
        f"WITH {SCORED}, both_ AS (SELECT src_ip, session, hosts, severity_score AS score, false AS raised FROM fin UNION ALL SELECT src_ip, session, hosts, least(100, severity_score + 20), true FROM fin), l AS (SELECT *, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS label, string_split(hosts, ',')[1] AS host FROM both_) "
        "SELECT src_ip, session, raised, concat('brain-', label, '-response') AS playbook, CASE label WHEN 'critical' THEN 'notify_soc:soc-team:immediate,create_ticket:thehive:immediate' WHEN 'high' THEN 'notify_soc:soc-team:high,create_ticket:thehive:high' WHEN 'medium' THEN 'create_ticket:thehive:medium' ELSE 'log_only:opensearch:low' END AS auto_execute_actions, "
        "CASE label WHEN 'critical' THEN concat('isolate_host:', host, ':high') ELSE '' END AS manual_review_actions FROM l"
    ),
    "bonus_applied": f"WITH {SCORED} SELECT src_ip, session, (c_intel >= 100 AND c_asset >= 80) OR (c_correlation >= 100 AND c_model >= 70) AS bonus_applied FROM fin",
    "alert_groups": (
        f"WITH {SESSION}, nn AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY us, alert_id) AS place, coalesce({_BAD}, false) AS kn FROM ses), "
        f"w AS (SELECT a.alert_id, count(*) AS size, min(b.place) AS f, bool_or(b.kn) AS bad FROM nn a JOIN nn b ON a.src_ip = b.src_ip AND b.place BETWEEN a.place - 999 AND a.place AND b.us >= a.us - {WINDOW} GROUP BY 1), "
        "q AS (SELECT a.alert_id, count(*) AS n, min(b.place) FILTER (b.event_type = 'scan') AS sc, min(b.place) FILTER (b.event_type = 'exfiltration') AS ex, count(*) FILTER (b.event_type = 'c2_beaconing') AS c2, count(*) FILTER (b.event_type = 'lateral_movement') AS lat, count(*) FILTER (b.event_type = 'scan') AS scans, count(*) FILTER (b.event_type = 'dns_tunneling') AS dn "
        "FROM nn a JOIN nn b ON a.src_ip = b.src_ip AND a.session = b.session AND b.place <= a.place GROUP BY 1), "
        "t AS (SELECT alert_id, sc, ex, CASE WHEN n < 2 THEN NULL WHEN sc < ex THEN 'scan_to_exfiltration' WHEN c2 > 0 THEN 'c2_beaconing' WHEN scans > 0 AND lat > 0 THEN 'lateral_movement' WHEN dn > 0 THEN 'dns_tunneling' END AS pattern FROM q), "
        "m AS (SELECT a.alert_id, t.pattern, count(*) AS size, min(b.place) AS f, max(b.place) AS l, bool_or(b.kn) AS bad FROM nn a JOIN t USING (alert_id) JOIN nn b ON a.src_ip = b.src_ip AND a.session = b.session AND b.place <= a.place WHERE CASE pattern WHEN 'scan_to_exfiltration' THEN b.place BETWEEN sc AND ex "
        "WHEN 'c2_beaconing' THEN b.event_type IN ('c2_beaconing', 'dns_tunneling', 'anomaly') WHEN 'lateral_movement' THEN b.event_type IN ('scan', 'lateral_movement') WHEN 'dns_tunneling' THEN b.event_type = 'dns_tunneling' ELSE false END GROUP BY 1, 2) "
        "SELECT alert_id, us, src_ip, session, 'shared_source_proximity' AS reason, '' AS pattern, size, f AS first_place, place AS last_place FROM nn JOIN w USING (alert_id) WHERE size >= 2 AND NOT bad "
        "UNION ALL SELECT m.alert_id, us, src_ip, session, concat('attack_pattern_', pattern), pattern, m.size, m.f, m.l FROM m JOIN nn USING (alert_id) JOIN w USING (alert_id) WHERE NOT m.bad AND NOT (w.size >= 2 AND NOT w.bad AND w.size = m.size AND m.f >= w.f)"
    ),
    "range_lookup": (
        "WITH o AS (SELECT o_orderkey, 167772160 + o_orderkey % 65536 AS number, concat(CASE WHEN o_custkey % 3 = 0 THEN 'hash:' ELSE '' END, '10.0.', o_orderkey // 256 % 256, '.', o_orderkey % 256) AS address, o_custkey % 3 <> 0 AS plain FROM orders), "
        "r AS (SELECT 167772160 + c_custkey * 7 AS first, 167772160 + c_custkey * 7 + c_custkey * 13 % 300 AS last, c_custkey FROM customer), u AS (SELECT DISTINCT number FROM o WHERE plain), "
        "f AS (SELECT number, c_custkey, last - first AS width FROM u JOIN r ON number BETWEEN first AND last QUALIFY row_number() OVER (PARTITION BY number ORDER BY last - first, first, last, c_custkey) = 1) "
        "SELECT o_orderkey, address, coalesce(CASE WHEN plain THEN c_custkey END, -1) AS c_custkey, coalesce(CASE WHEN plain THEN width END, -1) AS width FROM o LEFT JOIN f USING (number)"
    ),
    "entity_extract": r"WITH e AS (SELECT doc_id, regexp_extract_all(text, '(?i)\b[0-9a-f]{32,64}\b') AS h, regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b') AS i, regexp_extract_all(text, '\b[A-Z][A-Z0-9-]{2,}(?:\.[A-Za-z0-9-]+)*\b') AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[^\x00-\x7F\P{L}]', '_', 'g'), '[^\x00-\x7F\P{N}]', '_', 'g') AS text FROM documents)) SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(i, h))), ',') AS ips, array_to_string(list_sort(list_distinct(n)), ',') AS hosts, len(list_distinct(h)) AS hashes FROM e",
    "entity_except": "WITH w AS (SELECT DISTINCT conv_id, coalesce(role = 'assistant', false) AS mine, unnest(regexp_extract_all(coalesce(text, ''), '[a-z]+')) AS word FROM conversations), u AS (SELECT conv_id, word FROM w WHERE mine EXCEPT SELECT conv_id, word FROM w WHERE NOT mine) SELECT c.conv_id, count(u.word) AS unsupported FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) c LEFT JOIN u USING (conv_id) GROUP BY 1",
    "tag_overlap": f"WITH {A.ALERTS} SELECT alert_id, event_type = 'scan' OR source_type = 'host' AS suspicious FROM alerts",
    "validate_accept": f"WITH {A.ALERTS} SELECT alert_id FROM alerts WHERE severity BETWEEN 5 AND 90 AND confidence BETWEEN 0.05 AND 0.95 AND event_type <> 'dns_tunneling'",
    "validate_reject": f"WITH {A.ALERTS}, e AS (SELECT alert_id, concat_ws(',', CASE WHEN NOT severity BETWEEN 5 AND 90 THEN 'severity' END, CASE WHEN NOT confidence BETWEEN 0.05 AND 0.95 THEN 'confidence' END, CASE WHEN event_type = 'dns_tunneling' THEN 'event_type' END) AS error FROM alerts) SELECT * FROM e WHERE error <> ''",
    "weekly_report": f"WITH {A.ALERTS} SELECT event_type, count(*) AS n, count(*) FILTER (backup OR severity < 10) AS false_positives, round(count(*) FILTER (backup OR severity < 10) / count(*), 6) AS fp_rate FROM alerts GROUP BY 1",
    "tactic_types": "SELECT p_partkey, (ARRAY['c2_beaconing', 'lateral_movement', 'exfiltration', 'scan', 'credential_theft', 'anomaly'])[p_partkey % 6 + 1] AS event_type FROM part",
}
