"""Queries over flows and look-ups: rollups, features, baselines, panels and topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import privacy, scalars
from flowlens.operators import baseline, features, rollups
from flowlens.sources import adapters as A

DAY = A.DAY
W = 6 * A.HOUR
ROUND = 6


def rounded(df, *columns):
    return df.withColumns({c: F.round(F.col(c), ROUND) for c in columns})


def _hourly_sql(key: str) -> str:
    peer = "dst_ip" if key == "src_ip" else "src_ip"
    return f"WITH {A.CONN} SELECT us - us % 3600000000 AS bucket_us, {key}, count(*) AS connections, CAST(sum(orig_bytes + resp_bytes) AS BIGINT) AS bytes_total, CAST(sum(orig_pkts + resp_pkts) AS BIGINT) AS pkts_total, count(DISTINCT {peer}) AS unique_peers, count(DISTINCT dst_port) AS unique_ports FROM conn GROUP BY ALL"


HOSTS = (
    f"{A.CONN}, {A.DNS}, hosts AS (SELECT coalesce(c.src_ip, d.src_ip) AS src_ip, coalesce(unique_destinations, 0) AS unique_destinations, coalesce(unique_ports, 0) AS unique_ports, coalesce(dns_queries_count, 0) AS dns_queries_count, coalesce(nxdomain_ratio, 0) AS nxdomain_ratio, coalesce(avg_dns_query_length, 0) AS avg_dns_query_length "
    "FROM (SELECT src_ip, count(DISTINCT dst_ip) AS unique_destinations, count(DISTINCT dst_port) AS unique_ports FROM conn GROUP BY 1) c FULL JOIN (SELECT src_ip, count(*) AS dns_queries_count, avg(CASE WHEN rcode IN ('NXDOMAIN', 'SERVFAIL') THEN 1.0::DOUBLE ELSE 0 END) AS nxdomain_ratio, avg(length(query)) AS avg_dns_query_length FROM dns GROUP BY 1) d ON c.src_ip = d.src_ip)"
)
FEATURES = (
    f"{HOSTS}, feats AS (SELECT uid, us, c.src_ip, c.dst_ip, duration, orig_bytes, resp_bytes, orig_pkts, resp_pkts, orig_bytes + resp_bytes AS bytes_total, CASE WHEN orig_bytes + resp_bytes > 0 THEN orig_bytes / (orig_bytes + resp_bytes) ELSE 0 END AS bytes_ratio, c.dst_port, c.dst_port IN (80, 443, 22, 53, 25, 445, 3389) AS is_common_port, "
    "CAST(us // 3600000000 % 24 AS INTEGER) AS hour_of_day, CAST((us // 86400000000 + 3) % 7 AS INTEGER) AS day_of_week, (us // 86400000000 + 3) % 7 >= 5 AS is_weekend, coalesce(unique_destinations, 0) AS unique_destinations, coalesce(unique_ports, 0) AS unique_ports, coalesce(dns_queries_count, 0) AS dns_queries_count, coalesce(nxdomain_ratio, 0) AS nxdomain_ratio, coalesce(avg_dns_query_length, 0) AS avg_dns_query_length FROM conn c LEFT JOIN hosts h ON c.src_ip = h.src_ip)"
)
BASE = (
    f"{A.CONN}, {A.DNS}, long AS (SELECT src_ip, service, unnest(['orig_bytes', 'resp_bytes', 'duration', 'pkts']) AS metric, unnest([orig_bytes::DOUBLE, resp_bytes::DOUBLE, duration, (orig_pkts + resp_pkts)::DOUBLE]) AS v, uid FROM conn), "
    "const AS (SELECT c.src_ip, service, count(DISTINCT dst_ip) AS a, count(DISTINCT dst_port) AS b, coalesce(any_value(n), 0) AS q, count(*) AS sample_count FROM conn c LEFT JOIN (SELECT src_ip, count(*) AS n FROM dns GROUP BY 1) d ON c.src_ip = d.src_ip GROUP BY 1, 2), "
    "wide AS (SELECT src_ip, service, unnest(['unique_destinations', 'unique_ports', 'dns_queries']) AS metric, unnest([a::DOUBLE, b::DOUBLE, q::DOUBLE]) AS v, sample_count FROM const), "
    "base AS (SELECT src_ip, service, metric, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min_val, max(v) AS max_val, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99, count(*) AS sample_count FROM long GROUP BY 1, 2, 3 UNION ALL SELECT src_ip, service, metric, v, 0, v, v, v, v, v, sample_count FROM wide)"
)
_SUM = lambda c: f"CAST(sum({c}) AS BIGINT)"
_ROUNDED_HOSTS = "unique_destinations, unique_ports, dns_queries_count, round(nxdomain_ratio, 6) AS nxdomain_ratio, round(avg_dns_query_length, 6) AS avg_dns_query_length"


def _scaled(spark, d):
    rows = features.event_features(A.conn(spark, d), A.dns(spark, d))
    columns = ("duration", "bytes_total", "bytes_ratio", "unique_destinations")
    scaled = features.scale(rows, features.fit_scaler(rows, columns))
    return rounded(scaled.select("uid", *columns), *columns)


def _assets(spark, d):
    return A.read(spark, d, "supplier").select(F.col("s_suppkey").alias("ip"), F.concat(F.lit("device-"), F.col("s_nationkey").cast("string")).alias("device"))


def _active_links(spark, d):
    pairs = rollups.edges(A.conn(spark, d)).withColumn("score", scalars.link_score("bytes_total"))
    return pairs.select("src_ip", "dst_ip", "bytes_total", "score", scalars.link_is_anomalous("conn_state", F.col("score")).alias("is_anomaly"))


def _zones(spark, d):
    nets = F.array(*[F.lit(x) for x in ("10.0.0.", "10.1.0.", "10.2.0.", "10.3.0.", "10.9.0.", "192.168.1.", "172.16.0.", "8.8.8.", "0123456789abcdef")])
    flows = A.conn(spark, d).select(F.concat(F.element_at(nets, (F.col("src_ip") % 9 + 1).cast("int")), F.col("src_ip").cast("string")).alias("ip"))
    return flows.groupBy(scalars.zone("ip").alias("zone")).agg(F.count("*").alias("n")).withColumn("kind", scalars.zone_kind("zone"))


QUERIES = {
    "rollup_hourly_src": lambda s, d: rollups.hourly(A.conn(s, d), "src_ip"),
    "rollup_hourly_dst": lambda s, d: rollups.hourly(A.conn(s, d), "dst_ip"),
    "historical_by_dst": lambda s, d: rounded(rollups.historical(A.conn(s, d)), "bytes_p99", "deviation"),
    "historical_top_dst": lambda s, d: rollups.top_peer(A.conn(s, d)),
    "host_aggregates": lambda s, d: rounded(features.host_aggregates(A.conn(s, d), A.dns(s, d)), "nxdomain_ratio", "avg_dns_query_length"),
    "event_features": lambda s, d: rounded(features.event_features(A.conn(s, d), A.dns(s, d)), "bytes_ratio", "nxdomain_ratio", "avg_dns_query_length"),
    "window_features": lambda s, d: rounded(features.window_features(A.conn(s, d), A.dns(s, d), W), "avg_duration", "nxdomain_ratio"),
    "scaled_features": _scaled,
    "baseline_stats": lambda s, d: baseline.baselines(A.conn(s, d), A.dns(s, d)).withColumns({c: F.round(c, 9) for c in baseline.STATS}),
    "baseline_compare": lambda s, d: rounded(baseline.compare(A.conn(s, d), baseline.baselines(A.conn(s, d), A.dns(s, d))), "value", "z", "ratio"),
    "panel_bytes_over_time": lambda s, d: rollups.panel(A.conn(s, d), "sum", "orig_bytes", interval=A.HOUR),
    "panel_top_talkers": lambda s, d: rollups.panel(A.conn(s, d), "sum", "orig_bytes", by=("src_ip",), size=10),
    "panel_cardinality": lambda s, d: rollups.panel(A.conn(s, d), "cardinality", "dst_ip", by=("service",)),
    "panel_filtered_avg": lambda s, d: rounded(rollups.panel(A.alerts(s, d), "avg", "severity", interval=DAY, where="event_type = 'scan'"), "metric"),
    "panel_two_level_terms": lambda s, d: rollups.panel(A.conn(s, d), "count", by=("src_ip", "conn_state")),
    "panel_filter_counts": lambda s, d: rollups.panel(A.scores(s, d), "count", by=("model_name",), where="score > 0.7"),
    "panel_min_max": lambda s, d: rollups.panel(A.conn(s, d), "min", "orig_bytes", by=("service",)).join(rollups.panel(A.conn(s, d), "max", "orig_bytes", by=("service",)).select("service", F.col("metric").alias("most")), "service"),
    "panel_score_histogram": lambda s, d: rollups.histogram(A.events(s, d).select(F.col("value").alias("score")), "score", 25.0),
    "severity_distribution": lambda s, d: A.alerts(s, d).groupBy(scalars.severity_label("severity").alias("label")).agg(F.count("*").alias("n")).withColumn("playbook", scalars.playbook("label")),
    "severity_at_least_high": lambda s, d: A.alerts(s, d).withColumn("label", scalars.severity_label("severity")).where(scalars.at_least("label", "HIGH")).select("alert_id", "label"),
    "source_type_distribution": lambda s, d: A.alerts(s, d).groupBy("src_ip").agg(F.collect_set("source_type").alias("types")).select(F.explode("types").alias("source_type")).groupBy("source_type").agg(F.count("*").alias("n")),
    "topology_edges": lambda s, d: rollups.device_edges(rollups.edges(A.conn(s, d)), _assets(s, d)),
    "topology_devices": lambda s, d: rollups.devices(A.conn(s, d)).withColumn("risk", scalars.device_risk("as_src", 80, 60, 40)),
    "topology_zones": _zones,
    "active_links": _active_links,
    "line_rollup_daily": lambda s, d: A.flows_by_line(s, d).groupBy("us", "src_ip").agg(F.count("*").alias("connections"), F.sum("bytes").alias("bytes_total"), F.countDistinct("dst_ip").alias("unique_destinations")),
    "latest_by_key": lambda s, d: rollups.latest_by_key(A.alerts(s, d), ["src_ip", "event_type"], ["us", "alert_id"]).select("src_ip", "event_type", "alert_id", "us"),
    "latest_events": lambda s, d: rollups.latest(A.alerts(s, d), 100).select("alert_id", "us", "event_type"),
    "retention_filter": lambda s, d: rollups.retained(A.alerts(s, d), 10, 1_706_745_600_000_000).select("alert_id", "us"),
    "pseudonymize": lambda s, d: A.conn(s, d).select("uid", privacy.pseudonym("src_ip", "salt").alias("src_hash"), privacy.short_pseudonym("dst_ip", "salt").alias("dst_hash"), privacy.indexed_pseudonym("src_ip", "salt").alias("src_pseudo")),
    "pseudonym_detect": lambda s, d: A.read(s, d, "pages").select("page_id", privacy.is_pseudonym("url").alias("is_pseudonym"), privacy.vendor_pseudonym("url", "salt").alias("vendor")),
    "bytes_ratio_variants": lambda s, d: rounded(A.conn(s, d).select("uid", scalars.sent_per_received("orig_bytes", "resp_bytes").alias("bytes_ratio_or"), scalars.share_sent("orig_bytes", F.col("orig_bytes") + F.col("resp_bytes")).alias("bytes_ratio")), "bytes_ratio_or", "bytes_ratio"),
}
SQL = {
    "rollup_hourly_src": _hourly_sql("src_ip"),
    "rollup_hourly_dst": _hourly_sql("dst_ip"),
    "historical_by_dst": f"WITH {A.CONN} SELECT dst_ip, min(us) AS first_seen_us, round(quantile_cont(orig_bytes, 0.99), 6) AS bytes_p99, {_SUM('orig_bytes')} AS bytes_sum, CASE WHEN quantile_cont(orig_bytes, 0.99) > 0 THEN round(sum(orig_bytes) / quantile_cont(orig_bytes, 0.99), 6) ELSE 0 END AS deviation FROM conn GROUP BY 1",
    "historical_top_dst": f"WITH {A.CONN} SELECT src_ip, dst_ip, bytes_sum FROM (SELECT src_ip, dst_ip, {_SUM('orig_bytes')} AS bytes_sum FROM conn GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY bytes_sum DESC, dst_ip) = 1",
    "host_aggregates": f"WITH {HOSTS} SELECT src_ip, {_ROUNDED_HOSTS} FROM hosts",
    "event_features": f"WITH {FEATURES} SELECT * EXCLUDE (bytes_ratio, {', '.join(features.HOST_COLUMNS)}), round(bytes_ratio, 6) AS bytes_ratio, {_ROUNDED_HOSTS} FROM feats",
    "window_features": f"WITH {A.CONN}, {A.DNS}, o AS (SELECT min(us) AS origin FROM conn), cw AS (SELECT src_ip, us - ((us - origin) % {W} + {W}) % {W} AS window_us, {_SUM('orig_bytes')} AS bytes_out, {_SUM('resp_bytes')} AS bytes_in, {_SUM('orig_pkts + resp_pkts')} AS pkts_total, count(DISTINCT dst_ip) AS unique_destinations, count(DISTINCT dst_port) AS unique_ports, round(avg(duration), 6) AS avg_duration, count(*) AS connection_count FROM conn, o GROUP BY 1, 2), dw AS (SELECT src_ip, us - ((us - origin) % {W} + {W}) % {W} AS window_us, count(*) AS dns_queries, avg(CASE WHEN rcode IN ('NXDOMAIN', 'SERVFAIL') THEN 1.0::DOUBLE ELSE 0 END) AS nx FROM dns, o GROUP BY 1, 2) SELECT cw.*, coalesce(dns_queries, 0) AS dns_queries, round(coalesce(nx, 0), 6) AS nxdomain_ratio FROM cw LEFT JOIN dw USING (src_ip, window_us)",
    "scaled_features": f"WITH {FEATURES}, st AS (SELECT avg(duration) m1, stddev_pop(duration) s1, avg(bytes_total) m2, stddev_pop(bytes_total) s2, avg(bytes_ratio) m3, stddev_pop(bytes_ratio) s3, avg(unique_destinations) m4, stddev_pop(unique_destinations) s4 FROM feats) SELECT uid, round((duration - m1) / (CASE WHEN s1 = 0 THEN 1 ELSE s1 END), 6) AS duration, round((bytes_total - m2) / (CASE WHEN s2 = 0 THEN 1 ELSE s2 END), 6) AS bytes_total, round((bytes_ratio - m3) / (CASE WHEN s3 = 0 THEN 1 ELSE s3 END), 6) AS bytes_ratio, round((unique_destinations - m4) / (CASE WHEN s4 = 0 THEN 1 ELSE s4 END), 6) AS unique_destinations FROM feats, st",
    "baseline_stats": f"WITH {BASE} SELECT src_ip, service, metric, {', '.join(f'round({c}, 9) AS {c}' for c in baseline.STATS)}, sample_count FROM base",
    "baseline_compare": f"WITH {BASE} SELECT uid, metric, round(v, 6) AS value, round(z, 6) AS z, round(r, 6) AS ratio, coalesce(std, 0) > 0 AND (abs(z) > 3 OR r > 1) AS is_anomalous FROM (SELECT uid, l.metric, v, std, CASE WHEN std > 0 THEN (v - mean) / std ELSE 0 END AS z, CASE WHEN p99 > 0 THEN v / p99 ELSE 0 END AS r FROM long l LEFT JOIN base b ON l.src_ip = b.src_ip AND l.service = b.service AND l.metric = b.metric)",
    "panel_bytes_over_time": f"WITH {A.CONN} SELECT us - us % 3600000000 AS bucket_us, {_SUM('orig_bytes')} AS metric, count(*) AS doc_count FROM conn GROUP BY 1",
    "panel_top_talkers": f"WITH {A.CONN} SELECT src_ip, {_SUM('orig_bytes')} AS metric, count(*) AS doc_count FROM conn GROUP BY 1 ORDER BY doc_count DESC, src_ip LIMIT 10",
    "panel_cardinality": f"WITH {A.CONN} SELECT service, count(DISTINCT dst_ip) AS metric, count(*) AS doc_count FROM conn GROUP BY 1",
    "panel_filtered_avg": f"WITH {A.ALERTS} SELECT us - us % {DAY} AS bucket_us, round(avg(CASE WHEN event_type = 'scan' THEN severity END), 6) AS metric, count(*) AS doc_count FROM alerts GROUP BY 1",
    "panel_two_level_terms": f"WITH {A.CONN} SELECT src_ip, conn_state, count(*) AS metric, count(*) AS doc_count FROM conn GROUP BY 1, 2",
    "panel_filter_counts": f"WITH {A.SCORES} SELECT model_name, count(CASE WHEN score > 0.7 THEN 1 END) AS metric, count(*) AS doc_count FROM scores GROUP BY 1",
    "panel_min_max": f"WITH {A.CONN} SELECT service, min(orig_bytes) AS metric, count(*) AS doc_count, max(orig_bytes) AS most FROM conn GROUP BY 1",
    "panel_score_histogram": "SELECT CAST(floor(value / 25.0) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1",
    "severity_distribution": f"WITH {A.ALERTS}, l AS (SELECT CASE WHEN severity >= 80 THEN 'critical' WHEN severity >= 60 THEN 'high' WHEN severity >= 40 THEN 'medium' ELSE 'low' END AS label FROM alerts) SELECT label, count(*) AS n, CASE label WHEN 'critical' THEN 'isolate-host' WHEN 'high' THEN 'block-and-investigate' WHEN 'medium' THEN 'investigate' ELSE 'log-only' END AS playbook FROM l GROUP BY 1",
    "severity_at_least_high": f"WITH {A.ALERTS} SELECT alert_id, CASE WHEN severity >= 80 THEN 'critical' ELSE 'high' END AS label FROM alerts WHERE severity >= 60",
    "source_type_distribution": f"WITH {A.ALERTS} SELECT source_type, count(*) AS n FROM (SELECT DISTINCT src_ip, source_type FROM alerts) GROUP BY 1",
    "topology_edges": f"WITH {A.CONN}, e AS (SELECT src_ip, dst_ip, count(*) AS n, sum(orig_bytes + resp_bytes) AS b FROM conn WHERE src_ip <> dst_ip GROUP BY 1, 2), dv AS (SELECT s_suppkey AS ip, concat('device-', CAST(s_nationkey AS VARCHAR)) AS device FROM supplier) SELECT x.device AS from_device, y.device AS to_device, {_SUM('n')} AS connections, {_SUM('b')} AS bytes_total FROM e JOIN dv x ON src_ip = x.ip JOIN dv y ON dst_ip = y.ip WHERE x.device <> y.device GROUP BY 1, 2",
    "topology_devices": f"WITH {A.CONN} SELECT ip, {_SUM('a')} AS as_src, {_SUM('b')} AS as_dst, CASE WHEN sum(a) > 80 THEN 'critical' WHEN sum(a) > 60 THEN 'high' WHEN sum(a) > 40 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT src_ip AS ip, 1 AS a, 0 AS b FROM conn UNION ALL SELECT dst_ip, 0, 1 FROM conn) GROUP BY 1",
    "topology_zones": f"WITH {A.CONN}, z AS (SELECT (ARRAY['dmz', 'core', 'lan', 'iot', 'lan', 'lan', 'lan', 'internet', 'internet'])[src_ip % 9 + 1] AS zone FROM conn) SELECT zone, count(*) AS n, (MAP {{'internet': 'external', 'dmz': 'server', 'core': 'server', 'lan': 'workstation', 'iot': 'iot'}})[zone] AS kind FROM z GROUP BY 1",
    "active_links": f"WITH {A.CONN}, e AS (SELECT src_ip, dst_ip, {_SUM('orig_bytes + resp_bytes')} AS bytes_total, max(conn_state) AS st FROM conn WHERE src_ip <> dst_ip GROUP BY 1, 2), f AS (SELECT *, CASE WHEN bytes_total > 1000000 THEN 0.85::DOUBLE WHEN bytes_total > 100000 THEN 0.55::DOUBLE ELSE 0.25::DOUBLE END AS score FROM e) SELECT src_ip, dst_ip, bytes_total, score, st IN ('S0', 'REJ', 'S1') OR score > 0.7 AS is_anomaly FROM f",
    "line_rollup_daily": f"WITH {A.LINES} SELECT us, src_ip, count(*) AS connections, {_SUM('bytes')} AS bytes_total, count(DISTINCT dst_ip) AS unique_destinations FROM line GROUP BY 1, 2",
    "latest_by_key": f"WITH {A.ALERTS} SELECT src_ip, event_type, alert_id, us FROM alerts QUALIFY row_number() OVER (PARTITION BY src_ip, event_type ORDER BY us DESC, alert_id DESC) = 1",
    "latest_events": f"WITH {A.ALERTS} SELECT alert_id, us, event_type FROM alerts ORDER BY us DESC, alert_id DESC LIMIT 100",
    "retention_filter": f"WITH {A.ALERTS} SELECT alert_id, us FROM alerts WHERE us > 1706745600000000 - 10 * {DAY}",
    "pseudonymize": f"WITH {A.CONN} SELECT uid, sha256(concat('salt:', src_ip::VARCHAR)) AS src_hash, left(sha256(concat('salt:', dst_ip::VARCHAR)), 16) AS dst_hash, concat('sha256:', left(sha256(concat('salt', src_ip::VARCHAR)), 16)) AS src_pseudo FROM conn",
    "pseudonym_detect": "SELECT page_id, starts_with(url, 'hash:') OR length(url) > 39 OR regexp_full_match(url, '[0-9a-fA-F]{32,}') AS is_pseudonym, CASE WHEN url IS NULL OR url = '' THEN 'unknown' WHEN regexp_matches(url, '[.:]') THEN sha256(concat('salt:', CASE WHEN url = '-' THEN '0.0.0.0' ELSE url END)) ELSE url END AS vendor FROM pages",
    "bytes_ratio_variants": f"WITH {A.CONN} SELECT uid, round(CASE WHEN resp_bytes > 0 THEN orig_bytes / resp_bytes ELSE 1 END, 6) AS bytes_ratio_or, round(CASE WHEN orig_bytes + resp_bytes > 0 THEN orig_bytes / (orig_bytes + resp_bytes) ELSE 0 END, 6) AS bytes_ratio FROM conn",
}
