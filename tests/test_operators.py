"""Small cases with results worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions import entities, privacy, scalars
from flowlens.operators import correlate, detectors, features, labels, matching, ranges, rollups, severity, tuning
from flowlens.plans import correlation
from flowlens.sources import generate, logs, sinks

S = 1_000_000
CONN = "uid string, us long, src_ip string, dst_ip string, dst_port int, service string, duration double, orig_bytes long, resp_bytes long, orig_pkts long, resp_pkts long"


def one(frame):
    return frame.first()


def flows(spark):
    rows = [(f"n{i}", 30 * i * S, "A" if i % 2 == 0 else "B", "X" if i % 2 == 0 else "Y", 443 if i % 2 == 0 else 80, "ssl", 0.5 + 0.1 * i, 1000 + 100 * i, 5000 + 200 * i, 5 + i, 10 + i) for i in range(18)]
    rows += [("exfil", 600 * S, "A", "Y", 443, "ssl", 300.0, 50_000_000, 100, 50_000, 10), ("scan", 630 * S, "B", "Z", 22, None, 0.01, 50, 0, 1, 0)]
    return spark.createDataFrame(rows, CONN)


def lookups(spark):
    rows = [(f"d{i}", 60 * i * S, "A" if i % 2 == 0 else "B", f"host{i}.example.com", "NOERROR") for i in range(8)]
    rows += [("x1", 500 * S, "A", "nonexistent.evil.com", "NXDOMAIN"), ("x2", 510 * S, "A", "nonexistent.evil.com", "NXDOMAIN")]
    return spark.createDataFrame(rows, "uid string, us long, src_ip string, query string, rcode string")


def test_host_and_window_features(spark):
    from flowlens.operators import features

    hosts = {r["src_ip"]: r for r in features.host_aggregates(flows(spark), lookups(spark)).collect()}
    assert (hosts["A"]["unique_destinations"], hosts["A"]["unique_ports"], hosts["A"]["dns_queries_count"]) == (2, 1, 6)
    assert hosts["A"]["nxdomain_ratio"] == pytest.approx(1 / 3) and hosts["A"]["avg_dns_query_length"] == pytest.approx(18)
    assert (hosts["B"]["unique_destinations"], hosts["B"]["unique_ports"], hosts["B"]["nxdomain_ratio"]) == (2, 2, 0)
    got = {(r["window_us"] // S, r["src_ip"]): r for r in features.window_features(flows(spark), lookups(spark)).collect()}
    assert {k: r["connection_count"] for k, r in got.items()} == {(0, "A"): 5, (0, "B"): 5, (300, "A"): 4, (300, "B"): 4, (600, "A"): 1, (600, "B"): 1}
    assert (got[(300, "A")]["dns_queries"], got[(600, "B")]["bytes_out"]) == (3, 50) and got[(300, "A")]["nxdomain_ratio"] == pytest.approx(2 / 3)
    assert got[(600, "A")]["bytes_out"] == 50_000_000


def test_alignment_reaches_ties_and_reuse(spark):
    scores = spark.createDataFrame([(f"n{i}", 10 * i * S) for i in range(8)] + [(f"a{i}", (100 + 10 * i) * S) for i in range(2)], "event_id string, us long").withColumn("src_ip", F.lit("A")).withColumn("dst_ip", F.lit("X"))
    found = spark.createDataFrame([("l0", 102 * S, True), ("l1", 112 * S, True)], "label_id string, us long, label boolean").withColumn("src_ip", F.lit("A")).withColumn("dst_ip", F.lit("X"))
    aligned = matching.align_labels(scores, found)
    rows = {r["event_id"]: r for r in aligned.collect()}
    assert [rows[f"n{i}"]["distance_us"] for i in range(8)] == [None, None, *[d * S for d in (82, 72, 62, 52, 42, 32)]]
    assert rows["a0"]["label_id"] == "l0" and rows["a1"]["label_id"] == "l1" and rows["n0"]["label"] is False
    summary = one(matching.alignment_summary(aligned))
    assert (summary["total"], summary["matched"], summary["avg_distance_us"]) == (10, 8, 43.25 * S) and summary["avg_confidence"] == pytest.approx(1 - 43.25 / 90)
    tie = matching.align_labels(spark.createDataFrame([("e", 10 * S, "A", "X")], "event_id string, us long, src_ip string, dst_ip string"), spark.createDataFrame([("late", 15 * S, "A", "X", True), ("early", 5 * S, "A", "X", False)], "label_id string, us long, src_ip string, dst_ip string, label boolean"))
    assert one(tie)["label_id"] == "early"
    edge = matching.align_labels(spark.createDataFrame([("e", 0, "A", "X")], "event_id string, us long, src_ip string, dst_ip string"), spark.createDataFrame([("l", 90 * S, "A", "X", True)], "label_id string, us long, src_ip string, dst_ip string, label boolean"))
    assert one(edge)["label"] is True and one(edge)["match_confidence"] == 0


def votes(spark, rows):
    return spark.createDataFrame(rows, "event_id string, us long, source string, label boolean, confidence double, event_type string, ord long")


def test_consensus(spark):
    got = {r["event_id"]: r for r in labels.consensus(votes(spark, [
        ("one", 1, "ids", True, 0.9, "scan", 0), ("split", 1, "ids", True, 0.9, None, 0), ("split", 2, "hids", False, 0.5, "x", 1), ("none", 1, "ids", None, 0.9, None, 0),
        ("over", 1, "ids", True, 0.9, None, 0), ("over", 2, "analyst", False, 1.0, None, 1), ("over", 3, "analyst", True, 1.0, None, 2), ("zero", 1, "ids", True, 0.0, None, 0), (None, 1, "ids", True, 1.0, None, 0),
        ("", 1, "ids", True, 1.0, None, 0), ("near", 1, "hids", True, 0.5, None, 0), ("near", 2, "hids", False, 0.47, None, 1), ("tie", 1, "hids", True, 0.5, None, 0), ("tie", 2, "hids", False, 0.5, None, 1),
        ("late", 5, "ids", None, 0.9, "scan", 0), ("late", 9, "hids", True, 0.9, "", 1), ("late", 9, "intel", True, 0.9, "x", 2), ("same", 3, "analyst", False, 1.0, None, 1), ("same", 3, "analyst", True, 1.0, None, 2),
    ])).collect()}
    assert set(got) == {"one", "split", "over", "near", "tie", "late", "same"}
    assert got["one"]["label"] and got["one"]["confidence"] == pytest.approx(1.0) and got["one"]["event_type"] == "scan"
    assert got["split"]["score"] == pytest.approx((1.08 - 0.5) / 1.58) and got["split"]["event_type"] == "x"
    assert got["over"]["label"] and got["over"]["confidence"] == 1 and got["over"]["votes_positive"] == 0 and got["over"]["breakdown"] == {}
    # A narrow majority is a label, a tie is the negative one: nothing is held back below a score of 0.
    assert got["near"]["label"] and got["near"]["confidence"] == pytest.approx(0.03 / 0.97) and (got["tie"]["label"], got["tie"]["confidence"]) == (False, 0)
    # Abstentions are dropped first: they lend neither their time nor their type, and are not counted.
    assert (got["late"]["us"], got["late"]["event_type"], got["late"]["votes_abstain"], got["late"]["sources"]) == (9, "x", 0, "hids,intel")
    assert {k: tuple(v) for k, v in got["split"]["breakdown"].items()} == {"ids": (True, 0.9, 1.2), "hids": (False, 0.5, 1.0)}
    assert {k: tuple(v) for k, v in got["near"]["breakdown"].items()} == {"hids": (False, 0.47, 1.0)}  # the last vote of a source
    assert got["same"]["label"] is False  # of two latest the first
    plain = {r["event_id"]: r for r in labels.consensus(votes(spark, [("over", 1, "ids", True, 0.9, None, 0), ("over", 2, "analyst", False, 1.0, None, 1)]), analyst=None).collect()}
    assert plain["over"]["label"] is False
    held = labels.consensus(votes(spark, [("near", 1, "hids", True, 0.5, None, 0), ("near", 2, "hids", False, 0.47, None, 1)]), abstain=0.1)
    assert held.count() == 0


def test_consensus_keeps_addresses_and_technique(spark):
    rows = spark.createDataFrame(
        [("e", 3, "hids", True, 0.5, None, 2, "A", "X", None), ("e", 2, "ids", True, 0.9, "scan", 1, "B", "Y", "T1046"), ("e", 1, "intel", None, 0.9, "x", 0, "C", "Z", "T9999"), ("e", 4, "correlation", True, 0.5, "y", 3, "A", "X", "T1000")],
        "event_id string, us long, source string, label boolean, confidence double, event_type string, ord long, src_ip string, dst_ip string, mitre_attack_id string",
    )
    got = one(labels.consensus(rows))
    assert (got["us"], got["src_ip"], got["dst_ip"], got["event_type"], got["mitre_attack_id"]) == (2, "B", "Y", "scan", "T1046")


def test_hids_minimum_comes_before_the_factor(spark):
    schema = "label_id string, level int, src_ip string, dst_ip string, groups array<string>, agent_id string"
    rows = spark.createDataFrame([("a", 6, "", None, ["ossec", "syscheck", "web"], "7"), ("b", 6, "h", "", ["x"], "7"), ("c", 5, "h", "", [], "7"), ("d", 12, None, "t", None, "8")], schema)
    got = {r["label_id"]: (r["confidence"], r["event_type"], r["src_ip"], r["dst_ip"], r["source"]) for r in labels.SOURCES["hids"].weak_labels(rows).collect()}
    assert got == {"a": (pytest.approx(0.49), "file_integrity", "agent:7", "", "hids"), "b": (0.7, "anomaly", "h", "", "hids"), "d": (0.95, "anomaly", "agent:8", "t", "hids")}


def test_label_sources(spark):
    rows = spark.createDataFrame([(1, 1, ["botnet", "scan"], "Trojan Activity"), (2, 9, ["exfiltration"], "DNS Tunneling"), (3, 4, ["recon"], "nothing"), (4, 3, [], None)], "label_id int, threat_level int, tags array<string>, category string").withColumn("severity", F.col("label_id"))
    assert [(r["confidence"], r["event_type"]) for r in labels.SOURCES["intel"].weak_labels(rows).orderBy("label_id").collect()] == [(0.95, "c2_beaconing"), (0.6, "exfiltration"), (0.6, "scan"), (0.7, "threat_intel_match")]
    assert [(r["confidence"], r["event_type"]) for r in labels.SOURCES["ids"].weak_labels(rows).orderBy("label_id").collect()] == [(0.95, "c2_beaconing"), (0.8, "dns_tunneling"), (0.6, "anomaly"), (0.5, "anomaly")]
    assert {n: s.weight for n, s in labels.SOURCES.items()} == {"ids": 1.2, "hids": 1.0, "intel": 1.3, "correlation": 0.7, "analyst": 2.0, "vendor": 1.5}
    kinds = spark.createDataFrame([("Exfiltration over C2 Channel",), ("Command and Control",), ("uses C2",), ("Lateral Movement",), ("Reconnaissance",), ("Credential Access",), (None,)], "t string").select(scalars.tactic_event_type("t").alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["exfiltration", "c2_beaconing", "c2_beaconing", "lateral_movement", "scan", "credential_theft", "anomaly"]


def test_patterns_of_one_alert_kind(spark):
    rows = [(1, 0, "A", "c2_beaconing"), (2, S, "A", "scan"), (3, 0, "B", "dns_tunneling"), (4, S, "B", "scan"), (5, 0, "C", "exfiltration"), (6, S, "C", "scan"), (7, 0, "D", "dns_tunneling")]
    alerts = spark.createDataFrame(rows, "alert_id long, us long, src_ip string, event_type string").withColumn("dst_ip", F.lit("X")).withColumn("backup", F.col("alert_id") == 4).withColumn("scheduled", F.lit(False))
    assert {(r["src_ip"], r["pattern"], r["pattern_alerts"]) for r in correlate.attack_patterns(alerts).collect()} == {("A", "c2_beaconing", 1), ("B", "dns_tunneling", 1)}
    late = 3 * 3600 * S
    assert {(r["src_ip"], r["reason"]) for r in correlate.expired(alerts, late).collect()} == {("A", "session_expired_pattern_c2_beaconing"), ("B", "session_expired_pattern_dns_tunneling")}
    assert correlate.expired(alerts, S).count() == 0
    groups = {(r["src_ip"], r["reason"], tuple(r["alert_ids"])) for r in correlate.candidate_groups(alerts, F.lit(12)).collect()}
    assert groups == {("A", "shared_source_proximity", (1, 2)), ("A", "attack_pattern_c2_beaconing", (1,)), ("B", "attack_pattern_dns_tunneling", (3,)), ("C", "shared_source_proximity", (5, 6))}


def test_incidents_follow_the_ladder(spark):
    rows = [("A", 3, "scan", "h1,h2", "lateral_movement", 85, "critical", True, 1.0), ("B", 2, "anomaly, scan", None, None, 65, "high", False, 6.0), ("C", 1, "scan", "h", None, 45, "medium", False, None), ("D", 1, "", "h", None, 5, "low", False, 1.0)]
    frame = spark.createDataFrame(rows, "src_ip string, alerts long, kinds string, hosts string, pattern string, severity_score int, severity_label string, malicious boolean, deviation double")
    got = {r["src_ip"]: r for r in severity.incidents(frame).collect()}
    told = lambda row: [(a["action"], a["target"], a["priority"], a["auto_execute"]) for a in row["recommended_actions"]]
    assert told(got["A"]) == [("notify_soc", "soc-team", "immediate", True), ("create_ticket", "thehive", "immediate", True), ("isolate_host", "h1", "high", False)]
    assert [told(got[k]) for k in "BCD"] == [[("notify_soc", "soc-team", "high", True), ("create_ticket", "thehive", "high", True)], [("create_ticket", "thehive", "medium", True)], [("log_only", "opensearch", "low", True)]]
    assert all(a["justification"] for r in got.values() for a in r["recommended_actions"])
    expired = one(severity.incidents(frame.where("src_ip = 'A'").withColumn("reason", F.lit("session_expired_pattern_lateral_movement"))))
    assert expired["correlation_reason"].endswith("proximidad temporal.") and "Patrón detectado: lateral_movement." in expired["description"]
    assert "FP descartado" in got["A"]["false_positive_assessment"] and "FP improbable" in got["B"]["false_positive_assessment"] and "revisión manual" in got["C"]["false_positive_assessment"]
    assert got["D"]["title"] == "Incidente correlacionado: anomalía (1 alertas, severidad 5)" and "patrón de ataque lateral_movement." in got["A"]["correlation_reason"] and got["C"]["correlation_reason"].endswith("proximidad temporal.")


def test_no_destructive_action_runs_by_itself(spark):
    schema = "id string, severity_label string, recommended_actions array<struct<action:string,target:string,priority:string,auto_execute:boolean,justification:string>>"
    said = [(name, "h", "high", True, "") for name in (*severity.DESTRUCTIVE, "notify_soc")] + [("create_ticket", "t", "low", False, ""), ("log_only", "t", "low", None, ""), (None, "t", "low", True, "")]
    got = {r["id"]: r for r in sinks.action_payload(spark.createDataFrame([("a", "critical", said), ("b", "odd", []), ("c", None, None)], schema)).collect()}
    assert [a["action"] for a in got["a"]["auto_execute_actions"]] == ["notify_soc", None]
    assert [a["action"] for a in got["a"]["manual_review_actions"]] == [*severity.DESTRUCTIVE, "create_ticket", "log_only"]
    assert [got[k]["playbook"] for k in "abc"] == ["brain-critical-response", "brain-low-response", "brain-low-response"]
    # The incidents of the ladder, whole.
    frame = spark.createDataFrame([("A", 3, "scan", "h1", "x", 85, "critical", True, 1.0)], "src_ip string, alerts long, kinds string, hosts string, pattern string, severity_score int, severity_label string, malicious boolean, deviation double")
    row = one(sinks.action_payload(severity.incidents(frame)))
    assert [a["action"] for a in row["auto_execute_actions"]] == ["notify_soc", "create_ticket"] and [a["action"] for a in row["manual_review_actions"]] == ["isolate_host"]


def enriched(spark, groups, assets=(), geo=(), intel=(), history=()):
    made = lambda rows, schema: None if rows is None else spark.createDataFrame(list(rows), schema)
    return {r["src_ip"]: r for r in severity.enrich(
        spark.createDataFrame(groups, "src_ip long, session long, target_ips array<long>"), made(assets, "src_ip long, criticality int, failed boolean"), made(geo, "first long, last long, country string"),
        made(intel, "ip long, tag string, failed boolean"), made(history, "src_ip long, deviation double, failed boolean"),
    ).collect()}


def test_enrichment_takes_the_first_hit_and_fails_only_where_a_source_does(spark):
    groups = [(1, 1, [50, 60, 70]), (2, 1, [80]), (3, 1, [90, 70]), (4, 1, [95])]
    got = enriched(
        spark, groups, [(1, 5, False), (2, 4, True), (3, 0, False)], [(60, 65, "ES"), (66, 99, "FR")], [(60, "cdn", False), (60, "seen", False), (70, "botnet", False), (90, "x", True), (2, "c2-server", None)],
        [(1, 18.0, False), (4, 3.0, True)],
    )
    # No hit is no failure; the first known address decides, its tags only, and any hit flags.
    assert (got[1]["malicious"], got[1]["tags"], got[1]["suspicious"], got[1]["country"], got[1]["criticality"], got[1]["deviation"], got[1]["failed_sources"], got[1]["partial"]) == (True, "cdn,seen", False, "ES", 5, 18.0, "", False)
    assert (got[2]["malicious"], got[2]["tags"], got[2]["suspicious"], got[2]["country"], got[2]["criticality"], got[2]["failed_sources"], got[2]["partial"]) == (True, "c2-server", True, "FR", 2, "asset", True)
    assert (got[3]["malicious"], got[3]["tags"], got[3]["criticality"], got[3]["failed_sources"]) == (False, None, 2, "threat_intel")  # the failing look-up comes before the hit
    assert (got[4]["malicious"], got[4]["deviation"], got[4]["failed_sources"], got[4]["criticality"]) == (False, None, "historical", 2)
    down = enriched(spark, groups[:1], None, None, None, None)[1]
    assert (down["failed_sources"], down["criticality"], down["country"], down["malicious"], down["deviation"]) == ("asset,geoip,threat_intel,historical", 2, None, False, None)


def test_tags_without_malice_count_half(spark):
    rows = spark.createDataFrame([("A", False, True), ("B", True, False), ("C", False, False)], "src_ip string, malicious boolean, suspicious boolean")
    rows = severity.score_groups(rows.withColumns({"severity": F.lit(10.0), "alerts": F.lit(1), "criticality": F.lit(2), "deviation": F.lit(None).cast("double")}))
    assert {r["src_ip"]: (r["c_intel"], r["bonus_applied"]) for r in rows.collect()} == {"A": (50.0, False), "B": (100.0, False), "C": (0.0, False)}


def test_history_is_that_of_the_main_target_of_a_source(spark):
    rows = spark.createDataFrame([("A", "X", 1, 100), ("A", "X", 2, 100), ("A", "Y", 3, 150), ("B", "Y", 4, 900), ("C", "Y", 5, 0), ("D", "Z", 6, 10), ("D", "W", 7, 10)], "src_ip string, dst_ip string, us long, orig_bytes long")
    got = {r["src_ip"]: (r["dst_ip"], r["first_seen_us"], r["bytes_sum"], r["deviation"]) for r in rollups.historical_of_source(rows).collect()}
    assert got == {"A": ("X", 1, 200, 2.0), "B": ("Y", 4, 900, 1.0), "C": ("Y", 5, 0, 0.0), "D": ("W", 7, 10, 1.0)}


def test_ranges_equal_a_plain_search(spark):
    draw = np.random.default_rng(4)
    table = [(int(a), int(a + w), k) for k, (a, w) in enumerate(zip(draw.integers(0, 5000, 300), draw.choice([0, 1, 7, 64, 900, -3], 300)))] + [(0, 2**40, 300), (2**40 - 5, 2**41, 301)]
    numbers = [int(v) for v in draw.integers(0, 6000, 500)] * 2 + [0, 2**40, 2**40 + 1, 2**41, 2**41 + 1, -1, None]
    frame = spark.createDataFrame(table, "first long, last long, name long")
    got = {r["number"]: r["name"] for r in ranges.locate(spark.createDataFrame([(v,) for v in numbers], "number long"), frame).collect()}
    inside = lambda v: min(((b - a, a, b, k) for a, b, k in table if a <= v <= b), default=None)
    assert got == {v: inside(v)[3] for v in set(numbers) if v is not None and v >= 0 and inside(v)}
    cut = {(r["first"], r["last"]): r["b"] for r in frame.select("first", "last", ranges.block_column("first", "last").alias("b")).collect()}
    for (a, b), blocks in cut.items():
        covered = sorted((k["block"] << k["bits"], (k["block"] + 1) << k["bits"]) for k in blocks or [])
        assert [x for pair in covered for x in pair][:1] == ([a] if a <= b else []) and all(p[1] == q[0] for p, q in zip(covered, covered[1:])) and (not covered or covered[-1][1] == b + 1) and len(covered) <= 126
    assert ranges.locate(spark.createDataFrame([(5,)], "number long"), frame.limit(0)).count() == 0
    asked = spark.createDataFrame([("10.0.1.2",), ("256.0.0.1",), ("hash:10.0.1.2",), ("f" * 64,), ("::1",), (None,)], "a string").select(ranges.address_number("a").alias("n"), ranges.is_pseudonym("a").alias("p")).collect()
    assert [r["n"] for r in asked] == [10 * 2**24 + 258, None, None, None, None, None] and [r["p"] for r in asked] == [False, False, True, True, False, None]


def test_rows_without_a_number_are_not_one_task(spark, data):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("-1", "false")):
            spark.conf.set(n, v)
        got = correlation.QUERIES["range_lookup"](spark, data)
        parts = [r["count"] for r in got.where("address LIKE 'hash:%'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.max("width")).collect()]
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert len(parts) > 1 and max(parts) < 0.5 * sum(parts)


def test_ranges_that_share_a_block_and_lengths_with_few_and_many_blocks(spark):
    draw = np.random.default_rng(6)
    table = [(int(a), int(a + w), k) for k, (a, w) in enumerate(zip(draw.integers(0, 4000, 6000), draw.choice([0, 1, 2, 5, 40], 6000)))] + [(0, 2**50, 6000), (0, 2**62 - 1, 6001)] + [(100, 200, k) for k in range(6002, 6100)]
    numbers = [int(v) for v in draw.integers(0, 6000, 800)] + [2**49, 2**51, -3, None, None]
    rows = spark.createDataFrame(list(enumerate(numbers)), "id long, number long")
    got = {r["id"]: (r["number"], r["name"]) for r in ranges.with_range(rows, spark.createDataFrame(table, "first long, last long, name long")).collect()}
    inside = lambda v: min(((b - a, a, b, k) for a, b, k in table if v is not None and a <= v <= b), default=(None,))[-1]
    assert got == {k: (v, inside(v)) for k, v in enumerate(numbers)}


def test_timeline_entries(spark):
    rows = spark.createDataFrame([("g", "b", 1_782_864_000_500_000, "hids", "scan", None, 40, "rule"), ("g", "a", 1_782_864_000_000_000, "ids", "", 0.5, None, None), ("g", "c" * 20, 1_782_950_399_000_000, None, None, None, None, None)], "k string, alert_id string, us long, source string, event_type string, ml_score double, severity int, rule_message string")
    got = [tuple(e) for e in one(severity.timeline(rows, ["k"], 1_782_950_400_000_000))["timeline"]]
    assert got == [
        ("2026-07-01T00:00:00Z", "ids score 0.5"), ("2026-07-01T00:00:00.500000Z", "hids (scan) severidad 40 — rule"), ("2026-07-01T23:59:59Z", "Alerta cccccccc"), ("2026-07-02T00:00:00Z", severity.PUBLISHED),
    ]


def test_event_vector_has_the_numeric_columns_first():
    assert features.EVENT_COLUMNS[-2:] == ("is_common_port", "is_weekend") and len(features.EVENT_COLUMNS) == 17 and features.EVENT_COLUMNS[7:10] == ("dst_port", "hour_of_day", "day_of_week")


def test_entities_of_a_group(spark):
    rows = spark.createDataFrame([(3, 30, "A", "Z", "h2", "ids"), (1, 10, "A", "Y", "h9", "ids"), (2, 20, "A", "Y", "h2", "hids"), (4, 5, "B", "Y", None, "ids")], "alert_id long, us long, src_ip string, dst_ip string, host string, source string")
    got = {r["src_ip"]: r for r in correlate.group_entities(rows, ["src_ip"]).collect()}
    assert (got["A"]["src_hosts"], got["A"]["dst_hosts"], got["A"]["src_ips"], got["A"]["dst_ips"], got["A"]["unique_sources"], got["A"]["alert_count"]) == (["h9", "h2"], [], ["A"], ["Y", "Z"], 2, 3)
    assert got["B"]["src_hosts"] == [] and got["B"]["time_span_seconds"] == 0


def test_baseline_without_deviation_or_service(spark):
    from flowlens.operators import baseline

    rows = [("a", "A", None, 10), ("b", "A", "", 10), ("c", "B", "ssl", 1), ("d", "B", "ssl", 2)]
    conn = spark.createDataFrame(rows, "uid string, src_ip string, service string, orig_bytes long").withColumns({"us": F.lit(0), "dst_ip": F.lit("X"), "dst_port": F.lit(1), "resp_bytes": F.lit(5), "duration": F.lit(1.0), "orig_pkts": F.lit(1), "resp_pkts": F.lit(1)})
    base = baseline.baselines(conn, spark.createDataFrame([], "src_ip string"))
    got = {r["uid"]: r for r in baseline.compare(conn.withColumn("orig_bytes", F.col("orig_bytes") * 10), base).where("metric = 'orig_bytes'").collect()}
    assert got["a"]["ratio"] == 10 and not got["a"]["is_anomalous"] and not got["b"]["is_anomalous"] and got["c"]["is_anomalous"] and got["d"]["z"] > 3


def test_comparison_report_of_nothing(spark):
    none = spark.createDataFrame([], "event_type string, true_positive boolean, ttd_seconds double, explained boolean")
    row = one(severity.comparison_report(none, none, none))
    assert (row["coverage"], row["precision_pct"], row["reduction"], row["availability"], row["mttd_difference"]) == (100, 0, 0, 0, 0)
    ours = spark.createDataFrame([("scan", True, 60.0, True), ("scan", False, 120.0, False)], "event_type string, true_positive boolean, ttd_seconds double, explained boolean")
    row = one(severity.comparison_report(ours, ours.limit(1), ours.unionByName(ours)))
    assert (row["coverage"], row["precision_pct"], row["advantage"], row["reduction"], row["availability"]) == (200, 50, 1, 50, 50) and row["mttd_minutes"] == 1.5
    assert one(severity.by_category(ours, ours.limit(1)).where("event_type = 'scan'")).asDict() == {"event_type": "scan", "incidents": 2, "other_incidents": 1}


def test_severity_of_three_alerts(spark):
    parts = severity.components(F.lit(180.16 / 2.6), F.lit(5), F.lit(True), F.lit(True), F.lit(18.0), F.lit(3))
    assert one(spark.range(1).select(severity.severity(parts).alias("s")))["s"] == 100
    plain = severity.components(F.lit(2.5 / 0.4), F.lit(0), F.lit(False), F.lit(False), F.lit(None).cast("double"), F.lit(0))
    assert one(spark.range(1).select(severity.severity(plain).alias("s")))["s"] == 2  # 2.5 rounds to even


def test_sessions_sliding_and_patterns(spark):
    rows = spark.createDataFrame([(1, 0, "scan"), (2, 25 * 60 * S, "exfiltration"), (3, 60 * 60 * S, "scan")], "alert_id long, us long, event_type string").withColumn("src_ip", F.lit("A")).withColumn("dst_ip", F.lit("X")).withColumn("severity", F.lit(10))
    assert correlate.sliding_groups(rows).count() == 0
    assert [r["session"] for r in correlate.sessions(rows).orderBy("alert_id").collect()] == [1, 1, 2]
    assert one(correlate.attack_patterns(rows)).asDict() == {"src_ip": "A", "session": 1, "alerts": 2, "pattern": "scan_to_exfiltration", "pattern_alerts": 2, "end_us": 25 * 60 * S}


def test_threshold_sweep_counts_scores_at_a_threshold(spark):
    rows = spark.createDataFrame([("m", 0.01, True), ("m", 0.99, False), ("m", 0.5, True), ("m", 0.0, False), ("m", 1.0, True)], "model_name string, score double, label boolean")
    got = {round(r["threshold"], 6): (r["tp"], r["fp"], r["fn"], r["tn"]) for r in tuning.sweep(rows).collect()}
    assert len(got) == 100 and got[0.01] == (3, 1, 0, 1) and got[0.99] == (1, 1, 2, 1)
    for t in (0.01, 0.247576, 0.504949, 0.99):
        t = min(got, key=lambda x: abs(x - t))
        want = [sum((s >= t - 1e-9) == a and y == b for _, s, y in [(0, 0.01, True), (0, 0.99, False), (0, 0.5, True), (0, 0.0, False), (0, 1.0, True)]) for a, b in ((True, True), (True, False), (False, True), (False, False))]
        assert list(got[t]) == want


def test_curves_with_one_class(spark):
    rows = spark.createDataFrame([("m", 0.1, True), ("m", 0.9, True)], "model_name string, score double, label boolean")
    assert one(tuning.roc_auc(rows))["roc_auc"] == 0.5 and one(tuning.average_precision(rows))["average_precision"] == 1
    assert one(tuning.average_precision(rows.withColumn("label", ~F.col("label"))))["average_precision"] == 0


def test_drift_of_equal_and_disjoint_samples(spark):
    a, b = spark.createDataFrame([(i / 100,) for i in range(40)], "score double"), spark.createDataFrame([(0.6 + i / 100,) for i in range(40)], "score double")
    assert one(tuning.ks_distance(a, a))["ks"] == 0 and one(tuning.ks_distance(a, b))["ks"] == pytest.approx(1)
    assert one(tuning.wasserstein(a, b))["wasserstein"] == pytest.approx(0.6) and one(tuning.psi(a, a))["psi"] == 0
    assert tuning.ks_p_value(0, 100, 100) == 1 and tuning.ks_p_value(1, 100, 100) < 1e-6


def test_fusion_weights(spark):
    wide = spark.range(200).select(F.col("id").alias("event_id"), (F.col("id") / 200).alias("a"), ((F.col("id") * 37 % 200) / 200).alias("b"), (F.col("id") > 100).alias("label"))
    weights = tuning.logistic_weights(wide, ["a", "b"])
    assert weights["a"] > 0.8 and sum(weights.values()) == pytest.approx(1)
    assert tuning.logistic_weights(wide.limit(10), ["a", "b"]) == {"a": 0.5, "b": 0.5}
    assert tuning.stacked(wide, ["a", "b"]).count() == 200


def test_tsv_logs(spark):
    text = ["#separator \\x09", "#fields\tts\tuid\tid.orig_h\tid.resp_p\tduration\tservice\textra\tanswers\tttl\tok", "#types\ttime\tstring\taddr\tport\tinterval\tstring\tstring\tvector[string]\tvector[int]\tbool", "1782864000.5\tu1\t10.0.0.1\t443\t1.5\tssl\tx\ta,-,b\t1,2\tT", "-\tu2\t-\t-\t-\t-", "", "1\tu3\t10.0.0.1\tport\t1\t-\t-\t-\t-\tF"]
    rows, broken = logs.read_tsv(spark.createDataFrame([(t,) for t in text], "value string"), columns=["timestamp", "uid", "src_ip", "dst_port", "duration", "service", "answers", "ttl", "ok"], salt="s")
    got = {r["uid"]: r for r in rows.collect()}
    assert set(got) == {"u1", "u2"} and broken.count() == 1 and "extra" not in rows.columns
    assert got["u1"]["answers"] == ["a", "b"] and got["u1"]["ttl"] == [1, 2] and got["u1"]["ok"] is True and got["u1"]["dst_port"] == 443
    assert got["u2"]["dst_port"] == 0 and got["u2"]["duration"] == 0 and got["u2"]["service"] is None and got["u2"]["timestamp"].year == 1970 and len(got["u1"]["src_ip"]) == 64
    empty, _ = logs.read_tsv(spark.createDataFrame([("no header",)], "value string"))
    assert empty.columns == []


def test_eve_lines_and_topics(spark):
    line = '{"timestamp":"2026-07-01T00:00:00Z","event_type":"alert","src_ip":"a","dest_ip":"b","alert":{"signature":"s","severity":2,"metadata":[["x","y"],["mitre_attack_id","T1046"]]}}'
    frame = spark.createDataFrame([(line,), ('{"event_type":"flow"}',), ("{bad",), ("",)], "value string")
    row = one(logs.read_eve(frame))
    assert logs.read_eve(frame).count() == 1 and row["mitre_attack_id"] == "T1046" and row["alert_severity"] == 2
    parts = logs.by_topic(spark.createDataFrame([("t", '{"a":1}'), ("u", "x")], "topic string, value string"), {"t": "a int"})
    assert [r["a"] for r in parts["t"].collect()] == [1]


def test_paged_source(spark):
    class Alerts(logs.PagedSource):
        fetch = staticmethod(lambda cursor, options: ([((cursor or 0) * 10 + k,) for k in range(2)], (cursor or 0) + 1 if (cursor or 0) < 2 else None))

        @classmethod
        def name(cls):
            return "test_alerts"

    spark.dataSource.register(Alerts)
    assert sorted(r["id"] for r in spark.read.format("test_alerts").option("schema", "id long").load().collect()) == [0, 1, 10, 11, 20, 21]

    class Many(logs.PagedSource):
        fetch = staticmethod(lambda cursor, options: ([(cursor or 0,)], (cursor or 0) + 1 if (cursor or 0) < 149 else None))

        @classmethod
        def name(cls):
            return "test_many"

    spark.dataSource.register(Many)
    assert spark.read.format("test_many").option("schema", "id long").load().count() == 150


def test_times_pseudonyms_and_entities(spark):
    times = spark.createDataFrame([("2026-07-01T00:00:00Z",), ("1782864000",), ("2026-07-01T00:00:00",), ("never",)], "t string").select(F.unix_micros(scalars.parse_time("t")).alias("us")).collect()
    assert [r["us"] for r in times] == [1_782_864_000 * S] * 3 + [None]
    row = one(spark.createDataFrame([("10.0.0.1", None, "")], "a string, b string, c string").select(privacy.pseudonym("a", "s").alias("a"), privacy.pseudonym("b", "s").alias("b"), privacy.indexed_pseudonym("c", "s").alias("c"), privacy.vendor_pseudonym("c", "s").alias("d"), privacy.is_pseudonym(F.lit("f" * 32)).alias("e")))
    assert row["a"] != row["b"] and row["c"] == "" and row["d"] == "unknown" and row["e"]
    text = "see SRV-DB-01.corp.local, WEB-02 and srv-db-01, a well-known state-of-the-art host at 10.0.0.1 and 10.0.0.1, id " + "aB" * 16
    named = one(spark.createDataFrame([(text,)], "t string").select(entities.ips("t").alias("i"), entities.hosts("t").alias("h"), entities.hashes("t").alias("x")))
    assert named["i"] == ["10.0.0.1", "aB" * 16] and named["h"] == ["SRV-DB-01.corp.local", "WEB-02"] and named["x"] == ["aB" * 16]


def test_validation_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 50, 0), (2, None, 86_400 * S), (3, 200, 0)], "id int, severity int, us long")
    good, bad = severity.validate(rows, {"severity": F.col("severity").between(0, 100)})
    assert good.count() == 1 and {r["error"] for r in bad.collect()} == {"severity"}
    assert {r["original_message"] for r in sinks.dead_letters(bad, "test").collect()} == {'{"id":2,"us":86400000000}', '{"id":3,"severity":200,"us":0}'}
    sinks.write_by_date(rows, f"{tmp_path}/t")
    assert sinks.drop_before(spark, f"{tmp_path}/t", "1970-01-02").count() == 1
    sinks.save_run(spark, f"{tmp_path}/runs", "r", {"b": 1, "a": 2}, {"f1": 0.5})
    assert sinks.load_run(spark, f"{tmp_path}/runs", "r")["figures"] == {"f1": 0.5}
    with pytest.raises(KeyError):
        sinks.load_run(spark, f"{tmp_path}/runs", "missing")
    assert "| f1 | 0.5 |" in sinks.markdown({"f1": 0.5}, "Run")
    message = one(sinks.as_messages(rows.limit(1), "id", "topic"))
    assert message["topic"] == "topic" and message["key"] == "1"
    assert one(spark.range(1).select(sinks.index_name(F.lit("")).alias("a"), sinks.index_name(F.lit("sensor-conn")).alias("b"))).asDict() == {"a": "unclassified", "b": "logs-conn"}


def test_detectors_rank_outliers_and_survive_artifacts(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (300, 3)), [[9, 9, 9]]])
    forest, coder = detectors.fit_forest(x, 50), detectors.fit_autoencoder(x[:300], (8, 2, 8), 20)
    assert forest.score(x).argmax() == 300 and forest.score(x)[300] == 1 and coder.score(x)[300] == 1
    again = detectors.from_artifact(detectors.artifact(forest))
    assert np.allclose(again.score(x), forest.score(x)) and np.allclose(detectors.from_artifact(detectors.artifact(coder)).score(x), coder.score(x))
    assert (detectors.fit_forest(np.zeros((10, 2))).score(np.zeros((3, 2))) == 0.5).all()
    assert forest.importance().sum() == pytest.approx(1)
    assert detectors.fit_hmm([x[:1]], ["a", "b", "c"]) is None
    hmm = detectors.fit_hmm([x[:150], x[150:]], ["bytes_out", "unique_destinations", "connection_count"])
    assert np.allclose(hmm.step.sum(1), 1) and sorted(hmm.labels) == sorted(detectors.STATE_LABELS) and len(hmm.decode(x)[0]) == 301
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    both = detectors.detect(frame, ["a", "b", "c"], "id")
    assert both.count() == 602 and one(both.where("model_name = 'isolation_forest'").orderBy(F.desc("score")))["id"] == 300


def _sent_to_driver(spark, run) -> int:
    """Bytes of results that tasks hand to the driver while ``run`` runs."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {(stages.apply(k).stageId(), stages.apply(k).attemptId()): stages.apply(k).resultSize() for k in range(stages.size())}

    before = total()
    run()
    return sum(v for k, v in total().items() if k not in before)


def test_a_sample_is_the_first_hashes_and_sends_no_more_for_more_parts(spark):
    wide = spark.range(0, 40_000, 1, 40).select("id", F.col("id").cast("double").alias("a"))
    got = []
    assert _sent_to_driver(spark, lambda: got.extend(detectors.sample(wide, ["a"], "id", 1000)[:, 0])) < 600_000
    first = wide.orderBy(F.xxhash64("id"), "id").limit(1000).toPandas()["a"]
    assert got == list(first)
    # Keys that repeat: few hashes, so that too few rows or too many may lie below a first cut.
    for keys in (1, 3, 50):
        same = wide.select((F.col("id") % keys).alias("id"), "a")
        assert len(detectors.sample(same, ["a"], "id", 1000)) == 1000
    assert len(detectors.sample(wide, ["a"], "id", 100_000)) == 40_000
    assert detectors.sample(wide.limit(0), ["a"], "id").shape == (0, 1)


def test_an_autoencoder_of_all_rows_is_as_good_as_the_plain_fit(spark):
    rng = np.random.default_rng(3)
    hidden = rng.normal(0, 1, (6000, 2))
    x = np.tanh(hidden @ rng.normal(0, 1, (2, 6))) * [1, 10, 100, 1, 5, 1] + rng.normal(0, 0.05, (6000, 6)) + [5, 0, 0, 0, 0, 1]
    names = [f"c{k}" for k in range(6)]
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names)).repartition(4)
    plain = detectors.fit_autoencoder(x, (16, 2, 16), 20)
    made = detectors.fit_autoencoder_rows(frame, names, (16, 2, 16), 20)
    assert np.allclose(made.mean, x.mean(axis=0)) and np.allclose(made.sd, x.std(axis=0))
    assert made.error(x).mean() < 1.05 * plain.error(x).mean()
    skewed = detectors.fit_autoencoder_rows(frame.coalesce(1).unionByName(frame.limit(3)), names, (4,), 2)
    assert np.isfinite(skewed.error(x)).all()


def test_generators_repeat_and_mix(spark):
    a, b = generate.flows(spark, 500), generate.flows(spark, 500)
    assert a.exceptAll(b).count() == 0 and a.where("kind <> 'normal'").count() < 50 and generate.lookups(spark, 100).count() == 100
    assert generate.sensor_stream(spark).isStreaming


def test_the_last_header_counts(spark):
    lines = ["#fields\tzz\tuid", "#types\tstring\tstring", "#fields\tts\tuid", "#types\ttime\tstring", "1\tu1"]
    fields, types = logs.header(spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1))
    assert (fields, types) == (["ts", "uid"], ["time", "string"])
    assert logs.text_lines(spark, "/nowhere/at/all").count() == 0


def test_detectors_on_an_empty_table_and_all_windows(spark):
    empty = spark.createDataFrame([], "id long, a double, b double")
    for name in ("isolation_forest", "autoencoder"):
        fit, transform = detectors.DETECTORS[name]
        model = fit(empty, ["a", "b"], "id")
        assert transform(spark.createDataFrame([(1, 2.0, 3.0)], "id long, a double, b double"), ["a", "b"], model, "id").count() == 1
    columns = ["bytes_out", "unique_destinations"]
    rng = np.random.default_rng(0)
    levels = {0: (0, 0), 1: (0, 50), 2: (90_000, 0), 3: (30_000, 3)}
    rows = [(host, t, *(float(v) for v in np.add(levels[(t // 20 + host) % 4], rng.random(2)))) for host in range(3) for t in range(160)]
    windows = spark.createDataFrame(rows, "src_ip long, window_us long, bytes_out double, unique_destinations double")
    model = detectors.fit_hmm_windows(windows, columns)
    got = {(r["src_ip"], r["window_us"]): r["state_label"] for r in detectors.score_sequences(windows, columns, model).collect()}
    want = {0: "normal", 1: "scan", 2: "exfil", 3: "c2"}
    assert sum(got[h, t] == want[(t // 20 + h) % 4] for h, t, *_ in rows) > 0.95 * len(rows)
    assert detectors.fit_hmm_windows(windows.limit(1), columns) is None
    assert {r["state_label"] for r in detectors.score_sequences(windows, columns, None).collect()} == {"unknown"}


def test_sequences_taken_together_are_as_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(5)
    columns = ["bytes_out", "unique_destinations"]
    sequences = [rng.gamma(1, 1, (n, 2)) * [1000, 3] for n in [1, 7, 2, 7, 30, 1, 4]]
    model = detectors.fit_hmm(sequences, columns, rounds=3)
    for most in (detectors.TOGETHER, 10):
        made = [list(detectors._ranked(sequences, most)), detectors._expected(model, sequences)]
        assert sorted(int(k) for part, *_ in made[0] for k in part) == list(range(7)) and (most > 10) == (len(made[0]) == 1)
        assert np.allclose(made[1], sum(detectors._expected(model, [s]) for s in sequences))
    # Each path by trying all of them, the likelihood as their sum.
    for s, (path, likelihood) in zip(sequences, model.decode_all(sequences)):
        if len(s) > 4:
            continue
        e, step, start = model.emissions(s), np.log(model.step + 1e-300), np.log(model.start + 1e-300)
        every = {p: start[p[0]] + e[0, p[0]] + sum(step[a, b] + e[t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:]))) for p in np.ndindex(*[4] * len(s))}
        assert tuple(path) == max(every, key=every.get) and likelihood == pytest.approx(np.logaddexp.reduce(list(every.values())))
    # All take a step in time at once, so there is one look at the emissions however many there are.
    calls, real = [], detectors.Hmm.emissions
    monkeypatch.setattr(detectors.Hmm, "emissions", lambda self, x: calls.append(len(x)) or real(self, x))
    model.decode_all(sequences)
    detectors._expected(model, sequences)
    assert calls == [52, 52]
    monkeypatch.undo()
    # A null host or time and values that are missing stay as they were.
    rows = [(h, t, float(h * t % 7), float(t % 3)) for h in range(60) for t in range(h % 5 + 1)] + [(None, 1, 2.0, None), (None, None, float("nan"), 1.0)]
    windows = spark.createDataFrame(rows, "src_ip long, window_us long, bytes_out double, unique_destinations double").repartition(3)
    got = {(r["src_ip"], r["window_us"]): (r["state_label"], r["score"]) for r in detectors.score_sequences(windows, columns, model).collect()}
    assert set(got) == {r[:2] for r in rows}
    for host in (0, 4, 33, None):
        mine = sorted((r for r in rows if r[0] == host), key=lambda r: (r[1] is None, r[1]))
        path, _ = model.decode(np.nan_to_num(np.array([r[2:] for r in mine], float)))
        assert [got[r[:2]][0] for r in mine] == [model.labels[k] for k in path]


def test_fan_out_goes_on_after_a_failed_sink(spark):
    seen = []

    def broken(batch, number):
        raise ValueError("down")

    with pytest.raises(ValueError):
        sinks.fan_out(broken, lambda b, n: seen.append(b.count()))(spark.range(3), 0)
    sinks.fan_out(broken, lambda b, n: seen.append(n), failed=lambda w, e: seen.append(str(e)))(spark.range(3), 1)
    assert seen == [3, "down", 1]


def test_events_without_a_score_stay_in_active_learning(spark):
    rows = spark.createDataFrame([(1, "a", 0.5), (2, "a", None), (3, "a", 0.9)], "event_id long, model_name string, score double")
    assert tuning.active_learning(rows, 0.5).count() == 3
    assert [r["event_id"] for r in tuning.unlabelled_queries(rows.where("score IS NOT NULL"), rows.where("event_id = 1")).collect()] == [3]


def test_a_mean_score_does_not_depend_on_the_order_of_rows(spark):
    rows = [("isolation_forest", 0.05), ("autoencoder", 0.75), ("hmm", 0.4), ("other", None)]
    for turn in range(4):
        for part in (rows[turn:] + rows[:turn], list(reversed(rows[turn:] + rows[:turn]))):
            got = one(tuning.event_scores(spark.createDataFrame([(1, *r) for r in part], "event_id long, model_name string, score double").coalesce(1)))
            assert (got["mean_score"], got["models"]) == ((0.05 + 0.75 + 0.4) / 3, 3)
    none = one(tuning.event_scores(spark.createDataFrame([(1, "hmm", None), (1, None, None)], "event_id long, model_name string, score double")))
    assert none["mean_score"] is None and none["models"] == 0
    assert one(tuning.event_scores(spark.createDataFrame([(1, None, 0.5), (1, "new", 0.75)], "event_id long, model_name string, score double")))["mean_score"] == 0.625


def test_fusion_methods(spark):
    rows = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.8)], "event_id long, model_name string, score double")
    assert one(tuning.fuse_by("weighted", rows, models=["a", "b"]))["fused"] == pytest.approx(0.5)
    assert one(tuning.fuse_by("weighted", rows, weights={"a": 1.0, "b": 3.0}))["fused"] == pytest.approx(0.65)
    for wrong in ("logistic", "other"):
        with pytest.raises(ValueError):
            tuning.fuse_by(wrong, rows, models=["a", "b"])


def test_model_columns_prefer_normalized_ones(spark):
    from flowlens.operators import features

    assert features.model_columns(spark.createDataFrame([(1, 2, 3)], "a int, a_norm int, b int"), ["a", "b"]) == ["a_norm", "b"]


def test_curves_of_one_model_run_over_slices(spark):
    rng = np.random.default_rng(5)
    rows = [("m", float(s), bool(y), float(w)) for s, y, w in zip(np.round(rng.random(900), 2) * 3 - 1, rng.random(900) < 0.3, rng.random(900))] + [("m", None, True, 0.5), ("one", 0.5, True, 1.0), ("none", 0.5, False, 1.0)]
    frame = spark.createDataFrame(rows, "model_name string, score double, label boolean, w double")
    for weight in (None, "w"):
        of = {r["model_name"]: r["roc_auc"] for r in tuning.roc_auc(frame, weight=weight).collect()}
        precision = {r["model_name"]: r["average_precision"] for r in tuning.average_precision(frame, weight=weight).collect()}
        value = lambda s: -np.inf if s is None else s
        pos = [(value(s), w if weight else 1) for m, s, y, w in rows if m == "m" and y]
        neg = [(value(s), w if weight else 1) for m, s, y, w in rows if m == "m" and not y]
        area = sum(a * b * (1 if s > t else 0.5 if s == t else 0) for s, a in pos for t, b in neg) / sum(a for _, a in pos) / sum(b for _, b in neg)
        assert of["m"] == pytest.approx(area) and (of["one"], of["none"]) == (0.5, 0.5)
        total, step = sum(a for _, a in pos), 0.0
        for score in {s for s, _ in pos}:
            tp = sum(a for s, a in pos if s >= score)
            step += sum(a for s, a in pos if s == score) / total * tp / (tp + sum(b for s, b in neg if s >= score))
        assert precision["m"] == pytest.approx(step) and (precision["one"], precision["none"]) == (1.0, 0.0)


def test_alert_times_are_iso_text_only(spark):
    texts = ["2026-07-01T00:00:00Z", "2026-07-01T02:00:00+02:00", "2026-07-01", "2026-07-01T00:00:00.25", "1782864000", "1782864000.5", "", "never", "20260701", None]
    got = [r["us"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_micros(scalars.alert_time("t")).alias("us")).collect()]
    at = 1_782_864_000 * S
    assert got == [at, at, at, at + 250_000, *[None] * 6]


def test_logs_of_each_kind_have_their_columns(spark):
    head = "#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tquery\tqclass\tqtype_name\trcode\tanswers\tTTLs\textra\n#types\ttime\tstring\taddr\tport\taddr\tport\tenum\tstring\tcount\tstring\tcount\tvector[string]\tvector[interval]\tstring"
    body = "1782864000.5\tu1\t10.0.0.1\t5\t10.0.0.2\t53\tudp\thost.example\t1\tA\t3\ta,b\t300.0\tx\n1782864001\tu2\t10.0.0.1\t-\t-\t53\tudp\t-\t-\t-\t-\t-\t-\t-\nbad\tu3"
    rows, broken = logs.read_log(spark.createDataFrame([(line,) for line in f"{head}\n{body}".split("\n")], "value string"), "dns")
    assert rows.columns == ["timestamp", "uid", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "query", "qclass", "qtype", "rcode", "rcode_name", "answers", "ttl"] and broken.count() == 1
    first, second = rows.orderBy("uid").collect()
    assert (first["src_port"], first["query"], first["rcode"], first["answers"], first["rcode_name"], first["ttl"]) == (5, "host.example", "3", ["a", "b"], None, None)
    assert (second["src_port"], second["dst_ip"], second["query"], second["answers"]) == (0, None, None, [])
    for kind in logs.LOG_SCHEMAS:
        empty, _ = logs.read_log(spark.createDataFrame([], "value string"), kind)
        assert empty.count() == 0 and empty.columns[:2] == ["timestamp", "uid"]


def test_an_outside_explanation_replaces_the_fallback_where_it_is_valid(spark):
    frame = spark.createDataFrame([(k, 2, "scan", "h", None, 75, "high", False, 1.0) for k in range(6)], "k long, alerts long, kinds string, hosts string, pattern string, severity_score int, severity_label string, malicious boolean, deviation double").withColumn("src_ip", F.col("k"))
    action = "struct<action:string,target:string,priority:string,auto_execute:boolean,justification:string>"
    said = lambda k, title="T", move=10, confidence=0.9, acts=(("isolate_host", "h", "high", True, "x"), ("notify_soc", None, None, True, None), ("", "t", "low", True, ""), ("log_only", "t", "low", None, "")): (k, title, "d", "e", "r", "f", move, confidence, list(acts))
    rows = [said(0), said(1, move=30), said(2, title="T" * 101), said(3, confidence=1.5), said(4, move=None, acts=()), said(4, title="less sure", confidence=0.1), said(9)]
    outside = spark.createDataFrame(rows, f"k long, title string, description string, explanation string, correlation_reason string, false_positive_assessment string, severity_adjustment int, confidence double, recommended_actions array<{action}>")
    got = {r["k"]: r for r in severity.with_explanation(severity.incidents(frame), outside, ["k"]).collect()}
    assert (got[0]["severity_score"], got[0]["severity_label"], got[0]["title"], got[0]["xai_available"], got[0]["tags"], got[0]["confidence"]) == (85, "critical", "T", True, [], 0.9)
    assert [(a["action"], a["target"], a["priority"], a["auto_execute"]) for a in got[0]["recommended_actions"]] == [("isolate_host", "h", "high", False), ("notify_soc", "", "medium", True), ("log_only", "t", "low", False)]
    for k in (1, 2, 3, 5):  # out of bounds, too long, too sure, or none
        assert (got[k]["severity_score"], got[k]["xai_available"], got[k]["explanation"], got[k]["tags"]) == (75, False, None, ["needs_xai_reprocess"]) and got[k]["title"].startswith("Incidente")
    assert (got[4]["title"], got[4]["severity_score"], got[4]["severity_label"], got[4]["recommended_actions"]) == ("T", 75, "high", []) and len(got) == 6


def test_scalers_and_runs_are_kept(spark, tmp_path):
    scaler = {"b": (0.1, 2.0), "a": (1e-17, 1.0)}
    assert features.scaler_from_artifact(features.scaler_artifact(scaler)) == scaler and list(features.scaler_from_artifact(features.scaler_artifact(scaler))) == ["b", "a"]
    for run in ("r2", "r1"):
        sinks.save_run(spark, f"{tmp_path}/runs", run, {"a": run}, {})
    assert [r["run_id"] for r in sinks.list_runs(spark, f"{tmp_path}/runs").collect()] == ["r1", "r2"]


def test_a_failing_fit_is_tried_again_with_fewer_rounds(spark, monkeypatch):
    rows = spark.createDataFrame([(h, t, float(t % 5), float(h)) for h in range(3) for t in range(30)], "src_ip long, window_us long, bytes_out double, unique_destinations double")
    tried, real = [], detectors._fitted

    def fitted(held, model, rounds):
        tried.append(rounds)
        if rounds > detectors.RETRY_ROUNDS:
            raise ArithmeticError
        return real(held, model, 2)

    monkeypatch.setattr(detectors, "_fitted", fitted)
    assert detectors.fit_hmm_windows(rows, ["bytes_out", "unique_destinations"]) is not None and tried == [20, 10]


def test_labels_carry_the_technique_of_their_record(spark):
    record = spark.createDataFrame([(1, 1, "Network Scan", "T1046"), (2, 3, "x", None)], "label_id long, severity int, category string, mitre_attack_id string")
    assert {r["label_id"]: r["mitre_attack_id"] for r in labels.SOURCES["ids"].weak_labels(record).collect()} == {1: "T1046", 2: None}
    assert labels.SOURCES["ids"].weak_labels(record.drop("mitre_attack_id")).columns[-2:] == ["mitre_attack_id", "source"]
