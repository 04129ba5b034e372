"""The groups that alerts bring as they come, on streams and in a batch, against a plain replay."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from flowlens.operators import correlate, scan
from flowlens.streaming import correlator, jobs

MINUTE = 60_000_000
WINDOW, GAP = 5 * MINUTE, 30 * MINUTE
T0 = 1_782_864_000_000_000
KINDS = ["scan", "exfiltration", "c2_beaconing", "lateral_movement", "dns_tunneling", "anomaly", "anomaly", "anomaly"]


def pattern_of(alerts):
    """(name, ids) of the first pattern that a list of (id, us, source, kind, known) shows."""
    if len(alerts) < 2:
        return None
    alerts = sorted(alerts, key=lambda a: a[1])
    kinds = [a[3] for a in alerts]
    ids = lambda *wanted: [a[0] for a in alerts if a[3] in wanted]
    if "scan" in kinds and "exfiltration" in kinds and kinds.index("scan") < kinds.index("exfiltration"):
        return "scan_to_exfiltration", [a[0] for a in alerts[kinds.index("scan") : kinds.index("exfiltration") + 1]]
    if "c2_beaconing" in kinds:
        return "c2_beaconing", ids("c2_beaconing") + ids("dns_tunneling", "anomaly")
    if "scan" in kinds and "lateral_movement" in kinds:
        return "lateral_movement", ids("scan") + ids("lateral_movement")
    return ("dns_tunneling", ids("dns_tunneling")) if "dns_tunneling" in kinds else None


def replay(alerts, window=WINDOW, gap=GAP, history=1000, upto=None):
    """Groups by alert, and of sessions that ended before ``upto``, one alert after the other in the order given."""
    known = {a[0] for a in alerts if a[4]}
    windows, sessions, out = {}, {}, []

    def close(source):
        shown = pattern_of(sessions[source])
        if shown:
            out.append((None, max(a[1] for a in sessions[source]), source, f"session_expired_pattern_{shown[0]}", shown[0], tuple(shown[1])))
        del sessions[source]

    for alert in alerts:
        one, us, source, *_ = alert
        if source in sessions and us - max(a[1] for a in sessions[source]) > gap:
            close(source)
        recent = windows.setdefault(source, deque(maxlen=history))
        recent.append(alert)
        while recent[0][1] < us - window:
            recent.popleft()
        sessions.setdefault(source, []).append(alert)
        groups = [("shared_source_proximity", None, [a[0] for a in recent])] if len(recent) >= 2 else []
        shown = pattern_of(sessions[source])
        if shown:
            groups.append((f"attack_pattern_{shown[0]}", *shown))
        seen = []
        for reason, name, ids in groups:
            if not known & set(ids) and set(ids) not in seen:
                seen.append(set(ids))
                out.append((one, us, source, reason, name, tuple(ids)))
    for source in [s for s in sessions if upto is not None and max(a[1] for a in sessions[s]) + gap < upto]:
        close(source)
    return out


def drawn(seed, n=400, sources=4, known=0.03, step=4 * MINUTE):
    draw, us, out = random.Random(seed), T0, []
    for k in range(n):
        us += int(draw.expovariate(1 / step)) + (40 * MINUTE if draw.random() < 0.04 else 0)
        out.append((k, us - us % 1000, draw.randrange(sources) if seed % 2 else 0, draw.choice(KINDS), draw.random() < known))
    return out


SCHEMA = "alert_id long, us long, src_ip long, event_type string, known boolean"


def streamed(spark, folder, batches, **how):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", correlator.ROCKS)
    for part in batches:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withColumn("ts", F.timestamp_micros("us"))
    rows = jobs.drain(correlator.correlate_alerts(stream, WINDOW, GAP, delay="2 hours", **how), f"{folder}/run", "append").collect()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return sorted((tuple(r)[:5] + (tuple(r["alert_ids"]),) for r in rows), key=repr)


@pytest.mark.parametrize(("seed", "cut"), [(1, 400), (1, 60), (3, 97), (2, 130)])
def test_a_stream_equals_a_replay_whatever_its_batches(spark, tmp_path, seed, cut):
    """The last batch, an alert of another source much later, lets the watermark pass all the others."""
    alerts = drawn(seed)
    late = (9999, alerts[-1][1] + 600 * MINUTE, 99, "anomaly", False)
    batches = [alerts[a : a + cut] for a in range(0, len(alerts), cut)] + [[late], [(10000, late[1] + MINUTE // 1000, 98, "anomaly", False)]]
    got = streamed(spark, str(tmp_path), batches)
    assert got == sorted(replay(alerts, upto=late[1]), key=repr)
    assert any(r[0] is None for r in got) and {r[4] for r in got} > {"scan_to_exfiltration", "c2_beaconing"}


def test_a_window_holds_no_more_than_its_history(spark, tmp_path):
    alerts = [(k, T0 + k * 1000, 1, "anomaly", False) for k in range(40)]
    assert streamed(spark, str(tmp_path), [alerts[:25], alerts[25:]], history=10) == sorted(replay(alerts, history=10), key=repr)


def members(alerts, rows):
    """The rows of the batch form with the ids that their places stand for."""
    order = {}
    for a in sorted(alerts, key=lambda a: (a[1], a[0])):
        order.setdefault(a[2], []).append(a)
    kinds = {"c2_beaconing": {"c2_beaconing", "dns_tunneling", "anomaly"}, "lateral_movement": {"scan", "lateral_movement"}, "dns_tunneling": {"dns_tunneling"}}
    out = []
    for r in rows:
        inside = order[r["src_ip"]][r["first_place"] - 1 : r["last_place"]]
        ids = frozenset(a[0] for a in inside if r["pattern"] not in kinds or a[3] in kinds[r["pattern"]])
        assert len(ids) == r["size"]
        out.append((r["alert_id"], r["us"], r["src_ip"], r["reason"], r["pattern"], ids))
    return sorted(out, key=lambda r: (r[0], r[3]))


@pytest.mark.parametrize(("seed", "history", "step"), [(1, 1000, 4), (2, 1000, 4), (3, 1000, 40), (2, 3, 1)])
def test_the_batch_form_equals_a_replay(spark, seed, history, step):
    alerts = sorted(drawn(seed, step=step * MINUTE), key=lambda a: (a[1], a[0]))
    rows = correlate.alert_groups(spark.createDataFrame(alerts, SCHEMA), F.col("known"), WINDOW, GAP, history=history).collect()
    wanted = [(*r[:5], frozenset(r[5])) for r in replay(alerts, history=history)]
    assert members(alerts, rows) == sorted((r for r in wanted if r[0] is not None), key=lambda r: (r[0], r[3]))


def test_one_source_with_all_rows_is_as_many_groups_as_slices(spark):
    """Sessions, places and running sums over slices are those of one window over everything."""
    alerts = spark.createDataFrame(drawn(2, 900), SCHEMA)
    plain, last, session, wanted = [], None, 0, {}
    for a in drawn(2, 900):
        session += last is None or a[1] - last > GAP
        last = a[1]
        plain.append(a)
        wanted[a[0]] = (session, len(plain))
    for width in (MINUTE, 7 * MINUTE, 500 * MINUTE):
        rows = correlate.numbered(alerts, GAP, width=width)
        assert {r["alert_id"]: (r["session"], r["place"]) for r in rows.collect()} == wanted
        assert rows.select("_slice").distinct().count() == len({a[1] // width for a in plain})
    sums = scan.running(scan.with_slice(alerts, 7 * MINUTE), ["src_ip"], ["us", "alert_id"], {"n": F.lit(1)}, {"low": F.when(F.col("event_type") == "scan", F.col("us"))}, {"high": F.col("alert_id")})
    first = min(a[1] for a in plain if a[3] == "scan")
    assert {r["alert_id"]: (r["n"], r["low"], r["high"]) for r in sums.collect()} == {a[0]: (n, first if a[1] >= first else None, a[0]) for n, a in enumerate(plain, 1)}


def test_frames_of_slices_hold_what_they_look_back_on(spark):
    alerts = spark.createDataFrame([(*a, a[0] % 5, a[0] % 7) for a in drawn(2, 300, step=MINUTE)], f"{SCHEMA}, dst_ip int, severity int")
    plain = drawn(2, 300, step=MINUTE)
    for reach in (MINUTE, 9 * MINUTE, 3000 * MINUTE):
        inside = {a[0]: [b for b in plain if a[1] - reach <= b[1] <= a[1]] for a in plain}
        got = {r["alert_id"]: (r["size"], r["first_us"], r["targets"], r["kinds"], r["max_severity"]) for r in correlate.sliding_groups(alerts, reach, least=1).collect()}
        assert got == {k: (len(v), min(b[1] for b in v), len({b[0] % 5 for b in v}), len({b[3] for b in v}), max(b[0] % 7 for b in v)) for k, v in inside.items()}
    got = {r["alert_id"]: (r["size"], r["first_us"]) for r in correlate.sliding_groups(alerts, 60 * MINUTE, least=1, history=4).collect()}
    assert got == {a[0]: (len(w), w[0][1]) for k, a in enumerate(plain) for w in [[b for b in plain[max(0, k - 3) : k + 1] if b[1] >= a[1] - 60 * MINUTE]]}


def test_rows_without_source_or_time_stay(spark):
    rows = spark.createDataFrame([(1, None, 7, "scan", False), (2, T0, None, "scan", False), (3, T0 + 5, None, "scan", True), (4, T0, 7, "scan", None)], SCHEMA)
    assert {(r["alert_id"], r["session"]) for r in correlate.sessions(rows, GAP).collect()} >= {(2, 1), (3, 1)} and correlate.sessions(rows, GAP).count() == 4
