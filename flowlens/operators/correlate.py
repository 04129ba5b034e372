"""Correlation of alerts: sliding groups, sessions, attack patterns, known false positives, group de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.scan import SLICE, meet, reach_slice, running, with_reach, with_slice
from flowlens.session import cut

WINDOW, GAP = 300_000_000, 1_800_000_000
#: Alerts of a source that its window holds at most.
HISTORY = 1000


def sliding_groups(alerts: DataFrame, window: int = WINDOW, least: int = 2, history: int | None = None) -> DataFrame:
    """Per alert the alerts of its source in the closed frame [us - window, us], if at least ``least``: size, first, span, distinct targets and kinds.

    A frame by range over event time: the state is the frame alone, in any order of arrival. With ``history`` it has no more than so many
    rows, the last up to the alert. Slices of time keep a busy source from being one task; each has the rows that it looks back on.
    """
    rows = with_reach(alerts.select("alert_id", "us", "src_ip", "dst_ip", "event_type", "severity"), window, reach_slice(window))
    order = Window.partitionBy("src_ip", "_slice").orderBy("us")
    frame, last = order.rangeBetween(-window, 0), Window.partitionBy("src_ip", "_slice").orderBy("us", "alert_id").rowsBetween(1 - (history or 1), 0)
    pick = (lambda made: F.when(F.count("*").over(frame) > history, made.over(last)).otherwise(made.over(frame))) if history else (lambda made: made.over(frame))
    distinct = lambda c: F.size(pick(F.collect_set(c))).cast("long")
    rows = rows.select(
        "alert_id", "us", "src_ip", "_context", pick(F.count("*")).alias("size"), pick(F.min("us")).alias("first_us"), distinct("dst_ip").alias("targets"), distinct("event_type").alias("kinds"),
        pick(F.max("severity")).alias("max_severity"),
    )
    return rows.where(~F.col("_context") & (F.col("size") >= least)).drop("_context").withColumn("span_us", F.col("us") - F.col("first_us"))


def numbered(alerts: DataFrame, gap: int = GAP, key: str = "src_ip", tie: str = "alert_id", width: int = SLICE) -> DataFrame:
    """Adds ``session`` and ``place``, numbered from 1 in each entity, and the _slice of time; a session starts after more than ``gap`` without an alert.

    What starts within a slice is seen there; whether its first alert starts one is told by the last alert of the slice before. The sums over
    slices have a row for each, so an entity is as many tasks as it has slices.
    """
    order = Window.partitionBy(key, "_slice").orderBy("us", tie)
    rows = with_slice(alerts, width).withColumn("_starts", F.when(F.col("us") - F.lag("us").over(order) > gap, 1).otherwise(0))
    slices = rows.groupBy(key, "_slice").agg(F.min("us").alias("_first"), F.max("us").alias("_last"), F.sum("_starts").alias("_inner"), F.count("*").alias("_rows"))
    across = Window.partitionBy(key).orderBy("_slice")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_opens", F.when(F.col("_first") - F.lag("_last").over(across) <= gap, 0).otherwise(1))
    sessions_before = F.coalesce(F.sum(F.col("_opens") + F.col("_inner")).over(before), F.lit(0)) + F.col("_opens")
    slices = slices.select(key, "_slice", sessions_before.alias("_sessions"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_places"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_starts", F.sum("_starts").over(upto)).withColumn("_at", F.row_number().over(order))
    rows = meet(rows, slices, [key, "_slice"])
    return rows.withColumn("session", F.col("_sessions") + F.col("_starts")).withColumn("place", F.col("_places") + F.col("_at")).drop("_starts", "_at", "_sessions", "_places")


def sessions(alerts: DataFrame, gap: int = GAP, key: str = "src_ip", tie: str = "alert_id") -> DataFrame:
    """Adds ``session``, numbered from 1 in each entity: a new one starts where an alert comes more than ``gap`` after the one before."""
    return numbered(alerts, gap, key, tie).drop("_slice", "place")


def session_summary(alerts: DataFrame, gap: int = GAP) -> DataFrame:
    return sessions(alerts, gap).groupBy("src_ip", "session").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("alerts"), F.countDistinct("dst_ip").alias("targets"))


def session_recent(alerts: DataFrame, gap: int = GAP, last: int = WINDOW) -> DataFrame:
    """The alerts of each session in the last ``last`` of it."""
    rows = sessions(alerts, gap)
    newest = rows.groupBy("src_ip", "session").agg(F.max("us").alias("_newest"))
    return meet(rows, newest, ["src_ip", "session"]).where(F.col("us") >= F.col("_newest") - last).drop("_newest")


def expired(alerts: DataFrame, now_us: int, gap: int = GAP) -> DataFrame:
    """Sessions idle for more than ``gap`` at ``now_us`` whose alerts, at least two, show a pattern: what closes as a group of its own."""
    closed = attack_patterns(alerts, gap).where(F.lit(now_us) - F.col("end_us") > gap)
    return closed.withColumn("reason", F.concat(F.lit("session_expired_pattern_"), "pattern"))


def attack_patterns(alerts: DataFrame, gap: int = GAP, by: tuple[str, ...] = ("src_ip", "session")) -> DataFrame:
    """Per session of at least two alerts the first pattern in priority that it shows, the number of alerts that make it up, and its end.

    scan_to_exfiltration: the first scan before the first exfiltration, with all alerts between them; c2_beaconing: beaconing, with tunnelling
    and anomalies where there are any; lateral_movement: scan and lateral movement in any order; dns_tunneling: one tunnelling alert is enough.
    Places come from slices of time; the rest is one aggregation.
    """
    placed = numbered(alerts, gap).withColumnRenamed("place", "_n")
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("_n")))
    count = lambda *kinds: F.count(F.when(F.col("event_type").isin(*kinds), 1))
    rows = placed.groupBy(*by).agg(
        F.count("*").alias("alerts"), F.max("us").alias("end_us"), first("scan").alias("_scan"), first("exfiltration").alias("_exfil"), count("c2_beaconing").alias("_c2"), count("dns_tunneling", "anomaly").alias("_side"),
        count("lateral_movement").alias("_lateral"), count("scan").alias("_scans"), count("dns_tunneling").alias("_dns"),
    )
    exfil = F.col("_scan") < F.col("_exfil")
    name = (
        F.when(exfil, "scan_to_exfiltration")
        .when(F.col("_c2") > 0, "c2_beaconing")
        .when((F.col("_scans") > 0) & (F.col("_lateral") > 0), "lateral_movement")
        .when(F.col("_dns") > 0, "dns_tunneling")
    )
    size = (
        F.when(exfil, F.col("_exfil") - F.col("_scan") + 1).when(F.col("pattern") == "c2_beaconing", F.col("_c2") + F.col("_side"))
        .when(F.col("pattern") == "lateral_movement", F.col("_scans") + F.col("_lateral")).otherwise(F.col("_dns"))
    )
    found = rows.where("alerts >= 2").withColumn("pattern", name).where("pattern IS NOT NULL").withColumn("pattern_alerts", size.cast("long"))
    return found.select(*by, "alerts", "pattern", "pattern_alerts", "end_us")


def pattern_members(alerts: DataFrame, gap: int = GAP) -> DataFrame:
    """The alerts that make up each session's pattern: src_ip, session, pattern, alert_id."""
    by = ["src_ip", "session"]
    placed = numbered(alerts, gap).withColumnRenamed("place", "_n").drop("_slice")
    ends = placed.groupBy(*by).agg(*[F.min(F.when(F.col("event_type") == kind, F.col("_n"))).alias(name) for kind, name in (("scan", "_scan"), ("exfiltration", "_exfil"))])
    rows = placed.join(attack_patterns(alerts, gap).select(*by, "pattern"), by).join(ends, by)
    kind = F.col("event_type")
    inside = (
        F.when(F.col("pattern") == "scan_to_exfiltration", F.col("_n").between(F.col("_scan"), F.col("_exfil")))
        .when(F.col("pattern") == "c2_beaconing", kind.isin("c2_beaconing", "dns_tunneling", "anomaly"))
        .when(F.col("pattern") == "lateral_movement", kind.isin("scan", "lateral_movement"))
        .otherwise(kind == "dns_tunneling")
    )
    return rows.where(inside).select(*by, "pattern", "alert_id")


def candidate_groups(alerts: DataFrame, hour: Column, window: int = WINDOW, gap: int = GAP, least: int = 2) -> DataFrame:
    """What has to be looked at for each source's latest session: the window group of its newest alerts and the group of its pattern.

    Groups that hold a known false positive go, then those with the same alerts as an earlier one. (src_ip, session, reason, pattern, alert_ids)
    """
    by = ["src_ip", "session"]
    recent = session_recent(alerts, gap, window).select(*by, F.lit("shared_source_proximity").alias("reason"), F.lit(None).cast("string").alias("pattern"), "alert_id")
    shown = pattern_members(alerts, gap).select(*by, F.concat(F.lit("attack_pattern_"), "pattern").alias("reason"), "pattern", "alert_id")
    marks = alerts.select("alert_id", known_false_positive(F.col("backup"), F.col("scheduled"), F.col("event_type"), hour).alias("_known"))
    keys = [*by, "reason", "pattern"]
    groups = recent.unionByName(shown).join(marks, "alert_id").groupBy(*keys).agg(F.array_sort(F.collect_list("alert_id")).alias("alert_ids"), F.max("_known").alias("_known"))
    groups = groups.where(~F.col("_known") & (F.col("pattern").isNotNull() | (F.size("alert_ids") >= least)))
    return groups.groupBy(*by, "alert_ids").agg(F.min_by(F.struct("reason", "pattern"), F.col("pattern").isNotNull()).alias("g")).select(*by, "g.*", "alert_ids")


def window_starts(placed: DataFrame, window: int = WINDOW, history: int = HISTORY) -> DataFrame:
    """Adds ``start``, the place of the first alert in the window of each: no earlier than ``window`` before it, nor than the last ``history`` alerts.

    Each alert asks, at the far end of its window, how many alerts of its source there were before: one running count over alerts and
    questions together, instead of a frame that is walked again for each alert.
    """
    asked = placed.select("src_ip", (F.col("us") - window).alias("_at"), F.lit(0).alias("_is"), F.col("place"))
    both = asked.unionByName(placed.select("src_ip", F.col("us").alias("_at"), F.lit(1).alias("_is"), F.lit(None).cast("long").alias("place")))
    counted = running(with_slice(both, us="_at"), ["src_ip"], ["_at", "_is"], {"_before": F.col("_is")}).where("_is = 0").select("src_ip", "place", "_before")
    return meet(placed, counted, ["src_ip", "place"]).withColumn("start", F.greatest(F.col("_before") + 1, F.col("place") - (history - 1))).drop("_before")


def alert_groups(alerts: DataFrame, known: Column, window: int = WINDOW, gap: int = GAP, least: int = 2, history: int = HISTORY) -> DataFrame:
    """What each alert brings as it comes: the group of its source's window and that of the pattern of its session so far.

    (alert_id, us, src_ip, session, reason, pattern, size, first_place, last_place): places number the alerts of a source by (us, alert_id);
    a group of the window is all alerts between its places, one of a pattern those of the kinds that it consists of. Groups with a known false
    positive (``known``) go, then a pattern with the same alerts as the window. Counts of kinds run over slices of time, so neither a long
    session nor a busy source is walked again for each of its alerts. What is read several times is checkpointed.
    """
    kind, by = F.col("event_type"), ["src_ip", "session"]
    rows = numbered(alerts.withColumn("_known", F.coalesce(known, F.lit(False)).cast("int")), gap).select("alert_id", "us", "src_ip", "event_type", "session", "place", "_known", "_slice")
    rows = cut(running(cut(rows), ["src_ip"], ["us", "alert_id"], {"_all_known": F.col("_known")}))
    parts = {"c2": kind == "c2_beaconing", "side": kind.isin("dns_tunneling", "anomaly"), "scans": kind == "scan", "lateral": kind == "lateral_movement", "dns": kind == "dns_tunneling"}
    beaconing, moving = parts["c2"] | parts["side"], parts["scans"] | parts["lateral"]
    ones = lambda condition: F.when(condition, 1)
    totals = {f"_{n}": ones(c) for n, c in parts.items()} | {"_n": F.lit(1)}
    totals |= {f"_{n}_known": ones(c & (F.col("_known") == 1)) for n, c in (("c2", beaconing), ("lateral", moving), ("dns", parts["dns"]))}
    at = lambda condition: F.when(condition, F.col("place"))
    firsts = {"_first_c2": at(beaconing), "_first_lateral": at(moving), "_first_dns": at(parts["dns"])}
    firsts |= {"_scan": F.when(parts["scans"], F.struct("place", (F.col("_all_known") - F.col("_known")).alias("known"))), "_exfil": F.when(kind == "exfiltration", F.struct("place", F.col("_all_known").alias("known")))}
    lasts = {"_last_c2": at(beaconing), "_last_lateral": at(moving), "_last_dns": at(parts["dns"])}
    rows = running(rows, by, ["us", "alert_id"], totals, firsts, lasts)
    group = lambda name, size, first, last, known: F.struct(F.lit(name).alias("pattern"), size.cast("long").alias("size"), first.alias("first"), last.alias("last"), (known > 0).alias("known"))
    c = F.col
    shown = (
        F.when(c("_scan.place") < c("_exfil.place"), group("scan_to_exfiltration", c("_exfil.place") - c("_scan.place") + 1, c("_scan.place"), c("_exfil.place"), c("_exfil.known") - c("_scan.known")))
        .when(c("_c2") > 0, group("c2_beaconing", c("_c2") + c("_side"), c("_first_c2"), c("_last_c2"), c("_c2_known")))
        .when((c("_scans") > 0) & (c("_lateral") > 0), group("lateral_movement", c("_scans") + c("_lateral"), c("_first_lateral"), c("_last_lateral"), c("_lateral_known")))
        .when(c("_dns") > 0, group("dns_tunneling", c("_dns"), c("_first_dns"), c("_last_dns"), c("_dns_known")))
    )
    rows = cut(rows.withColumn("_shown", F.when(c("_n") >= 2, shown)).select("alert_id", "us", "src_ip", "session", "place", "_known", "_all_known", "_shown"))
    rows = cut(window_starts(rows, window, history))
    # Known ones before the window's first alert; only alerts that start a window are asked for.
    starts = rows.select("src_ip", c("place").alias("start"), (c("_all_known") - c("_known")).alias("_known_before"))
    rows = meet(rows, starts, ["src_ip", "start"])
    near = F.when((c("place") - c("start") + 1 >= least) & (c("_all_known") == c("_known_before")), F.struct(
        F.lit("shared_source_proximity").alias("reason"), F.lit(None).cast("string").alias("pattern"), (c("place") - c("start") + 1).alias("size"), c("start").alias("first_place"), c("place").alias("last_place"),
    ))
    same = c("_near").isNotNull() & (c("_near.size") == c("_shown.size")) & (c("_shown.first") >= c("start"))
    pattern = F.when(~c("_shown.known") & ~same, F.struct(
        F.concat(F.lit("attack_pattern_"), c("_shown.pattern")).alias("reason"), c("_shown.pattern"), c("_shown.size"), c("_shown.first").alias("first_place"), c("_shown.last").alias("last_place"),
    ))
    found = rows.withColumn("_near", near).select("alert_id", "us", "src_ip", "session", F.explode(F.array_compact(F.array(c("_near"), pattern))).alias("g"))
    return found.select("alert_id", "us", "src_ip", "session", "g.*")


def needs_no_explanation(alerts: Column, severity: Column, pattern: Column, least: int = 40) -> Column:
    """A single alert of a severity below ``least`` that is part of no pattern."""
    return (alerts == 1) & (severity < least) & pattern.isNull()


def known_false_positive(backup: Column, scheduled: Column, event_type: Column, hour: Column) -> Column:
    """An authorised activity, or a scheduled exfiltration between two and four at night."""
    return backup | ((event_type == "exfiltration") & hour.between(2, 4) & scheduled)


def drop_false_positives(alerts: DataFrame, by: list[str], hour: Column) -> DataFrame:
    """Groups none of whose alerts is a known false positive."""
    bad = alerts.where(known_false_positive(F.col("backup"), F.col("scheduled"), F.col("event_type"), hour)).select(*by).distinct()
    return alerts.join(bad, by, "left_anti")


def group_dedup(groups: DataFrame, prefer_pattern: bool = False) -> DataFrame:
    """Of groups with the same alerts the first, by ``ord``; with prefer_pattern a named pattern comes before that.

    ``groups`` has ord, reason, pattern and alert_ids.
    """
    key = F.array_join(F.transform(F.array_sort("alert_ids"), lambda x: x.cast("string")), ",")
    order = F.struct(F.col("pattern").isNull(), "ord") if prefer_pattern else F.struct("ord")
    return groups.withColumn("members", key).groupBy("members").agg(F.min_by(F.struct("ord", "reason", "pattern"), order).alias("g")).select("members", "g.*")


def group_metrics(alerts: DataFrame, by: list[str]) -> DataFrame:
    """Span, distinct sources and targets, hosts as they first occur, and confidence-weighted severity of each group; the plain mean without confidence."""
    weighted = F.when(F.sum("confidence") > 0, F.sum(F.col("severity") * F.col("confidence")) / F.sum("confidence")).otherwise(F.avg("severity"))
    rows = alerts.groupBy(*by).agg(
        F.count("*").alias("alerts"), (F.max("us") - F.min("us")).alias("span_us"), F.countDistinct("src_ip").alias("sources"), F.countDistinct("dst_ip").alias("targets"), weighted.alias("severity"),
    )
    return rows.join(in_order(alerts, by, "host", "hosts"), by, "left").withColumn("hosts", F.array_join("hosts", ","))


def in_order(alerts: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """The distinct values of a column of each group, in the order in which they first occur. A row for each value meets in the second aggregation."""
    firsts = alerts.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.min(F.struct("us", "alert_id")).alias("_first"))
    return firsts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", column))), lambda v: v[column]).alias(name))


def group_entities(alerts: DataFrame, by: list[str], source: str = "source") -> DataFrame:
    """What an incident lists of each group: src_hosts as they first occur, dst_hosts (none are known), src_ips and dst_ips in order, and its metrics.

    Metrics: alert_count, time_span_seconds, unique_sources (what raised the alerts), unique_destinations.
    """
    rows = alerts.groupBy(*by).agg(
        F.array_sort(F.collect_set("src_ip")).alias("src_ips"), F.array_sort(F.collect_set("dst_ip")).alias("dst_ips"), F.count("*").alias("alert_count"), ((F.max("us") - F.min("us")) / 1_000_000).alias("time_span_seconds"),
        F.countDistinct(source).alias("unique_sources"), F.countDistinct("dst_ip").alias("unique_destinations"),
    )
    none = F.array().cast("array<string>")
    rows = rows.join(in_order(alerts, by, "host", "src_hosts"), by, "left")
    return rows.withColumn("src_hosts", F.coalesce("src_hosts", none)).withColumn("dst_hosts", none)
