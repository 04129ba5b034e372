"""Weak labels from several sources, and their weighted consensus.

A weak label has event_id, us, src_ip, dst_ip, source, label (true, false or null for abstaining), confidence, event_type and ord, the
place of the vote among those of its event.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.scalars import tactic_event_type
from flowlens.operators import matching


@dataclass(frozen=True)
class LabelSource:
    """A labelling function: (records, least confidence) -> weak labels, with its weight and least confidence.

    The function applies the minimum itself, since a source may lower the confidence after the check.
    """

    name: str
    weight: float
    min_confidence: float
    label: Callable[[DataFrame, float], DataFrame]

    def weak_labels(self, records: DataFrame) -> DataFrame:
        return self.label(records, self.min_confidence).withColumn("source", F.lit(self.name))


SOURCES: dict[str, LabelSource] = {}


def register_label_source(name: str, weight: float, min_confidence: float, label: Callable[[DataFrame, float], DataFrame]) -> LabelSource:
    SOURCES[name] = LabelSource(name, weight, min_confidence, label)
    return SOURCES[name]


def _table(column: str, table: dict, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col(column)], F.lit(default))


#: Confidences by severity or threat level, and event types by category, rule group and vendor category.
IDS_CONFIDENCE = {1: 0.95, 2: 0.80, 3: 0.60}
INTEL_CONFIDENCE = {1: 0.95, 2: 0.85, 3: 0.70, 4: 0.60}
VENDOR_CONFIDENCE = {"critical": 1.0, "high": 0.9, "medium": 0.7, "low": 0.5}
IDS_TYPES = {
    "Trojan Activity": "c2_beaconing",
    "Attempted Administrator Privilege Gain": "lateral_movement",
    "Attempted User Privilege Gain": "lateral_movement",
    "Data Exfiltration": "exfiltration",
    "DNS Tunneling": "dns_tunneling",
    "Network Scan": "scan",
    "Malware Command and Control Activity Detected": "c2_beaconing",
}
HIDS_TYPES = {
    "syscheck": "file_integrity",
    "rootcheck": "rootkit",
    "auth": "auth_anomaly",
    "web": "web_attack",
    "malware": "malware",
    "vulnerability-detector": "vulnerability",
    "sql_injection": "sql_injection",
    "xss": "xss",
}
VENDOR_TYPES = ("exfiltration", "c2_beaconing", "lateral_movement", "dns_tunneling", "scan")


def _technique(records: DataFrame) -> Column:
    """The id of the attack technique that a record names, null where records have none."""
    return (F.col("mitre_attack_id") if "mitre_attack_id" in records.columns else F.lit(None)).cast("string").alias("mitre_attack_id")


def ids_labels(records: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Signature alerts: confidence by severity, type by category."""
    rows = records.withColumn("_c", _table("severity", IDS_CONFIDENCE, 0.5)).where(F.col("_c") >= min_confidence)
    return rows.select("label_id", F.lit(True).alias("label"), F.col("_c").alias("confidence"), _table("category", IDS_TYPES, "anomaly").alias("event_type"), _technique(records))


def hids_labels(records: DataFrame, min_confidence: float = 0.5, least_level: int = 6) -> DataFrame:
    """Host-agent alerts of at least ``least_level``: confidence by level, type by the first known rule group.

    Where both addresses miss, the confidence is lowered after the check of the minimum; the agent stands in for a missing source.
    """
    level = F.col("level")
    confidence = F.when(level >= 12, 0.95).when(level >= 9, 0.85).when(level >= 6, 0.70).when(level >= 3, 0.50).otherwise(0.30)
    source, target = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("src_ip", "dst_ip"))
    types = F.create_map(*[F.lit(x) for pair in HIDS_TYPES.items() for x in pair])
    kind = F.element_at(F.filter(F.transform("groups", lambda g: types[g]), lambda t: t.isNotNull()), 1)
    rows = records.where(level >= least_level).withColumn("_c", confidence).where(F.col("_c") >= min_confidence)
    kind = F.when(F.size(F.filter("groups", lambda g: types[g].isNotNull())) > 0, kind).otherwise("anomaly")
    return rows.select(
        "label_id", F.lit(True).alias("label"), (F.col("_c") * F.when((source == "") & (target == ""), 0.7).otherwise(1.0)).alias("confidence"), kind.alias("event_type"),
        F.when(source == "", F.concat(F.lit("agent:"), F.col("agent_id").cast("string"))).otherwise(source).alias("src_ip"), target.alias("dst_ip"),
    )


def intel_labels(records: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Threat intelligence: confidence by threat level (1 to 4, else as 4), type by the first telling tags."""
    tagged = lambda *names: F.arrays_overlap("tags", F.array(*[F.lit(n) for n in names]))
    kind = F.when(tagged("c2", "botnet"), "c2_beaconing").when(tagged("exfiltration"), "exfiltration").when(tagged("scan", "recon"), "scan").otherwise("threat_intel_match")
    rows = records.withColumn("_c", _table("threat_level", INTEL_CONFIDENCE, 0.6)).where(F.col("_c") >= min_confidence)
    return rows.select("label_id", F.lit(True).alias("label"), F.col("_c").alias("confidence"), kind.alias("event_type"), _technique(records))


def correlation_labels(records: DataFrame, min_confidence: float = 0.3, factor: float = 0.8) -> DataFrame:
    """Correlated incidents: their confidence times ``factor``, type by tactic."""
    rows = records.withColumn("_c", F.col("confidence") * factor).where(F.col("_c") >= min_confidence)
    return rows.select("label_id", F.lit(True).alias("label"), F.col("_c").alias("confidence"), tactic_event_type("tactic").alias("event_type"), _technique(records))


def analyst_labels(records: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    return records.select("label_id", "label", F.lit(1.0).alias("confidence"), F.lit("analyst_confirmed").alias("event_type"))


def vendor_labels(records: DataFrame, min_confidence: float = 0.5, minimum: Column | None = None, deduplicate: bool = True) -> DataFrame:
    """Vendor alerts for which ``minimum`` holds: confidence by the exact severity name, type by category; one a second at the same addresses."""
    rows = records if minimum is None else records.where(minimum)
    if deduplicate:
        rows = rows.join(matching.dedup_labels(rows).select("label_id"), "label_id", "left_semi")
    kind = F.when(F.col("vendor_category").isin(*VENDOR_TYPES), F.col("vendor_category")).otherwise("anomaly")
    rows = rows.withColumn("_c", _table("severity_name", VENDOR_CONFIDENCE, 0.5)).where(F.col("_c") >= min_confidence)
    return rows.select("label_id", F.lit(True).alias("label"), F.col("_c").alias("confidence"), kind.alias("event_type"))


register_label_source("ids", 1.2, 0.5, ids_labels)
register_label_source("hids", 1.0, 0.5, hids_labels)
register_label_source("intel", 1.3, 0.5, intel_labels)
register_label_source("correlation", 0.7, 0.3, correlation_labels)
register_label_source("analyst", 2.0, 0.0, analyst_labels)
register_label_source("vendor", 1.5, 0.5, vendor_labels)


def label_events(events: DataFrame, records: dict[str, DataFrame], window: int = matching.WINDOW, weights: dict[str, float] | None = None) -> DataFrame:
    """End to end: each source labels its records, labels go to the nearest event at their addresses within ``window``, votes are agreed upon.

    events: event_id, us, src_ip, dst_ip; records by source name, each with label_id, us, src_ip, dst_ip and what its source reads, with the
    id of an attack technique as ``mitre_attack_id`` where it has one.
    """
    votes = None
    for place, (name, rows) in enumerate(records.items()):
        made = SOURCES[name].weak_labels(rows)
        at = rows.select("label_id", "us", "src_ip", "dst_ip")
        technique = "mitre_attack_id" if "mitre_attack_id" in made.columns else F.lit(None).cast("string").alias("mitre_attack_id")
        matched = matching.match_events(at.join(made.select("label_id"), "label_id", "left_semi"), events, window).select("label_id", "event_id")
        part = made.select("label_id", "label", "confidence", "event_type", "source", technique).join(at, "label_id").join(matched, "label_id")
        ord_ = F.struct(F.lit(place).alias("source"), "label_id").alias("ord")
        part = part.select("event_id", "us", "src_ip", "dst_ip", "source", "label", "confidence", "event_type", "mitre_attack_id", ord_)
        votes = part if votes is None else votes.unionByName(part)
    return consensus(votes, weights)


def supervised(agreed: DataFrame) -> DataFrame:
    """Consensus as training labels: event_id, us, label, source, confidence, event_type."""
    return agreed.select("event_id", "us", "label", F.lit("consensus").alias("source"), "confidence", "event_type")


def consensus(votes: DataFrame, weights: dict[str, float] | None = None, abstain: float = 0.0, decision: float = 0.0, analyst: str | None = "analyst") -> DataFrame:
    """What the votes of each event agree on, for events that get a label.

    (event_id, us, src_ip, dst_ip, label, confidence, score, event_type, mitre_attack_id, sources, breakdown, votes_positive, votes_negative,
    votes_abstain). Abstentions and votes without an event are dropped first. The score is the weighted mean of the signed votes; without weight, or
    below ``abstain``, there is no label. The latest analyst vote, the first of several at one time, overrides it with confidence 1, without counts and
    breakdown; the order of sums does not decide (12 digits). Time and addresses are those of the first vote, type and technique those of the first that has one; ``breakdown`` has the last
    vote of each source. All of it is one aggregation by event. Addresses and technique are null where votes have none.
    """
    weights = weights if weights is not None else {s.name: s.weight for s in SOURCES.values()}
    there = [c if c in votes.columns else F.lit(None).cast("string").alias(c) for c in ("src_ip", "dst_ip", "mitre_attack_id")]
    said = votes.select("event_id", "us", "source", "label", "confidence", "event_type", "ord", *there).where("event_id IS NOT NULL AND event_id <> '' AND label IS NOT NULL" if dict(votes.dtypes)["event_id"] == "string" else "event_id IS NOT NULL AND label IS NOT NULL")
    said = said.withColumn("_weight", _table("source", weights, 1.0))
    w, sign = F.col("_weight") * F.col("confidence"), F.when(F.col("label"), 1.0).otherwise(-1.0)
    # The last vote of a source is told before the event's: a row per (event, source) meets in the second aggregation.
    by_source = said.groupBy("event_id", "source").agg(
        F.sum(sign * w).alias("_num"), F.sum(w).alias("_den"), F.min(F.struct(-F.col("us"), "ord", "label")).alias("_latest"), F.min(F.struct("ord", "us", "src_ip", "dst_ip")).alias("_first"),
        F.min(F.when(F.col("event_type") != "", F.struct("ord", "event_type"))).alias("_type"), F.min(F.when(F.col("mitre_attack_id") != "", F.struct("ord", "mitre_attack_id"))).alias("_technique"),
        F.max(F.struct("ord", "label", "confidence", F.col("_weight").alias("weight"))).alias("_last"), F.count(F.when(F.col("label"), 1)).alias("_pos"), F.count(F.when(~F.col("label"), 1)).alias("_neg"),
    )
    rows = by_source.groupBy("event_id").agg(
        F.sum("_num").alias("_num"), F.sum("_den").alias("_den"), F.min(F.when(F.col("source") == (analyst or ""), F.col("_latest"))).alias("_analyst"), F.min("_first").alias("_first"), F.min("_type").alias("_type"),
        F.min("_technique").alias("_technique"), F.array_sort(F.collect_list(F.struct("source", F.struct("_last.label", "_last.confidence", "_last.weight").alias("vote")))).alias("_votes"),
        F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"),
    )
    overridden = F.col("_analyst").isNotNull()
    out = rows.withColumn("score", F.when(F.col("_den") > 0, F.col("_num") / F.col("_den"))).where(overridden | (F.abs("score") >= abstain))
    count = lambda c: F.when(overridden, F.lit(0)).otherwise(c).cast("long")
    none = F.create_map().cast("map<string,struct<label:boolean,confidence:double,weight:double>>")
    return out.select(
        "event_id", F.col("_first.us").alias("us"), F.col("_first.src_ip").alias("src_ip"), F.col("_first.dst_ip").alias("dst_ip"), F.when(overridden, F.col("_analyst.label")).otherwise(F.round("score", 12) > decision).alias("label"),
        F.when(overridden, 1.0).otherwise(F.abs("score")).alias("confidence"), "score", F.col("_type.event_type").alias("event_type"), F.col("_technique.mitre_attack_id").alias("mitre_attack_id"),
        F.concat_ws(",", "_votes.source").alias("sources"), F.when(overridden, none).otherwise(F.map_from_entries("_votes")).alias("breakdown"),
        count(F.col("_pos")).alias("votes_positive"), count(F.col("_neg")).alias("votes_negative"), F.lit(0).cast("long").alias("votes_abstain"),
    )


def source_stats(votes: DataFrame) -> DataFrame:
    """Votes by source: count, positive, negative, abstained, mean confidence."""
    return votes.groupBy("source").agg(F.count("*").alias("n"), F.count(F.when(F.col("label"), 1)).alias("positive"), F.count(F.when(~F.col("label"), 1)).alias("negative"), F.count(F.when(F.col("label").isNull(), 1)).alias("abstained"), F.avg("confidence").alias("avg_confidence"))


def unlabeled(events: DataFrame, agreed: DataFrame) -> DataFrame:
    """Events without a consensus."""
    return events.join(agreed.select("event_id"), "event_id", "left_anti")


def incidents(agreed: DataFrame, least: float = 0.5) -> DataFrame:
    return agreed.where(F.col("label") & (F.col("confidence") > least))
