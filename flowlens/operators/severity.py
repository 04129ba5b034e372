"""Enrichment, severity and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.scalars import severity_label
from flowlens.operators import ranges
from flowlens.session import cut

WEIGHTS = {"model": 0.40, "asset": 0.25, "intel": 0.15, "history": 0.10, "correlation": 0.10}

#: Names of the enrichments, in order, and tags that make an address suspicious without its being known as malicious.
ENRICHMENTS = ("asset", "geoip", "threat_intel", "historical")
SUSPICIOUS_TAGS = ("botnet", "c2-server", "malware", "phishing", "suspicious")


def _failing(rows: DataFrame | None) -> Column:
    """Whether a row of a look-up stands for one that was not answered."""
    return F.coalesce(F.col("failed"), F.lit(False)) if rows is not None and "failed" in rows.columns else F.lit(False)


def enrich(groups: DataFrame, assets: DataFrame | None, geo: DataFrame | None, intel: DataFrame | None, history: DataFrame | None) -> DataFrame:
    """Adds what the four look-ups know of each group, and which of them failed.

    groups: src_ip, session, and target_ips, an array of distinct targets in the order in which they are asked for; assets: src_ip, criticality;
    geo: ranges first, last with country; intel: ip, tag; history: src_ip, deviation. Adds criticality (2 where unknown or 0), country of the
    first target that lies in a range, malicious with the tags of the first address, source before targets, that is known, suspicious (its
    tags say so), deviation of the source's main target. A source of enrichment fails where it is None, or where the look-up that counts has ``failed``
    set; then it knows nothing. A look-up without a hit is no failure. Targets that are no numbers, pseudonyms among them, are in no range.
    """
    keys, groups = ["src_ip", "session"], cut(groups)  # read once for each look-up
    down = {name: F.lit(table is None) for name, table in zip(ENRICHMENTS, (assets, geo, intel, history))}
    rows = groups
    if assets is not None:
        known = assets.groupBy("src_ip").agg(F.max_by("criticality", F.col("criticality")).alias("_criticality"), F.max(_failing(assets)).alias("_asset"))
        rows = rows.join(known, "src_ip", "left")
        down["asset"] = F.coalesce("_asset", F.lit(False))
    else:
        rows = rows.withColumn("_criticality", F.lit(None).cast("int"))
    if geo is not None:
        targets = groups.select(*keys, F.posexplode("target_ips").alias("_place", "_ip"))
        found = ranges.locate(targets, geo, "_ip").select("number", "country")
        met = targets.join(found, targets["_ip"].cast("long") == found["number"]).groupBy(*keys).agg(F.min_by("country", "_place").alias("country"))
        rows = rows.join(met, keys, "left")
    else:
        rows = rows.withColumn("country", F.lit(None).cast("string"))
    if intel is not None:
        known = intel.groupBy("ip").agg(F.array_sort(F.collect_set("tag")).alias("_tags"), F.max(_failing(intel)).alias("_intel"))
        addresses = groups.select(*keys, F.posexplode(F.concat(F.array("src_ip"), "target_ips")).alias("_place", "ip"))
        met = addresses.join(known, "ip").groupBy(*keys).agg(F.min_by(F.struct("_tags", "_intel"), "_place").alias("_met"))
        rows = rows.join(met, keys, "left")
        down["threat_intel"] = F.coalesce("_met._intel", F.lit(False))
    else:
        rows = rows.withColumn("_met", F.lit(None).cast("struct<_tags:array<string>,_intel:boolean>"))
    if history is not None:
        rows = rows.join(history.groupBy("src_ip").agg(F.max("deviation").alias("_deviation"), F.max(_failing(history)).alias("_historical")), "src_ip", "left")
        down["historical"] = F.coalesce("_historical", F.lit(False))
    else:
        rows = rows.withColumn("_deviation", F.lit(None).cast("double"))
    rows = rows.withColumn("_down", F.array_compact(F.array(*[F.when(down[e], e) for e in ENRICHMENTS])))
    hit = F.col("_met").isNotNull() & ~down["threat_intel"]
    rows = rows.withColumns({
        "criticality": F.coalesce(F.when(~down["asset"] & (F.col("_criticality") > 0), F.col("_criticality")), F.lit(2)), "malicious": hit, "tags": F.when(hit, F.concat_ws(",", "_met._tags")),
        "suspicious": hit & F.coalesce(F.arrays_overlap("_met._tags", F.array(*[F.lit(t) for t in SUSPICIOUS_TAGS])), F.lit(False)), "deviation": F.when(~down["historical"], F.col("_deviation")),
        "failed_sources": F.array_join("_down", ","), "partial": F.size("_down") > 0,
    })
    return rows.drop("_criticality", "_asset", "_met", "_deviation", "_historical", "_down")


def components(model: Column, criticality: Column, malicious: Column, suspicious: Column, deviation: Column, alerts: Column) -> dict[str, Column]:
    """The five parts of the severity, each from 0 to 100."""
    cap = lambda c: F.least(F.lit(100.0), c)
    return {
        "model": model.cast("double"), "asset": cap(criticality * 20.0), "intel": F.when(malicious, 100.0).when(suspicious, 50.0).otherwise(0.0),
        "history": cap(F.coalesce(deviation, F.lit(0.0)) * 10.0), "correlation": cap(alerts * 25.0),
    }


def severity(parts: dict[str, Column]) -> Column:
    """The weighted sum; times 1.2 where intelligence is sure and the asset critical, times 1.1 where correlation and model are high; half-even."""
    total = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    total = F.when((parts["intel"] >= 100) & (parts["asset"] >= 80), F.least(F.lit(100.0), total * 1.2)).otherwise(total)
    total = F.when((parts["correlation"] >= 100) & (parts["model"] >= 70), F.least(F.lit(100.0), total * 1.1)).otherwise(total)
    return F.bround(F.round(F.least(F.lit(100.0), total), 9)).cast("int")


def bonus(parts: dict[str, Column]) -> Column:
    """Whether one of the two factors was applied."""
    return ((parts["intel"] >= 100) & (parts["asset"] >= 80)) | ((parts["correlation"] >= 100) & (parts["model"] >= 70))


def score_groups(enriched: DataFrame) -> DataFrame:
    """Adds the five components, ``severity_score``, ``severity_label`` and ``bonus_applied``."""
    parts = components(F.col("severity"), F.col("criticality"), F.col("malicious"), F.col("suspicious"), F.col("deviation"), F.col("alerts"))
    rows = enriched.withColumns({f"c_{k}": v for k, v in parts.items()})
    rows = rows.withColumn("severity_score", severity({k: F.col(f"c_{k}") for k in parts})).withColumn("bonus_applied", bonus({k: F.col(f"c_{k}") for k in parts}))
    return rows.withColumn("severity_label", severity_label("severity_score"))


#: Actions that wait for a hand, and the ladder of actions by severity: action, target, priority, runs by itself, justification.
DESTRUCTIVE = ("isolate_host", "block_ip", "block_domain", "quarantine")
LADDER = {
    "critical": (
        ("notify_soc", "soc-team", "immediate", True, "Severidad crítica requiere notificación inmediata"), ("create_ticket", "thehive", "immediate", True, "Crear caso para tracking"),
        ("isolate_host", None, "high", False, "Aislamiento requiere aprobación humana"),
    ),
    "high": (("notify_soc", "soc-team", "high", True, "Severidad alta requiere notificación"), ("create_ticket", "thehive", "high", True, "Crear caso para tracking")),
    "medium": (("create_ticket", "thehive", "medium", True, "Crear caso para monitorización"),),
    "low": (("log_only", "opensearch", "low", True, "Severidad baja, solo logging"),),
}


def actions(label: Column, host: Column) -> Column:
    """The ladder's actions for a severity label: array<struct<action, target, priority, auto_execute, justification>>; ``host`` is to be isolated."""
    names = ("action", "target", "priority", "auto_execute", "justification")
    one = lambda a: F.struct(*[(host.cast("string") if value is None else F.lit(value)).alias(name) for name, value in zip(names, a)])
    out = None
    for name, ladder in LADDER.items():
        made = F.array(*map(one, ladder))
        out = F.when(label == name, made) if out is None else out.when(label == name, made)
    return out.otherwise(F.array(one(LADDER["low"][0])))


def adjusted(score: Column, adjustment: Column) -> Column:
    """A score with an outside adjustment of at most 20 either way, within 0 and 100."""
    return F.least(F.lit(100), F.greatest(F.lit(0), score + F.least(F.lit(20), F.greatest(F.lit(-20), adjustment))))


def incidents(scored: DataFrame) -> DataFrame:
    """The deterministic incident of each group: title, description, correlation_reason, false_positive_assessment and recommended_actions.

    scored: alerts, kinds (sorted, comma and space joined), src_ip, hosts, pattern (null without one), reason, severity_score, severity_label,
    malicious, deviation. The wording is fixed. Only a group that an attack pattern brought, not one of an expired session, is said to follow it;
    without ``reason`` every pattern counts as one.
    """
    by_pattern = F.col("reason").startswith("attack_pattern") if "reason" in scored.columns else F.col("pattern").isNotNull()
    text = lambda c: F.col(c).cast("string")
    kinds = F.when(F.coalesce(F.col("kinds"), F.lit("")) == "", "anomalía").otherwise(F.col("kinds"))
    title = F.concat(F.lit("Incidente correlacionado: "), kinds, F.lit(" ("), text("alerts"), F.lit(" alertas, severidad "), text("severity_score"), F.lit(")"))
    description = F.concat(
        F.lit("Incidente correlacionado por scoring automático (LLM no disponible). "), text("alerts"), F.lit(" alertas, severidad "), text("severity_score"), F.lit(". "),
        F.when(F.coalesce(F.col("kinds"), F.lit("")) != "", F.concat(F.lit("Tipos de evento: "), F.col("kinds"), F.lit(". "))).otherwise(""), F.lit("Entidad: "), text("src_ip"), F.lit(". "),
        F.when(F.col("pattern").isNotNull(), F.concat(F.lit("Patrón detectado: "), F.col("pattern"), F.lit("."))).otherwise(""),
    )
    how = F.when(by_pattern, F.concat(F.lit(" y siguen el patrón de ataque "), F.col("pattern"))).otherwise(" y ocurren en proximidad temporal")
    reason = F.concat(F.lit("Las "), text("alerts"), F.lit(" alertas comparten la misma entidad ("), text("src_ip"), F.lit(")"), how, F.lit("."))
    judged = (
        F.when(F.col("malicious"), "IP destino marcada como maliciosa en threat intel. FP descartado.")
        .when(F.col("deviation") > 5, "Desviación significativa del baseline histórico. FP improbable.")
        .otherwise("Datos insuficientes para evaluación automática. Requiere revisión manual.")
    )
    host = F.coalesce(F.element_at(F.split("hosts", ","), 1), text("src_ip"))
    rows = scored.withColumn("title", title).withColumn("description", description).withColumn("correlation_reason", reason)
    rows = rows.withColumn("false_positive_assessment", F.concat(F.lit("Evaluación automática (sin LLM): "), judged))
    return rows.withColumn("recommended_actions", actions(F.col("severity_label"), host))


#: What an outside explanation may say: a title of so many characters, an adjustment of so many points either way.
TITLE_CHARS, MOST_ADJUSTMENT = 100, 20
_ACTION = "array<struct<action:string,target:string,priority:string,auto_execute:boolean,justification:string>>"


def valid_explanation(row: str = "e") -> Column:
    """Whether an explanation (a struct) has all its texts, a title that is not too long, a confidence from 0 to 1 and an adjustment in bounds."""
    e = F.col(row)
    texts = ("title", "description", "explanation", "correlation_reason", "false_positive_assessment")
    ok = (F.length(e["title"]) <= TITLE_CHARS) & e["confidence"].between(0, 1) & F.coalesce(e["severity_adjustment"], F.lit(0)).between(-MOST_ADJUSTMENT, MOST_ADJUSTMENT)
    for t in texts:
        ok = ok & e[t].isNotNull()
    return F.coalesce(ok, F.lit(False))


def with_explanation(made: DataFrame, outside: DataFrame, by: list[str]) -> DataFrame:
    """Incidents of ``incidents`` with what an outside system explains of them, where that is valid; the others stay as they are.

    outside: ``by``, title, description, explanation, correlation_reason, false_positive_assessment, severity_adjustment, confidence and
    recommended_actions. The severity is moved within 0 and 100, its label follows if it was moved; the actions are the outside ones, of which
    those without a name go and no destructive one runs by itself. Adds explanation, confidence, xai_available and tags.
    """
    told = outside.select(*[F.col(k).alias(f"_key_{k}") for k in by], F.struct(*[c for c in outside.columns if c not in by]).alias("e"))
    told = told.where(valid_explanation()).groupBy(*[f"_key_{k}" for k in by]).agg(F.max_by("e", F.col("e.confidence")).alias("e"))
    same = F.lit(True)
    for k in by:
        same = same & (F.col(k) == F.col(f"_key_{k}"))
    rows = made.join(told, same, "left").drop(*[f"_key_{k}" for k in by])
    has, move = F.col("e").isNotNull(), F.coalesce("e.severity_adjustment", F.lit(0))
    score = F.when(has, adjusted(F.col("severity_score"), move).cast("int")).otherwise(F.col("severity_score"))
    by_hand = lambda a: F.struct(
        a["action"].alias("action"), F.coalesce(a["target"], F.lit("")).alias("target"), F.coalesce(a["priority"], F.lit("medium")).alias("priority"),
        (F.coalesce(a["auto_execute"], F.lit(False)) & ~a["action"].isin(*DESTRUCTIVE)).alias("auto_execute"), F.coalesce(a["justification"], F.lit("")).alias("justification"),
    )
    theirs = F.transform(F.filter(F.coalesce("e.recommended_actions", F.array().cast(_ACTION)), lambda a: F.coalesce(a["action"], F.lit("")) != ""), by_hand)
    text = {c: F.coalesce(F.col(f"e.{c}"), F.col(c)) for c in ("title", "description", "correlation_reason", "false_positive_assessment")}
    return rows.withColumns({
        **text, "explanation": F.col("e.explanation"), "confidence": F.coalesce("e.confidence", F.lit(0.5)), "recommended_actions": F.when(has, theirs).otherwise(F.col("recommended_actions")),
        "severity_label": F.when(has & (move != 0), severity_label(score)).otherwise(F.col("severity_label")), "severity_score": score, "xai_available": has,
        "tags": F.when(has, F.array().cast("array<string>")).otherwise(F.array(F.lit("needs_xai_reprocess"))),
    }).drop("e")


#: Fixed value: the last entry of a timeline.
PUBLISHED = "Brain: incidente correlacionado y publicado"


def iso_time(us: str | Column) -> Column:
    """Epoch microseconds as ISO time in UTC, with a fraction only where there is one."""
    us = F.col(us) if isinstance(us, str) else us
    seconds, fraction = F.floor(us / 1_000_000), F.pmod(us, F.lit(1_000_000))
    day, of_day = F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")), F.pmod(seconds, F.lit(86_400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(of_day / 3600), F.floor(of_day % 3600 / 60), of_day % 60)
    return F.concat(day.cast("string"), F.lit("T"), clock, F.when(fraction > 0, F.format_string(".%06d", fraction)).otherwise(""), F.lit("Z"))


def timeline(alerts: DataFrame, by: list[str], published_us: int) -> DataFrame:
    """The alerts of a group in order as entries (timestamp, event), with a closing one at ``published_us``.

    An event is told by what its alert has of source, event_type, ml_score, severity and rule_message. Entries of equal time are in order of alert_id.
    """
    text = lambda c, made: F.when(F.col(c).isNotNull(), made(F.col(c).cast("string"))) if c in alerts.columns else F.lit(None).cast("string")
    filled = lambda c, made: F.when(F.col(c) != "", made(F.col(c))) if c in alerts.columns else F.lit(None).cast("string")
    event = F.concat_ws(
        " ", filled("source", lambda v: v), filled("event_type", lambda v: F.concat(F.lit("("), v, F.lit(")"))), text("ml_score", lambda v: F.concat(F.lit("score "), v)),
        text("severity", lambda v: F.concat(F.lit("severidad "), v)), filled("rule_message", lambda v: F.concat(F.lit("— "), v)),
    )
    event = F.when(event == "", F.concat(F.lit("Alerta "), F.substring(F.col("alert_id").cast("string"), 1, 8))).otherwise(event)
    rows = alerts.select(*by, F.struct("us", "alert_id", iso_time("us").alias("timestamp"), event.alias("event")).alias("e")).groupBy(*by).agg(F.array_sort(F.collect_list("e")).alias("_e"))
    entries = F.transform("_e", lambda e: F.struct(e["timestamp"].alias("timestamp"), e["event"].alias("event")))
    last = F.struct(iso_time(F.lit(published_us)).alias("timestamp"), F.lit(PUBLISHED).alias("event"))
    return rows.select(*by, F.concat(entries, F.array(last)).alias("timeline"))


def validate(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with the failed checks in ``error``); a check that is null fails."""
    failed = F.concat_ws(",", *[F.when(~F.coalesce(c, F.lit(False)), name) for name, c in checks.items()])
    marked = rows.withColumn("error", failed)
    return marked.where("error = ''").drop("error"), marked.where("error <> ''")


def weekly_report(incidents_: DataFrame) -> DataFrame:
    """Per event type: incidents, true and false positives, share of false ones; categories with most false ones first."""
    false = F.count(F.when(F.col("verdict") == "false_positive", 1))
    return incidents_.groupBy("event_type").agg(F.count("*").alias("n"), false.alias("false_positives"), (false / F.count("*")).alias("fp_rate")).orderBy(F.desc("false_positives"), "event_type")


def comparison_report(ours: DataFrame, theirs: DataFrame, received: DataFrame) -> DataFrame:
    """One row of weekly figures of two systems' incidents (true_positive, ttd_seconds, explained) and the alerts received.

    coverage and precision in percent, advantage, mean time to detect in minutes with its difference in percent, share of false positives,
    reduction from alerts to incidents, and availability of explanations. What has nothing to compare with is 100 for coverage, else 0.
    """
    mine = ours.agg(F.count("*").alias("n"), F.count(F.when(F.col("true_positive"), 1)).alias("tp"), F.avg("ttd_seconds").alias("ttd"), F.count(F.when(F.col("explained"), 1)).alias("explained"))
    other = theirs.agg(F.count("*").alias("other_n"), F.avg("ttd_seconds").alias("other_ttd"))
    every = received.agg(F.count("*").alias("received"))
    row = mine.crossJoin(other).crossJoin(every)  # one row each
    share = lambda a, b, none=0.0: F.when(b > 0, a / b * 100).otherwise(none)
    n, tp, m, r = F.col("n"), F.col("tp"), F.col("other_n"), F.col("received")
    ttd, other_ttd = F.coalesce(F.col("ttd"), F.lit(0.0)) / 60, F.coalesce(F.col("other_ttd"), F.lit(0.0)) / 60
    return row.select(
        n.alias("incidents"), m.alias("other_incidents"), share(n, m, 100.0).alias("coverage"), share(tp, n).alias("precision_pct"), (n - m).alias("advantage"), ttd.alias("mttd_minutes"), other_ttd.alias("other_mttd_minutes"),
        F.when(other_ttd > 0, (ttd - other_ttd) / other_ttd * 100).otherwise(0.0).alias("mttd_difference"), share(n - tp, n).alias("fp_rate"), share(r - n, r).alias("reduction"), share(F.col("explained"), n).alias("availability"),
    )


def by_category(ours: DataFrame, theirs: DataFrame, categories: tuple[str, ...] = ("exfiltration", "c2_beaconing", "lateral_movement", "dns_tunneling", "scan")) -> DataFrame:
    """Incidents of both systems in each category, 0 where there are none."""
    both = ours.select("event_type", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(theirs.select("event_type", F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    names = ours.sparkSession.createDataFrame([(c,) for c in categories], "event_type string")
    sums = both.groupBy("event_type").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    return names.join(sums, "event_type", "left").select("event_type", F.coalesce("_a", F.lit(0)).cast("long").alias("incidents"), F.coalesce("_b", F.lit(0)).cast("long").alias("other_incidents"))


def totals(tables: dict[str, DataFrame], incidents_: DataFrame) -> DataFrame:
    """(kind, name, n): rows of each table, incidents that are not of low severity (those without a label among them), and incidents by label."""
    out = None
    for name, rows in tables.items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    kept = incidents_.where(~F.col("severity_label").eqNullSafe("low"))
    every = kept.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit("incidents").alias("name"), "n")
    by_label = kept.where("severity_label IS NOT NULL").groupBy("severity_label").agg(F.count("*").alias("n")).select(F.lit("severity").alias("kind"), F.col("severity_label").alias("name"), "n")
    return (every if out is None else out.unionByName(every)).unionByName(by_label)


def route_feedback(feedback: DataFrame) -> dict[str, DataFrame]:
    """What verdicts on incidents lead to: patterns to filter, patterns to reinforce, incidents to review, and the log of severity changes."""
    verdict = lambda v: feedback.where(F.col("verdict") == v)
    return {
        "fp_patterns": verdict("false_positive").select("incident_id", "reason"), "tp_patterns": verdict("true_positive").select("incident_id"), "review": verdict("needs_review").select("incident_id", "reason"),
        "calibrations": feedback.where("severity_adjustment IS NOT NULL").select("incident_id", "original_severity", "adjusted_severity", F.col("severity_adjustment").alias("adjustment")),
    }
