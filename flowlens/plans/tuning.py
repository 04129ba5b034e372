"""Queries over labels and scores: matching, weak labels, consensus, thresholds, curves, drift, active learning and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.scalars import at_least
from flowlens.operators import labels as L
from flowlens.operators import matching as M
from flowlens.operators import tuning as T
from flowlens.plans.detection import rounded
from flowlens.sources import adapters as A

#: The driver's events are sparse, so the reaches are hours here; the operators' defaults are seconds.
REACH = 6 * A.HOUR
#: Records that analysts look at: those of the highest levels.
REVIEWED = "level >= 14"
SPLIT = "(SELECT (min(us) + max(us)) // 2 AS mid FROM ev)"


def purchases(s, d):
    return A.events(s, d).where("event_type = 'purchase'").select("event_id", "us", F.col("user_id").alias("src_ip"), F.col("k").alias("dst_ip"))


def aligned(s, d):
    return M.align_labels(purchases(s, d), A.label_rows(s, d), REACH // 2, REACH // 2)


ALIGNED = (
    f"{A.EVENTS}, {A.LABELS}, pur AS (SELECT event_id, us, user_id AS src_ip, k AS dst_ip FROM ev WHERE event_type = 'purchase'), "
    f"near AS (SELECT event_id, label_id, label, abs(p.us - l.us) AS dist FROM pur p JOIN lab l ON p.src_ip = l.src_ip AND p.dst_ip = l.dst_ip AND abs(p.us - l.us) <= {REACH} QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(p.us - l.us), l.us, label_id) = 1), "
    f"al AS (SELECT p.event_id, coalesce(label, false) AS label, label_id, dist AS distance_us, CASE WHEN dist IS NULL THEN 0 ELSE greatest(0, 1 - dist / {REACH}) END AS match_confidence FROM pur p LEFT JOIN near n ON p.event_id = n.event_id)"
)


def votes(s, d):
    """Four sources label the same events: by severity, level, correlation, and an analyst for those of the highest levels."""
    rows = A.label_rows(s, d).withColumn("level", F.col("level"))
    base = rows.select("label_id", "us")

    def of(source, ordinal, made):
        got = L.SOURCES[source].weak_labels(made)
        kind = F.col("event_type") if "event_type" in got.columns else F.lit(None).cast("string")
        return got.withColumn("event_type", kind).join(base, "label_id").select(F.floor(F.col("label_id") / 4).alias("event_id"), "us", "source", "label", "confidence", "event_type", (F.col("label_id") * 10 + ordinal).alias("ord"))

    analyst = rows.where(REVIEWED)
    out = of("ids", 0, rows).unionByName(of("hids", 1, A.host_records(s, d))).unionByName(of("correlation", 2, rows)).unionByName(of("analyst", 3, analyst))
    return out


VOTES = (
    f"{A.EVENTS}, {A.LABELS}, votes AS (SELECT label_id // 4 AS event_id, us, 'ids' AS source, true AS label, ids_conf AS confidence, ids_type AS event_type, label_id * 10 AS ord, 1.2::DOUBLE AS w FROM lab "
    "UNION ALL SELECT label_id // 4, us, 'hids', true, hids_conf, hids_type, label_id * 10 + 1, 1.0::DOUBLE FROM lab WHERE level >= 6 "
    "UNION ALL SELECT label_id // 4, us, 'correlation', true, confidence * 0.8::DOUBLE, tactic_type, label_id * 10 + 2, 0.7::DOUBLE FROM lab WHERE confidence * 0.8::DOUBLE >= 0.3 "
    "UNION ALL SELECT label_id // 4, us, 'analyst', label, 1.0::DOUBLE, 'analyst_confirmed', label_id * 10 + 3, 2.0::DOUBLE FROM lab WHERE level >= 14)"
)


def machine_votes(s, d):
    """Signed votes with abstentions, for the weighted path."""
    k = F.col("k")
    return A.events(s, d).select(
        F.floor(F.col("event_id") / 3).alias("event_id"), "us", F.element_at(F.array(F.lit("ids"), F.lit("hids"), F.lit("intel"), F.lit("other")), (k % 4 + 1).cast("int")).alias("source"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(k % 2 == 0).cast("boolean").alias("label"), ((k + 1) / 128).alias("confidence"), F.when(k % 3 == 0, F.col("event_type")).alias("event_type"), F.col("event_id").alias("ord"),
        F.col("user_id").alias("src_ip"), k.alias("dst_ip"), F.when(k % 7 == 0, F.concat(F.lit("T"), k.cast("string"))).alias("mitre_attack_id"),
    )


def _breakdown(column="breakdown"):
    """Votes by source as text."""
    one = lambda e: F.concat_ws(":", e["key"], e["value"]["label"].cast("string"), e["value"]["confidence"].cast("string"), e["value"]["weight"].cast("string"))
    return F.array_join(F.array_sort(F.transform(F.map_entries(column), one)), ",")


CONSENSUS = (
    f"WITH {A.EVENTS}, v AS (SELECT event_id // 3 AS event_id, us, user_id AS src_ip, k AS dst_ip, (ARRAY['ids', 'hids', 'intel', 'other'])[k % 4 + 1] AS source, k % 2 = 0 AS label, (k + 1) / 128 AS confidence, CASE WHEN k % 3 = 0 THEN event_type END AS event_type, CASE WHEN k % 7 = 0 THEN concat('T', k) END AS mitre, event_id AS ord FROM ev WHERE k % 5 <> 0), "
    "w AS (SELECT *, CASE source WHEN 'ids' THEN 1.2::DOUBLE WHEN 'hids' THEN 1.0::DOUBLE WHEN 'intel' THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM v), "
    "b AS (SELECT event_id, string_agg(concat(source, ':', label, ':', confidence, ':', weight), ',' ORDER BY source) AS breakdown FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY event_id, source ORDER BY ord DESC) = 1) GROUP BY 1), "
    "g AS (SELECT event_id, arg_min(us, ord) AS us, arg_min(src_ip, ord) AS src_ip, arg_min(dst_ip, ord) AS dst_ip, sum(CASE WHEN label THEN weight * confidence ELSE -weight * confidence END) / sum(weight * confidence) AS score, arg_min(event_type, ord) FILTER (event_type IS NOT NULL) AS event_type, "
    "arg_min(mitre, ord) FILTER (mitre IS NOT NULL) AS mitre_attack_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) FILTER (label) AS votes_positive, count(*) FILTER (NOT label) AS votes_negative FROM w GROUP BY 1) "
    "SELECT event_id, us, src_ip, dst_ip, round(score, 12) > 0 AS label, round(abs(score), 6) AS confidence, round(score, 6) AS score, event_type, mitre_attack_id, sources, breakdown, votes_positive, votes_negative, 0::BIGINT AS votes_abstain FROM g JOIN b USING (event_id)"
)


def _weak(source, columns=("label_id", "label", "confidence", "event_type")):
    def run(s, d):
        got = L.SOURCES[source].weak_labels(A.host_records(s, d) if source == "hids" else A.label_rows(s, d))
        return got.select(*columns).withColumn("confidence", F.round("confidence", 6))

    return run


_RECORDS = ("ids", "intel", "correlation", "analyst")


def label_events(s, d):
    """All events labelled from the records of four sources."""
    rows = A.label_rows(s, d)
    records = {name: rows.where(REVIEWED) if name == "analyst" else rows for name in _RECORDS}
    return L.label_events(A.events(s, d).select("event_id", "us", F.col("user_id").alias("src_ip"), F.col("k").alias("dst_ip")), records)


def _grid_sql(weight: str) -> str:
    return (
        f"WITH {A.JUDGED.replace('judged AS', 'judged AS', 1)}, grid AS (SELECT round(0.01::DOUBLE + 0.98::DOUBLE * i / 99, 12) AS threshold FROM range(100) t(i)), m AS (SELECT model_name, threshold, count(*) FILTER (score >= threshold AND label) AS tp, count(*) FILTER (score >= threshold AND NOT label) AS fp, count(*) FILTER (score < threshold AND label) AS fn, count(*) FILTER (score < threshold AND NOT label) AS tn, "
        f"coalesce(sum({weight}) FILTER (score >= threshold AND label), 0) AS a, coalesce(sum({weight}) FILTER (score >= threshold AND NOT label), 0) AS b, coalesce(sum({weight}) FILTER (score < threshold AND label), 0) AS c, coalesce(sum({weight}) FILTER (score < threshold AND NOT label), 0) AS e FROM judged, grid GROUP BY 1, 2), "
        "q AS (SELECT *, CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0 END AS p, CASE WHEN a + c > 0 THEN a / (a + c) ELSE 0 END AS r FROM m), "
        "sw AS (SELECT model_name, tp, fp, fn, tn, threshold, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, a + e - b - 10 * c AS cost, (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END) - (CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END) AS youden FROM q) "
    )


_SIX = ", ".join(f"round({c}, 6) AS {c}" for c in ("threshold", "precision", "recall", "f1", "cost", "youden"))
_FIGURES = ("threshold", "precision", "recall", "f1", "cost", "youden")


def halves(s, d, model):
    """Scores before and after the middle of the time span."""
    rows = A.scores(s, d).where(F.col("model_name") == model)
    mid = rows.agg(F.floor((F.min("us") + F.max("us")) / 2).alias("mid"))
    both = rows.crossJoin(F.broadcast(mid))
    return both.where("us < mid"), both.where("us >= mid")


def _halves_sql(model):
    return f"WITH {A.SCORES}, mid AS {SPLIT}, r AS (SELECT score FROM scores, mid WHERE model_name = '{model}' AND us < mid), c AS (SELECT score FROM scores, mid WHERE model_name = '{model}' AND us >= mid)"


def _by_model(measure):
    """A distance between the halves of each model's scores."""

    def run(s, d):
        out = None
        for model in A.MODELS:
            rows = measure(*halves(s, d, model)).withColumn("model_name", F.lit(model))
            out = rows if out is None else out.unionByName(rows)
        return out

    return run


def _by_model_sql(name: str, made: str) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS model_name, v AS {name} FROM ({_halves_sql(m)}{made})" for m in A.MODELS)


def _drift(s, d):
    out = None
    for model in A.MODELS:
        ref, cur = halves(s, d, model)
        rows = T.psi(ref, cur).select(F.lit(model).alias("model_name"), F.lit("psi").alias("metric"), F.col("psi").alias("value"), F.lit(0.001).alias("threshold"))
        out = rows if out is None else out.unionByName(rows)
    return T.recommend(out)


_PSI = "(SELECT sum((c - r) * ln(c / r)) FROM (SELECT b, greatest(1e-6, coalesce((SELECT count(*) FROM r WHERE score BETWEEN 0 AND 1 AND least(floor(score * 10), 9) = b) / (SELECT count(*) FROM r), 0)) AS r, greatest(1e-6, coalesce((SELECT count(*) FROM c WHERE score BETWEEN 0 AND 1 AND least(floor(score * 10), 9) = b) / (SELECT count(*) FROM c), 0)) AS c FROM range(10) t(b)))"
_GAPS = "n AS (SELECT (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM c) AS nc), u AS (SELECT score, sum(a) AS a, sum(b) AS b FROM (SELECT score, 1 AS a, 0 AS b FROM r UNION ALL SELECT score, 0, 1 FROM c) GROUP BY 1), g AS (SELECT score, abs(sum(a) OVER (ORDER BY score) / nr - sum(b) OVER (ORDER BY score) / nc) AS gap, lead(score) OVER (ORDER BY score) - score AS width FROM u, n)"
_EVENT = "e AS (SELECT event_id, avg(score) AS mean_score, stddev_pop(score) AS sd, count(score) AS models FROM scores GROUP BY 1)"
_AL = (
    f"WITH {A.SCORES}, {_EVENT}, b AS (SELECT *, least(floor(mean_score * 10), 9) AS bin FROM e), f AS (SELECT event_id, mean_score, sd, models, exp(-((mean_score - 0.5::DOUBLE) ** 2) / (2 * 0.15::DOUBLE ** 2)) AS uncertainty, CASE WHEN models < 2 THEN 0 ELSE least(sd / 0.5::DOUBLE, 1) END AS disagreement, 1 - count(*) OVER (PARTITION BY bin) / count(*) OVER () AS diversity FROM b)"
)


def _matrix(s, d):
    return T.confusion(A.judged(s, d), F.col("score") >= 0.5, ("model_name",))


_MATRIX = f"WITH {A.JUDGED}, m AS (SELECT model_name, count(*) FILTER (score >= 0.5 AND label) AS tp, count(*) FILTER (score >= 0.5 AND NOT label) AS fp, count(*) FILTER (score < 0.5 AND label) AS fn, count(*) FILTER (score < 0.5 AND NOT label) AS tn, count(*) AS total FROM judged GROUP BY 1)"
_KPI = f"{_MATRIX}, k AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END * 100 AS coverage, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END * 100 AS precision_pct, fp AS advantage, CAST(tp + tn - fp - 10 * fn AS DOUBLE) AS cost FROM m)"


def _wide(s, d):
    label = (F.col("k") + F.floor("value")) % 7 == 0
    return A.events(s, d).select("event_id", F.least(F.lit(1.0), F.col("value") / 500).alias("isolation_forest"), (F.col("k") / 100).alias("autoencoder"), label.alias("label"))


def _lr(s, d):
    weights = T.logistic_weights(_wide(s, d), ["isolation_forest", "autoencoder"])
    return s.createDataFrame(sorted(weights.items()), "model_name string, weight double")


def _sparse_scores(s, d):
    return A.scores(s, d).withColumn("score", F.when((F.col("event_id") % 5 == 0) & (F.col("model_name") == "hmm"), F.lit(None)).otherwise(F.col("score")))


WEIGHTS = {"isolation_forest": 0.5, "autoencoder": 0.3, "hmm": 0.2}


def _runs(s, d):
    k = T.key_figures(_matrix(s, d))
    return T.compare_runs(k.select(F.col("model_name").alias("run_id"), "coverage", "precision_pct", "advantage", F.lit(5.0).alias("mttd_diff_pct")))


def _mttd(s, d):
    rows = A.alerts(s, d).select((F.col("severity") / 8).alias("own_delay"), F.when(F.col("severity") > 10, F.col("severity") / 10).alias("vendor_delay"))
    return rounded(T.mean_times(rows), "mttd_own", "mttd_vendor", "mttd_diff_pct")


def weighted_optimum_sql() -> str:
    """The threshold of the largest weighted cost, with figures of plain counts."""
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / ({b}) ELSE 0 END"
    return (
        _grid_sql("confidence") + "SELECT model_name, round(threshold, 6) AS threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(cost, 6) AS cost, round(youden, 6) AS youden "
        f"FROM (SELECT *, {ratio('tp', 'tp + fp')} AS p, {ratio('tp', 'tp + fn')} AS r FROM sw QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY round(sw.cost, 12) DESC, sw.threshold) = 1)"
    )


QUERIES = {
    "nearest_label_align": lambda s, d: rounded(aligned(s, d), "match_confidence").na.fill(-1, ["label_id", "distance_us"]),
    "nearest_event_match": lambda s, d: M.match_events(A.label_rows(s, d), purchases(s, d), REACH),
    "alignment_summary": lambda s, d: rounded(M.alignment_summary(aligned(s, d)), "match_rate", "avg_distance_us", "avg_confidence"),
    "label_dedup": lambda s, d: M.dedup_labels(A.label_rows(s, d)),
    "weak_labels_ids": _weak("ids"),
    "weak_labels_hids": _weak("hids", ("label_id", "label", "confidence", "event_type", "src_ip", "dst_ip")),
    "weak_labels_intel": _weak("intel"),
    "weak_labels_corr": _weak("correlation"),
    "weak_labels_vendor": lambda s, d: L.vendor_labels(A.label_rows(s, d), minimum=at_least("severity_name", "medium")),
    "label_events": lambda s, d: L.supervised(label_events(s, d)).withColumn("confidence", F.round("confidence", 6)),
    "consensus_vote": lambda s, d: rounded(L.consensus(machine_votes(s, d)).withColumn("breakdown", _breakdown()), "confidence", "score"),
    "consensus_analyst": lambda s, d: L.consensus(votes(s, d)).select("event_id", "us", "label", F.round("confidence", 6).alias("confidence"), "event_type", "sources"),
    "source_stats": lambda s, d: rounded(L.source_stats(votes(s, d)), "avg_confidence"),
    "unlabeled_events": lambda s, d: L.unlabeled(A.label_rows(s, d).select(F.floor(F.col("label_id") / 4).alias("event_id")).unionByName(A.events(s, d).select(F.floor(F.col("event_id") / 3).alias("event_id"))).distinct(), L.consensus(votes(s, d))),
    "consensus_incidents": lambda s, d: L.incidents(L.consensus(votes(s, d))).agg(F.count("*").alias("n")),
    "confusion_matrix": _matrix,
    "kpi_metrics": lambda s, d: rounded(T.key_figures(_matrix(s, d)), "coverage", "precision_pct"),
    "gap_analysis": lambda s, d: T.gap_analysis(T.key_figures(_matrix(s, d))).select("model_name", "coverage_met", "precision_pct_met", "advantage_met", "all_met"),
    "mean_time_to_detect": _mttd,
    "threshold_sweep": lambda s, d: rounded(T.sweep(A.judged(s, d)), *_FIGURES),
    "threshold_sweep_weighted": lambda s, d: rounded(T.sweep(A.judged(s, d), weight="confidence"), *_FIGURES),
    "optimal_threshold": lambda s, d: rounded(T.optimal(T.sweep(A.judged(s, d)), "f1"), *_FIGURES),
    "optimal_threshold_cost": lambda s, d: rounded(T.optimal(T.sweep(A.judged(s, d)), "cost"), *_FIGURES),
    "roc_auc": lambda s, d: rounded(T.roc_auc(A.judged(s, d)), "roc_auc"),
    "average_precision": lambda s, d: rounded(T.average_precision(A.judged(s, d)), "average_precision"),
    "roc_auc_weighted": lambda s, d: rounded(T.roc_auc(A.judged(s, d), weight="confidence"), "roc_auc"),
    "average_precision_weighted": lambda s, d: rounded(T.average_precision(A.judged(s, d), weight="confidence"), "average_precision"),
    "psi_drift": lambda s, d: rounded(_by_model(T.psi)(s, d), "psi"),
    "ks_statistic": lambda s, d: rounded(_by_model(T.ks_distance)(s, d), "ks"),
    "wasserstein": lambda s, d: rounded(_by_model(T.wasserstein)(s, d), "wasserstein"),
    "drift_recommend": _drift,
    "al_uncertainty": lambda s, d: rounded(T.event_scores(A.scores(s, d)).select("event_id", T.uncertainty(F.col("mean_score"), 0.5).alias("uncertainty")), "uncertainty"),
    "al_disagreement": lambda s, d: rounded(T.event_scores(A.scores(s, d)).select("event_id", T.disagreement(F.col("sd"), F.col("models")).alias("disagreement")), "disagreement"),
    "al_diversity": lambda s, d: rounded(T.diversity(T.event_scores(A.scores(s, d))).select("event_id", "diversity"), "diversity"),
    "al_hybrid_topk": lambda s, d: rounded(T.active_learning(A.scores(s, d), 0.5).select("event_id", "priority", "suggested_label"), "priority"),
    "al_unreviewed": lambda s, d: rounded(T.active_learning(A.scores(s, d), 0.5, 50, A.events(s, d).where("event_type = 'view'")).select("event_id", "priority"), "priority"),
    "fuse_weighted": lambda s, d: rounded(T.fuse(A.scores(s, d), WEIGHTS), "fused"),
    "fuse_apply_nulls": lambda s, d: T.fuse(_sparse_scores(s, d), WEIGHTS).withColumn("fused", F.round("fused", 9)),
    "fuse_batch_by_event": lambda s, d: rounded(T.fuse_batch(A.scores(s, d)), "mean_score"),
    "fuse_lr_weights": _lr,
    "fuse_stacking": lambda s, d: T.stacked(_wide(s, d), ["isolation_forest", "autoencoder"], 3),
    "run_compare": lambda s, d: rounded(_runs(s, d), "coverage", "precision_pct", "composite"),
}
SQL = {
    "nearest_label_align": f"WITH {ALIGNED} SELECT event_id, label, coalesce(label_id, -1) AS label_id, coalesce(distance_us, -1) AS distance_us, round(match_confidence, 6) AS match_confidence FROM al",
    "nearest_event_match": f"WITH {A.EVENTS}, {A.LABELS} SELECT label_id, e.event_id, abs(l.us - e.us) AS distance_us FROM lab l JOIN ev e ON e.event_type = 'purchase' AND e.user_id = l.src_ip AND e.k = l.dst_ip AND abs(l.us - e.us) <= {REACH} QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY abs(l.us - e.us), e.us, e.event_id) = 1",
    "alignment_summary": f"WITH {ALIGNED} SELECT count(*) AS total, count(label_id) AS matched, count(*) - count(label_id) AS unmatched, round(count(label_id) / greatest(count(*), 1), 6) AS match_rate, round(coalesce(sum(distance_us), 0) / greatest(count(label_id), 1), 6) AS avg_distance_us, round(sum(match_confidence) / greatest(count(label_id), 1), 6) AS avg_confidence FROM al",
    "label_dedup": f"WITH {A.EVENTS}, {A.LABELS} SELECT src_ip, dst_ip, label_id, us FROM lab QUALIFY row_number() OVER (PARTITION BY src_ip, dst_ip, round_even(us / 1000000, 0) ORDER BY us, label_id) = 1",
    "weak_labels_ids": f"WITH {A.EVENTS}, {A.LABELS} SELECT label_id, true AS label, ids_conf AS confidence, ids_type AS event_type FROM lab",
    "weak_labels_hids": f"WITH {A.EVENTS}, {A.LABELS} SELECT label_id, true AS label, round(hids_conf, 6) AS confidence, hids_type AS event_type, CASE WHEN k % 7 = 0 THEN concat('agent:', k % 10) ELSE CAST(src_ip AS VARCHAR) END AS src_ip, CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN '' ELSE CAST(dst_ip AS VARCHAR) END AS dst_ip FROM lab WHERE level >= 6",
    "weak_labels_intel": f"WITH {A.EVENTS}, {A.LABELS} SELECT label_id, true AS label, intel_conf AS confidence, intel_type AS event_type FROM lab",
    "weak_labels_corr": f"WITH {A.EVENTS}, {A.LABELS} SELECT label_id, true AS label, round(confidence * 0.8::DOUBLE, 6) AS confidence, tactic_type AS event_type FROM lab WHERE confidence * 0.8::DOUBLE >= 0.3",
    "weak_labels_vendor": f"WITH {A.EVENTS}, {A.LABELS} SELECT label_id, true AS label, vendor_conf AS confidence, vendor_type AS event_type FROM lab WHERE k % 5 >= 1 QUALIFY row_number() OVER (PARTITION BY src_ip, dst_ip, round_even(us / 1000000, 0) ORDER BY us, label_id) = 1",
    "label_events": (
        f"WITH {A.EVENTS}, {A.LABELS}, made AS (SELECT 0 AS so, label_id, us, src_ip, dst_ip, 'ids' AS source, true AS label, ids_conf AS confidence, ids_type AS event_type, 1.2::DOUBLE AS w FROM lab UNION ALL SELECT 1, label_id, us, src_ip, dst_ip, 'intel', true, intel_conf, intel_type, 1.3::DOUBLE FROM lab "
        "UNION ALL SELECT 2, label_id, us, src_ip, dst_ip, 'correlation', true, confidence * 0.8::DOUBLE, tactic_type, 0.7::DOUBLE FROM lab WHERE confidence * 0.8::DOUBLE >= 0.3 UNION ALL SELECT 3, label_id, us, src_ip, dst_ip, 'analyst', label, 1.0::DOUBLE, 'analyst_confirmed', 2.0::DOUBLE FROM lab WHERE level >= 14), "
        "v AS (SELECT m.*, e.event_id FROM made m JOIN ev e ON e.user_id = m.src_ip AND e.k = m.dst_ip AND abs(e.us - m.us) <= 60000000 QUALIFY row_number() OVER (PARTITION BY so, label_id ORDER BY abs(e.us - m.us), e.us, e.event_id) = 1), "
        "g AS (SELECT event_id, arg_min(us, (so, label_id)) AS us, sum(CASE WHEN label THEN w * confidence ELSE -w * confidence END) / sum(w * confidence) AS score, arg_max(label, (us, -so, -label_id)) FILTER (source = 'analyst') AS an, arg_min(event_type, (so, label_id)) AS event_type FROM v GROUP BY 1) "
        "SELECT event_id, us, coalesce(an, round(score, 12) > 0) AS label, 'consensus' AS source, CASE WHEN an IS NULL THEN round(abs(score), 6) ELSE 1 END AS confidence, event_type FROM g"
    ),
    "consensus_vote": CONSENSUS,
    "consensus_analyst": f"WITH {VOTES}, g AS (SELECT event_id, arg_min(us, ord) AS us, sum(CASE WHEN label THEN w * confidence WHEN NOT label THEN -w * confidence END) / sum(w * confidence) AS score, arg_max(label, (us, -ord)) FILTER (source = 'analyst') AS an, arg_min(event_type, ord) FILTER (event_type IS NOT NULL) AS event_type, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM votes GROUP BY 1) SELECT event_id, us, coalesce(an, round(score, 12) > 0) AS label, round(CASE WHEN an IS NOT NULL THEN 1 ELSE abs(score) END, 6) AS confidence, event_type, sources FROM g",
    "source_stats": f"WITH {VOTES} SELECT source, count(*) AS n, count(*) FILTER (label) AS positive, count(*) FILTER (NOT label) AS negative, count(*) FILTER (label IS NULL) AS abstained, round(avg(confidence), 6) AS avg_confidence FROM votes GROUP BY 1",
    "unlabeled_events": f"WITH {VOTES} SELECT event_id FROM (SELECT label_id // 4 AS event_id FROM lab UNION SELECT event_id // 3 FROM ev) WHERE event_id NOT IN (SELECT event_id FROM votes)",
    "consensus_incidents": f"WITH {VOTES}, g AS (SELECT event_id, sum(CASE WHEN label THEN w * confidence WHEN NOT label THEN -w * confidence END) / sum(w * confidence) AS score, arg_max(label, (us, -ord)) FILTER (source = 'analyst') AS an FROM votes GROUP BY 1) SELECT count(*) AS n FROM g WHERE an OR (an IS NULL AND score > 0.5)",
    "confusion_matrix": f"{_MATRIX} SELECT * FROM m",
    "kpi_metrics": f"{_KPI} SELECT * EXCLUDE (coverage, precision_pct), round(coverage, 6) AS coverage, round(precision_pct, 6) AS precision_pct FROM k",
    "gap_analysis": f"{_KPI} SELECT model_name, coverage >= 90 AS coverage_met, precision_pct >= 85 AS precision_pct_met, advantage >= 0 AS advantage_met, coverage >= 90 AND precision_pct >= 85 AND advantage >= 0 AS all_met FROM k",
    "mean_time_to_detect": f"WITH {A.ALERTS} SELECT round(avg(severity / 8), 6) AS mttd_own, round(avg(CASE WHEN severity > 10 THEN severity / 10 END), 6) AS mttd_vendor, round((avg(severity / 8) - avg(CASE WHEN severity > 10 THEN severity / 10 END)) / avg(CASE WHEN severity > 10 THEN severity / 10 END) * 100, 6) AS mttd_diff_pct FROM alerts",
    "threshold_sweep": _grid_sql("1.0::DOUBLE") + f"SELECT model_name, tp, fp, fn, tn, {_SIX} FROM sw",
    "threshold_sweep_weighted": _grid_sql("confidence") + f"SELECT model_name, tp, fp, fn, tn, {_SIX} FROM sw",
    "optimal_threshold": _grid_sql("1.0::DOUBLE") + f"SELECT model_name, {_SIX} FROM sw QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY round(f1, 12) DESC, sw.threshold) = 1",
    "optimal_threshold_cost": _grid_sql("1.0::DOUBLE") + f"SELECT model_name, {_SIX} FROM sw QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY round(sw.cost, 12) DESC, sw.threshold) = 1",
    "roc_auc": f"WITH {A.JUDGED} SELECT p.model_name, round(avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0 END), 6) AS roc_auc FROM judged p JOIN judged n ON p.model_name = n.model_name AND p.label AND NOT n.label GROUP BY 1",
    "average_precision": f"WITH {A.JUDGED}, s AS (SELECT model_name, score, count(*) FILTER (label) AS p, count(*) AS n FROM judged GROUP BY 1, 2), c AS (SELECT model_name, p, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY model_name) AS ap FROM s WINDOW w AS (PARTITION BY model_name ORDER BY score DESC)) SELECT model_name, round(sum(p / ap * cp / cn), 6) AS average_precision FROM c GROUP BY 1",
    "roc_auc_weighted": f"WITH {A.JUDGED} SELECT p.model_name, round(sum(p.confidence * n.confidence * CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0 END) / sum(p.confidence * n.confidence), 6) AS roc_auc FROM judged p JOIN judged n ON p.model_name = n.model_name AND p.label AND NOT n.label GROUP BY 1",
    "average_precision_weighted": f"WITH {A.JUDGED}, s AS (SELECT model_name, score, coalesce(sum(confidence) FILTER (label), 0) AS p, sum(confidence) AS n FROM judged GROUP BY 1, 2), c AS (SELECT model_name, p, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY model_name) AS ap FROM s WINDOW w AS (PARTITION BY model_name ORDER BY score DESC)) SELECT model_name, round(sum(p / ap * cp / cn), 6) AS average_precision FROM c GROUP BY 1",
    "psi_drift": _by_model_sql("psi", f" SELECT round({_PSI}, 6) AS v"),
    "ks_statistic": _by_model_sql("ks", f", {_GAPS} SELECT round(max(gap), 6) AS v FROM g"),
    "wasserstein": _by_model_sql("wasserstein", f", {_GAPS} SELECT round(sum(gap * coalesce(width, 0)), 6) AS v FROM g"),
    "drift_recommend": " UNION ALL ".join(f"SELECT '{m}' AS model_name, CASE WHEN v > 0.001 THEN 1::BIGINT ELSE 0::BIGINT END AS drifted_metrics, CASE WHEN v <= 0.001 THEN 'none' WHEN v / 0.001 < 1.5 THEN 'low' WHEN v / 0.001 < 2 THEN 'medium' ELSE 'high' END AS severity, v > 0.001 AS retune FROM ({_halves_sql(m)} SELECT {_PSI} AS v)" for m in A.MODELS),
    "al_uncertainty": f"{_AL} SELECT event_id, round(uncertainty, 6) AS uncertainty FROM f",
    "al_disagreement": f"{_AL} SELECT event_id, round(disagreement, 6) AS disagreement FROM f",
    "al_diversity": f"{_AL} SELECT event_id, round(diversity, 6) AS diversity FROM f",
    "al_hybrid_topk": f"{_AL}, p AS (SELECT event_id, round(0.5::DOUBLE * uncertainty + 0.3::DOUBLE * disagreement + 0.2::DOUBLE * diversity, 9) AS pr, mean_score >= 0.5 AS suggested_label FROM f) SELECT event_id, round(pr, 6) AS priority, suggested_label FROM p ORDER BY pr DESC, event_id LIMIT 20",
    "al_unreviewed": f"{_AL.replace('e AS (SELECT', 'e AS (SELECT', 1).replace('FROM scores GROUP BY 1)', 'FROM scores WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = ' + chr(39) + 'view' + chr(39) + ') GROUP BY 1)')}, p AS (SELECT event_id, round(0.5::DOUBLE * uncertainty + 0.3::DOUBLE * disagreement + 0.2::DOUBLE * diversity, 9) AS pr FROM f) SELECT event_id, round(pr, 6) AS priority FROM p ORDER BY pr DESC, event_id LIMIT 50",
    "fuse_weighted": f"WITH {A.SCORES}, f AS (SELECT event_id, sum(score * CASE model_name WHEN 'isolation_forest' THEN 0.5::DOUBLE WHEN 'autoencoder' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END) AS v FROM scores GROUP BY 1) SELECT event_id, round(v, 6) AS fused, v >= 0.5 AS is_anomaly FROM f",
    "fuse_apply_nulls": f"WITH {A.SCORES}, q AS (SELECT event_id, CASE WHEN event_id % 5 = 0 AND model_name = 'hmm' THEN NULL ELSE score END AS score, CASE model_name WHEN 'isolation_forest' THEN 0.5::DOUBLE WHEN 'autoencoder' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS w FROM scores), f AS (SELECT event_id, sum(score * w) / sum(w) FILTER (score IS NOT NULL) AS v FROM q GROUP BY 1) SELECT event_id, round(v, 9) AS fused, v >= 0.5 AS is_anomaly FROM f",
    "fuse_batch_by_event": f"WITH {A.SCORES} SELECT event_id, string_agg(DISTINCT model_name, ',' ORDER BY model_name) AS models, bool_or(score > 0.7) AS any_anomaly, round(avg(score), 6) AS mean_score FROM scores GROUP BY 1",
    "run_compare": f"{_KPI} SELECT model_name AS run_id, round(coverage, 6) AS coverage, round(precision_pct, 6) AS precision_pct, advantage, 5.0::DOUBLE AS mttd_diff_pct, round(coverage + precision_pct + advantage - 5, 6) AS composite FROM k ORDER BY coverage + precision_pct + advantage DESC, model_name LIMIT 1",
}
