"""Threshold tuning, curves, key figures, drift, active learning and fusion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.scan import meet, running

GRID = 100
LOW, HIGH = 0.01, 0.99
COSTS = {"tp": 1.0, "tn": 1.0, "fp": -1.0, "fn": -10.0}


def confusion(rows: DataFrame, predicted: Column, by: tuple[str, ...] = ()) -> DataFrame:
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    label = F.col("label")
    return rows.groupBy(*by).agg(n(predicted & label, "tp"), n(predicted & ~label, "fp"), n(~predicted & label, "fn"), n(~predicted & ~label, "tn"), F.count("*").alias("total"))


def _ratio(a, b) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def key_figures(matrix: DataFrame) -> DataFrame:
    """Coverage and precision in percent, false positives as (negative) advantage, and cost."""
    coverage, precision = _ratio(F.col("tp"), F.col("tp") + F.col("fn")) * 100, _ratio(F.col("tp"), F.col("tp") + F.col("fp")) * 100
    cost = F.col("tp") * COSTS["tp"] + F.col("tn") * COSTS["tn"] + F.col("fp") * COSTS["fp"] + F.col("fn") * COSTS["fn"]
    return matrix.withColumn("coverage", coverage).withColumn("precision_pct", precision).withColumn("advantage", F.col("fp")).withColumn("cost", cost)


TARGETS = {"coverage": 90.0, "precision_pct": 85.0}


def gap_analysis(figures: DataFrame) -> DataFrame:
    """Whether each target is met, and whether all are."""
    met = figures.withColumns({f"{c}_met": F.col(c) >= t for c, t in TARGETS.items()}).withColumn("advantage_met", F.col("advantage") >= 0)
    return met.withColumn("all_met", F.col("coverage_met") & F.col("precision_pct_met") & F.col("advantage_met"))


def threshold_grid(n: int = GRID) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(LOW + (HIGH - LOW) * i / (n - 1), 12))


def sweep(rows: DataFrame, by: tuple[str, ...] = ("model_name",), n: int = GRID, weight: str | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, cost and Youden's J at each of ``n`` thresholds of the grid; a score counts from its threshold on.

    Rows are first summed by the last threshold that they reach, in one aggregation of at most n + 1 rows a model; the grid then takes
    cumulative sums over those, so no row is repeated for each threshold. With a weight, precision, recall, f1 and cost use weighted sums,
    the counts stay.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    # At score s the thresholds 0..step are reached; floor with a tolerance keeps scores that equal a threshold on its side.
    reached = F.floor((F.col("score") - LOW) / (HIGH - LOW) * (n - 1) + 1e-9)
    step = F.least(F.lit(n - 1), F.greatest(F.lit(-1), reached)).cast("int")
    sums = rows.groupBy(*by, step.alias("_step")).agg(
        F.count(F.when(F.col("label"), 1)).alias("_p"), F.count(F.when(~F.col("label"), 1)).alias("_n"), F.sum(F.when(F.col("label"), w).otherwise(0.0)).alias("_wp"), F.sum(F.when(~F.col("label"), w).otherwise(0.0)).alias("_wn")
    )
    grid = rows.select(*by).distinct().withColumn("_step", F.explode(F.sequence(F.lit(-1), F.lit(n - 1))))
    full = grid.join(sums, [*by, "_step"], "left").na.fill(0, ["_p", "_n", "_wp", "_wn"])
    above = Window.partitionBy(*by).orderBy("_step").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    below = Window.partitionBy(*by).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    part = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    counted = full.select(*by, "_step", *[part(c, o).alias(a) for a, c, o in (("tp", "_p", above), ("fp", "_n", above), ("fn", "_p", below), ("tn", "_n", below), ("wtp", "_wp", above), ("wfp", "_wn", above), ("wfn", "_wp", below), ("wtn", "_wn", below))]).where("_step >= 0")
    precision, recall = _ratio(F.col("wtp"), F.col("wtp") + F.col("wfp")), _ratio(F.col("wtp"), F.col("wtp") + F.col("wfn"))
    out = counted.withColumn("threshold", F.round(LOW + (HIGH - LOW) * F.col("_step") / (n - 1), 12)).withColumn("precision", precision).withColumn("recall", recall)
    out = out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    out = out.withColumn("cost", F.col("wtp") * COSTS["tp"] + F.col("wtn") * COSTS["tn"] + F.col("wfp") * COSTS["fp"] + F.col("wfn") * COSTS["fn"])
    out = out.withColumn("youden", _ratio(F.col("tp"), F.col("tp") + F.col("fn")) - _ratio(F.col("fp"), F.col("fp") + F.col("tn")))
    return out.drop("_step", "wtp", "wfp", "wfn", "wtn")


def optimal(swept: DataFrame, metric: str = "cost", by: tuple[str, ...] = ("model_name",)) -> DataFrame:
    """The lowest threshold with the largest metric, with its figures; precision, recall and f1 are of counts, even after a weighted sweep."""
    columns = ["threshold", "tp", "fp", "fn", "cost", "youden"]
    best = swept.groupBy(*by).agg(F.max_by(F.struct(*columns), F.struct(F.round(metric, 12), -F.col("threshold"))).alias("b")).select(*by, "b.*")
    tp, precision, recall = F.col("tp"), F.col("precision"), F.col("recall")
    out = best.withColumn("precision", _ratio(tp, tp + F.col("fp"))).withColumn("recall", _ratio(tp, tp + F.col("fn"))).withColumn("f1", _ratio(2 * precision * recall, precision + recall))
    return out.select(*by, "threshold", "precision", "recall", "f1", "cost", "youden")


#: Scores are dealt into slices of this width for sums over all scores of a model.
SCORE_SLICE = 1 / 1024


def by_score(rows: DataFrame, by: tuple[str, ...], weight: str | None = None) -> DataFrame:
    """Weight of positives (p) and negatives (n) at each distinct score, of those above it, and of all: what the curves need; weight 1 without one.

    Rows are summed by score first. What is above comes from sums over slices of scores, so no task has all the scores of a model. A null score
    counts as lower than all others.
    """
    w = F.col(weight) if weight else F.lit(1)
    none = F.lit(0.0) if weight else F.lit(0)
    score = F.coalesce(F.col("score").cast("double"), F.lit(float("-inf")))
    sums = rows.groupBy(*by, (-score).alias("_below")).agg(F.coalesce(F.sum(F.when(F.col("label"), w)), none).alias("p"), F.coalesce(F.sum(F.when(~F.col("label"), w)), none).alias("n"))
    upto = running(sums.withColumn("_slice", F.floor(F.col("_below") / SCORE_SLICE)), [*by], ["_below"], {"_p": F.col("p"), "_n": F.col("n")})
    every = sums.groupBy(*by).agg(F.sum("p").alias("p_all"), F.sum("n").alias("n_all"))
    return meet(upto, every, [*by]).select(*by, (-F.col("_below")).alias("score"), "p", "n", (F.col("_p") - F.col("p")).alias("p_above"), (F.col("_n") - F.col("n")).alias("n_above"), "p_all", "n_all")


def roc_auc(rows: DataFrame, by: tuple[str, ...] = ("model_name",), weight: str | None = None) -> DataFrame:
    """Area under the ROC curve: a negative is below the positives above it and half below those it ties with; 0.5 with one class."""
    area = F.try_divide(F.sum(F.col("n") * (F.col("p_above") + F.col("p") / 2)), F.max(F.col("p_all") * F.col("n_all")))
    return by_score(rows, by, weight).groupBy(*by).agg(F.coalesce(area, F.lit(0.5)).alias("roc_auc"))


def average_precision(rows: DataFrame, by: tuple[str, ...] = ("model_name",), weight: str | None = None) -> DataFrame:
    """Sum of recall steps times precision; 0 without positives, 1 without negatives."""
    p, n = F.col("p") + F.col("p_above"), F.col("n") + F.col("n_above")
    area = F.sum(F.coalesce(F.try_divide(F.col("p"), F.col("p_all")) * F.try_divide(p, p + n), F.lit(0.0)))
    return by_score(rows, by, weight).groupBy(*by).agg(area.alias("average_precision"))


def shares(rows: DataFrame, field: str = "score", bins: int = 10) -> DataFrame:
    """Share of all rows in each of the bins of [0, 1]; values outside count in the denominator only."""
    kept = F.col(field).between(0, 1)
    hist = rows.where(kept).groupBy(F.least(F.floor(F.col(field) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return hist.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).select("bin", (F.col("n") / F.col("total")).alias("share"))


def psi(reference: DataFrame, current: DataFrame, field: str = "score", bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability index."""
    spark = reference.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    r, c = shares(reference, field, bins).withColumnRenamed("share", "r"), shares(current, field, bins).withColumnRenamed("share", "c")
    both = grid.join(r, "bin", "left").join(c, "bin", "left").select(*[F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(floor)).alias(x) for x in ("r", "c")])
    return both.agg(F.sum((F.col("c") - F.col("r")) * F.ln(F.col("c") / F.col("r"))).alias("psi"))


#: Values are dealt into this many ranges for global running sums.
RANGES = 64


def _distribution_gap(reference: DataFrame, current: DataFrame, field: str) -> DataFrame:
    """(value, gap, width): difference of the two distribution functions at each value, and the way to the next value.

    Counts are first summed by value. Running sums go by ranges of values: totals of the ranges, a handful of rows, are summed up and added
    to running sums within each, so no task holds all values.
    """
    rows = reference.select(F.col(field).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(current.select(F.col(field).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = rows.where("v IS NOT NULL").groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    cuts = counts.agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], F.lit(10_000)).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    place = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col("v"))) if cuts else F.lit(0)
    ranged = counts.withColumn("range", place.cast("int"))
    totals = ranged.groupBy("range").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.min("v").alias("first"))
    order = Window.orderBy("range")  # over at most RANGES rows
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range", F.coalesce(F.sum("ta").over(before), F.lit(0)).alias("oa"), F.coalesce(F.sum("tb").over(before), F.lit(0)).alias("ob"), F.sum("ta").over(Window.partitionBy()).alias("na"), F.sum("tb").over(Window.partitionBy()).alias("nb"), F.lead("first").over(order).alias("following"))
    inside = Window.partitionBy("range").orderBy("v")
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = ranged.withColumn("ra", F.sum("a").over(run)).withColumn("rb", F.sum("b").over(run)).withColumn("nxt", F.lead("v").over(inside)).join(F.broadcast(totals), "range")
    share = lambda part, run, n: F.try_divide(F.col(part) + F.col(run), F.col(n))
    gap = F.abs(share("oa", "ra", "na") - share("ob", "rb", "nb"))
    return joined.select(F.col("v").alias("value"), gap.alias("gap"), (F.coalesce("nxt", "following") - F.col("v")).alias("width"))


def ks_distance(reference: DataFrame, current: DataFrame, field: str = "score") -> DataFrame:
    """The Kolmogorov-Smirnov statistic."""
    return _distribution_gap(reference, current, field).agg(F.max("gap").alias("ks"))


def ks_p_value(distance: float, n: int, m: int) -> float:
    """The asymptotic two-sample p-value; small samples differ from the exact one."""
    if not n or not m:
        return 1.0
    root = math.sqrt(n * m / (n + m))
    x = (root + 0.12 + 0.11 / root) * distance
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def wasserstein(reference: DataFrame, current: DataFrame, field: str = "score") -> DataFrame:
    """The first Wasserstein distance: the area between the two distribution functions."""
    return _distribution_gap(reference, current, field).agg(F.sum(F.col("gap") * F.coalesce("width", F.lit(0.0))).alias("wasserstein"))


def drift_severity(value: Column, threshold: Column) -> Column:
    ratio = value / threshold
    return F.when(ratio < 1.5, "low").when(ratio < 2, "medium").otherwise("high")


def recommend(results: DataFrame) -> DataFrame:
    """(model_name, drifted metrics, worst severity, retune) from (model_name, metric, value, threshold)."""
    drifted = F.col("value") > F.col("threshold")
    rank = F.when(drifted, F.array_position(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), drift_severity(F.col("value"), F.col("threshold")))).otherwise(0)
    rows = results.groupBy("model_name").agg(F.count(F.when(drifted, 1)).alias("drifted_metrics"), F.max(rank).alias("_rank"))
    return rows.select("model_name", "drifted_metrics", F.element_at(F.array(F.lit("none"), F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("_rank") + 1).cast("int")).alias("severity"), (F.col("drifted_metrics") > 0).alias("retune"))


#: The order in which an event's scores are added up. A sum of doubles depends on it, and with that the bin of a mean on the edge of two.
MODEL_ORDER = ("isolation_forest", "autoencoder", "hmm")


def event_scores(scores: DataFrame, order: tuple[str, ...] = MODEL_ORDER) -> DataFrame:
    """Per event: mean score, population deviation and number of models.

    The mean adds the models in ``order``, however the rows come in, others after them; without ``model_name`` rows are added as they come.
    """
    mean = F.avg("score")
    if "model_name" in scores.columns:
        of = lambda c: F.coalesce(F.sum(F.when(c, F.col("score"))), F.lit(0.0))
        name = F.col("model_name")
        mean = F.try_divide(sum((of(name == m) for m in order), F.lit(0.0)) + of(~F.coalesce(name.isin(*order), F.lit(False))), F.count("score"))
    return scores.groupBy("event_id").agg(mean.alias("mean_score"), F.stddev_pop("score").alias("sd"), F.count("score").alias("models"))


def uncertainty(score: Column, threshold: float, sigma: float = 0.15) -> Column:
    return F.exp(-((score - threshold) ** 2) / (2 * sigma**2))


def disagreement(sd: Column, models: Column) -> Column:
    return F.when(models < 2, 0.0).otherwise(F.least(sd / 0.5, F.lit(1.0)))


def diversity(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Adds ``diversity``: 1 less the share of events in the same bin of the mean score; events without a score are a bin of their own.

    The bins are a table of eleven rows, joined by broadcast.
    """
    placed = scored.withColumn("_bin", F.coalesce(F.least(F.floor(F.col("mean_score") * bins), F.lit(bins - 1)), F.lit(-1)).cast("int"))
    sums = placed.groupBy("_bin").agg(F.count("*").alias("_n"))
    sums = sums.withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    return placed.join(F.broadcast(sums), "_bin").withColumn("diversity", 1 - F.col("_n") / F.col("_all")).drop("_bin", "_n", "_all")


def active_learning(scores: DataFrame, threshold: float, k: int = 20, reviewed: DataFrame | None = None) -> DataFrame:
    """The ``k`` events to ask about by .5 uncertainty, .3 disagreement and .2 diversity; ties go to the smaller id."""
    rows = event_scores(scores)
    if reviewed is not None:
        rows = rows.join(reviewed.select("event_id"), "event_id", "left_anti")
    rows = diversity(rows).withColumn("uncertainty", uncertainty(F.col("mean_score"), threshold)).withColumn("disagreement", disagreement(F.col("sd"), F.col("models")))
    rows = rows.withColumn("priority", F.round(0.5 * F.col("uncertainty") + 0.3 * F.col("disagreement") + 0.2 * F.col("diversity"), 9)).withColumn("suggested_label", F.col("mean_score") >= threshold)
    return rows.orderBy(F.desc("priority"), "event_id").limit(k)


def fuse(scores: DataFrame, weights: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """Weighted mean of the scores that an event has, weights shared among those; 0 without any."""
    w = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("model_name")]
    rows = scores.groupBy("event_id").agg(F.sum(F.when(F.col("score").isNotNull(), w * F.col("score"))).alias("_s"), F.sum(F.when(F.col("score").isNotNull(), w)).alias("_w"))
    return rows.select("event_id", F.when(F.col("_w") > 0, F.col("_s") / F.col("_w")).otherwise(0.0).alias("fused")).withColumn("is_anomaly", F.col("fused") >= threshold)


def contributions(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """What each model gives to a weighted fusion: its weight times its score, on the mean over all events; a score that is missing gives 0."""
    w = F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("model_name")], F.lit(0.0))
    sums = scores.groupBy("model_name").agg(F.sum(F.coalesce(w * F.col("score"), F.lit(0.0))).alias("_sum"))
    events = scores.agg(F.countDistinct("event_id").alias("_n"))
    return sums.crossJoin(F.broadcast(events)).select("model_name", F.coalesce(F.try_divide("_sum", "_n"), F.lit(0.0)).alias("contribution"))  # one row


def fuse_batch(scores: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per event: models, whether any calls it anomalous, mean score."""
    return scores.groupBy("event_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("model_name"))).alias("models"), F.max(F.col("score") > threshold).alias("any_anomaly"), F.avg("score").alias("mean_score"))


def logistic_weights(wide: DataFrame, models: list[str], min_rows: int = 50, min_positive: int = 5) -> dict[str, float]:
    """Shares of the absolute coefficients of a logistic regression on the scores; equal shares if there is too little to learn from.

    ``wide`` has a column for each model and label. The fit is Spark's own, over all rows.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    equal = {m: 1 / len(models) for m in models}
    n, positive = wide.agg(F.count("*"), F.count(F.when(F.col("label"), 1))).first()
    if n < min_rows or positive < min_positive or positive == n:
        return equal
    rows = VectorAssembler(inputCols=models, outputCol="features", handleInvalid="skip").transform(wide.withColumn("y", F.col("label").cast("double")))
    fit = LogisticRegression(labelCol="y", regParam=1 / n, elasticNetParam=0.0, standardization=False, maxIter=200).fit(rows)
    size = [abs(float(c)) for c in fit.coefficients]
    return {m: c / sum(size) for m, c in zip(models, size)} if sum(size) > 0 else equal


def stacked(wide: DataFrame, models: list[str], folds: int = 5, min_rows: int = 50, min_positive: int = 5) -> DataFrame:
    """Adds ``fused``: cross-fitted predictions of a logistic regression; folds by a hash of the id, the equal-weight mean if there is too little."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    n, positive = wide.agg(F.count("*"), F.count(F.when(F.col("label"), 1))).first()
    if n < min_rows or positive < min_positive or positive == n:
        return wide.withColumn("fused", sum(F.col(m) for m in models) / len(models))
    folds = max(2, min(folds, positive))
    rows = VectorAssembler(inputCols=models, outputCol="features", handleInvalid="skip").transform(wide.withColumn("y", F.col("label").cast("double")).withColumn("_fold", F.pmod(F.xxhash64("event_id"), F.lit(folds))))
    out = None
    for k in range(folds):
        fit = LogisticRegression(labelCol="y", regParam=1 / n, elasticNetParam=0.0, standardization=False, maxIter=100).fit(rows.where(F.col("_fold") != k))
        part = fit.transform(rows.where(F.col("_fold") == k)).withColumn("fused", vector_to_array("probability")[1]).select(*wide.columns, "fused")
        out = part if out is None else out.unionByName(part)
    return out


def mean_times(pairs: DataFrame) -> DataFrame:
    """Mean time to detect of ours and the vendor's, in seconds, and the difference in percent; 0 where the vendor has none."""
    ours, theirs = F.avg("own_delay"), F.avg("vendor_delay")
    return pairs.agg(F.coalesce(ours, F.lit(0.0)).alias("mttd_own"), F.coalesce(theirs, F.lit(0.0)).alias("mttd_vendor"), F.when(theirs > 0, (ours - theirs) / theirs * 100).otherwise(0.0).alias("mttd_diff_pct"))


def compare_runs(runs: DataFrame) -> DataFrame:
    """The run with the largest coverage + precision + advantage - |mttd difference|; ties go to the smaller id."""
    composite = F.col("coverage") + F.col("precision_pct") + F.col("advantage") - F.abs("mttd_diff_pct")
    return runs.withColumn("composite", composite).orderBy(F.desc("composite"), "run_id").limit(1)


def unlabelled_queries(scores: DataFrame, labelled: DataFrame, k: int = 20, threshold: float = 0.5, unified: DataFrame | None = None) -> DataFrame:
    """The ``k`` events without a label to ask about first: highest unified score, or mean of the models' where there is none; ties by id."""
    rows = event_scores(scores.join(labelled.select("event_id"), "event_id", "left_anti"))
    rows = rows.join(unified.select("event_id", "unified_score"), "event_id", "left") if unified is not None else rows.withColumn("unified_score", F.lit(None).cast("double"))
    rows = rows.withColumn("unified_score", F.coalesce("unified_score", "mean_score")).withColumn("uncertainty", 1 - F.abs(F.col("unified_score") - threshold))
    return rows.select("event_id", "unified_score", "models", "uncertainty", (F.col("unified_score") >= threshold).alias("suggested_label"), F.lit("unlabeled").alias("reason")).orderBy(F.desc("unified_score"), "event_id").limit(k)


def by_time_and_source(results: DataFrame, places: int = 4) -> DataFrame:
    """Results of several models put together by (us, src_ip): mean score, rounded, number of models, whether any finds an anomaly."""
    return results.groupBy("us", "src_ip").agg(F.round(F.avg("score"), places).alias("avg_score"), F.count("*").alias("models"), F.max("is_anomaly").alias("is_anomaly"))


def most_suspicious(fused: DataFrame, k: int = 50) -> DataFrame:
    return fused.orderBy(F.desc("avg_score"), "us", "src_ip").limit(k)


def alert_payload(fused: DataFrame) -> DataFrame:
    """Alerts from fused scores (event_id, us, src_ip, dst_ip, fused, is_anomaly, models): severity in percent, cut; confidence is the score."""
    tags = F.when(F.col("is_anomaly"), F.array(F.lit("ml_detection"), F.lit("anomaly"))).otherwise(F.array(F.lit("ml_detection")))
    known = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", "unknown").otherwise(F.col(c).cast("string"))
    return fused.select(
        F.col("event_id").alias("alert_id"), "us", F.lit("detection_consumer").alias("source"), F.lit("anomaly").alias("source_type"), F.floor(F.col("fused") * 100).cast("int").alias("severity_raw"), F.col("fused").alias("confidence"),
        known("src_ip").alias("src_ip"), known("dst_ip").alias("dst_ip"), F.lit("tcp").alias("protocol"), F.lit("anomaly").alias("event_type"), F.concat_ws(",", "models").alias("ml_model"), F.col("fused").alias("ml_score"), tags.alias("tags"),
    )


def tuning_scores(results: DataFrame, threshold: float) -> DataFrame:
    """A detector's results as scores to tune on: what it found and at which threshold become features."""
    return results.select("event_id", "us", "src_ip", F.coalesce(F.col("dst_ip").cast("string"), F.lit("")).alias("dst_ip"), "model_name", "score", F.struct("is_anomaly", F.lit(threshold).alias("threshold")).alias("features"))


def fuse_by(method: str, scores: DataFrame, labelled: DataFrame | None = None, weights: dict[str, float] | None = None, models: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Fusion by method: "weighted" by given weights (equal ones without), "logistic" by weights learned from ``labelled`` (wide, with label)."""
    models = models or sorted(weights or {})
    if method == "weighted":
        return fuse(scores, weights or dict.fromkeys(models, 1 / len(models)), threshold)
    if method == "logistic":
        if labelled is None:
            raise ValueError("logistic fusion needs labelled rows")
        return fuse(scores, logistic_weights(labelled, models), threshold)
    raise ValueError(f"unknown method of fusion: {method}")
