"""Sinks: messages, date-partitioned tables, dead letters, action payloads, experiment runs, reports, metrics."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.scalars import playbook
from flowlens.operators.severity import DESTRUCTIVE


def as_messages(rows: DataFrame, key: str, topic: str) -> DataFrame:
    """(topic, key, value): what a Kafka sink takes; the value is the row as JSON."""
    return rows.select(F.lit(topic).alias("topic"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def index_name(topic: str | Column, fallback: str = "unclassified") -> Column:
    """The index of a topic: sensor topics by type, others by name, a fallback without one."""
    topic = F.col(topic) if isinstance(topic, str) else topic
    return F.coalesce(F.regexp_replace(F.nullif(topic, F.lit("")), "^sensor-(.*)$", "logs-$1"), F.lit(fallback))


def write_by_date(rows: DataFrame, path: str, us: str = "us", mode: str = "append", files: int = 16) -> None:
    """Parquet partitioned by event date, in up to ``files`` files a date, so that a day is not one task's work."""
    dated = rows.withColumn("date", F.date_from_unix_date(F.floor(F.col(us) / 86_400_000_000).cast("int")))
    dated.repartition("date", F.pmod(F.xxhash64(*rows.columns), F.lit(files))).write.mode(mode).partitionBy("date").parquet(path)


def drop_before(spark: SparkSession, path: str, date: str) -> DataFrame:
    """What a retention job keeps of a table by date: partitions from ``date`` on, pruned at planning."""
    return spark.read.parquet(path).where(F.col("date") >= F.lit(date).cast("date"))


def dead_letters(rejected: DataFrame, component: str) -> DataFrame:
    """(original_message, error, component): what goes to the dead-letter table."""
    columns = [c for c in rejected.columns if c != "error"]
    return rejected.select(F.to_json(F.struct(*columns)).alias("original_message"), "error", F.lit(component).alias("component"))


#: The response that an incident of each severity starts.
PLAYBOOKS = {"critical": "brain-critical-response", "high": "brain-high-response", "medium": "brain-medium-response", "low": "brain-low-response"}


def action_payload(incidents: DataFrame) -> DataFrame:
    """Adds playbook, auto_execute_actions and manual_review_actions to incidents with severity_label and recommended_actions.

    An action runs by itself if it says so and is none of the destructive ones, whatever it says; all others wait for a hand.
    """
    runs = lambda a: F.coalesce(a["auto_execute"], F.lit(False)) & ~F.coalesce(a["action"].isin(*DESTRUCTIVE), F.lit(False))
    every = "recommended_actions"
    return incidents.withColumns({"playbook": playbook("severity_label", PLAYBOOKS), "auto_execute_actions": F.filter(every, runs), "manual_review_actions": F.filter(every, lambda a: ~runs(a))})


def fan_out(*writers: Callable[[DataFrame, int], None], failed: Callable[[Callable, Exception], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that feeds several sinks from one computation of the batch.

    A sink that fails does not keep the others from theirs: ``failed`` is told of it, or without that the first error is raised at the end.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        errors: list[Exception] = []
        for w in writers:
            try:
                w(batch, number)
            except Exception as error:
                if failed:
                    failed(w, error)
                else:
                    errors.append(error)
        batch.unpersist()
        if errors:
            raise errors[0]

    return write


def save_run(spark: SparkSession, path: str, run_id: str, parameters: dict, figures: dict) -> None:
    """One row for an experiment run: parameters and figures as JSON with sorted keys, and a hash of the parameters."""
    text = json.dumps(parameters, sort_keys=True)
    row = spark.createDataFrame([(run_id, text, json.dumps(figures, sort_keys=True))], "run_id string, parameters string, figures string")
    row.withColumn("parameters_hash", F.sha2("parameters", 256)).write.mode("append").parquet(path)


def load_run(spark: SparkSession, path: str, run_id: str) -> dict:
    rows = spark.read.parquet(path).where(F.col("run_id") == run_id).limit(1).collect()
    if not rows:
        raise KeyError(run_id)
    return {"parameters": json.loads(rows[0]["parameters"]), "figures": json.loads(rows[0]["figures"])}


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """The ids of the runs that are kept, each with the hash of its parameters, in order."""
    return spark.read.parquet(path).select("run_id", "parameters_hash").orderBy("run_id")


def markdown(row: dict, title: str) -> str:
    """A one-row result as a report."""
    lines = [f"# {title}", "", "| Figure | Value |", "| --- | --- |"]
    return "\n".join(lines + [f"| {k} | {round(v, 4) if isinstance(v, float) else v} |" for k, v in row.items()]) + "\n"


def observed(rows: DataFrame, name: str = "engine"):
    """(rows with counters attached, observation): rows, anomalies and mean score are read off the job that writes them."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, F.count("*").alias("rows"), F.count(F.when(F.col("is_anomaly"), 1)).alias("anomalies"), F.avg("score").alias("mean_score")), seen
