"""Standing questions: the events to ask about, kept up batch by batch without reading earlier events again.

The diversity of an event depends on how many events share its bin of scores, so its priority moves with every batch. Within a bin, though, all
have the same diversity, so their order stays: the first ``k`` of each bin and the number of events in it are all that has to be kept. Parts
of a batch keep their own bounded heaps, and heaps merge by taking the first ``k`` of both, whatever the order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.tuning import disagreement, event_scores, uncertainty

BINS = 10
_STATE = "bin int, n long, event_id long, local double, mean_score double, is_count boolean"
_COLUMNS = [part.split()[0] for part in _STATE.split(", ")]


def _first(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    return rows.sort_values(["bin", "local", "event_id"], ascending=[True, False, True]).groupby("bin", sort=False).head(k)


def heaps(rows: DataFrame, k: int) -> DataFrame:
    """Per part of ``rows`` and bin the ``k`` events of the highest local priority, ties by id, and a row with the number of events it stands for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, counts = None, {}
        for pdf in batches:
            for at, n in pdf.groupby("bin")["n"].sum().items():
                counts[at] = counts.get(at, 0) + int(n)
            named = pdf[~pdf["is_count"]]
            held = _first(named if held is None else pd.concat([held, named]), k)
        if held is not None:
            yield held.assign(n=0)
        if counts:
            yield pd.DataFrame({"bin": list(counts), "n": list(counts.values()), "event_id": 0, "local": 0.0, "mean_score": 0.0, "is_count": True})

    return rows.select(*_COLUMNS).mapInPandas(run, _STATE)


def local_priorities(scores: DataFrame, threshold: float) -> DataFrame:
    """What a batch of model scores (event_id, score, model_name if there is one) adds: a row per event with its bin and the part of its priority that does not move."""
    rows = event_scores(scores.where("event_id IS NOT NULL"))
    place = F.coalesce(F.least(F.floor(F.col("mean_score") * BINS), F.lit(BINS - 1)), F.lit(-1)).cast("int")
    local = 0.5 * uncertainty(F.col("mean_score"), threshold) + 0.3 * disagreement(F.col("sd"), F.col("models"))
    return rows.select(place.alias("bin"), F.lit(1).cast("long").alias("n"), F.col("event_id").cast("long").alias("event_id"), F.round(local, 12).alias("local"), "mean_score", F.lit(False).alias("is_count"))


def merged(states: DataFrame, k: int) -> DataFrame:
    """One heap from several: of each part, then of all. What meets in one task is ``k`` rows a bin and part."""
    return heaps(heaps(states, k).repartition(1), k)


def questions(state: DataFrame, threshold: float, k: int) -> DataFrame:
    """(event_id, priority, suggested_label) of the ``k`` events to ask about, of all that the state stands for."""
    sums = state.groupBy("bin").agg(F.sum("n").alias("_n"))
    every = sums.agg(F.sum("_n").alias("_all"))
    diversity = 1 - F.col("_n") / F.col("_all")
    rows = state.where("NOT is_count").join(F.broadcast(sums), "bin").crossJoin(F.broadcast(every))  # one row
    rows = rows.withColumn("priority", F.round(F.col("local") + 0.2 * diversity, 9))
    return rows.orderBy(F.desc("priority"), "event_id").limit(k).select("event_id", "priority", (F.col("mean_score") >= threshold).alias("suggested_label"))


def keep_asking(spark: SparkSession, folder: str, threshold: float, k: int = 20) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the state of the questions under ``folder``, a version for each batch.

    A batch is read from the version before it and written as its own, so a batch that runs again after a failure counts once. An event's scores
    come in one batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = local_priorities(batch, threshold)
        before = latest_version(spark, folder, number)
        both = new if before is None else new.unionByName(spark.read.schema(_STATE).parquet(f"{folder}/version={before}"))
        merged(both, k).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return write


def latest_version(spark: SparkSession, folder: str, before: int | None = None) -> int | None:
    """The newest whole version under ``folder``, of those before a number if one is given."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    names = [s.getPath() for s in files.listStatus(path)]
    done = [int(p.getName().split("=")[1]) for p in names if p.getName().startswith("version=") and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max([n for n in done if before is None or n < before], default=None)


def asked(spark: SparkSession, folder: str, threshold: float, k: int = 20) -> DataFrame:
    """The questions that stand now."""
    version = latest_version(spark, folder)
    if version is None:
        return spark.createDataFrame([], "event_id long, priority double, suggested_label boolean")
    return questions(spark.read.schema(_STATE).parquet(f"{folder}/version={version}"), threshold, k)


def ask_over(stream: DataFrame, folder: str, threshold: float, k: int = 20) -> DataFrame:
    """Runs a stream of model scores (event_id, score) over all that is there and gives the questions at its end."""
    spark, place = stream.sparkSession, f"{folder}/questions-{uuid.uuid4().hex}"
    query = stream.writeStream.foreachBatch(keep_asking(spark, f"{place}/state", threshold, k)).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return asked(spark, f"{place}/state", threshold, k)
