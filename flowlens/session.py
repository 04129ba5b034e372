"""A session with the settings that the engine expects."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(app: str = "flowlens", master: str | None = None, **settings: str) -> SparkSession:
    """``settings`` are Spark settings with ``__`` for dots; they override ``SETTINGS``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.

    Where it is unset, a temporary folder of our own in local mode; an error on a cluster, whose machines do not see each other's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="flowlens-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` computed once and cut from what made them, in the shared folder: for frames that a plan reads several times."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()
