"""A table kept from a log of changes: a key's newest version wins, a null value deletes it, in whatever order changes come.

Changes are (key, value, version, ingest_us). They are appended as they come, one folder a batch, and folded into the table from time to time: the
table holds the newest version of each key, deletions among them, so that an older change that comes late stays without effect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.streaming.questions import latest_version

SCHEMA = "key string, value string, version long, ingest_us long"


def as_changes(rows: DataFrame, key: str, version: str | Column, value: Column | None = None, deleted: Column | None = None) -> DataFrame:
    """Rows as changes: the value is the row as JSON, or ``value``; where ``deleted`` holds it is null, a tombstone. Ingest time is now."""
    made = value if value is not None else F.to_json(F.struct(*rows.columns))
    kept = F.when(~F.coalesce(deleted, F.lit(False)), made) if deleted is not None else made
    number = F.col(version) if isinstance(version, str) else version
    return rows.select(F.col(key).cast("string").alias("key"), kept.alias("value"), number.cast("long").alias("version"), F.unix_micros(F.current_timestamp()).alias("ingest_us"))


def newest(changes: DataFrame) -> DataFrame:
    """The newest version of each key, tombstones among them; of equal versions a deletion wins, then the larger value. Changes without key are left out.

    One aggregation with partial results, so a key with a third of all changes is no more work than others.
    """
    order = F.struct("version", F.col("value").isNull(), "value")
    top = changes.where("key IS NOT NULL").groupBy("key").agg(F.max_by(F.struct("value", "version"), order).alias("c"), F.max_by("ingest_us", F.struct(order, "ingest_us")).alias("ingest_us"))
    return top.select("key", "c.value", "c.version", "ingest_us")


def live(table: DataFrame) -> DataFrame:
    """The keys that are there."""
    return table.where("value IS NOT NULL")


def append(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes a batch of changes to the log; a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select(*[part.split()[0] for part in SCHEMA.split(", ")]).write.mode("overwrite").parquet(f"{folder}/log/batch={number}")

    return write


def _log(spark: SparkSession, folder: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/log")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(f"{SCHEMA}, batch long").parquet(f"{folder}/log") if there else spark.createDataFrame([], f"{SCHEMA}, batch long")


def compact(spark: SparkSession, folder: str, keep_deleted_us: int | None = None, now_us: int | None = None) -> int:
    """Folds the log into a new version of the table, numbered after the last batch in it, and returns that number.

    It reads the last version and the batches after it only. Deletions are kept, since an older change of their key may yet come; those taken in
    more than ``keep_deleted_us`` before ``now_us`` go. Readers go on with the version before until the new one is whole.
    """
    before = latest_version(spark, f"{folder}/table")
    changes = _log(spark, folder)
    if before is not None:
        changes = changes.where(F.col("batch") >= before)
    last = changes.agg(F.max("batch")).first()[0]
    if last is None:
        return before if before is not None else -1
    rows = newest(changes.drop("batch") if before is None else changes.drop("batch").unionByName(spark.read.schema(SCHEMA).parquet(f"{folder}/table/version={before}")))
    if keep_deleted_us is not None:
        rows = rows.where(F.col("value").isNotNull() | (F.col("ingest_us") >= now_us - keep_deleted_us))
    rows.write.mode("overwrite").parquet(f"{folder}/table/version={last + 1}")
    return last + 1


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The table as all changes so far have it: the last version with the batches after it."""
    before = latest_version(spark, f"{folder}/table")
    changes = _log(spark, folder)
    if before is None:
        return live(newest(changes.drop("batch")))
    rows = changes.where(F.col("batch") >= before).drop("batch").unionByName(spark.read.schema(SCHEMA).parquet(f"{folder}/table/version={before}"))
    return live(newest(rows))
