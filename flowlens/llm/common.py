"""Reading tables and what the queries of this subpackage share on the Spark side."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; 0 for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % modulus, F.lit(0))


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


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate results, wherever Spark's file systems keep it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of an Arrow batch of texts, at most.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Lowers the session's Arrow batches to ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes, where they are larger.

    The default of 10,000 rows suits numbers; of whole texts it makes tens of MB, held several times over by the executor and its Python worker.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage, in the shared folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def labelled(documents: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int) -> DataFrame:
    """(doc_id, text, y, weight) of labelled documents for which ``keep``, a condition on doc_id, holds.

    At most ``per_class`` documents of each label, taken by a hash of the id, so the side that is broadcast is bounded by that
    parameter; ``weight`` is how many labels of its class a row stands for, so that weighted classes keep the shares of the whole table.
    A document labelled twice counts as its largest label; null labels and labels of unknown documents are left out.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    taken = None
    for y in (0, 1):
        weight = max(1.0, size.get(y, 0) / per_class)
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).withColumn("weight", F.lit(weight))
        taken = part if taken is None else taken.unionByName(part)
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(taken), "doc_id")
