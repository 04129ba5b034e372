"""A transactional outbox: what a batch or a stream sends, once and whole, whatever tasks and batches run again.

Tasks stage their rows as lines of JSON under the run's own folder. Only when all tasks are done does the driver put the parts that they name into
the batch's folder and write its manifest, which makes the batch count; a part of an attempt that failed is named by none and goes. A batch
whose manifest is there is not written again. What an outside system is sent is read from the outbox, by manifest.
Paths are those of ``pyarrow.fs``; driver and executors have to share them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"


@dataclass
class Part(WriterCommitMessage):
    """A staged file with the run that it was staged by, and the rows in it; no file where a task had no rows.

    Of a stream the writer that commits is another one than that of the tasks, so the run comes with the part.
    """

    name: str | None
    rows: int
    run: str


class Outbox(DataSource):
    """``df.write.format("outbox").option("path", ...).option("batch_id", ...)`` or ``writeStream``; the columns become the fields of the lines.

    Without ``batch_id`` every batch write is a new one. A stream's batches are numbered by Spark.
    """

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema.names)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _StreamWriter(dict(self.options), schema.names)


class _Staging:
    def __init__(self, options: dict[str, str], names: list[str]):
        self.uri, self.names, self.run = options["path"], names, uuid.uuid4().hex
        self.batch = options.get("batch_id") or options.get("batchId")

    def _place(self, *parts: str) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.uri)
        return files, "/".join([root, *parts])

    def write(self, iterator: Iterator) -> Part:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.jsonl"
        files, folder = self._place("staging", self.run)
        out, rows = None, 0
        try:
            for row in iterator:
                if out is None:
                    files.create_dir(folder)
                    out = files.open_output_stream(f"{folder}/{name}")
                out.write((json.dumps(dict(zip(self.names, row)), default=str, ensure_ascii=False) + "\n").encode())
                rows += 1
        finally:
            if out is not None:
                out.close()
        return Part(name if rows else None, rows, self.run)

    def _finish(self, messages: list, batch: str) -> None:
        """Puts the batch in its place: parts first, then the manifest, whose presence is the commit."""
        files, done = self._place("batches", f"batch={batch}", MANIFEST)
        folder = done.rsplit("/", 1)[0]
        if files.get_file_info(done).type == fs.FileType.NotFound:
            if files.get_file_info(folder).type != fs.FileType.NotFound:
                files.delete_dir(folder)  # left by a commit that did not come to its manifest
            files.create_dir(folder)
            parts = [m for m in messages if m is not None and m.name]
            for part in parts:
                files.move(f"{self._place('staging', part.run)[1]}/{part.name}", f"{folder}/{part.name}")
            with files.open_output_stream(f"{done}.tmp") as out:
                out.write(json.dumps({"batch": batch, "rows": sum(m.rows for m in parts), "parts": sorted(m.name for m in parts)}).encode())
            files.move(f"{done}.tmp", done)
        self._clear(messages)

    def _clear(self, messages: list) -> None:
        """Removes what the runs of these parts, and this one, have staged."""
        for run in {self.run} | {m.run for m in messages if m is not None}:
            files, folder = self._place("staging", run)
            if files.get_file_info(folder).type != fs.FileType.NotFound:
                files.delete_dir(folder)


class _Writer(_Staging, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self._finish(messages, self.batch or self.run)

    def abort(self, messages: list) -> None:
        self._clear(messages)


class _StreamWriter(_Staging, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._finish(messages, str(batchId))

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._clear(messages)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Outbox)


def deliveries(spark: SparkSession, path: str) -> DataFrame:
    """(batch, rows, parts) of each batch that counts."""
    files, root = fs.FileSystem.from_uri(path)
    schema = "batch string, rows long, parts array<string>"
    if files.get_file_info(f"{root}/batches").type == fs.FileType.NotFound:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", MANIFEST).json(f"{path}/batches")


def delivered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the batches that count, with their batch: lines of parts that a manifest names."""
    counted = deliveries(spark, path).select(F.col("batch").alias("_batch"), F.explode("parts").alias("_part"))
    if counted.isEmpty():
        return spark.createDataFrame([], f"{schema}, batch string")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").json(f"{path}/batches").withColumn("_part", name)  # batch comes from the folder
    return rows.withColumn("batch", F.col("batch").cast("string")).join(F.broadcast(counted), (F.col("batch") == F.col("_batch")) & (rows["_part"] == counted["_part"])).drop("_part", "_batch")
