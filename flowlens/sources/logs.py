"""Readers of sensor logs: tab-separated logs with header lines, EVE JSON lines, JSON logs by directory, and a paged REST source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, StructType

from flowlens.functions.privacy import pseudonym
from flowlens.functions.scalars import parse_time

#: Names of log fields in the engine; other fields keep theirs.
RENAMED = {"id.orig_h": "src_ip", "id.resp_h": "dst_ip", "id.orig_p": "src_port", "id.resp_p": "dst_port", "ts": "timestamp", "proto": "protocol", "qtype_name": "qtype"}
UNSET = ("-", "")


def typed(value: Column, kind: str) -> Column:
    """A log value by its declared type: unset counts are 0, intervals 0.0, booleans false, vectors empty, others null; times are UTC."""
    unset = value.isNull() | value.isin(*UNSET)
    if kind in ("count", "int", "port"):
        return F.when(unset, F.lit(0).cast("long")).otherwise(value.try_cast("long"))
    if kind in ("interval", "double"):
        return F.when(unset, 0.0).otherwise(value.try_cast("double"))
    if kind == "bool":
        return F.when(unset, False).otherwise(value.isin("T", "true", "True", "1"))
    if kind == "time":
        return F.timestamp_micros(F.when(unset, F.lit(0).cast("long")).otherwise(F.round(value.try_cast("double") * 1_000_000).cast("long")))
    if kind.startswith(("vector", "set")):
        items = F.when(unset, F.array().cast("array<string>")).otherwise(F.filter(F.split(value, ","), lambda x: ~x.isin(*UNSET)))
        return F.transform(items, lambda x: x.try_cast("long")) if "[int]" in kind or "[count]" in kind else items
    return F.when(~unset, value)


def header(lines: DataFrame) -> tuple[list[str], list[str]]:
    """Field names and types of the last such header lines, by the order of rows; no types are all strings, no fields give none.

    One aggregation; two lines come to the driver.
    """
    place, value = F.monotonically_increasing_id(), F.col("value")
    last = lambda mark: F.max(F.when(value.startswith(mark), F.struct(F.col("_place"), value)))
    got = lines.select(value, place.alias("_place")).where(value.startswith("#")).agg(last("#fields").alias("f"), last("#types").alias("t")).first()
    fields, types = (g["value"].split("\t")[1:] if g else [] for g in (got["f"], got["t"]))
    return fields, (types + ["string"] * len(fields))[: len(fields)]


def read_tsv(lines: DataFrame, columns: list[str] | None = None, salt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantined lines) of a log's lines (column ``value``).

    Comments and blank lines go; short rows are filled up with unset values; unknown fields are left out if ``columns`` are given; addresses
    become pseudonyms if a salt is given. A line with a number that is none is quarantined by itself.
    """
    fields, types = header(lines)
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("_parts", F.split("value", "\t"))
    names = [RENAMED.get(f, f) for f in fields]
    raw = {n: F.coalesce(F.get("_parts", F.lit(k)), F.lit("-")) for k, n in enumerate(names)}
    made = {n: typed(raw[n], t) for n, t in zip(names, types)}
    broken = F.lit(False)
    for n, t in zip(names, types):
        if t in ("count", "int", "port", "interval", "double", "time"):
            broken = broken | (~raw[n].isin(*UNSET) & raw[n].try_cast("double").isNull())
    keep = [n for n in names if columns is None or n in columns]
    rows = body.where(~broken).select(*[(pseudonym(made[n], salt) if salt and n in ("src_ip", "dst_ip") else made[n]).alias(n) for n in keep])
    return rows, body.where(broken).select("value")


_ENDS = "timestamp timestamp, uid string, src_ip string, dst_ip string, src_port long, dst_port long, "
#: The columns of each kind of log. Names and types of the data model.
LOG_SCHEMAS = {
    "conn": f"{_ENDS}protocol string, duration double, orig_bytes long, resp_bytes long, orig_pkts long, resp_pkts long, service string, conn_state string",
    "dns": f"{_ENDS}protocol string, query string, qclass long, qtype string, rcode string, rcode_name string, answers array<string>, ttl array<long>",
    "http": f"{_ENDS}method string, host string, uri string, user_agent string, status_code long, request_body_len long, response_body_len long",
    "ssl": f"{_ENDS}version string, cipher string, server_name string, resumed boolean, subject string, issuer string",
}


def read_log(lines: DataFrame, kind: str, salt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantined lines) of a log of a kind, with the columns of ``LOG_SCHEMAS`` in order; those that the log has not are null, others go."""
    schema = StructType.fromDDL(LOG_SCHEMAS[kind])
    rows, broken = read_tsv(lines, schema.names, salt)
    there = set(rows.columns)
    plain = lambda f: F.col(f.name).try_cast(f.dataType) if not isinstance(f.dataType, ArrayType) else F.transform(f.name, lambda x: x.try_cast(f.dataType.elementType))
    listed = dict(rows.dtypes)
    made = [(plain(f) if f.name in there and (not isinstance(f.dataType, ArrayType) or listed[f.name].startswith("array")) else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    return rows.select(*made), broken


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines under ``path``; none where there is no such path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return spark.read.text(path) if found else spark.createDataFrame([], "value string")


def read_tsv_path(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    return read_tsv(text_lines(spark, path), **options)


EVE_SCHEMA = "timestamp string, event_type string, src_ip string, dest_ip string, src_port int, dest_port int, proto string, flow_id long, alert struct<signature:string, category:string, severity:int, signature_id:long, metadata:array<array<string>>>, _corrupt string"


def read_eve(lines: DataFrame) -> DataFrame:
    """Flat alerts from EVE JSON lines (column ``value``): other events, blank and malformed lines are skipped; a reused technique id comes from the metadata."""
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", EVE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e")).where("e._corrupt IS NULL AND e.event_type = 'alert'")
    technique = F.get(F.filter("e.alert.metadata", lambda m: F.get(m, F.lit(0)) == "mitre_attack_id"), F.lit(0))
    return parsed.select(
        parse_time("e.timestamp").alias("timestamp"), F.col("e.src_ip").alias("src_ip"), F.col("e.dest_ip").alias("dst_ip"), F.col("e.src_port").alias("src_port"), F.col("e.dest_port").alias("dst_port"), F.col("e.proto").alias("protocol"),
        F.col("e.alert.signature").alias("alert_signature"), F.col("e.alert.category").alias("alert_category"), F.col("e.alert.severity").alias("alert_severity"), F.col("e.alert.signature_id").cast("string").alias("rule_id"), F.get(technique, F.lit(1)).alias("mitre_attack_id"), F.col("e.flow_id").alias("flow_id"),
    )


def by_topic(messages: DataFrame, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Messages (topic, value) parsed by the schema of their topic, a DataFrame for each; unparsable values have null fields."""
    return {topic: messages.where(F.col("topic") == topic).select(F.from_json("value", schema).alias("r"), "value").select("r.*", "value") for topic, schema in schemas.items()}


def json_logs(spark: SparkSession, root: str, schema: str, sensor: str, log_type: str, stream: bool = False) -> DataFrame:
    """A sensor's JSON logs under ``root/sensor/log_type`` with the topic they go to."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).json(f"{root}/{sensor}/{log_type}").withColumn("topic", F.lit(f"{sensor}-{log_type}"))


class PagedSource(DataSource):
    """A REST source read page by page with a cursor: ``fetch(cursor, options) -> (rows, next cursor or None)``.

    All pages are read, unless the option ``max_pages`` sets a limit.
    """

    fetch: Callable | None = None

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(type(self).fetch, dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, fetch: Callable, options: dict[str, str]):
        self.fetch, self.options = fetch, options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a cursor has to be followed in order

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import time

        cursor, wait = None, 1 / float(self.options.get("requests_per_second", "1000"))
        pages, most = 0, int(self.options.get("max_pages", "0"))
        while not most or pages < most:
            pages += 1
            for attempt in range(int(self.options.get("retries", "3")) + 1):
                try:
                    rows, cursor = self.fetch(cursor, self.options)
                    break
                except OSError:
                    if attempt == int(self.options.get("retries", "3")):
                        raise
                    time.sleep(float(self.options.get("backoff", "0.1")) * 2**attempt)
            yield from (tuple(r) for r in rows)
            if cursor is None:
                return
            time.sleep(wait)
