"""The outbox and the cursor source: nothing lost and nothing twice, with failures and restarts."""

import json
import os

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from flowlens.sources import cursor, outbox, sinks

ROWS = "id long, note string"


@pytest.fixture
def sent(spark, tmp_path):
    outbox.register(spark)
    return f"file://{tmp_path}/out", lambda schema=ROWS: sorted((r["batch"], r["id"], r["note"]) for r in outbox.delivered(spark, f"file://{tmp_path}/out", schema).collect())


def test_a_batch_is_sent_once(spark, sent):
    path, got = sent
    rows = spark.createDataFrame([(k, f"n{k} é") for k in range(20)], ROWS).repartition(4)
    write = lambda frame, batch: frame.write.format("outbox").mode("append").option("path", path).option("batch_id", batch).save()
    assert got() == [] and outbox.deliveries(spark, path).count() == 0
    write(rows, "a")
    write(rows, "a")  # again, as after a driver that was lost
    write(rows.where("id < 3"), "b")
    write(rows.limit(0), "c")
    assert got() == [("a", k, f"n{k} é") for k in range(20)] + [("b", k, f"n{k} é") for k in range(3)] if got()[0][1] == 0 else sorted(got())
    assert {(r["batch"], r["rows"]) for r in outbox.deliveries(spark, path).collect()} == {("a", 20), ("b", 3), ("c", 0)}
    assert os.listdir(path.removeprefix("file://") + "/staging") == []


def test_nothing_of_a_batch_with_a_failing_part_is_sent(spark, sent):
    path, got = sent

    def fails(parts):
        for pdf in parts:
            if TaskContext.get().partitionId() == 2:
                raise ValueError("a part fails")
            yield pdf

    rows = spark.createDataFrame([(k, "x") for k in range(40)], ROWS).repartition(4)
    with pytest.raises(Exception, match="a part fails"):
        rows.mapInPandas(fails, ROWS).write.format("outbox").mode("append").option("path", path).option("batch_id", "a").save()
    assert got() == [] and outbox.deliveries(spark, path).count() == 0
    rows.write.format("outbox").mode("append").option("path", path).option("batch_id", "a").save()
    assert len(got()) == 40 and len({r[1] for r in got()}) == 40


def test_parts_without_a_manifest_do_not_count(spark, sent):
    path, got = sent
    folder = path.removeprefix("file://") + "/batches/batch=7"
    os.makedirs(folder)
    with open(f"{folder}/part-000000-1.jsonl", "w") as out:
        out.write('{"id": 1, "note": "half"}\n')
    assert got() == []
    spark.createDataFrame([(5, "whole")], ROWS).write.format("outbox").mode("append").option("path", path).option("batch_id", "7").save()
    assert got() == [("7", 5, "whole")]


def test_a_stream_sends_each_batch_once_after_restarts(spark, sent, tmp_path):
    path, got = sent
    broken = tmp_path / "broken"

    def run():
        rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        flag = str(broken)

        def check(parts):
            for pdf in parts:
                if os.path.exists(flag) and (pdf["id"] >= 20).any():
                    raise ValueError("the sink is down")
                yield pdf

        query = rows.mapInPandas(check, ROWS).writeStream.format("outbox").option("path", path).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    for a in (0, 10, 20):
        spark.createDataFrame([(k, "x") for k in range(a, a + 10)], ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        os.utime(tmp_path, None)
    broken.touch()
    with pytest.raises(Exception, match="the sink is down"):
        run()
    assert len(got()) in (0, 10, 20) and all(r[1] < 20 for r in got())
    broken.unlink()
    run()
    run()
    assert sorted(r[1] for r in got()) == list(range(30))


def test_incidents_go_through_the_outbox_as_messages(spark, sent):
    path, _ = sent
    incidents = spark.createDataFrame([(1, "critical"), (2, "low")], "incident_id long, severity_label string")
    sinks.as_messages(incidents, "incident_id", "incidents").write.format("outbox").mode("append").option("path", path).option("batch_id", "i").save()
    rows = outbox.delivered(spark, path, "topic string, key string, value string").collect()
    assert sorted((r["topic"], r["key"], json.loads(r["value"])["severity_label"]) for r in rows) == [("incidents", "1", "critical"), ("incidents", "2", "low")]


class Feed(cursor.CursorSource):
    """Rows of a file, by time, in pages of three."""

    @classmethod
    def name(cls):
        return "test_feed"

    @staticmethod
    def newest(options):
        with open(options["file"]) as file:
            return max((json.loads(line)[0] for line in file), default=-1) + 1

    @staticmethod
    def fetch(start, end, at, options):
        with open(options["calls"], "a") as calls:
            calls.write(f"{start} {end} {at}\n")
        if os.path.exists(options["calls"] + ".down"):
            os.unlink(options["calls"] + ".down")
            raise OSError("a call is lost")
        with open(options["file"]) as file:
            rows = sorted(tuple(json.loads(line)) for line in file)
        inside = [r for r in rows if start <= r[0] < end]
        begin = int(at or 0)
        return inside[begin : begin + 3], str(begin + 3) if begin + 3 < len(inside) else None


def test_a_cursor_stream_goes_on_where_it_ended(spark, tmp_path):
    spark.dataSource.register(Feed)
    file, calls = str(tmp_path / "feed"), str(tmp_path / "calls")

    def add(times):
        with open(file, "a") as out:
            out.writelines(json.dumps([t, f"e{t}"]) + "\n" for t in times)

    def run():
        stream = spark.readStream.format("test_feed").option("schema", "us long, name string").option("file", file).option("calls", calls).option("range_us", "100").option("backoff", "0.01").load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r["us"] for r in spark.read.schema("us long, name string").parquet(f"{tmp_path}/out").collect())

    add(range(0, 950, 10))
    open(calls + ".down", "w").close()
    assert run() == list(range(0, 950, 10))
    ranges = {tuple(map(int, line.split()[:2])) for line in open(calls)}
    assert len(ranges) == 10 and min(a for a, _ in ranges) == 0 and max(b for _, b in ranges) == 941  # ten partitions of about a hundred each
    assert run() == list(range(0, 950, 10))
    add(range(1000, 1100, 50))
    assert run() == [*range(0, 950, 10), 1000, 1050]
    again = [tuple(map(int, line.split()[:2])) for line in open(calls)]
    assert min(a for a, b in again if b > 941) >= 941  # nothing that was read is asked for again


def test_ranges_of_a_batch():
    reader = cursor._CursorReader(lambda options: 1000, None, {"range_us": "100", "most_ranges": "4"})
    assert [(p.start_us, p.end_us) for p in reader.partitions({"us": 0}, {"us": 250})] == [(0, 83), (83, 166), (166, 250)]
    assert len(reader.partitions({"us": 0}, {"us": 10_000})) == 4 and reader.partitions({"us": 5}, {"us": 5}) == []
    assert reader.latestOffset() == {"us": 1000}
    reader.commit({"us": 2000})
    assert reader.latestOffset() == {"us": 2000}  # a source that goes back does not take the stream with it
