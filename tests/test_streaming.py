"""Streams against batch results, over several micro-batches."""

from pyspark.sql import functions as F

from flowlens.operators import correlate
from flowlens.plans import models
from flowlens.streaming import jobs

HOUR = 3_600_000_000
T0 = 1_782_864_000_000_000


def files(spark, folder, batches):
    """One file for each batch, in order."""
    schema = "event_id long, us long, user_id long, k int"
    for n, rows in enumerate(batches):
        spark.createDataFrame([(e, T0 + us, u, k) for e, us, u, k in rows], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withColumn("ts", F.timestamp_micros("us"))


BATCHES = [[(1, 0, 7, 1), (2, HOUR, 7, 2), (3, 0, 8, 1)], [(4, 2 * HOUR, 7, 1), (5, 2 * HOUR, 7, 3)], [(6, 9 * HOUR, 7, 1), (7, 9 * HOUR, 8, 1)]]


def test_sliding_state_equals_the_frame_of_a_batch(spark, tmp_path):
    stream = files(spark, str(tmp_path), BATCHES)
    got = {(r["event_id"], r["size"]) for r in jobs.drain(jobs.sliding(stream, 2 * HOUR, delay="12 hours"), f"{tmp_path}/run", "append").collect()}
    rows = [(e, us, u, k) for batch in BATCHES for e, us, u, k in batch]
    alerts = spark.createDataFrame(rows, "alert_id long, us long, src_ip long, dst_ip int").withColumn("event_type", F.lit("scan")).withColumn("severity", F.lit(1))
    assert got == {(r["alert_id"], r["size"]) for r in correlate.sliding_groups(alerts, 2 * HOUR).collect()} == {(2, 2), (4, 4), (5, 4)}


def test_rollup_keeps_the_newest_version_of_a_window(spark, tmp_path):
    stream = files(spark, str(tmp_path), BATCHES).withColumn("value", F.lit(1.5))
    rows = jobs.drain(jobs.rollup(stream, "1 day", "6 hours"), f"{tmp_path}/run", "update", ["start", "user_id"]).collect()
    assert {((r["start"].hour), r["user_id"]): (r["connections"], r["bytes_total"], r["unique_targets"]) for r in rows} == {(0, 7): (4, 6.0, 3), (0, 8): (1, 1.5, 1), (6, 7): (1, 1.5, 1), (6, 8): (1, 1.5, 1)}


def test_sessions_of_a_stream(spark, tmp_path):
    rows = jobs.drain(jobs.sessions(files(spark, str(tmp_path), BATCHES), "90 minutes", "1 day"), f"{tmp_path}/run", "complete").collect()
    assert sorted((r["user_id"], r["alerts"]) for r in rows) == [(7, 1), (7, 4), (8, 1), (8, 1)]


def test_duplicates_within_the_watermark_go(spark, tmp_path):
    stream = files(spark, str(tmp_path), [[(1, 0, 7, 1), (1, 10, 7, 1)], [(1, 20, 7, 1), (2, 30, 7, 1)]])
    assert sorted(r["event_id"] for r in jobs.drain(jobs.deduplicated(stream, ["event_id"]), f"{tmp_path}/run", "append").collect()) == [1, 2]


def test_votes_meet_scores_within_reach(spark, tmp_path):
    votes = files(spark, f"{tmp_path}/v", [[(1, 0, 7, 1), (2, 0, 7, 1)]]).select("event_id", "ts", (F.col("k") == 1).alias("label"))
    scores = files(spark, f"{tmp_path}/s", [[(1, 60_000_000, 7, 1), (2, 2 * HOUR, 7, 1)]]).select("event_id", "ts", F.lit(0.5).alias("score"))
    rows = jobs.drain(jobs.with_scores(votes, scores, "1 day"), f"{tmp_path}/run", "append").collect()
    assert [(r["event_id"], r["label"], r["score"]) for r in rows] == [(1, True, 0.5)]


def test_invalid_rows_go_to_the_dead_letters(spark, tmp_path):
    good, bad = [], []
    sink = jobs.split_sink({"target": F.col("k") < 3}, lambda df: good.extend(r["event_id"] for r in df.collect()), lambda df: bad.extend((r["event_id"], r["error"]) for r in df.collect()))
    query = files(spark, str(tmp_path), BATCHES).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(good) == [1, 2, 3, 4, 6, 7] and bad == [(5, "target")]


def test_replay_counts_all_events_whatever_the_order_of_files(spark, tmp_path):
    """The newest file comes first; one source has 3000 events in a window, some at equal times."""
    events = [(k, T0 + 2 * 24 * HOUR + k // 2 * 1_000_000, 7) for k in range(3000)] + [(3000 + k, T0 + k * HOUR, 8) for k in range(40)] + [(4000 + k, T0 + k * HOUR, 7) for k in range(10)]
    for part in (events[:3000], events[3020:3040], events[3000:3020] + events[3040:]):
        rows = spark.createDataFrame([(*e, "view", 1.0, '{"k": 1}') for e in part], "event_id long, us long, user_id long, event_type string, value double, props string")
        rows.select("event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    sizes = {e: sum(v == u and t - 6 * HOUR <= s <= t for _, s, v in events) for e, t, u in events}
    got = {r["event_id"]: r["size"] for r in models.stream_sliding(spark, str(tmp_path)).collect()}
    assert got == {e: n for e, n in sizes.items() if n >= 2} and max(got.values()) == 3000
    rolled = {}
    for _, t, u in events:
        rolled[t - t % HOUR, u] = rolled.get((t - t % HOUR, u), 0) + 1
    assert {(r["bucket_us"], r["user_id"]): r["connections"] for r in models.stream_rollup(spark, str(tmp_path)).collect()} == rolled


def test_sliding_state_is_not_cut_over_batches(spark, tmp_path):
    batches = [[(1500 * b + k, b * HOUR + k, 7, 1) for k in range(1500)] for b in range(2)]
    got = [r["size"] for r in jobs.drain(jobs.sliding(files(spark, str(tmp_path), batches), 2 * HOUR), f"{tmp_path}/run", "append").collect()]
    assert sorted(got) == list(range(2, 3001))
