"""Vote flush, standing questions and the change log: any order of batches against a plain replay."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import labels, tuning
from flowlens.sources import changelog
from flowlens.streaming import correlator, jobs, questions, votes

SECOND = 1_000_000
T0 = 1_782_864_000_000_000
WEIGHTS = {"ids": 1.2, "hids": 1.0, "analyst": 2.0}
SCHEMA = "us long, ord long, is_vote boolean, event_id string, src_ip string, dst_ip string, source string, label boolean, confidence double, event_type string, mitre_attack_id string, score double, is_anomaly boolean"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", correlator.ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def drawn(seed, n=300, events=25):
    draw, us, out = random.Random(seed), T0, []
    for k in range(n):
        us += draw.randrange(4 * SECOND)
        event = f"e{draw.randrange(events)}" if draw.random() < 0.97 else None
        if draw.random() < 0.7:
            source = draw.choice(["ids", "hids", "hids", "other", "analyst"] if draw.random() < 0.3 else ["ids", "hids", "other"])
            out.append((us, k, True, event, "A", f"d{k % 3}", source, draw.choice([True, True, False, None]), draw.choice([0.0, 0.5, 0.9]), draw.choice([None, "scan", ""]), draw.choice([None, "T1"]), None, None))
        else:
            out.append((us, k, False, event or "e0", "A", None, None, None, None, None, None, k / n, k % 2 == 0))
    return out


def replay(records, flush=5, ttl=20 * SECOND, kept=8, dropped=3):
    """One record after the other; what waits at the end is agreed on as well."""
    pending, scores, out, newest = [], {}, [], 0

    def agreed():
        groups = {}
        for v in pending:
            if v[3]:
                groups.setdefault(v[3], []).append(v)
        for event, found in groups.items():
            if event not in scores:
                out.append(("late", event, len(found), None, None, None))
            said = [v for v in found if v[7] is not None]
            if not said:
                continue
            analyst = [v for v in said if v[6] == "analyst"]
            if analyst:
                newest_vote = max(analyst, key=lambda v: v[0])
                label, confidence = newest_vote[7], 1.0
            else:
                total = sum(WEIGHTS.get(v[6], 1.0) * v[8] for v in said)
                if not total:
                    continue
                score = sum(WEIGHTS.get(v[6], 1.0) * v[8] * (1 if v[7] else -1) for v in said) / total
                label, confidence = score > 1e-12, abs(score)
            if label and confidence > 0.5:
                out.append(("incident", event, len(found), said[0][0], round(confidence, 9), scores[event][1] if event in scores else None))
        pending.clear()

    for r in records:
        if r[0] > newest + 60 * SECOND:
            agreed()
        newest = max(newest, r[0])
        for event in [e for e, (us, _) in scores.items() if us < newest - ttl]:
            del scores[event]
        if r[2]:
            pending.append(r)
            continue
        scores[r[3]] = (r[0], r[11])
        if len(scores) > kept:
            for event in sorted(scores, key=lambda e: (scores[e][0], e))[:dropped]:
                del scores[event]
        if len(pending) >= flush:
            agreed()
    agreed()
    return sorted(out, key=repr)


def streamed(spark, folder, batches, lanes=1):
    for part in batches:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withColumn("ts", F.timestamp_micros("us"))
    stream = votes.tagged(rows.where("is_vote"), rows.where("NOT is_vote"), WEIGHTS, lanes)
    got = jobs.drain(votes.flush_votes(stream, 5, 20 * SECOND, 60 * SECOND, 8, 3, delay="10 minutes"), f"{folder}/run", "append").collect()
    assert all((r["us"] is not None) and (r["kind"] == "late") == (r["label"] is None) for r in got)
    return sorted(((r["kind"], r["event_id"], r["votes"], r["us"] if r["kind"] == "incident" else None, None if r["confidence"] is None else round(r["confidence"], 9), r["score"]) for r in got), key=repr)


@pytest.mark.parametrize(("seed", "cut"), [(1, 300), (1, 23), (2, 71)])
def test_votes_are_flushed_as_in_a_replay(rocks, tmp_path, seed, cut):
    records = drawn(seed)
    # A score an hour later: what still waits is agreed on.
    end = [(records[-1][0] + s * SECOND, 1000 + s, False, "end", "A", None, None, None, None, None, None, 0.5, False) for s in (3600, 3601)]
    got = streamed(rocks, str(tmp_path), [*[records[a : a + cut] for a in range(0, len(records), cut)], end[:1], end[1:]])
    assert got == replay([*records, *end])
    assert {r[0] for r in got} == {"late", "incident"} and any(r[5] is not None for r in got) and any(r[0] == "incident" and r[5] is None for r in got)


def test_an_idle_lane_agrees_on_what_waits(rocks, tmp_path):
    one = (T0, 1, True, "e", "A", "d", "ids", True, 0.9, "scan", "T1", None, None)
    score = (T0 + SECOND, 2, False, "e", "A", None, None, None, None, None, None, 0.7, True)
    later = [(T0 + s * SECOND, 10 + s, False, "x", "A", None, None, None, None, None, None, 0.1, False) for s in (7200, 7300)]
    got = streamed(rocks, str(tmp_path), [[one, score], later[:1], later[1:]])
    # Alone it waits for four others; once its lane has been idle it is agreed on, by a timer or by the next record, with the score that was there.
    assert got == [("incident", "e", 1, T0, 1.0, 0.7)]
    other = (T0 + 7200 * SECOND, 10, False, "x", "B", None, None, None, None, None, None, 0.1, False)
    assert streamed(rocks, f"{tmp_path}/timer", [[one, score], [other], [(other[0] + SECOND, *other[1:])]], lanes=2**20) == [("incident", "e", 1, T0, 1.0, 0.7)]


def test_agreement_equals_the_batch_consensus(spark):
    records = [r for r in drawn(5) if r[2] and r[3]]
    frame = spark.createDataFrame(records, SCHEMA)
    wanted = {r["event_id"]: r for r in labels.consensus(frame, WEIGHTS).collect()}
    by_event = {}
    for r in records:
        by_event.setdefault(r[3], []).append(dict(zip(["us", "ord", "is_vote", "event_id", "src_ip", "dst_ip", "source", "label", "confidence", "event_type", "mitre_attack_id"], r)) | {"weight": WEIGHTS.get(r[6], 1.0)})
    for event, found in by_event.items():
        made = votes.agree(found)
        assert (made is None) == (event not in wanted)
        if made:
            same = wanted[event]
            assert [made[c] for c in ("us", "src_ip", "dst_ip", "label", "event_type", "mitre_attack_id", "sources", "votes_positive", "votes_negative")] == [same[c] for c in ("us", "src_ip", "dst_ip", "label", "event_type", "mitre_attack_id", "sources", "votes_positive", "votes_negative")]
            assert made["confidence"] == pytest.approx(same["confidence"])


def test_scores_are_kept_by_age_and_number():
    draw = random.Random(2)
    buffer, plain = votes.Buffer({}, 50, 5, 2), {}
    for step in range(500):
        us, event = step + draw.randrange(-5, 5), f"e{draw.randrange(9)}"
        buffer.expire(step)
        plain = {e: v for e, v in plain.items() if v[0] >= step - 50}
        buffer.put(event, us, step, True)
        plain[event] = (us, step, True)
        if len(plain) > 5:
            for e in sorted(plain, key=lambda e: (plain[e][0], e))[:2]:
                del plain[e]
        assert buffer.held == plain


@pytest.mark.parametrize("seed", [1, 2])
def test_standing_questions_equal_active_learning_over_all_batches(spark, tmp_path, seed):
    draw = random.Random(seed)
    scores = [(e, m, draw.choice([0.5, 0.48, draw.random(), None])) for e in range(400) for m in ("a", "b", "c")]
    events = list(range(400))
    draw.shuffle(events)
    for part in (events[:150], events[150:151], events[151:390], events[390:]):
        inside = set(part)
        spark.createDataFrame([s for s in scores if s[0] in inside], "event_id long, model_name string, score double").repartition(3).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, model_name string, score double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = [(r["event_id"], r["priority"], r["suggested_label"]) for r in questions.ask_over(stream, str(tmp_path), 0.5, 15).collect()]
    every = tuning.active_learning(spark.createDataFrame(scores, "event_id long, model_name string, score double"), 0.5, 15).collect()
    assert [g[0] for g in got] == [r["event_id"] for r in every] and [g[2] for g in got] == [r["suggested_label"] for r in every]
    assert [g[1] for g in got] == pytest.approx([r["priority"] for r in every], abs=2e-9)


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    rows = lambda a, b: spark.createDataFrame([(e, e / 100) for e in range(a, b)], "event_id long, score double")
    write = questions.keep_asking(spark, f"{tmp_path}/s", 0.5, 5)
    write(rows(0, 40), 0)
    write(rows(40, 90), 1)
    first = questions.asked(spark, f"{tmp_path}/s", 0.5, 5).collect()
    write(rows(40, 90), 1)
    assert questions.asked(spark, f"{tmp_path}/s", 0.5, 5).collect() == first
    assert spark.read.parquet(f"{tmp_path}/s/version=1").agg(F.sum("n")).first()[0] == 90
    assert questions.asked(spark, f"{tmp_path}/none", 0.5).count() == 0


def folded(changes):
    table = {}
    for key, value, version, _ in changes:
        if key is not None and (key not in table or (version, value is None, value or "") > table[key][:3]):
            table[key] = (version, value is None, value or "", value)
    return {k: (v[3], v[0]) for k, v in table.items() if v[3] is not None}


@pytest.mark.parametrize("seed", range(3))
def test_any_order_of_changes_gives_the_same_table(spark, tmp_path, seed):
    draw = random.Random(seed)
    changes = [(f"k{draw.randrange(12)}", draw.choice([None, "x", "y"]), draw.randrange(40), k) for k in range(150)] + [(None, "x", 99, 1)]
    draw.shuffle(changes)
    write, at, number = changelog.append(str(tmp_path)), 0, 0
    while at < len(changes):
        size = draw.randrange(1, 60)
        batch = spark.createDataFrame(changes[at : at + size], changelog.SCHEMA)
        write(batch, number)
        if draw.random() < 0.3:
            write(batch, number)  # once more, as after a failure
        at, number = at + size, number + 1
        if draw.random() < 0.6:
            changelog.compact(spark, str(tmp_path))
        assert {r["key"]: (r["value"], r["version"]) for r in changelog.current(spark, str(tmp_path)).collect()} == folded(changes[:at])
    last = changelog.compact(spark, str(tmp_path))
    assert changelog.compact(spark, str(tmp_path)) == last == number
    assert {r["key"]: (r["value"], r["version"]) for r in changelog.live(spark.read.parquet(f"{tmp_path}/table/version={last}")).collect()} == folded(changes)


def test_a_deleted_key_stays_deleted(spark, tmp_path):
    write = changelog.append(str(tmp_path))
    rows = spark.createDataFrame([("a", 1, 5, False), ("a", 2, 6, True), ("b", 3, 1, None)], "id string, n int, v long, gone boolean")
    changes = changelog.as_changes(rows, "id", "v", deleted=F.col("gone"))
    assert all(r["ingest_us"] > T0 / 2 for r in changes.collect())
    write(changes, 0)
    changelog.compact(spark, str(tmp_path))
    write(changelog.as_changes(spark.createDataFrame([("a", 9, 4)], "id string, n int, v long"), "id", "v"), 1)  # older than the deletion
    assert [r["key"] for r in changelog.current(spark, str(tmp_path)).collect()] == ["b"]
    changelog.compact(spark, str(tmp_path), keep_deleted_us=0, now_us=2**62)
    assert [r["key"] for r in spark.read.parquet(f"{tmp_path}/table/version=2").collect()] == ["b"]
    assert changelog.current(spark, f"{tmp_path}/none").count() == 0 and changelog.compact(spark, f"{tmp_path}/none") == -1
