"""Weak votes and model scores as they come: votes wait, a score lets those that wait be agreed on, and scores are kept for a while.

Both kinds of records are tagged into one stream and keyed by lane, so that one state machine sees them in order; no stream is joined with
another. The scores of a lane are bounded by age and by number. Votes on an event whose score is not there (any more) go to a side output.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Votes that wait before a score has them agreed on, scores kept, and how many of the oldest go at once beyond that.
FLUSH, KEPT, DROPPED = 5, 1000, 100
TTL, IDLE = 600_000_000, 60_000_000
#: What makes an incident: a positive consensus of more than this confidence.
LEAST = 0.5
_VOTE = "us long, ord long, event_id string, src_ip string, dst_ip string, source string, label boolean, confidence double, weight double, event_type string, mitre_attack_id string"
_VOTE_COLUMNS = [part.split()[0] for part in _VOTE.split(", ")]
OUTCOMES = (
    "kind string, event_id string, us long, src_ip string, dst_ip string, label boolean, confidence double, event_type string, mitre_attack_id string, sources string, votes_positive long, votes_negative long, "
    "score double, is_anomaly boolean, votes long"
)
_OUT_COLUMNS = [part.split()[0] for part in OUTCOMES.split(", ")]


def agree(votes: list[dict]) -> dict | None:
    """The consensus of one event's votes, in order, or None without one: as ``labels.consensus`` has it, on the few votes of a flush."""
    said = [v for v in votes if v["label"] is not None]
    if not said:
        return None
    first = lambda column: next((v[column] for v in said if v[column]), None)
    out = {"us": said[0]["us"], "src_ip": said[0]["src_ip"], "dst_ip": said[0]["dst_ip"], "event_type": first("event_type"), "mitre_attack_id": first("mitre_attack_id"), "sources": ",".join(sorted({v["source"] for v in said}))}
    analyst = [v for v in said if v["source"] == "analyst"]
    if analyst:
        return out | {"label": max(analyst, key=lambda v: v["us"])["label"], "confidence": 1.0, "votes_positive": 0, "votes_negative": 0}
    total = sum(v["weight"] * v["confidence"] for v in said)
    if not total:
        return None
    score = sum(v["weight"] * v["confidence"] * (1 if v["label"] else -1) for v in said) / total
    positive = sum(v["label"] for v in said)
    return out | {"label": round(score, 12) > 0, "confidence": abs(score), "votes_positive": positive, "votes_negative": len(said) - positive}


class Buffer:
    """Scores by event, at most ``kept``, none older than ``ttl`` behind the newest record; beyond ``kept`` the oldest go, ``dropped`` at once."""

    def __init__(self, held: dict[str, tuple], ttl: int, kept: int, dropped: int):
        self.held, self.ttl, self.kept, self.dropped = held, ttl, kept, dropped
        self.ages = [(us, event) for event, (us, *_) in held.items()]
        heapq.heapify(self.ages)

    def _oldest(self) -> tuple[int, str] | None:
        while self.ages and self.held.get(self.ages[0][1], (None,))[0] != self.ages[0][0]:
            heapq.heappop(self.ages)  # a score that has been replaced
        return self.ages[0] if self.ages else None

    def put(self, event: str, us: int, score: float, is_anomaly: bool) -> None:
        self.held[event] = (us, score, is_anomaly)
        heapq.heappush(self.ages, (us, event))
        if len(self.held) > self.kept:
            for _ in range(self.dropped):
                if self._oldest():
                    del self.held[self._oldest()[1]]

    def expire(self, newest: int) -> None:
        while (oldest := self._oldest()) and oldest[0] < newest - self.ttl:
            del self.held[oldest[1]]


class VoteFlush(StatefulProcessor):
    """See ``flush_votes``."""

    def __init__(self, flush: int, ttl: int, idle: int, kept: int, dropped: int, least: float):
        self.flush, self.ttl, self.idle, self.kept, self.dropped, self.least = flush, ttl, idle, kept, dropped, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _VOTE)
        self.scores = handle.getMapState("scores", "event_id string", "us long, score double, is_anomaly boolean")
        self.newest = handle.getValueState("newest", "us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pending = [dict(zip(_VOTE_COLUMNS, v)) for v in self.pending.get()]
        before = {k[0]: tuple(v) for k, v in self.scores.iterator()}
        buffer = Buffer(dict(before), self.ttl, self.kept, self.dropped)
        newest = self.newest.get()[0] if self.newest.exists() else 0
        out: list[dict] = []
        came = pd.concat(list(rows)).sort_values(["us", "ord"], kind="stable").astype(object)
        for row in came.where(came.notna(), None).to_dict("records"):
            if pending and row["us"] > newest + self.idle:  # what waited then, though no timer has told it yet
                out += self._flushed(pending, buffer.held)
                pending = []
            newest = max(newest, row["us"])
            buffer.expire(newest)
            if row["is_vote"]:
                pending.append({c: row[c] for c in _VOTE_COLUMNS})
                continue
            buffer.put(row["event_id"], row["us"], row["score"], row["is_anomaly"])
            if len(pending) >= self.flush:
                out += self._flushed(pending, buffer.held)
                pending = []
        if pending:
            self.pending.put([tuple(v[c] for c in _VOTE_COLUMNS) for v in pending])
        else:
            self.pending.clear()
        for event in before.keys() - buffer.held.keys():
            self.scores.removeKey((event,))
        for event, value in buffer.held.items():
            if before.get(event) != value:
                self.scores.updateValue((event,), value)
        self.newest.update((newest,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((newest + self.idle) // 1000 + 1)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A lane that has been idle agrees on what still waits; its scores stay for their time, or go where that has passed."""
        pending = [dict(zip(_VOTE_COLUMNS, v)) for v in self.pending.get()]
        held = {k[0]: tuple(v) for k, v in self.scores.iterator()}
        self.pending.clear()
        newest = self.newest.get()[0]
        end = (newest + self.ttl) // 1000 + 1
        if expiredTimerInfo.getExpiryTimeInMs() >= end:
            self.scores.clear()
            self.newest.clear()
        else:
            self.handle.registerTimer(end)
        yield self._frame(self._flushed(pending, held))

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(out: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([[row.get(c) for c in _OUT_COLUMNS] for row in out], columns=_OUT_COLUMNS, dtype=object)

    def _flushed(self, pending: list[dict], held: dict[str, tuple]) -> list[dict]:
        by_event: dict[str, list[dict]] = {}
        for vote in pending:
            if vote["event_id"]:
                by_event.setdefault(vote["event_id"], []).append(vote)
        out = []
        for event, votes in by_event.items():
            score = held.get(event)
            if score is None:
                out.append({"kind": "late", "event_id": event, "us": votes[0]["us"], "votes": len(votes)})
            agreed = agree(votes)
            if agreed and agreed["label"] and agreed["confidence"] > self.least:
                known = {"score": score[1], "is_anomaly": score[2]} if score else {}
                out.append({"kind": "incident", "event_id": event, "votes": len(votes), **agreed, **known})
        return out


def tagged(votes: DataFrame, scores: DataFrame, weights: dict[str, float], lanes: int = 64) -> DataFrame:
    """Votes (event_id, us, ts, ord, src_ip, dst_ip, source, label, confidence, event_type, mitre_attack_id) and scores (event_id, us, ts, ord,
    src_ip, score, is_anomaly) as one stream with their lane, which follows from src_ip, so that votes meet the scores of their event."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    lane = F.pmod(F.xxhash64(F.col("src_ip").cast("string")), F.lit(lanes)).cast("int").alias("lane")
    text = lambda *names: [F.col(c).cast("string").alias(c) for c in names]
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    left = votes.select(
        lane, "ts", F.lit(True).alias("is_vote"), "us", "ord", *text("event_id", "src_ip", "dst_ip", "source"), "label", "confidence", F.coalesce(table[F.col("source")], F.lit(1.0)).alias("weight"), *text("event_type", "mitre_attack_id"),
        *none("double", "score"), *none("boolean", "is_anomaly"),
    )
    right = scores.select(
        lane, "ts", F.lit(False).alias("is_vote"), "us", "ord", *text("event_id", "src_ip"), *none("string", "dst_ip", "source"), *none("boolean", "label"), *none("double", "confidence", "weight"),
        *none("string", "event_type", "mitre_attack_id"), F.col("score").cast("double").alias("score"), "is_anomaly",
    )
    return left.unionByName(right)


def flush_votes(records: DataFrame, flush: int = FLUSH, ttl: int = TTL, idle: int = IDLE, kept: int = KEPT, dropped: int = DROPPED, least: float = LEAST, delay: str = "1 hour") -> DataFrame:
    """(kind, event_id, ...) from ``tagged`` records, in order of (us, ord) within a batch.

    A score is kept for its time; if at least ``flush`` votes wait in its lane, they are agreed on: a positive consensus of more than ``least`` is
    an "incident", with the score of its event where that is there; votes on an event without one are told as "late", with how many. A lane
    that is idle agrees on the rest. The session needs ``correlator.ROCKS`` as the provider of its state stores.
    """
    processor = VoteFlush(flush, ttl, idle, kept, dropped, least)
    return records.withWatermark("ts", delay).groupBy("lane").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime")
