"""Alerts as they come: for each, the group of its source's window and the pattern of its session so far; idle sessions close by timers.

State is keyed by source and kept in lists, to which a batch appends; a batch reads them once. Event-time timers close a session that has
been idle for the gap and, if it shows a pattern, emit its group, so nothing waits for a next alert of the source.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flowlens.operators.correlate import GAP, HISTORY, WINDOW

#: The state store that lists and timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GROUPS = "alert_id long, us long, src_ip long, reason string, pattern string, alert_ids array<long>"
_ALERT = "alert_id long, us long, event_type string, known boolean"
_COLUMNS = ["alert_id", "us", "event_type", "known"]
#: Kinds that a pattern needs, and the kinds of its alerts in the order in which they are listed.
_KINDS = {
    "c2_beaconing": (("c2_beaconing",), (("c2_beaconing",), ("dns_tunneling", "anomaly"))),
    "lateral_movement": (("scan", "lateral_movement"), (("scan",), ("lateral_movement",))),
    "dns_tunneling": (("dns_tunneling",), (("dns_tunneling",),)),
}


class Progress:
    """The pattern of a session, kept up as its alerts come in order of time; an alert that comes late makes it read the session again."""

    def __init__(self, alerts: list[tuple]):
        self.alerts: list[tuple] = []
        self.places: dict[str, list[int]] = {}
        for alert in sorted(alerts, key=lambda a: a[1]):
            self.add(alert)

    def add(self, alert: tuple) -> None:
        if self.alerts and alert[1] < self.alerts[-1][1]:
            self.__init__([*self.alerts, alert])
            return
        place = len(self.alerts)
        self.alerts.append(alert)
        self.places.setdefault(alert[2], []).append(place)

    def pattern(self) -> tuple[str, list[tuple]] | None:
        """(name, alerts) of the first pattern in priority that at least two alerts show."""
        if len(self.alerts) < 2:
            return None
        there = self.places
        if "scan" in there and "exfiltration" in there and there["scan"][0] < there["exfiltration"][0]:
            return "scan_to_exfiltration", self.alerts[there["scan"][0] : there["exfiltration"][0] + 1]
        for name, (needed, parts) in _KINDS.items():
            if all(kind in there for kind in needed):
                return name, [self.alerts[k] for kinds in parts for k in sorted(k for kind in kinds for k in there.get(kind, []))]
        return None


class Correlator(StatefulProcessor):
    """See ``correlate_alerts``."""

    def __init__(self, window: int, gap: int, least: int, history: int):
        self.window, self.gap, self.least, self.history = window, gap, least, history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", _ALERT)
        self.session = handle.getListState("session", _ALERT)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        recent = deque(self._read(self.recent), self.history)
        old = self._read(self.session)
        progress, kept = Progress(old), len(old)
        newest = max((a[1] for a in old), default=None)
        fresh: list[tuple] = []  # what the session has got in this batch
        out: list[tuple] = []
        came = pd.concat(list(rows)).sort_values(["us", "alert_id"], kind="stable")
        for alert in zip(*(came[c].tolist() for c in _COLUMNS)):
            at = alert[1]
            if newest is not None and at - newest > self.gap:
                out += self._closed(key[0], progress, newest)
                progress, fresh, kept, newest = Progress([]), [], 0, None
            recent.append(alert)
            while recent[0][1] < at - self.window:
                recent.popleft()
            progress.add(alert)
            fresh.append(alert)
            newest = at if newest is None else max(newest, at)
            groups = [("shared_source_proximity", None, list(recent))] if len(recent) >= self.least else []
            shown = progress.pattern()
            if shown:
                groups.append((f"attack_pattern_{shown[0]}", *shown))
            seen = set()
            for reason, pattern, members in groups:
                ids = tuple(sorted({a[0] for a in members}))
                if ids not in seen and not any(a[3] for a in members):
                    seen.add(ids)
                    out.append((alert[0], at, key[0], reason, pattern, [a[0] for a in members]))
        self.recent.put(list(recent))
        if kept:
            self.session.appendList(fresh)
        else:
            self.session.put(fresh)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((newest + self.gap) // 1000 + 1)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        alerts = self._read(self.session)
        self.session.clear()
        self.recent.clear()
        yield self._frame(self._closed(key[0], Progress(alerts), max((a[1] for a in alerts), default=0)))

    def close(self) -> None:
        pass

    def _closed(self, source: int, progress: Progress, newest: int) -> list[tuple]:
        """The group of a session that has ended: no alert brings it, so its id is null and its time that of the last alert."""
        shown = progress.pattern() if len(progress.alerts) >= self.least else None
        return [(None, newest, source, f"session_expired_pattern_{shown[0]}", shown[0], [a[0] for a in shown[1]])] if shown else []

    @staticmethod
    def _read(state) -> list[tuple]:
        return [tuple(a) for a in state.get()]

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[part.split()[0] for part in GROUPS.split(", ")], dtype=object)


def correlate_alerts(stream: DataFrame, window: int = WINDOW, gap: int = GAP, least: int = 2, history: int = HISTORY, delay: str = "1 hour") -> DataFrame:
    """A row per group: (alert_id, us, src_ip, reason, pattern, alert_ids).

    stream: alert_id, us, ts, src_ip, event_type, and ``known``, whether the alert is a known false positive. Each alert brings the last
    ``history`` alerts of its source from ``window`` before it on, if there are at least ``least``, and the pattern of its session so far; a
    group that holds a known false positive goes, and one with the same alerts as the other. A session ends after ``gap`` without an alert: if it
    shows a pattern, a row without alert_id says so, once, whether an alert or the watermark ends it.
    The session needs ``spark.sql.streaming.stateStore.providerClass`` to be ``ROCKS``.
    """
    rows = stream.withWatermark("ts", delay).select("src_ip", "ts", "alert_id", "us", "event_type", F.coalesce("known", F.lit(False)).alias("known"))
    return rows.groupBy("src_ip").transformWithStateInPandas(statefulProcessor=Correlator(window, gap, least, history), outputStructType=GROUPS, outputMode="Append", timeMode="EventTime")
