"""A stream over a source that is read by time: the offset is how far time has been read, and a batch is read by ranges of time in parallel.

The offset is in the query's checkpoint, so a batch that runs again asks for the same ranges, and a query that starts again goes on where the last
committed batch ended: nothing is lost and nothing is read twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

MINUTE = 60_000_000


@dataclass
class TimeRange(InputPartition):
    """The times [start_us, end_us)."""

    start_us: int
    end_us: int


def retried(call: Callable, options: dict[str, str]):
    """``call()``, again after a growing while where it fails with an OSError, up to ``retries`` times (3)."""
    most = int(options.get("retries", "3"))
    for attempt in range(most + 1):
        try:
            return call()
        except OSError:
            if attempt == most:
                raise
            time.sleep(float(options.get("backoff", "0.1")) * 2**attempt)


class CursorSource(DataSource):
    """A subclass names itself and gives ``newest(options)``, the end of what can be read (exclusive, microseconds), and
    ``fetch(start_us, end_us, cursor, options)``, a page of rows of that time with the next cursor, or None after the last page.

    Options: schema; start_us, where the first run begins (0); range_us, the width of a partition (an hour); most_ranges, how many of them a batch has
    at most (64).
    """

    newest: Callable | None = None
    fetch: Callable | None = None

    @classmethod
    def name(cls) -> str:
        return "cursor"

    def schema(self) -> str:
        return self.options["schema"]

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _CursorReader(type(self).newest, type(self).fetch, dict(self.options))


class _CursorReader(DataSourceStreamReader):
    def __init__(self, newest: Callable, fetch: Callable, options: dict[str, str]):
        self.newest, self.fetch, self.options = newest, fetch, options
        self.width = int(options.get("range_us", str(60 * MINUTE)))
        self.reached: int | None = None  # where the batch before ended, once this reader has seen one

    def initialOffset(self) -> dict:  # noqa: N802
        return {"us": int(self.options.get("start_us", "0"))}

    def latestOffset(self) -> dict:  # noqa: N802
        end = int(retried(lambda: self.newest(self.options), self.options))
        begin = self.reached if self.reached is not None else self.initialOffset()["us"]
        return {"us": max(begin, end)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Ranges of equal width, more than that wide only where the batch would have more of them than it may."""
        self.reached = end["us"]
        span = end["us"] - start["us"]
        number = min(int(self.options.get("most_ranges", "64")), -(-span // self.width))
        cuts = [start["us"] + span * k // number for k in range(number + 1)] if number else []
        return [TimeRange(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: TimeRange) -> Iterator[tuple]:
        cursor = None
        while True:
            rows, cursor = retried(lambda: self.fetch(partition.start_us, partition.end_us, cursor, self.options), self.options)
            yield from (tuple(r) for r in rows)
            if cursor is None:
                return

    def commit(self, end: dict) -> None:
        self.reached = end["us"]
