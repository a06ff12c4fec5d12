"""A bounded sink: records go out in batches by count or by time, and what exceeds the bound is counted.

Records of one lane are taken in order of time and id. The first one opens a window of some length.
Within it, every `size` records make a batch, and what is left makes one when the window ends; after
`capacity` records, further ones are dropped and counted. The next record opens the next window. The
rule goes by the records' own times, so neither micro-batches nor restarts change a row. Lanes are
what is spread over tasks: give a busy source several.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OUT = "lane string, opened timestamp, batch int, n long, first_id long, last_id long, total long, dropped long"
STATE = "opened long, taken long, dropped long, n long, first_id long, last_id long, total long"
RECORD = "at long, id long, value long"


@dataclass(frozen=True)
class Bounds:
    """Records of a batch, microseconds of a window, records of a window."""

    size: int = 256
    length: int = 500_000
    capacity: int = 4096


class Window:
    """A lane's open window; its fields are all that a lane keeps of records that have gone through."""

    def __init__(self, bounds: Bounds, lane: str, state: tuple | None = None):
        self.bounds, self.lane = bounds, lane
        self.opened, self.taken, self.dropped, self.n, self.first, self.last, self.total = state or (None, 0, 0, 0, 0, 0, 0)

    def state(self) -> tuple:
        return self.opened, self.taken, self.dropped, self.n, self.first, self.last, self.total

    def _row(self, batch: int | None, n: int, first: int | None, last: int | None, total: int, dropped: int) -> tuple:
        return self.lane, pd.Timestamp(self.opened, unit="us", tz="UTC"), batch, n, first, last, total, dropped

    def _flush(self) -> Iterator[tuple]:
        if self.n:
            yield self._row((self.taken - 1) // self.bounds.size, self.n, self.first, self.last, self.total, 0)
        self.n = self.total = 0

    def pass_time(self, now: int) -> Iterator[tuple]:
        """What goes out once all records before now are in."""
        if self.opened is not None and self.opened + self.bounds.length <= now:
            yield from self._flush()
            if self.dropped:
                yield self._row(None, 0, None, None, 0, self.dropped)
            self.opened, self.taken, self.dropped = None, 0, 0

    def take(self, at: int, id_: int, value: int) -> Iterator[tuple]:
        yield from self.pass_time(at)
        if self.opened is None:
            self.opened = at
        if self.taken == self.bounds.capacity:
            self.dropped += 1
            return
        if not self.n:
            self.first = id_
        self.taken, self.n, self.last, self.total = self.taken + 1, self.n + 1, id_, self.total + value
        if self.n == self.bounds.size:
            yield from self._flush()


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
    return df.astype({"batch": "Int32", "first_id": "Int64", "last_id": "Int64", "opened": "datetime64[us, UTC]"})


class Batching(StatefulProcessor):
    """Keeps a lane's records until the watermark has passed them, then takes them in order."""

    def __init__(self, bounds: Bounds):
        self.bounds = bounds

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting, self.window = handle.getListState("waiting", RECORD), handle.getValueState("window", STATE)

    def handleInputRows(self, key, rows, timerValues):
        records = [tuple(map(int, r)) for pdf in rows for r in pdf[["at", "id", "value"]].itertuples(index=False)]
        if records:
            self.waiting.appendList(records)
            self._wake(min(r[0] for r in records) // 1000 + 1)
        yield _frame([])

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = 1000 * timerValues.getCurrentWatermarkInMs()
        window = Window(self.bounds, key[0], tuple(self.window.get()) if self.window.exists() else None)
        records = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        out = [row for r in records if r[0] < now for row in window.take(*r)]
        out += window.pass_time(now)
        later = [r for r in records if r[0] >= now]
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self._wake(later[0][0] // 1000 + 1)
        if window.opened is None:
            self.window.clear()
        else:
            self.window.update(window.state())
            self._wake((window.opened + self.bounds.length) // 1000 + 1)
        yield _frame(out)

    def close(self) -> None:
        pass


def _records(stats: DataFrame) -> DataFrame:
    return stats.select("lane", "ts", F.unix_micros("ts").alias("at"), F.col("id").cast("long"), F.col("value").cast("long"))


def batched_stream(stats: DataFrame, bounds: Bounds = Bounds(), lateness: str = "1 minute") -> DataFrame:
    """Batches of a stream (lane string, ts timestamp, id, value); later rows than the watermark are dropped by Spark.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = _records(stats.withWatermark("ts", lateness))
    return rows.groupBy("lane").transformWithStateInPandas(Batching(bounds), OUT, "Append", "EventTime")


def batched(stats: DataFrame, bounds: Bounds = Bounds(), until: str | None = None) -> DataFrame:
    """The same batches of a table; with until (a timestamp) only what has gone out by then.

    Lanes are sorted and streamed through their tasks, which keep one open window.
    """
    limit = None if until is None else int(pd.Timestamp(until).value // 1000)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window = None
        for pdf in parts:
            out = []
            for lane, at, id_, value in pdf.itertuples(index=False):
                if window is None or window.lane != lane:
                    out += window.pass_time(2**62 if limit is None else limit) if window else []
                    window = Window(bounds, lane)
                if limit is None or at < limit:
                    out += window.take(at, id_, value)
            yield _frame(out)
        if window:
            yield _frame(list(window.pass_time(2**62 if limit is None else limit)))

    rows = _records(stats).drop("ts").where("lane IS NOT NULL")
    return rows.repartition("lane").sortWithinPartitions("lane", "at", "id", "value").mapInPandas(run, OUT)
