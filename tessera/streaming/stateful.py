"""Stateful jobs that follow each key in event time: breakers, silences, intervals, lifetimes.

Rows of a key may arrive in any order, within the watermark's delay. They wait in the state
until the watermark has passed their range of time. They are packed there by pages of some ranges, and one
timer a key, at the end of its earliest range that waits, reads all that the watermark has passed,
page after page in order; no task holds more of a key than a page. So a key asks the state a few
times per page and batch, and not per range: where a key's rows lie far apart, a range holds a row
or two. A follower is a small machine: it is fed one row at a time and names the moment at which
it has something to say if nothing comes (`due`). That moment is a timer too, so a stream that has
fallen silent is reported by the watermark alone. A key whose machine is at rest and whose rows are
read leaves the state.

The state store has to be RocksDB's (`rocksdb`), which keeps timers beside values.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_US = 3_600_000_000
ROW = np.dtype([("us", "<i8"), ("id", "<i8"), ("flag", "<i8")])

Said = tuple[str, int, int]


class Breaker:
    """`opened` at the failure that makes `least` in a row, or at a later one while closed;
    `closed` at a success, or `cooldown` after the last failure, which further failures put off."""

    fields = ("run", "until")

    def __init__(self, least: int = 3, cooldown_s: int = 90):
        self.least, self.cooldown = least, cooldown_s * 1_000_000
        self.run = self.until = 0

    def due(self) -> int | None:
        return self.until or None

    def expire(self) -> Iterator[Said]:
        yield "closed", self.until, 0
        self.until = 0

    def feed(self, us: int, row_id: int, failed: int) -> Iterator[Said]:
        if failed:
            self.run += 1
            if self.run >= self.least:
                if not self.until:
                    yield "opened", us, row_id
                self.until = us + self.cooldown
        else:
            if self.until:
                yield "closed", us, row_id
            self.run = self.until = 0


class Silence:
    """`idle` where nothing came for idle_s, `total` where a run of rows goes on for total_s;
    either ends the run, and the next row begins another."""

    fields = ("first", "last")

    def __init__(self, idle_s: float, total_s: float | None = None):
        self.idle, self.total = int(idle_s * 1_000_000), total_s and int(total_s * 1_000_000)
        self.first = self.last = 0

    def due(self) -> int | None:
        if not self.last:
            return None
        return min(self.last + self.idle, self.first + self.total) if self.total else self.last + self.idle

    def expire(self) -> Iterator[Said]:
        at = self.due()
        yield ("idle" if at == self.last + self.idle else "total"), at, 0
        self.first = self.last = 0

    def feed(self, us: int, row_id: int, flag: int) -> Iterator[Said]:
        self.first, self.last = self.first or us, us
        yield from ()


class Interval:
    """`early` at a row that comes less than least_s after the one before it."""

    fields = ("last",)

    def __init__(self, least_s: float):
        self.least, self.last = int(least_s * 1_000_000), 0

    def due(self) -> int | None:
        return self.last + self.least if self.last else None

    def expire(self) -> Iterator[Said]:
        self.last = 0
        yield from ()

    def feed(self, us: int, row_id: int, flag: int) -> Iterator[Said]:
        if self.last:
            yield "early", us, row_id
        self.last = us


class Lifetime:
    """A value that is made when it is asked for and absent, and lives for ttl_s: `made` and `expired`."""

    fields = ("made",)

    def __init__(self, ttl_s: float = 7 * 86_400):
        self.ttl, self.made = int(ttl_s * 1_000_000), 0

    def due(self) -> int | None:
        return self.made + self.ttl if self.made else None

    def expire(self) -> Iterator[Said]:
        yield "expired", self.made + self.ttl, 0
        self.made = 0

    def feed(self, us: int, row_id: int, flag: int) -> Iterator[Said]:
        if not self.made:
            self.made = us
            yield "made", us, row_id


def follow(machine, rows: Iterable[tuple[int, int, int]], until: int) -> Iterator[Said]:
    """What the machine says of rows (us, id, flag) in order, and of the silence before `until`."""
    for us, row_id, flag in rows:
        while (due := machine.due()) is not None and due <= us:
            yield from machine.expire()
        yield from machine.feed(us, row_id, flag)
    while (due := machine.due()) is not None and due < until:
        yield from machine.expire()


class Follower(StatefulProcessor):
    """Feeds a copy of the machine per key, page after page of what the watermark has passed."""

    def __init__(self, machine, range_us: int, ranges: int = 1):
        self.machine, self.range_us, self.page_us = machine, range_us, range_us * ranges
        self.rest = tuple(getattr(machine, f) for f in machine.fields)
        self.packed = f"<{len(machine.fields)}q"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "data binary")
        self.rows = handle.getMapState("rows", "page long", "data binary")

    def _timer(self, us: int) -> None:
        """A timer at the end of the range of a moment."""
        self.handle.registerTimer(-(-(us // self.range_us + 1) * self.range_us // 1_000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            found = np.zeros(len(frame), ROW)
            for name in ROW.names:
                found[name] = frame[name].to_numpy()
            pages = found["us"] // self.page_us
            for number in np.unique(pages).tolist():
                known = self.rows.getValue((number,))[0] if self.rows.containsKey((number,)) else b""
                self.rows.updateValue((number,), (known + found[pages == number].tobytes(),))
            first = int(found["us"].min()) if first is None else min(first, int(found["us"].min()))
        if first is not None:
            self._timer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1_000 // self.range_us * self.range_us
        held = self.state.exists()
        before = struct.unpack(self.packed, self.state.get()[0]) if held else self.rest
        for field, value in zip(self.machine.fields, before):
            setattr(self.machine, field, value)
        waiting = None
        for page in sorted(k[0] for k in self.rows.keys()):
            if page * self.page_us >= until:
                waiting = page
                break
            rows = np.sort(np.frombuffer(self.rows.getValue((page,))[0], ROW), order=["us", "id"])
            n = int(np.searchsorted(rows["us"], until))
            yield from self._said(key, rows[:n].tolist(), min(until, (page + 1) * self.page_us))
            if n < len(rows):
                self.rows.updateValue((page,), (rows[n:].tobytes(),))
                self._timer(int(rows["us"][n]))
            else:
                self.rows.removeKey((page,))
        yield from self._said(key, (), until)
        if waiting is not None:
            rows = np.frombuffer(self.rows.getValue((waiting,))[0], ROW)
            self._timer(int(rows["us"].min()))
        if (due := self.machine.due()) is not None:
            self._timer(due)
        values = tuple(getattr(self.machine, f) for f in self.machine.fields)
        if values == self.rest:
            if held:
                self.state.clear()
        elif values != before:
            self.state.update((struct.pack(self.packed, *values),))

    def _said(self, key, rows: Iterable[tuple[int, int, int]], until: int) -> Iterator[pd.DataFrame]:
        said = list(follow(self.machine, rows, until))
        if said:
            events, at, ids = zip(*said)
            yield pd.DataFrame({"key": [key[0]] * len(said), "event": events, "at_us": at, "row_id": ids})

    def close(self) -> None:
        pass


def followed(stream: DataFrame, machine, key: str, row_id: str = "event_id", flag=None, ts: str = "ts", delay: str = "1 hour", range_us: int = HOUR_US, ranges: int = 1) -> DataFrame:
    """key, event, at_us, row_id: what the machine says of each key of a streaming DataFrame.

    flag is a column the machine is told with each row; row_id is 0 where no row speaks. Rows
    without key or time go; rows of one time come in the order of their ids. A page of the state
    holds so many `ranges`: one for keys of many rows each, more for keys whose rows lie far apart.
    """
    flag = F.lit(0) if flag is None else flag
    timed = stream.withWatermark(ts, delay).filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    rows = timed.select(F.col(key).alias("key"), F.col(ts), F.unix_micros(ts).alias("us"), F.col(row_id).cast("long").alias("id"), flag.cast("long").alias("flag"))
    kind = stream.schema[key].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(Follower(machine, range_us, ranges), f"key {kind}, event string, at_us long, row_id long", "append", "EventTime")


def with_rocksdb(spark: SparkSession, run):
    """run() while the session's state stores are RocksDB's; its own setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        return run()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
