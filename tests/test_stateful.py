"""Followers in event time against their machines fed with sorted rows, over several batches."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.shared import scratch
from tessera.streaming import stateful
from tessera.streaming.jobs import run_available

MACHINES = [
    stateful.Breaker(3, 90),
    stateful.Silence(60),
    stateful.Silence(60, 150),
    stateful.Interval(2.5),
    stateful.Lifetime(400),
]
RANGE = 60_000_000


def rows(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    out, base = [], 1_700_000_000_000_000
    for key in range(6):
        at = base
        for _ in range(rng.randrange(5, 60)):
            at += rng.choice([1_000_000, 2_400_000, 20_000_000, 95_000_000, 500_000_000])
            out.append((key, at, len(out), int(rng.random() < 0.6)))
    out.append((99, base + 20_000_000_000, len(out), 0))  # moves the watermark on
    rng.shuffle(out)
    return sorted(out, key=lambda r: r[1] + rng.randrange(20_000_000))  # out of order within the delay


@pytest.mark.parametrize("machine", MACHINES, ids=lambda m: type(m).__name__)
def test_stream_equals_the_sorted_twin(spark, machine):
    events = rows(7)
    path = scratch(spark, "events")
    schema = "user_id long, us long, event_id long, failed int"
    for i in range(4):  # four files, one batch each
        part = events[len(events) * i // 4 : len(events) * (i + 1) // 4]
        spark.createDataFrame(part, schema).select("*", F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    found = stateful.followed(stream, machine, "user_id", flag=F.col("failed"), delay="1 minute", range_us=RANGE)
    out = stateful.with_rocksdb(spark, lambda: run_available(found, scratch(spark, "followed")))
    got = sorted(map(tuple, out.collect()))
    passed = (max(r[1] for r in events) - 60_000_000) // RANGE * RANGE
    want = []
    for key in sorted({r[0] for r in events}):
        own = sorted((us, i, f) for k, us, i, f in events if k == key and us < passed)
        fresh = type(machine).__new__(type(machine))
        fresh.__dict__.update(machine.__dict__ | {f: 0 for f in machine.fields})
        want += [(key, *x) for x in stateful.follow(fresh, own, passed)]
    assert got == sorted(want) and len(got) > 5


class Handle:
    """What a follower asks of its handle, in memory; counts the questions."""

    def __init__(self):
        self.value, self.map, self.timers, self.asked = None, {}, set(), 0

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, *schemas):
        return self

    def registerTimer(self, ms):
        self.asked += 1
        self.timers.add(ms)

    def __getattr__(self, name):
        self.asked += 1
        own = {
            "exists": lambda: self.value is not None,
            "get": lambda: self.value,
            "update": lambda v: setattr(self, "value", v),
            "clear": lambda: setattr(self, "value", None),
            "containsKey": lambda k: k in self.map,
            "getValue": lambda k: self.map[k],
            "updateValue": lambda k, v: self.map.__setitem__(k, v),
            "removeKey": lambda k: self.map.pop(k),
            "keys": lambda: iter(list(self.map)),
            "getCurrentWatermarkInMs": lambda: self.watermark,
        }
        return own[name]


def test_a_key_asks_the_state_by_pages_and_not_by_ranges():
    import pandas as pd

    day = 86_400_000_000
    sparse = pd.DataFrame({"us": [i * day + 5 for i in range(200)], "id": range(200), "flag": 0})
    handle = Handle()
    follower = stateful.Follower(stateful.Silence(3_600), day, 64)
    follower.init(handle)
    assert list(follower.handleInputRows((1,), iter([sparse]), None)) == []
    out = []
    for watermark in (day * 90, day * 300):
        handle.watermark = watermark // 1_000
        while due := [t for t in handle.timers if t <= handle.watermark]:
            handle.timers.remove(min(due))
            out += [x for f in follower.handleExpiredTimer((1,), handle, None) for x in f.itertuples(index=False)]
        assert len(out) == min(200, watermark // day)
    assert handle.asked < 60 and not handle.map and handle.value is None
