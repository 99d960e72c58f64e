"""Streams with state: the same rows come out however the stream is cut into batches."""

import datetime as dt
from collections import Counter

import pytest

from quillstream.streaming import stateful
from quillstream.streaming.event_streams import finished

T0 = dt.datetime(2024, 1, 1, 8, 0)


def streamed(spark, tmp_path, rows, schema, files):
    """Rows in order of time as a stream of so many files, a batch each."""
    step = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    whole = spark.read.parquet(str(tmp_path / "in")).schema
    return spark.readStream.schema(whole).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")


def at(hours):
    return T0 + dt.timedelta(hours=hours)


TOUCH = "event_id long, ts timestamp, user_id long, product long, kind string"
EVENTS = [
    (1, at(0), 1, 5, "touch"), (2, at(1), 1, 6, "touch"), (3, at(2), 1, 5, "purchase"), (4, at(2), 2, 5, "purchase"), (5, at(3), 1, 7, "purchase"),
    (6, at(25), 1, 5, "touch"), (7, at(26), 1, 5, "purchase"), (8, at(26), 1, 6, "purchase"), (9, at(24 * 7), 1, 6, "purchase"),
    (10, at(24 * 8 + 0.5), 1, 6, "purchase"), (11, at(24 * 12), 3, 1, "touch"),
]


@pytest.mark.parametrize("files", [1, 3, 11])
def test_each_purchase_comes_out_once_with_its_nearest_touch(spark, tmp_path, files):
    s = streamed(spark, tmp_path, EVENTS, TOUCH, files)
    with stateful.rocks_state(spark):
        got = finished(stateful.nearest_touches(s), "t")
    # The first day of user 1 begins at 8:00 with trace 1, the second at 9:00 with trace 6.
    assert {r["event_id"]: r["trace_id"] for r in got.collect()} == {3: 1, 4: None, 5: None, 7: 6, 8: 1, 9: 1, 10: None}
    assert got.count() == 7


CALLS = "event_id long, ts timestamp, router long, task long, asks boolean"


def brute(rows, timeout, cap, on_full, end):
    """One router after the other, row by row."""
    out = []
    for router in {r[2] for r in rows}:
        waiting = {}
        mine = [r for r in rows if r[2] == router and r[1] <= end]
        for event_id, ts, _, task, asks in [*mine, (None, end, router, None, None)]:
            for t in [t for t, (since, _) in waiting.items() if since + timeout < ts]:
                out.append((router, t, waiting.pop(t)[1], None, "timeout"))
            if event_id is None:
                continue
            if not asks:
                e = waiting.pop(task, (None, None))[1]
                out.append((router, task, e, event_id, "delivered" if e is not None else "unknown"))
                continue
            if task in waiting:
                out.append((router, task, waiting.pop(task)[1], None, "replaced"))
            if len(waiting) >= cap and on_full == "reject":
                out.append((router, task, event_id, None, "rejected"))
                continue
            if len(waiting) >= cap:
                oldest = min(waiting, key=lambda t: waiting[t])
                out.append((router, oldest, waiting.pop(oldest)[1], None, "evicted"))
            waiting[task] = (ts, event_id)
    return Counter(out)


@pytest.mark.parametrize("on_full", ["evict", "reject"])
@pytest.mark.parametrize("files", [1, 7])
def test_rendezvous(spark, tmp_path, on_full, files):
    import random

    r = random.Random(4)
    rows = [(i, T0 + dt.timedelta(minutes=7 * i + r.randint(0, 5)), r.randint(0, 1), r.randint(0, 6), r.random() < 0.6) for i in range(200)]
    s = streamed(spark, tmp_path, rows, CALLS, files)
    with stateful.rocks_state(spark):
        got = finished(stateful.rendezvous(s, timeout_seconds=3600, cap=3, on_full=on_full), "r").collect()
    want = brute(rows, dt.timedelta(hours=1), 3, on_full, max(x[1] for x in rows) - dt.timedelta(hours=1))
    assert Counter((x["router"], x["task"], x["event_id"], x["callback"], x["status"]) for x in got) == want
    assert {x["status"] for x in got} >= {"delivered", "timeout", "unknown", "replaced", "evicted" if on_full == "evict" else "rejected"}


def test_unknown_limits_are_an_error():
    with pytest.raises(ValueError):
        stateful.Rendezvous(on_full="forget")
