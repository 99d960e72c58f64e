"""Purchases with their nearest touches come out the same however users are dealt and the stream is cut."""

import datetime as dt
import random

import pytest
from test_stateful import T0, TOUCH, streamed

from quillstream.streaming import stateful
from quillstream.streaming.event_streams import finished


def brute(rows):
    days, want = {}, {}
    for i, ts, user, product, kind in rows:
        if kind == "touch":
            first, trace, products = days.get((user, ts.date()), (ts, i, set()))
            days[user, ts.date()] = (min(first, ts), min(trace, i), products | {product})
    end = max(r[1] for r in rows) - dt.timedelta(hours=1)
    for i, ts, user, product, kind in rows:
        if kind == "purchase" and dt.datetime.combine(ts.date() + dt.timedelta(days=1), dt.time()) <= end:
            near = [(first, -trace) for (u, _), (first, trace, ps) in days.items() if u == user and None not in (u, product) and product in ps and first <= ts <= first + dt.timedelta(days=7)]
            want[i] = -max(near)[1] if near else None
    return want


@pytest.mark.parametrize("files, buckets", [(1, 1), (9, 2), (4, 50)])
def test_users_of_one_bucket_are_apart(spark, tmp_path, files, buckets):
    r = random.Random(6)
    rows = [(i, T0 + dt.timedelta(hours=2 * i, minutes=r.randint(0, 50)), r.choice([1, 2, 3, None]), r.choice([0, 1, 2, 3, 4, 5, None]), r.choice(["touch", "purchase"])) for i in range(300)]
    # The watermark comes to stand at the very end of a day.
    rows = [x for x in rows if x[1] < T0 + dt.timedelta(days=20)] + [(999, dt.datetime(2024, 1, 22, 1), 9, 0, "touch")]
    s = streamed(spark, tmp_path, rows, TOUCH, files)
    got = finished(stateful.nearest_touches(s, buckets=buckets), "near").collect()
    want = brute(rows)
    assert len(got) == len(want) and {x["event_id"]: x["trace_id"] for x in got} == want
    assert None in want.values() and len(want) > 100
