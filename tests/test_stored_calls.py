"""Calls that are carried out come out the same however keys are dealt and the stream is cut."""

import datetime as dt
import random

import pytest
from test_stateful import T0, streamed

from quillstream.streaming.event_streams import finished, stored_calls


@pytest.mark.parametrize("files, buckets", [(1, 1), (9, 3)])
def test_keys_of_one_bucket_are_apart(spark, tmp_path, files, buckets):
    r = random.Random(3)
    rows = [(i, T0 + dt.timedelta(minutes=7 * i + r.randint(0, 5)), r.choice([1, 2, None]), r.choice(["a", "b", None])) for i in range(180)]
    stored, want = {}, set()
    for i, ts, user, tool in rows:
        if (user, tool) not in stored or ts - stored[user, tool] > dt.timedelta(hours=1):
            stored[user, tool] = ts
            want.add(i)
    s = streamed(spark, tmp_path, rows, "event_id long, ts timestamp, user long, tool string", files)
    got = [x["event_id"] for x in finished(stored_calls(s, ["user", "tool"], 3600, buckets), "calls").collect()]
    assert len(got) == len(want) and set(got) == want
