"""Streams with state of their own and timers: the nearest touch of each purchase, and tasks
that wait for callbacks.

Rows are buffered until the watermark has passed them and then taken in order of event time,
so results don't depend on how the stream was cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillstream.plans.registry import query
from quillstream.sources.tables import E_SQL, P_SQL
from quillstream.streaming.event_streams import BUCKETS, finished, stream_events

DAY_US = 86_400_000_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession):
    """State with several variables and timers needs this store."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: The state of a bucket: what its users were shown by day, and the purchases that wait.
SHOWN, BOUGHT = ["user_id", "day", "product", "first", "trace"], ["event_id", "user_id", "product", "at"]


def shown_by_day(shown: pd.DataFrame) -> pd.DataFrame:
    """A row for each product of a user's day, with the first moment and trace of that day."""
    whole = shown.groupby(["user_id", "day"])
    shown = shown.assign(first=whole["first"].transform("min"), trace=whole["trace"].transform("min"))
    return shown.drop_duplicates(["user_id", "day", "product"])


def nearest_of(bought: pd.DataFrame, shown: pd.DataFrame, days: int) -> pd.DataFrame:
    """Purchases with the last day of touches that shows the product and begins at most ``days``
    before; there is none where trace_id is missing, as it is without a user or a product."""
    known = bought["user_id"].notna() & bought["product"].notna()
    shown = shown.assign(touched=shown["first"]).sort_values("first", kind="stable")
    near = pd.merge_asof(
        bought[known].astype("int64").sort_values("at", kind="stable"), shown, left_on="at", right_on="first", by=["user_id", "product"], tolerance=days * DAY_US
    )
    near = pd.concat([df.astype("Int64") for df in (near, bought[~known])]).rename(columns={"at": "bought", "trace": "trace_id"})
    return near[["event_id", "user_id", "product", "trace_id", "touched", "bought"]]


def nearest_touches(stream: DataFrame, days: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """(event_id, user_id, product, trace_id, touched, bought) for each purchase of a stream with
    a watermark (event_id, ts, user_id, product, kind: touch or purchase); times in microseconds.

    A day of touches counts from its first moment and trace.  As products that are shown later
    in a day count from there too, purchases wait for the end of their day, when a timeout puts
    each out once, with its touch if it has one.  Days that no purchase can reach any more
    are dropped then.  A user's rows are few, so a state holds all users of a bucket.
    """

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs() * 1000
        held = state.get if state.exists else [[]] * (len(SHOWN) + len(BOUGHT))
        shown = pd.DataFrame(dict(zip(SHOWN, held[: len(SHOWN)], strict=True)), dtype="int64")
        bought = pd.DataFrame(dict(zip(BOUGHT, held[len(SHOWN) :], strict=True)), dtype="Int64")
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            us = rows["ts"].astype("datetime64[us]").astype("int64")
            rows = rows.assign(at=us, first=us, day=us // DAY_US, trace=rows["event_id"])
            is_touch = (rows["kind"] == "touch") & rows["user_id"].notna() & rows["product"].notna()
            shown = shown_by_day(pd.concat([shown, rows.loc[is_touch, SHOWN].astype("int64")]))
            bought = pd.concat([bought, rows.loc[rows["kind"] == "purchase", BOUGHT].astype("Int64")])
        ends = (bought["at"] // DAY_US + 1) * DAY_US
        due = bought[ends <= watermark]
        if len(due):
            yield nearest_of(due, shown, days)
        bought = bought[ends > watermark]
        # A purchase that waits, or that may still come, is not before this moment.
        since = int(bought["at"].min()) if len(bought) else watermark
        last = (shown["day"] + 1 + days) * DAY_US
        kept = last >= min(since, watermark)
        shown, last = shown[kept], last[kept]
        if len(bought) or len(shown):
            waiting = bought.astype(object).where(bought.notna(), None)
            state.update(tuple(df[c].tolist() for df, names in ((shown, SHOWN), (waiting, BOUGHT)) for c in names))
            # A timeout comes when the watermark is beyond it.
            wake = int(ends[ends > watermark].min()) - 1000 if len(bought) else int(last.min())
            state.setTimeoutTimestamp(max(wake, watermark) // 1000)
        elif state.exists:
            state.remove()

    dealt = stream.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))
    schema = "event_id long, user_id long, product long, trace_id long, touched long, bought long"
    state = ", ".join(f"{c} array<bigint>" for c in [*(f"shown_{c}" for c in SHOWN), *(f"bought_{c}" for c in BOUGHT)])
    return dealt.groupBy("bucket").applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.EventTimeTimeout)


def _cut(*kinds: str) -> str:
    """The watermark at the end of a stream of these events."""
    return f"(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM e WHERE event_type IN {kinds})"


@query("stream_nearest_touch", f"""WITH {P_SQL} SELECT p.event_id, p.user_id, p.product, coalesce(lt.trace_id, -1) AS trace_id, coalesce(round(lt.hours, 6), -1) AS hours FROM p LEFT JOIN lt USING (event_id)
WHERE date_trunc('day', p.bought) + INTERVAL 1 DAY <= {_cut('view', 'click', 'purchase')}""")  # fmt: skip
def stream_nearest_touch(spark, d):
    """Every purchase whose day the watermark has passed, once, with its last touch or none."""
    e = stream_events(spark, d).where(F.col("event_type").isin("view", "click", "purchase"))
    kind = F.when(F.col("event_type") == "purchase", "purchase").otherwise("touch")
    s = e.select("event_id", "ts", "user_id", (F.col("k") % 10).alias("product"), kind.alias("kind")).withWatermark("ts", "1 hour")
    with rocks_state(spark):
        done = finished(nearest_touches(s), "nearest-touch")
    hours = F.round((F.col("bought") - F.col("touched")) / 3600000000.0, 6)
    return done.select("event_id", "user_id", "product", "trace_id", hours.alias("hours")).fillna(-1)


class Rendezvous(StatefulProcessor):
    """Tasks of one router that wait for their callbacks.

    At most ``cap`` wait; one more makes the oldest go (``on_full`` = "evict") or is turned
    away itself ("reject").  A task that is registered again takes its former's place.  A
    callback for a task that does not wait, any more or at all, is unknown.
    """

    def __init__(self, timeout_seconds: float = 120, cap: int = 500, on_full: str = "evict"):
        if on_full not in ("evict", "reject"):
            raise ValueError(f"on_full must be evict or reject, not {on_full}")
        self.timeout, self.cap, self.on_full = int(timeout_seconds * 1_000_000), cap, on_full

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.coming = handle.getListState("coming", "at long, event_id long, task long, asks boolean")
        self.waiting = handle.getListState("waiting", "at long, event_id long, task long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            us = batch["ts"].astype("datetime64[us]").astype("int64")
            self.coming.appendList([(int(a), int(e), int(t), bool(x)) for a, e, t, x in zip(us, batch["event_id"], batch["task"], batch["asks"], strict=True)])
            self._wake(int(us.min()))
        return iter(())

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.coming.get())
        due, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        waiting = {r[2]: (r[0], r[1]) for r in self.waiting.get()}  # by age
        out: list[tuple] = []

        def close(task: int, status: str, at: int, callback: int | None = None) -> None:
            since, event_id = waiting.pop(task)
            out.append((key[0], task, event_id, callback, status, at - since))

        def expire(at: int) -> None:
            for task in [t for t, (since, _) in waiting.items() if since + self.timeout < at]:
                close(task, "timeout", waiting[task][0] + self.timeout)

        for at, event_id, task, asks in due:
            expire(at)
            if not asks:
                if task in waiting:
                    close(task, "delivered", at, event_id)
                else:
                    out.append((key[0], task, None, event_id, "unknown", None))
                continue
            if task in waiting:
                close(task, "replaced", at)
            if len(waiting) >= self.cap:
                if self.on_full == "reject":
                    out.append((key[0], task, event_id, None, "rejected", 0))
                    continue
                close(next(iter(waiting)), "evicted", at)
            waiting[task] = (at, event_id)
        expire(now)
        for state, kept in ((self.coming, later), (self.waiting, [(since, e, t) for t, (since, e) in waiting.items()])):
            state.put(kept) if kept else state.clear()
        wakes = [r[0] for r in later[:1]] + [since + self.timeout for since, _ in list(waiting.values())[:1]]
        if wakes:
            self._wake(max(min(wakes), now))
        if out:
            frame = pd.DataFrame(out, columns=["router", "task", "event_id", "callback", "status", "waited"])
            yield frame.astype({c: "Int64" for c in ("event_id", "callback", "waited")})

    def close(self) -> None:
        pass


def rendezvous(stream: DataFrame, timeout_seconds: float = 120, cap: int = 500, on_full: str = "evict") -> DataFrame:
    """(router, task, event_id, callback, status, waited in microseconds) of a stream with a
    watermark (event_id, ts, router, task, asks: a task waits, or a callback comes)."""
    schema = "router long, task long, event_id long, callback long, status string, waited long"
    return stream.groupBy("router").transformWithStateInPandas(Rendezvous(timeout_seconds, cap, on_full), schema, "Append", "EventTime")


def _rendezvous_sql(seconds: int, cap: int, on_full: str) -> str:
    """The same as a walk over each router's rows in order, with the waiting tasks as a list."""
    item = "STRUCT(task BIGINT, id BIGINT, since BIGINT)"
    shut = "STRUCT(task BIGINT, event_id BIGINT, callback BIGINT, status VARCHAR, waited BIGINT)"
    row = lambda x, callback, status, waited: f"{{'task': {x}.task, 'event_id': {x}.id, 'callback': {callback}, 'status': '{status}', 'waited': {waited}}}"
    full = f"reg AND len(others) >= {cap}"
    if on_full == "evict":
        kept = f"CASE WHEN NOT reg THEN others WHEN {full} THEN list_append(others[2:], new) ELSE list_append(others, new) END"
        over = f"CASE WHEN {full} THEN [{row('others[1]', 'NULL::BIGINT', 'evicted', 't - others[1].since')}] ELSE [] END"
    else:
        kept = f"CASE WHEN NOT reg OR {full} THEN others ELSE list_append(others, new) END"
        over = f"CASE WHEN {full} THEN [{row('new', 'NULL::BIGINT', 'rejected', '0::BIGINT')}] ELSE [] END"
    gone = lambda over: row("x", "NULL::BIGINT", "timeout", f"{seconds * 1_000_000}::BIGINT")
    return f"""WITH RECURSIVE {E_SQL}, cut AS (SELECT epoch_us({_cut('signup', 'click')}) AS w),
ev AS (SELECT user_id % 8 AS router, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS i, event_id, user_id AS task, epoch_us(ts) AS t, event_type = 'signup' AS reg
  FROM e, cut WHERE event_type IN ('signup', 'click') AND epoch_us(ts) <= w),
st AS (SELECT DISTINCT router, 0::BIGINT AS i, []::{item}[] AS pending, []::{shut}[] AS outs FROM ev
 UNION ALL SELECT router, i, {kept}, list_concat(list_concat(expired::{shut}[], ({over})::{shut}[]), (CASE
   WHEN len(mine) > 0 AND reg THEN [{row('mine[1]', 'NULL::BIGINT', 'replaced', 't - mine[1].since')}] WHEN len(mine) > 0 THEN [{row('mine[1]', 'event_id', 'delivered', 't - mine[1].since')}]
   WHEN NOT reg THEN [{{'task': task, 'event_id': NULL::BIGINT, 'callback': event_id, 'status': 'unknown', 'waited': NULL::BIGINT}}] ELSE [] END)::{shut}[])
 FROM (SELECT *, list_filter(live, lambda x: x.task = task) AS mine, list_filter(live, lambda x: x.task <> task) AS others, {{'task': task, 'id': event_id, 'since': t}}::{item} AS new
  FROM (SELECT st.router, ev.i, ev.event_id, ev.task, ev.t, ev.reg, list_filter(st.pending, lambda x: x.since + {seconds * 1_000_000} >= ev.t) AS live,
    list_transform(list_filter(st.pending, lambda x: x.since + {seconds * 1_000_000} < ev.t), lambda x: {gone('x')}) AS expired FROM st JOIN ev ON ev.router = st.router AND ev.i = st.i + 1))),
last AS (SELECT router, list_transform(list_filter(pending, lambda x: x.since + {seconds * 1_000_000} < w), lambda x: {gone('x')}) AS outs FROM st, cut QUALIFY i = max(i) OVER (PARTITION BY router)),
o AS (SELECT router, unnest(outs) AS o FROM st UNION ALL SELECT router, unnest(outs) FROM last)
SELECT router, o.task AS task, coalesce(o.event_id, -1) AS event_id, coalesce(o.callback, -1) AS callback, o.status AS status, coalesce(o.waited, -1) AS waited FROM o"""


def _callbacks(spark: SparkSession, d: str, **limits) -> DataFrame:
    e = stream_events(spark, d).where(F.col("event_type").isin("signup", "click"))
    s = e.select("event_id", "ts", (F.col("user_id") % 8).alias("router"), F.col("user_id").alias("task"), (F.col("event_type") == "signup").alias("asks"))
    with rocks_state(spark):
        return finished(rendezvous(s.withWatermark("ts", "1 hour"), **limits), "rendezvous").fillna(-1)


@query("callback_rendezvous", _rendezvous_sql(14_400, 4, "evict"))
def callback_rendezvous(spark, d):
    """Signups wait for a click of their user: four hours, and four of a router at once, the
    oldest going first (120 seconds and 500 are the defaults of ``rendezvous``)."""
    return _callbacks(spark, d, timeout_seconds=14_400, cap=4)


@query("callback_admission", _rendezvous_sql(14_400, 4, "reject"))
def callback_admission(spark, d):
    """The same, but tasks beyond the four are turned away."""
    return _callbacks(spark, d, timeout_seconds=14_400, cap=4, on_full="reject")
