"""Figures over traces and tool calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.plans.registry import query
from quillstream.sources.tables import R_SQL, T_SQL, events, tool_records, traces


@query("trace_snapshot", f"""WITH {T_SQL}, d AS (SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS i, count(*) OVER () AS n FROM t WHERE ms > 0)
SELECT count(*) AS total, round(avg((state = 'done')::INT), 4) AS success_rate, round(avg((state = 'error')::INT), 4) AS error_rate,
 round(avg(asked), 4) AS clarification_rate, (SELECT ms FROM d WHERE i = n // 2) AS p50_ms,
 (SELECT ms FROM d WHERE i = CASE WHEN n >= 100 THEN CAST(floor(0.99 * n) AS BIGINT) ELSE n - 1 END) AS p99_ms,
 (SELECT round(avg(ms), 3) FROM d) AS mean_ms FROM t""")  # fmt: skip
def trace_snapshot(spark, d):
    """p50 is the element n // 2 of the sorted durations over 0, p99 the element
    floor(0.99 n), below 100 traces the largest.  Positions come from counts by duration
    (combined before the shuffle), not from a list of all durations."""
    t = traces(spark, d)
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    base = t.agg(
        F.count(F.lit(1)).alias("total"), share(F.col("state") == "done").alias("success_rate"), share(F.col("state") == "error").alias("error_rate"),
        F.round(F.avg("asked"), 4).alias("clarification_rate"),
    )
    by = t.where("ms > 0").groupBy("ms").agg(F.count(F.lit(1)).alias("c"))
    # Parts of 2**16 ms: a window over few rows, then one inside each part.
    by = by.withColumn("part", F.floor(F.col("ms") / 65536))
    parts = by.groupBy("part").agg(F.sum("c").alias("pc"))
    parts = parts.select("part", (F.sum("pc").over(W.orderBy("part")) - F.col("pc")).alias("before"), F.sum("pc").over(W.partitionBy()).alias("n"))
    upto = F.col("before") + F.sum("c").over(W.partitionBy("part").orderBy("ms"))
    by = by.join(parts, "part").withColumn("upto", upto)
    p99 = F.when(F.col("n") >= 100, F.floor(F.col("n") * F.lit(0.99))).otherwise(F.col("n") - 1)
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("ms")))
    q = by.agg(at(F.floor(F.col("n") / 2)).alias("p50_ms"), at(p99).alias("p99_ms"), F.round(F.sum(F.col("ms") * F.col("c")) / F.sum("c"), 3).alias("mean_ms"))
    return base.join(F.broadcast(q))  # one row each


_STATUS = ["success", "degraded", "error", "timeout"]


@query("tool_status_pivot", f"""WITH {R_SQL} SELECT tool, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in _STATUS)}, count(*) AS total,
 round(count(*) FILTER (status = 'success')::DOUBLE / greatest(count(*), 1), 4) AS success_rate FROM r GROUP BY tool""")  # fmt: skip
def tool_status_pivot(spark, d):
    n = lambda s: F.count_if(F.col("status") == s)
    all_ = F.count(F.lit(1))
    return tool_records(spark, d).groupBy("tool").agg(*(n(s).alias(s) for s in _STATUS), all_.alias("total"), F.round(n("success") / F.greatest(all_, F.lit(1)), 4).alias("success_rate"))


@query("tool_latency_percentiles", f"""WITH {R_SQL}, o AS (SELECT tool, elapsed_ms, row_number() OVER (PARTITION BY tool ORDER BY elapsed_ms) - 1 AS i,
  count(*) OVER (PARTITION BY tool) AS n FROM r)
SELECT tool, max(elapsed_ms) FILTER (i = least(n * 50 // 100, n - 1)) AS p50, max(elapsed_ms) FILTER (i = least(n * 95 // 100, n - 1)) AS p95,
 max(elapsed_ms) FILTER (i = least(n * 99 // 100, n - 1)) AS p99 FROM o GROUP BY tool""")  # fmt: skip
def tool_latency_percentiles(spark, d):
    """The element min(n * p // 100, n - 1) of each tool's sorted latencies.  Counts by value are
    combined before the shuffle and summed by part of 16 ms, so that the window that orders
    all values of a tool sees parts, and the windows over values one part each."""
    by = tool_records(spark, d).groupBy("tool", "elapsed_ms").agg(F.count(F.lit(1)).alias("c"))
    by = by.withColumn("part", F.floor(F.col("elapsed_ms") / 16))
    parts = by.groupBy("tool", "part").agg(F.sum("c").alias("pc"))
    of_tool = W.partitionBy("tool")
    parts = parts.select("tool", "part", (F.sum("pc").over(of_tool.orderBy("part")) - F.col("pc")).alias("before"), F.sum("pc").over(of_tool).alias("n"))
    upto = F.col("before") + F.sum("c").over(W.partitionBy("tool", "part").orderBy("elapsed_ms"))
    by = by.join(parts, ["tool", "part"]).withColumn("upto", upto)
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1), F.col("elapsed_ms")))
    return by.groupBy("tool").agg(at(50).alias("p50"), at(95).alias("p95"), at(99).alias("p99"))


_BOUNDS = [0.1, 0.5, 1, 2, 5, 10, 30, 60]
_LE = ", ".join(f"({b}::DOUBLE)" for b in _BOUNDS)


@query("latency_histogram", f"""WITH {R_SQL} SELECT tool, le, count(*) FILTER (elapsed_ms <= le) AS cumulative, count(*) AS total, round(sum(elapsed_ms), 4) AS sum_value
 FROM r, (VALUES {_LE}, ('inf'::DOUBLE)) v(le) GROUP BY tool, le""")  # fmt: skip
def latency_histogram(spark, d):
    """Cumulative buckets: each call is counted once for every bound, in the partial sums."""
    bounds = [*map(float, _BOUNDS), float("inf")]
    r = tool_records(spark, d).groupBy("tool").agg(
        F.array(*[F.struct(F.lit(b).alias("le"), F.count_if(F.col("elapsed_ms") <= b).alias("cumulative")) for b in bounds]).alias("b"),
        F.count(F.lit(1)).alias("total"), F.round(F.sum("elapsed_ms"), 4).alias("sum_value"),
    )
    return r.select("tool", F.inline("b"), "total", "sum_value")


@query("plan_steps_histogram", f"WITH {T_SQL} SELECT le, count(*) FILTER (calls <= le) AS cumulative FROM t, (VALUES (1), (2), (3), (4), (5), (7), (10)) v(le) GROUP BY le")
def plan_steps_histogram(spark, d):
    one = traces(spark, d).agg(F.array(*[F.struct(F.lit(b).alias("le"), F.count_if(F.col("calls") <= b).alias("cumulative")) for b in (1, 2, 3, 4, 5, 7, 10)]).alias("b"))
    return one.select(F.inline("b"))


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles where b may be 0: NaN or infinite then, no error."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


@query("trace_waterfall", f"""WITH {R_SQL} SELECT event_id, user_id, CAST(day AS VARCHAR) AS day, tool, date_diff('microsecond', first_value(ts) OVER w, ts) / 1000.0::DOUBLE AS offset_ms,
 round(100 * elapsed_ms / sum(elapsed_ms) OVER (PARTITION BY user_id, day), 4) AS share FROM r WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)""")  # fmt: skip
def trace_waterfall(spark, d):
    """Where each call of a trace begins, and its share of the trace's time.  Traces whose calls
    took no time at all have no shares: nothing by nothing is NaN, as in SQL."""
    w = W.partitionBy("user_id", "day")
    r = tool_records(spark, d)
    offset = F.timestamp_diff("MICROSECOND", F.first("ts").over(w.orderBy("ts", "event_id")), F.col("ts")) / 1000.0
    share = F.round(quotient(F.col("elapsed_ms") * 100, F.sum("elapsed_ms").over(w)), 4)
    return r.select("event_id", "user_id", F.col("day").cast("string").alias("day"), "tool", offset.alias("offset_ms"), share.alias("share"))


@query("trace_recent", f"WITH {T_SQL} SELECT trace_id, user_id, started, calls, state FROM t ORDER BY started DESC, trace_id DESC LIMIT 20")
def trace_recent(spark, d):
    t = traces(spark, d).select("trace_id", "user_id", "started", "calls", "state")
    return t.orderBy(F.desc("started"), F.desc("trace_id")).limit(20)


@query("trace_ring_buffer", f"WITH {T_SQL} SELECT trace_id, user_id FROM t ORDER BY started DESC, trace_id DESC LIMIT 500")
def trace_ring_buffer(spark, d, capacity: int = 500):
    """The newest 500 traces stay, whoever they are of."""
    return traces(spark, d).orderBy(F.desc("started"), F.desc("trace_id")).limit(capacity).select("trace_id", "user_id")


@query("ab_compare", f"""WITH {T_SQL}, a AS (SELECT CASE WHEN user_id % 4 = 0 THEN 'x_canary' ELSE 'control' END AS arm, count(*) AS n,
  avg(ms) AS mean_ms, avg((state = 'done')::INT) AS success FROM t GROUP BY 1)
SELECT arm, n, round(mean_ms, 3) AS mean_ms, round(success, 4) AS success, round(100 * (success - (SELECT success FROM a WHERE arm = 'control')), 4) AS delta_pp FROM a""")  # fmt: skip
def ab_compare(spark, d):
    arm = F.when(F.col("user_id") % 4 == 0, "x_canary").otherwise("control")
    a = traces(spark, d).groupBy(arm.alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean_ms"), F.avg((F.col("state") == "done").cast("int")).alias("success"))
    base = F.max(F.when(F.col("arm") == "control", F.col("success"))).over(W.partitionBy())  # one row for each arm
    return a.select("arm", "n", F.round("mean_ms", 3).alias("mean_ms"), F.round("success", 4).alias("success"), F.round((F.col("success") - base) * 100, 4).alias("delta_pp"))


@query("funnel", f"""WITH {T_SQL}, s AS (SELECT count(*) AS total, count(*) FILTER (asked = 1) AS clarified, count(*) FILTER (state = 'done') AS done FROM t)
SELECT stage, n, round(100.0 * n / greatest(total, 1), 4) AS pct FROM (SELECT total, unnest(['total', 'clarified', 'done']) AS stage, unnest([total, clarified, done]) AS n FROM s)""")  # fmt: skip
def funnel(spark, d):
    s = traces(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("asked") == 1).alias("clarified"), F.count_if(F.col("state") == "done").alias("done"))
    s = s.select("total", F.expr("stack(3, 'total', total, 'clarified', clarified, 'done', done) AS (stage, n)"))
    return s.select("stage", "n", F.round(F.lit(100.0) * F.col("n") / F.greatest("total", F.lit(1)), 4).alias("pct"))


@query("critical_path", f"""WITH {R_SQL}, s AS (SELECT user_id, day, k % 3 AS step, sum(elapsed_ms) AS serial, max(elapsed_ms) AS longest FROM r GROUP BY 1, 2, 3)
SELECT user_id, CAST(day AS VARCHAR) AS day, round(sum(serial), 4) AS serial_ms, round(sum(longest), 4) AS parallel_ms FROM s GROUP BY user_id, s.day""")  # fmt: skip
def critical_path(spark, d):
    s = tool_records(spark, d).groupBy("user_id", "day", (F.col("k") % 3).alias("step")).agg(F.sum("elapsed_ms").alias("serial"), F.max("elapsed_ms").alias("longest"))
    return s.groupBy("user_id", F.col("day").cast("string").alias("day")).agg(F.round(F.sum("serial"), 4).alias("serial_ms"), F.round(F.sum("longest"), 4).alias("parallel_ms"))


#: Allowed changes of state.
TRANSITIONS = {
    "clarifying": ["planning", "done", "error"],
    "planning": ["validating", "clarifying", "error"],
    "validating": ["executing", "planning", "error"],
    "executing": ["reflecting", "error"],
    "reflecting": ["synthesizing", "planning", "error"],
    "synthesizing": ["done", "error"],
    "done": [],
    "error": ["done"],
}
_STATES = list(TRANSITIONS)
_EDGES = ", ".join(f"('{a}', '{b}')" for a, bs in TRANSITIONS.items() for b in bs)


@query("state_transition_audit", f"""WITH {R_SQL}, s AS (SELECT user_id, day, ts, event_id, list_extract({_STATES}, (k % 8 + 1)::BIGINT) AS state FROM r),
n AS (SELECT *, lead(state) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS next FROM s)
SELECT state, next, count(*) AS violations FROM n WHERE next IS NOT NULL AND (state, next) NOT IN (VALUES {_EDGES}) GROUP BY 1, 2""")  # fmt: skip
def state_transition_audit(spark, d):
    r = tool_records(spark, d)
    state = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("k") % 8 + 1).cast("int"))
    nxt = F.lead("state").over(W.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    n = r.withColumn("state", state).select("state", nxt.alias("next")).where("next IS NOT NULL")
    edges = spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "state string, next string")
    counts = n.groupBy("state", "next").agg(F.count(F.lit(1)).alias("violations"))  # 64 rows at most
    return counts.join(F.broadcast(edges), ["state", "next"], "left_anti")


@query("degradation_outcome", f"""WITH {R_SQL} SELECT policy, status, count(*) AS n, CASE WHEN status IN ('success', 'degraded') THEN status WHEN policy IN ('fail_fast', 'retry_with_backoff') THEN 'error' ELSE 'degraded' END AS outcome
FROM (SELECT *, list_extract(['fail_fast', 'return_cached', 'skip', 'inform_user', 'retry_with_backoff'], (k % 5 + 1)::BIGINT) AS policy FROM r) GROUP BY 1, 2""")  # fmt: skip
def degradation_outcome(spark, d):
    policies = F.array(*map(F.lit, ["fail_fast", "return_cached", "skip", "inform_user", "retry_with_backoff"]))
    r = tool_records(spark, d).withColumn("policy", F.element_at(policies, (F.col("k") % 5 + 1).cast("int")))
    outcome = F.when(F.col("status").isin("success", "degraded"), F.col("status")).when(F.col("policy").isin("fail_fast", "retry_with_backoff"), "error").otherwise("degraded")
    return r.groupBy("policy", "status").agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", outcome)


@query("degradation_notes", f"WITH {R_SQL} SELECT event_id, tool, tool || ': ' || status AS note FROM r WHERE status IN ('degraded', 'error')")
def degradation_notes(spark, d):
    r = tool_records(spark, d).where(F.col("status").isin("degraded", "error"))
    return r.select("event_id", "tool", F.concat_ws(": ", "tool", "status").alias("note"))


@query("errors_last_wins", f"""WITH {R_SQL} SELECT user_id, tool, max(event_id) AS event_id, max_by(status, event_id) AS status FROM r GROUP BY 1, 2""")
def errors_last_wins(spark, d):
    return tool_records(spark, d).groupBy("user_id", "tool").agg(F.max("event_id").alias("event_id"), F.max_by("status", "event_id").alias("status"))


@query("metric_counters", """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1""")
def metric_counters(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("dedup_gap", f"""WITH {R_SQL}, g AS (SELECT event_id, user_id, tool, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id, tool ORDER BY ts, event_id), ts) AS gap
  FROM r WHERE status IN ('success', 'degraded'))
SELECT event_id, user_id, tool, coalesce(gap <= 3600000000, false) AS hit FROM g""")  # fmt: skip
def dedup_gap(spark, d):
    """A call is a hit if the one before with the same key is at most an hour old; failed
    calls are not kept, so that they can be tried again."""
    r = tool_records(spark, d).where(F.col("status").isin("success", "degraded"))
    before = F.lag("ts").over(W.partitionBy("user_id", "tool").orderBy("ts", "event_id"))
    return r.select("event_id", "user_id", "tool", F.coalesce(F.timestamp_diff("MICROSECOND", before, F.col("ts")) <= 3_600_000_000, F.lit(False)).alias("hit"))


@query("cache_hits", f"""WITH {R_SQL}, g AS (SELECT tool, date_diff('microsecond', lag(ts) OVER (PARTITION BY tool, k ORDER BY ts, event_id), ts) AS gap FROM r)
SELECT tool, count(*) AS calls, count(*) FILTER (gap < 300000000) AS fresh, count(*) FILTER (gap >= 300000000) AS stale, count(*) FILTER (gap IS NULL) AS cold FROM g GROUP BY 1""")  # fmt: skip
def cache_hits(spark, d):
    """Calls by the age of the one before with the same key.  Few keys may hold all calls, so
    the window runs inside a key's day, and the first call of a day finds its predecessor in
    the last moments of the days before, of which there is one row for each day."""
    r = tool_records(spark, d).select("tool", "k", "day", "ts", "event_id")
    w = W.partitionBy("tool", "k", "day").orderBy("ts", "event_id")
    inside = r.withColumn("before", F.lag("ts").over(w))
    lasts = r.groupBy("tool", "k", "day").agg(F.max("ts").alias("last"))
    lasts = lasts.select("tool", "k", "day", F.lag("last").over(W.partitionBy("tool", "k").orderBy("day")).alias("carried"))
    g = inside.join(lasts, ["tool", "k", "day"])
    gap = F.timestamp_diff("MICROSECOND", F.coalesce("before", "carried"), F.col("ts"))
    g = g.select("tool", gap.alias("gap"))
    return g.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("gap") < 300_000_000).alias("fresh"), F.count_if(F.col("gap") >= 300_000_000).alias("stale"), F.count_if(F.col("gap").isNull()).alias("cold"))


@query("plan_violations", f"""WITH {R_SQL}, s AS (SELECT user_id, day, tool, k, row_number() OVER w - 1 AS step, count(*) OVER (PARTITION BY user_id, day) AS n FROM r WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)),
x AS (SELECT *, step - 1 - k % 3 + CASE WHEN k % 7 = 0 THEN 3 ELSE 0 END AS dep FROM s)
SELECT user_id, CAST(day AS VARCHAR) AS day, step, dep, CASE WHEN dep < 0 THEN 'negative' WHEN dep >= n THEN 'missing' ELSE 'forward' END AS message FROM x WHERE dep < 0 OR dep >= step
UNION ALL SELECT user_id, CAST(day AS VARCHAR), step, dep, 'unknown tool' FROM x WHERE tool NOT IN ('tool_0', 'tool_1', 'tool_2', 'tool_3', 'tool_4', 'tool_5', 'tool_6')""")  # fmt: skip
def plan_violations(spark, d):
    """Traces as plans: a step's dependency must exist and come before it (the first of
    negative, missing, forward that applies), and its tool must be known."""
    w = W.partitionBy("user_id", "day")
    s = tool_records(spark, d).withColumn("step", F.row_number().over(w.orderBy("ts", "event_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    s = s.withColumn("dep", F.col("step") - 1 - F.col("k") % 3 + F.when(F.col("k") % 7 == 0, 3).otherwise(0))
    dep = F.col("dep")
    message = F.when(dep < 0, "negative").when(dep >= F.col("n"), "missing").otherwise("forward")
    bad = s.where((dep < 0) | (dep >= F.col("step"))).select("user_id", "day", "step", "dep", message.alias("message"))
    known = spark.range(7).select(F.concat(F.lit("tool_"), F.col("id")).alias("tool"))
    unknown = s.join(F.broadcast(known), "tool", "left_anti")
    return bad.unionByName(unknown.select("user_id", "day", "step", "dep", F.lit("unknown tool").alias("message"))).withColumn("day", F.col("day").cast("string"))
