"""Event streams: each runs to the end of what is there and hands back its sink's table.

Sinks and checkpoints lie in the folder that driver and executors share.  ``events.ts``
has no zone; watermarks need a timestamp, so it is cast first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstream.operators.context import lifetimes_sql
from quillstream.plans.registry import query
from quillstream.sources.scratch import scratch_path
from quillstream.sources.tables import E_SQL, R_SQL, level, status

#: Into so many buckets the keys of a stream are dealt where each key has few rows.
BUCKETS = 1024


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # A pattern, since a stream's source takes folders but no single file by its name.
    e = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream in append mode over all there is; the rows that its sink then holds."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    q = stream.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, name + "-state")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_hourly_kpis", """WITH h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, ts FROM events),
c AS (SELECT hour, count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases FROM h GROUP BY 1)
SELECT strftime(hour, '%Y-%m-%d %H') AS hour, impressions, clicks, purchases FROM c WHERE hour + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)""")  # fmt: skip
def stream_hourly_kpis(spark, d):
    """Counts by hour; an hour is final, and given out, one hour of event time after its end."""
    e = stream_events(spark, d).withWatermark("ts", "1 hour").withColumn("l", level(F.col("event_type")))
    n = lambda x: F.count_if(F.col("l") == x)
    g = e.groupBy(F.window("ts", "1 hour")).agg(n("impression").alias("impressions"), n("click").alias("clicks"), n("purchase").alias("purchases"))
    done = finished(g.select(F.col("window.start").alias("start"), "impressions", "clicks", "purchases"), "hourly-kpis")
    return done.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "impressions", "clicks", "purchases")


@query("stream_status_log", f"WITH {R_SQL} SELECT tool, status, count(*) AS n FROM r WHERE status <> 'success' GROUP BY 1, 2")
def stream_status_log(spark, d):
    """Calls that did not succeed, appended to a log by the stream, then counted."""
    e = stream_events(spark, d).select("event_id", F.concat(F.lit("tool_"), F.col("k") % 8).alias("tool"), status(F.col("event_type")).alias("status"))
    return finished(e.where("status != 'success'"), "status-log").groupBy("tool", "status").agg(F.count(F.lit(1)).alias("n"))


def stored_calls(stream: DataFrame, keys: list[str], ttl_seconds: int, buckets: int = BUCKETS) -> DataFrame:
    """The calls of a stream (event_id, ts and ``keys``) that are carried out: the first of a
    key and the first after the stored one has outlived ``ttl_seconds``.  The state of a key
    is one moment; it is dropped when the watermark has passed the end of its life.  Keys are
    few rows each, so a state holds all keys of a bucket."""
    ttl, names = ttl_seconds * 1_000_000, stream.columns
    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs() * 1000
        stored = dict(zip(*state.get, strict=True)) if state.exists else {}
        out = None
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            us = rows["ts"].astype("datetime64[us]").astype("int64").tolist()
            keep = []
            for key, moment in zip(rows["key"], us, strict=True):
                had = stored.get(key)
                new = had is None or moment - had > ttl
                if new:
                    stored[key] = moment
                keep.append(new)
            out = rows.loc[keep, names]
        alive = {k: m for k, m in stored.items() if m + ttl >= watermark}
        if alive:
            state.update((list(alive), list(alive.values())))
            state.setTimeoutTimestamp(max(max(alive.values()) + ttl, watermark) // 1000 + 1)
        elif state.exists:
            state.remove()
        if out is not None:
            yield out

    dealt = stream.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("key", F.to_json(F.struct(*keys)))
    state = "keys array<string>, stored array<bigint>"
    return dealt.groupBy("bucket").applyInPandasWithState(step, stream.schema, state, "append", GroupStateTimeout.EventTimeTimeout)


def calls(spark: SparkSession, d: str) -> DataFrame:
    e = stream_events(spark, d).withColumn("status", status(F.col("event_type")))
    return e.select("event_id", "ts", "user_id", F.concat(F.lit("tool_"), F.col("k") % 8).alias("tool"), "k", "status").withWatermark("ts", "1 hour")


@query("stream_dedup", lifetimes_sql("user_id, tool", 3600, "status IN ('success', 'degraded')") + " SELECT user_id, tool, ts FROM kept")
def stream_dedup(spark, d):
    """Calls that are carried out, equal ones being answered for an hour from the first."""
    good = calls(spark, d).where(F.col("status").isin("success", "degraded")).select("event_id", "ts", "user_id", "tool")
    kept = finished(stored_calls(good, ["user_id", "tool"], 3600), "dedup")
    return kept.select("user_id", "tool", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stream_fresh_cache", lifetimes_sql("tool, k", 300, "true") + " SELECT tool, count(*) AS searches FROM kept GROUP BY 1")
def stream_fresh_cache(spark, d):
    """Searches that are made, a result staying fresh for 300 seconds."""
    kept = finished(stored_calls(calls(spark, d).select("event_id", "ts", "tool", "k"), ["tool", "k"], 300), "fresh-cache")
    return kept.groupBy("tool").agg(F.count(F.lit(1)).alias("searches"))


@query("stream_sessions", f"""WITH {R_SQL}, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM r),
n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), x AS (SELECT user_id, min(ts) AS started, max(ts) AS last, count(*) AS calls FROM n GROUP BY user_id, s)
SELECT user_id, started, calls, least(calls, 20) AS held FROM x WHERE last + INTERVAL 5 HOUR <= (SELECT max(ts) FROM r)""")  # fmt: skip
def stream_sessions(spark, d):
    """Sessions of a user, over after four hours without a call, and the turns held, 20 at most."""
    w = F.session_window("ts", "4 hours")
    g = calls(spark, d).groupBy("user_id", w).agg(F.count(F.lit(1)).alias("calls"))
    done = finished(g.select("user_id", F.col("session_window.start").alias("started"), "calls"), "sessions")
    return done.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "calls", F.least("calls", F.lit(20)).cast("long").alias("held"))


@query("stream_attr_join", f"""WITH {E_SQL} SELECT p.event_id, arg_max(t.event_id, (t.ts, -t.event_id)) AS touch FROM e p JOIN e t ON p.event_type = 'purchase' AND t.event_type IN ('view', 'click') AND p.user_id = t.user_id AND p.k % 10 = t.k % 10
 AND t.ts <= p.ts AND p.ts <= t.ts + INTERVAL 7 DAY GROUP BY 1""")  # fmt: skip
def stream_attr_join(spark, d):
    """Two streams joined within seven days, state older than that going with the watermark;
    the nearest touch of each purchase is then taken from the pairs that were given out."""
    e = lambda *types: stream_events(spark, d).where(F.col("event_type").isin(*types))
    product = (F.col("k") % 10).alias("product")
    t = e("view", "click").select(F.col("ts").alias("touched"), F.col("user_id").alias("u"), product.alias("p"), F.col("event_id").alias("touch")).withWatermark("touched", "1 hour")
    p = e("purchase").select("event_id", F.col("ts").alias("bought"), "user_id", product).withWatermark("bought", "1 hour")
    near = F.expr("u = user_id AND p = product AND touched <= bought AND bought <= touched + INTERVAL 7 DAYS")
    pairs = finished(p.join(t, near).select("event_id", "touched", "touch"), "attribution")
    return pairs.groupBy("event_id").agg(F.max_by("touch", F.struct("touched", -F.col("touch"))).alias("touch"))


@query("stream_callbacks", f"""WITH {E_SQL}, w AS (SELECT event_id, user_id, ts FROM e WHERE event_type = 'signup' AND ts < (SELECT max(ts) FROM e) - INTERVAL 1 DAY),
j AS (SELECT w.event_id, min(c.event_id) AS callback FROM w LEFT JOIN e c ON c.event_type = 'click' AND c.user_id = w.user_id AND c.ts >= w.ts AND c.ts <= w.ts + INTERVAL 2 HOUR GROUP BY 1)
SELECT event_id, coalesce(callback, -1) AS callback FROM j""")  # fmt: skip
def stream_callbacks(spark, d):
    """Tasks that wait for a callback of their user, two hours at most; what nobody answers
    times out when the watermark has passed.  The last day of the stream is left open."""
    e = lambda kind: stream_events(spark, d).where(F.col("event_type") == kind)
    w = e("signup").select("event_id", F.col("ts").alias("asked"), "user_id").withWatermark("asked", "1 hour")
    c = e("click").select(F.col("event_id").alias("c"), F.col("ts").alias("answered"), F.col("user_id").alias("u")).withWatermark("answered", "1 hour")
    within = F.expr("u = user_id AND answered >= asked AND answered <= asked + INTERVAL 2 HOURS")
    pairs = finished(w.join(c, within, "left_outer").select("event_id", "asked", "c"), "callbacks")
    last = spark.read.parquet(f"{d}/events.parquet").agg((F.max("ts").cast("timestamp") - F.expr("INTERVAL 1 DAY")).alias("end"))
    closed = pairs.join(F.broadcast(last), F.col("asked") < F.col("end"))  # one row
    return closed.groupBy("event_id").agg(F.coalesce(F.min("c"), F.lit(-1)).alias("callback"))


@query("event_log_roundtrip", f"WITH {R_SQL} SELECT event_id, tool, status, elapsed_ms FROM r")
def event_log_roundtrip(spark, d):
    """Append tool calls to a log of JSON lines and scan it with a fixed schema."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    rows = e.select("event_id", F.concat(F.lit("tool_"), F.col("k") % 8).alias("tool"), status(F.col("event_type")).alias("status"), F.col("value").alias("elapsed_ms"))
    out = scratch_path(spark, "event-log")
    rows.write.mode("append").json(out)
    return spark.read.schema(rows.schema).json(out)
