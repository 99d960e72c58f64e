"""How the given tables stand for an assistant's records.

events: a view or a click is a touch, a purchase a purchase; each event is also a tool
call, and the events of a user on a day are one trace.  ``k`` is the number in ``props``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def level(event_type: Column) -> Column:
    return (
        F.when(event_type == "view", "impression").when(event_type == "click", "click").when(event_type == "signup", "add_to_cart")
        .when(event_type == "purchase", "purchase").when(event_type == "error", "returned")
    )


def status(event_type: Column) -> Column:
    return F.when(event_type == "error", "error").when(event_type == "signup", "degraded").when(event_type == "click", "timeout").otherwise("success")


def tool_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, tool, status, elapsed_ms, k, day."""
    e = events(spark, sf_dir)
    return e.select(
        "event_id", "ts", "user_id", F.concat(F.lit("tool_"), F.col("k") % 8).alias("tool"),
        status(F.col("event_type")).alias("status"), F.col("value").alias("elapsed_ms"), "k", F.to_date("ts").alias("day"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for a user's day: trace_id, user_id, day, started, ended, ms, calls, state."""
    r = tool_records(spark, sf_dir)
    t = r.groupBy("user_id", "day").agg(
        F.min("event_id").alias("trace_id"), F.min("ts").alias("started"), F.max("ts").alias("ended"),
        F.count(F.lit(1)).alias("calls"), F.max((F.col("status") == "error").cast("int")).alias("failed"),
        F.max((F.col("status") == "timeout").cast("int")).alias("asked"),
    )
    ms = F.timestamp_diff("MICROSECOND", F.col("started"), F.col("ended")) / 1000.0
    return t.withColumn("ms", ms).withColumn("state", F.when(F.col("failed") == 1, "error").otherwise("done"))


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each product that a user's day of views and clicks recommends."""
    e = events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    e = e.withColumn("day", F.to_date("ts")).withColumn("product", F.col("k") % 10)
    w = W.partitionBy("user_id", "day")
    day = e.select("user_id", "product", F.min("event_id").over(w).alias("trace_id"), F.min("ts").over(w).alias("touched"))
    return day.distinct()


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("event_type") == "purchase")
    return e.select("event_id", "user_id", F.col("ts").alias("bought"), (F.col("k") % 10).alias("product"))


#: The same tables in SQL, as the beginning of a WITH clause.
E_SQL = "e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(ts AS DATE) AS day FROM events)"
R_SQL = (
    E_SQL
    + """, r AS (SELECT event_id, ts, user_id, 'tool_' || (k % 8) AS tool,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'degraded' WHEN 'click' THEN 'timeout' ELSE 'success' END AS status,
  value AS elapsed_ms, k, day FROM e)"""
)
T_SQL = (
    R_SQL
    + """, t AS (SELECT user_id, day, min(event_id) AS trace_id, min(ts) AS started, max(ts) AS ended, count(*) AS calls,
  date_diff('microsecond', min(ts), max(ts)) / 1000.0::DOUBLE AS ms,
  CASE WHEN bool_or(status = 'error') THEN 'error' ELSE 'done' END AS state,
  max((status = 'timeout')::INT) AS asked FROM r GROUP BY user_id, day)"""
)
P_SQL = (
    E_SQL
    + """, touch AS (SELECT DISTINCT user_id, k % 10 AS product, min(event_id) OVER w AS trace_id, min(ts) OVER w AS touched
  FROM e WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id, day)),
p AS (SELECT event_id, user_id, ts AS bought, k % 10 AS product FROM e WHERE event_type = 'purchase'),
hit AS (SELECT p.event_id, p.user_id, p.product, p.bought, touch.trace_id, touch.touched,
    row_number() OVER (PARTITION BY p.event_id ORDER BY touch.touched DESC, touch.trace_id) AS n
  FROM p JOIN touch ON p.user_id = touch.user_id AND p.product = touch.product
    AND touch.touched <= p.bought AND p.bought <= touch.touched + INTERVAL 7 DAY),
lt AS (SELECT event_id, user_id, product, trace_id,
    date_diff('microsecond', touched, bought) / 3600000000.0::DOUBLE AS hours FROM hit WHERE n = 1)"""
)

#: The assistant's tools and intents, and which tools an intent allows.
TOOLS = [
    "rag_search", "rag_chat", "web_search", "user_profile", "inventory_check", "image_search", "knowledge_graph",
    "price_analysis", "order_lookup", "order_create", "logistics_track", "crm_create_return", "crm_send_coupon",
]
WHITELIST = {
    "shopping_guide": ["rag_search", "rag_chat", "web_search", "user_profile", "inventory_check", "image_search"],
    "recommendation": ["rag_search", "rag_chat", "web_search", "user_profile", "inventory_check", "knowledge_graph", "image_search"],
    "operations": ["rag_search", "web_search", "price_analysis", "order_lookup"],
    "supply_chain": ["rag_search", "order_lookup", "order_create", "logistics_track", "crm_create_return", "inventory_check"],
    "general": ["rag_search", "rag_chat", "web_search"],
}
CONFIRMATION_TOOLS = ["order_create", "crm_create_return", "order_cancel"]
INTENTS = list(WHITELIST)


def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user's day as the steps of a plan, each depending on one other:
    tool_records and intent, step, n (steps of the plan), dep."""
    w = W.partitionBy("user_id", "day")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    s = tool_records(spark, sf_dir).withColumn("tool", pick(TOOLS, F.col("k") % len(TOOLS))).withColumn("intent", pick(INTENTS, F.col("user_id") % len(INTENTS)))
    s = s.withColumn("step", F.row_number().over(w.orderBy("ts", "event_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return s.withColumn("dep", F.col("step") - 1 - F.col("k") % 3 + F.when(F.col("k") % 7 == 0, 3).otherwise(0)).withColumn("day", F.col("day").cast("string"))


S_SQL = (
    R_SQL
    + f""", s AS (SELECT user_id, CAST(day AS VARCHAR) AS day, event_id, ts, k, status, elapsed_ms, list_extract({TOOLS}, (k % {len(TOOLS)} + 1)::BIGINT) AS tool,
  list_extract({INTENTS}, (user_id % {len(INTENTS)} + 1)::BIGINT) AS intent, row_number() OVER w - 1 AS step, count(*) OVER (PARTITION BY user_id, day) AS n,
  row_number() OVER w - 2 - k % 3 + CASE WHEN k % 7 = 0 THEN 3 ELSE 0 END AS dep FROM r WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id))"""
)
