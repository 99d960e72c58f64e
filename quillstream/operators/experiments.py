"""Experiment assignment over customers, and rollout decisions over measured arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.functions.experiments import bucket, canary_percentile, decide, next_percent
from quillstream.plans.registry import query
from quillstream.sources.tables import R_SQL, table, tool_records

GROUPS = ["control", "a", "b"]
_B = "('0x' || substr(sha256('ranker:user_' || c_custkey), 1, 8))::BIGINT % 3"
_C = "(('0x' || substr(sha256('planner_prompt_v2:canary:user_' || c_custkey), 1, 8))::BIGINT % 10000) / 100.0::DOUBLE"
_G = f"CASE {_B} WHEN 0 THEN 'control' WHEN 1 THEN 'a' ELSE 'b' END"


def _user():
    return F.concat(F.lit("user_"), F.col("c_custkey").cast("string"))


@query("bucket_assign", f"SELECT c_custkey, {_G} AS experiment_group FROM customer")
def bucket_assign(spark, d):
    return table(spark, d, "customer").select("c_custkey", bucket("ranker", _user(), GROUPS).alias("experiment_group"))


@query("bucket_distribution", f"""SELECT g AS experiment_group, count(c.c_custkey) AS users FROM (VALUES ('control'), ('a'), ('b'), ('unused')) v(g)
LEFT JOIN (SELECT c_custkey, {_G} AS x FROM customer) c ON c.x = g GROUP BY g""")  # fmt: skip
def bucket_distribution(spark, d):
    groups = spark.range(1).select(F.explode(F.array(*map(F.lit, [*GROUPS, "unused"]))).alias("experiment_group"))
    counts = bucket_assign(spark, d).groupBy("experiment_group").agg(F.count(F.lit(1)).alias("users"))
    return groups.join(counts, "experiment_group", "left").select("experiment_group", F.coalesce("users", F.lit(0).cast("long")).alias("users"))


@query("variant_assign", f"""SELECT c_custkey, {_C} AS percentile, CASE WHEN {_C} < 5 THEN 'canary' ELSE 'control' END AS variant,
CASE WHEN {_C} < 5 THEN 'planner_prompt_v2_canary' ELSE {_G} END AS label FROM customer""")  # fmt: skip
def variant_assign(spark, d):
    """Users below the canary's share get its variant and label; the others the control
    variant under the label of their bucket."""
    c = table(spark, d, "customer")
    p = canary_percentile("planner_prompt_v2", _user())
    return c.select(
        "c_custkey", p.alias("percentile"), F.when(p < 5, "canary").otherwise("control").alias("variant"),
        F.when(p < 5, "planner_prompt_v2_canary").otherwise(bucket("ranker", _user(), GROUPS)).alias("label"),
    )


@query("canary_split", f"SELECT c_mktsegment, count(*) AS users, count(*) FILTER ({_C} < 5) AS canary FROM customer GROUP BY 1")
def canary_split(spark, d):
    c = table(spark, d, "customer").withColumn("p", canary_percentile("planner_prompt_v2", _user()))
    return c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("p") < 5).alias("canary"))


_ARMS = f"""{R_SQL}, arms AS (SELECT tool AS experiment,
  count(*) FILTER (user_id % 2 = 0) AS n_control, count(*) FILTER (user_id % 2 = 1) AS n_canary,
  coalesce(avg((status = 'success')::INT) FILTER (user_id % 2 = 0), 0) AS control, coalesce(avg((status = 'success')::INT) FILTER (user_id % 2 = 1), 0) AS canary,
  coalesce(avg((status = 'error')::INT) FILTER (user_id % 2 = 1), 0) AS error_rate,
  coalesce(avg(elapsed_ms) FILTER (user_id % 2 = 1), 0) AS latency_ms, 5.0::DOUBLE * (1 + min(k) % 12) AS percent FROM r GROUP BY tool)"""


def arms(spark, d):
    """Figures of either arm (users by parity) for each tool as an experiment."""
    r = tool_records(spark, d)
    odd = F.col("user_id") % 2 == 1
    mean = lambda x, arm: F.coalesce(F.avg(F.when(arm, x)), F.lit(0.0))
    good, bad = (F.col("status") == "success").cast("int"), (F.col("status") == "error").cast("int")
    return r.groupBy(F.col("tool").alias("experiment")).agg(
        F.count_if(~odd).alias("n_control"), F.count_if(odd).alias("n_canary"), mean(good, ~odd).alias("control"), mean(good, odd).alias("canary"),
        mean(bad, odd).alias("error_rate"), mean(F.col("elapsed_ms"), odd).alias("latency_ms"), (F.lit(5.0) * (1 + F.min("k") % 12)).alias("percent"),
    )


@query("rollout_decide", f"""WITH {_ARMS}, a AS (SELECT *, CASE WHEN error_rate > 0.21 OR latency_ms > 60 THEN 'rollback'
  WHEN n_control < 20 OR n_canary < 20 THEN 'hold' WHEN control = 0 THEN 'hold'
  WHEN (canary - control) / control >= 0.02 THEN CASE WHEN percent >= 50 THEN 'complete' ELSE 'expand' END
  WHEN (canary - control) / control < -0.05 THEN 'rollback' ELSE 'hold' END AS action FROM arms)
SELECT experiment, n_control, n_canary, round(control, 6) AS control, round(canary, 6) AS canary, action,
  CASE action WHEN 'rollback' THEN 0.0 WHEN 'expand' THEN least(percent * 2, 50.0) WHEN 'complete' THEN 100.0 ELSE percent END AS next_percent FROM a""")  # fmt: skip
def rollout_decide(spark, d):
    a = arms(spark, d)
    violated = (F.col("error_rate") > 0.21) | (F.col("latency_ms") > 60)
    c = F.col
    a = a.withColumn("action", decide(c("control"), c("canary"), c("n_control"), c("n_canary"), violated, c("percent"), 20, 0.02))
    return a.select(
        "experiment", "n_control", "n_canary", F.round("control", 6).alias("control"), F.round("canary", 6).alias("canary"), "action",
        next_percent(c("action"), c("percent")).alias("next_percent"),
    )


@query("guardrail_status", f"""WITH {_ARMS}, g AS (SELECT experiment, 'error_rate' AS metric, error_rate AS value, 0.21 AS most FROM arms
  UNION ALL SELECT experiment, 'latency_ms', latency_ms, 60 FROM arms)
SELECT experiment, metric, round(value, 6) AS value, CASE WHEN value > most THEN 'violated' WHEN value > most * 0.8 THEN 'warning' ELSE 'ok' END AS status FROM g""")  # fmt: skip
def guardrail_status(spark, d):
    limits = F.array(
        F.struct(F.lit("error_rate").alias("metric"), F.col("error_rate").alias("value"), F.lit(0.21).alias("most")),
        F.struct(F.lit("latency_ms").alias("metric"), F.col("latency_ms").alias("value"), F.lit(60.0).alias("most")),
    )
    g = arms(spark, d).select("experiment", F.inline(limits))
    v, most = F.col("value"), F.col("most")
    return g.select("experiment", "metric", F.round(v, 6).alias("value"), F.when(v > most, "violated").when(v > most * 0.8, "warning").otherwise("ok").alias("status"))
