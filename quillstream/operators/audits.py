"""Checks against settings that are rows: guardrails of a rollout, arms by label, phases by
bucket, and inputs made up to fit a tool's parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.operators.experiments import _ARMS, arms
from quillstream.operators.result_rules import TOOL_PARAMS, schema_errors
from quillstream.plans.registry import query
from quillstream.sources.tables import S_SQL, T_SQL, plan_steps, traces

#: The default rollout, and the limits of its guardrails.
CANARY_PERCENT, MIN_SAMPLE = 5.0, 200
GUARDRAILS = [("error_rate", 0.05), ("avg_latency_ms", 10_000.0), ("plan_validation_failure", 0.10)]


def guardrail_violations(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """experiment, violated (names in order, joined), checked: metrics (experiment, metric, value)
    against limits (metric, most); a metric without a limit, or a limit without a metric, is
    passed over, and a value at its limit is none too many."""
    both = metrics.join(F.broadcast(limits), "metric")
    bad = F.array_sort(F.collect_list(F.when(F.col("value") > F.col("most"), F.col("metric"))))  # one for each limit
    return both.groupBy("experiment").agg(F.array_join(bad, ",").alias("violated"), F.count(F.lit(1)).alias("checked"))


@query("rollout_guardrails", f"""WITH {_ARMS}, m AS (SELECT experiment, 'error_rate' AS metric, error_rate AS value FROM arms UNION ALL SELECT experiment, 'avg_latency_ms', latency_ms * 200 FROM arms UNION ALL SELECT experiment, 'unknown', 1 FROM arms),
l(metric, most) AS (VALUES {", ".join(f"('{m}', {x}::DOUBLE)" for m, x in GUARDRAILS)}),
g AS (SELECT experiment, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (value > most), '') AS violated, count(*) AS checked FROM m JOIN l USING (metric) GROUP BY 1)
SELECT experiment, violated, checked, CASE WHEN violated <> '' THEN 'rollback' WHEN n_control < {MIN_SAMPLE} OR n_canary < {MIN_SAMPLE} THEN 'hold' ELSE 'judge' END AS action FROM g JOIN arms USING (experiment)""")  # fmt: skip
def rollout_guardrails(spark, d):
    """The default settings on each experiment's metrics."""
    a = arms(spark, d)
    named = {"error_rate": F.col("error_rate"), "avg_latency_ms": F.col("latency_ms") * 200, "unknown": F.lit(1.0)}
    metrics = a.select("experiment", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in named.items()])))
    g = guardrail_violations(metrics, spark.createDataFrame(GUARDRAILS, "metric string, most double"))
    few = (F.col("n_control") < MIN_SAMPLE) | (F.col("n_canary") < MIN_SAMPLE)
    action = F.when(F.col("violated") != "", "rollback").when(few, "hold").otherwise("judge")
    return g.join(a.select("experiment", "n_control", "n_canary"), "experiment").select("experiment", "violated", "checked", action.alias("action"))


def arm_of(label: Column) -> Column:
    """The control group by its name, canaries by any name that says so; others are in neither."""
    return F.when(label == "control", "control").when(F.contains(label, F.lit("canary")), "canary")


_LABEL = "CASE user_id % 5 WHEN 0 THEN 'control' WHEN 1 THEN 'canary' WHEN 2 THEN 'planner_canary_v2' WHEN 3 THEN 'control_old' ELSE '' END"


@query("arms_by_label", f"""WITH {T_SQL}, a AS (SELECT *, {_LABEL} AS label FROM t), b AS (SELECT *, CASE WHEN label = 'control' THEN 'control' WHEN contains(label, 'canary') THEN 'canary' END AS arm FROM a)
SELECT arm, count(*) AS traces, count(DISTINCT label) AS labels, round(avg((state = 'done')::INT), 6) AS success, round(avg(ms), 3) AS mean_ms FROM b WHERE arm IS NOT NULL GROUP BY 1""")  # fmt: skip
def arms_by_label(spark, d):
    t = traces(spark, d).withColumn("label", F.expr(_LABEL))
    t = t.withColumn("arm", arm_of(F.col("label"))).where("arm IS NOT NULL")
    return t.groupBy("arm").agg(
        F.count(F.lit(1)).alias("traces"), F.countDistinct("label").alias("labels"), F.round(F.avg((F.col("state") == "done").cast("int")), 6).alias("success"), F.round(F.avg("ms"), 3).alias("mean_ms")
    )


#: Bounds of the histogram of phases.
PHASE_BOUNDS = [0.1, 0.5, 1, 2, 5, 10, 30]
_PHASE = "CASE WHEN step = 0 THEN 'plan' WHEN step = n - 1 THEN 'synthesis' ELSE 'execute' END"


@query("phase_histogram", f"""WITH {S_SQL}, p AS (SELECT {_PHASE} AS phase, elapsed_ms AS v FROM s)
SELECT phase, le, count(*) FILTER (v <= le) AS cumulative, count(*) AS total, round(sum(v), 4) AS sum_value FROM p, (VALUES {", ".join(f"({b}::DOUBLE)" for b in PHASE_BOUNDS)}, ('inf'::DOUBLE)) b(le) GROUP BY 1, 2""")  # fmt: skip
def phase_histogram(spark, d):
    """Cumulative counts of the durations of phases; every bound is counted in one pass."""
    bounds = [*PHASE_BOUNDS, float("inf")]
    p = plan_steps(spark, d).select(F.expr(_PHASE).alias("phase"), F.col("elapsed_ms").alias("v"))
    g = p.groupBy("phase").agg(*[F.count_if(F.col("v") <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(F.lit(1)).alias("total"), F.round(F.sum("v"), 4).alias("sum_value"))
    each = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)])
    return g.select("phase", F.inline(each), "total", "sum_value")


def made_up_inputs(params: DataFrame) -> DataFrame:
    """tool, input: a JSON object with a value of the right type for each required field."""
    value = (
        F.when(F.col("type") == "string", F.concat(F.lit('"test_'), "field", F.lit('"'))).when(F.col("type").isin("integer", "number"), "1")
        .when(F.col("type") == "boolean", "true").when(F.col("type") == "array", "[]").otherwise("{}")
    )
    item = F.when(F.col("required"), F.struct("position", F.concat(F.lit('"'), "field", F.lit('":'), value).alias("j")))
    made = params.groupBy("tool").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return made.select("tool", F.concat(F.lit("{"), F.array_join(F.transform("items", lambda x: x["j"]), ","), F.lit("}")).alias("input"))


_JSON_OF = {t: "{" + ",".join(f'"{f}":' + {"string": f'"test_{f}"', "integer": "1", "number": "1", "boolean": "true", "array": "[]"}[k] for tool, f, k, needed in TOOL_PARAMS if tool == t and needed) + "}" for t in dict.fromkeys(p[0] for p in TOOL_PARAMS)}


@query("made_up_calls", f"""WITH {S_SQL}, m(tool, input) AS (VALUES {", ".join(f"('{t}', '{j}')" for t, j in _JSON_OF.items())})
SELECT tool, input, count(*) AS calls, 0 AS wrong FROM s JOIN m USING (tool) GROUP BY 1, 2""")  # fmt: skip
def made_up_calls(spark, d):
    """Every planned call of a tool with parameters, made with a made-up input, which is then
    checked like any other."""
    params = spark.createDataFrame([(i, *p) for i, p in enumerate(TOOL_PARAMS)], "position int, tool string, field string, type string, required boolean")
    calls = plan_steps(spark, d).select("event_id", "tool").join(F.broadcast(made_up_inputs(params)), "tool")
    checked = schema_errors(calls, params, ["tool", "input"])
    return checked.groupBy("tool", "input").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("errors") != "").cast("int").alias("wrong"))
