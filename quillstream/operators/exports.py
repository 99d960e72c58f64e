"""Records as others read them: spans and logs as JSON, metrics as text, keys, labels, cards,
tables that are updated by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.plans.registry import query
from quillstream.sources.tables import E_SQL, R_SQL, S_SQL, T_SQL, events, plan_steps, table, tool_records, traces


@query("otel_export", f"""WITH {S_SQL} SELECT user_id || '-' || day AS trace, '{{"traceId":"' || user_id || '-' || day || '","spans":[' || string_agg('{{"spanId":"' || event_id || '"' || CASE WHEN step > 0 THEN ',"parentSpanId":"root"' ELSE '' END || ',"name":"' || tool
 || '","startTimeUnixNano":' || epoch_us(ts) * 1000 || ',"attributes":{{"k":"' || k || '","status":"' || status || '"}}}}', ',' ORDER BY step) || ']}}' AS json FROM s GROUP BY user_id, day""")  # fmt: skip
def otel_export(spark, d):
    """A trace for each plan; its first span has no parent, attributes are strings of at most 256."""
    text = lambda c: F.left(F.col(c).cast("string"), F.lit(256)).alias(c)
    span = F.struct(
        "step", F.col("event_id").cast("string").alias("spanId"), F.when(F.col("step") > 0, "root").alias("parentSpanId"), F.col("tool").alias("name"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("startTimeUnixNano"), F.struct(text("k"), text("status")).alias("attributes"),
    )
    g = plan_steps(spark, d).groupBy("user_id", "day").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    spans = F.transform("spans", lambda s: s.dropFields("step"))
    trace = F.concat_ws("-", "user_id", "day")
    return g.select(trace.alias("trace"), F.to_json(F.struct(trace.alias("traceId"), spans.alias("spans"))).alias("json"))


@query("log_lines", f"""WITH {R_SQL} SELECT event_id, '{{"level":"' || CASE WHEN status = 'error' THEN 'ERROR' ELSE 'INFO' END || '","logger":"' || tool || '","msg":"' || status || '"' || CASE WHEN status = 'error' THEN ',"exception":"k' || k || '"' ELSE '' END || ',"trace_id":"' || user_id || '"}}' AS line FROM r""")
def log_lines(spark, d):
    """Log records as JSON; what is null is left out."""
    bad = F.col("status") == "error"
    line = F.struct(
        F.when(bad, "ERROR").otherwise("INFO").alias("level"), F.col("tool").alias("logger"), F.col("status").alias("msg"),
        F.when(bad, F.concat(F.lit("k"), F.col("k"))).alias("exception"), F.col("user_id").cast("string").alias("trace_id"),
    )
    return tool_records(spark, d).select("event_id", F.to_json(line).alias("line"))


@query("tool_status_counters", f"WITH {R_SQL} SELECT tool, status, count(*) AS calls FROM r GROUP BY 1, 2")
def tool_status_counters(spark, d):
    return tool_records(spark, d).groupBy("tool", "status").agg(F.count(F.lit(1)).alias("calls"))


@query("intent_counters", f"""WITH {S_SQL}, p AS (SELECT user_id, day, intent, bool_or(status = 'timeout') AS asked, count(*) AS calls FROM s GROUP BY 1, 2, 3)
SELECT intent, count(*) AS responses, count(*) FILTER (asked) AS clarifying, sum(calls)::BIGINT AS calls, count(*) FILTER (calls > 1) AS replanned FROM p GROUP BY 1""")  # fmt: skip
def intent_counters(spark, d):
    """What responses add to the counters: clarifications, calls and repeated rounds by intent."""
    p = plan_steps(spark, d).groupBy("user_id", "day", "intent").agg(F.bool_or(F.col("status") == "timeout").alias("asked"), F.count(F.lit(1)).alias("calls"))
    return p.groupBy("intent").agg(
        F.count(F.lit(1)).alias("responses"), F.count_if("asked").alias("clarifying"), F.sum("calls").alias("calls"), F.count_if(F.col("calls") > 1).alias("replanned")
    )


@query("metrics_text", f"""WITH {R_SQL} SELECT 'tool_calls_total{{tool="' || tool || '",status="' || status || '"}} ' || count(*) AS line FROM r GROUP BY tool, status""")
def metrics_text(spark, d, enabled: bool = True):
    """Counters as exposition text; one comment if metrics are off."""
    if not enabled:
        return spark.createDataFrame([("# metrics are off",)], "line string")
    return tool_status_counters(spark, d).select(F.format_string('tool_calls_total{tool="%s",status="%s"} %d', "tool", "status", "calls").alias("line"))


@query("gauges", f"""WITH {T_SQL}, g AS (SELECT count(*) AS plans, count(*) FILTER (state = 'done') AS done, count(*) FILTER (asked = 0 AND state = 'done') AS at_once, count(*) FILTER (state = 'error') AS pending FROM t)
SELECT plans, round(done::DOUBLE / greatest(plans, 1), 4) AS conversion_rate, round(at_once::DOUBLE / greatest(plans, 1), 4) AS first_contact_resolution, pending FROM g""")  # fmt: skip
def gauges(spark, d):
    n, state = F.greatest(F.count(F.lit(1)), F.lit(1)), F.col("state")
    return traces(spark, d).agg(
        F.count(F.lit(1)).alias("plans"), F.round(F.count_if(state == "done") / n, 4).alias("conversion_rate"),
        F.round(F.count_if((state == "done") & (F.col("asked") == 0)) / n, 4).alias("first_contact_resolution"), F.count_if(state == "error").alias("pending"),
    )


def band(value: Column, good: float, fair: float, names=("ok", "warn", "critical")) -> Column:
    return F.when(value > good, names[0]).when(value > fair, names[1]).otherwise(names[2])


_BANDS = f"""{R_SQL}, x AS (SELECT tool, count(*) FILTER (status = 'success')::DOUBLE / count(*) AS success, count(*) FILTER (status = 'error')::DOUBLE / count(*) AS failed FROM r GROUP BY 1),
b AS (SELECT tool, CASE WHEN success > 0.9 THEN 'ok' WHEN success > 0.4 THEN 'warn' ELSE 'critical' END AS success_band, CASE WHEN failed < 0.05 THEN 'ok' WHEN failed < 0.3 THEN 'warn' ELSE 'critical' END AS error_band FROM x)"""


def bands(spark, d) -> DataFrame:
    n = F.count(F.lit(1))
    x = tool_records(spark, d).groupBy("tool").agg((F.count_if(F.col("status") == "success") / n).alias("s"), (F.count_if(F.col("status") == "error") / n).alias("e"))
    error = F.when(F.col("e") < 0.05, "ok").when(F.col("e") < 0.3, "warn").otherwise("critical")
    return x.select("tool", band(F.col("s"), 0.9, 0.4).alias("success_band"), error.alias("error_band"))


@query("traffic_lights", f"WITH {_BANDS} SELECT tool, success_band, error_band FROM b")
def traffic_lights(spark, d):
    return bands(spark, d)


@query("health_rollup", f"""WITH {_BANDS}, c AS (SELECT success_band AS level FROM b UNION ALL SELECT error_band FROM b)
SELECT count(*) FILTER (level = 'ok') AS ok, count(*) FILTER (level = 'warn') AS warn, count(*) FILTER (level = 'critical') AS critical, max(CASE level WHEN 'critical' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END)::INT AS exit_code FROM c""")  # fmt: skip
def health_rollup(spark, d):
    """All checks by level; the worst decides."""
    c = bands(spark, d).select(F.explode(F.array("success_band", "error_band")).alias("level"))
    n = lambda x: F.count_if(F.col("level") == x)
    worst = F.max(F.when(F.col("level") == "critical", 2).when(F.col("level") == "warn", 1).otherwise(0))
    return c.agg(n("ok").alias("ok"), n("warn").alias("warn"), n("critical").alias("critical"), worst.alias("exit_code"))


@query("trace_lookup", f"WITH {T_SQL} SELECT c_custkey, coalesce(t.user_id, -1) AS user_id, coalesce(t.state, 'none') AS state FROM customer LEFT JOIN t ON t.trace_id = c_custkey")
def trace_lookup(spark, d):
    """The trace with a given id, or none."""
    t = traces(spark, d).select(F.col("trace_id").alias("c_custkey"), "user_id", "state")
    return table(spark, d, "customer").select("c_custkey").join(t, "c_custkey", "left").fillna({"user_id": -1, "state": "none"})


@query("store_eviction", f"WITH {R_SQL} SELECT event_id, tool FROM r WHERE status IN ('success', 'degraded') ORDER BY ts DESC, event_id DESC LIMIT 10000")
def store_eviction(spark, d, capacity: int = 10_000):
    """What a store of bounded capacity holds in the end, the oldest insertion going first."""
    r = tool_records(spark, d).where(F.col("status").isin("success", "degraded"))
    return r.orderBy(F.desc("ts"), F.desc("event_id")).limit(capacity).select("event_id", "tool")


@query("cache_keys", f"WITH {R_SQL} SELECT event_id, left(sha256(tool || (k % 5 + 1)), 16) AS search_key, left(sha256(tool || '{{\"k\": ' || k || ', \"user\": ' || user_id || '}}'), 16) AS workflow_key FROM r")
def cache_keys(spark, d):
    """The first 16 hex digits of a hash of the query and the number of results, and of a
    workflow's name and its inputs as JSON with sorted keys."""
    inputs = F.format_string('{"k": %d, "user": %d}', "k", "user_id")
    key = lambda *c: F.left(F.sha2(F.concat(*c), 256), F.lit(16))
    return tool_records(spark, d).select("event_id", key("tool", (F.col("k") % 5 + 1).cast("string")).alias("search_key"), key("tool", inputs).alias("workflow_key"))


@query("event_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS iso, strftime(ts, '%Y-%m') AS month FROM events")
def event_times(spark, d):
    """Moments in UTC; microseconds only where there are some."""
    ts = F.col("ts")
    fraction = F.when(F.date_format(ts, "SSSSSS") == "000000", "").otherwise(F.date_format(ts, ".SSSSSS"))
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))
    return events(spark, d).select("event_id", iso.alias("iso"), F.left(iso, F.lit(7)).alias("month"))


@query("retry_delays", f"""WITH {R_SQL}, a AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, tool, day ORDER BY ts, event_id) AS attempt FROM r WHERE status = 'error')
SELECT event_id, attempt, CASE WHEN attempt < 3 THEN 0.5::DOUBLE * pow(2, attempt - 1) END AS delay FROM a""")  # fmt: skip
def retry_delays(spark, d):
    """Seconds to wait after each failed attempt, doubling; after the third there is no other."""
    r = tool_records(spark, d).where("status = 'error'")
    attempt = F.row_number().over(W.partitionBy("user_id", "tool", "day").orderBy("ts", "event_id"))
    a = r.select("event_id", attempt.cast("long").alias("attempt"))
    return a.withColumn("delay", F.when(F.col("attempt") < 3, F.lit(0.5) * F.pow(F.lit(2.0), F.col("attempt") - 1)))


#: Names of event types, icons of states, the words for stars.
LABELS = {"view": "浏览", "click": "点击", "purchase": "购买"}
ICONS = {"success": "✅", "degraded": "⚠️", "error": "❌", "timeout": "⏱️"}
STARS = {1: "一星", 2: "二星", 3: "三星"}


def lookup(spark, values: dict, key: str, value: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(k, v) for k, v in values.items()], [key, value]))


def _values(values: dict) -> str:
    return ", ".join(f"({k!r}, '{v}')" for k, v in values.items())


@query("event_labels", f"WITH l(event_type, label) AS (VALUES {_values(LABELS)}) SELECT coalesce(label, event_type) AS label, count(*) AS n FROM events LEFT JOIN l USING (event_type) GROUP BY 1")
def event_labels(spark, d):
    """Names in the user's language; a key without one stands for itself."""
    n = events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.join(lookup(spark, LABELS, "event_type", "label"), "event_type", "left").select(F.coalesce("label", "event_type").alias("label"), "n")


@query("step_labels", f"""WITH {S_SQL}, i(status, icon) AS (VALUES {_values(ICONS)}), l(event_type, label) AS (VALUES {_values(LABELS)}), p AS (SELECT user_id, day, count(*) FILTER (step < 3) AS planned FROM s GROUP BY 1, 2)
SELECT event_id, coalesce(icon, '❓') || ' ' || CASE WHEN step < planned THEN tool ELSE 'step ' || step END AS line FROM s LEFT JOIN i USING (status) JOIN p USING (user_id, day)""")  # fmt: skip
def step_labels(spark, d):
    """Step records beside the plan's first three steps by position, with the state's icon;
    a record beyond them is named by its number."""
    s = plan_steps(spark, d)
    planned = s.where("step < 3").select("user_id", "day", "step", F.col("tool").alias("planned"))
    s = s.join(planned, ["user_id", "day", "step"], "left").join(lookup(spark, ICONS, "status", "icon"), "status", "left")
    name = F.coalesce("planned", F.concat(F.lit("step "), F.col("step")))
    return s.select("event_id", F.concat(F.coalesce("icon", F.lit("❓")), F.lit(" "), name).alias("line"))


@query("return_cards", f"""WITH st(stars, shown) AS (VALUES {_values(STARS)}), x AS (SELECT l_orderkey, l_linenumber, (l_quantity::BIGINT % 6) AS stars, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R')
SELECT l_orderkey, l_linenumber, CASE WHEN x.stars = 0 THEN '' ELSE coalesce(shown, x.stars || '星') END AS shown, CASE WHEN x.stars <= 2 THEN '高' ELSE '中' END AS priority, CASE WHEN x.stars <= 2 THEN 'red' ELSE 'orange' END AS colour,
 CASE WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_name, 'widget') THEN 'widget' WHEN contains(p_name, 'gear') THEN 'gear' ELSE 'other' END AS kind FROM x LEFT JOIN st USING (stars)""")  # fmt: skip
def return_cards(spark, d):
    """Returned lines as cards: stars in words, priority and colour, the kind of article."""
    l = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity").cast("long") % 6).alias("stars"))  # noqa: E741
    x = l.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").join(lookup(spark, STARS, "stars", "word"), "stars", "left")
    few = F.col("stars") <= 2
    kind = F.coalesce(*[F.when(F.contains("p_name", F.lit(w)), F.lit(w)) for w in ("ring", "widget", "gear")], F.lit("other"))
    shown = F.when(F.col("stars") == 0, "").otherwise(F.coalesce("word", F.concat(F.col("stars"), F.lit("星"))))
    return x.select(
        "l_orderkey", "l_linenumber", shown.alias("shown"), F.when(few, "高").otherwise("中").alias("priority"), F.when(few, "red").otherwise("orange").alias("colour"), kind.alias("kind")
    )


@query("variant_overrides", """WITH o AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'prompt ' || c_nationkey END AS prompt, CASE c_custkey % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE END AS temperature FROM customer)
SELECT c_custkey, coalesce(nullif(prompt, ''), 'base') AS prompt, coalesce(temperature, 0.2::DOUBLE) AS temperature FROM o""")  # fmt: skip
def variant_overrides(spark, d):
    """A variant inherits what it leaves out: an empty prompt is left out, a temperature of 0 is not."""
    c, n = table(spark, d, "customer"), F.col("c_custkey")
    prompt = F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit("prompt "), F.col("c_nationkey")))
    temperature = F.when(n % 4 == 0, 0.0).when(n % 4 == 1, 0.7)
    return c.select("c_custkey", F.coalesce(F.nullif(prompt, F.lit("")), F.lit("base")).alias("prompt"), F.coalesce(temperature, F.lit(0.2)).alias("temperature"))


@query("tool_listing", f"""WITH {R_SQL}, x AS (SELECT tool, count(*) AS n, avg(elapsed_ms) AS ms FROM r GROUP BY 1)
SELECT '- ' || tool || '(calls: ' || n || '): ' || CASE WHEN ms > 50 THEN 'slow' ELSE 'fast' END || CASE WHEN n % 2 = 0 THEN ', polled' ELSE '' END AS line FROM x""")  # fmt: skip
def tool_listing(spark, d):
    """Tools as a prompt lists them, with a hint on how long they take."""
    x = tool_records(spark, d).groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.avg("elapsed_ms").alias("ms"))
    hint = F.concat(F.when(F.col("ms") > 50, "slow").otherwise("fast"), F.when(F.col("n") % 2 == 0, ", polled").otherwise(""))
    return x.select(F.concat(F.lit("- "), "tool", F.lit("(calls: "), F.col("n"), F.lit("): "), hint).alias("line"))


def upsert(base: DataFrame, changes: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """``base`` with ``changes`` by key (one row each): values given replace those there were,
    a key that was not there is added with ``defaults`` for what is not given."""
    both = base.alias("b").join(changes.alias("c"), key, "full")
    given = lambda n: [F.col(f"c.{n}")] if n in changes.columns else []
    return both.select(key, *[F.coalesce(*given(n), F.col(f"b.{n}"), defaults.get(n, F.lit(None))).alias(n) for n in base.columns if n != key])


@query("ticket_upsert", f"""WITH {E_SQL}, u AS (SELECT event_id AS k2, max_by(CASE event_type WHEN 'purchase' THEN '已处理' WHEN 'error' THEN '处理中' END, event_id) AS status, max(CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END) AS handled FROM e GROUP BY 1 HAVING max(event_type) IN ('purchase', 'error'))
SELECT coalesce(o_orderkey, k2) AS ticket, coalesce(u.status, CASE WHEN o_orderkey IS NULL THEN '待处理' ELSE o_orderstatus END) AS status, CAST(handled AS VARCHAR) AS handled, coalesce(o_orderpriority, 'none') AS priority FROM orders FULL JOIN u ON o_orderkey = k2""")  # fmt: skip
def ticket_upsert(spark, d):
    """Tickets updated by key: the time of handling is set only with the state that means it."""
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("ticket"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("handled"), F.col("o_orderpriority").alias("priority"))
    e = events(spark, d).where(F.col("event_type").isin("purchase", "error"))
    bought = F.col("event_type") == "purchase"
    u = e.select(F.col("event_id").alias("ticket"), F.when(bought, "已处理").otherwise("处理中").alias("status"), F.when(bought, F.to_date("ts").cast("string")).alias("handled"))
    return upsert(base, u, "ticket", {"status": F.lit("待处理"), "priority": F.lit("none")})
