"""What is kept of users and runs: memory that fits a question, traces as nested records, a
log of trace operations, all messages on a plan, and the summary of a stress run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.operators.graphs import longest_paths, plan_dependencies
from quillstream.operators.plans import allowed_tools
from quillstream.operators.result_rules import _CALL_SQL, TOOL_PARAMS, schema_errors
from quillstream.operators.text import _KW, keywords
from quillstream.plans.registry import query
from quillstream.sources.tables import CONFIRMATION_TOOLS, INTENTS, R_SQL, S_SQL, T_SQL, TOOLS, WHITELIST, plan_steps, table, tool_records, traces

# ---------------------------------------------------------------- memory that fits a question


def matching_preferences(prefs: Column, words: Column) -> Column:
    """Of preferences (map of any keys to VARIANT) those whose key and value, written one after
    the other, hold one of the words."""
    return F.map_filter(prefs, lambda k, v: F.exists(words, lambda w: F.contains(F.concat(k, v.cast("string")), w)))


def as_dict(prefs: Column) -> Column:
    """A map as Python writes a dict: texts in quotes, numbers as they are."""
    shown = lambda e: F.when(F.schema_of_variant(e["value"]) == "STRING", F.concat(F.lit("'"), e["value"].cast("string"), F.lit("'"))).otherwise(e["value"].cast("string"))
    items = F.transform(F.map_entries(prefs), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), shown(e)))
    return F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))


def relevant_conversation(intent: Column, said: Column, wanted_intent: Column, words: Column) -> Column:
    """The same intent, unless it is empty, or a keyword in common."""
    return ((wanted_intent != "") & (intent == wanted_intent)) | F.arrays_overlap(keywords(said), words)


def question_memory(users: DataFrame, purchases: DataFrame, conversations: DataFrame, max_chars: int = 300) -> DataFrame:
    """user_id, tier2: what is known of a user that fits the question.

    ``users``: user_id, question, intent, prefs (map<string, variant>); ``purchases``: user_id,
    nth, product, line; ``conversations``: user_id, nth, intent, said.  At most three purchases
    whose product holds a keyword; at most two conversations if over 50 characters are left,
    and preferences if over 30 are, each if its block fits in.  Only purchases take room.
    """
    users = users.withColumn("words", keywords(F.col("question")))
    asks = users.select("user_id", "words", F.col("intent").alias("wanted"))
    firsts = lambda n: F.transform(F.slice(F.array_sort(F.collect_list(F.struct("nth", "line"))), 1, n), lambda x: x["line"])
    bought = purchases.join(asks, "user_id").where(F.exists("words", lambda w: F.contains(F.col("product"), w)))
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("nth"))
    bought = bought.withColumn("n", nth).where("n <= 3").groupBy("user_id").agg(F.concat(F.lit("历史购买: "), F.array_join(firsts(3), " | ")).alias("b1"))
    talked = conversations.join(asks, "user_id").where(relevant_conversation(F.col("intent"), F.col("said"), F.col("wanted"), F.col("words")))
    talked = talked.withColumn("n", nth).where("n <= 2").withColumn("line", F.concat(F.lit("曾问: "), F.left("said", F.lit(80))))
    talked = talked.groupBy("user_id").agg(F.concat(F.lit("相关对话: "), F.array_join(firsts(2), "; ")).alias("b2"))
    likes = matching_preferences(F.col("prefs"), F.col("words"))
    both = users.join(bought, "user_id", "left").join(talked, "user_id", "left").withColumn("likes", likes)
    room = F.lit(max_chars) - F.coalesce(F.length("b1"), F.lit(0))
    b3 = F.when(F.size("likes") > 0, F.concat(F.lit("相关偏好: "), as_dict(F.col("likes"))))
    if_room = lambda block, least: F.when((room > least) & (F.length(block) <= room), block)
    return both.select("user_id", F.concat_ws("\n", "b1", if_room(F.col("b2"), 50), if_room(b3, 30)).alias("tier2"))


_PRIOS = ["URGENT", "HIGH", "MEDIUM", "LOW", "SPECIFIED"]
_QUESTION = f"'any ' || c_mktsegment || ', ' || element_at(array({', '.join(repr(p) for p in _PRIOS)}), CAST(c_custkey % 5 AS INT) + 1) || ' 12?'"
_PREFS = """'{' || concat_ws(',', '"segment":"' || c_mktsegment || '"', CASE c_custkey % 3 WHEN 0 THEN '"' || lower(c_mktsegment) || '_budget":' || c_custkey * 10 WHEN 1 THEN '"URGENT":true' END,
 CASE c_custkey % 4 WHEN 0 THEN '"colour":"any red"' WHEN 1 THEN '"sizes":12' END, CASE c_custkey % 7 WHEN 0 THEN '"none":null' END) || '}'"""


@query("memory_by_question", f"""WITH c AS (SELECT c_custkey, {_QUESTION.replace("element_at(array(", "list_extract([").replace(f"{_PRIOS[-1]!r})", f"{_PRIOS[-1]!r}]")} AS text, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE list_extract({INTENTS}, c_custkey % 5 + 1) END AS intent, {_PREFS} AS j FROM customer),
k AS (SELECT c_custkey, intent, j, {_KW} AS words FROM c),
b AS (SELECT c_custkey, '历史购买: ' || string_agg(line, ' | ' ORDER BY o_orderkey) AS block FROM (SELECT c_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m') || ' ' || o_orderpriority || ' ¥' || floor(o_totalprice)::BIGINT AS line
  FROM orders JOIN k ON o_custkey = c_custkey WHERE len(list_filter(words, lambda w: contains(o_orderpriority, w))) > 0 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) <= 3) GROUP BY 1),
q AS (SELECT c_custkey, '相关对话: ' || string_agg('曾问: ' || left(said, 80), '; ' ORDER BY turn) AS block FROM (SELECT c_custkey, turn, text AS said
  FROM (SELECT k.c_custkey, k.words, k.intent, turn, coalesce(t.text, '') AS text FROM conversations t JOIN k ON conv_id = c_custkey WHERE role = 'user')
  WHERE (intent <> '' AND intent = list_extract({INTENTS}, turn % 5 + 1)) OR len(list_intersect({_KW}, words)) > 0 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY turn) <= 2) GROUP BY 1),
p AS (SELECT c_custkey, words, unnest(json_keys(j)) AS key, unnest(range(len(json_keys(j)))) AS nth, j FROM k),
m AS (SELECT c_custkey, '相关偏好: {{' || string_agg('''' || key || ''': ' || CASE WHEN json_type(j, '$.' || key) = 'VARCHAR' THEN '''' || json_extract_string(j, '$.' || key) || '''' ELSE json_extract_string(j, '$.' || key) END, ', ' ORDER BY nth) || '}}' AS block
  FROM p WHERE len(list_filter(words, lambda w: contains(key || json_extract_string(j, '$.' || key), w))) > 0 GROUP BY 1),
x AS (SELECT k.c_custkey, b.block AS b1, q.block AS b2, m.block AS b3, 300 - coalesce(length(b.block), 0) AS room FROM k LEFT JOIN b USING (c_custkey) LEFT JOIN q USING (c_custkey) LEFT JOIN m USING (c_custkey))
SELECT c_custkey AS user_id, concat_ws(chr(10), b1, CASE WHEN room > 50 AND length(b2) <= room THEN b2 END, CASE WHEN room > 30 AND length(b3) <= room THEN b3 END) AS tier2 FROM x""")  # fmt: skip
def memory_by_question(spark, d):
    """Each customer's purchases, conversations and preferences that fit a question of theirs."""
    c = table(spark, d, "customer")
    intent = lambda i: F.element_at(F.array(*map(F.lit, INTENTS)), (i % 5 + 1).cast("int"))
    users = c.select(
        F.col("c_custkey").alias("user_id"), F.expr(_QUESTION).alias("question"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(intent(F.col("c_custkey"))).alias("intent"),
        F.from_json(F.expr(_PREFS), "map<string,variant>").alias("prefs"),
    )
    line = F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit(" "), "o_orderpriority", F.lit(" ¥"), F.floor("o_totalprice").cast("string"))
    purchases = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("nth"), F.col("o_orderpriority").alias("product"), line.alias("line"))
    said = table(spark, d, "conversations").where("role = 'user'")
    said = said.select(F.col("conv_id").alias("user_id"), F.col("turn").alias("nth"), intent(F.col("turn")).alias("intent"), F.coalesce("text", F.lit("")).alias("said"))
    return question_memory(users, purchases, said)


# ---------------------------------------------------------------- traces


def trace_records(steps: DataFrame, keys: Sequence[str], message: Column, cut: int = 200) -> DataFrame:
    """A nested record of each trace: message and summaries cut to ``cut`` characters, phases,
    plan steps and tool records as arrays of structs in the order of the steps."""
    in_order = lambda x: F.array_sort(F.collect_list(x))
    t = steps.groupBy(*keys).agg(
        F.min("event_id").alias("trace_id"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.first(message).alias("message"),
        in_order(F.struct("step", F.col("tool").alias("phase"), F.col("elapsed_ms").alias("duration_ms"))).alias("phases"),
        in_order(F.struct("step", F.array("tool").alias("actions"), F.array("dep").alias("depends_on"))).alias("plan_steps"),
        in_order(F.struct("step", "tool", "status", "summary", "elapsed_ms", F.when(F.col("status") == "error", F.lit("failed")).alias("error"))).alias("tool_records"),
    )
    short = F.transform("tool_records", lambda r: r.withField("summary", F.left(r["summary"], F.lit(cut))))
    ms = F.timestamp_diff("MICROSECOND", F.col("started"), F.col("ended")) / 1000.0
    return t.select(*keys, "trace_id", F.left("message", F.lit(cut)).alias("user_message"), ms.alias("duration_ms"), "phases", "plan_steps", short.alias("tool_records"))


@query("trace_projection", f"""WITH {S_SQL} SELECT min(event_id) AS trace_id, left('message of user ' || user_id || repeat(' and so on', count(*)::INT * 9), 200) AS user_message, date_diff('microsecond', min(ts), max(ts)) / 1000.0::DOUBLE AS duration_ms,
 string_agg(tool, ',' ORDER BY step) FILTER (step < 5) AS phases, string_agg(step || ':' || tool || '<' || dep, ',' ORDER BY step) AS plan_steps,
 string_agg(step || ' ' || tool || ' ' || status || ' ' || left(repeat(tool || ' found ' || k || '; ', (k % 30)::INT), 200) || CASE WHEN status = 'error' THEN ' failed' ELSE '' END, '|' ORDER BY step) AS tool_records FROM s GROUP BY user_id, day""")  # fmt: skip
def trace_projection(spark, d):
    """Traces as records, here with their arrays as text and the first five phases."""
    s = plan_steps(spark, d).withColumn("summary", F.repeat(F.concat("tool", F.lit(" found "), F.col("k").cast("string"), F.lit("; ")), (F.col("k") % 30).cast("int")))
    message = F.concat(F.lit("message of user "), F.col("user_id").cast("string"), F.repeat(F.lit(" and so on"), (F.col("n") * 9).cast("int")))
    t = trace_records(s, ["user_id", "day"], message)
    text = lambda c, f, by: F.array_join(F.transform(c, f), by)
    number = lambda x: x.cast("string")
    steps = text("plan_steps", lambda p: F.concat(number(p["step"]), F.lit(":"), F.array_join(p["actions"], "+"), F.lit("<"), F.array_join(p["depends_on"].cast("array<string>"), "+")), ",")
    found = text("tool_records", lambda r: F.concat(number(r["step"]), F.lit(" "), r["tool"], F.lit(" "), r["status"], F.lit(" "), r["summary"], F.coalesce(F.concat(F.lit(" "), r["error"]), F.lit(""))), "|")
    return t.select("trace_id", "user_message", "duration_ms", F.array_join(F.slice("phases", 1, 5)["phase"], ",").alias("phases"), steps.alias("plan_steps"), found.alias("tool_records"))


def replay_traces(log: DataFrame) -> DataFrame:
    """The state of each trace after a log (trace, ts, nth, op: start, phase or complete, state).

    The first start makes a trace; what comes before it, or without one, changes nothing and
    is counted as dropped; phases are added, and the last completion counts.
    """
    began = F.min(F.when(F.col("op") == "start", F.struct("ts", "nth"))).over(W.partitionBy("trace"))
    log = log.withColumn("known", F.coalesce(F.struct("ts", "nth") >= began, F.lit(False)))
    of = lambda op: F.col("known") & (F.col("op") == op)
    end = F.max(F.when(of("complete"), F.struct("ts", "nth", "state")))
    return log.groupBy("trace").agg(
        F.bool_or("known").alias("stored"), F.count_if(of("phase")).alias("phases"), F.coalesce(end["state"], F.lit("running")).alias("state"),
        F.count_if(~F.col("known")).alias("dropped"),
    )


_OP = "CASE k % 4 WHEN 0 THEN 'start' WHEN 3 THEN 'complete' ELSE 'phase' END"


@query("trace_log_replay", f"""WITH {R_SQL}, l AS (SELECT user_id || '-' || k % 7 AS trace, ts, event_id, {_OP} AS op, status FROM r),
b AS (SELECT *, min(ts) FILTER (op = 'start') OVER (PARTITION BY trace) AS began FROM l),
g AS (SELECT *, coalesce(ts >= began, false) AS known FROM b)
SELECT trace, bool_or(known) AS stored, count(*) FILTER (known AND op = 'phase') AS phases, coalesce(arg_max(status, ts) FILTER (known AND op = 'complete'), 'running') AS state, count(*) FILTER (NOT known) AS dropped FROM g GROUP BY 1""")  # fmt: skip
def trace_log_replay(spark, d):
    """Operations on traces, those on unknown ones without effect."""
    r = tool_records(spark, d)
    trace = F.concat(F.col("user_id").cast("string"), F.lit("-"), (F.col("k") % 7).cast("string"))
    return replay_traces(r.select(trace.alias("trace"), "ts", F.col("event_id").alias("nth"), F.expr(_OP).alias("op"), F.col("status").alias("state")))


# ---------------------------------------------------------------- plans


def plan_messages(steps: DataFrame, spark) -> DataFrame:
    """user_id, day, step, kind, message: all that is wrong with plans, in one union.

    A dependency that is negative, missing or not before its step; a tool that nobody has; an
    input against its tool's parameters; steps that a cycle keeps from running (one row a
    plan, step -1); a tool that the plan's intent does not allow, where the intent is known.
    """
    row = lambda x, kind, message: x.select("user_id", "day", F.col("step").cast("long").alias("step"), F.lit(kind).alias("kind"), message.alias("message"))
    dep = F.col("dep")
    why = F.when(dep < 0, "negative").when(dep >= F.col("n"), "missing").otherwise("forward")
    ranges = row(steps.where((dep < 0) | (dep >= F.col("step"))), "dependency", why)
    unknown = row(steps.where(~F.col("tool").isin(TOOLS)), "tool", F.concat(F.lit("unknown tool "), "tool"))
    params = spark.createDataFrame([(i, *p) for i, p in enumerate(TOOL_PARAMS)], "position int, tool string, field string, type string, required boolean")
    inputs = schema_errors(steps, params, ["user_id", "day", "step"])
    inputs = row(inputs.where("errors != ''"), "input", F.col("errors"))
    stuck = F.size(F.filter(longest_paths(F.col("deps")), lambda x: x < 0))
    cycles = plan_dependencies(steps).select("user_id", "day", F.lit(-1).alias("step"), stuck.alias("stuck")).where("stuck > 0")
    cycles = row(cycles, "cycle", F.concat(F.lit("circular: "), F.col("stuck").cast("string"), F.lit(" steps")))
    audited = steps.where(F.col("intent").isin(list(WHITELIST)))
    audit = row(audited.join(F.broadcast(allowed_tools(spark)), ["intent", "tool"], "left_anti"), "whitelist", F.concat("tool", F.lit(" not for "), "intent"))
    return ranges.union(unknown).union(inputs).union(cycles).union(audit)


_PLAN_TOOL, _PLAN_INTENT = "CASE WHEN k % 19 = 0 THEN 'teleport' ELSE tool END", "CASE user_id % 9 WHEN 7 THEN '' WHEN 8 THEN 'smalltalk' ELSE intent END"


def _messages_sql() -> str:
    from quillstream.operators.plans import _PAIRS
    from quillstream.plans.registry import SQL

    checks = SQL["schema_from_table"]
    fixed = checks[checks.index("p(position") : checks.index("c AS (SELECT event_id")]
    rest = checks[checks.index("g AS (SELECT event_id, tool") : checks.rindex("SELECT event_id, tool, string_agg")].rstrip()
    return f"""WITH RECURSIVE {S_SQL}, x AS (SELECT user_id, day, event_id, k, step, n, dep, {_PLAN_TOOL} AS tool, {_PLAN_INTENT} AS intent FROM s), {fixed}
c AS (SELECT event_id, tool, {_CALL_SQL} AS j FROM x), {rest},
edges AS (SELECT user_id, day, n, step, dep FROM s WHERE dep >= 0 AND dep < n UNION SELECT user_id, day, n, step, step - 2 FROM s WHERE k % 4 = 0 AND step >= 2),
walk AS (SELECT user_id, day, n, step, step AS at, 0 AS len FROM s UNION SELECT w.user_id, w.day, w.n, w.step, e.dep, w.len + 1 FROM walk w JOIN edges e ON e.user_id = w.user_id AND e.day = w.day AND e.step = w.at WHERE w.len < w.n),
lv AS (SELECT user_id, day, step FROM walk GROUP BY user_id, day, n, step HAVING max(len) >= n)
SELECT user_id, day, step, 'dependency' AS kind, CASE WHEN dep < 0 THEN 'negative' WHEN dep >= n THEN 'missing' ELSE 'forward' END AS message FROM x WHERE dep < 0 OR dep >= step
UNION ALL SELECT user_id, day, step, 'tool', 'unknown tool ' || tool FROM x WHERE tool = 'teleport'
UNION ALL SELECT user_id, day, step, 'input', string_agg(message, '; ' ORDER BY part, nth) FROM m JOIN x USING (event_id) GROUP BY 1, 2, 3
UNION ALL SELECT user_id, day, -1, 'cycle', 'circular: ' || count(*) || ' steps' FROM lv GROUP BY 1, 2
UNION ALL SELECT user_id, day, step, 'whitelist', tool || ' not for ' || intent FROM x WHERE intent NOT IN ('', 'smalltalk') AND (intent, tool) NOT IN (VALUES {_PAIRS})"""


@query("plan_messages", _messages_sql())
def all_plan_messages(spark, d):
    """Every message on every plan; plans without an intent, or of an unknown one, are not audited."""
    s = plan_steps(spark, d).withColumn("input", F.expr(_CALL_SQL)).withColumn("tool", F.expr(_PLAN_TOOL)).withColumn("intent", F.expr(_PLAN_INTENT))
    return plan_messages(s, spark)


@query("plan_lints", f"""WITH {S_SQL}, g AS (SELECT user_id, day, max(n) AS n, min(k % 100) FILTER (step = 0) AS clarity, max(event_id % 2) FILTER (step = 0) AS asks, count(*) FILTER (elapsed_ms > 50 AND step < n - 1) AS slow_early,
  count(*) FILTER (tool IN ('{"', '".join(CONFIRMATION_TOOLS)}')) AS confirm FROM s GROUP BY 1, 2)
SELECT user_id, day, concat_ws(',', CASE WHEN slow_early > 0 THEN 'slow_before_end:' || slow_early END, CASE WHEN clarity < 70 AND asks = 0 THEN 'unclear_without_question' END, CASE WHEN clarity >= 85 AND asks = 1 THEN 'clear_with_question' END) AS lints
FROM g WHERE slow_early > 0 OR (clarity < 70 AND asks = 0) OR (clarity >= 85 AND asks = 1)""")  # fmt: skip
def plan_lints(spark, d):
    """Advice on plans, never enforced: slow tools stand last, an unclear plan (below 0.7) asks
    back, and a clear one (0.85 and more) does not."""
    first = lambda c: F.min(F.when(F.col("step") == 0, c))
    g = plan_steps(spark, d).groupBy("user_id", "day").agg(
        first(F.col("k") % 100).alias("clarity"), first(F.col("event_id") % 2).alias("asks"), F.count_if((F.col("elapsed_ms") > 50) & (F.col("step") < F.col("n") - 1)).alias("slow"),
    )
    slow = F.when(F.col("slow") > 0, F.concat(F.lit("slow_before_end:"), F.col("slow").cast("string")))
    unclear, clear = F.when((F.col("clarity") < 70) & (F.col("asks") == 0), "unclear_without_question"), F.when((F.col("clarity") >= 85) & (F.col("asks") == 1), "clear_with_question")
    return g.select("user_id", "day", F.concat_ws(",", slow, unclear, clear).alias("lints")).where("lints != ''")


# ---------------------------------------------------------------- runs and questions


@query("stress_summary", f"""WITH {T_SQL}, p AS (SELECT CASE WHEN asked = 1 THEN 'clarification' ELSE 'full_execution' END AS path, ms FROM t), w AS (SELECT count(*) AS total, date_diff('microsecond', min(started), max(ended)) / 1000000.0::DOUBLE AS wall FROM t),
o AS (SELECT path, ms, row_number() OVER (PARTITION BY path ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY path) AS n FROM p),
q AS (SELECT path, max(n) AS runs, max(ms) FILTER (i = least(n * 50 // 100, n - 1)) AS p50_ms, max(ms) FILTER (i = least(n * 99 // 100, n - 1)) AS p99_ms FROM o GROUP BY 1),
r2 AS (SELECT round(avg((status = 'success')::INT), 4) AS success_rate, round(avg((status = 'degraded')::INT), 4) AS degraded_rate FROM r)
SELECT path, runs, p50_ms, p99_ms, total, round(wall, 2) AS wall_s, round(total / wall, 6) AS throughput_rps, success_rate, degraded_rate FROM q, w, r2""")  # fmt: skip
def stress_summary(spark, d):
    """Runs by path with their percentiles, and the whole run's throughput and rates.  Counts by
    duration are combined before the shuffle and ordered inside parts of 65 seconds."""
    t = traces(spark, d).withColumn("path", F.when(F.col("asked") == 1, "clarification").otherwise("full_execution"))
    wall = F.timestamp_diff("MICROSECOND", F.min("started"), F.max("ended")) / 1000000.0
    whole = t.agg(F.count(F.lit(1)).alias("total"), wall.alias("wall"))
    rate = lambda s: F.round(F.avg((F.col("status") == s).cast("int")), 4)
    tools = tool_records(spark, d).agg(rate("success").alias("success_rate"), rate("degraded").alias("degraded_rate"))
    by = t.groupBy("path", "ms").agg(F.count(F.lit(1)).alias("c")).withColumn("part", F.floor(F.col("ms") / 65536))
    parts = by.groupBy("path", "part").agg(F.sum("c").alias("pc"))
    of_path = W.partitionBy("path")
    parts = parts.select("path", "part", (F.sum("pc").over(of_path.orderBy("part")) - F.col("pc")).alias("before"), F.sum("pc").over(of_path).alias("n"))
    by = by.join(parts, ["path", "part"]).withColumn("upto", F.col("before") + F.sum("c").over(W.partitionBy("path", "part").orderBy("ms")))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1), F.col("ms")))
    q = by.groupBy("path").agg(F.max("n").alias("runs"), at(50).alias("p50_ms"), at(99).alias("p99_ms"))
    q = q.join(F.broadcast(whole)).join(F.broadcast(tools))  # one row each
    return q.select("path", "runs", "p50_ms", "p99_ms", "total", F.round("wall", 2).alias("wall_s"), F.round(F.col("total") / F.col("wall"), 6).alias("throughput_rps"), "success_rate", "degraded_rate")


@query("funnel_from_rates", f"""WITH {T_SQL}, s AS (SELECT count(*) AS total, round(avg((asked = 1)::INT), 4) AS clarified, round(avg((state = 'done')::INT), 4) AS done FROM t)
SELECT stage, n, round(100.0::DOUBLE * n / greatest(total, 1), 4) AS pct FROM (SELECT total, unnest(['total', 'clarified', 'done']) AS stage, unnest([total, trunc(clarified * total)::BIGINT, trunc(done * total)::BIGINT]) AS n FROM s)""")  # fmt: skip
def funnel_from_rates(spark, d):
    """The funnel as a dashboard has it: counts are got back from rounded rates, cut to whole numbers."""
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    s = traces(spark, d).agg(F.count(F.lit(1)).alias("total"), share(F.col("asked") == 1).alias("clarified"), share(F.col("state") == "done").alias("done"))
    s = s.select("total", F.expr("stack(3, 'total', total, 'clarified', CAST(clarified * total AS BIGINT), 'done', CAST(done * total AS BIGINT)) AS (stage, n)"))
    return s.select("stage", "n", F.round(F.lit(100.0) * F.col("n") / F.greatest("total", F.lit(1)), 4).alias("pct"))


#: Fixed value: an asked-back request, enriched with the answer.
ENRICHED = ("【原始请求】", "\n【用户补充说明】", "\n请基于以上完整信息重新规划。")


@query("clarified_queries", f"""SELECT conv_id, turn, '{ENRICHED[0]}' || coalesce(text, '') || chr(10) || '{ENRICHED[1][1:]}' || coalesce(answer, '') || chr(10) || '{ENRICHED[2][1:]}' AS enriched
FROM (SELECT conv_id, turn, text, lead(text) OVER w AS answer, row_number() OVER w AS n FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE n = 1""")  # fmt: skip
def clarified_queries(spark, d):
    """The first request of each conversation with what the user said next."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").where("role = 'user'")
    c = c.select("conv_id", "turn", "text", F.lead("text").over(w).alias("answer"), F.row_number().over(w).alias("n")).where("n = 1")
    said = lambda x: F.coalesce(x, F.lit(""))
    return c.select("conv_id", "turn", F.concat(F.lit(ENRICHED[0]), said("text"), F.lit(ENRICHED[1]), said("answer"), F.lit(ENRICHED[2])).alias("enriched"))


#: Profiles of tools for the flags below: expected and longest time, in milliseconds of the data.
PROFILES = [(t, 20 + 5 * i, 60 + 10 * i) for i, t in enumerate(TOOLS)]
_PROFILES_SQL = ", ".join(f"('{t}', {a}, {b})" for t, a, b in PROFILES)


@query("overdue_calls", f"""WITH {S_SQL}, p(tool, expected_ms, max_ms) AS (VALUES {_PROFILES_SQL})
SELECT tool, expected_ms, max_ms, count(*) AS calls, count(*) FILTER (elapsed_ms > expected_ms) AS slower, count(*) FILTER (elapsed_ms > max_ms) AS overdue FROM s JOIN p USING (tool) GROUP BY 1, 2, 3""")  # fmt: skip
def overdue_calls(spark, d):
    """Calls that took longer than their tool's profile expects, and longer than it allows."""
    p = F.broadcast(spark.createDataFrame(PROFILES, "tool string, expected_ms int, max_ms int"))
    g = plan_steps(spark, d).join(p, "tool").groupBy("tool", "expected_ms", "max_ms")
    return g.agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("elapsed_ms") > F.col("expected_ms")).alias("slower"), F.count_if(F.col("elapsed_ms") > F.col("max_ms")).alias("overdue"))


@query("replan_rounds", f"""WITH {S_SQL}, g AS (SELECT intent, least(count(*) FILTER (dep < 0 OR dep >= step), 2) AS replans, least(count(*) FILTER (status = 'error'), 3) AS reflections FROM s GROUP BY user_id, day, intent)
SELECT intent, replans, reflections, count(*) AS plans FROM g GROUP BY 1, 2, 3""")  # fmt: skip
def replan_rounds(spark, d):
    """How often plans would have been made anew: at most twice for their messages, and thought
    over at most three times for failed calls."""
    bad = F.count_if((F.col("dep") < 0) | (F.col("dep") >= F.col("step")))
    g = plan_steps(spark, d).groupBy("user_id", "day", "intent").agg(F.least(bad, F.lit(2)).alias("replans"), F.least(F.count_if(F.col("status") == "error"), F.lit(3)).alias("reflections"))
    return g.groupBy("intent", "replans", "reflections").agg(F.count(F.lit(1)).alias("plans"))
