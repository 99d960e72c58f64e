"""Checks of plans: which tools an intent allows, dependencies, cycles, rules between steps,
inputs against schemas, and plans that arrive as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.plans.registry import query
from quillstream.sources.tables import CONFIRMATION_TOOLS, R_SQL, S_SQL, TOOLS, WHITELIST, plan_steps, tool_records

_PAIRS = ", ".join(f"('{i}', '{t}')" for i, tools in WHITELIST.items() for t in tools)
_A = f"a(intent, tool) AS (VALUES {_PAIRS})"


def allowed_tools(spark) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, tools in WHITELIST.items() for t in tools], "intent string, tool string")


@query("whitelist_violations", f"WITH {S_SQL}, {_A} SELECT user_id, day, step, intent, tool FROM s WHERE (intent, tool) NOT IN (SELECT intent, tool FROM a)")
def whitelist_violations(spark, d):
    """Steps whose tool their plan's intent does not allow."""
    return plan_steps(spark, d).join(F.broadcast(allowed_tools(spark)), ["intent", "tool"], "left_anti").select("user_id", "day", "step", "intent", "tool")


@query("whitelist_coverage", f"""WITH {S_SQL}, {_A}, u AS (SELECT intent, count(*) AS calls, count(DISTINCT tool) AS used, count(*) FILTER ((intent, tool) IN (SELECT intent, tool FROM a)) AS allowed_calls FROM s GROUP BY 1)
SELECT intent, count(tool) AS allowed, bool_or(tool = 'rag_search') AS has_search, coalesce(max(calls), 0) AS calls, coalesce(max(used), 0) AS used, coalesce(max(allowed_calls), 0) AS allowed_calls FROM a LEFT JOIN u USING (intent) GROUP BY 1""")  # fmt: skip
def whitelist_coverage(spark, d):
    a = allowed_tools(spark)
    by_pair = plan_steps(spark, d).groupBy("intent", "tool").agg(F.count(F.lit(1)).alias("n"))  # intents x tools rows
    u = by_pair.join(F.broadcast(a.withColumn("ok", F.lit(True))), ["intent", "tool"], "left").groupBy("intent")
    u = u.agg(F.sum("n").alias("calls"), F.count(F.lit(1)).alias("used"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("allowed_calls"))
    out = a.groupBy("intent").agg(F.count("tool").alias("allowed"), F.bool_or(F.col("tool") == "rag_search").alias("has_search")).join(u, "intent", "left")
    return out.fillna(0, ["calls", "used", "allowed_calls"])


_CONFIRM = ", ".join(f"'{t}'" for t in CONFIRMATION_TOOLS)


@query("confirmation_plans", f"WITH {S_SQL} SELECT user_id, day, string_agg(tool, ',' ORDER BY step) FILTER (tool IN ({_CONFIRM})) AS confirm, count(*) AS steps FROM s GROUP BY 1, 2 HAVING bool_or(tool IN ({_CONFIRM}))")
def confirmation_plans(spark, d):
    """Plans that wait for the user, with the tools that need it in order."""
    needs = F.col("tool").isin(CONFIRMATION_TOOLS)
    asked = F.array_sort(F.collect_list(F.when(needs, F.struct("step", "tool"))))
    g = plan_steps(spark, d).groupBy("user_id", "day").agg(asked.alias("a"), F.count(F.lit(1)).alias("steps"))
    return g.where(F.size("a") > 0).select("user_id", "day", F.array_join(F.col("a.tool"), ",").alias("confirm"), "steps")


@query("supply_chain_lint", f"WITH {S_SQL} SELECT user_id, day, count(*) AS steps FROM s WHERE intent = 'supply_chain' GROUP BY 1, 2 HAVING NOT bool_or(tool IN ('order_lookup', 'order_create', 'crm_create_return'))")
def supply_chain_lint(spark, d):
    """Supply-chain plans without a tool for orders or returns."""
    g = plan_steps(spark, d).where("intent = 'supply_chain'").groupBy("user_id", "day")
    g = g.agg(F.count(F.lit(1)).alias("steps"), F.bool_or(F.col("tool").isin("order_lookup", "order_create", "crm_create_return")).alias("ok"))
    return g.where(~F.col("ok")).drop("ok")


@query("mutating_calls", f"WITH {S_SQL} SELECT tool, status, count(*) AS n FROM s WHERE tool IN ('order_create', 'crm_create_return', 'crm_send_coupon') GROUP BY 1, 2")
def mutating_calls(spark, d):
    """Calls that change something, the only ones that are guarded against repetition."""
    return plan_steps(spark, d).where(F.col("tool").isin("order_create", "crm_create_return", "crm_send_coupon")).groupBy("tool", "status").agg(F.count(F.lit(1)).alias("n"))


@query("clarity_gate", f"WITH {S_SQL} SELECT intent, count(*) AS plans, count(*) FILTER (k % 100 / 100.0::DOUBLE < 0.7::DOUBLE) AS unclear FROM s WHERE step = 0 GROUP BY 1")
def clarity_gate(spark, d):
    """Plans whose clarity, here of the first step, is below 0.7, which is asked back."""
    p = plan_steps(spark, d).where("step = 0").groupBy("intent")
    return p.agg(F.count(F.lit(1)).alias("plans"), F.count_if(F.col("k") % 100 / F.lit(100.0) < 0.7).alias("unclear"))


@query("unsatisfied_dependencies", f"""WITH {S_SQL} SELECT user_id, day, step, dep FROM s x WHERE dep >= 0
 AND NOT EXISTS (SELECT 1 FROM s y WHERE y.user_id = x.user_id AND y.day = x.day AND y.step = x.dep AND y.step < x.step AND y.status <> 'error')""")  # fmt: skip
def unsatisfied_dependencies(spark, d):
    """Steps whose dependency had not been carried out when they began."""
    s = plan_steps(spark, d)
    ran = s.where("status != 'error'").select("user_id", "day", F.col("step").alias("dep"))
    late = (F.col("dep") >= F.col("step")) & (F.col("dep") >= 0)
    x = s.select("user_id", "day", "step", "dep")
    return x.where(late).unionByName(x.where(~late & (F.col("dep") >= 0)).join(ran, ["user_id", "day", "dep"], "left_anti"))


def unfinished(deps: Column) -> Column:
    """How many steps of a plan are on or behind a cycle, given for each step the list of
    steps it depends on (those that the plan has not are no dependency): in every round the
    steps whose dependencies are all done are done."""
    none_done = F.transform(deps, lambda _: F.lit(False))

    def round_(done: Column, _: Column) -> Column:
        ready = lambda of: F.forall(of, lambda x: (x < 0) | (x >= F.size(deps)) | F.get(done, x.cast("int")))
        return F.zip_with(done, deps, lambda was, of: was | ready(of))

    done = F.aggregate(F.sequence(F.lit(1), F.size(deps)), none_done, round_)
    return F.size(F.filter(done, lambda x: ~x))


@query("plan_cycles", f"""WITH RECURSIVE {S_SQL}, edges AS (SELECT user_id, day, step, dep, n FROM s WHERE dep >= 0 AND dep < n),
walk AS (SELECT user_id, day, step, dep, n, 1 AS len FROM edges
 UNION ALL SELECT w.user_id, w.day, w.step, e.dep, w.n, w.len + 1 FROM walk w JOIN edges e ON e.user_id = w.user_id AND e.day = w.day AND e.step = w.dep WHERE w.len <= w.n),
bad AS (SELECT user_id, day, count(DISTINCT step) AS caught FROM walk WHERE len > n GROUP BY 1, 2)
SELECT user_id, day, caught FROM bad""")  # fmt: skip
def plan_cycles(spark, d):
    """Plans with circular dependencies, and how many steps never become ready."""
    deps = F.transform(F.array_sort(F.collect_list(F.struct("step", "dep"))), lambda x: F.array(x["dep"]))
    p = plan_steps(spark, d).groupBy("user_id", "day").agg(deps.alias("deps"))  # one plan's steps
    return p.select("user_id", "day", unfinished(F.col("deps")).cast("long").alias("caught")).where("caught > 0")


#: (tool depended on, tool of the step, holds, message); ``k`` stands for the result's fields.
GuardRule = tuple[str, str, Column, str]


def default_guard_rules() -> list[GuardRule]:
    k = F.col("dep_k")
    return [
        ("order_lookup", "crm_send_coupon", k % 4 > 0, "no orders: no coupon"),
        ("inventory_check", "price_analysis", (k % 3 != 0) | (k % 2 > 0), "out of stock: no price analysis"),
        ("user_profile", "rag_search", F.lit(True), ""),
        ("order_lookup", "crm_create_return", k % 5 != 0, "returned already"),
        ("order_lookup", "logistics_track", k % 7 != 0, "digital product: nothing to track"),
    ]


def guard_violations(steps: DataFrame, rules: Sequence[GuardRule]) -> DataFrame:
    """Each step against the result it depends on; the first rule violated gives the message.
    Rules of the user's own come first in ``rules``.  Steps whose dependency has no result pass."""
    results = steps.select("user_id", "day", F.col("step").alias("dep"), F.col("tool").alias("dep_tool"), F.col("k").alias("dep_k"))
    both = steps.where("dep >= 0").join(results, ["user_id", "day", "dep"])
    fails = lambda dep, cur, holds: (F.col("dep_tool") == dep) & (F.col("tool") == cur) & ~holds
    message = F.coalesce(*[F.when(fails(dep, cur, holds), F.lit(m)) for dep, cur, holds, m in rules])
    return both.withColumn("message", message).where("message IS NOT NULL").select("user_id", "day", "step", "tool", "message")


_TOOL2 = [8, 12, 8, 11, 8, 10, 4, 7, 3, 0]


@query("semantic_guard", f"""WITH {S_SQL.replace(f"(k % {len(TOOLS)} + 1)::BIGINT", f"list_extract({[x + 1 for x in _TOOL2]}, (k % 10 + 1)::BIGINT)")},
j AS (SELECT x.user_id, x.day, x.step, x.tool, y.tool AS dep_tool, y.k AS dep_k FROM s x JOIN s y ON x.user_id = y.user_id AND x.day = y.day AND x.dep = y.step AND x.dep >= 0),
m AS (SELECT *, CASE WHEN dep_tool = 'order_lookup' AND tool = 'crm_send_coupon' AND dep_k % 4 = 0 THEN 'no orders: no coupon'
 WHEN dep_tool = 'inventory_check' AND tool = 'price_analysis' AND dep_k % 3 = 0 AND dep_k % 2 = 0 THEN 'out of stock: no price analysis'
 WHEN dep_tool = 'order_lookup' AND tool = 'crm_create_return' AND dep_k % 5 = 0 THEN 'returned already'
 WHEN dep_tool = 'order_lookup' AND tool = 'logistics_track' AND dep_k % 7 = 0 THEN 'digital product: nothing to track' END AS message FROM j)
SELECT user_id, day, step, tool, message FROM m WHERE message IS NOT NULL""")  # fmt: skip
def semantic_guard(spark, d):
    """The rules between steps, over the tools that they name."""
    tool = F.element_at(F.array(*[F.lit(TOOLS[i]) for i in _TOOL2]), (F.col("k") % len(_TOOL2) + 1).cast("int"))
    return guard_violations(plan_steps(spark, d).withColumn("tool", tool), default_guard_rules())


_INPUT_SQL = """'{' || concat_ws(',', CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '"query":' || k WHEN 2 THEN '"query":null' ELSE '"query":"q' || k || '"' END,
 CASE k % 4 WHEN 0 THEN '"top_k":' || k WHEN 1 THEN '"top_k":"' || k || '"' WHEN 2 THEN '"top_k":1.5' END,
 CASE k % 3 WHEN 0 THEN '"deep":true' WHEN 1 THEN '"deep":"yes"' END, CASE k % 6 WHEN 0 THEN '"tags":["a"]' WHEN 1 THEN '"tags":{}' END, '"other":1') || '}'"""


def with_schema_errors(rows: DataFrame, json_col: str, required: Sequence[str], kinds: dict[str, str]) -> DataFrame:
    """Add ``errors``, messages on a JSON object: required fields that are missing or null, and
    fields whose type is not the expected one; fields without an expectation pass."""
    fits = {"string": ["str"], "number": ["int", "float", "bool"], "integer": ["int", "bool"], "boolean": ["bool"], "array": ["list"]}
    fields = list(dict.fromkeys([*required, *kinds]))
    v = F.parse_json(json_col)
    rows = rows.withColumn("__found", F.array(*[F.schema_of_variant(F.variant_get(v, f"$.{f}", "variant")) for f in fields]))

    def name(kind: Column) -> Column:
        named = F.when(kind == "STRING", "str").when(kind == "BIGINT", "int").when(kind == "BOOLEAN", "bool").when(kind == "VOID", "NoneType")
        return F.when(kind.isNotNull(), named.when(F.startswith(kind, F.lit("ARRAY")), "list").when(F.startswith(kind, F.lit("OBJECT")), "dict").otherwise("float"))

    rows = rows.withColumn("__found", F.transform("__found", name))
    got = {f: F.col("__found")[i] for i, f in enumerate(fields)}
    missing = [F.when(got[f].isNull() | (got[f] == "NoneType"), F.lit(f"Missing required field: {f}")) for f in required]
    wrong = [F.when(~got[f].isin(fits[kind]), F.concat(F.lit(f"Field '{f}' expected {kind}, got "), got[f])) for f, kind in kinds.items()]
    return rows.withColumn("errors", F.concat_ws("; ", *missing, *wrong)).drop("__found")


_GOT = "CASE json_type(j, '$.{0}') WHEN 'VARCHAR' THEN 'str' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' WHEN 'NULL' THEN 'NoneType' END"


def _wrong(f: str, kind: str, fits: str) -> str:
    g = _GOT.format(f)
    return f"CASE WHEN {g} NOT IN ({fits}) THEN 'Field ''{f}'' expected {kind}, got ' || {g} END"


@query("input_schema_check", f"""WITH {R_SQL}, i AS (SELECT event_id, {_INPUT_SQL} AS j FROM r), c AS (SELECT event_id, concat_ws('; ',
 CASE WHEN coalesce({_GOT.format('query')}, 'NoneType') = 'NoneType' THEN 'Missing required field: query' END,
 {_wrong('query', 'string', "'str'")}, {_wrong('top_k', 'integer', "'int', 'bool'")}, {_wrong('deep', 'boolean', "'bool'")}, {_wrong('tags', 'array', "'list'")}) AS errors FROM i)
SELECT event_id, errors FROM c WHERE errors <> ''""")  # fmt: skip
def input_schema_check(spark, d):
    """Tool inputs against a schema."""
    i = tool_records(spark, d).select("event_id", F.expr(_INPUT_SQL).alias("j"))
    kinds = {"query": "string", "top_k": "integer", "deep": "boolean", "tags": "array"}
    return with_schema_errors(i, "j", ["query"], kinds).select("event_id", "errors").where("errors != ''")


_RAW = """CASE k % 5 WHEN 0 THEN '{"intent":"operations","intent_clarity":0.' || (k % 9 + 1) || ',"steps":[{"actions":[{"tool_name":"t' || k || '"}]},{"actions":[]},{"step_index":7,"actions":[{"tool_name":"u"},{"tool_name":"v"}]}]}'
 WHEN 1 THEN concat('```json', chr(10), '{"steps":[{"actions":[]},{"actions":[{"tool_name":"t' || k || '"}]}]}', chr(10), '```') WHEN 2 THEN '{"intent": "broken" ' || k WHEN 3 THEN '  {}  '
 ELSE concat('```', chr(10), '{"intent":"general","clarifying_question":"which ' || k || '?"}', chr(10), '```') END"""


def strip_fences(raw: Column) -> Column:
    text = F.trim(raw)
    bare = F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(text.startswith("```"), bare).otherwise(text)


_PLAN = "struct<intent:string,intent_clarity:double,clarifying_question:string,steps:array<struct<step_index:int,actions:array<struct<tool_name:string>>>>>"


def parse_plan(raw: Column) -> Column:
    """A plan from text: steps without actions go, a step without a number gets the number of
    steps before it that stay; text that is no JSON is a general plan that asks back."""
    text = strip_fences(raw)
    p = F.from_json(text, _PLAN)
    bad = F.try_parse_json(text).isNull()
    steps = F.filter(F.coalesce(p["steps"], F.array().cast("array<struct<step_index:int,actions:array<struct<tool_name:string>>>>")), lambda s: F.size(s["actions"]) > 0)
    tools = F.transform(steps, lambda s, i: F.concat(F.coalesce(s["step_index"], i).cast("string"), F.lit(":"), F.array_join(F.transform(s["actions"], lambda a: a["tool_name"]), "+")))
    return F.struct(
        F.when(bad, "general").otherwise(F.coalesce(p["intent"], F.lit("general"))).alias("intent"),
        F.when(bad, 0.5).otherwise(F.coalesce(p["intent_clarity"], F.lit(1.0))).alias("clarity"),
        F.when(bad, F.lit("请再说明您的需求")).otherwise(p["clarifying_question"]).alias("question"),
        F.when(bad, "").otherwise(F.array_join(tools, ",")).alias("steps"),
    )


@query("plan_parse", f"""WITH {R_SQL}, t AS (SELECT event_id, trim({_RAW}) AS raw FROM r),
c AS (SELECT event_id, CASE WHEN starts_with(raw, '```') THEN regexp_replace(regexp_replace(raw, '^```(?:json)?\\s*', ''), '\\s*```$', '') ELSE raw END AS j FROM t),
p AS (SELECT event_id, json_valid(j) AS ok, CASE WHEN json_valid(j) THEN j ELSE '{{}}' END AS j FROM c),
s AS (SELECT event_id, list_filter(from_json(json_extract(j, '$.steps'), '[{{"step_index":"INT","actions":[{{"tool_name":"VARCHAR"}}]}}]'), lambda x: len(x.actions) > 0) AS kept FROM p)
SELECT event_id, CASE WHEN ok THEN coalesce(json_extract_string(j, '$.intent'), 'general') ELSE 'general' END AS intent,
 CASE WHEN ok THEN coalesce(CAST(json_extract(j, '$.intent_clarity') AS DOUBLE), 1.0::DOUBLE) ELSE 0.5::DOUBLE END AS clarity,
 CASE WHEN ok THEN json_extract_string(j, '$.clarifying_question') ELSE '请再说明您的需求' END AS question,
 coalesce(array_to_string(list_transform(kept, lambda x, i: coalesce(x.step_index, i - 1) || ':' || array_to_string(list_transform(x.actions, lambda a: a.tool_name), '+')), ','), '') AS steps
FROM p JOIN s USING (event_id)""")  # fmt: skip
def plan_parse(spark, d):
    raw = tool_records(spark, d).select("event_id", F.expr(_RAW).alias("raw"))
    return raw.select("event_id", parse_plan(F.col("raw")).alias("p")).select("event_id", "p.*")


@query("reflection_parse", f"""WITH {R_SQL}, t AS (SELECT event_id, CASE k % 3 WHEN 0 THEN '{{"needs_replan":true,"overall_quality":0.' || (k % 9 + 1) || ',"issues":["a","b"],"notes":"n"}}' WHEN 1 THEN 'oops ' || k ELSE '{{}}' END AS raw FROM r)
SELECT event_id, CASE WHEN json_valid(raw) THEN coalesce(json_extract_string(raw, '$.needs_replan'), 'not said') ELSE 'false' END AS needs_replan,
 CASE WHEN json_valid(raw) THEN CAST(json_extract(raw, '$.overall_quality') AS DOUBLE) ELSE 0.5::DOUBLE END AS quality,
 CASE WHEN json_valid(raw) THEN coalesce(json_array_length(raw, '$.issues'), 0)::INT ELSE 0 END AS issues,
 CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.notes') ELSE 'unreadable: ' || left(raw, 300) END AS notes FROM t""")  # fmt: skip
def reflection_parse(spark, d):
    """Reflections from text; one that is no JSON asks for nothing."""
    made = """CASE k % 3 WHEN 0 THEN '{"needs_replan":true,"overall_quality":0.' || (k % 9 + 1) || ',"issues":["a","b"],"notes":"n"}' WHEN 1 THEN 'oops ' || k ELSE '{}' END"""
    t = tool_records(spark, d).select("event_id", strip_fences(F.expr(made)).alias("raw"))
    bad, p = F.try_parse_json("raw").isNull(), F.from_json("raw", "struct<needs_replan:boolean,overall_quality:double,issues:array<string>,notes:string>")
    return t.select(
        "event_id", F.when(bad, "false").otherwise(F.coalesce(p["needs_replan"].cast("string"), F.lit("not said"))).alias("needs_replan"), F.when(bad, 0.5).otherwise(p["overall_quality"]).alias("quality"),
        F.when(bad, 0).otherwise(F.coalesce(F.size(p["issues"]), F.lit(0))).alias("issues"),
        F.when(bad, F.concat(F.lit("unreadable: "), F.left("raw", F.lit(300)))).otherwise(p["notes"]).alias("notes"),
    )


@query("step_results", f"""WITH {S_SQL}, x AS (SELECT user_id, day, tool, row_number() OVER (PARTITION BY user_id, day ORDER BY step) AS i FROM s),
y AS (SELECT user_id, day, status, row_number() OVER (PARTITION BY user_id, day ORDER BY step) AS i FROM s WHERE status <> 'timeout')
SELECT user_id, day, i - 1 AS position, tool, CASE WHEN tool = 'crm_send_coupon' THEN 'TOOL_NOT_FOUND' WHEN status IS NULL THEN 'EXECUTOR_EXCEPTION' ELSE status END AS outcome FROM x LEFT JOIN y USING (user_id, day, i)""")  # fmt: skip
def step_results(spark, d):
    """A plan's actions and the results that came back, zipped by position; an action without
    a result, or with an unknown tool, gets an error record."""
    order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"])
    g = plan_steps(spark, d).groupBy("user_id", "day").agg(
        order(F.struct("step", F.col("tool").alias("v"))).alias("tool"),
        order(F.when(F.col("status") != "timeout", F.struct("step", F.col("status").alias("v")))).alias("status"),
    )
    z = g.select("user_id", "day", F.posexplode(F.arrays_zip("tool", "status")).alias("position", "z"))
    outcome = F.when(F.col("z.tool") == "crm_send_coupon", "TOOL_NOT_FOUND").otherwise(F.coalesce("z.status", F.lit("EXECUTOR_EXCEPTION")))
    return z.select("user_id", "day", F.col("position").cast("long").alias("position"), F.col("z.tool").alias("tool"), outcome.alias("outcome"))


_PAYLOAD = """'{"sku-' || k || '":' || k || ',"sku-x":"no","plain":' || k || ',"entities":[{"id":"e' || (k % 10) || '"},{"name":"none"},{"id":"e' || (k % 7) || '"}]}'"""


@query("product_ids", f"""WITH {R_SQL}, p AS (SELECT event_id, {_PAYLOAD} AS j FROM r),
f AS (SELECT event_id, list_filter(json_keys(j), lambda x: contains(x, '-') AND json_type(json_extract(j, '$."' || x || '"')) IN ('UBIGINT', 'BIGINT', 'DOUBLE')) AS a,
 list_filter(json_extract_string(j, '$.entities[*].id'), lambda x: x IS NOT NULL) AS b FROM p)
SELECT event_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS ids FROM f""")  # fmt: skip
def product_ids(spark, d):
    """Keys with a hyphen and a numeric value, and the ids of entities."""
    p = tool_records(spark, d).select("event_id", F.expr(_PAYLOAD).alias("j"))
    flat = F.from_json("j", "map<string,string>")
    keyed = F.map_keys(F.map_filter(flat, lambda k, v: F.contains(k, F.lit("-")) & F.rlike(v, F.lit(r"^-?[0-9]+(\.[0-9]+)?$"))))
    listed = F.transform(F.from_json(F.get_json_object("j", "$.entities"), "array<struct<id:string>>"), lambda e: e["id"])
    return p.select("event_id", F.array_join(F.array_sort(F.array_union(keyed, F.filter(listed, lambda x: x.isNotNull()))), ",").alias("ids"))


@query("response_projection", f"""WITH {S_SQL} SELECT user_id, day, any_value(intent) AS intent, count(*) AS tool_calls_made, count(*) FILTER (status IN ('success', 'degraded')) AS answered,
 coalesce(string_agg('src' || k, ',' ORDER BY step) FILTER (status IN ('success', 'degraded')), '') AS sources FROM s GROUP BY 1, 2""")  # fmt: skip
def response_projection(spark, d):
    """What a response shows of a plan: how many calls, and the sources of those that answered."""
    good = F.col("status").isin("success", "degraded")
    found = F.array_sort(F.collect_list(F.when(good, F.struct("step", F.concat(F.lit("src"), F.col("k")).alias("src")))))
    g = plan_steps(spark, d).groupBy("user_id", "day").agg(F.first("intent").alias("intent"), F.count(F.lit(1)).alias("tool_calls_made"), F.count_if(good).alias("answered"), found.alias("f"))
    return g.withColumn("sources", F.array_join(F.col("f.src"), ",")).drop("f")


@query("tool_set_equality", f"""WITH {S_SQL}, g AS (SELECT user_id, day, list_sort(list_distinct(list(tool))) AS tools FROM s GROUP BY 1, 2)
SELECT user_id, day, tools = lag(tools) OVER (PARTITION BY user_id ORDER BY day) AS same FROM g QUALIFY same IS NOT NULL""")  # fmt: skip
def tool_set_equality(spark, d):
    """Whether a user's day used the same tools as the day before that."""
    g = plan_steps(spark, d).groupBy("user_id", "day").agg(F.collect_set("tool").alias("tools"))
    before = F.lag("tools").over(W.partitionBy("user_id").orderBy("day"))
    g = g.withColumn("before", before)
    same = (F.size(F.array_except("tools", "before")) == 0) & (F.size(F.array_except("before", "tools")) == 0)
    return g.where("before IS NOT NULL").select("user_id", "day", same.alias("same"))


@query("error_preview", f"""WITH {S_SQL}, bad AS (SELECT user_id, day, tool, row_number() OVER (PARTITION BY user_id, day ORDER BY step) AS i FROM s WHERE status = 'error')
SELECT user_id, day, string_agg(tool, ', ' ORDER BY i) FILTER (i <= 3) AS shown, count(*) AS errors FROM bad GROUP BY 1, 2""")  # fmt: skip
def error_preview(spark, d):
    """The first three errors of each plan, and their number."""
    e = plan_steps(spark, d).where("status = 'error'").groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("step", "tool"))).alias("e"))
    return e.select("user_id", "day", F.array_join(F.slice("e.tool", 1, 3), ", ").alias("shown"), F.size("e").cast("long").alias("errors"))


