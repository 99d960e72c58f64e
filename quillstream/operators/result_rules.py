"""Rules on what tools return, contracts before and after calls, answers when a call fails, and
inputs against schemas that are data themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.plans.registry import query
from quillstream.plans.rules import Rule, RuleSet, only_context
from quillstream.sources.tables import R_SQL, table, tool_records

#: Messages of the result rules, and marks of an answer that gives up.
NEGATIVE_STOCK, BAD_PRICE, NO_SOURCES = "库存数量为负数: ", "价格无效: ", "RAG 搜索返回成功但没有检索到任何来源文档"
GAVE_UP = ["无法回答", "没有找到"]
PRICE_KEYS = ["price", "our_price", "suggested_price"]


def number(data: Column, key: str) -> Column:
    """A number of a JSON object, null if it is missing, null or anything but a number."""
    return F.try_variant_get(F.try_parse_json(data), f"$.{key}", "double")


def _given(data: Column, key: str) -> Column:
    """Whether the key is there with a value other than null."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(data), f"$.{key}", "variant"))
    return F.coalesce(kind != "VOID", F.lit(False))


def _numeric(data: Column, key: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(data), f"$.{key}", "variant"))
    return F.coalesce((kind == "BIGINT") | (kind == "DOUBLE") | F.startswith(kind, F.lit("DECIMAL")), F.lit(False))


def default_result_rules(data: str = "data", status: str = "status", tool: str = "tool") -> RuleSet:
    """Stock is not negative; the first invalid price of the chain is reported; a search that
    succeeded with an answer has sources.  A stock or price that is no number can't be judged."""
    d = F.col(data)
    stock, said = F.get_json_object(d, "$.quantity_available"), lambda k: F.get_json_object(d, f"$.{k}")
    stock_ok = F.when(~_given(d, "quantity_available"), F.lit(True)).when(_numeric(d, "quantity_available"), number(d, "quantity_available") >= 0)
    # From the front: the first key that is given decides, unless it is fine.
    price_ok, price_says = F.lit(True), F.lit(None).cast("string")
    for key in reversed(PRICE_KEYS):
        bad = number(d, key) <= 0
        price_ok = F.when(~_given(d, key), price_ok).when(~_numeric(d, key), F.lit(None).cast("boolean")).when(bad, F.lit(False)).otherwise(price_ok)
        price_says = F.when(_numeric(d, key) & bad, F.concat(F.lit(f"{BAD_PRICE}{key}="), said(key))).otherwise(price_says)
    sources = F.coalesce(F.size(F.from_json(said("sources"), "array<string>")), F.lit(0))
    answer = F.coalesce(said("answer"), F.lit(""))
    gave_up = F.exists(F.array(*map(F.lit, GAVE_UP)), lambda w: F.contains(answer, w))
    sources_ok = (F.col(status) != "success") | (sources > 0) | (answer == "") | gave_up
    rules = RuleSet()
    rules.add_rule(Rule("stock_non_negative", stock_ok, F.concat(F.lit(NEGATIVE_STOCK), stock)))
    rules.add_rule(Rule("price_positive", price_ok, price_says))
    return rules.add_rule(Rule("source_chunks_non_empty", sources_ok, F.lit(NO_SOURCES), tools=("rag_search", "rag_chat")))


#: Results of all shapes, as text: numbers, texts in their place, nulls, missing keys, no JSON.
_DATA_SQL = """CASE WHEN k % 11 = 10 THEN '{"price": oops' ELSE '{' || concat_ws(',',
 CASE k % 4 WHEN 0 THEN '"quantity_available":' || (k % 7 - 2) WHEN 1 THEN '"quantity_available":"many"' WHEN 2 THEN '"quantity_available":null' END,
 CASE k % 5 WHEN 0 THEN '"price":null' WHEN 1 THEN '"price":' || (k % 3 - 1) WHEN 2 THEN '"price":"free"' END,
 CASE k % 3 WHEN 0 THEN '"our_price":' || (k % 9 - 4) || '.5' END, CASE k % 2 WHEN 0 THEN '"suggested_price":0' END,
 CASE k % 6 WHEN 0 THEN '"sources":[]' WHEN 1 THEN '"sources":["a","b"]' END,
 CASE k % 7 WHEN 0 THEN '"answer":""' WHEN 1 THEN '"answer":"没有找到 ' || k || '"' WHEN 2 THEN '"answer":"yes ' || k || '"' WHEN 3 THEN '"answer":"maybe"' END) || '}' END"""
_RULE_TOOL = "CASE k % 8 WHEN 0 THEN 'rag_search' WHEN 2 THEN 'rag_chat' WHEN 4 THEN 'rag_search' ELSE 'inventory_check' END"


def _j(key: str) -> str:
    return f"json_type(j, '$.{key}')"


_NUM = "('UBIGINT', 'BIGINT', 'DOUBLE')"
_BAD = "CASE " + " ".join(
    f"WHEN coalesce({_j(key)}, 'NULL') <> 'NULL' AND {_j(key)} NOT IN {_NUM} THEN 'Rule price_positive failed: not evaluated' "
    f"WHEN {_j(key)} IN {_NUM} AND CAST(json_extract(j, '$.{key}') AS DOUBLE) <= 0 THEN '{BAD_PRICE}{key}=' || json_extract_string(j, '$.{key}')"
    for key in PRICE_KEYS
) + " END"


@query("result_rules", f"""WITH {R_SQL}, x AS (SELECT event_id, status, {_RULE_TOOL} AS tool, {_DATA_SQL} AS raw FROM r), y AS (SELECT *, CASE WHEN json_valid(raw) THEN raw ELSE 'null' END AS j FROM x),
v AS (SELECT event_id, tool, 'stock_non_negative' AS rule, CASE WHEN coalesce({_j("quantity_available")}, 'NULL') = 'NULL' THEN NULL WHEN {_j("quantity_available")} NOT IN {_NUM} THEN 'Rule stock_non_negative failed: not evaluated'
  WHEN CAST(json_extract(j, '$.quantity_available') AS DOUBLE) < 0 THEN '{NEGATIVE_STOCK}' || json_extract_string(j, '$.quantity_available') END AS message FROM y
 UNION ALL SELECT event_id, tool, 'price_positive', {_BAD} FROM y
 UNION ALL SELECT event_id, tool, 'source_chunks_non_empty', CASE WHEN tool IN ('rag_search', 'rag_chat') AND status = 'success' AND coalesce(json_array_length(j, '$.sources'), 0) = 0
  AND coalesce(json_extract_string(j, '$.answer'), '') <> '' AND NOT contains(json_extract_string(j, '$.answer'), '无法回答') AND NOT contains(json_extract_string(j, '$.answer'), '没有找到') THEN '{NO_SOURCES}' END FROM y
 UNION ALL SELECT event_id, tool, 'short_answers', CASE WHEN length(json_extract_string(j, '$.answer')) > 7 THEN 'answer of ' || length(json_extract_string(j, '$.answer')) END FROM y)
SELECT event_id, tool, rule, message FROM v WHERE message IS NOT NULL""")  # fmt: skip
def result_rules(spark, d):
    """The default rules and one of the user's own on every result."""
    r = tool_records(spark, d).select("event_id", "status", F.expr(_RULE_TOOL).alias("tool"), F.expr(_DATA_SQL).alias("data"))
    length = F.coalesce(F.length(F.get_json_object("data", "$.answer")), F.lit(0))
    rules = default_result_rules().add_rule(Rule("short_answers", length <= 7, F.concat(F.lit("answer of "), length.cast("string"))))
    return rules.check(r, ["event_id", "tool"]).drop("position")


def return_contract_rules() -> RuleSet:
    """What must hold before and after a return is made; the context is a map of text."""
    seen = lambda *keys: only_context(F.col("context"), keys)
    amount = F.try_to_number(F.col("refund"), F.lit("999999999.99"))
    limit = F.try_to_number(seen("order_total")["order_total"], F.lit("999999999.99"))
    rules = RuleSet()
    rules.add_rule(Rule("vip_only", F.coalesce(seen("user_tier")["user_tier"], F.lit("")) == "vip", F.lit("only vip users"), "precondition", context=("user_tier",)))
    rules.add_rule(Rule("completed_only", F.coalesce(seen("order_status")["order_status"], F.lit("")) == "F", F.concat(F.lit("order is "), F.coalesce(seen("order_status")["order_status"], F.lit("unknown"))), "precondition", context=("order_status",)))
    rules.add_rule(Rule("not_returned", F.coalesce(seen("returned")["returned"], F.lit("")) != "R", F.lit("returned already"), "precondition", context=("returned",)))
    return rules.add_rule(Rule("refund_within", amount <= limit, F.concat(F.lit("refund of "), F.col("refund")), "postcondition", context=("order_total",)))


_CONTEXT_SQL = """x AS (SELECT l_orderkey, l_linenumber, CASE WHEN c_acctbal > 5000 THEN 'vip' WHEN c_acctbal > 0 THEN 'regular' END AS tier, CASE WHEN l_linenumber % 7 <> 6 THEN o_orderstatus END AS order_status, l_returnflag AS flag,
  CASE WHEN l_partkey % 13 = 0 THEN 'unknown' ELSE floor(l_extendedprice)::BIGINT::VARCHAR END AS refund, CASE WHEN l_partkey % 17 <> 0 THEN floor(o_totalprice)::BIGINT::VARCHAR END AS total
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


@query("contract_phases", f"""WITH {_CONTEXT_SQL}, v AS (SELECT l_orderkey, l_linenumber, 'precondition' AS phase, 'vip_only' AS rule, CASE WHEN coalesce(tier, '') <> 'vip' THEN 'only vip users' END AS message FROM x
 UNION ALL SELECT l_orderkey, l_linenumber, 'precondition', 'completed_only', CASE WHEN coalesce(order_status, '') <> 'F' THEN 'order is ' || coalesce(order_status, 'unknown') END FROM x
 UNION ALL SELECT l_orderkey, l_linenumber, 'precondition', 'not_returned', CASE WHEN flag = 'R' THEN 'returned already' END FROM x
 UNION ALL SELECT l_orderkey, l_linenumber, 'postcondition', 'refund_within', CASE WHEN try_cast(refund AS BIGINT) IS NULL OR total IS NULL THEN 'Rule refund_within failed: not evaluated' WHEN refund::BIGINT > total::BIGINT THEN 'refund of ' || refund END FROM x)
SELECT phase, rule, message, count(*) AS n, min(l_orderkey) AS first_order FROM v WHERE message IS NOT NULL GROUP BY 1, 2, 3""")  # fmt: skip
def contract_phases(spark, d):
    """Violations of the contracts of a return by phase; what the context lacks or garbles can't
    be evaluated, which counts against that contract alone."""
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    whole = lambda c: F.floor(c).cast("string")
    context = F.create_map(
        F.lit("user_tier"), F.when(F.col("c_acctbal") > 5000, "vip").when(F.col("c_acctbal") > 0, "regular"),
        F.lit("order_status"), F.when(F.col("l_linenumber") % 7 != 6, F.col("o_orderstatus")), F.lit("returned"), F.col("l_returnflag"),
        F.lit("order_total"), F.when(F.col("l_partkey") % 17 != 0, whole("o_totalprice")),
    )
    refund = F.when(F.col("l_partkey") % 13 == 0, "unknown").otherwise(whole("l_extendedprice"))
    calls = x.select("l_orderkey", "l_linenumber", F.lit("crm_create_return").alias("tool"), refund.alias("refund"), context.alias("context"))
    rules = return_contract_rules()
    both = F.array(*[F.struct(F.lit(p).alias("phase"), rules.violations(p, F.col("tool")).alias("v")) for p in ("precondition", "postcondition")])
    each = calls.select("l_orderkey", F.inline(both)).select("l_orderkey", "phase", F.inline("v"))
    return each.groupBy("phase", "rule", "message").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_order"))


@query("stale_fallback", f"""WITH {R_SQL}, c AS (SELECT event_id, tool, k, ts, status, elapsed_ms, CASE WHEN status = 'success' THEN ts END AS good_ts, CASE WHEN status = 'success' THEN event_id END AS good_id FROM r),
l AS (SELECT *, last_value(good_id IGNORE NULLS) OVER w AS stored_id, last_value(good_ts IGNORE NULLS) OVER w AS stored_ts FROM c WINDOW w AS (PARTITION BY tool, k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, tool, CASE WHEN status = 'success' THEN event_id ELSE coalesce(stored_id, -1) END AS answer, CASE WHEN status = 'success' THEN 'success' WHEN stored_id IS NULL THEN 'error' ELSE 'degraded' END AS outcome,
 CASE WHEN status <> 'success' THEN coalesce(date_diff('microsecond', stored_ts, ts), -1) ELSE 0 END AS age FROM l""")  # fmt: skip
def stale_fallback(spark, d):
    """Where a call fails, the last good answer to the same question stands in, however old
    (microseconds); without one it stays an error.  A question may have all calls: inside a day
    the answer is looked for among the day's, then in the last ones of the days before."""
    r = tool_records(spark, d)
    good = F.when(F.col("status") == "success", F.struct("ts", "event_id"))
    r = r.select("event_id", "tool", "k", "day", "ts", "status", good.alias("good"))
    today = F.last("good", ignorenulls=True).over(W.partitionBy("tool", "k", "day").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1))
    days = r.groupBy("tool", "k", "day").agg(F.max("good").alias("good"))
    before = F.last("good", ignorenulls=True).over(W.partitionBy("tool", "k").orderBy("day").rowsBetween(W.unboundedPreceding, -1))
    days = days.select("tool", "k", "day", before.alias("before"))
    s = r.withColumn("today", today).join(days, ["tool", "k", "day"]).withColumn("stored", F.coalesce("today", "before"))
    failed = F.col("status") != "success"
    age = F.timestamp_diff("MICROSECOND", F.col("stored.ts"), F.col("ts"))
    return s.select(
        "event_id", "tool", F.when(failed, F.coalesce("stored.event_id", F.lit(-1))).otherwise(F.col("event_id")).alias("answer"),
        F.when(~failed, "success").when(F.col("stored").isNull(), "error").otherwise("degraded").alias("outcome"), F.when(failed, F.coalesce(age, F.lit(-1))).otherwise(0).alias("age"),
    )


#: Parameters of the tools (tool, field, type, required).
TOOL_PARAMS = [
    ("rag_search", "query", "string", True), ("rag_search", "top_k", "integer", False), ("rag_chat", "query", "string", True), ("rag_chat", "session_id", "string", False),
    ("web_search", "query", "string", True), ("web_search", "max_results", "integer", False), ("order_lookup", "order_id", "string", True), ("order_lookup", "deep", "boolean", False),
    ("price_analysis", "price", "number", True), ("price_analysis", "tags", "array", True),
]
#: Which kinds of value a type takes, as they are called in messages.
FITS = {"string": ["str"], "number": ["int", "float", "bool"], "integer": ["int", "bool"], "boolean": ["bool"], "array": ["list"]}


def kind_of(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    named = F.when(kind == "STRING", "str").when(kind == "BIGINT", "int").when(kind == "BOOLEAN", "bool").when(kind == "VOID", "NoneType")
    return F.when(kind.isNotNull(), named.when(F.startswith(kind, F.lit("ARRAY")), "list").when(F.startswith(kind, F.lit("OBJECT")), "dict").otherwise("float"))


def schema_errors(calls: DataFrame, params: DataFrame, keys: list[str], input_col: str = "input") -> DataFrame:
    """``keys``, errors: what is wrong with each call's input (JSON) by the parameters of its tool
    (tool, position, field, type, required), which are a table: required fields that are missing
    or null in the order of the parameters, then types in the order of the input.  Fields that
    the tool doesn't name pass, as do calls of a tool without parameters."""
    # The kinds of the values in the input's order; the parameters of a tool are a few rows.
    fields = F.from_json(input_col, "map<string,variant>")
    given = F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("field"), kind_of(e["value"]).alias("kind")))
    of_tool = params.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("position", "field", "type", "required"))).alias("__params"))
    both = calls.withColumn("__given", F.coalesce(given, F.array().cast("array<struct<field:string,kind:string>>"))).join(F.broadcast(of_tool), "tool", "left")
    has = lambda p: F.exists("__given", lambda g: (g["field"] == p["field"]) & (F.coalesce(g["kind"], F.lit("NoneType")) != "NoneType"))
    missing = F.transform(F.filter("__params", lambda p: p["required"] & ~has(p)), lambda p: F.concat(F.lit("Missing required field: "), p["field"]))
    fits = F.create_map(*[x for kind, names in FITS.items() for x in (F.lit(kind), F.array(*map(F.lit, names)))])

    def wrong(g: Column) -> Column:
        p = F.get(F.filter("__params", lambda p: p["field"] == g["field"]), F.lit(0))
        kind = F.coalesce(g["kind"], F.lit("NoneType"))
        bad = ~F.array_contains(fits[p["type"]], kind)
        return F.when(bad, F.concat(F.lit("Field '"), g["field"], F.lit("' expected "), p["type"], F.lit(", got "), kind))

    types = F.filter(F.transform("__given", wrong), lambda m: m.isNotNull())
    return both.select(*keys, F.array_join(F.concat(F.coalesce(missing, F.array().cast("array<string>")), types), "; ").alias("errors"))


_TOOLS_USED = ["rag_search", "rag_chat", "web_search", "order_lookup", "price_analysis", "image_search"]
_CALL_SQL = """'{' || concat_ws(',', CASE k % 3 WHEN 0 THEN '"zeta":1' END, CASE k % 7 WHEN 0 THEN '"tags":["a",1]' WHEN 1 THEN '"tags":{"a":1}' WHEN 2 THEN '"tags":"a"' END,
 CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '"query":' || k WHEN 2 THEN '"query":null' ELSE '"query":"q' || k || '"' END, CASE k % 4 WHEN 0 THEN '"top_k":' || k WHEN 1 THEN '"top_k":"5"' WHEN 2 THEN '"top_k":2.5' END,
 CASE k % 6 WHEN 0 THEN '"session_id":7' WHEN 1 THEN '"order_id":"o"' WHEN 2 THEN '"order_id":false' END, CASE k % 9 WHEN 0 THEN '"deep":true' WHEN 1 THEN '"deep":"yes"' WHEN 2 THEN '"price":1.5' WHEN 3 THEN '"price":"1"' WHEN 4 THEN '"max_results":[3]' END) || '}'"""
_KIND = "CASE json_type(json_extract(j, '$.' || field)) WHEN 'VARCHAR' THEN 'str' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' ELSE 'NoneType' END"


@query("schema_from_table", f"""WITH {R_SQL}, p(position, tool, field, type, required) AS (VALUES {", ".join(f"({i}, '{t}', '{f}', '{k}', {r})" for i, (t, f, k, r) in enumerate(TOOL_PARAMS))}),
fits(type, kind) AS (VALUES {", ".join(f"('{t}', '{k}')" for t, names in FITS.items() for k in names)}),
c AS (SELECT event_id, list_extract({_TOOLS_USED}, (k % 6 + 1)::BIGINT) AS tool, {_CALL_SQL} AS j FROM r),
g AS (SELECT event_id, tool, j, unnest(json_keys(j)) AS field, unnest(range(len(json_keys(j)))) AS nth FROM c), t AS (SELECT g.*, {_KIND} AS kind FROM g),
m AS (SELECT c.event_id, 0 AS part, p.position AS nth, 'Missing required field: ' || p.field AS message FROM c JOIN p ON p.tool = c.tool AND p.required WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.event_id = c.event_id AND t.field = p.field AND t.kind <> 'NoneType')
 UNION ALL SELECT t.event_id, 1, t.nth, 'Field ''' || t.field || ''' expected ' || p.type || ', got ' || t.kind FROM t JOIN p ON p.tool = t.tool AND p.field = t.field WHERE (p.type, t.kind) NOT IN (SELECT type, kind FROM fits))
SELECT event_id, tool, string_agg(message, '; ' ORDER BY part, nth) AS errors FROM m JOIN c USING (event_id) GROUP BY 1, 2""")  # fmt: skip
def schema_from_table(spark, d):
    """Calls of several tools in one pass against a table of parameters."""
    tool = F.element_at(F.array(*map(F.lit, _TOOLS_USED)), (F.col("k") % 6 + 1).cast("int"))
    calls = tool_records(spark, d).select("event_id", tool.alias("tool"), F.expr(_CALL_SQL).alias("input"))
    params = spark.createDataFrame([(i, *p) for i, p in enumerate(TOOL_PARAMS)], "position int, tool string, field string, type string, required boolean")
    return schema_errors(calls, params, ["event_id", "tool"]).where("errors != ''")
