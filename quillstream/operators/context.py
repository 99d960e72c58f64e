"""What fits into a prompt: a budget of characters over tool results, tiered memory of a
user, and calls that are repeated within a time to live."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.plans.registry import query
from quillstream.sources.tables import R_SQL, plan_steps, table, tool_records

#: What stands for results that no longer fit.
CUT = "\n[...truncated — budget exhausted]"
SPENT = "[TOKEN BUDGET EXHAUSTED — remaining results omitted]"
DEGRADED_OMITTED = ": [degraded — details omitted, budget exhausted]"
SUCCESS_OMITTED = ": [success — omitted, budget full]"


def within_budget(records: Column, head: Column, max_chars: int = 2000, degraded_chars: int = 300) -> Column:
    """One text of at most about ``max_chars`` from records of (tool, status, summary, error,
    code): ``head``, then failed calls with all detail, degraded ones, and successful ones
    sharing what is left.  Each line's length depends on what the lines before have left, so
    a fold carries the budget; a null or empty ``head`` is left out."""
    of = lambda *status: F.filter(records, lambda r: r["status"].isin(*status))
    cut = lambda text, n: F.substr(text, F.lit(1), F.greatest(n, F.lit(0)).cast("int"))
    half = lambda s: F.floor(s["budget"] / 2)

    def state(parts: Column, budget: Column, stop: Column) -> Column:
        return F.struct(parts.alias("parts"), budget.cast("long").alias("budget"), stop.alias("stop"))

    def add(s: Column, line: Column, cost: Column | None = None, stop: Column | None = None) -> Column:
        spent = F.length(line) if cost is None else cost
        return state(F.concat(s["parts"], F.array(line)), s["budget"] - spent, F.lit(False) if stop is None else stop)

    def let(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def failed(s: Column, r: Column) -> Column:
        line = F.concat(
            F.lit("[ERROR] "), r["tool"], F.lit(" ["), F.coalesce(r["code"], F.lit("UNKNOWN")), F.lit("]\n   Result: "), cut(r["summary"], F.least(F.lit(300), half(s))),
            F.lit("\n   Diagnostic: "), cut(F.coalesce(r["error"], F.lit("(no error detail)")), F.least(F.lit(200), half(s))),
        )
        short = lambda x: F.when(F.length(x) > s["budget"], F.concat(cut(x, s["budget"] - 50), F.lit(CUT))).otherwise(x)

        def close(x: Column) -> Column:
            left = s["budget"] - F.length(x)
            parts = F.concat(s["parts"], F.array(x))
            return state(F.when(left < 100, F.concat(parts, F.array(F.lit(SPENT)))).otherwise(parts), left, left < 100)

        return F.when(s["stop"], s).otherwise(let(short(line), close))

    def degraded(s: Column, r: Column) -> Column:
        line = F.concat(F.lit("[DEGRADED] "), r["tool"], F.lit(": "), cut(r["summary"], F.least(F.lit(200), F.lit(degraded_chars), s["budget"])))
        omitted = F.concat(F.lit("[DEGRADED] "), r["tool"], F.lit(DEGRADED_OMITTED))
        fits = lambda x: F.when(s["budget"] > F.length(x), add(s, x)).when(s["budget"] > 50, add(s, omitted, F.lit(50))).otherwise(s)
        return F.when(s["stop"], s).otherwise(let(line, fits))

    def success(share: Column):
        def step(s: Column, r: Column) -> Column:
            line = F.concat(F.lit("[OK] "), r["tool"], F.lit(": "), cut(r["summary"], F.least(share - 30, F.lit(120))))
            full = F.concat(F.lit("[OK] "), r["tool"], F.lit(SUCCESS_OMITTED))
            fits = lambda x: F.when(s["budget"] > F.length(x), add(s, x)).otherwise(add(s, full, F.lit(0), F.lit(True)))
            return F.when(s["stop"], s).otherwise(let(line, fits))

        return step

    has_head = F.coalesce(F.length(head) > 0, F.lit(False))
    empty = F.array().cast("array<string>")
    start = state(F.when(has_head, F.array(head)).otherwise(empty), F.lit(max_chars) - F.when(has_head, F.length(head)).otherwise(0), F.lit(False))
    good = of("success")

    def rest(s: Column) -> Column:
        n = F.size(good)
        share = F.greatest(F.lit(60), F.floor(s["budget"] / n))
        names = F.array_join(F.transform(good, lambda r: r["tool"]), ", ")
        listed = F.concat(F.lit("[OK] Success tools ("), n.cast("string"), F.lit("): "), names)
        done = F.when(s["stop"] | (n == 0), s).when(s["budget"] > 200, F.aggregate(good, s, success(share))).otherwise(add(s, listed, F.lit(0)))
        return done["parts"]

    after_errors = F.aggregate(of("error", "timeout"), start, failed)
    return F.array_join(let(after_errors, lambda s: let(F.aggregate(of("degraded"), s, degraded), rest)), "\n")


@query("token_budget")
def token_budget(spark, d):
    """Each plan's results within 600 characters."""
    record = F.struct(
        "step", "tool", "status", F.repeat(F.concat("tool", F.lit(" says "), F.col("k").cast("string"), F.lit(" ")), (F.col("k") % 17).cast("int")).alias("summary"),
        F.when(F.col("k") % 2 == 0, F.repeat(F.lit("trace "), F.col("k").cast("int"))).alias("error"), F.when(F.col("k") % 3 == 0, "E42").alias("code"),
    )
    p = plan_steps(spark, d).groupBy("user_id", "day").agg(F.array_sort(F.collect_list(record)).alias("records"))
    head = F.concat(F.lit("plan of "), F.size("records").cast("string"), F.lit(" steps"))
    return p.select("user_id", "day", within_budget(F.col("records"), head, 600).alias("text"))


@query("memory_tier1", """WITH p AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN floor(c_acctbal / 1000)::BIGINT || 'k' END AS price, CASE c_custkey % 3 WHEN 0 THEN 'novice' WHEN 1 THEN 'expert' END AS skill,
 c_mktsegment AS interest, CASE WHEN c_nationkey % 2 = 0 THEN 'Brand#' || c_nationkey END AS brand FROM customer)
SELECT c_custkey, '用户画像: ' || concat_ws('; ', '价格偏好: ' || price, '使用经验: ' || skill, '兴趣: ' || interest, '偏好品牌: ' || brand) AS tier1 FROM p""")  # fmt: skip
def memory_tier1(spark, d):
    """What is always known of a user; signals that are missing leave no trace."""
    c = table(spark, d, "customer")
    signals = {
        "价格偏好: ": F.when(F.col("c_acctbal") > 0, F.concat(F.floor(F.col("c_acctbal") / 1000).cast("string"), F.lit("k"))),
        "使用经验: ": F.when(F.col("c_custkey") % 3 == 0, "novice").when(F.col("c_custkey") % 3 == 1, "expert"),
        "兴趣: ": F.col("c_mktsegment"),
        "偏好品牌: ": F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("Brand#"), F.col("c_nationkey"))),
    }
    said = F.concat_ws("; ", *[F.concat(F.lit(k), v) for k, v in signals.items()])
    return c.select("c_custkey", F.when(said != "", F.concat(F.lit("用户画像: "), said)).otherwise("").alias("tier1"))


def matches_any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


@query("memory_tier2", """WITH b AS (SELECT o_custkey, '历史购买: ' || string_agg(strftime(o_orderdate, '%Y-%m') || ' ' || o_orderpriority || ' ¥' || floor(o_totalprice)::BIGINT, ' | ' ORDER BY o_orderkey) AS block
  FROM (SELECT * FROM orders WHERE contains(o_orderpriority, 'URGENT') OR contains(o_orderpriority, 'HIGH') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3) GROUP BY 1),
q AS (SELECT conv_id, '相关对话: ' || string_agg('曾问: ' || left(coalesce(text, ''), 80), '; ' ORDER BY turn) AS block FROM (SELECT * FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2) GROUP BY 1),
x AS (SELECT c_custkey, b.block AS b1, 300 - coalesce(length(b.block), 0) AS room, q.block AS b2, CASE WHEN contains(c_mktsegment, 'HOUSE') THEN '相关偏好: {''segment'': ''' || c_mktsegment || '''}' END AS b3
  FROM customer LEFT JOIN b ON o_custkey = c_custkey LEFT JOIN q ON conv_id = c_custkey)
SELECT c_custkey, concat_ws(chr(10), b1, CASE WHEN room > 50 AND length(b2) <= room THEN b2 END, CASE WHEN room > 30 AND length(b3) <= room THEN b3 END) AS tier2 FROM x""")  # fmt: skip
def memory_tier2(spark, d, max_chars: int = 300):
    """What fits a user's question: purchases always, at most three; conversations and
    preferences if there is room.  A block of conversations does not take room from preferences."""
    o = table(spark, d, "orders").where(matches_any(F.col("o_orderpriority"), ["URGENT", "HIGH"]))
    line = F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit(" "), "o_orderpriority", F.lit(" ¥"), F.floor("o_totalprice").cast("string"))
    firsts = lambda c, n: F.transform(F.slice(F.array_sort(F.collect_list(c)), 1, n), lambda x: x["line"])
    b = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.concat(F.lit("历史购买: "), F.array_join(firsts(F.struct("o_orderkey", line.alias("line")), 3), " | ")).alias("b1"))
    q = table(spark, d, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("c_custkey"))
    asked = F.concat(F.lit("曾问: "), F.left(F.coalesce("text", F.lit("")), F.lit(80)))
    q = q.agg(F.concat(F.lit("相关对话: "), F.array_join(firsts(F.struct("turn", asked.alias("line")), 2), "; ")).alias("b2"))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(b, "c_custkey", "left").join(q, "c_custkey", "left")
    room = F.lit(max_chars) - F.coalesce(F.length("b1"), F.lit(0))
    b3 = F.when(matches_any(F.col("c_mktsegment"), ["HOUSE"]), F.concat(F.lit("相关偏好: {'segment': '"), "c_mktsegment", F.lit("'}")))
    if_room = lambda block, least: F.when((room > least) & (F.length(block) <= room), block)
    return c.select("c_custkey", F.concat_ws("\n", "b1", if_room(F.col("b2"), 50), if_room(b3, 30)).alias("tier2"))


def first_of_lifetimes(rows: DataFrame, keys: Sequence[str], ttl_seconds: int, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """The rows that are stored: the first of a key, and the first after the stored one has
    been kept for longer than ``ttl_seconds``.  Each task reads its keys in order of time and
    remembers one moment, so a key's history may be of any length."""
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, time, tie)
    ttl = pd.Timedelta(seconds=ttl_seconds)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, at = None, None
        for b in batches:
            keep = []
            for key, moment in zip(b[list(keys)].itertuples(index=False, name=None), b[time], strict=True):
                new = key != last or moment - at > ttl
                if new:
                    last, at = key, moment
                keep.append(new)
            yield b[pd.Series(keep, index=b.index, dtype=bool)]

    return rows.mapInPandas(scan, rows.schema)


def lifetimes_sql(keys: str, seconds: int, where: str) -> str:
    same = " AND ".join(f"r.{k.strip()} = kept.{k.strip()}" for k in keys.split(","))
    return f"""WITH RECURSIVE {R_SQL}, o AS (SELECT * FROM r WHERE {where}),
kept AS (SELECT {keys}, min(ts) AS ts FROM o GROUP BY {keys}
 UNION ALL SELECT {", ".join("kept." + k.strip() for k in keys.split(","))}, min(r.ts) FROM kept JOIN o r ON {same} AND r.ts > kept.ts + INTERVAL {seconds} SECOND
 GROUP BY {", ".join("kept." + k.strip() for k in keys.split(","))}, kept.ts)"""


@query("dedup_ttl", lifetimes_sql("user_id, tool", 3600, "status IN ('success', 'degraded')") + " SELECT user_id, tool, count(*) AS stored FROM kept GROUP BY 1, 2")
def dedup_ttl(spark, d):
    """How often a call was carried out and stored, equal ones within an hour being answered
    from the store; failed calls are not stored, so that they can be tried again."""
    r = tool_records(spark, d).where(F.col("status").isin("success", "degraded")).select("event_id", "ts", "user_id", "tool")
    return first_of_lifetimes(r, ["user_id", "tool"], 3600).groupBy("user_id", "tool").agg(F.count(F.lit(1)).alias("stored"))
