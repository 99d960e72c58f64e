"""Orders, returns, prices and products bought together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.functions.best import best
from quillstream.plans.registry import query
from quillstream.sources.scratch import stored
from quillstream.sources.tables import table


@query("order_totals", """SELECT o_orderkey, count(l_linenumber) AS lines, round(coalesce(sum(l_extendedprice * (1 - l_discount)), 0), 4) AS total
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")  # fmt: skip
def order_totals(spark, d):
    """Lines are summed by order before the join; orders without lines have 0."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    sums = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.sum(price).alias("total"))
    o = table(spark, d, "orders").select("o_orderkey").join(sums, "o_orderkey", "left")
    return o.select("o_orderkey", F.coalesce("lines", F.lit(0).cast("long")).alias("lines"), F.round(F.coalesce("total", F.lit(0.0)), 4).alias("total"))


@query("order_lookup", """SELECT c_custkey, coalesce(max_by(o_orderkey, o_orderdate), -1) AS last_order, coalesce(max_by(o_orderstatus, o_orderdate), 'unknown') AS status, count(o_orderkey) AS orders
FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate + o_orderkey * INTERVAL 1 MICROSECOND AS o_orderdate FROM orders) ON c_custkey = o_custkey GROUP BY 1""")  # fmt: skip
def order_lookup(spark, d):
    last = F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(last.alias("l"), F.count(F.lit(1)).alias("orders"))
    c = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return c.select(
        "c_custkey", F.coalesce(F.col("l")["o_orderkey"], F.lit(-1).cast("long")).alias("last_order"),
        F.coalesce(F.col("l")["o_orderstatus"], F.lit("unknown")).alias("status"), F.coalesce("orders", F.lit(0).cast("long")).alias("orders"),
    )


@query("return_contracts", """WITH x AS (SELECT l_orderkey, l_linenumber, c_acctbal > 5000 AS vip, o_orderstatus = 'F' AS completed, l_returnflag <> 'R' AS not_returned,
  l_extendedprice * (1 - l_discount) <= o_totalprice AS within FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
v AS (SELECT unnest(['vip_only', 'completed_only', 'not_returned', 'refund_within']) AS contract, unnest([vip, completed, not_returned, within]) AS passed FROM x)
SELECT contract, count(*) AS checked, count(*) FILTER (NOT passed) AS violations FROM v GROUP BY 1""")  # fmt: skip
def return_contracts(spark, d):
    """How many order lines break each contract of a return."""
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rules = {
        "vip_only": F.col("c_acctbal") > 5000, "completed_only": F.col("o_orderstatus") == "F", "not_returned": F.col("l_returnflag") != "R",
        "refund_within": F.col("l_extendedprice") * (1 - F.col("l_discount")) <= F.col("o_totalprice"),
    }
    each = F.array(*[F.struct(F.lit(k).alias("contract"), c.alias("passed")) for k, c in rules.items()])
    return x.select(F.inline(each)).groupBy("contract").agg(F.count(F.lit(1)).alias("checked"), F.count_if(~F.col("passed")).alias("violations"))


@query("price_position", """WITH q AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY 1, 2)
SELECT p_partkey, round(median(price), 6) AS median_price, count(*) AS offers, round(p_retailprice - median(price), 6) AS gap FROM part JOIN q ON p_partkey = l_partkey GROUP BY p_partkey, p_retailprice""")  # fmt: skip
def price_position(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    q = q.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.percentile("price", 0.5).alias("m"), F.count(F.lit(1)).alias("offers"))
    p = table(spark, d, "part").select("p_partkey", "p_retailprice").join(q, "p_partkey")
    return p.select("p_partkey", F.round("m", 6).alias("median_price"), "offers", F.round(F.col("p_retailprice") - F.col("m"), 6).alias("gap"))


@query("stock_rules", """WITH s AS (SELECT p_partkey, p_retailprice AS price, p_size * 40 - coalesce(sum(l_quantity), 0) AS left_over FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey, p_retailprice, p_size)
SELECT p_partkey, round(left_over, 2) AS left_over, concat_ws(',', CASE WHEN left_over < 0 THEN 'negative_stock' END, CASE WHEN price <= 0 THEN 'bad_price' END) AS violations FROM s WHERE left_over < 0 OR price <= 0""")  # fmt: skip
def stock_rules(spark, d):
    sold = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("sold"))
    s = table(spark, d, "part").join(sold, "p_partkey", "left").withColumn("left_over", F.col("p_size") * 40 - F.coalesce("sold", F.lit(0.0)))
    bad = F.concat_ws(",", F.when(F.col("left_over") < 0, "negative_stock"), F.when(F.col("p_retailprice") <= 0, "bad_price"))
    return s.where((F.col("left_over") < 0) | (F.col("p_retailprice") <= 0)).select("p_partkey", F.round("left_over", 2).alias("left_over"), bad.alias("violations"))


@query("co_purchase_khop", """WITH o AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
e AS (SELECT a.l_partkey AS p, b.l_partkey AS q, count(*) AS n FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY a.l_partkey ORDER BY count(*) DESC, b.l_partkey) <= 5),
h AS (SELECT p, q, 1 AS hop FROM e UNION ALL SELECT a.p, b.q, 2 FROM e a JOIN e b ON a.q = b.p WHERE a.p <> b.q)
SELECT p AS product, q AS related, min(hop) AS hops FROM h GROUP BY 1, 2""")  # fmt: skip
def co_purchase_khop(spark, d):
    """Products reached in two steps, five neighbours a step."""
    from quillstream.operators.graphs import TASK_PAIRS, bought_together, strongest_edges

    e = stored(strongest_edges(bought_together(spark, d), 5).select(F.col("src").alias("p"), F.col("dst").alias("q")), "khop-edges")
    # Each edge stands for itself and for the five behind it.
    tasks = max(1, -(-6 * e.count() // TASK_PAIRS))
    behind = e.select(F.col("p").alias("q"), F.col("q").alias("z")).repartition(tasks, "q")
    two = e.repartition(tasks, "q").join(behind, "q").where("p != z").select("p", F.col("z").alias("q"), F.lit(2).alias("hop"))
    h = e.select("p", "q", F.lit(1).alias("hop")).union(two).repartition(tasks, "p")
    return h.groupBy(F.col("p").alias("product"), F.col("q").alias("related")).agg(F.min("hop").alias("hops"))


@query("user_profile", """WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'vip' ELSE 'regular' END || '|' || c_mktsegment || coalesce('|' || string_agg(o_orderkey::VARCHAR, ',' ORDER BY n), '') AS memory
FROM customer LEFT JOIN o ON c_custkey = o_custkey AND n <= 3 GROUP BY c_custkey, c_acctbal, c_mktsegment""")  # fmt: skip
def user_profile(spark, d):
    """The signals of who a user is and the last three orders, as one line."""
    o = table(spark, d, "orders")
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    o = o.select("o_custkey", "o_orderkey", n.alias("n")).where("n <= 3")
    last = F.transform(F.array_sort(F.collect_list(F.struct("n", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string"))
    o = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(last, ",").alias("last"))
    c = table(spark, d, "customer").join(o, "c_custkey", "left")
    return c.select("c_custkey", F.concat_ws("|", F.when(F.col("c_acctbal") > 5000, "vip").otherwise("regular"), "c_mktsegment", "last").alias("memory"))


@query("retrieve_topk", """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(a, embedding::DOUBLE[]), 4) AS score FROM q JOIN embeddings ON vec_id <> query_id)
SELECT query_id, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""")  # fmt: skip
def retrieve_topk(spark, d, block_queries: int = 4096, part_rows: int = 1 << 14, k: int = 20):
    """The 20 nearest by cosine (4 places) for every row whose id is divisible by 50, against
    all rows.  Blocks of queries meet parts of the data, as many of either as there are rows
    for; a task multiplies few queries at a time, and each keeps no more than the best of a
    part, however many are equal, before the parts are put together."""
    e = table(spark, d, "embeddings").where("embedding IS NOT NULL")
    v = e.select("vec_id", F.col("embedding").alias("v"), F.size("embedding").alias("dims"))
    asked = F.col("vec_id") % 50 == 0
    sizes = e.agg(F.count(F.lit(1)).alias("rows"), F.count_if(asked).alias("queries")).first()
    blocks, parts = (max(1, -(-n // size)) for n, size in ((sizes["queries"], block_queries), (sizes["rows"], part_rows)))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    keys = ["dims", "block", "part"]
    q = v.where(asked).select(F.col("vec_id").alias("query_id"), F.col("v").alias("a"), F.col("dims").alias("dims"), dealt(blocks).alias("block"), upto(parts).alias("part"))
    x = v.withColumn("part", dealt(parts)).withColumn("block", upto(blocks))

    def best_of_part(queries: pa.Table, rows: pa.Table) -> pa.Table:
        matrix = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy().astype(float).reshape(t.num_rows, -1)
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if queries.num_rows and rows.num_rows:
            ids, others = queries.column("query_id").to_numpy(), rows.column("vec_id").to_numpy()
            a, b = matrix(queries, "a"), matrix(rows, "v")
            lengths = np.linalg.norm(b, axis=1)
            for i in range(0, len(ids), 64):
                with np.errstate(invalid="ignore", divide="ignore"):
                    scores = (a[i : i + 64] @ b.T) / (np.linalg.norm(a[i : i + 64], axis=1)[:, None] * lengths)
                # What has no direction comes first, as in SQL.
                scores[np.isnan(scores)] = 2
                for query, row in zip(ids[i : i + 64], scores, strict=True):
                    mine = others != query
                    found, score = best(others[mine], row[mine], k)
                    for column, values in zip(out, (np.full(len(found), query), found, np.where(score == 2, np.nan, score)), strict=True):
                        column.append(values)
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    # A task for each pair of a block and a part, so that none holds many.
    tasks = lambda df: df.repartition(blocks * parts, *keys).groupBy(*keys)
    s = tasks(q).cogroup(tasks(x)).applyInArrow(best_of_part, "query_id long, vec_id long, score double")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return s.withColumn("r", nth).where(F.col("r") <= k).drop("r")


@query("retrieve_chunks", "SELECT doc_id, left(text, 500) AS chunk, round(n_chars / 1000.0::DOUBLE, 4) AS score FROM documents WHERE n_chars > 0")
def retrieve_chunks(spark, d):
    return table(spark, d, "documents").where("n_chars > 0").select("doc_id", F.left("text", F.lit(500)).alias("chunk"), F.round(F.col("n_chars") / 1000.0, 4).alias("score"))
