"""Walks over graphs: products reached in several steps, and the levels of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.plans.registry import query
from quillstream.sources.scratch import stored
from quillstream.sources.tables import S_SQL, plan_steps, table

#: Into so many parts the visitors of a node are dealt, so that a hub is no single task's.
SALTS = 16
#: Pairs of products that one task counts, about; some 100 bytes each.
TASK_PAIRS = 500_000


def strongest_edges(edges: DataFrame, fanout: int) -> DataFrame:
    """Each node's ``fanout`` heaviest edges (src, dst, weight), of equal ones the smallest dst."""
    n = F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return edges.withColumn("n", n).where(F.col("n") <= fanout).drop("n")


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int = 3, per_hop: int = 50, salts: int = SALTS, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(seed, node, hop, weight): what each seed reaches, hop by hop.

    A hop follows the ``per_hop`` heaviest edges of each node of the frontier and keeps the
    ``per_hop`` heaviest nodes that the seed has not met before; a path weighs the product of
    its edges, a node its heaviest path.  Every round is a stored table.  A node's edges are
    one list.  Many seeds may stand at one node: those of a hub are dealt by salt, and its
    list alone is copied.  There are as many tasks as steps ask for, so that what a task
    holds doesn't grow with the input.
    """
    ways = strongest_edges(edges, per_hop).groupBy("src").agg(F.collect_list(F.struct("dst", "weight")).alias("ways"))
    ways = stored(ways, "hop-edges")
    lists = ways.count()
    frontier = seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("hop"), F.lit(1).cast("long").alias("weight"))
    frontier = stored(frontier.distinct(), "hop-0")
    met = frontier
    for hop in range(1, hops + 1):
        rows = frontier.count()
        if not rows:
            break
        # A list may be as long as per_hop edges.
        tasks = max(1, -(-max(rows, lists) * per_hop // task_pairs))
        hubs = frontier.groupBy("node").count().where(F.col("count") > max(1, task_pairs // per_hop)).select(F.col("node").alias("hub"))
        # Hubs are few, as each is many rows of the frontier.
        hubs = F.broadcast(stored(hubs, "hop-hubs"))
        at = frontier.select("seed", F.col("node").alias("src"), F.col("weight").alias("so_far")).join(hubs, F.col("src") == F.col("hub"), "left")
        at = at.select("seed", "src", "so_far", F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("seed"), F.lit(salts)).cast("int")).otherwise(0).alias("salt"))
        copies = F.when(F.col("hub").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        to = ways.join(hubs, F.col("src") == F.col("hub"), "left").select("src", "ways", F.explode(copies).alias("salt"))
        dealt = lambda df: df.repartition(tasks, "src", "salt")
        # Lists go to their seeds whole; what a seed has met goes beside its steps.
        steps = dealt(at).join(dealt(to), ["src", "salt"]).select("seed", "so_far", "ways")
        before = met.select("seed", F.lit(None).cast("long").alias("so_far"), F.array(F.struct(F.col("node").alias("dst"), F.lit(None).cast("long").alias("weight"))).alias("ways"))
        each = steps.unionByName(before).repartition(tasks, "seed").select("seed", "so_far", F.explode("ways").alias("way"))
        each = each.select("seed", F.col("way.dst").alias("node"), (F.col("so_far") * F.col("way.weight")).alias("weight"), F.col("so_far").isNull().alias("met"))
        new = each.groupBy("seed", "node").agg(F.max("weight").alias("weight"), F.max("met").alias("met")).where(~F.col("met"))
        n = F.row_number().over(W.partitionBy("seed").orderBy(F.desc("weight"), "node"))
        new = new.withColumn("n", n).where(F.col("n") <= per_hop).select("seed", "node", F.lit(hop).alias("hop"), "weight")
        frontier = stored(new, f"hop-{hop}")
        met = met.union(frontier)
    return met.where("hop > 0")


def bought_together(spark, d: str, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(src, dst, weight): in how many orders two products stand together; an order's lines are
    few, and so are its pairs.  Pairs are counted by their first product, in as many tasks as
    there are pairs for, so that what a task holds doesn't grow with the input."""
    orders = table(spark, d, "lineitem").where("l_partkey IS NOT NULL AND l_orderkey IS NOT NULL").groupBy("l_orderkey")
    orders = stored(orders.agg(F.collect_set("l_partkey").alias("ps")), "orders-products")
    pairs = orders.agg(F.sum(F.size("ps").cast("long") * (F.size("ps") - 1)).alias("n")).first()["n"] or 0
    tasks = max(1, -(-pairs // task_pairs))
    # Orders are dealt out first: what a task writes is a product with its whole order, less than its pairs.
    first = orders.repartition(tasks, "l_orderkey").select("ps", F.explode("ps").alias("src")).repartition(tasks, "src")
    each = first.select("src", F.explode("ps").alias("dst")).where("src != dst")
    return each.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def _hop_sql(hop: int) -> str:
    before = " UNION ALL ".join(f"SELECT seed, node FROM h{i}" for i in range(hop))
    return f"""h{hop} AS (SELECT seed, dst AS node, max(h.weight * e.weight)::BIGINT AS weight FROM h{hop - 1} h JOIN e ON h.node = e.src
 WHERE (seed, dst) NOT IN ({before}) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY max(h.weight * e.weight) DESC, dst) <= 50)"""


@query("co_purchase_3hop", f"""WITH o AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS weight FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY a.l_partkey ORDER BY count(*) DESC, b.l_partkey) <= 50),
h0 AS (SELECT p_partkey AS seed, p_partkey AS node, 1::BIGINT AS weight FROM part WHERE p_partkey % 50 = 0), {_hop_sql(1)}, {_hop_sql(2)}, {_hop_sql(3)}
SELECT seed, node, 1 AS hop, weight FROM h1 UNION ALL SELECT seed, node, 2, weight FROM h2 UNION ALL SELECT seed, node, 3, weight FROM h3""")  # fmt: skip
def co_purchase_3hop(spark, d):
    """Three hops of 50 from every product whose key is divisible by 50."""
    seeds = table(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("seed"))
    return k_hop(bought_together(spark, d), seeds)


def longest_paths(deps: Column) -> Column:
    """The level of each step of a plan, given for each the steps that it depends on (those that
    the plan has not are no dependency): 0 without any, else one more than the highest of
    them; -1 for steps on or behind a cycle.  A round gives a level to the steps whose
    dependencies have theirs, so there are at most as many rounds as steps."""
    unknown = F.transform(deps, lambda _: F.lit(-1))

    def round_(levels: Column, _: Column) -> Column:
        def level(was: Column, of: Column) -> Column:
            known = F.transform(F.filter(of, lambda x: (x >= 0) & (x < F.size(deps))), lambda x: F.get(levels, x.cast("int")))
            next_ = F.coalesce(F.array_max(known), F.lit(-1)) + 1
            return F.when(was >= 0, was).when(F.exists(known, lambda x: x < 0), F.lit(-1)).otherwise(next_)

        return F.zip_with(levels, deps, level)

    return F.aggregate(F.sequence(F.lit(1), F.size(deps)), unknown, round_)


def plan_dependencies(steps: DataFrame) -> DataFrame:
    """user_id, day, deps: of each step the one before it by its own count, and for every fourth
    kind of call the step two places up as well."""
    second = F.when((F.col("k") % 4 == 0) & (F.col("step") >= 2), F.col("step") - 2)
    both = F.filter(F.array("dep", second), lambda x: x.isNotNull())
    return steps.groupBy("user_id", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", both.alias("d")))), lambda x: x["d"]).alias("deps"))


@query("plan_levels", f"""WITH RECURSIVE {S_SQL}, edges AS (SELECT user_id, day, n, step, dep FROM s WHERE dep >= 0 AND dep < n UNION SELECT user_id, day, n, step, step - 2 FROM s WHERE k % 4 = 0 AND step >= 2),
walk AS (SELECT user_id, day, n, step, step AS at, 0 AS len FROM s UNION SELECT w.user_id, w.day, w.n, w.step, e.dep, w.len + 1 FROM walk w JOIN edges e ON e.user_id = w.user_id AND e.day = w.day AND e.step = w.at WHERE w.len < w.n),
lv AS (SELECT user_id, day, n, step, CASE WHEN max(len) >= n THEN -1 ELSE max(len) END AS level FROM walk GROUP BY user_id, day, n, step)
SELECT user_id, day, level, count(*) AS width, max(level) OVER (PARTITION BY user_id, day) + 1 AS critical_length FROM lv GROUP BY user_id, day, level""")  # fmt: skip
def plan_levels(spark, d):
    """The stages in which a plan's steps could run together: level, how many steps are in it,
    and how many levels there are.  Level -1 holds the steps that a cycle keeps from running."""
    levels = plan_dependencies(plan_steps(spark, d)).withColumn("levels", longest_paths(F.col("deps")))
    levels = levels.withColumn("critical_length", F.array_max("levels") + 1)
    each = levels.select("user_id", "day", "critical_length", F.explode("levels").alias("level"))
    return each.groupBy("user_id", "day", "level", "critical_length").agg(F.count(F.lit(1)).alias("width"))
