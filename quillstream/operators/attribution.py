"""Last-touch attribution within seven days, and the figures that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions.experiments import bucket
from quillstream.plans.registry import query
from quillstream.sources.tables import P_SQL, events, level, purchases, touches


def last_touch(touched: DataFrame, bought: DataFrame) -> DataFrame:
    """The nearest touch of each purchase: same user and product, at most seven days before,
    both ends included; of equal times the smallest trace.  The equi-join on user and
    product spreads busy users, and the best touch is combined before the shuffle."""
    pairs = bought.join(touched, ["user_id", "product"])
    pairs = pairs.where((F.col("touched") <= F.col("bought")) & (F.col("bought") <= F.col("touched") + F.expr("INTERVAL 7 DAYS")))
    best = F.max(F.struct("touched", (-F.col("trace_id")).alias("t")))
    hit = pairs.groupBy("event_id", "user_id", "product", "bought").agg(best.alias("b"))
    hours = F.timestamp_diff("MICROSECOND", F.col("b")["touched"], F.col("bought")) / 3600000000.0
    return hit.select("event_id", "user_id", "product", (-F.col("b")["t"]).alias("trace_id"), hours.alias("hours"))


@query("attr_last_touch", f"WITH {P_SQL} SELECT event_id, user_id, product, trace_id, round(hours, 6) AS hours FROM lt")
def attr_last_touch(spark, d):
    return last_touch(touches(spark, d), purchases(spark, d)).withColumn("hours", F.round("hours", 6))


@query("attr_organic", f"WITH {P_SQL} SELECT event_id, user_id, product FROM p WHERE event_id NOT IN (SELECT event_id FROM lt)")
def attr_organic(spark, d):
    bought = purchases(spark, d)
    return bought.join(last_touch(touches(spark, d), bought), "event_id", "left_anti").select("event_id", "user_id", "product")


def _rates(by: str) -> str:
    return f"""SELECT {by}, count(*) FILTER (l = 'impression') AS impressions, count(*) FILTER (l = 'click') AS clicks,
  count(*) FILTER (l = 'add_to_cart') AS carts, count(*) FILTER (l = 'purchase') AS purchases, count(*) FILTER (l = 'returned') AS returns,
  round(count(*) FILTER (l = 'click')::DOUBLE / greatest(count(*) FILTER (l = 'impression'), 1), 4) AS ctr,
  round(count(*) FILTER (l = 'add_to_cart')::DOUBLE / greatest(count(*) FILTER (l = 'click'), 1), 4) AS atc_rate,
  round(count(*) FILTER (l = 'purchase')::DOUBLE / greatest(count(*) FILTER (l = 'impression'), 1), 4) AS conversion_rate,
  round(count(*) FILTER (l = 'returned')::DOUBLE / greatest(count(*) FILTER (l = 'purchase'), 1), 4) AS return_rate,
  round(coalesce(sum(hours), 0.0) / greatest(count(hours), 1), 1) AS avg_time_to_purchase_hours
  FROM x GROUP BY {by}"""


_X_SQL = f"""WITH {P_SQL}, x AS (SELECT e.user_id, e.k % 10 AS product,
  CASE WHEN ('0x' || substr(sha256('exp:user_' || e.user_id), 1, 8))::BIGINT % 2 = 0 THEN 'control' ELSE 'treatment' END AS experiment_group,
  CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'click' WHEN 'signup' THEN 'add_to_cart'
    WHEN 'purchase' THEN 'purchase' ELSE 'returned' END AS l, lt.hours
  FROM e LEFT JOIN lt ON e.event_id = lt.event_id) """


def kpis(rows: DataFrame, by: str) -> DataFrame:
    """Counts by level and their rates (4 places), denominators 1 at least; mean hours only
    over rows that have them."""
    n = lambda name: F.count_if(F.col("level") == name)
    rate = lambda a, b: F.round(n(a) / F.greatest(n(b), F.lit(1)), 4)
    return rows.groupBy(by).agg(
        n("impression").alias("impressions"), n("click").alias("clicks"), n("add_to_cart").alias("carts"),
        n("purchase").alias("purchases"), n("returned").alias("returns"),
        rate("click", "impression").alias("ctr"), rate("add_to_cart", "click").alias("atc_rate"),
        rate("purchase", "impression").alias("conversion_rate"), rate("returned", "purchase").alias("return_rate"),
        F.round(F.coalesce(F.sum("hours"), F.lit(0.0)) / F.greatest(F.count("hours"), F.lit(1)), 1).alias("avg_time_to_purchase_hours"),
    )


def attributed(spark, d) -> DataFrame:
    hours = last_touch(touches(spark, d), purchases(spark, d)).select("event_id", "hours")
    e = events(spark, d).join(hours, "event_id", "left")
    group = bucket("exp", F.concat(F.lit("user_"), F.col("user_id").cast("string")), ["control", "treatment"])
    return e.select("user_id", (F.col("k") % 10).alias("product"), group.alias("experiment_group"), level(F.col("event_type")).alias("level"), "hours")


@query("attr_kpis", _X_SQL + _rates("experiment_group"))
def attr_kpis(spark, d):
    return kpis(attributed(spark, d), "experiment_group")


@query("attr_kpis_by_product", _X_SQL + _rates("product"))
def attr_kpis_by_product(spark, d):
    return kpis(attributed(spark, d), "product")


#: Ways to find the touch that a purchase is due to.
MODELS = {"last_touch": last_touch}


@query("attr_kpis_totals", _X_SQL.rstrip() + ", y AS (SELECT * REPLACE ('total' AS experiment_group) FROM x UNION ALL SELECT * REPLACE (CASE WHEN product = 9 THEN 'unknown' ELSE product::VARCHAR END AS experiment_group) FROM x) " + _rates("experiment_group").replace("FROM x ", "FROM y "))
def attr_kpis_totals(spark, d, model: str = "last_touch"):
    """KPIs by an attribute, here the product, 9 being none; what has none is 'unknown', and
    all rows together are 'total'."""
    if model not in MODELS:
        raise ValueError(f"no attribution model {model}")
    x = attributed(spark, d)
    named = F.coalesce(F.when(F.col("product") != 9, F.col("product").cast("string")), F.lit("unknown"))
    return kpis(x.withColumn("experiment_group", F.explode(F.array(F.lit("total"), named))), "experiment_group")
