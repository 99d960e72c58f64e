"""Mixing sources to target weights by systematic sampling.

Within a source every document expects ``target / source size`` copies.  The documents
stand in order of size (then of a hash), their expected copies are summed up from the
first, one random offset is added, and a document is emitted once for each integer
boundary that its step crosses.  The order by size keeps the words taken within about
one document's length of the target.

The prefix sums are exact at any size without one task per source: counts by
(source, size, part) are summed first, a window over those few rows gives each part its
start, and rows are numbered only inside a part.  Parts of one size hold about
``part_rows`` rows, so a hot source, or a hot size inside it, is split by hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.llm.common import WORD_RE, hex_unit, stored


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """Targets of sources from (src, source_size); src is a key that sorts by code point.

    Weights repeat over the sources in order.  A source's target stops at ``max_repeat``
    times its size; what is above is shared again by weight until none is above.  Sorted
    by cap over weight, the sources that stop come first, so running sums find the last
    of them without a loop.  The windows here see one row per source.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    n = F.row_number().over(W.orderBy("src")) - 1
    w = sizes.withColumn("w", F.element_at(cycle, (n % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size").cast("double") * max_repeat)
    before = W.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy()).cast("double")
    w = w.withColumn("per_weight", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    w = w.withColumn("stops", F.col("cap") < F.col("per_weight") * F.col("w"))
    # The first source that doesn't stop has the smallest cap by weight of those left.
    first = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("w"), "src", "per_weight"))).over(W.partitionBy())
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.least("cap", first["per_weight"] * F.col("w")))
    return w.select("src", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_to_targets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    max_repeat: int = 3,
    seed: int = 17,
    part_rows: int = 1024,
) -> DataFrame:
    """(id, size, source_size, target, copies, taken) for every row of ``docs``.

    A null or empty text has size 0 and a source of size 0 has target 0; its rows get no
    copies.  Null sources are one source, last in order.  Rows repeated whole are drawn
    one by one.  The result depends on the rows and the seed alone, so reruns agree.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_RE)).cast("long")
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        key.alias("src"),
        size.alias("size"),
        F.md5(F.concat(ident, F.lit(f"/{seed}"))).alias("h"),
    )
    rows = stored(rows, "mix-sizes")  # word counts are taken once
    by_size = rows.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = by_size.groupBy("src").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal = targets(sizes, weights, max_repeat)
    starts = by_size.select(
        "src",
        "size",
        F.ceil(F.col("n") / part_rows).alias("parts"),
        (F.sum("n").over(W.partitionBy("src").orderBy("size")) - F.col("n")).alias("start"),
    ).join(goal, "src")
    rows = rows.join(starts, ["src", "size"])
    unit = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    rows = rows.withColumn("part", F.floor(unit * F.col("parts")))
    counts = rows.groupBy("src", "size", "part").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.select(
        "src", "size", "part", (F.sum("m").over(W.partitionBy("src", "size").orderBy("part")) - F.col("m")).alias("inner")
    )
    rows = rows.join(counts, ["src", "size", "part"])
    nth = F.row_number().over(W.partitionBy("src", "size", "part").orderBy("h", "id"))
    rank = F.col("start") + F.col("inner") + nth
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = hex_unit(F.concat(F.lit(f"offset/{seed}/"), F.col("src")))
    rows = rows.withColumn("rank", rank).withColumn("each", each).withColumn("offset", offset)
    crossed = F.floor(F.col("rank") * F.col("each") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("each") + F.col("offset"))
    copies = F.least(crossed, F.lit(max_repeat)).cast("long")
    return rows.select(
        F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def op7(docs: DataFrame) -> DataFrame:
    return mix_to_targets(docs).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '/17') AS h
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 3 AS cap FROM d GROUP BY src),
w AS (SELECT *, ((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::DOUBLE AS w FROM s),
p AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE
     - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
     / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS per_weight FROM w),
f AS (SELECT per_weight AS lam FROM p WHERE NOT (cap < per_weight * w) ORDER BY cap / w, src LIMIT 1),
t AS (
  SELECT src, source_size,
         CASE WHEN cap < per_weight * w THEN cap ELSE least(cap, (SELECT lam FROM f) * w) END AS target,
         ('0x' || substr(md5('offset/17/' || src), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM p),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS each,
         row_number() OVER (PARTITION BY d.src ORDER BY d.size, d.h, d.doc_id) AS n
  FROM d JOIN t USING (src))
SELECT doc_id, size, source_size, target,
       least(floor(n * each + u) - floor((n - 1) * each + u), 3)::BIGINT * size AS taken
FROM r
"""
