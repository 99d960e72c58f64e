"""Exact deduplication: group by 128-bit content hash, compare bytes, keep one id.

Rows are grouped by the MD5 of their text alone, so a hash, an id and a count are all that
the shuffle carries, one row from each task however large a group of copies is.  Inside
every group of two or more the bytes are then compared: the smallest and the largest text
of a hash are found, again combined in each task, and only if both are the same is the group
one text.  A hash that two texts share is grouped once more by the texts themselves.
Groups of one row need nothing else, so rows learn of their group by a join with the groups
of several rows, which is broadcast up to a size and dealt out by salted hash beyond it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import ascii_lower, stored

#: Where groups are not broadcast, the rows of one go to so many tasks.
SALTS = 16


def _with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], small: bool, how: str) -> DataFrame:
    if small:
        return rows.join(F.broadcast(groups), keys, how)
    salted = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return rows.join(salted, [*keys, "__salt"], how).drop("__salt")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    digest: Callable[[Column], Column] = F.md5,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """Add ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` to every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty.
    ``keep`` ("min" or "max") says which id of a group stays.  A null id stays only where
    its whole group has none.  Rows that repeat both id and text are one document: each
    of them reports the same result.  An empty table gives an empty result.  Columns of
    ``docs`` with one of the four names are replaced; none may begin with two underscores.
    ``digest`` gives the hash; a worse one changes the cost, never the result.
    """
    best = {"min": F.min, "max": F.max}[keep]
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.withColumn("__norm", norm).withColumn("__hash", digest(F.col("__norm")))
    found = [best(id_col).alias("__keep"), F.count(F.lit(1)).alias("__size")]
    groups = stored(rows.groupBy("__hash").agg(*found).where("__size > 1"), "dedup-groups")
    small = groups.count() <= broadcast_rows  # some 60 bytes each
    shared = _with_groups(rows.select("__hash", "__norm"), groups.select("__hash"), ["__hash"], small, "inner")
    ends = shared.groupBy("__hash").agg(F.min("__norm").alias("__low"), F.max("__norm").alias("__high"))
    collisions = stored(ends.where("__low != __high").select("__hash"), "dedup-collisions")
    met = collisions.count()
    if met:
        clean = groups.join(collisions, "__hash", "left_anti")
    else:
        clean = groups
    joined = _with_groups(rows, clean, ["__hash"], small, "left")
    if met:  # the hash does not tell these apart: the texts do
        apart = _with_groups(rows.select("__hash", "__norm", id_col), collisions, ["__hash"], met <= broadcast_rows, "inner")
        apart = stored(apart.groupBy("__hash", "__norm").agg(best(id_col).alias("__keep2"), F.count(F.lit(1)).alias("__size2")), "dedup-apart")
        joined = joined.join(apart, ["__hash", "__norm"], "left")
        of_group = {c: F.when(F.col("__size2").isNotNull(), F.col(c + "2")).otherwise(F.col(c)) for c in ("__keep", "__size")}
        joined = joined.withColumns(of_group)
    keep_id = F.when(F.col("__size").isNull(), F.col(id_col)).otherwise(F.col("__keep"))
    out = {
        "keep_id": keep_id,
        "group_size": F.coalesce("__size", F.lit(1).cast("long")),
        "kept": F.col(id_col).eqNullSafe(keep_id),
        "text_sha256": F.sha2("__norm", 256),
    }
    own = [c for c in docs.columns if c not in out]
    return joined.select(*own, *(c.alias(k) for k, c in out.items()))


def op4(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text")
    return exact_dedup(rows, keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
