"""Connected components of a graph given by its links, in joins and groupings alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in a link; component is the smallest id it reaches.

    Every round gives each id the smallest label among its neighbours and then that
    label's own label, so that a chain's length at least halves.  Each round is written
    to the shared folder, which cuts the lineage.
    """
    both = links.select(F.col(a).alias("id"), F.col(b).alias("other")).union(links.select(F.col(b), F.col(a)))
    both = stored(both.where("id != other").distinct(), "cc-links")
    labels = stored(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("near"))
        moved = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        moved = moved.join(jump, "component").select("id", "was", F.least("component", "next").alias("component"))
        moved = stored(moved, "cc-labels")
        labels = moved.select("id", "component")
        if not moved.where("component != was").limit(1).count():
            return labels
