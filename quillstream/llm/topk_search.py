"""Exact top-k search by inner product with two cover trees.

Queries and data are indexed alike.  The upper level of the tree is a set of pivots, fitted
on a bounded sample; every row belongs to its nearest pivot, and the rows of a pivot form
blocks of bounded size.  A pair of nodes is skipped if the inner product of their centres,
widened by both covering radii, cannot reach the worst k-th score of the node's queries.
That is done first for pairs of pivots (which decides the blocks a query is sent to) and
then, inside a task, for pairs of nodes of the block's cover tree and the queries' one, down to
leaves of ``LEAF`` rows.  How much is skipped depends on the data: vectors that point
everywhere alike leave little to skip, clustered ones much.

Every query starts from its k-th best score among the sample's rows, which are data too.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.llm.common import stored

#: Rows of a leaf: pairs of leaves are one matrix product each.
LEAF = 16
#: The cover radius shrinks by this from level to level.
BASE = 1.3
NEVER = -(2**62)


class Node:
    """A node of a cover tree: its children's centres, its own among them, are further apart
    than the level's cover radius, and every row below it is within that of one of them.
    ``radius`` is the distance of the row farthest from the centre."""

    __slots__ = ("centre", "radius", "rows", "children", "centres", "radii", "norms", "norm")

    def __init__(self, x: np.ndarray, rows: np.ndarray, cover: float | None = None):
        self.rows, self.children = rows, []
        self.centre = x[rows[0]]
        self.norm = float(np.linalg.norm(self.centre))
        d = np.linalg.norm(x[rows] - self.centre, axis=1)
        self.radius = float(d.max())
        if len(rows) <= LEAF or self.radius == 0:
            return
        cover = min(self.radius, self.radius if cover is None else cover) / BASE
        # Farthest first: each new centre is further than the cover radius from those before.
        centres, owner = [0], np.zeros(len(rows), np.int64)
        while d.max() > cover:
            far = int(d.argmax())
            new = np.linalg.norm(x[rows] - x[rows[far]], axis=1)
            owner[new < d] = len(centres)
            d = np.minimum(d, new)
            centres.append(far)
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(len(centres)), side="right")
        for c, mine in zip(centres, np.split(order, ends[:-1]), strict=True):
            self.children.append(Node(x, rows[np.r_[c, mine[mine != c]]], cover))
        self.centres = np.array([c.centre for c in self.children])
        self.radii = np.array([c.radius for c in self.children])
        self.norms = np.array([c.norm for c in self.children])


def ball_bound(centre, norm, radius, centres, norms, radii):
    """The largest inner product of a vector in one ball with a vector in another, and a little
    more than what rounding can take away from any of its terms."""
    reach = radius * norms + radii * norm + radius * radii
    return centres @ centre + reach + 1e-9 * (norm * norms + reach + 1)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while all sums stay below 2**53."""
    if a.size and b.size and np.abs(a).max() * float(np.abs(b).max()) * a.shape[1] >= 2.0**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a.astype(float) @ b.astype(float).T).astype(np.int64)


class DualTree:
    def __init__(self, q_ids, q, start, ids, x, k: int):
        self.q_ids, self.q, self.ids, self.x, self.k = q_ids, q, ids, x, k
        self.worst = start.astype(np.int64).copy()
        self.best: list[list] = [[] for _ in q_ids]
        self.fq, self.fx = q.astype(float), x.astype(float)
        self.scored = 0  # pairs of a query and a row whose inner product was computed
        if len(q_ids) and len(ids):
            self.visit(Node(self.fq, np.arange(len(q_ids))), Node(self.fx, np.arange(len(ids))))

    def visit(self, a: Node, b: Node) -> None:
        if not a.children and not b.children:
            self.leaves(a.rows, b.rows)
        elif not b.children or (a.children and 4 * a.radius > b.radius):  # queries first: a group's bound is its worst
            bounds = ball_bound(b.centre, b.norm, b.radius, a.centres, a.norms, a.radii)
            for n in np.argsort(-bounds):
                if bounds[n] >= self.worst[a.children[n].rows].min():
                    self.visit(a.children[n], b)
        else:
            bounds = ball_bound(a.centre, a.norm, a.radius, b.centres, b.norms, b.radii)
            for n in np.argsort(-bounds):
                if bounds[n] < self.worst[a.rows].min():
                    break
                self.visit(a, b.children[n])

    def leaves(self, qs: np.ndarray, rows: np.ndarray) -> None:
        scores = inner(self.q[qs], self.x[rows])
        self.scored += scores.size
        reaches = scores >= self.worst[qs][:, None]
        for i in np.flatnonzero(reaches.any(1)):
            q = qs[i]
            for j in np.flatnonzero(reaches[i]):
                if self.ids[rows[j]] == self.q_ids[q]:
                    continue
                entry, heap = (int(scores[i, j]), -int(self.ids[rows[j]])), self.best[q]
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                if len(heap) == self.k:
                    self.worst[q] = max(self.worst[q], heap[0][0])


def pick_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows, each farthest from those before: a cover of the sample."""
    if not len(x):
        return x
    at, d = [0], np.linalg.norm(x - x[0], axis=1)
    while len(at) < count and d.max() > 0:
        at.append(int(d.argmax()))
        d = np.minimum(d, np.linalg.norm(x - x[at[-1]], axis=1))
    return x[at]


def topk_search(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 1024,
    k: int = 10,
    sample_rows: int = 2048,
    pivots: int = 48,
    block_rows: int = 1024,
    query_rows: int = 2048,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows but its own.

    Components become floor(scale * x); the score is their exact inner product, ties go to
    the smaller id.  A vector takes no part if it or its id is null, or if it holds a null
    or non-finite component or not the commonest number of components.  Rows that repeat an
    id stand for one vector, the smallest by components.  Scores must fit a long.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    v = F.col(vec_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, finite))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), is_query.alias("q"), ints.alias("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths or not lengths[0]["d"]:
        return spark.createDataFrame([], schema)
    dim = lengths[0]["d"]
    rows = rows.where(F.size("v") == dim).groupBy("id").agg(F.max("q").alias("q"), F.min("v").alias("v"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    s_ids = np.array([r["id"] for r in sample], np.int64)
    s = np.array([r["v"] for r in sample], np.int64).reshape(-1, dim)
    centres = pick_pivots(s.astype(float), pivots)
    known = spark.sparkContext.broadcast((s_ids, s, centres))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s_ids, s, centres = known.value
        for b in batches:
            if not len(b):
                continue
            x = np.stack(list(b["v"])).astype(np.int64)
            f = x.astype(float)
            far = np.sqrt(np.maximum(((f[:, None, :] - centres[None]) ** 2).sum(2), 0)) if len(b) < 512 else np.concatenate(
                [np.sqrt(((f[i : i + 512, None, :] - centres[None]) ** 2).sum(2)) for i in range(0, len(f), 512)]
            )
            pivot = far.argmin(1)
            start = np.full(len(b), NEVER, np.int64)
            asked = np.flatnonzero(b["q"].fillna(False).to_numpy(bool))
            if len(asked):
                scores = inner(x[asked], s)
                scores[b["id"].to_numpy()[asked][:, None] == s_ids[None]] = NEVER
                if len(s_ids) >= k:
                    start[asked] = np.partition(scores, len(s_ids) - k, axis=1)[:, len(s_ids) - k]
            yield pd.DataFrame({"id": b["id"], "q": b["q"].fillna(False).astype(bool), "v": [r.tobytes() for r in x], "pivot": pivot, "far": far.min(1), "start": start})

    placed = stored(rows.mapInPandas(assign, "id long, q boolean, v binary, pivot int, far double, start long"), "topk-placed")
    # One row for each pivot and role: bounded, so the driver may decide about pairs of them.
    role = placed.groupBy("pivot").agg(
        F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.sum(F.col("q").cast("long")).alias("asked"),
        F.max(F.when(F.col("q"), F.col("far"))).alias("q_radius"), F.min(F.when(F.col("q"), F.col("start"))).alias("worst"),
    ).orderBy("pivot").collect()
    asked = sum(r["asked"] for r in role)
    if not asked:
        return spark.createDataFrame([], schema)
    at = np.array([r["pivot"] for r in role])
    norms = np.linalg.norm(centres[at], axis=1)
    radii = np.array([r["radius"] for r in role])
    reach = []  # at most one row for each pair of pivots
    for r in role:
        if r["asked"]:
            c = centres[r["pivot"]]
            bound = ball_bound(c, float(np.linalg.norm(c)), r["q_radius"], centres[at], norms, radii)
            reach += [(r["pivot"], int(p)) for p in at[bound >= r["worst"]]]
    reach_df = F.broadcast(spark.createDataFrame(reach, "pivot int, p int"))
    sizes = F.broadcast(spark.createDataFrame([(r["pivot"], -(-r["n"] // block_rows)) for r in role], "p int, blocks long"))
    q_parts = -(-asked // query_rows)
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(q_parts))
    queries = placed.where("q").select("id", "v", "start", "pivot", part.alias("part")).join(reach_df, "pivot").join(sizes, "p")
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    queries = queries.select("p", "block", "part", "id", "v", "start")
    # A row of data is copied only to the parts of queries that its block is reached by.
    data = placed.withColumnRenamed("pivot", "p").join(sizes, "p").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    parts = placed.where("q").select("pivot", part.alias("part")).distinct().join(reach_df, "pivot").select("p", "part").distinct()
    data = data.join(parts, "p").select("p", "block", "part", "id", "v")
    data = data.select(*(F.col(c).alias(c) for c in data.columns))  # apart from the queries' columns

    def search(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        read = lambda c: np.frombuffer(b"".join(c), np.int64).reshape(-1, dim)
        t = DualTree(queries["id"].to_numpy(), read(queries["v"]), queries["start"].to_numpy(), data["id"].to_numpy(), read(data["v"]), k)
        out = [(int(q), -i, s) for q, heap in zip(t.q_ids, t.best, strict=True) for s, i in heap]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["p", "block", "part"]
    found = queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(embeddings: DataFrame) -> DataFrame:
    return topk_search(embeddings.select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
  GROUP BY vec_id),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM p QUALIFY rank <= 10
"""
