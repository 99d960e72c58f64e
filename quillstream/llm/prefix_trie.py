"""Conversation prefix trie: which beginnings conversations share, from sorted neighbours.

A conversation is the sequence of its turns' digests.  Distinct sequences are sorted in range
partitions.  In each, the edges between neighbours, labelled with the length of their common
beginning, are taken in descending order: union-find joins the components on both sides, and
every merge makes a branching node.  Of a partition's forest all is final but the beginnings
of its first and last sequence; with what hangs on them they are contracted to weighted
sequences, which are merged across the boundaries in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.llm.common import broadcast_if_small, crc_text, stored

#: Bytes of a turn's digest.
DIGEST = 16
#: Distinct sequences of a partition, about; turns by which partitions are told apart.
PART_ROWS, RANGE_TURNS = 200_000, 256
#: Members' ids that are joined in one row at most.
CHUNK_IDS = 4096
BROADCAST_ROWS = 500_000

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: Kinds of rows that a partition gives: a node, and a weighted beginning for the merge.
PLACED = NODES + ", part int, slot int, turns binary, sizes array<long>"


class Forest:
    """The compressed trie of sorted, distinct, weighted sequences.

    ``keys`` are joined digests, ``sizes`` the lengths of the turns' texts.  A weight is what
    stands at the very end of a sequence: its members (``count``), the smallest (``least``),
    and of finished subtrees there the children, leaves and saved tokens.
    """

    def __init__(self, keys: list[bytes], sizes: list[np.ndarray], count, least, children, leaves, saved):
        self.keys = keys
        self.sums = [np.concatenate([[0], np.cumsum(s)]) for s in sizes]
        n = len(keys)
        self.depth = [len(k) // DIGEST for k in keys]
        self.rep, self.parent = list(range(n)), [-1] * n
        self.count, self.least, self.children, self.leaves, self.saved = (list(x) for x in (count, least, children, leaves, saved))
        self.same = list(range(2 * n))  # a node that turned out to be another
        self._merge([self._common(i) for i in range(n - 1)])
        self._sum()

    def _common(self, i: int) -> int:
        """Turns that sequences i and i + 1 begin with alike."""
        a, b = self.keys[i], self.keys[i + 1]
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            return n // DIGEST
        x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
        return int(np.argmax(x != y)) // DIGEST

    def _merge(self, common: list[int]) -> None:
        n = len(self.keys)
        head, top = list(range(n)), list(range(n))  # of components: union-find, and the node above all

        def find(x: int) -> int:
            while head[x] != x:
                head[x] = head[head[x]]
                x = head[x]
            return x

        for i in np.argsort(-np.array(common, np.int64), kind="stable").tolist():
            d, a, b = common[i], find(i), find(i + 1)
            u, v = top[a], top[b]
            if self.depth[u] == d:
                if self.depth[v] == d:  # both are the node of this beginning
                    self._absorb(u, v)
                else:
                    self.parent[v] = u
                above = u
            elif self.depth[v] == d:
                self.parent[u] = above = v
            else:
                above = len(self.depth)
                self.depth.append(d)
                self.rep.append(self.rep[u])
                self.parent.append(-1)
                for column, nothing in ((self.count, 0), (self.least, None), (self.children, 0), (self.leaves, 0), (self.saved, 0)):
                    column.append(nothing)
                self.parent[u] = self.parent[v] = above
            head[b] = a
            top[a] = above

    def _absorb(self, u: int, v: int) -> None:
        self.same[v] = u
        for column in (self.count, self.children, self.leaves, self.saved):
            column[u] += column[v]
        self.least[u] = min((x for x in (self.least[u], self.least[v]) if x is not None), default=None)

    def node(self, x: int) -> int:
        while self.same[x] != x:
            x = self.same[x]
        return x

    def _sum(self) -> None:
        """Carry members, leaves and saved tokens from each node to the one above, deepest first."""
        self.nodes = sorted((x for x in range(len(self.depth)) if self.same[x] == x), key=lambda x: -self.depth[x])
        self.own = [(c, m, k, f, s) for c, m, k, f, s in zip(self.count, self.least, self.children, self.leaves, self.saved, strict=True)]
        for x in self.nodes:
            if not self.children[x]:
                self.leaves[x] = 1
            if self.parent[x] >= 0:
                above = self.parent[x] = self.node(self.parent[x])
                self.add(x, above)

    def add(self, x: int, above: int) -> None:
        self.count[above] += self.count[x]
        self.least[above] = min((m for m in (self.least[above], self.least[x]) if m is not None), default=None)
        self.children[above] += 1
        self.leaves[above] += self.leaves[x]
        self.saved[above] += self.edge(x)

    def edge(self, x: int) -> int:
        """Saved tokens of a subtree and of the turns between its top and the node above."""
        sums, above = self.sums[self.rep[x]], self.depth[self.parent[x]]
        return self.saved[x] + (self.count[x] - 1) * int(sums[self.depth[x]] - sums[above])

    def rows(self, x: int, parent_conv, ends: str | None, none: str) -> list[tuple]:
        """A node and those between it and the one above, as rows of NODES."""
        sums, n, bottom = self.sums[self.rep[x]], self.count[x], self.depth[x]
        up = self.depth[self.parent[x]] if self.parent[x] >= 0 else bottom - 1
        out = []
        for d in range(bottom, up, -1):
            saved = self.saved[x] + (n - 1) * int(sums[bottom] - sums[max(d - 1, 0)])
            kids, end = (self.children[x], ends or none) if d == bottom else (1, none)
            over = parent_conv if d == up + 1 else self.least[x]
            out.append((self.least[x], d, over if d else None, n, kids, self.leaves[x], saved, end))
        return out


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def as_sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, sizes): each conversation's digests joined, and its texts' lengths."""
    t = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    # A length in front, so that no role and text are another role and text together.
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text")
    t = t.withColumn("nth", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    t = t.select("conv_id", F.struct("nth", F.substring(_sha(whole), 1, 2 * DIGEST).alias("digest"), F.length("text").cast("long").alias("size")).alias("t"))
    t = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return t.select("conv_id", F.unhex(F.array_join("t.digest", "")).alias("turns"), F.col("t.size").alias("sizes"))


def rebuilt(turns: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Conversations that begin with the first h turns of the first of their ``group``, h being
    the checksum of the id modulo ``heads``, and go on with their own turns after those."""
    own = stored(as_sequences(turns), "trie-own")
    first = own.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.substring("turns", 1, DIGEST * (heads - 1)).alias("head"), F.slice("sizes", 1, heads - 1).alias("head_sizes")
    )
    h = (crc_text(F.col("conv_id")) % heads).cast("int")
    both = own.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")).join(first, "base", "left")
    bytes_of = lambda c, start, n: F.substring(c, start, n)
    head = F.coalesce(bytes_of(F.col("head"), F.lit(1), F.col("h") * DIGEST), F.lit(b""))
    rest = bytes_of(F.col("turns"), F.col("h") * DIGEST + 1, F.octet_length("turns"))
    sizes = F.concat(
        F.coalesce(F.slice("head_sizes", F.lit(1), F.col("h")), F.array().cast("array<long>")), F.slice("sizes", F.col("h") + 1, F.greatest(F.size("sizes"), F.lit(1)))
    )
    return both.select("conv_id", F.concat(head, rest).alias("turns"), sizes.alias("sizes"))


def with_members(sequences: DataFrame) -> DataFrame:
    """Distinct sequences (turns, sizes, n, conv_id, ends_sha256): members, the smallest, and
    the hash of all.  Ids are joined in rows of CHUNK_IDS at most, in order, and a sequence's
    rows are hashed one after the other, however many members it has."""
    s = stored(sequences.withColumn("seq", F.unhex(F.substring(F.sha2("turns", 256), 1, 32))), "trie-sequences")
    chunk = F.floor(F.col("conv_id") / CHUNK_IDS)
    parts = s.groupBy("seq", chunk.alias("chunk")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    parts = parts.select("seq", "chunk", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("conv_id"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        last, state = None, None
        for batch in batches:
            done = []
            for seq, n, conv, text in zip(*(batch.column(c).to_pylist() for c in ("seq", "n", "conv_id", "text")), strict=True):
                if seq == last:
                    state[2].update(b"," + text.encode())
                    state[0] += n
                else:
                    if last is not None:
                        done.append((state[1], state[0], state[2].hexdigest()))
                    last, state = seq, [n, conv, hashlib.sha256(text.encode())]
            yield _batch(done, MEMBERS)
        if last is not None:
            yield _batch([(state[1], state[0], state[2].hexdigest())], MEMBERS)

    ordered = parts.repartition("seq").sortWithinPartitions("seq", "chunk")
    least = ordered.mapInArrow(digest, "conv_id long, n long, ends_sha256 string")
    return s.drop("seq").join(least, "conv_id")


MEMBERS = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("ends_sha256", pa.string())])
_NODE_FIELDS = [pa.field(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in NODES.split(", ")]
_PLACED_FIELDS = [*_NODE_FIELDS, pa.field("part", pa.int32()), pa.field("slot", pa.int32()), pa.field("turns", pa.binary()), pa.field("sizes", pa.list_(pa.int64()))]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _empty_hash() -> str:
    import hashlib

    return hashlib.sha256(b"").hexdigest()


def partition_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition's final nodes (``turns`` null; ``slot`` names the place of an open
    parent), and its open beginnings, contracted with all that hangs on them."""
    from pyspark import TaskContext

    part, none = TaskContext.get().partitionId(), _empty_hash()
    keys, sizes, count, least, ends = [], [], [], [], []
    for batch in batches:
        keys += batch.column("turns").to_pylist()
        sizes += [np.array(s, np.int64) for s in batch.column("sizes").to_pylist()]
        for held, c in ((count, "n"), (least, "conv_id"), (ends, "ends_sha256")):
            held += batch.column(c).to_pylist()
    if not keys:
        return
    n = len(keys)
    f = Forest(keys, sizes, count, least, [0] * n, [0] * n, [0] * n)
    open_: dict[int, int] = {}
    for x in (0, n - 1):
        x = f.node(x)
        while x >= 0 and x not in open_:
            open_[x] = len(open_)
            x = f.parent[x]
    end_of = {f.node(i): e for i, e in enumerate(ends)}
    weight = {x: [*f.own[x]] for x in open_}
    out: list[tuple] = []
    schema = pa.schema(_PLACED_FIELDS)
    for x in f.nodes:
        if x in open_:
            continue
        above = f.parent[x]
        slot = open_.get(above)
        if slot is not None:
            w = weight[above]
            w[0] += f.count[x]
            w[1] = min(m for m in (w[1], f.least[x]) if m is not None)
            w[2] += 1
            w[3] += f.leaves[x]
            w[4] += f.edge(x)
        rows = f.rows(x, None if slot is not None else f.least[above], end_of.get(x), none)
        out += [(*r, part, slot if slot is not None and r[1] == f.depth[above] + 1 else None, None, None) for r in rows]
        if len(out) > 20_000:
            yield _batch(out, schema)
            out = []
    for x, slot in open_.items():
        c, m, k, v, s = weight[x]
        key, lengths = keys[f.rep[x]][: DIGEST * f.depth[x]], sizes[f.rep[x]][: f.depth[x]]
        out.append((m, f.depth[x], None, c, k, v, s, end_of.get(x), part, slot, key, lengths))
    yield _batch(out, schema)


def merge_boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All open beginnings, sorted: their final nodes, and with ``turns`` set, for each part and
    slot the conversation that its node is named after."""
    none = _empty_hash()
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    merged: dict[bytes, dict] = {}
    for r in rows:
        one = merged.setdefault(r["turns"], r | {"at": [], "n_convs": 0, "conv_id": None, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "ends_sha256": None})
        for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            one[c] += r[c]
        one["conv_id"] = min((x for x in (one["conv_id"], r["conv_id"]) if x is not None), default=None)
        one["ends_sha256"] = one["ends_sha256"] or r["ends_sha256"]
        one["at"].append((r["part"], r["slot"]))
    empty = {"turns": b"", "sizes": [], "n_convs": 0, "conv_id": None, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "ends_sha256": None, "at": []}
    merged.setdefault(b"", empty)  # the root, whatever else there is
    kept = [merged[k] for k in sorted(merged)]
    column = lambda c: [r[c] for r in kept]
    f = Forest(column("turns"), [np.array(s, np.int64) for s in column("sizes")], column("n_convs"), column("conv_id"), column("n_children"), column("n_leaves"), column("saved_tokens"))
    end_of = {f.node(i): r["ends_sha256"] for i, r in enumerate(kept) if r["ends_sha256"]}
    out = []
    for x in f.nodes:
        above = f.parent[x]
        out += [(*r, None, None, None, None) for r in f.rows(x, f.least[above] if above >= 0 else None, end_of.get(x), none)]
    for i, r in enumerate(kept):
        out += [(f.least[f.node(i)], *[None] * 7, part, slot, b"", None) for part, slot in r["at"]]
    for i in range(0, len(out), 20_000):
        yield _batch(out[i : i + 20_000], pa.schema(_PLACED_FIELDS))


def prefix_trie(sequences: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The nodes of the trie of sequences (conv_id, turns, sizes), a row each.

    conv_id is the smallest member; the root has no parent; a conversation without turns is a
    member of the root alone.  An empty table has no members and so no nodes.  A partition
    holds about ``part_rows`` distinct sequences; those that begin with the same RANGE_TURNS
    turns share one.  The merge across boundaries reads a few rows of each partition.
    """
    distinct = stored(with_members(sequences), "trie-distinct")
    spark = distinct.sparkSession
    parts = max(-(-distinct.count() // part_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = distinct.repartitionByRange(parts, F.substring("turns", 1, DIGEST * RANGE_TURNS)).sortWithinPartitions("turns")
    forest = stored(dealt.mapInArrow(partition_forest, PLACED), "trie-forest")
    merged = stored(forest.where("turns IS NOT NULL").repartition(1).mapInArrow(merge_boundaries, PLACED), "trie-merged")
    names = merged.where("turns IS NOT NULL").select("part", "slot", F.col("conv_id").alias("__named"))
    nodes = forest.where("turns IS NULL").join(broadcast_if_small(stored(names, "trie-names"), BROADCAST_ROWS), ["part", "slot"], "left")
    columns = [c.split()[0] for c in NODES.split(", ")]
    inner = nodes.withColumn("parent_conv_id", F.coalesce("__named", "parent_conv_id")).select(*columns)
    return inner.union(merged.where("turns IS NULL").select(*columns))


def op13(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations.

    Turns go by number, null first, equal ones by role and text; a null role or text is empty;
    rows that repeat are turns that repeat; rows without conv_id belong to no conversation.
    Texts may be of any length, of which only digest and length travel; a conversation's
    digests must fit into one row.  Other columns are not read.
    """
    return prefix_trie(rebuilt(conversations))


OP13_SQL = """WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
    lambda crc, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h FROM t),
r AS (SELECT c.conv_id, 0 AS own, nth, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND nth <= h
  UNION ALL SELECT c.conv_id, 1, nth, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND nth > h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, nth) AS depth, sha256(length(role) || ':' || role || ':' || text) AS k, length(text) AS size FROM r),
p AS (SELECT conv_id, depth, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, size FROM d UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved FROM p GROUP BY path, depth),
k AS (SELECT q.path AS parent, count(*) AS n_children FROM n JOIN p q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1 GROUP BY 1),
u AS (SELECT q.path, sum(saved) AS saved_tokens, count(*) FILTER (k.parent IS NULL) AS n_leaves
  FROM n LEFT JOIN k ON k.parent = n.path JOIN p q ON q.conv_id = n.conv_id AND q.depth <= n.depth GROUP BY 1),
e AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY 1) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, u.n_leaves, u.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN u USING (path) LEFT JOIN k ON k.parent = n.path LEFT JOIN e ON e.path = n.path
LEFT JOIN p q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1 LEFT JOIN n o ON o.path = q.path"""
