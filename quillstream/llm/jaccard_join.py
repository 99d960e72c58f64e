"""N-gram Jaccard join by a token-group matrix.

A document is the set of its word shingles, held as 64-bit hashes.  The tokens of all sets
have one order, rare ones first.  The number of sets that hold a token is counted exactly
for the tokens of one zone of hashes, which is a little wider than a prefix; tokens outside
it follow by hash, and shingles that a sample shows to be frequent come last.  Two sets
that reach the threshold then share one of their first ``n - ceil(t * n) + 1`` tokens, so
only those are ever indexed.  Tokens that one set alone holds come first of all and link
nothing: a set with enough of them is not indexed, and of others they are only counted.

1. Documents with the same set are one representative.
2. Similar documents are brought into groups: each representative is compared with those
   that come first under most of its shared tokens, having the fewest rarer tokens before
   them (a number of pairs linear in the documents), and the links found give components,
   cut into groups of bounded size.  Of near copies of one text the one that was changed
   least comes first, which links with most of the others.
3. The matrix holds, for each token, the groups that contain it.  A representative and a
   group of another component are a candidate if they share an indexed token and their
   sizes, and the token's places in the order, allow a link.
4. For each candidate the query's tokens that the union of the group's tokens lacks bound
   the Jaccard similarity from above; only groups whose bound qualifies are opened.  What
   is left is compared set by set, exactly.

Bounds use the indexed tokens alone: up to the place in the order where the shorter of two
lists ends both sets are known, and each token that only one of them has lowers what they
can share.
No step lists all pairs inside a group: large groups of near copies become one component
in step 2, which is not compared with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import broadcast_if_small, stored
from quillstream.llm.components import connected_components

#: The hashes below this bound, 34 of 100, are the zone whose tokens are counted.
ZONE_END = np.int64(-(2**63) + 34 * 2**64 // 100)

#: A token's key: how many sets hold it in the upper bits, its hash in the lower 48.
HASH_BITS = 48
MOST_SETS, OUTSIDE, FREQUENT = 32_000, 32_100, 32_200

_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MUL[1]
    h = (h ^ (h >> np.uint64(27))) * _MUL[2]
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``words`` words, A-Z lower-cased;
    one of the whole sequence if it is shorter, none without words."""
    # Bytes are lower-cased and split at exactly the ASCII letters and white space.
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(words, len(w))
    acc = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        acc = _stir(acc * _MUL[0] + h[j : len(h) - k + 1 + j])
    return np.unique(acc.view(np.int64))


def prefix_length(n: int, percent: int) -> int:
    """Tokens of a set of n that a set at ``percent`` or more shares at least one of."""
    return n - -(-percent * n // 100) + 1 if n else 0


def is_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    both = int(_inside(small, large).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def may_link(x: np.ndarray, x_alone: int, nx: int, y: np.ndarray, y_alone: int, ny: int, percent: int) -> bool:
    """Whether two sets of nx and ny tokens can link, by their indexed keys (sorted) and by
    how many tokens before those each has alone."""
    if not len(x) or not len(y):
        return False
    end = min(x[-1], y[-1])
    a, b = x[x <= end], y[y <= end]
    both = int(_inside(a, b).sum()) if len(b) else 0
    lost = x_alone + y_alone + len(a) + len(b) - 2 * both
    return (100 + percent) * (nx + ny - lost) >= 2 * percent * (nx + ny)


def _inside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of the sorted ``a`` are in the sorted ``b``."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return b[at] == a


def _frequent(docs: DataFrame, words: int, sample_docs: int, least: int, most: int) -> np.ndarray:
    """Shingles that occur in ``least`` documents or more of a sample of about
    ``sample_docs``, the ``most`` commonest at most.  Any list gives the same links; a good
    one keeps common passages out of the index."""
    total = docs.count()
    if not total:
        return np.zeros(0, np.int64)
    part = docs.where(F.pmod(F.xxhash64("id"), F.lit(max(1, total // sample_docs))) == 0)

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, words) for t in b["text"]]
            token, n = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_counts=True)
            yield pd.DataFrame({"token": token, "n": n})

    seen = part.select("text").mapInPandas(tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = seen.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(most).collect()
    return np.sort(np.array([r["token"] for r in rows], np.int64))


def jaccard_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 75,
    group_size: int = 64,
    pivots: int = 4,
    sample_docs: int = 4000,
    broadcast_rows: int = 4_000_000,
) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    Two documents link when ``100 * intersection >= percent * union``; component_id is the
    smallest id reachable by links, a document's own included.  A null or empty text has
    no shingles and links with nothing.  Rows that repeat an id and a text give the same
    result each; ids should be unique otherwise.  A row with a null id takes no part: its
    n_shingles is counted and its component_id is null.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = given.where(F.col("id").isNotNull())
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(rows, words, sample_docs, 4, 100_000))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Size and digest of each set, its tokens in the zone, and the keys of those that
        fill its prefix if the zone has too few."""
        last = frequent.value
        for b in batches:
            sizes, digests, zones, rests = [], [], [], []
            for t in b["text"]:
                s = shingle_set(t, words)
                late = _inside(s, last) if len(last) else np.zeros(len(s), bool)
                inside = (s < ZONE_END) & ~late
                zone, missing = s[inside], prefix_length(len(s), percent) - int(inside.sum())
                rest = np.zeros(0, np.int64)
                if missing > 0:
                    first = np.where(late, FREQUENT, OUTSIDE)[~inside].astype(np.int64) << HASH_BITS
                    rest = np.sort(first | (s[~inside] & ((1 << HASH_BITS) - 1)))[:missing]
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                zones.append(zone)
                rests.append(rest)
            yield pd.DataFrame({"id": b["id"], "n": sizes, "digest": digests, "zone": zones, "rest": rests})

    kind = given.schema["id"].dataType.simpleString()
    summary = f"id {kind}, n long, digest binary, zone array<long>, rest array<long>"
    sets = stored(rows.mapInPandas(summarise, summary), "jaccard-sets")
    light = sets.select("id", "n", "digest")
    classes = light.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # Stored, so that it is sent out if small and a large group of copies can be split if not.
    classes = broadcast_if_small(stored(classes.where("copies > 1").select("digest", "rep"), "jaccard-classes"), broadcast_rows)
    copies = stored(light.join(classes, "digest").where("id != rep").select("id", "rep").distinct(), "jaccard-copies")
    single = sets.where("n > 0").join(broadcast_if_small(copies.select("id"), broadcast_rows), "id", "left_anti")
    repeated = stored(light.groupBy("id").count().where("count > 1").select("id"), "jaccard-repeated")
    if repeated.limit(1).count():  # of rows repeated whole one stays, since each set counts once
        again = broadcast_if_small(repeated, broadcast_rows)
        single = single.join(again, "id", "left_anti").union(single.join(again, "id", "left_semi").dropDuplicates(["id"]))

    # How many sets hold each token of the zone; tokens that one set alone holds go.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = single.select("id", F.explode("zone").alias("token")).withColumn(
        "held", F.count(F.lit(1)).over(Window.partitionBy("token"))
    )
    key = F.shiftleft(F.least("held", F.lit(MOST_SETS)), HASH_BITS).bitwiseOR(F.col("token").bitwiseAND(F.lit((1 << HASH_BITS) - 1)))
    keys = counted.where("held > 1").groupBy("id").agg(F.array_sort(F.collect_list(key)).alias("keys"))

    # Each set's indexed keys: what its prefix holds after the tokens it has alone.
    heads = single.select("id", "n", F.size("zone").alias("zone"), "rest").join(keys, "id", "left")
    heads = heads.withColumn("keys", F.coalesce("keys", F.array().cast("array<long>")))
    heads = heads.withColumn("alone", F.col("zone") - F.size("keys"))
    room = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("alone")
    heads = heads.withColumn("room", room.cast("int")).where("room > 0")
    heads = stored(heads.select("id", "n", "alone", F.slice(F.concat("keys", "rest"), F.lit(1), F.col("room")).alias("prefix")), "jaccard-heads")

    # Keys of the prefixes that different sets share, dealt out once and read twice.
    tokens = heads.select("id", "n", "alone", F.posexplode("prefix").alias("pos", "token"))
    tokens = tokens.select("id", "n", (F.col("alone") + F.col("pos")).alias("pos"), "token").repartition(parts, "token")
    # The first under a token is the set with the fewest rarer tokens: of near copies the most like all others.
    shared = tokens.groupBy("token").agg(F.min(F.struct("pos", "id", "n")).alias("first"), F.min("id").alias("low"), F.max("id").alias("high"))
    postings = stored(tokens.join(shared.where("low < high").drop("low", "high"), "token"), "jaccard-postings")

    def allowed(n, left, low, high, high_left):
        """Sizes n and low to high can link, with one token shared before at most
        ``left`` and ``high_left`` others: an upper bound of what is shared."""
        fits = (n * percent <= high * 100) & (low * percent <= n * 100)
        return fits & (F.least(left, high_left) * (100 + percent) >= (n + low) * percent)

    @F.pandas_udf("boolean")
    def possible(x: pd.Series, xa: pd.Series, nx: pd.Series, y: pd.Series, ya: pd.Series, ny: pd.Series) -> pd.Series:
        return pd.Series([may_link(*v, percent) for v in zip(x, xa, nx, y, ya, ny, strict=True)], dtype=bool)

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        read = lambda x: np.frombuffer(x, np.int64)
        return pd.Series([is_link(read(x), read(y), percent) for x, y in zip(a, b, strict=True)], dtype=bool)

    def full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "tokens": [shingle_set(t, words).tobytes() for t in b["text"]]}, columns=["id", "tokens"])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that link, by their whole sets, taken from the texts again."""
        pairs = stored(pairs, name + "-pairs")
        ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), name + "-ids")
        full = rows.join(broadcast_if_small(ids, broadcast_rows), "id", "left_semi")
        full = stored(full.mapInPandas(full_sets, f"id {kind}, tokens binary"), name + "-sets")
        both = pairs.join(full.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
        both = both.join(full.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
        return stored(both.where(linked("x", "y")).select("a", "b"), name + "-links")

    # Step 2: each set against those that are the first under most of its shared tokens.
    pivot = F.col("first")
    near = postings.where(
        (F.col("id") != pivot["id"])
        & allowed(F.col("n"), F.col("n") - F.col("pos"), pivot["n"], pivot["n"], pivot["n"] - pivot["pos"])
    )
    near = near.groupBy("id", pivot["id"].alias("pivot")).agg(F.count(F.lit(1)).alias("votes"))
    most = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("votes"), "pivot"))), 1, pivots)
    near = near.groupBy("id").agg(F.transform(most, lambda x: x["pivot"]).alias("near"))
    near = near.select(F.col("id").alias("a"), F.explode("near").alias("b"))
    sided = lambda c, t: heads.select(F.col("id").alias(c), *(F.col(x).alias(x + t) for x in ("n", "prefix", "alone")))
    near = near.join(sided("a", "_a"), "a").join(sided("b", "_b"), "b")
    near = near.where(possible("prefix_a", "alone_a", "n_a", "prefix_b", "alone_b", "n_b")).select("a", "b").distinct()
    links = verified(near, "jaccard-near")
    first = connected_components(links)

    # Step 3: the matrix of tokens and groups, and what can still link across components.
    members = postings.select("id").distinct().join(first, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    sized = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / group_size).alias("cuts"))
    members = members.join(sized, "component")
    members = stored(members.withColumn("cut", F.pmod(F.xxhash64("id"), "cuts")).drop("cuts"), "jaccard-members")
    indexed = postings.select("id", "n", "token", (F.col("n") - F.col("pos")).alias("left")).join(members, "id")
    matrix = indexed.groupBy("token", F.col("component").alias("g"), F.col("cut").alias("gc")).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("left").alias("high_left")
    )
    fits = allowed(F.col("n"), F.col("left"), F.col("low"), F.col("high"), F.col("high_left"))
    opened = indexed.join(matrix, "token").where((F.col("component") > F.col("g")) & fits).select("id", "g", "gc").distinct()
    opened = stored(opened, "jaccard-candidates")

    # Step 4: bound by the union of the group's tokens, open, compare.
    def open_group(queries: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(group) and len(queries):
            union, low = np.unique(np.concatenate(list(group["prefix"]))), int(group["n"].min())
            end, alone = min(p[-1] for p in group["prefix"]), int(group["alone"].min())
            for q in queries.itertuples():
                mine = q.prefix[q.prefix <= end]
                lacks = int(q.alone) + len(mine) - int(_inside(mine, union).sum())
                # What both can share at most: the query's tokens that the union may have, and a member's own.
                if (100 + percent) * min(q.n - lacks, int(group["n"].max()) - alone) < percent * (q.n + low):
                    continue
                able = [m for m in group.itertuples() if may_link(q.prefix, q.alone, q.n, m.prefix, m.alone, m.n, percent)]
                if q.one and able:
                    able = [max(able, key=lambda m: (int(_inside(m.prefix, q.prefix).sum()), -abs(m.n - q.n)))]
                found += [(q.id, m.id) for m in able]
        return pd.DataFrame(found, columns=["a", "b"])

    def candidates(opened: DataFrame, one: bool) -> DataFrame:
        """The pairs (a, b) that can link, of each query and the groups opened for it; with
        ``one`` only the likeliest of each group.  The salt keeps the queries of one task
        bounded; a group's lists are read once for each salt."""
        per_group = opened.groupBy("g", "gc").agg(F.ceil(F.count(F.lit(1)) / 512).alias("salts"))
        queries = opened.join(per_group, ["g", "gc"]).withColumn("salt", F.pmod(F.xxhash64("id"), "salts")).drop("salts")
        queries = queries.join(heads, "id").withColumn("one", F.lit(one))
        sides = members.select("id", F.col("component").alias("g"), F.col("cut").alias("gc")).join(per_group, ["g", "gc"])
        sides = sides.select("id", "g", "gc", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(heads, "id")
        sides = sides.select(*(F.col(c).alias(c) for c in sides.columns))  # apart from the other side's columns
        keys = ["g", "gc", "salt"]
        return queries.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInPandas(open_group, f"a {kind}, b {kind}").distinct()

    # Only links between different components matter.  Each query first tries the likeliest
    # member of each group, which joins most of a large group of near copies; then all members of
    # more and more of the groups that still lie in another component, until none is left.
    final, tried, turn = first, 0, F.xxhash64("id", "g", "gc")
    while True:
        side = lambda c: final.select(F.col("id").alias(c), F.col("component").alias("c" + c))
        apart = opened.join(side("id"), "id", "left").join(side("g"), "g", "left")
        apart = apart.where(F.coalesce("cid", "id") != F.coalesce("cg", "g")).select("id", "g", "gc")
        ranked = stored(apart.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(turn))), "jaccard-open")
        if not ranked.limit(1).count():
            break
        now = ranked.where(F.col("nth") <= tried) if tried else ranked
        found = verified(candidates(now.select("id", "g", "gc"), one=not tried), "jaccard-more")
        # What was opened for its likeliest member alone is opened again if it still lies apart.
        opened = ranked.where(F.col("nth") > tried).select("id", "g", "gc")
        if found.limit(1).count():
            links = stored(links.union(found), "jaccard-links")
            final = connected_components(links)
        tried = 64 * tried or 8

    # Back to the rows: copies follow their representative.
    light = light.join(copies, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    light = light.join(final.withColumnRenamed("id", "rep"), "rep", "left")
    out = light.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    nameless = given.where(F.col("id").isNull()).mapInPandas(summarise, summary)
    out = out.union(nameless.select("id", "n", F.col("id").alias("component_id")))
    return out.withColumnRenamed("id", id_col)


def op3(docs: DataFrame) -> DataFrame:
    return jaccard_groups(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
