"""Toxicity by class-conditional Kneser-Ney models.

Words are spelled out as characters, so that an expression seen rarely, or never in this
form, still counts by its beginning.  For each class, toxic and ordinary, a character is
predicted from the word so far, by absolute discounting; both classes back off to the
same estimate, built from shared continuation counts (after how many different beginnings
was this seen?).  A text's evidence is what the two log-likelihoods of its words differ by,
normalised by its length (see ``Evidence``); a logistic curve, fitted on labelled rows that
the counts never saw, turns it into a score.

Counts are gathered from every labelled training document and grow with them; each word
counts once a document, so that repetition inside one text proves nothing.  No beginning is
too rare to be counted: counts, continuation counts and the model are stored tables, and the
distinct words of the texts to score are joined with them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import broadcast_if_small, crc_text, stored

#: A character is predicted from what precedes it in a word, up to so many characters in all.
DEPTH = 16
#: The windows of a longer word begin at each letter that so many follow, itself included.
LEAST_WINDOW = 4
END = "$"
#: A word counts by what its ratio (a natural logarithm) exceeds this.
MARGIN = 2.0
#: Texts are normalised by their number of words to this power: between the mean, which lets
#: chance decide short texts, and the square root, by which chance alone grows.
LENGTH_POWER = 0.75
#: Of the bitmap of words that are joined: 8 MB.
BITMAP_BITS = 1 << 26
#: Steps of the model are whole multiples of one part in so many.
GRID = float(1 << 24)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters; one of more than DEPTH, such as a sentence without blanks, is read whole
    through a window of DEPTH letters that slides over it, so that an expression inside it
    begins a window as it would begin a word."""
    words = _WORD.findall(text.lower()) if isinstance(text, str) else []
    if not words or max(map(len, words)) <= DEPTH:
        return words
    out: list[str] = []
    for w in words:
        if len(w) <= DEPTH:
            out.append(w)
        else:
            out += [w[i : i + DEPTH] for i in range(len(w) - LEAST_WINDOW + 1)]
    return out


def count_words(docs: DataFrame, text_col: str, toxic_col: str) -> DataFrame:
    """(word, texts, ordinary, toxic): in how many texts each word occurs, in all and of
    either class; a text whose ``toxic_col`` is null is of neither."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())
            for t, toxic in zip(b["text"], b["toxic"], strict=True):
                sums[int(toxic)].update(set(words_of(t)))  # -1: the last one
            words = list(sums[0].keys() | sums[1].keys() | sums[2].keys())
            n = [[x[w] for w in words] for x in sums]
            yield pd.DataFrame({"word": words, "texts": list(map(sum, zip(*n, strict=True))), "a": n[0], "b": n[1]}, columns=["word", "texts", "a", "b"])

    given = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(toxic_col).cast("int"), F.lit(-1)).alias("toxic"))
    parts = given.mapInPandas(count, "word string, texts long, a long, b long")
    return parts.groupBy("word").agg(F.sum("texts").alias("texts"), F.sum("a").alias("ordinary"), F.sum("b").alias("toxic"))


def spelled(word: Column) -> Column:
    """DEPTH characters at most, END among them."""
    return F.substring(F.concat(F.substring(word, 1, DEPTH), F.when(F.length(word) < DEPTH, F.lit(END)).otherwise(F.lit(""))), 1, DEPTH)


def beginnings(full: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(full)), lambda i: F.substr(full, F.lit(1), i))


def count_starts(words: DataFrame) -> DataFrame:
    """(start, a, b): counts of the beginnings of words by class, DEPTH characters at most."""
    seen = words.where(F.col("ordinary") + F.col("toxic") > 0)
    starts = seen.select("ordinary", "toxic", F.explode(beginnings(spelled(F.col("word")))).alias("start"))
    return starts.groupBy("start").agg(F.sum("ordinary").alias("a"), F.sum("toxic").alias("b"))


def shared_estimate(starts: DataFrame, discount: float) -> DataFrame:
    """(g, back): of the last of three characters after the two before, from both classes,
    by how many different beginnings they end."""
    last = lambda g, n: F.substring(g, -n, n)
    before = lambda g: F.expr(f"substring({g}, 1, length({g}) - 1)")
    grams = starts.groupBy(last(F.concat(F.lit("^^"), F.col("start")), 3).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    levels = [grams]
    for k in (2, 1):
        levels.insert(0, levels[0].groupBy(last(F.col("g"), k).alias("g")).agg(F.sum("n").alias("n")))
    back = None
    for k, level in enumerate(levels, 1):
        level = level.withColumn("h", before("g")).withColumn("shorter", last(F.col("g"), k - 1) if k > 1 else F.lit(""))
        sums = level.groupBy("h").agg(F.sum("n").alias("after"), F.count(F.lit(1)).alias("different"))
        level = level.join(sums, "h")
        if back is None:
            level = level.withColumn("back", 1 / (F.col("different") + 1))
        else:
            level = level.join(back.withColumnRenamed("g", "shorter"), "shorter")
        p = (F.greatest(F.col("n") - discount, F.lit(0.0)) + discount * F.col("different") * F.col("back")) / F.col("after")
        back = level.select("g", p.alias("back"))
    return back


def word_ratios(words: DataFrame, starts: DataFrame, broadcast_rows: int, discount: float = 0.75) -> DataFrame:
    """(word, texts, x): the log-likelihood ratio of toxic to ordinary of each word, known
    or not.  A word gets the steps of its known beginnings, and what leaving them adds where
    it goes on as no known one does (the shared estimate cancels out; only the weights of
    backing off differ).

    Beginnings, what follows them and the words are dealt out by their first two characters
    and sorted, so that one pass, which remembers the beginnings around a row, meets each
    before all that go on from it.  What is shorter, single letters, is sent to every task.
    """
    spark, number = words.sparkSession, lambda *c: [F.col(x).cast("double") if isinstance(x, str) else x for x in c]
    kinds = lambda c: F.count_if(F.col(c) > 0)
    h = F.expr("substring(start, 1, length(start) - 1)")
    parents = starts.groupBy(h.alias("h")).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), kinds("a").alias("ka"), kinds("b").alias("kb"))
    parents = stored(parents, "toxic-parents")
    shared = broadcast_if_small(stored(shared_estimate(starts, discount), "toxic-shared"), broadcast_rows)
    none, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    own = starts.withColumn("g", F.expr("substring(concat('^^', start), -3, 3)")).join(shared, "g")
    own = own.select(F.lit(0), "start", no_text, *number("a", "b", "back"), none)
    below = parents.select(F.lit(1), "h", no_text, *number("ta", "tb", "ka", "kb"))
    asked = words.select(F.lit(2), spelled(F.col("word")), F.when(F.length("word") >= DEPTH, F.col("word")), *number("texts"), none, none, none)
    names = ["kind", "s", "long", "u", "v", "m", "n"]
    model = own.union(below).toDF(*names)

    def step(row, total) -> float:
        """What the last character adds, given what follows the beginning before it."""
        p = [(max(c - discount, 0) + discount * k * row.m) / t if t else row.m for c, t, k in ((row.u, *total[::2]), (row.v, *total[1::2]))]
        return round((log(p[1]) - log(p[0])) * GRID) / GRID

    def leaving(total) -> float:
        w = [discount * k / t if t else 1.0 for t, k in (total[::2], total[1::2])]
        return round((log(w[1]) - log(w[0])) * GRID) / GRID

    # By beginning: the ratio so far, what leaving adds, what follows.
    short = model.where(F.length("s") < 2).toPandas()
    totals = {r.s: (r.u, r.v, r.m, r.n) for r in short.itertuples() if r.kind == 1}
    root = (0.0, leaving(totals[""]) if totals else 0.0, totals.get(""))
    first = {r.s: (step(r, root[2]), leaving(totals[r.s]), totals[r.s]) for r in short.itertuples() if r.kind == 0}
    sent = spark.sparkContext.broadcast((root, first))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, first = sent.value
        around: list[tuple] = []
        for b in batches:
            found = []
            for r in b.itertuples(index=False):
                s = r.s
                while around and not (around[-1][0] and s.startswith(around[-1][0])):
                    around.pop()
                if not around:
                    around.append((s[0], *first[s[0]]) if s[0] in first else ("", *root))
                at, x, end, total = around[-1]
                if r.kind == 0:
                    around.append((s, x + step(r, total), 0.0, None))
                elif r.kind == 1:
                    total = (r.u, r.v, r.m, r.n)
                    around[-1] = (at, x, leaving(total), total)
                else:
                    found.append((r.long or s[:-1], int(r.u), x if at == s else x + end))
            yield pd.DataFrame(found, columns=["word", "texts", "x"])

    rows = model.where(F.length("s") >= 2).union(asked.toDF(*names))
    rows = rows.repartition(F.substring("s", 1, 2)).sortWithinPartitions("s", "kind")
    return rows.mapInPandas(scan, "word string, texts long, x double")


class Evidence:
    """What a text's words say beyond chance: the sum of their log-likelihood ratios above
    ``MARGIN``, divided by a power of their number, 0 without words.

    A smaller ratio, and any word likelier in ordinary texts, says nothing: toxic texts are
    few, and a long text has many words that few of them happen to hold.  So only words above
    the margin are looked up.  Those in most texts are sent to every task, ``words_sent`` at
    most; a bitmap of fixed size tells which others can be meant, and those are joined.
    Which way a word goes changes the cost alone.
    """

    def __init__(self, ratios: DataFrame, words_sent: int, broadcast_rows: int):
        above = ratios.where(F.col("x") > MARGIN).select("word", "texts", (F.col("x") - MARGIN).alias("x"))
        above = stored(above, "toxic-above")
        order = F.floor(F.log2("texts")).cast("int")
        sizes = {r["e"]: r["count"] for r in above.groupBy(order.alias("e")).count().collect()}
        e = max(sizes, default=0) + 1
        sent = 0
        while e > 0 and sent + sizes.get(e - 1, 0) <= words_sent:
            e -= 1
            sent += sizes.get(e, 0)
        often = above.where(order >= e).select("word", "x").toPandas()
        table = dict(zip(often["word"], often["x"].tolist(), strict=True))
        spark = ratios.sparkSession
        self.known = spark.sparkContext.broadcast(table)
        self.rare = above.where(order < e).select("word", "x") if e else None
        self.broadcast_rows = broadcast_rows
        if e:
            place = F.crc32(F.col("word").cast("binary")).bitwiseAND(F.lit(BITMAP_BITS - 1)) + 1  # the functions count from 1
            bits = self.rare.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
            maps = bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()  # BITMAP_BITS in all
            bitmap = np.zeros(BITMAP_BITS // 8, np.uint8)
            for r in maps:
                low = (r["bucket"] - 1) * 4096
                bitmap[low : low + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
            self.bitmap = spark.sparkContext.broadcast(bitmap.tobytes())

    def add(self, docs: DataFrame, text_col: str, name: str) -> DataFrame:
        known, bitmap = self.known, None if self.rare is None else self.bitmap

        def may_be_rare(word: str) -> bool:
            place = crc32(word.encode("utf-8", "replace")) & (BITMAP_BITS - 1)
            return bool(bitmap.value[place >> 3] >> (place & 7) & 1) and word not in known.value

        @F.pandas_udf("x double, n long, rare boolean")
        def sums(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for t in texts:
                rows = []
                for words in map(words_of, t):
                    got = [x for x in map(known.value.get, words) if x is not None]
                    rows.append((sum(got), len(words), bitmap is not None and any(map(may_be_rare, words))))
                yield pd.DataFrame(rows, columns=["x", "n", "rare"]).astype({"x": float})

        @F.pandas_udf("array<struct<word:string,n:long>>")
        def others(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [{"word": w, "n": n} for w, n in Counter(words_of(t)).items() if may_be_rare(w)])

        rows = docs.withColumn("__sums", sums(F.col(text_col)))
        n = F.pow(F.greatest(F.col("__sums.n"), F.lit(1)).cast("double"), F.lit(LENGTH_POWER))
        if self.rare is None:
            return rows.withColumn(name, F.col("__sums.x") / n).drop("__sums")
        key = F.unhex(F.md5(F.col(text_col).cast("binary")))
        texts = docs.select(key.alias("__key"), F.col(text_col).alias("t"))
        more = texts.select("__key", F.explode(others("t")).alias("w")).groupBy("__key", "w.word").agg(F.max("w.n").alias("n"))
        more = more.join(self.rare, "word").groupBy("__key").agg(F.sum(F.col("n") * F.col("x")).alias("__x"))
        more = broadcast_if_small(stored(more, "toxic-rare"), self.broadcast_rows)
        own = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")).cast("binary")  # matches nothing, and is no hot key
        joined = rows.withColumn("__key", F.when(F.col("__sums.rare"), key).otherwise(own)).join(more, "__key", "left")
        return joined.withColumn(name, (F.col("__sums.x") + F.coalesce("__x", F.lit(0.0))) / n).drop("__sums", "__key", "__x")


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve of y over x, by Newton's method with a
    little shrinkage, so that it ends where classes separate."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    scale = float(np.std(x)) or 1.0
    z = np.c_[x / scale, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + 1e-2 * w
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), grad)
    return float(w[0] / scale), float(w[1])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    counted: Column,
    calibrated: Column,
    id_col: str,
    text_col: str,
    label_col: str,
    max_calibration: int,
    words_sent: int,
    broadcast_rows: int,
) -> tuple[Evidence, float, float]:
    """Counts come from all rows of ``labels`` where ``counted``; the curve from at most
    ``max_calibration`` rows where ``calibrated``, those with the smallest hash of their
    id.  Every beginning that was counted is in the model, however rare: counts, model and
    the words' ratios are tables that are joined, so nothing has to fit one machine."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    one = one.groupBy(id_col).agg(F.max(label_col).alias("__label"))
    train = stored(one.where(counted), "toxic-labels")
    text = docs.select(id_col, text_col)
    words = stored(count_words(text.join(broadcast_if_small(train, broadcast_rows), id_col, "left"), text_col, "__label"), "toxic-words")
    starts = stored(count_starts(words), "toxic-starts")
    few = broadcast_rows // 8
    evidence = Evidence(stored(word_ratios(words, starts, few), "toxic-ratios"), words_sent, few)
    sample = stored(one.where(calibrated).orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(max_calibration), "toxic-sample")
    got = evidence.add(text.join(F.broadcast(sample), id_col), text_col, "x").select("__label", "x").toPandas()
    slope, shift = calibrate(got["x"].to_numpy(float), got["__label"].to_numpy(float))
    return evidence, slope, shift


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    counted: Column,
    calibrated: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_calibration: int = 4000,
    words_sent: int = 200_000,
    broadcast_rows: int = 4_000_000,
) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) to every row.

    ``counted`` and ``calibrated`` say, over ids of ``labels``, which labelled rows are
    learned from; they should exclude each other.  The score sees the text alone, the whole
    of it however long.  A null text, or one without words, has no evidence either way and
    gets the curve's value at 0.  Of an id labelled twice the larger label counts.  Rows that
    repeat score alike; an empty table gives no rows.  Further columns are kept, but for
    names with two leading underscores.
    """
    evidence, slope, shift = fit_toxicity(docs, labels, counted, calibrated, id_col, text_col, label_col, max_calibration, words_sent, broadcast_rows)
    x = F.least(F.greatest(slope * F.col("__evidence") + shift, F.lit(-30.0)), F.lit(30.0))
    return evidence.add(docs, text_col, "__evidence").withColumn("score", 1 / (1 + F.exp(-x))).drop("__evidence")


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    fold = crc_text(F.col("doc_id")) % 5
    scored = score_toxicity(docs.select("doc_id", "text"), labels, fold.isin(1, 2, 3), fold == 4)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
