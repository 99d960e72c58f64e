"""From raw documents to token ids: five stages, each a training-data operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next stage's ``docs``.  An empty table passes through; further
columns are kept, but for the last stage, unless their names begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.bpe import bpe_decode, bpe_encode, vocabulary
from quillstream.llm.common import broadcast_if_small, crc_text, read, stored
from quillstream.llm.exact_dedup import exact_dedup
from quillstream.llm.jaccard_join import jaccard_groups
from quillstream.llm.mixing import mix_to_targets
from quillstream.llm.quality import score_quality

#: Of ids or hashes with a number, some 60 bytes each.
BROADCAST_ROWS = 1_000_000
#: Of text that is encoded at once: half of the operator's own, as rows carry more here.
SLICE_BYTES = 16 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more stay; a null text is scored as an empty one."""
    labels = read(spark, sf_dir, "labels")
    scored = score_quality(docs, labels, crc_text(F.col("doc_id")) % 4 != 2, score_col="__score")
    return scored.where(F.col("__score") >= 0.7).drop("__score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays; of rows that repeat its id as well, the
    smallest by all columns."""
    kept = exact_dedup(docs, keep="max").where("kept")
    again = stored(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")), "pipeline-again")
    if not again.limit(1).count():
        return kept.select(*docs.columns)
    repeated = broadcast_if_small(again, BROADCAST_ROWS)
    same = F.col("doc_id").eqNullSafe(F.col("__again"))
    one = kept.join(repeated, same, "left_semi").groupBy("doc_id", "text_sha256").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return kept.join(repeated, same, "left_anti").select(*docs.columns).union(one.select("row.*").select(*docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; a null id is
    in no group.  Documents that share an id go together."""
    groups = jaccard_groups(docs.select("doc_id", "text"))
    dropped = stored(groups.where("doc_id != component_id").select("doc_id").distinct(), "pipeline-near")
    return docs.join(broadcast_if_small(dropped, BROADCAST_ROWS), "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands in the result as often as its source's target asks for.  Documents
    that share id and text are copied alike, as often as the most of them."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("/"), F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.withColumn("__key", F.md5(named))
    taken = mix_to_targets(keyed.select("__key", "text", "source"), id_col="__key").where("copies > 0").select("__key", "copies")
    taken = stored(taken.groupBy("__key").agg(F.max("copies").alias("copies")), "pipeline-mix")
    repeated = keyed.join(broadcast_if_small(taken, BROADCAST_ROWS), "__key")
    return repeated.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; ``round_trip`` says that the ids give the text back."""
    ranks, pattern = vocabulary()
    # Of the text a hash goes along, which is what the decoded bytes are compared with.
    given = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256"))
    encoded = bpe_encode(given, ranks, pattern, keep=["doc_id", "lang", "source", "text_sha256"], slice_bytes=SLICE_BYTES)
    both = bpe_decode(encoded, ranks)
    same = F.sha2("decoded", 256) == F.col("text_sha256")
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", encoding),
]

#: A learned classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
