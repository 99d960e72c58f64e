"""What the operators of this subpackage share: scratch tables, text units, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, return.
WORD_RE = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only where none is set."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts the lineage, survives the loss of executors and lets a costly result be
    read twice; with ``by`` there is a folder for each value of that column, of which there
    must be few.  The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    _delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def stored_in_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """The same, in as many buckets of ``key`` as shuffles have partitions, so that a later
    grouping by it moves none of the rows.  The table's name lasts only until it is read."""
    spark = df.sparkSession
    unique = f"{name}-{uuid.uuid4().hex}"
    path, table = f"{shared_dir(spark)}/{unique}", unique.replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(table)
    _delete_on_exit(spark, path)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # an external table: its files stay
    return out


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if ``df`` (a stored table) has at most ``max_rows`` rows."""
    return F.broadcast(df) if df.count() <= max_rows else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` does exactly that for text of ASCII alone, several times faster than
    ``translate``; only other texts take the slow way.
    """
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hex_unit(key: Column) -> Column:
    """A number from 0 (inclusive) to 1 (exclusive) drawn from the MD5 of a string."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def crc_text(col: Column) -> Column:
    return F.crc32(col.cast("string").cast("binary"))
