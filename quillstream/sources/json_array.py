"""A table kept as JSON arrays: a data source with an overwrite that readers never see half done.

A table is a folder.  Each overwrite writes a version, a folder of files that hold one array
each, and then replaces the small file CURRENT, which names the version.  A path that is one
file is read as one array.  A file that is missing, empty, broken or no array of objects has
no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillstream.plans.registry import query
from quillstream.sources.scratch import scratch_path
from quillstream.sources.tables import R_SQL, tool_records

CURRENT = "CURRENT"
BATCH_ROWS = 10_000


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def _read(fs: arrow_fs.FileSystem, path: str) -> str:
    with fs.open_input_stream(path) as f:
        return f.read().decode("utf-8", errors="replace")


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    name: str


class JsonArrayReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> Sequence[InputPartition]:
        """A task for each file of the current version."""
        fs, path = _open(self.path)
        if fs.get_file_info(path).type == arrow_fs.FileType.File:
            return [File(path)]
        if fs.get_file_info(f"{path}/{CURRENT}").type != arrow_fs.FileType.File:
            return []
        version = f"{path}/{_read(fs, f'{path}/{CURRENT}').strip()}"
        return [File(x.path) for x in sorted(fs.get_file_info(arrow_fs.FileSelector(version)), key=lambda x: x.path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, File):  # what Spark reads where there are no partitions
            return
        fs, _ = _open(self.path)
        schema = to_arrow_schema(self.schema)
        try:
            rows = json.loads(_read(fs, partition.path))
        except (ValueError, FileNotFoundError):
            rows = []
        rows = [r for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []
        for i in range(0, len(rows), BATCH_ROWS):
            some = rows[i : i + BATCH_ROWS]
            yield pa.RecordBatch.from_arrays([_column([r.get(f.name) for r in some], f.type) for f in schema], schema=schema)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """Values that don't fit the column's type become null."""
    try:
        return pa.array(values, kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError):
        return pa.array([_fitting(v, kind) for v in values], kind)


def _fitting(value, kind: pa.DataType):
    try:
        return pa.scalar(value, kind).as_py()
    except (pa.ArrowInvalid, pa.ArrowTypeError):
        return None


class JsonArrayWriter(DataSourceArrowWriter):
    """Tasks write their files into a new version; the commit swaps CURRENT.  Of two writers at
    once each has its own version, and the table is that of the last to commit."""

    def __init__(self, path: str):
        self.path, self.version = path, f"v-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = _open(self.path)
        name = f"part-{uuid.uuid4().hex}.json"  # a task that runs twice leaves a file that no commit names
        fs.create_dir(f"{path}/_tasks/{self.version}")
        with fs.open_output_stream(f"{path}/_tasks/{self.version}/{name}") as f:
            lead = b"["
            for batch in batches:
                for row in batch.to_pylist():
                    f.write(lead + json.dumps(row, ensure_ascii=False, default=str).encode())
                    lead = b",\n"
            f.write(b"]" if lead == b",\n" else b"[]")
        return Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = _open(self.path)
        fs.create_dir(f"{path}/{self.version}")
        for m in messages:
            if m is not None:
                fs.move(f"{path}/_tasks/{self.version}/{m.name}", f"{path}/{self.version}/{m.name}")
        beside = f"{path}/{CURRENT}-{self.version}"
        with fs.open_output_stream(beside) as f:
            f.write(self.version.encode())
        fs.move(beside, f"{path}/{CURRENT}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = _open(self.path)
        if fs.get_file_info(f"{path}/_tasks/{self.version}").type == arrow_fs.FileType.Directory:
            fs.delete_dir(f"{path}/_tasks/{self.version}")


class JsonArraySource(DataSource):
    """``spark.read.format("json_array").schema(...).load(path)``, and ``df.write`` with mode overwrite."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        raise ValueError("json_array needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return JsonArrayReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if not overwrite:
            raise ValueError("json_array tables are only overwritten as a whole")
        return JsonArrayWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonArraySource)


def write_json_array(df: DataFrame, path: str) -> None:
    register(df.sparkSession)
    df.write.format("json_array").mode("overwrite").save(path)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    register(spark)
    return spark.read.format("json_array").schema(schema).load(path)


@query("json_array_table", f"WITH {R_SQL} SELECT event_id, tool, status, elapsed_ms, '备注 ' || tool AS note FROM r WHERE status <> 'success'")
def json_array_table(spark, d):
    """Failed calls as a table of JSON arrays: written, written anew as a whole, and read."""
    r = tool_records(spark, d).select("event_id", "tool", "status", "elapsed_ms", F.concat(F.lit("备注 "), "tool").alias("note"))
    path = scratch_path(spark, "json-array")
    write_json_array(r.limit(10), path)
    write_json_array(r.where("status != 'success'"), path)
    return read_json_array(spark, path, r.schema)
