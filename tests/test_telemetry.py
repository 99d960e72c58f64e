"""Shares of traces that took no time."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from quillstream.operators import telemetry
from quillstream.plans import catalog


def test_quotients_by_zero(spark):
    nan, inf = float("nan"), float("inf")
    cases = [(0.0, 0.0), (5.0, 0.0), (-5.0, 0.0), (nan, 0.0), (6.0, 3.0), (None, 0.0), (1.0, None), (0.0, -0.0)]
    got = spark.createDataFrame(cases, "a double, b double").select(telemetry.quotient(F.col("a"), F.col("b")).alias("q")).collect()
    assert [str(r["q"]) for r in got] == [str(x) for x in (nan, inf, -inf, nan, 2.0, None, None, nan)]


def test_waterfall_of_traces_without_time(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 8, 0)
    values = [(1, 0.0), (1, 0.0), (2, 1.0), (2, 3.0), (3, 5.0), (3, -5.0), (4, None), (5, 0.0), (5, None)]
    rows = [(i, at + dt.timedelta(minutes=i), u, "view", v, '{"k": 3}') for i, (u, v) in enumerate(values)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(catalog.SQL["trace_waterfall"]).fetchall()
    got = catalog.QUERIES["trace_waterfall"](spark, str(tmp_path)).collect()
    assert sorted(map(str, got and [tuple(r) for r in got])) == sorted(map(str, want))
