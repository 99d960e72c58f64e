"""Every query of the library that has SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from quillstream.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(df):
    cols = sorted(df.columns)
    text = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
    return cols, sorted(tuple(text(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_matches_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalog.SQL[name]).df())


def test_a_taken_name_is_an_error():
    from quillstream.plans.registry import query

    with pytest.raises(ValueError):
        query("attr_kpis")(lambda s, d: None)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2
    assert set(e.oracle_sql()) <= set(e.queries())


def test_canary_share(spark):
    from pyspark.sql import functions as F

    from quillstream.functions.experiments import canary_percentile

    users = spark.range(1000).select(F.concat(F.lit("user_"), F.col("id")).alias("u"))
    assert users.where(canary_percentile("planner_prompt_v2", F.col("u")) < 5).count() == 44


def test_sanitiser_cases(spark):
    out = catalog.QUERIES["sanitize_inputs"](spark, SF).where("conv_id = -1").orderBy("turn").collect()
    assert [(r["flags"], r["severity"]) for r in out[:5]] == [
        ("direct_override", "blocked"), ("role_hijack,mass_exfiltration", "blocked"), ("prompt_extraction", "blocked"),
        ("delimiter_injection,delimiter_injection,mass_exfiltration", "blocked"), ("", "clean"),
    ]
