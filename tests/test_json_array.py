"""Tables of JSON arrays: round trips, broken files, writers at once."""

import json

import pytest

from quillstream.sources.json_array import CURRENT, JsonArrayWriter, read_json_array, write_json_array

SCHEMA = "id long, name string, tags array<string>, score double"
ROWS = [(1, "é\n\"x\"", ["a", "b"], 1.5), (2, None, [], None), (3, "", None, -0.25)]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_round_trip_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    write_json_array(spark.createDataFrame(ROWS * 50, SCHEMA).repartition(4), path)
    assert rows(read_json_array(spark, path, SCHEMA)) == sorted(ROWS * 50)
    write_json_array(spark.createDataFrame(ROWS[:1], SCHEMA), path)
    assert rows(read_json_array(spark, path, SCHEMA)) == ROWS[:1]
    assert not list((tmp_path / "t" / "_tasks").iterdir())
    write_json_array(spark.createDataFrame([], SCHEMA), path)
    assert rows(read_json_array(spark, path, SCHEMA)) == []


@pytest.mark.parametrize("text", ["", "  ", "[{\"id\": 1}", "oops", "{\"id\": 1}", "null", "\xff\xfe"])
def test_malformed_is_empty(spark, tmp_path, text):
    (tmp_path / "one.json").write_text(text, encoding="latin-1")
    assert rows(read_json_array(spark, str(tmp_path / "one.json"), SCHEMA)) == []


def test_one_file_and_values_that_do_not_fit(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps([{"id": 1, "more": 2}, 7, {"id": "x", "score": 2.5}, {"name": "n"}]))
    assert read_json_array(spark, str(tmp_path / "one.json"), "id long, score double, name string").collect() == [(1, None, None), (None, 2.5, None), (None, None, "n")]


def test_no_table_has_no_rows(spark, tmp_path):
    assert rows(read_json_array(spark, str(tmp_path / "nothing"), SCHEMA)) == []


def test_a_failed_overwrite_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    write_json_array(spark.createDataFrame(ROWS, SCHEMA), path)
    bad = spark.range(3).selectExpr("id", "CAST(raise_error('stop') AS STRING) AS name", "array('a') AS tags", "1.0D AS score")
    with pytest.raises(Exception, match="stop"):
        write_json_array(bad, path)
    assert rows(read_json_array(spark, path, SCHEMA)) == sorted(ROWS, key=lambda r: r[0])


def test_two_writers_at_once(spark, tmp_path):
    """Both write before either commits; the table is that of the later commit, whole."""
    import pyarrow as pa

    a, b = JsonArrayWriter(str(tmp_path / "t")), JsonArrayWriter(str(tmp_path / "t"))
    batch = lambda x: iter([pa.RecordBatch.from_pydict({"id": [x, x + 1]})])
    of_a, of_b = a.write(batch(1)), b.write(batch(10))
    b.commit([of_b])
    assert rows(read_json_array(spark, str(tmp_path / "t"), "id long")) == [(10,), (11,)]
    a.commit([of_a])
    assert rows(read_json_array(spark, str(tmp_path / "t"), "id long")) == [(1,), (2,)]
    assert (tmp_path / "t" / CURRENT).read_text() == a.version


def test_append_is_an_error(spark, tmp_path):
    write_json_array(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "t"))
    with pytest.raises(Exception, match="overwritten"):
        spark.createDataFrame(ROWS, SCHEMA).write.format("json_array").mode("append").save(str(tmp_path / "t"))
