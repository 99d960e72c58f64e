"""Walks over graphs, rules that trap their errors, schemas that are data."""

import os
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.operators import graphs, records, result_rules
from quillstream.plans.rules import Rule, RuleSet, only_context


@pytest.mark.parametrize("seed, hops, per_hop, salts", [(1, 3, 50, 16), (2, 4, 3, 2), (3, 2, 1, 1)])
def test_k_hop(spark, seed, hops, per_hop, salts):
    r = np.random.default_rng(seed)
    edges = {(int(a), int(b)): int(w) for a, b, w in r.integers(1, 40, (200, 3)) if a != b} | {(i, 1): 2 for i in range(2, 40)}
    ways = defaultdict(list)
    for (a, b), w in edges.items():
        ways[a].append((-w, b))
    want = set()
    for seed_ in range(1, 40, 5):
        met, frontier = {seed_}, {seed_: 1}
        for hop in range(1, hops + 1):
            best = {}
            for node, so_far in frontier.items():
                for w, b in sorted(ways[node])[:per_hop]:
                    if b not in met:
                        best[b] = max(best.get(b, 0), so_far * -w)
            frontier = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:per_hop])
            met |= set(frontier)
            want |= {(seed_, n, hop, w) for n, w in frontier.items()}
    e = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight long")
    s = spark.createDataFrame([(i,) for i in range(1, 40, 5)] * 2, "seed long")
    got = [tuple(x) for x in graphs.k_hop(e, s, hops, per_hop, salts).select("seed", "node", "hop", "weight").collect()]
    assert len(got) == len(want) and set(got) == want


def test_longest_paths(spark):
    plans = [
        ([], []), ([[]], [0]), ([[], [0], [0, 1], [0]], [0, 1, 2, 1]), ([[1], [0], []], [-1, -1, 0]), ([[0], [0]], [-1, -1]),
        ([[9], [-1], [1, 7]], [0, 0, 1]), ([[1], [2], [3], []], [3, 2, 1, 0]), ([[], [2], [1], [0, 1]], [0, -1, -1, -1]),
    ]
    df = spark.createDataFrame(plans, "deps array<array<int>>, want array<int>").where("size(deps) > 0")
    assert all(r["got"] == r["want"] for r in df.select("want", graphs.longest_paths(F.col("deps")).alias("got")).collect())


def test_a_rule_that_fails_on_one_row_is_that_row_s_violation(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, "-1"), (4, None)], "id int, n string")
    n = F.try_to_number(F.col("n"), F.lit("S999"))
    rules = RuleSet().add_rule(Rule("positive", n > 0, F.concat(F.lit("n is "), F.col("n")))).add_rule(Rule("known", F.col("n").isNotNull(), F.lit("no n")))
    got = [tuple(r) for r in rules.check(df.withColumn("tool", F.lit("t")), ["id"]).orderBy("id", "position").collect()]
    assert got == [(2, 0, "positive", "Rule positive failed: not evaluated"), (3, 0, "positive", "n is -1"), (4, 0, "positive", "Rule positive failed: not evaluated"), (4, 1, "known", "no n")]


def test_phases_tools_and_names(spark):
    no = F.lit(False)
    rules = RuleSet().add_rule(Rule("a", no, F.lit("A"), "precondition", tools=("t",))).add_rule(Rule("b", no, F.lit(None).cast("string"), "postcondition"))
    df = spark.createDataFrame([("t",), ("u",)], "tool string")
    assert [tuple(r) for r in rules.check(df, ["tool"], "precondition").collect()] == [("t", 0, "a", "A")]
    assert [r["message"] for r in rules.check(df, ["tool"], "postcondition").collect()] == ["b", "b"]
    assert rules.check(df, ["tool"], "result").count() == 0
    with pytest.raises(ValueError):
        rules.add_rule(Rule("a", no, F.lit("")))
    with pytest.raises(ValueError):
        Rule("c", no, F.lit(""), "sometimes")


def test_a_rule_sees_only_its_context(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},)], "c map<string,string>")
    assert df.select(only_context(F.col("c"), ["b", "z"])).first()[0] == {"b": "2"}


def test_result_rules_on_worked_cases(spark):
    rows = [
        (1, "inventory_check", "success", '{"quantity_available": -2}'), (2, "inventory_check", "success", '{"COF-001": 35, "COF-005": 0}'),
        (3, "x", "error", '{"price": null, "our_price": 0, "suggested_price": -1}'), (4, "x", "success", '{"price": 5, "our_price": "free", "suggested_price": 0}'),
        (5, "rag_search", "success", '{"sources": [], "answer": "yes"}'), (6, "rag_search", "success", '{"answer": "没有找到"}'), (7, "rag_search", "error", '{"answer": "yes"}'),
        (8, "rag_chat", "success", '{"sources": ["a"], "answer": "yes"}'), (9, "x", "success", "not json"), (10, "x", "success", None),
    ]
    df = spark.createDataFrame(rows, "id int, tool string, status string, data string")
    got = {(r["id"], r["message"]) for r in result_rules.default_result_rules().check(df, ["id"]).collect()}
    assert got == {(1, "库存数量为负数: -2"), (3, "价格无效: our_price=0"), (4, "Rule price_positive failed: not evaluated"), (5, "RAG 搜索返回成功但没有检索到任何来源文档")}


def test_schema_errors_keep_the_input_s_order(spark):
    params = spark.createDataFrame([(0, "t", "b", "integer", True), (1, "t", "a", "string", True), (2, "t", "c", "array", False)], "position int, tool string, field string, type string, required boolean")
    calls = [(1, "t", '{"c": 1, "b": "x", "z": 0, "a": 2}'), (2, "t", '{"a": null}'), (3, "u", "{}"), (4, "t", "no json"), (5, "t", '{"b": true, "a": "s", "c": []}'), (6, "t", None)]
    got = {r["id"]: r["errors"] for r in result_rules.schema_errors(spark.createDataFrame(calls, "id int, tool string, input string"), params, ["id"]).collect()}
    both = "Missing required field: b; Missing required field: a"
    assert got[1] == "Field 'c' expected array, got int; Field 'b' expected integer, got str; Field 'a' expected string, got int"
    assert got[2] == both + "; Field 'a' expected string, got NoneType"
    assert not got[3] and got[4] == got[6] == both and got[5] == ""


def test_preferences_of_any_keys(spark):
    df = spark.sql("""SELECT from_json('{"skill": "novice", "budget_max": 300, "likes": "red tea"}', 'map<string,variant>') AS p, array('red', 'budget') AS w""")
    assert df.select(records.as_dict(records.matching_preferences(F.col("p"), F.col("w")))).first()[0] == "{'budget_max': 300, 'likes': 'red tea'}"


def test_blank_input_comes_back_untouched(spark, tmp_path):
    from quillstream.plans.catalog import QUERIES

    rows = [(1, 0, "user", "  "), (1, 1, "user", " hi "), (1, 2, "user", ""), (1, 3, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["turn"]: r["cleaned"] for r in QUERIES["sanitize_inputs"](spark, str(tmp_path)).where("conv_id = 1").collect()}
    assert got == {0: "  ", 1: "hi", 2: "", 3: ""}


@pytest.mark.parametrize("left_over", [True, False])
def test_entry_works_without_the_optional_part(tmp_path, left_over):
    """A copy of the library without the folder, or with an empty one."""
    import shutil

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "quillstream", tmp_path / "quillstream", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if left_over:
        os.makedirs(tmp_path / "quillstream" / "llm" / "__pycache__")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'attr_kpis' in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
