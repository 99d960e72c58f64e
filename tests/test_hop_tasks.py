"""A hop's tasks hold a bounded number of steps, and edges are not copied for every salt."""

import re

import numpy as np
import pytest
import test_graphs_and_rules

from quillstream.operators import graphs


@pytest.fixture
def written(spark, monkeypatch):
    """The plan that wrote each stored table."""
    found, stored = {}, graphs.stored

    def counting(df, name):
        out = stored(df, name)
        found[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return out

    monkeypatch.setattr(graphs, "stored", counting)
    return found


def test_tasks_follow_the_steps(spark, written):
    r = np.random.default_rng(3)
    edges = {(int(a), int(b)) for a, b in r.integers(0, 300, (6000, 2)) if a != b}
    e = spark.createDataFrame([(a, b, 1 + (a * b) % 7) for a, b in edges], "src long, dst long, weight long")
    s = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "seed long")
    want = {tuple(x) for x in graphs.k_hop(e, s, 2, 10).collect()}
    got = [tuple(x) for x in graphs.k_hop(e, s, 2, 10, task_pairs=500).collect()]
    assert len(got) == len(want) and set(got) == want
    # 100 seeds with ten nodes each ask for ten edges of each.
    assert re.search(r"RepartitionByExpression \[seed#\d+L?\], 20\b", written["hop-2"])


def test_orders_are_dealt_before_they_are_copied(spark, tmp_path):
    lines = [(i // 4, i % 50) for i in range(400)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    plan = graphs.bought_together(spark, str(tmp_path), task_pairs=100)._jdf.queryExecution().optimizedPlan().toString()
    # 100 orders have 1200 pairs.
    assert re.search(r"RepartitionByExpression \[l_orderkey#\d+L?\], 12\b", plan) and re.search(r"\[src#\d+L?\], 12\b", plan)


@pytest.mark.parametrize("task_pairs", [1, 7, 400])
def test_hubs_are_dealt(spark, monkeypatch, task_pairs):
    k_hop = graphs.k_hop
    monkeypatch.setattr(graphs, "k_hop", lambda *args: k_hop(*args, task_pairs=task_pairs))
    test_graphs_and_rules.test_k_hop(spark, 1, 3, 5, 4)
