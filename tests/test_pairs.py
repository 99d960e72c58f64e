"""Products bought together are counted in as many tasks as there are pairs for."""

import itertools
from collections import Counter

import numpy as np

from quillstream.operators import graphs


def test_tasks_hold_a_bounded_number_of_pairs(spark, tmp_path):
    r = np.random.default_rng(8)
    lines = [(int(o), int(p)) for o, p in r.integers(0, [400, 90], (2000, 2))] + [(None, 1), (7, None), (None, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = {}
    for o, p in lines:
        if o is not None and p is not None:
            orders.setdefault(o, set()).add(p)
    want = Counter(pair for ps in orders.values() for pair in itertools.permutations(ps, 2))
    pairs = graphs.bought_together(spark, str(tmp_path), task_pairs=200)
    assert {(x["src"], x["dst"]): x["weight"] for x in pairs.collect()} == want
    assert pairs.rdd.getNumPartitions() == -(-sum(want.values()) // 200)
