"""Nearest vectors in blocks and parts."""

import numpy as np
import pytest

from quillstream.operators.commerce import retrieve_topk


@pytest.mark.parametrize("block_queries, part_rows", [(4096, 1 << 14), (2, 70)])
def test_copies_and_zero_vectors(spark, tmp_path, monkeypatch, block_queries, part_rows):
    r = np.random.default_rng(6)
    v = r.normal(size=(300, 8)).round(2)
    v[40:200] = v[50]
    v[250] = 0
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    v = v.astype(np.float32).astype(float)
    with np.errstate(invalid="ignore"):
        scores = np.round(v[::50] @ v.T / (np.linalg.norm(v[::50], axis=1)[:, None] * np.linalg.norm(v, axis=1)), 4)
    want = {}
    for q in range(0, 300, 50):
        order = sorted((-(9.0 if np.isnan(s) else s), i) for i, s in enumerate(scores[q // 50]) if i != q)[:20]
        want[q] = [i for _, i in order]
    found = retrieve_topk(spark, str(tmp_path), block_queries, part_rows).collect()
    got = {}
    for x in sorted(found, key=lambda x: (x["query_id"], -(9.0 if np.isnan(x["score"]) else x["score"]), x["vec_id"])):
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    assert got == want
