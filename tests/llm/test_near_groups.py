"""A large group of near copies: what is opened for comparison grows with its documents, not with their pairs."""

import numpy as np
import pytest

from quillstream.llm import jaccard_join


def copies(n):
    """The base has the largest id; each other text differs from it in one to four words of its own."""
    r = np.random.default_rng(n)
    base = [f"b{i}" for i in range(150)]
    rows = [(n, " ".join(base))]
    for i in range(n):
        words = list(base)
        for j, at in enumerate(r.choice(150, 1 + i % 4, replace=False)):
            words[at] = f"x{i}y{j}"
        rows.append((i, " ".join(words)))
    return rows


def brute(rows):
    words = {i: t.split() for i, t in rows}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in words.items()}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("n", [100, 300])
def test_candidates_of_a_near_group_grow_with_its_documents(spark, monkeypatch, n):
    rows, opened, stored = copies(n), [], jaccard_join.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "jaccard-candidates":
            opened.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(df).collect()}
    assert got == brute(rows)
    assert len(opened) == 1 and opened[0] <= n, opened
