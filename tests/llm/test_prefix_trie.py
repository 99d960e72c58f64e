"""The prefix trie against brute force, whatever the partitions."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillstream.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs string"


def brute(rows):
    con = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            con[c].append((t is not None, t or 0, r or "", x or ""))
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, v in con.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(x[2:] for x in sorted(con.get(c - c % 100, []))[:h]) + tuple(x[2:] for x in sorted(v)[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in members.items()
    )


def nodes(df, **more):
    out = prefix_trie.prefix_trie(prefix_trie.rebuilt(df), **more).collect()
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in out)


def made(seed, n):
    """Few distinct turns, so that beginnings meet; some ids without a base, some turns missing."""
    r = np.random.default_rng(seed)
    rows = []
    for c in r.permutation(n * 3)[:n].tolist():
        for t in range(int(r.integers(1, 9))):
            rows.append((c, t if r.random() < 0.95 else None, "user" if t % 2 else None, "abc"[: int(r.integers(0, 4))], "x"))
    return rows + rows[:3] + [(None, 1, "user", "lost", "x")]


@pytest.mark.parametrize("seed, part_rows", [(1, 200_000), (2, 7), (3, 1)])
def test_brute_force(spark, seed, part_rows):
    rows = made(seed, 300)
    assert nodes(spark.createDataFrame(rows, SCHEMA), part_rows=part_rows) == brute(rows)


def test_many_copies_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 16)
    rows = [(c, t, "user", "same", "x") for c in range(0, 900) for t in range(8)]
    assert nodes(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_odd_tables(spark):
    assert nodes(spark.createDataFrame([], SCHEMA)) == []
    one = [(1, 0, "user", "hm", None)]  # its base is missing and it may be without turns
    assert nodes(spark.createDataFrame(one, SCHEMA)) == brute(one)
    negative = [(-c, t, "user", f"{t}", "x") for c in range(100, 140) for t in range(3)]
    base = [r for r in negative if r[0] % 100 == 0]
    assert base and len(nodes(spark.createDataFrame(negative, SCHEMA))) > 3
    long = [(c, t, "user", f"{t % 7}" * 50, "x") for c in (200, 201, 202) for t in range(1500 + c)]
    assert nodes(spark.createDataFrame(long, SCHEMA)) == brute(long)


def test_role_and_text_do_not_run_together(spark):
    rows = [(0, 0, "ab", "c", "x"), (100, 0, "a", "bc", "x"), (200, 0, "ab", "c", "x")]
    assert nodes(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
