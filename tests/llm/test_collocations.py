"""Phrases against brute force, with one trie and with many."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillstream.llm import collocations

SCHEMA = "text string, lang string, phrase string, w1 int"


def brute(docs, least, top=2000, cover=80):
    counts, total = defaultdict(Counter), Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p[b : b + m] for p, a in found.items() for m in range(2, len(p)) for b in range(len(p) - m + 1) if 100 * a >= cover * c[p[b : b + m]]}
        rows = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]], k))
        for i, (score, a, p, left, right, k) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, total[lang], -score, k))
    return sorted(out)


def made(seed, n):
    r = np.random.default_rng(seed)
    words = ["the", "Of", "old", "river", "bank", "é", "ÉCOLE", "école", "a-b", "new\tyork", "x y", "end.", "so,", "\n", "  "]
    weights = np.array([9, 7, 5, 4, 4, 2, 2, 2, 1, 2, 1, 2, 2, 1, 1]) / 45
    docs = [(" ".join(r.choice(words, p=weights, size=int(r.integers(0, 60)))), ["en", "fr", None][i % 3], "p", 1) for i in range(n)]
    return docs + [(None, "en", "p", 1), ("", None, "p", 1), ("the old river bank. " * 40, "en", "p", 1), ("lone", "xx", "p", 1), *docs[:4]]


@pytest.mark.parametrize("seed, least, trie_rows", [(1, 30, 1_000_000), (2, 5, 11), (3, 2, 1_000_000)])
def test_brute_force(spark, monkeypatch, seed, least, trie_rows):
    if seed == 2:  # several shards of words, small rows and merges
        for name, value in (("VOCABULARY_ROWS", 4), ("ROW_NUMBERS", 16), ("HELD_KEYS", 50), ("SPLIT_BYTES", 300), ("BLOCK", 3)):
            monkeypatch.setattr(collocations, name, value)
    docs = made(seed, 120)
    got = collocations.mine_collocations(spark.createDataFrame(docs, SCHEMA), min_count=least, trie_rows=trie_rows)
    assert sorted(map(tuple, got.collect())) == brute(docs, least)


def test_top_and_empty(spark):
    docs = made(4, 60)
    df = spark.createDataFrame(docs, SCHEMA)
    assert sorted(map(tuple, collocations.mine_collocations(df, min_count=4, top=5).collect())) == brute(docs, 4, top=5)
    assert collocations.op12(df.limit(0)).count() == 0
    assert collocations.op12(df.limit(2)).count() == 0


def test_trie_finds_what_a_set_finds():
    r = np.random.default_rng(5)
    rows = {tuple(p) for p in r.integers(1, 40, (600, 4)).tolist()}
    closed = {(*p[:n], *[0] * (4 - n)) for p in rows for n in (2, 3, 4)}
    trie = collocations.DoubleArrayTrie(np.array(sorted(closed)))
    ids = r.integers(1, 45, 5000).astype(np.int32)
    for level, (at, slots) in enumerate(trie.walk(ids, 4), 2):
        want = [i for i in range(len(ids) - level + 1) if (*ids[i : i + level].tolist(), *[0] * (4 - level)) in closed]
        assert at.tolist() == want
        assert [tuple(trie.phrases[x][:level]) for x in trie.accept[slots]] == [tuple(ids[i : i + level]) for i in want]


def test_a_pass_for_all_words_and_tries(spark, monkeypatch):
    """However many shards of words and tries there are: texts are numbered in one pass and
    leave no words beside the numbers, each level is one pass, the driver builds no trie."""
    written, real = [], collocations.stored

    def stored(df, name, *args, **kwargs):
        written.append((name, df.columns, df._jdf.queryExecution().analyzed().toString().count("MapInArrow")))
        return real(df, name, *args, **kwargs)

    def refuse(self, phrases):
        raise AssertionError("a trie was built in the driver")

    monkeypatch.setattr(collocations, "stored", stored)
    monkeypatch.setattr(collocations, "VOCABULARY_ROWS", 4)
    monkeypatch.setattr(collocations.DoubleArrayTrie, "__init__", refuse)
    docs = made(6, 120)
    got = collocations.mine_collocations(spark.createDataFrame(docs, SCHEMA), min_count=5, trie_rows=11)
    assert sorted(map(tuple, got.collect())) == brute(docs, 5)
    assert [(columns, passes) for name, columns, passes in written if name == "phrases-texts"] == [(["ids"], 1)]
    assert [passes for name, _, passes in written if name == "phrases-candidates"] == [1, 1, 1]


def test_mapped_tries(spark):
    """Tries lie in one file that is mapped, not copied; a state spells its phrase."""
    r = np.random.default_rng(7)
    closed = {(*p[:n], *[0] * (4 - n)) for p in r.integers(1, 40, (600, 4)).tolist() for n in (2, 3, 4)}
    tries = collocations.send_tries(spark.createDataFrame(sorted(closed), "w1 int, w2 int, w3 int, w4 int"), 100)
    ids = r.integers(0, 45, 5000).astype(np.int32)
    found = {}
    for level, at, states in tries.walk(ids, 4):
        order = np.argsort(states)
        found |= {(level, a): tuple(p) for a, p in zip(at[order].tolist(), tries.spelled(states[order]).tolist(), strict=True)}
    windows = {(n, i): (*ids[i : i + n].tolist(), *[0] * (4 - n)) for n in (2, 3, 4) for i in range(len(ids) - n + 1) if ids[i : i + n].all()}
    assert found == {k: p for k, p in windows.items() if p in closed}
    assert len(tries.sizes) > 10 and all(isinstance(t.base.base, np.memmap) for t in tries._tries())
