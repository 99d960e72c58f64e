"""Best-fit packing against the tokenizer's own library, and the plan against brute force."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstream.llm import packing

TEXTS = [None, "", "a few words", "a few words", "x" * 40, "word " * 3000, "é 中文 " * 700, "end <|endoftext|> of text", "\n\n \t", "one, two; three " * 150]


@pytest.fixture(scope="module")
def whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, texts, encode, capacity):
    """Pieces are the documents' ids, in order, and sequences have neither gaps nor overlaps."""
    bins = defaultdict(list)
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = Counter()
    for doc_id, text in texts:
        ids = encode(text)
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert got == want
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity, part_rows", [(1024, 4096), (64, 2), (16, 1)])
def test_pieces_are_the_documents_ids(spark, whole, capacity, part_rows):
    texts = [*enumerate(TEXTS), (2, TEXTS[2]), (None, "no id")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, length string, sequence_id int")
    out = packing.pack_best_fit(df, capacity=capacity, part_rows=part_rows, keep_ids=True)
    rows = out.collect()
    check(rows, texts, whole, capacity)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    assert sorted(map(str, rows)) == sorted(map(str, out.collect()))


def test_whole_table(spark, whole):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in d.collect()]
    rows = packing.op11(d).collect()
    n = check(rows, texts, whole, 1024)
    assert n <= -(-sum(r["length"] for r in rows) // 1024) + 2
    assert packing.op11(d.limit(0)).count() == 0


def test_long_blanks_go_to_the_library(whole):
    import public_tokenizers as p

    text = "a" + " " * 700_000 + "b"
    assert packing.encoder(p.path("byte_bpe_50k.tiktoken"), p.path("byte_bpe_50k.json"))(text) + [2] == whole(text)


def fewest(lengths, capacity):
    """The least number of bins, by trying all."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= lengths[i]}:
            j = rooms.index(room)
            go(i + 1, rooms[:j] + [room - lengths[i]] + rooms[j + 1 :])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_plans_hold_every_piece_and_are_near_the_fewest(lengths):
    plan = packing.best_fit(Counter(lengths), 20)
    better = packing.swap_search(plan, 20)
    for p in (plan, better):
        assert Counter(x for k, n in p.items() for x in k for _ in range(n)) == Counter(lengths)
        assert all(sum(k) <= 20 for k in p)
    squares = [sum(sum(k) ** 2 * n for k, n in p.items()) for p in (plan, better)]
    assert squares[1] >= squares[0] and sum(better.values()) <= sum(plan.values())
    assert sum(better.values()) <= fewest(lengths, 20) + 1


def test_swaps_empty_bins_that_best_fit_leaves():
    r = random.Random(3)
    lengths = Counter(r.randint(200, 500) for _ in range(4000))
    plan = packing.best_fit(lengths)
    assert sum(packing.swap_search(plan).values()) < sum(plan.values())
