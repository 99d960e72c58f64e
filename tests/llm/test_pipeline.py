"""Each stage of the pipeline, and all of them, against plain restatements."""

import base64
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from quillstream.llm.common import read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return read(spark, SF, "documents")


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as p
    import tiktoken

    with open(p.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_quality_keeps_what_the_classifier_scores_high(spark, documents):
    from quillstream.llm.quality import op8

    scores = {r["doc_id"]: r["score"] for r in op8(documents, read(spark, SF, "labels")).collect()}
    kept = pipeline.quality(spark, documents, SF)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, s in scores.items() if s >= 0.7)


def test_mixing_meets_the_targets(spark, documents):
    out = pipeline.mixing(spark, documents, SF)
    assert out.columns == documents.columns
    size = {r["doc_id"]: len((r["text"] or "").replace("\n", " ").replace("\t", " ").split(" ")) for r in documents.collect()}
    have, got = Counter(), Counter()
    for r in documents.collect():
        have[r["source"]] += size[r["doc_id"]]
    copies = Counter(r["doc_id"] for r in out.collect())
    for r in documents.collect():
        got[r["source"]] += copies[r["doc_id"]] * size[r["doc_id"]]
    assert max(copies.values()) <= 3
    # Sources weigh 1, 2, 3 in their order; one whose target is above three times its size stops there.
    sources = sorted(have)
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    capped, total = set(), sum(have.values())
    while True:
        left = total - sum(3 * have[s] for s in capped)
        target = {s: 3 * have[s] if s in capped else left * weight[s] / sum(weight[x] for x in sources if x not in capped) for s in sources}
        more = {s for s in sources if s not in capped and target[s] > 3 * have[s]}
        if not more:
            break
        capped |= more
    for s in sources:
        assert abs(got[s] - target[s]) <= 0.1 * target[s] + max(size.values())


def test_encoding_is_the_tokenizer_s(spark, documents, tokenizer):
    out = {r["doc_id"]: r for r in pipeline.encoding(spark, documents, SF).collect()}
    for r in documents.collect():
        got = out[r["doc_id"]]
        assert got["ids"] == tokenizer(r["text"] or "") and got["n_tokens"] == len(got["ids"]) and got["round_trip"]
        assert (got["lang"], got["source"]) == (r["lang"], r["source"])


def test_stages_one_after_the_other(spark, documents):
    """What run() gives is what the stages give, and reruns agree."""
    docs = documents
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), documents.schema)
    want = Counter(r["doc_id"] for r in docs.collect())
    runs = [pipeline.run(spark, SF).select("doc_id", "n_tokens", "round_trip").collect() for _ in range(2)]
    assert all(r["round_trip"] for r in runs[0]) and sorted(runs[0]) == sorted(runs[1])
    assert Counter(r["doc_id"] for r in runs[0]) == want and want


def test_stages_pass_an_empty_table(spark, documents):
    none = documents.where("false")
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
