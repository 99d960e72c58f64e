"""Each training-data operator against brute force, and on nulls, empty texts, ties,
repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import bpe, exact_dedup, html_text, jaccard_join, mixing, quality, secrets, topk_search, toxicity, url_filter

DOCS = "doc_id long, text string, source string, kept string"
WORDS = "the quick brown fox jumps over a lazy dog near some old river bank while birds sing about morning light".split()


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in r.integers(0, len(WORDS), n))


LONG = prose(1, 5000)
ROWS = [
    (1, "Hello World", "a", "x"), (2, "hello world", "b", "x"), (2, "hello world", "b", "x"), (3, None, None, None), (4, "", "a", "x"),
    (5, LONG, "a", "x"), (6, LONG + " end", "é", "x"), (None, "no id", "a", "x"), (7, "ÉCOLE école", "c", "x"), (8, "école école", "c", "x"),
    (9, prose(2, 40), "a", "x"), (10, prose(2, 40) + " more", "a", "x"), (11, "one two", "a", "x"), (12, "ONE  two", "a", "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(docs, none):
    out = exact_dedup.op4(docs).collect()
    assert len(out) == len(ROWS)
    by = {r["doc_id"]: r for r in out}
    assert (by[1]["keep_id"], by[1]["group_size"], by[1]["kept"]) == (2, 3, False)
    assert by[3]["keep_id"] == 4 and not by[3]["kept"] and by[None]["kept"]
    assert by[7]["keep_id"] == 7 and by[8]["keep_id"] == 8  # only A-Z is folded
    assert by[1]["text_sha256"] == hashlib.sha256(b"hello world").hexdigest()
    assert exact_dedup.exact_dedup(docs).columns.count("kept") == 1
    assert exact_dedup.op4(none).count() == 0


def test_mixing(docs, none):
    out = mixing.op7(docs).collect()
    assert len(out) == len(ROWS)
    size = {r["doc_id"]: r["size"] for r in out}
    assert size[5] == 5000 and size[3] == size[4] == 0
    assert all(r["taken"] <= 3 * r["size"] for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.op7(docs).collect()))
    assert mixing.op7(none).count() == 0


def test_mixing_reaches_targets_whatever_the_parts(spark):
    rows = [(i, prose(i, 1 + i % 37), "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = mixing.mix_to_targets(df, part_rows=4).toPandas().sort_values("doc_id")
    assert a.equals(mixing.mix_to_targets(df).toPandas().sort_values("doc_id").set_index(a.index))
    got = a.groupby(["source_size", "target"])["taken"].sum().reset_index()
    assert ((got["taken"] - got["target"]).abs() <= 40).all()


def test_secrets(spark, none):
    key = "AKIA" + "Q" * 16
    texts = [f'x password: "abcdefgh1" {key}', "token=abc", None, "", "SECRET = 12345678", "é api_key='zzzzzzzz9' " + "0af" * 11, "APIKEY:aaaaaaaa token=bbbbbbbb" * 2, "deadbeef" * 4]
    df = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string")
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    for few in (0, 500_000):
        got = {r["doc_id"]: [(s["start"], s["end"], s["n"]) for s in r["spans"]] for r in secrets.scan_secrets(df, broadcast_rows=few).collect()}
        assert got == {i: secrets.python_spans(t, rules) for i, t in enumerate([*texts, texts[0]])}
    assert secrets.op10(none.select("doc_id", "text")).count() == 0
    assert secrets.trigram_query(secrets.BASE_RULES[2].pattern) is True


def test_bpe_is_the_library_s(docs, none):
    import public_tokenizers as p
    import tiktoken

    with open(p.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table, pattern = bpe.vocabulary()
    out = bpe.bpe_decode(bpe.bpe_encode(docs, table, pattern, slice_bytes=64), table).collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert r["ids"] == enc.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.op9(none).count() == 0


def brute_components(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if label[a] != label[b] and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_jaccard_join(spark, docs, none):
    base = prose(7, 60).split()
    rows = [(i, " ".join(base[: i % 23] + [f"w{i}"] + base[i % 23 :])) for i in range(70)]
    rows += [(100 + i, prose(100 + i, 30)) for i in range(20)] + [(r[0] + 200, r[1]) for r in ROWS if r[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_components(rows)
    for size, sample, few in ((64, 4000, 4_000_000), (4, 1, 0)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(df, group_size=size, sample_docs=sample, broadcast_rows=few).collect()}
        assert got == expected
    nameless = [r for r in jaccard_join.op3(docs).collect() if r["doc_id"] is None]
    assert [(r["n_shingles"], r["component_id"]) for r in nameless] == [(1, None)]
    assert jaccard_join.op3(none).count() == 0


def test_topk(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 8)).round(2).tolist()
    x[5], x[6], x[7] = x[8], None, [None, *x[7][1:]]
    x[9][0] = float("nan")
    df = spark.createDataFrame([*enumerate(x), (None, x[0]), (0, x[0])], "vec_id long, embedding array<double>")
    v = {i: np.floor(1024 * np.array(e)).astype(int) for i, e in enumerate(x) if e and None not in e and e[0] == e[0]}
    out = topk_search.topk_search(df, F.col("vec_id") % 100 == 0, block_rows=100, query_rows=4, sample_rows=64).collect()
    got = {}
    for q, n, i, s in sorted(out):
        got.setdefault(q, []).append((n, i, s))
    for q in [i for i in v if i % 100 == 0]:
        best = sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:10]
        assert got[q] == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert len(got) == 15
    assert topk_search.op1(df.where("false")).count() == 0


def test_toxicity_and_quality(spark, none):
    r = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(600):
        toxic, bad = bool(r.random() < 0.3), bool(r.random() < 0.3)
        text = prose(i, 60).split()
        if toxic:
            text[::9] = ["zilch" + "abcdefgh"[j % 8] for j in range(len(text[::9]))]
        rows.append((i, " ".join(f"{w}***" if bad else w for w in text)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "no id here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    known = {i: (q, t) for i, q, t in labels}
    for op, n, mod, held in ((toxicity.op2, 1, 5, 0), (quality.op8, 0, 4, 2)):
        out = op(df, lab).collect()
        assert len(out) == len(rows) and all(0 <= x["score"] <= 1 for x in out)
        test = [x for x in out if x["held_out"] and x["doc_id"] in known]
        assert all(zlib.crc32(str(x["doc_id"]).encode()) % mod == held for x in test)
        assert np.mean([x["predicted"] == known[x["doc_id"]][n] for x in test]) > 0.95
        assert op(none.select("doc_id", "text"), lab.where("false")).count() == 0


def brute_kneser_ney(counts, d=0.75):
    """Ratio of a word from {word: (ordinary, toxic)}, with no beginning left out."""
    spell = lambda w: (w + "$")[: toxicity.DEPTH]
    starts = {}
    for w, ab in counts.items():
        for i in range(1, len(spell(w)) + 1):
            starts.setdefault(spell(w)[:i], np.zeros(2))
            starts[spell(w)[:i]] += ab
    below = {}
    for g, ab in starts.items():
        t = below.setdefault(g[:-1], np.zeros((2, 2)))
        t += [ab, ab > 0]
    kinds = [Counter(("^^" + g)[-k:] for g in starts) for k in (1, 2, 3)]

    def shared(g):
        same = [n for x, n in kinds[len(g) - 1].items() if x[:-1] == g[:-1]]
        back = shared(g[1:]) if len(g) > 1 else 1 / (len(kinds[0]) + 1)
        return (max(kinds[len(g) - 1][g] - d, 0) + d * len(same) * back) / sum(same)

    def word(w):
        x = 0.0
        for i in range(1, len(spell(w)) + 1):
            g = spell(w)[:i]
            total, n = below.get(g[:-1], np.zeros((2, 2)))
            if g not in starts:
                return x + float(np.diff(np.log([d * k / t if t else 1 for t, k in zip(total, n)]))[0])
            back = shared(("^^" + g)[-3:])
            x += float(np.diff(np.log([(max(c - d, 0) + d * k * back) / t if t else back for c, t, k in zip(starts[g], total, n)]))[0])
        return x

    return word


def test_toxicity_model_has_every_beginning(spark):
    r = np.random.default_rng(11)
    rows = [(i, prose(i, 12) + f" zil{'abcdefgh'[i % 8]}{'xyz'[i % 3]} {'qrstuvw'[i % 7]}once{'abcdefghij'[i % 10]} " + "long" * (i % 6)) for i in range(60)]
    rows += [(100, "unseen Zilpha"), (101, "zilax zilax ünseen"), (102, None), (103, "... Ω"), (101, "zilax zilax ünseen")]
    rows += [(104, "someverylongword" + "zilaxonce" * 3), (105, "x" * 17 + "zilax")]
    labels = [(i, int(r.random() < 0.4)) for i in range(40)]
    counts, toxic = {}, dict(labels)
    for i, t in rows[:30]:
        for w in set(toxicity.words_of(t)):
            counts.setdefault(w, np.zeros(2))[toxic[i]] += 1
    word = brute_kneser_ney(counts)

    def evidence_of(text):  # what each word says above two nats, by words to the power 3/4
        words = toxicity.words_of(text)
        return sum(max(0.0, word(w) - 2.0) for w in words) / max(1, len(words)) ** 0.75

    expected = sorted((str(i), round(float(evidence_of(t)), 5)) for i, t in rows)
    assert len({x for _, x in expected}) > 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    args = (df, lab, F.col("doc_id") < 30, F.col("doc_id") >= 30, "doc_id", "text", "toxic", 4000)
    for sent, few in ((200_000, 4_000_000), (5, 0), (0, 4_000_000)):
        evidence = toxicity.fit_toxicity(*args, sent, few)[0]
        got = evidence.add(df, "text", "x").collect()
        assert sorted((str(x["doc_id"]), round(x["x"], 5)) for x in got) == expected


def test_long_words_are_read_whole():
    words = toxicity.words_of("short " + "abcdefghijklmnop" + " " + "abcdefghijklmnopqrst 12 ab_c")
    assert words[:2] == ["short", "abcdefghijklmnop"] and words[-2:] == ["ab", "c"]
    assert words[2:-2] == ["abcdefghijklmnopqrst"[i : i + 16] for i in range(17)]
    assert words[-3] == "qrst"


def test_urls(spark):
    urls = ["http://com/x", "https://WWW.Example.com/en/1", "http://a.example.com/en/", "http://b.net/es/?q", "net/es/", None, "http://x.org", "http://notexample.com/en/", "http://net/fr/#t", "http://example.com"]
    out = url_filter.op6(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [r["rule"] for r in out] == ["com/", "www.example.com/en/", "example.com/en/", "net/es/", None, None, None, "com/", "net/fr/", None]
    assert [r["verdict"] for r in out] == ["allow", "allow", "block", "block", "allow", "allow", "allow", "allow", "block", "allow"]
    assert (out[1]["host"], out[1]["path"], out[4]["host"], out[5]["path"]) == ("www.example.com", "/en/1", "", "")


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div id=x>Site {0}</div><article><h1>A&amp;B</h1><p>one\n two<br>three<p>four<div class=comments>c</div></article><footer>f</footer>"
    same = "<body><div>boiler <b>plate</b></div><p>text {0}</p></body>"
    rows = [(1, "http://a/1", page), (2, "http://a/2", None), (3, None, "")] + [(10 + i, f"http://b/{i}", same.format(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for few in (0, 1000):
        got = {r["page_id"]: r["text"] for r in html_text.extract_text(df, broadcast_keys=few).collect()}
        assert got[1] == "A&B\none two three\nfour" and got[2] == got[3] == ""
        assert all(got[10 + i] == f"text {i}" for i in range(6))
    assert html_text.op5(df.where("false")).count() == 0


def test_html_copies_are_one_witness(spark):
    copy = "<body><div><p>first part</p><p>second part</p></div></body>"
    inside = "<body><article><h1>{0}</h1><div><p>a long text that several pages have</p></div></article></body>"
    rows = [(i, f"http://a/{i}", copy) for i in range(5)] + [(10 + i, f"http://b/{i}", inside.format(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for few in (0, 1000):
        got = {r["page_id"]: r["text"] for r in html_text.extract_text(df, broadcast_keys=few).collect()}
        assert all(got[i] == "first part\nsecond part" for i in range(5))
        assert all(got[10 + i] == f"{i}\na long text that several pages have" for i in range(5))


def test_html_templates_of_a_large_host(spark):
    box = "<div>see also this</div>"
    rows = [(i, f"http://a/{i}", f"<body>{box if i < 150 else ''}<p>text {i}</p></body>") for i in range(1000)]
    got = html_text.op5(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"text {r['page_id']}" for r in got)


def test_html_labels_are_whole(spark):
    pages = {
        '<body><article class="post comments-open"><p>a</p></article></body>': "a",
        '<body><div class="content with-sidebar"><p>a</p></div><div id="main" class="no-sidebar"><p>b</p></div></body>': "a\nb",
        '<body><article><header class="entry-header"><h1>t</h1></header><div class="header">u</div><p>a</p></article></body>': "t\nu\na",
        '<body><div class="widget"><main><p>a</p></main></div></body>': "a",
        '<body><p>a <span class="ad">buy <span>now</span></span>b <a class="share">x</a></p><p><i class=ad>y</p><p>c</p></body>': "a b\nc",
        '<body><div class="big ad">x</div><p>a</p></body>': "a",
    }
    df = spark.createDataFrame([(i, f"http://h{i}/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.op5(df).collect()}
    assert [got[i] for i in range(len(pages))] == list(pages.values())


def test_pipeline_keeps_one_of_each_group(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = c.near(spark, c.exact(spark, docs, sf), sf)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and len(ids) < docs.count()
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert Counter(label for _, label in brute_components(rows).values()).most_common(1)[0][1] == 1


def test_bpe_decode_refuses_unknown_ids(spark):
    table, _ = bpe.vocabulary()
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.bpe_decode(odd, table).collect()} == {1: None, 2: b""}
    for bad, why in ((-1, "vocabulary has not"), (len(table), "vocabulary has not"), (None, "MALFORMED_CHARACTER")):
        with pytest.raises(Exception, match=why):
            bpe.bpe_decode(spark.createDataFrame([(1, [0, bad])], "doc_id long, ids array<int>"), table).collect()


def test_exact_dedup_tells_texts_of_one_hash_apart(docs):
    want = sorted(map(str, exact_dedup.exact_dedup(docs, keep="max").collect()))
    for rows in (-1, 500_000):
        weak = exact_dedup.exact_dedup(docs, keep="max", digest=lambda c: F.substring(F.md5(c), 1, 1), broadcast_rows=rows)
        assert sorted(map(str, weak.collect())) == want


def test_dual_tree_descends_and_prunes():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 3000, (40, 16))[rng.integers(0, 40, 2000)] + rng.normal(0, 100, (2000, 16))).astype(np.int64)
    ids = np.arange(2000)
    t = topk_search.DualTree(ids[:100], x[:100], np.full(100, topk_search.NEVER), ids, x, 10)
    assert t.scored < 0.9 * 100 * 2000
    for i, heap in enumerate(t.best):
        s = x @ x[i]
        assert sorted((-a, -b) for a, b in heap) == sorted((-int(s[j]), j) for j in range(2000) if j != i)[:10]
