"""Template removal against counts made by hand, and time on pages made to be slow."""

import time
from collections import defaultdict

import numpy as np
import pytest

from quillstream.llm import html_text

SCHEMA = "page_id long, url string, html string, text string, host string"


def made(seed, n, article):
    """Pages of three hosts out of paragraphs of their own and boxes that recur, none of them
    named by a class; with each page the boxes on it."""
    r = np.random.default_rng(seed)
    rows, said, boxes_of = [], {}, {}
    for i in range(n):
        host = f"h{i % 3}.org"
        own = [f"page {i} says {j} " + " ".join(map(str, r.integers(1 << 40, size=12))) for j in range(int(r.integers(1, 6)))]
        boxes = [b for b in range(4) if r.random() < (0.9, 0.5, 0.1, 0.02)[b]]
        parts = [(f"<p id='p{i}-{j}'>{t}</p>", t) for j, t in enumerate(own)]
        for b in boxes:
            # Attributes differ from page to page, as in made-up ids; tags and texts do not.
            html = f"<div id=x{r.integers(1 << 30)}><section>box {b} of {host}</section><span>now</span> and then</div>"
            parts.insert(int(r.integers(0, len(parts) + 1)), (html, None))
        body = "".join(h for h, _ in parts)
        rows.append((i, f"http://{host}/{i}", f"<html><body>{f'<article>{body}</article>' if article else body}</body></html>", "x", "y"))
        said[i], boxes_of[i] = [t for _, t in parts], (host, boxes)
    return rows, said, boxes_of


@pytest.mark.parametrize("seed, article", [(1, False), (2, True)])
def test_boxes_that_recur_go_and_nothing_else(spark, seed, article):
    rows, said, boxes_of = made(seed, 240, article)
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    pages, count = defaultdict(int), defaultdict(int)
    for host, boxes in boxes_of.values():
        pages[host] += 1
        for b in boxes:
            count[host, b] += 1
    gone = {k for k, n in count.items() if n >= 3 and n >= min(0.2 * pages[k[0]], 100)}
    assert {b for _, b in gone} == {0, 1}
    for i, texts in said.items():
        host, boxes = boxes_of[i]
        lines = got[i].split("\n")
        assert [x for x in lines if x.startswith("page")] == [t for t in texts if t is not None]
        left = [b for b in boxes if (host, b) not in gone]
        assert sorted(x for x in lines if x.startswith("box")) == sorted(f"box {b} of {host}" for b in left)
        assert sum(x == "now and then" for x in lines) == len(left)


def test_broadcast_or_joined_is_the_same(spark):
    rows, *_ = made(3, 90, False)
    df = spark.createDataFrame([*rows, rows[0], (900, None, None, "x", "y"), (901, "no host", "", "x", "y")], SCHEMA)
    a, b = (sorted(map(str, html_text.extract_text(df, broadcast_keys=n).collect())) for n in (0, 1_000_000))
    assert a == b and len(a) == 93


def test_reruns_agree_on_pages_with_the_same_texts(spark):
    """Pages that say the same in other elements are one witness, the same one each time."""
    rows = [(i, "http://a.org/", f"<body><div><{'section' if i % 2 else 'aside2'}>box</{'section' if i % 2 else 'aside2'}></div><p>text {i // 2}</p>", "x", "y") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    runs = [sorted(map(str, html_text.extract_text(df.repartition(n)).collect())) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]


@pytest.mark.parametrize("made_of", [
    ('<a "', ""), ("<div>x", ""), ("<ul><li>", "<x>y"), ("<td><div>", "<x><tr>"), ("<div>", "</p>"), ("<", ">"), ("<!", ""), ("<article>x", ""),
    ("<script>", "</script"), ('<a x="', ">"), ("<p><x>", "</x>"), ("<span class=ad>", "x"),
])
def test_time_grows_with_length_alone(made_of):
    def seconds(n):
        html = made_of[0] * n + made_of[1] * n
        began = time.process_time()
        html_text.main_text(html, ())
        return time.process_time() - began

    seconds(2000)
    small, large = seconds(10_000), seconds(80_000)
    assert large < max(1.0, 24 * small)  # eight times the length; sixty-four times, if it were squared


def test_quotes_that_never_close():
    assert html_text.main_text('<p class="a">one</p><p title="two>three</p><p>four', ()) == "one\nthree\nfour"
    assert html_text.main_text("a < b and <3 <p>c", ()) == "a < b and <3\nc"
    assert html_text.main_text("<p>a<!-- <p>b</p> --><![CDATA[x & <y>]]>c<script>if (a<b) '</p>'</script>d", ()) == "ax & <y>c\nd"
