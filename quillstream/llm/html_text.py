"""HTML extraction by removal of site templates.

Every page is cut into elements.  The subtree of each element that may be a template is
hashed, Spark counts on how many pages of its host each hash occurs, and subtrees that
recur on many pages of their host are deleted.  Elements whose tag, role or class says
that they are no article text (menus, adverts, forms, scripts and so on) go as well,
since a host with few pages shows no recurrence.  What is left of the article gives the
text blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import stored

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LABEL = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Elements whose content is not markup, up to their end tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Inside these a block of text goes on.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: No article text, wherever they stand.
DROP_TAGS = frozenset(
    "head nav footer aside form button select option dialog menu svg math canvas audio video object applet map input fieldset".split()
)
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sidebar menu nav navbar navigation footer header masthead cookie "
    "cookies consent gdpr notice notices alert comment comments commentlist respond reply replies disqus promo promotion sponsor "
    "sponsored share sharing social related newsletter subscribe subscription signup breadcrumb breadcrumbs pagination pager popup "
    "modal overlay widget toolbar skip login search complementary contentinfo form".split()
)
#: Blocks that the article itself consists of: inside it they are never taken for a template.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())
#: Inside an article these name its own head.
HEAD_WORDS = frozenset("header banner masthead".split())
ROOTS = frozenset("html body article main".split())
#: An open element of the key's kind ends where one of these begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


#: Containers that an element whose end tag was left out does not reach beyond.
HOLDS = frozenset("div section article main table ul ol dl body".split())


class _Element:
    __slots__ = ("tag", "parent", "drop", "article", "key", "around", "root", "chars", "hash", "gone")

    def __init__(self, tag: str, parent: _Element | None, drop: bool, article: bool):
        self.tag, self.parent, self.drop, self.article, self.key = tag, parent, drop, article, None
        self.around, self.root, self.chars, self.gone = False, None, 0, False  # has an article inside; the article around; its text's length
        self.hash = xxhash.xxh64(tag.encode("utf-8", "replace"))


def dropped(attributes: str, article: bool) -> bool:
    """Whether a whole class, id or role says that this is no article text."""
    if not attributes:
        return False
    found = DROP_WORDS.intersection(" ".join(x[1] or x[2] or x[3] for x in _LABEL.findall(attributes)).lower().split())
    return bool(found - HEAD_WORDS if article else found)


def _tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it is an end tag, attributes) of each tag, in one pass; comments
    and declarations have no name, character data has the name ``![cdata[``.

    Where quotes don't close any more, tags from there on end at the next ``>``; a ``<`` that
    begins nothing is text.
    """
    pos, last, quoted = 0, html.rfind(">"), True
    while 0 <= (at := html.find("<", pos)) < last:
        if html.startswith(("<!--", "<![CDATA["), at):
            comment = html[at + 2] == "-"
            end = html.find("-->" if comment else "]]>", at + (4 if comment else 9))
            pos = end + 3 if end >= 0 else len(html)
            yield at, pos, "" if comment else "![cdata[", False, "" if comment else html[at + 9 : end if end >= 0 else pos]
            continue
        if html.startswith(("<!", "<?"), at):
            pos = html.find(">", at) + 1
            yield at, pos, "", False, ""
            continue
        name = _NAME.match(html, at)
        if not name:
            pos = at + 1
            continue
        found = _ATTRIBUTES.match(html, name.end()) if quoted else None
        quoted = found is not None
        end = found.end() if found else html.find(">", name.end()) + 1
        if not end:
            return
        pos = end
        tag = name[2].lower()
        yield at, pos, tag, bool(name[1]), html[name.end() : end - 1]
        if tag in RAW and not name[1]:  # its content is no markup
            close = re.compile(f"</{re.escape(tag)}\\b", re.I).search(html, pos)
            end = html.find(">", close.end()) + 1 if close else 0
            pos = end or len(html)
            yield pos, pos, "", False, ""


def parse(html: str) -> tuple[list[tuple[str, _Element | None]], list[_Element]]:
    """(text blocks in page order, each with the element that holds it; all elements, those
    around others first).

    ``key`` of an element that may be a template is the hash of its subtree: tags and block
    texts, without attributes and inline elements.  Time grows with the page's length alone:
    an element's hash takes up those of its children, and lists by tag say what is open.
    """
    stack: list[_Element] = []
    open_at: dict[str, list[int]] = {}  # places in the stack, by tag
    holds: list[int] = []
    elements: list[_Element] = []
    blocks: list[tuple[str, _Element | None]] = []
    text: list[str] = []
    hidden: list = []  # a dropped inline element: its tag, how often it is open, the elements around it

    def flush() -> None:
        if text:
            words = unescape("".join(text)).split()
            text.clear()
            if words:
                block = " ".join(words)
                if stack:
                    stack[-1].chars += len(block)
                    stack[-1].hash.update(b"\0" + block.encode("utf-8", "replace"))
                blocks.append((block, stack[-1] if stack else None))

    def close(to: int) -> None:
        while len(stack) > to:
            e = stack.pop()
            open_at[e.tag].pop()
            if e.tag in HOLDS:
                holds.pop()
            if e.parent is not None:
                e.parent.hash.update(b"\1" + e.hash.digest())
        if hidden and len(stack) < hidden[2]:  # its end tag was left out
            hidden.clear()

    pos, skip = 0, False
    for start, end, tag, ends, attributes in _tags(html):
        if start > pos and not hidden and not skip:
            text.append(html[pos:start])
        pos, skip = end, False
        if not tag:
            continue
        if tag == "![cdata[":
            if not hidden:
                text.append(attributes.replace("&", "&amp;"))
            continue
        if tag in INLINE:
            if tag == "br" and not hidden:
                text.append(" ")
            elif hidden and tag == hidden[0]:
                hidden[1] += -1 if ends else 1
                if not hidden[1]:
                    hidden.clear()
            elif not hidden and not ends and tag not in VOID and dropped(attributes, bool(stack and stack[-1].article)):
                hidden[:] = tag, 1, len(stack)
            continue
        flush()
        if ends:
            if open_at.get(tag):
                close(open_at[tag][-1])
            continue
        if tag in RAW:
            skip = True
            continue
        if tag in VOID:
            continue
        # End tags that may be left out: the topmost such element, unless a container is above it.
        left = max((open_at[t][-1] for t in ("p", *(t for t, by in ENDS.items() if tag in by)) if open_at.get(t)), default=-1)
        if left >= 0 and left > (holds[-1] if holds else -1):
            close(left)
        above = stack[-1] if stack else None
        article = bool(above and above.article) or tag in ("article", "main")
        drop = tag in DROP_TAGS or (tag == "header" and not article)
        if tag not in ROOTS:
            drop = drop or dropped(attributes, article)
        e = _Element(tag, above, drop, article)
        elements.append(e)
        e.root = above and (above if above.tag in ("article", "main") else above.root)
        if tag in ("article", "main"):
            x = above
            while x is not None and not x.around:
                x.around = True
                x.drop = x.drop and (x.tag in DROP_TAGS or x.tag == "header")  # never by its label
                x = x.parent
        if not attributes.rstrip().endswith("/") or tag in ROOTS:
            open_at.setdefault(tag, []).append(len(stack))
            if tag in HOLDS:
                holds.append(len(stack))
            stack.append(e)
    if pos < len(html) and not hidden:
        text.append(html[pos:])
    flush()
    close(0)
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.chars += e.chars
    for e in elements:
        # What holds an article or most of one is the article, and so are its own blocks.
        most = e.root is not None and 2 * e.chars > e.root.chars
        if e.chars and e.tag not in ROOTS and not (e.article and e.tag in TEXT_TAGS) and not e.around and not most:
            e.key = e.hash.intdigest() >> 1
    return blocks, elements


def template_keys(html: str) -> set[int]:
    return {e.key for e in parse(html)[1] if e.key is not None}


def witness(html: str) -> tuple[int, list[int]]:
    """(hash of the page's block texts, keys of its elements)."""
    blocks, elements = parse(html)
    said = "\n".join(t for t, _ in blocks).encode("utf-8", "replace")
    return xxhash.xxh64_intdigest(said) >> 1, sorted({e.key for e in elements if e.key is not None})


def main_text(html: str, templates) -> str:
    """The blocks outside dropped elements and outside subtrees whose hash is in ``templates``,
    joined by line ends.  Where the templates find nothing on a page, the article that it
    marks, if any, bounds its text."""
    blocks, elements = parse(html)
    found = False
    for e in elements:
        template = e.key is not None and e.key in templates
        found = found or template
        e.gone = template or e.drop or (e.parent is not None and e.parent.gone)
    kept = [(t, e) for t, e in blocks if e is None or not e.gone]
    marked = [] if found else [t for t, e in kept if e is not None and e.article]
    return "\n".join(marked or [t for t, _ in kept])


class _Sorted:
    """Membership in a sorted array of keys."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def __contains__(self, key: int | None) -> bool:
        if key is None or not len(self.keys):
            return False
        i = int(np.searchsorted(self.keys, key))
        return i < len(self.keys) and int(self.keys[i]) == key


def extract_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = 3,
    min_share: float = 0.2,
    enough_pages: int = 100,
    broadcast_keys: int = 1_000_000,
) -> DataFrame:
    """(id, url, text) for every row.

    A subtree is a template if it occurs on at least ``min_pages`` pages of its host and on
    ``min_share`` of them, or on ``enough_pages`` however large the host.  A null html is an empty page and gives an empty text; a null
    url stands for a host of its own.  Pages of a host with the same block
    texts count once and are extracted each; what holds an article, or most of one, is no template.
    The templates are broadcast if no more than ``broadcast_keys``; otherwise each page
    gets its own by joins.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[^:]*://([^/?#]*)", 1)), F.lit(""))
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.xxhash64(host).alias("host"))

    @F.pandas_udf("array<long>")
    def keys_of(html: pd.Series) -> pd.Series:
        return html.map(lambda h: sorted(template_keys(h)))

    @F.pandas_udf("page long, keys array<long>")
    def witness_of(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([witness(h) for h in html], columns=["page", "keys"])

    # Pages of a host that say the same are one witness.
    pages_of = rows.select("host", witness_of("html").alias("w")).groupBy("host", "w.page").agg(F.min("w.keys").alias("keys"))
    pages_of = stored(pages_of, "page-keys")
    keys = pages_of.select("host", F.explode("keys").alias("key"))
    counts = keys.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    of_host = pages_of.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    found = counts.join(of_host, "host").where(F.col("n") >= F.least(F.col("pages") * min_share, F.lit(float(enough_pages))))
    found = stored(found.select("host", "key"), "page-templates")
    if found.count() <= broadcast_keys:
        by_host: dict[int, list[int]] = {}
        for r in found.collect():
            by_host.setdefault(r["host"], []).append(r["key"])
        known = pages.sparkSession.sparkContext.broadcast({h: np.sort(np.array(k, np.int64)) for h, k in by_host.items()})

        @F.pandas_udf("string")
        def text_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            templates = {h: _Sorted(k) for h, k in known.value.items()}
            for hosts, html in batches:
                yield pd.Series([main_text(x, templates.get(int(h), ())) for h, x in zip(hosts, html, strict=True)], dtype=object)

        return rows.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text_of("host", "html").alias("text"))
    page = F.xxhash64("id", "url", "html")
    own = rows.select(page.alias("page"), "host", F.explode(keys_of("html")).alias("key")).join(found, ["host", "key"])
    own = own.groupBy("page").agg(F.collect_set("key").alias("keys"))  # at most a page's elements

    @F.pandas_udf("string")
    def text_with(keys: pd.Series, html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, set() if k is None else {int(x) for x in k}) for k, h in zip(keys, html, strict=True)], dtype=object)

    joined = rows.withColumn("page", page).join(own, "page", "left")
    return joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text_with("keys", "html").alias("text"))


def op5(pages: DataFrame) -> DataFrame:
    found = extract_text(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
