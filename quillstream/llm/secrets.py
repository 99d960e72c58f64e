"""Secret scans behind a trigram inverted index, in DataFrame functions alone.

Each rule is a regular expression.  From it a Boolean query over trigrams is derived
that every match must satisfy.  The trigrams of all queries are indexed over the whole
texts: a stored table, by trigram, of the texts that hold it.  Of each rule the lists
that its query names are read and intersected, and only the texts that are left are
verified with its expression.  A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import ascii_lower, broadcast_if_small, stored

try:
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as sre_parser


@dataclass(frozen=True)
class Rule:
    """kind: name in spans; pattern: understood alike by Java and Python; group and
    least: matches whose group is shorter than that are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The contract's rules, in its order.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: What the method adds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)

#: A query is True (no condition), ("tri", t), ("and", queries) or ("or", queries).
MAX_EXACT = 32


def _all(parts: list) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> object:
    if any(p is True for p in parts):
        return True
    sets = {p: frozenset(p[1] if p[0] == "and" else [p]) for p in parts}
    # An alternative that asks for all that another asks for, and more, adds nothing.
    parts = [p for p in sets if not any(other < sets[p] for other in sets.values())]
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> object:
    """What holds for a text that has one of the strings in it."""
    return _any([_all([("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(nodes) -> tuple[set[str] | None, object]:
    """(the strings that the nodes can match, if those are few, else None; their query)."""
    run, parts, exact = {""}, [], True
    for op, arg in nodes:
        strings, query = None, True
        if op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            strings = {chr(a).lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            strings, query = _walk(arg[-1])
        elif op is sre.BRANCH:
            both = [_walk(x) for x in arg[1]]
            strings = set().union(*(s for s, _ in both)) if all(s is not None for s, _ in both) else None
            query = _any([q for _, q in both])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            found, inner_query = _walk(inner)
            if found is not None and high == 1:
                strings = found | ({""} if low == 0 else set())
            query = inner_query if low else True
        elif op is sre.AT:
            strings = {""}
        if strings is not None and len(strings) * len(run) <= MAX_EXACT:
            run = {a + b for a, b in product(run, strings)}
        else:
            parts += [_of_strings(run), query]
            run, exact = {""}, False
    parts.append(_of_strings(run))
    return (run if exact else None), _all(parts)


def trigram_query(pattern: str) -> object:
    """The Boolean query that every match of ``pattern`` satisfies on the lower-cased text."""
    return _walk(sre_parser.parse(pattern))[1]


def trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1]))


def index_texts(low: DataFrame, wanted: list[str]) -> DataFrame:
    """The inverted index of texts (key, low): postings (trigram, key), trigram being its place
    in ``wanted``, a folder for each, so that a query reads the lists that it names alone."""
    has = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(i)) for i, t in enumerate(wanted)]), lambda i: i.isNotNull())
    return stored(low.select(F.explode(has).alias("trigram"), "key"), "secret-postings", by="trigram")


def texts_of(postings: DataFrame, query: object, wanted: list[str]) -> DataFrame:
    """(key) of the texts that satisfy a query: the lists that it names are read, and those
    that a text is in say whether the Boolean condition holds."""
    lists = postings.where(F.col("trigram").isin([wanted.index(t) for t in sorted(trigrams(query))]))
    met = lists.groupBy("key").agg(F.collect_set("trigram").alias("has"))  # a query's trigrams at most

    def holds(q: object) -> Column:
        if q[0] == "tri":
            return F.array_contains("has", wanted.index(q[1]))
        out = holds(q[1][0])
        for x in q[1][1:]:
            out = (out & holds(x)) if q[0] == "and" else (out | holds(x))
        return out

    return met.where(holds(query)).select("key")


def _spans(text: Column, n: int, rule: Rule) -> Column:
    """Array of (start, end, rule number) in code points, leftmost, non-overlapping.

    ``split`` and ``regexp_extract_all`` cut a text at the same matches; the lengths of
    what lies between and of the matches themselves add up to the positions.
    """
    match = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else match
    cuts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), match.alias("hit"), kept.alias("val"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,n:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(F.coalesce(x["hit"], F.lit("")))
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(n).alias("n")))
        good = x["hit"].isNotNull() & (F.length(x["val"]) >= rule.least)
        return F.struct(end.cast("long").alias("at"), F.when(good, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(cuts, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def quick(rule: Rule) -> str:
    """A pattern that finds a text with a match that is long enough, without listing matches."""
    return rule.pattern[:-1] + "{%d,}" % rule.least if rule.pattern.endswith("]+") and not rule.group and rule.pattern[0] == "[" else rule.pattern


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """(id, spans) for every row: spans is array<struct<start, end, n>>, n the rule's number.

    Spans are sorted by start, then rule.  A null text counts as empty and has no spans;
    rows that repeat, or share an id, are each scanned by their own text, whole however long;
    an empty table gives no rows; further columns, whatever their names, are left out.  The
    candidates are broadcast only if at most ``broadcast_rows``, else joined by shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*map(trigrams, queries)))
    indexed = [n for n, q in enumerate(queries) if q is not True]
    if indexed:
        postings = index_texts(rows.select("key", ascii_lower(F.col("text")).alias("low")), wanted)
        each = [texts_of(postings, queries[n], wanted).select("key", F.lit(n).alias("n")) for n in indexed]
        candidates = reduce(DataFrame.union, each).groupBy("key").agg(F.collect_set("n").alias("verify"))  # a few rules
        candidates = stored(candidates, "secret-candidates")
        rows = rows.join(broadcast_if_small(candidates, broadcast_rows), "key", "left")
    else:
        rows = rows.withColumn("verify", F.lit(None).cast("array<int>"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,n:int>>")
    parts = []
    for n, rule in enumerate(rules):
        here = F.rlike(F.col("text"), F.lit(quick(rule)))
        if n in indexed:
            here = F.coalesce(F.array_contains("verify", n), F.lit(False)) & here
        parts.append(F.when(here, _spans(F.col("text"), n, rule)).otherwise(none))
    order = lambda a, b: F.when(
        a["start"] != b["start"], F.signum(a["start"] - b["start"])
    ).otherwise(F.signum(a["n"] - b["n"])).cast("int")
    return rows.select(F.col("id").alias(id_col), F.array_sort(F.concat(*parts), order).alias("spans"))


def listing(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["n"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10(docs: DataFrame) -> DataFrame:
    rules = BASE_RULES + MORE_RULES
    found = scan_secrets(docs, rules=rules)
    spans = F.col("spans")
    count = lambda n: F.size(F.filter(spans, lambda s: s["n"] == n)).cast("long")
    base = F.filter(spans, lambda s: s["n"] < len(BASE_RULES))
    return found.select(
        "doc_id",
        *(count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE_RULES)),
        F.sha2(listing(base, rules), 256).alias("base_sha256"),
        listing(spans, rules).alias("spans"),
    )


def python_spans(text: str | None, rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """The same spans by Python's ``re`` and no index: what tests compare with."""
    out = []
    for n, r in enumerate(rules):
        out += [(m.start(), m.end(), n) for m in re.finditer(r.pattern, text or "") if len(m.group(r.group)) >= r.least]
    return sorted(out, key=lambda s: (s[0], s[2]))
