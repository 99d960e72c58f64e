"""URL filters on a sorted array of digests.

Each rule is a key (host, then path); the 64-bit xxhash of every key is kept in one
sorted array beside the full strings.  The arrays are files that Spark ships to each
executor once; tasks map them into memory, so workers share pages and nothing is
unpickled.  A batch of urls is probed at once by binary search, and each hit is confirmed
with the stored string, since two strings may share a digest.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import LOWER, UPPER

_LOWER = str.maketrans(UPPER, LOWER)
_END = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) as the rules see them; both empty for a null or a url without ``://``."""
    if not isinstance(url, str) or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = _END.search(rest)
    cut = m.start() if m else len(rest)
    path = _PATH_END.split(rest[cut:], maxsplit=1)[0]
    return rest[:cut].translate(_LOWER), path


def write_rules(rules: Iterable[tuple[str, str, str]], folder: str) -> list[str]:
    """Write (action, host, path) rules as sorted arrays; of equal keys the last wins."""
    table = {host + path: (action, len(host)) for action, host, path in rules}
    keys = sorted(table, key=lambda k: xxhash.xxh64_intdigest(k.encode()))
    raw = [k.encode() for k in keys]
    name = f"urls-{uuid.uuid4().hex}"
    arrays = {
        "digests": np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64),
        "offsets": np.cumsum([0, *map(len, raw)], dtype=np.int64),
        "strings": np.frombuffer(b"".join(raw), np.uint8),
        "block": np.array([table[k][0] == "block" for k in keys], np.bool_),
        "paths": np.array(sorted({len(k) - table[k][1] for k in keys}), np.int64),
    }
    out = []
    for part, array in arrays.items():
        out.append(os.path.join(folder, f"{name}-{part}.npy"))
        np.save(out[-1], array)
    return out


class DigestArray:
    """The rules' files, mapped into memory."""

    def __init__(self, files: dict[str, str]):
        for part, path in files.items():
            setattr(self, part, np.load(path, mmap_mode="r"))

    def find(self, keys: list[str]) -> np.ndarray:
        """For each key the place of its rule, or -1."""
        raw = [k.encode() for k in keys]
        probe = np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64)
        at = np.searchsorted(self.digests, probe)
        out = np.full(len(keys), -1, np.int64)
        inside = at < len(self.digests)
        hits = np.flatnonzero(inside)
        for i in hits[self.digests[at[hits]] == probe[hits]]:
            j = at[i]
            while j < len(self.digests) and self.digests[j] == probe[i]:  # all that share the digest
                if bytes(self.strings[self.offsets[j] : self.offsets[j + 1]]) == raw[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def judge(self, urls: Iterable[str | None], default: str) -> pd.DataFrame:
        """A rule fits its host and all subdomains if the path starts with the rule's; the
        longest rule wins, of equally long ones that with the longer host."""
        hosts, paths, keys, owner, rank = [], [], [], [], []
        for n, url in enumerate(urls):
            host, path = split_url(url)
            hosts.append(host)
            paths.append(path)
            labels = host.split(".")
            for i in range(len(labels) if "://" in (url or "") else 0):
                suffix = ".".join(labels[i:])
                for length in self.paths:
                    if length <= len(path):
                        keys.append(suffix + path[:length])
                        owner.append(n)
                        rank.append((len(keys[-1]), len(suffix)))
        best: dict[int, tuple] = {}
        if keys:
            for i, j in enumerate(self.find(keys)):
                if j >= 0:
                    best[owner[i]] = max(best.get(owner[i], ((0, 0), "", False)), (rank[i], keys[i], bool(self.block[j])))
        rule = [best[n][1] if n in best else None for n in range(len(hosts))]
        verdict = [("block" if best[n][2] else "allow") if n in best else default for n in range(len(hosts))]
        return pd.DataFrame({"host": hosts, "path": paths, "rule": pd.Series(rule, dtype=object), "verdict": verdict})


def ship(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> dict[str, str]:
    """Give the rules' files to Spark, which hands them to every executor; names by part."""
    folder = os.path.realpath(tempfile.mkdtemp(prefix="urls-"))  # the driver's own; Spark serves the files
    names = {}
    for path in write_rules(rules, folder):
        spark.sparkContext.addFile(path)
        names[path.rsplit("-", 1)[1].removesuffix(".npy")] = os.path.basename(path)
    return names


def filter_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]], url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row; columns of these names
    are replaced.  A url that no rule fits, a null one among them, gets ``default``.
    Without rules every url does.  Rows that repeat are judged one by one."""
    names = ship(pages.sparkSession, list(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        array = DigestArray({part: SparkFiles.get(name) for part, name in names.items()})
        for urls in batches:
            yield array.judge(urls.where(urls.notna(), None), default)

    added = ("host", "path", "rule", "verdict")
    own = [c for c in pages.columns if c not in added]
    return pages.select(*own, judge(F.col(url_col)).alias("__judged")).select(*own, *(F.col("__judged")[c].alias(c) for c in added))


#: The contract's rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op6(pages: DataFrame) -> DataFrame:
    return filter_urls(pages.select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1) ELSE '' END,
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) ELSE '' END AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM u)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
