"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words, the whole text in all.  Every
passage is encoded by a small network from counts of its bytes and words; gated attention
weighs the passages, and the weighted sum of their codes gives the score.  Only labels of
documents are known, so the weights are learned from them.

The network is fitted in numpy on a bounded sample of labelled rows; every document is
scored inside Spark tasks, one Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE_WORDS = 64

#: Classes of bytes; a byte of 128 and more is part of another letter or sign.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\v\f\r", "\n", ".", ",;:", "!?", "|", "*_~^", "%$#&@", "\"'", "()[]{}<>", "/\\=+-"]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
_CLASS[128:] = len(_CLASSES) + 1
for _n, _chars in enumerate(_CLASSES):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _n
N_CLASSES = len(_CLASSES) + 2
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MIX = np.random.default_rng(11).integers(1, 1 << 62, 256, dtype=np.int64)
N_FEATURES = N_CLASSES + 6


def passage_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features by passage, number of passages by text); a text without words is one
    passage.  All texts are handled as one array of bytes, each as if it were alone."""
    if not len(texts):
        return np.zeros((0, N_FEATURES)), np.zeros(0, np.int64)
    raw = [(t if isinstance(t, str) else "").encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)  # a line end closes each text
    doc_start = np.cumsum(sizes) - sizes
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    first = np.searchsorted(starts, doc_start)  # of each text's words
    words = np.diff(np.r_[first, len(starts)])
    bags = np.maximum(1, -(-words // PASSAGE_WORDS))
    bag_start = np.cumsum(bags) - bags
    x = np.zeros((int(bags.sum()), N_FEATURES))
    doc_of = np.repeat(np.arange(len(raw)), words)
    passage = bag_start[doc_of] + (np.arange(len(starts)) - first[doc_of]) // PASSAGE_WORDS
    # A byte counts with the last word of its own text that begins at or before it; those
    # before a text's first word, or of one without words, with its first passage.
    last = np.repeat(np.arange(-1, len(starts)), np.diff(np.r_[0, starts, len(data)]))
    of_text = np.repeat(np.arange(len(raw)), sizes)
    inside = last >= first[of_text]
    of_byte = bag_start[of_text]
    of_byte[inside] = passage[last[inside]]
    counts = np.bincount(of_byte * N_CLASSES + _CLASS[data], minlength=len(x) * N_CLASSES).reshape(len(x), N_CLASSES)
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    length = ends - starts
    total = np.cumsum(np.r_[0, np.where(space, 0, _MIX[data])])  # wraps alike everywhere
    code = (total[ends] - total[starts]) ^ (length << 48)
    again = np.r_[False, (code[1:] == code[:-1]) & (doc_of[1:] == doc_of[:-1])][: len(code)]
    n = np.bincount(passage, minlength=len(x))
    order = np.lexsort((code, passage))
    new = np.r_[True, (np.diff(code[order]) != 0) | (np.diff(passage[order]) != 0)][: len(code)]
    distinct = np.bincount(passage[order[new]], minlength=len(x))
    upper, lower = counts[:, 1], counts[:, 0] + counts[:, N_CLASSES - 1]
    some = np.maximum(n, 1)
    x[:, :N_CLASSES] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    x[:, N_CLASSES] = np.bincount(passage, again, len(x)) / some
    x[:, N_CLASSES + 1] = distinct / some
    x[:, N_CLASSES + 2] = np.bincount(passage, length, len(x)) / some / 10
    x[:, N_CLASSES + 3] = upper / np.maximum(upper + lower, 1)
    x[:, N_CLASSES + 4] = np.log1p(n) / 4
    x[:, N_CLASSES + 5] = 1
    return x, bags


def slices(texts: list[str | None], limit: int = 1 << 20) -> Iterator[list[str | None]]:
    """The texts in runs of about ``limit`` characters, so that the arrays made of them stay
    small whatever a batch holds."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t) if isinstance(t, str) else 0
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


class AttentionModel:
    """Encoder, gated attention and classifier, with plain gradients."""

    def __init__(self, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        make = lambda *shape: rng.normal(0, 0.3, shape)
        self.p = {"enc": make(N_FEATURES, hidden), "tan": make(hidden, hidden), "gate": make(hidden, hidden), "att": make(hidden), "out": make(hidden), "bias": np.zeros(1)}
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)

    def _forward(self, x: np.ndarray, bags: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(((x - self.mean) / self.scale) @ p["enc"])
        tan, gate = np.tanh(h @ p["tan"]), 1 / (1 + np.exp(-h @ p["gate"]))
        e = (tan * gate) @ p["att"]
        start = np.cumsum(bags) - bags
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), bags))
        a = e / np.repeat(np.add.reduceat(e, start), bags)
        z = np.add.reduceat(a[:, None] * h, start)
        y = 1 / (1 + np.exp(-np.clip(z @ p["out"] + p["bias"][0], -30, 30)))
        return {"h": h, "tan": tan, "gate": gate, "a": a, "z": z, "y": y}

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.03, decay: float = 1e-4) -> AttentionModel:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        p, n = self.p, max(1, len(y))
        xs = (x - self.mean) / self.scale
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            f = self._forward(x, bags)
            err = (f["y"] - y) / n
            dz = err[:, None] * p["out"]
            da = (np.repeat(dz, bags, 0) * f["h"]).sum(1)
            inner = np.add.reduceat(f["a"] * da, np.cumsum(bags) - bags)
            de = f["a"] * (da - np.repeat(inner, bags))
            d_tan = de[:, None] * p["att"] * f["gate"] * (1 - f["tan"] ** 2)
            d_gate = de[:, None] * p["att"] * f["tan"] * f["gate"] * (1 - f["gate"])
            dh = f["a"][:, None] * np.repeat(dz, bags, 0) + d_tan @ p["tan"].T + d_gate @ p["gate"].T
            g = {
                "enc": xs.T @ (dh * (1 - f["h"] ** 2)), "tan": f["h"].T @ d_tan, "gate": f["h"].T @ d_gate,
                "att": (f["tan"] * f["gate"]).T @ de, "out": f["z"].T @ err, "bias": np.array([err.sum()]),
            }
            for k in p:  # Adam
                g[k] = g[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self._forward(*passage_features(part))["y"] for part in slices(texts))])


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str, label_col: str, max_docs: int) -> AttentionModel:
    """Fit on at most ``max_docs`` labelled documents, those with the smallest hash of
    their id.  Of an id labelled twice the larger label counts.  Without labelled rows,
    or with one class alone, the model says that class (1 without any)."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & usable).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    sample = one.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(max_docs)
    found = docs.select(id_col, text_col).join(F.broadcast(sample), id_col).select(text_col, "__label")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes, parts = [], []
            for part in slices(list(b[text_col])):
                x, bags = passage_features(part)
                sizes += bags.tolist()
                parts += np.split(x.astype(np.float32), np.cumsum(bags)[:-1])
            yield pd.DataFrame({"label": b["__label"].astype("int64"), "n": sizes, "x": [p.tobytes() for p in parts]}, columns=["label", "n", "x"])

    rows = found.mapInPandas(features, "label long, n long, x binary").toPandas()
    model = AttentionModel()
    classes = set(rows["label"])
    if len(classes) < 2:
        model.p = {k: np.zeros_like(a) for k, a in model.p.items()}
        model.p["bias"][0] = -20.0 if classes == {0} else 20.0
        return model
    rows = rows.sort_values(["label", "n", "x"])  # the same order in every run
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, N_FEATURES).astype(float)
    return model.fit(x, rows["n"].to_numpy(), rows["label"].to_numpy().astype(float))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_docs: int = 4000,
    score_col: str = "score",
    train_docs: DataFrame | None = None,
) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) to every row; the model sees the
    text alone.

    ``usable`` says, over ``labels``, which labelled rows may be learned from; texts of
    ``train_docs`` (``docs`` by default) are joined to them.  A null text counts as empty
    and is scored like one.  Rows that repeat get the same score.
    """
    model = fit_quality(docs if train_docs is None else train_docs, labels, usable, id_col, text_col, label_col, max_docs)
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(known.value.score(list(t)))

    return docs.withColumn(score_col, score(F.col(text_col)))


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    scored = score_quality(docs.select("doc_id", "text"), labels, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
