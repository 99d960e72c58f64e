"""The passages of the quality classifier and its attention against plain loops; the digest
array of the URL filter where digests collide."""

import math
import re

import numpy as np
import pytest

from quillstream.llm import quality, url_filter

TEXTS = [
    "", None, "  \n ", "one", "The QUICK brown fox; it's 12% | of *all*. Yes!\nNo?", "é école ÉCOLE 中文 中文 中文", " lead " + "word word other " * 90 + "end\n\n",
    "\t".join(f"w{i % 7}" for i in range(64)), " ".join(f"w{i % 7}" for i in range(65)),
]


def plain_features(text):
    """A row for each passage, byte by byte and word by word."""
    data = (text if isinstance(text, str) else "").encode() + b"\n"
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\v\f\r]+", data)]
    rows = []
    for p in range(0, max(1, len(words)), quality.PASSAGE_WORDS):
        mine = words[p : p + quality.PASSAGE_WORDS]
        begin = 0 if p == 0 else mine[0][0]
        end = words[p + quality.PASSAGE_WORDS][0] if p + quality.PASSAGE_WORDS < len(words) else len(data)
        counts = [0] * quality.N_CLASSES
        for byte in data[begin:end]:
            kind = next((i for i, chars in enumerate(quality._CLASSES) if chr(byte) in chars), len(quality._CLASSES)) if byte < 128 else len(quality._CLASSES) + 1
            counts[kind] += 1
        said = [data[a:b] for a, b in mine]
        before = [data[words[p - 1][0] : words[p - 1][1]] if p else None, *said[:-1]][: len(said)]
        upper, lower, n = counts[1], counts[0] + counts[-1], max(1, len(said))
        rows.append([math.sqrt(c / sum(counts)) for c in counts] + [
            sum(a == b for a, b in zip(said, before, strict=True)) / n, len(set(said)) / n, sum(map(len, said)) / n / 10, upper / max(upper + lower, 1), math.log1p(len(said)) / 4, 1,
        ])
    return rows


def test_features_of_whole_texts():
    want = [plain_features(t) for t in TEXTS]
    x, bags = quality.passage_features(TEXTS)
    assert bags.tolist() == [len(w) for w in want]
    assert np.allclose(x, np.concatenate(want))


def test_a_text_s_features_do_not_depend_on_its_neighbours():
    for part in ([0, 1, 2], [2, 3], [4, 2, 0, 6], [1], [7, 8, 2, 2]):
        x, _ = quality.passage_features([TEXTS[i] for i in part])
        assert np.allclose(x, np.concatenate([plain_features(TEXTS[i]) for i in part]))
    assert quality.passage_features([])[0].shape == (0, quality.N_FEATURES)


def plain_score(model, rows):
    """Encode, weigh by gated attention, sum up, classify: one document."""
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    p, codes, weights = model.p, [], []
    for r in rows:
        h = [math.tanh(sum((r[i] - model.mean[i]) / model.scale[i] * p["enc"][i][k] for i in range(len(r)))) for k in range(len(p["att"]))]
        e = 0.0
        for k in range(len(h)):
            tan, gate = (sum(h[i] * p[name][i][k] for i in range(len(h))) for name in ("tan", "gate"))
            e += math.tanh(tan) * sigmoid(gate) * p["att"][k]
        codes.append(h)
        weights.append(math.exp(e))
    z = [sum(w * h[k] for w, h in zip(weights, codes, strict=True)) / sum(weights) for k in range(len(p["att"]))]
    return sigmoid(sum(a * b for a, b in zip(z, p["out"], strict=True)) + p["bias"][0])


def test_scores_of_a_fitted_model():
    x, bags = quality.passage_features(TEXTS * 3)
    model = quality.AttentionModel(hidden=5).fit(x, bags, np.array([i % 2 for i in range(len(bags))], float), steps=20)
    x, bags = quality.passage_features(TEXTS)
    assert np.allclose(model._forward(x, bags)["y"], [plain_score(model, plain_features(t)) for t in TEXTS])


def test_gradients_point_downhill():
    x, bags = quality.passage_features(TEXTS)
    y = np.array([1, 0, 1, 0, 1, 1, 0, 1, 0], float)

    def loss(model):
        f = np.clip(model._forward(x, bags)["y"], 1e-9, 1 - 1e-9)
        return -np.mean(y * np.log(f) + (1 - y) * np.log(1 - f))

    few, many = (loss(quality.AttentionModel().fit(x, bags, y, steps=n)) for n in (1, 300))
    assert many < 0.5 * few


@pytest.mark.parametrize("values", [1, 2, 5])
def test_urls_with_colliding_digests(tmp_path, monkeypatch, values):
    """All that share a digest are told apart by their strings."""
    real = url_filter.xxhash.xxh64_intdigest
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: real(b) % values)
    rules = [("block" if i % 3 else "allow", f"h{i}.org", "/a/" if i % 2 else "/") for i in range(40)]
    files = {p.rsplit("-", 1)[1].removesuffix(".npy"): p for p in url_filter.write_rules(rules, str(tmp_path))}
    urls = [f"http://h{i}.org/a/x" for i in range(45)] + ["http://www.h3.org/b", None]
    got = url_filter.DigestArray(files).judge(urls, "allow")
    for i in range(45):
        want = f"h{i}.org" + ("/a/" if i % 2 else "/") if i < 40 else None
        assert got["rule"][i] == want and got["verdict"][i] == ("block" if i < 40 and i % 3 else "allow")
    assert got["rule"][45] is None and got["rule"][46] is None
