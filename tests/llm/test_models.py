"""The classifiers against slow forms of the same."""

import random
import zlib

import numpy as np
import xxhash

from trekframe.llm import quality, toxicity
from trekframe.llm.words import mix


def plain_features(text):
    """Features of one text, counted one by one."""
    words, out = text.split(), set()
    m = lambda x: int(mix(np.array([x % (1 << 64)], dtype=np.uint64))[0])
    code = lambda w: xxhash.xxh64_intdigest(w.lower().encode()) >> 16
    shape = lambda w: (zlib.crc32(quality.word_shape(w).encode()) & 0xFFFF) + 1
    step, base = 0x100000001B3, 1 << 18
    w, s = [code(x) for x in words], [0, *(shape(x) for x in words), 0]
    add = lambda k, x: out.add(base + (m(x * step + k) >> 48))
    back = [0] * (len(words) + 2)
    for i in range(len(words)):
        near = [d for d in range(1, 5) if i >= d and w[i - d] == w[i]]
        back[i] = near[0] if near else 0
    for i in range(len(words)):
        out.add(m(w[i]) >> 46)
        if i + 1 < len(words):
            out.add(m(w[i] * 31 + w[i + 1] * step) >> 46)
        add(0, s[i + 1])
        add(2, (s[i] * step + s[i + 1]) * step + s[i + 2])
        add(3, (back[i] * step + back[i + 1]) * step + back[i + 2])
    for i in range(len(s) - 1):
        add(1, s[i] * step + s[i + 1])
    return sorted(out)


def test_features_one_by_one():
    ngrams = quality.TextNgrams()
    rng = random.Random(2)
    texts = ["One", "One TWO two two!!", "a b a b a b c", "Été 3.5% (x) x x x x x"] + [" ".join(rng.choice("aa Bb c3 dd! Ée".split()) for _ in range(30)) for _ in range(20)]
    for t in texts:
        assert ngrams.features(t).tolist() == plain_features(t)
    assert len(ngrams.features(None)) == len(ngrams.features("  ")) == 0
    assert [quality.word_shape(w) for w in ("Hello,", "HELLO!!!", "a", "x-1.25", "中文")] == ["Aaa,", "AA!!", "a", "a-0.00", "aa"]


def test_dual_descent_closes_the_gap():
    rng = np.random.default_rng(3)
    n, m = 200, 60
    rows = [np.sort(rng.choice(m, 12, replace=False)) for _ in range(n)]
    y = np.array([int((r < 20).sum() > 4) for r in rows])
    values = [rng.normal(1, 0.3, 12) for _ in rows]
    w, bias = quality.dual_coordinate_descent(rows, values, y, m, 0.5, 400)
    sign = np.where(y > 0, 1.0, -1.0)
    upper = np.where(y > 0, 0.5 * n / (2 * (y > 0).sum()), 0.5 * n / (2 * (y <= 0).sum()))
    margins = sign * np.array([w[r] @ v + bias for r, v in zip(rows, values)])
    primal = 0.5 * (w @ w + bias * bias) + (upper * np.maximum(0, 1 - margins)).sum()
    # a dual point from the same solution: w = sum alpha y x, found by least squares within the box
    x = np.zeros((n, m + 1))
    for i, (r, v) in enumerate(zip(rows, values)):
        x[i, r], x[i, m] = v, 1.0
    alpha = np.where(margins < 1 - 1e-6, upper, 0.0)
    edge = np.abs(margins - 1) <= 1e-3
    target = np.append(w, bias) - (alpha * ~edge * sign) @ x
    alpha[edge] = np.clip(np.linalg.lstsq((sign[edge, None] * x[edge]).T, target, rcond=None)[0], 0, upper[edge])
    combined = (alpha * sign) @ x
    dual = alpha.sum() - 0.5 * combined @ combined
    assert abs(primal - dual) <= 0.02 * primal


def test_log_count_ratios_by_hand():
    r = quality.log_count_ratios([np.array([0, 1]), np.array([1])], np.array([1, 0]), 3)
    p, q = np.array([2.0, 2.0, 1.0]), np.array([1.0, 2.0, 1.0])
    assert np.allclose(r, np.log(p / p.sum()) - np.log(q / q.sum()))


def slow_logit(model, text):
    """Forward pass of one text, window by window."""
    vectors = []
    for word in text.split():
        core = word.strip(toxicity._STRIP).lower() or word
        first = core[: toxicity.PREFIXES[-1]]
        own = [toxicity.bucket(core), *(toxicity.bucket(f"{n}{first[:n]}") for n in toxicity.PREFIXES)]
        vectors.append(model.embedding[own].sum(axis=0))
    zero, z = np.zeros(model.embedding.shape[1]), []
    for f, b in zip(model.filters, model.biases):
        gap = [zero] * (max(toxicity.WIDTHS) - 1)
        padded = [*gap, *vectors, *gap]
        best = np.full(len(b), -np.inf)
        for i in range(len(padded)):
            window = [padded[i + j] if i + j < len(padded) else zero for j in range(len(f))]
            best = np.maximum(best, sum(window[j] @ f[j] for j in range(len(f))))
        z.append(np.maximum(best + b, 0))
    return float(np.concatenate(z) @ model.out + model.out_bias)


def test_forward_pass_window_by_window():
    model = toxicity.initial(8, 6, 5)
    texts = ["", "one", "A longer text, with punctuation!!", "repeat repeat repeat", "x " * 50]
    got = toxicity.logits_of(texts, model, toxicity.Vocabulary(model.responses), most=20)
    assert np.allclose(got, [slow_logit(model, t) for t in texts], atol=1e-4)


def test_the_start_sees_no_labels_and_learns():
    """Nothing in the start depends on labels, and it tells texts apart only after training."""
    rng = random.Random(5)
    words = [f"q{i}z" for i in range(400)]
    texts, y = [], []
    for i in range(800):
        own = [rng.choice(words) for _ in range(rng.randint(5, 40))]
        if i % 4 == 0:
            own[rng.randrange(len(own))] = rng.choice(["badword", "worseword", "vileword"])
        texts.append(" ".join(own))
        y.append(int(i % 4 == 0))
    y = np.array(y)
    model = toxicity.fit(texts[:600], y[:600], ["en"] * 600)
    score = lambda m: m.calibrated(toxicity.logits_of(texts[600:], m, toxicity.Vocabulary(m.responses)))
    assert ((score(model) >= 0.7) == (y[600:] > 0)).mean() >= 0.97
    start = score(toxicity.initial(8, 6, 11))
    order = np.argsort(-start)
    assert y[600:][order[:50]].mean() < 0.6
