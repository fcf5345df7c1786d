"""Quality classifier: naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.llm.labelled import held_out, labelled_sample
from trekframe.llm.words import Memo, mix, small_batches

BITS = 18
_SHAPE_BITS = 16


def word_shape(word: str) -> str:
    """How a word is written: its kinds of characters in order, a run of one kind at most twice. Letters are ``A`` or
    ``a`` by case, digits are ``0``, other characters stand for themselves."""
    kinds = "".join("a" if c.islower() else "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUN.sub(r"\1\1", kinds)


_RUN = re.compile(r"(.)\1{2,}", re.DOTALL)
_LOW = np.uint64((1 << _SHAPE_BITS) - 1)


def _code(word: str) -> int:
    """Hash of a word's lower-case form, with that of its shape in the lowest bits."""
    h = xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
    return (h & ~int(_LOW)) | zlib.crc32(word_shape(word).encode("utf-8", "surrogatepass")) & int(_LOW)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))]


class TextNgrams:
    """Distinct hashed n-grams of a text: words and word pairs, runs of one to three word shapes, and
    of three distances to the same word before."""

    def __init__(self):
        self.codes = Memo(_code)

    def features(self, text: str | None) -> np.ndarray:
        """Sorted distinct feature numbers below ``N_FEATURES``."""
        words = (text or "").split()
        if not words:
            return np.empty(0, dtype=np.int32)
        codes = np.fromiter(map(self.codes.__getitem__, words), dtype=np.uint64, count=len(words))
        word = codes >> np.uint64(_SHAPE_BITS)
        edged = np.concatenate(([np.uint64(0)], (codes & _LOW) + np.uint64(1), [np.uint64(0)]))
        pair = edged[:-1] * _STEP + edged[1:]
        triple = pair[:-1] * _STEP + edged[2:]
        back = np.zeros(len(words) + 2, dtype=np.uint64)  # how far back the same word stands, if near
        for d in range(_NEAR, 0, -1):
            back[d : len(words)][word[d:] == word[:-d]] = d
        again = (back[:-2] * _STEP + back[1:-1]) * _STEP + back[2:]
        top, short, base = np.uint64(64 - BITS), np.uint64(64 - _SHAPE_BITS), np.int32(1 << BITS)
        parts = [(mix(w) >> top).astype(np.int32) for w in (word, word[:-1] * np.uint64(31) + word[1:] * _STEP)]
        parts += [base + (mix(s * _STEP + np.uint64(k)) >> short).astype(np.int32) for k, s in enumerate((edged[1:-1], pair, triple, again))]
        return distinct(np.concatenate(parts))


_STEP, _NEAR = np.uint64(0x100000001B3), 4
N_FEATURES = (1 << BITS) + (1 << _SHAPE_BITS)


@dataclass
class NbSvm:
    """``score = sigmoid(slope * margin + shift)``; ``weights`` hold the class log-count ratios already."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, features: np.ndarray) -> float:
        margin = float(self.weights[features].sum() / max(1.0, len(features)) ** 0.5 + self.bias)
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, n_features: int, alpha: float = 1.0) -> np.ndarray:
    """log((alpha + p) / |alpha + p|) - log((alpha + q) / |alpha + q|) of indicator counts p and q by class."""
    p = np.full(n_features, alpha)
    q = np.full(n_features, alpha)
    for idx, label in zip(rows, y):
        (p if label else q)[idx] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, n_features: int, c: float, epochs: int, seed: int = 7):
    """Linear hinge-loss model: coordinate steps on the dual, rows in a new order each epoch; a last bias feature of 1."""
    w, bias = np.zeros(n_features), 0.0
    sign = np.where(y > 0, 1.0, -1.0)
    alpha = np.zeros(len(rows))
    upper = np.where(y > 0, c * len(y) / max(1, 2 * (y > 0).sum()), c * len(y) / max(1, 2 * (y <= 0).sum()))
    norms = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            idx, v = rows[i], values[i]
            g = sign[i] * (w[idx] @ v + bias) - 1.0
            step = min(max(alpha[i] - g / norms[i], 0.0), upper[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[idx] += step * sign[i] * v
                bias += step * sign[i]
                worst = max(worst, abs(step))
        if worst < 1e-4:
            break
    return w, bias


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and shift of the sigmoid that fits the labels best, by Newton steps with smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        h = np.maximum(p * (1 - p), 1e-9)
        m = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, n_features: int = N_FEATURES, c: float = 1.0, epochs: int = 12, spare: int = 5) -> NbSvm:
    """Fits on all rows but every ``spare``-th, which set the sigmoid. One class alone gives a constant score."""
    y = np.asarray(y)
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else (y.sum() + 1) / (len(y) + 2)
        return NbSvm(np.zeros(n_features), 0.0, 1.0, float(np.log(share / (1 - share))))
    own = np.arange(len(y)) % spare != 0
    if len(set(y[own])) < 2 or len(set(y[~own])) < 2:
        own[:] = True
    keep = np.flatnonzero(own)
    train = [rows[i] for i in keep]
    r = log_count_ratios(train, y[keep], n_features)
    values = [r[idx] / max(1.0, len(idx)) ** 0.5 for idx in train]
    w, bias = dual_coordinate_descent(train, values, y[keep], n_features, c, epochs)
    model = NbSvm(w * r, bias, 1.0, 0.0)
    check = np.flatnonzero(~own) if (~own).any() else keep
    margin = np.array([model.weights[rows[i]].sum() / max(1.0, len(rows[i])) ** 0.5 + bias for i in check])
    model.slope, model.shift = platt(margin, y[check])
    return model


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 10_000, c: float = 1.0) -> NbSvm:
    """Learns from at most ``max_rows`` labelled documents outside the held-out third; their texts come to the driver."""
    got = labelled_sample(docs, labels, label, max_rows).select("doc_id", "text", "y").toArrow().sort_by("doc_id")
    ngrams = TextNgrams()
    rows = [ngrams.features(t) for t in got.column("text").to_pylist()]
    return fit(rows, got.column("y").to_numpy().astype(np.int64), c=c)


def score_quality(docs: DataFrame, model: NbSvm, column: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and the score in ``column`` (which replaces one of that name), from the whole text alone; a
    null text counts as empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.slope, model.shift))  # fixed size

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, ngrams = NbSvm(*shared.value), TextNgrams()
        for texts in batches:
            yield pa.array([own.score(ngrams.features(t)) for t in texts.to_pylist()], type=pa.float64())

    return docs.withColumn(column, score(F.col("text").cast("string")))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 10_000) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document.

    Null and empty texts get a score too; repeated rows and rows without an id are scored as they come, and a text of
    any length is scored whole. Other columns, whatever their names, are ignored. An empty table gives an empty result,
    and labels of one class only, or none, a constant score.
    """
    scored = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train_quality(docs, labels, max_rows=max_rows))
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted")
    )
