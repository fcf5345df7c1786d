"""Toxicity: a convolutional text classifier over hashed word embeddings."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.llm.labelled import held_out, labelled_sample
from trekframe.llm.quality import platt
from trekframe.llm.words import small_batches

BUCKETS = 1 << 18  # bucket 0 is the padding between texts
PREFIXES = (3, 4, 5)  # a word's embedding is the sum of those of the word and of its first letters
WIDTHS = (1, 2, 3)
_STRIP = ".,;:!?\"'()[]{}«»¿¡-*_#%$&|<>/\\=+~^`@"


def bucket(key: str) -> int:
    return 1 + zlib.crc32(key.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)


class Vocabulary(dict):
    """word -> number of its row; row 0 is padding.

    A row starts as the word's buckets: that of its lower-case letters, and those of its prefixes, whose lengths keep
    equal strings apart. ``per_word`` turns new rows of buckets into what is kept of them. The buckets of prefixes are
    remembered apart, as new words mostly begin like known ones.
    """

    def __init__(self, per_word=None, limit: int = 60_000):
        super().__init__()
        self.per_word, self.limit, self.prefixes, self.pending = per_word or (lambda b: b), limit, {}, []
        self.rows = self.per_word(np.zeros((1, 1 + len(PREFIXES)), dtype=np.int64))

    def __missing__(self, word: str) -> int:
        core = word.strip(_STRIP).lower() or word
        first = core[: PREFIXES[-1]]
        found = self.prefixes.get(first)
        if found is None:
            found = self.prefixes[first] = tuple(bucket(f"{n}{first[:n]}") for n in PREFIXES)
        self.pending.append((bucket(core), *found))
        row = self[word] = len(self) + 1
        return row

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """Row numbers of each text's words, good until the next call."""
        if len(self) > self.limit:
            self.clear()
            self.prefixes.clear()
            self.rows = self.rows[:1]
        out = []
        for t in texts:
            words = (t or "").split()
            out.append(np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words)))
        if self.pending:
            self.rows = np.concatenate([self.rows, self.per_word(np.array(self.pending, dtype=np.int64))])
            self.pending = []
        return out


def lay_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array with padding before and behind each, and where each begins; a window that begins in one
    text's part reaches no word of the next."""
    gap = np.zeros(max(WIDTHS) - 1, dtype=np.int64)
    parts, starts, at = [], [], 0
    for t in texts:
        starts.append(at)
        parts += [gap, t, gap]
        at += len(t) + 2 * len(gap)
    parts.append(np.zeros(max(WIDTHS), dtype=np.int64))
    return np.concatenate(parts), np.array(starts, dtype=np.int64)


@dataclass
class ConvModel:
    """Embedding, one bank of filters per width, max pooling, and a logistic layer; then a sigmoid for calibration."""

    embedding: np.ndarray  # (BUCKETS, dim)
    filters: list[np.ndarray]  # per width: (width, dim, n)
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def responses(self, buckets: np.ndarray) -> np.ndarray:
        """What each word (a row of buckets) adds to each filter at each place of a window, side by side."""
        vectors = self.embedding[buckets].sum(axis=1)
        vectors[buckets[:, 0] == 0] = 0
        return np.concatenate([vectors @ f[j] for f in self.filters for j in range(len(f))], axis=1).astype(np.float32)

    def logits(self, texts: list[np.ndarray], responses: np.ndarray) -> np.ndarray:
        """Of texts given as rows of ``responses``."""
        if not texts:
            return np.empty(0)
        ids, starts = lay_out(texts)
        n, at, pooled = len(ids) - max(WIDTHS), 0, []
        for f, bias in zip(self.filters, self.biases):
            act = 0
            for j in range(len(f)):
                act = act + responses[ids[j : n + j], at : at + len(bias)]
                at += len(bias)
            pooled.append(np.maximum(np.maximum.reduceat(act, starts, axis=0) + bias, 0))
        return np.concatenate(pooled, axis=1).astype(np.float64) @ self.out + self.out_bias

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -40, 40)))


def initial(dim: int, n_filters: int, seed: int) -> ConvModel:
    """A random model; nothing in it is set by the labels."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    embedding[0] = 0
    filters = [rng.normal(0, (2 / (w * dim)) ** 0.5, (w, dim, n_filters)).astype(np.float32) for w in WIDTHS]
    return ConvModel(embedding, filters, [np.zeros(n_filters, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, n_filters * len(WIDTHS)), -1.0)


def train(
    texts: list[np.ndarray], words: np.ndarray, y: np.ndarray, dim: int = 8, n_filters: int = 6, shown: int = 40_000, batch: int = 16, rate: float = 0.01,
    embedding_rate: float = 0.5, seed: int = 11,
) -> ConvModel:
    """Stochastic gradient steps (Adam on the small layers, Adagrad on embedding rows) through the pooled windows, from a
    random start. Few texts are gone through more often: about ``shown`` are shown in all, in 3 to 30 rounds."""
    y = np.asarray(y, dtype=np.float64)
    model = initial(dim, n_filters, seed)
    epochs = min(30, max(3, -(-shown // max(1, len(texts)))))
    rng = np.random.default_rng(seed)
    k = len(WIDTHS)
    small = [s.astype(np.float64) for s in (*model.filters, *model.biases, model.out, np.array([model.out_bias]))]
    m1, m2, step = [np.zeros_like(s) for s in small], [np.zeros_like(s) for s in small], 0
    seen = np.full(BUCKETS, 0.1)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            ids, starts = lay_out([texts[i] for i in own])
            distinct, ids = np.unique(ids, return_inverse=True)
            buckets = words[distinct]
            vectors = model.embedding[buckets].sum(axis=1)
            vectors[distinct == 0] = 0
            n = len(ids) - max(WIDTHS)
            lengths = np.diff(np.append(starts, n))
            pooled, places = [], []
            for w, f, b in zip(WIDTHS, small[:k], small[k : 2 * k]):
                act = sum((vectors @ f[j].astype(np.float32))[ids[j : n + j]] for j in range(w))
                best = np.maximum.reduceat(act, starts, axis=0)
                place = np.where(act == np.repeat(best, lengths, axis=0), np.arange(n)[:, None], n)
                places.append(np.minimum.reduceat(place, starts, axis=0))
                pooled.append(np.maximum(best + b, 0))
            z = np.concatenate(pooled, axis=1)
            p = 1 / (1 + np.exp(-np.clip(z @ small[-2] + small[-1][0], -30, 30)))
            err = (p - y[own]) / len(own)
            grads = [np.zeros_like(s) for s in small]
            grads[-2], grads[-1] = z.T @ err, np.array([err.sum()])
            dz = (err[:, None] * small[-2]) * (z > 0)
            at, moves = [], []
            for i, w in enumerate(WIDTHS):
                d = dz[:, i * n_filters : (i + 1) * n_filters]
                grads[k + i] = d.sum(axis=0)
                for j in range(w):
                    rows = ids[places[i] + j]  # (texts, filters)
                    grads[i][j] = np.einsum("tfd,tf->df", vectors[rows], d)
                    move = (d[:, :, None] * small[i][j].T[None]).reshape(-1, dim)
                    at.append(buckets[rows.ravel()].ravel())
                    moves.append(np.repeat(move, buckets.shape[1], axis=0))
            step += 1
            for s, g, a, v in zip(small, grads, m1, m2):
                a += 0.1 * (g - a)
                v += 0.001 * (g * g - v)
                s -= rate * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            met, inverse = np.unique(np.concatenate(at), return_inverse=True)
            g = np.zeros((len(met), dim))
            np.add.at(g, inverse, np.concatenate(moves))
            g[met == 0] = 0
            seen[met] += (g * g).sum(axis=1) * len(own)
            model.embedding[met] -= (embedding_rate * g / np.sqrt(seen[met])[:, None]).astype(np.float32)
    model.filters = [s.astype(np.float32) for s in small[:k]]
    model.biases = [s.astype(np.float32) for s in small[k : 2 * k]]
    model.out, model.out_bias = small[-2], float(small[-1][0])
    return model


def language_thresholds(scores: np.ndarray, y: np.ndarray, langs: list, default: float = 0.7, least: int = 30) -> dict[str, float]:
    """For each language, the threshold with the best F1 among its calibration rows; few rows keep the default."""
    out = {}
    langs = np.array([x or "" for x in langs])
    for lang in sorted(set(langs)):
        own = langs == lang
        s, t = scores[own], y[own] > 0
        if t.sum() < least or (~t).sum() < least:
            out[lang] = default
            continue
        order = np.argsort(-s, kind="stable")
        hits = np.cumsum(t[order])
        f1 = 2 * hits / (np.arange(1, len(s) + 1) + t.sum())
        cut = len(f1) - 1 - int(np.argmax(f1[::-1]))
        below = s[order][cut + 1] if cut + 1 < len(s) else 0.0
        out[lang] = float((s[order][cut] + below) / 2)
    return out


def fit(texts: list[str | None], y: np.ndarray, langs: list, spare: int = 5, **options) -> ConvModel:
    """Trains on all texts but every ``spare``-th; those set the sigmoid and the thresholds by language."""
    y = np.asarray(y)
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else (y.sum() + 1) / (len(y) + 2)
        model = initial(8, 6, 0)
        model.out[:], model.out_bias = 0, float(np.log(share / (1 - share)))
        return model
    own = np.arange(len(y)) % spare != 0
    if len(set(y[own])) < 2 or len(set(y[~own])) < 2:
        own[:] = True
    vocabulary = Vocabulary(limit=1 << 62)
    rows = vocabulary.of(texts)
    keep = np.flatnonzero(own)
    model = train([rows[i] for i in keep], vocabulary.rows, y[keep], **options)
    check = np.flatnonzero(~own) if (~own).any() else keep
    logits = logits_of([texts[i] for i in check], model, Vocabulary(model.responses))
    model.slope, model.shift = platt(logits, y[check])
    model.thresholds = language_thresholds(model.calibrated(logits), y[check], [langs[i] for i in check])
    return model


def logits_of(texts: list[str | None], model: ConvModel, vocabulary: Vocabulary, most: int = 1_000_000) -> np.ndarray:
    """Texts are taken in parts of about ``most`` characters; each is scored whole."""
    out, part, size = [], [], 0
    for k, t in enumerate(texts):
        part.append(t)
        size += len(t or "")
        if size >= most or k == len(texts) - 1:
            rows = vocabulary.of(part)
            out.append(model.logits(rows, vocabulary.rows))
            part, size = [], 0
    return np.concatenate(out) if out else np.empty(0)


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 10_000, **options) -> ConvModel:
    """Learns from at most ``max_rows`` labelled documents outside the held-out third; their texts come to the driver."""
    got = labelled_sample(docs, labels, label, max_rows).select("doc_id", "text", "lang", "y").toArrow().sort_by("doc_id")
    return fit(got.column("text").to_pylist(), got.column("y").to_numpy().astype(np.int64), got.column("lang").to_pylist(), **options)


def score_toxicity(docs: DataFrame, model: ConvModel, column: str = "toxicity_score") -> DataFrame:
    """All columns of ``docs`` and the score in ``column`` (which replaces one of that name), from the whole text alone; a
    null text counts as empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        vocabulary = Vocabulary(own.responses)
        for texts in batches:
            yield pa.array(own.calibrated(logits_of(texts.to_pylist(), own, vocabulary)), type=pa.float64())

    return docs.withColumn(column, score(F.col("text").cast("string")))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 10_000) -> DataFrame:
    """``(doc_id, held_out, score, predicted, flagged)`` of every document.

    Null and empty texts get a score too; repeated rows and rows without an id are scored as they come, and a text of
    any length is scored whole. Other columns, whatever their names, are ignored. An empty table gives an empty result,
    and labels of one class only, or none, a constant score.

    ``predicted`` uses the one threshold; ``flagged`` uses the threshold calibrated for the row's language, where the
    language is known. The score itself sees nothing but the text.
    """
    model = train_toxicity(docs, labels, max_rows=max_rows)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    scored = score_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang")), model)
    own = F.lit(threshold)
    for name, value in sorted(model.thresholds.items()):
        own = F.when(F.coalesce("lang", F.lit("")) == name, F.lit(value)).otherwise(own)
    score = F.col("toxicity_score")
    return scored.select(
        "doc_id", held_out().alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), (score >= own).cast("int").alias("flagged")
    )
