"""Language identification by hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trekframe.llm.words import small_batches

UNKNOWN = "und"
_EDGE, _BITS = 32, 18  # all letters of Unicode lie below 2^18
_PIECE = 1 << 20  # letters of a text looked at at once
_KEPT = 1 << 20  # different trigrams that a task holds before it adds them up

Counts = tuple[np.ndarray, np.ndarray]


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(1 << _BITS)), dtype=bool, count=1 << _BITS)


def summed(parts: list[Counts]) -> Counts:
    """One count for each key of several counts; keys in order."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts


class Bundles:
    """Hypervectors of texts. Every letter has a random vector of -1 and 1; a trigram is the product of its letters' vectors,
    each permuted (rotated) once for every letter that follows; a text is the sum of the trigrams of its lower-case
    letter runs, each run standing between two edges.

    Trigrams are counted first, and the counts multiplied with the trigrams' vectors, of which at most ``limit`` are kept.
    """

    def __init__(self, size: int = 1024, limit: int = 40_000):
        self.size, self.limit, self.is_letter = size, limit, _letters()
        self.letters: dict[int, np.ndarray] = {}
        self.known, self.row = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.table = np.empty((0, size), dtype=np.int8)

    def letter(self, code: int) -> np.ndarray:
        """A letter's vector, the same in every process, rotated twice, once and not at all."""
        got = self.letters.get(code)
        if got is None:
            bits = np.random.Generator(np.random.Philox(key=code + 1)).integers(0, 2, self.size, dtype=np.int8) * np.int8(2) - np.int8(1)
            if len(self.letters) >= 8192:
                self.letters.clear()
            got = self.letters[code] = np.stack([np.roll(bits, 2), np.roll(bits, 1), bits])
        return got

    def trigram(self, key: int) -> np.ndarray:
        mask = (1 << _BITS) - 1
        return self.letter(key >> 2 * _BITS)[0] * self.letter((key >> _BITS) & mask)[1] * self.letter(key & mask)[2]

    def counts(self, text: str) -> Counts:
        """The text's different trigrams, each as one number, and how often they stand there."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        parts = []
        for a in range(0, len(codes), _PIECE):
            part = codes[max(0, a - 1) : a + _PIECE + 1]
            letter = self.is_letter[np.minimum(part, (1 << _BITS) - 1)] & (part < 1 << _BITS)
            part = np.where(letter, part, _EDGE)
            ends = (int(a == 0), int(a + _PIECE >= len(codes)))
            part, letter = np.pad(part, ends, constant_values=_EDGE), np.pad(letter, ends)
            keys = np.sort((part[:-2] << 2 * _BITS | part[1:-1] << _BITS | part[2:])[letter[1:-1]])
            starts = np.flatnonzero(np.diff(keys, prepend=-1))
            parts.append((keys[starts], np.diff(starts, append=len(keys))))
        return parts[0] if len(parts) == 1 else summed(parts) if parts else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of different trigrams, at most ``limit`` of them."""
        at = np.searchsorted(self.known, keys)
        new = keys[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != keys)] if len(self.known) else keys
        if len(new):
            if len(self.known) + len(new) > self.limit:
                self.known, self.row, self.table, new = self.known[:0], self.row[:0], self.table[:0], keys
            rows = np.arange(len(self.table), len(self.table) + len(new))
            self.table = np.concatenate([self.table, np.stack([self.trigram(int(k)) for k in new])])
            order = np.argsort(both := np.concatenate([self.known, new]))
            self.known, self.row = both[order], np.concatenate([self.row, rows])[order]
            at = np.searchsorted(self.known, keys)
        return self.table[self.row[at]]

    def of_counts(self, counts: list[Counts]) -> np.ndarray:
        """A row for each of several counts: the sum of the trigrams' vectors, in whole numbers."""
        used, at = np.unique(np.concatenate([k for k, _ in counts]), return_inverse=True)
        text = np.repeat(np.arange(len(counts)), [len(k) for k, _ in counts])
        table = np.zeros((len(counts), len(used)))
        table[text, at] = np.concatenate([c for _, c in counts])
        kind = np.float32 if table.sum(axis=1).max(initial=0) < 1 << 24 else np.float64  # whole numbers stay exact
        out = np.zeros((len(counts), self.size))
        for a in range(0, len(used), 4096):
            out += table[:, a : a + 4096].astype(kind) @ self.vectors(used[a : a + 4096]).astype(kind)
        return out

    def of_texts(self, texts: list[str | None], at_once: int = 64) -> Iterator[np.ndarray | None]:
        """The bundle of each whole text; None for one without a letter."""
        for a in range(0, len(texts), at_once):
            counts = [self.counts(t or "") for t in texts[a : a + at_once]]
            for (keys, _), bundle in zip(counts, self.of_counts(counts)):
                yield bundle if len(keys) else None


@dataclass
class Profiles:
    """Unit prototypes by language, languages in order."""

    languages: list[str]
    units: np.ndarray

    def closest(self, bundle: np.ndarray) -> tuple[str, float]:
        """The language of the largest cosine (ties: the first), and that cosine, from 0 to 1."""
        length = float(np.sqrt(bundle @ bundle))
        cosines = self.units @ bundle / (length or 1.0)
        k = int(cosines.argmax())
        return self.languages[k], min(1.0, max(0.0, float(cosines[k])))


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document belongs to the quarter of ids that no profile may learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def learn_profiles(docs: DataFrame, size: int = 1024, max_languages: int = 8192) -> Profiles:
    """Prototypes from all documents with a language outside the held-out quarter; rows without an id are not learned from.

    A prototype is the sum of its documents' bundles. Tasks add up their rows by language, so what is shuffled is at
    most ``size`` numbers for each language and task, whatever share of the rows a language has; what comes to the driver
    is one vector a language. At most ``max_languages`` values of ``lang``, the most frequent, are languages: there
    are fewer than that on Earth.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col("doc_id").isNotNull() & ~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    langs = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).select("lang")
    known = known.join(F.broadcast(langs), "lang", "left_semi")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundles, counts, met, totals = Bundles(size), defaultdict(list), 0, defaultdict(lambda: np.zeros(size))

        def spill(least: int) -> int:
            for lang, parts in counts.items():
                counts[lang] = parts = [summed(parts)]
                if len(parts[0][0]) > least:
                    totals[lang] += bundles.of_counts(parts)[0]
                    counts[lang] = []
            return sum(len(k) for parts in counts.values() for k, _ in parts)

        for batch in batches:
            for lang, text in zip(*[c.to_pylist() for c in batch.columns]):
                counts[lang].append(bundles.counts(text))
                met += len(counts[lang][-1][0])
                if met > _KEPT:
                    met = spill(_KEPT // 2)
                    met = spill(0) if met > _KEPT // 2 else met
        spill(0)
        for lang, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array(range(size), pa.int32()), pa.array(total.astype(np.int64), pa.int64())], ["lang", "slot", "total"])

    got = known.select("lang", "text").mapInArrow(sums, "lang string, slot int, total long").groupBy("lang", "slot").agg(F.sum("total").alias("total")).toArrow()
    names, slots, values = got.column("lang").to_pylist(), got.column("slot").to_numpy(), got.column("total").to_numpy()
    table: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(size))
    for name, slot, value in zip(names, slots, values):
        table[name][slot] = value
    table = {k: v for k, v in table.items() if v.any()}
    languages = sorted(table)
    units = np.array([table[k] / np.sqrt(table[k] @ table[k]) for k in languages]).reshape(-1, size)
    return Profiles(languages, units)


def identify(docs: DataFrame, profiles: Profiles, lang: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """All columns of ``docs``, the language of each whole text in ``lang`` and its cosine, 0 to 1, in ``score`` (columns of
    those names are replaced). A text that is null or without a letter is ``und`` with score 0, as is any if nothing was learned."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # one vector a language

    @F.arrow_udf("struct<lang:string,score:double>")
    def closest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        bundles = Bundles(own.units.shape[1])
        for texts in batches:
            found = [(UNKNOWN, 0.0) if b is None or not own.languages else own.closest(b) for b in bundles.of_texts(texts.to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    met = "_".join(["met", *docs.columns])  # a name that no column has
    return docs.withColumn(met, closest(F.col("text").cast("string"))).withColumns({lang: F.col(f"{met}.lang"), score: F.col(f"{met}.score")}).drop(met)


def predict_languages(docs: DataFrame, size: int = 1024) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document.

    Whole texts count, of any length; upper and lower case are one. A text without a letter, an empty or a null one is
    ``und``. Repeated rows are predicted (and learned from) each; rows without an id are predicted. Ties go to the
    first language in order. Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    met = identify(own, learn_profiles(own, size))
    return met.select("doc_id", is_held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
