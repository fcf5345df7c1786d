"""Benchmark decontamination: item-sized word windows, CGK embedding, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.llm.words import WordHashes, mix, small_batches
from trekframe.storage import materialize

VOCABULARY_BITS = 20  # fixed size of the broadcast tables of benchmark words
SAMPLED = 2  # sampled places of a repetition
_ODD = np.uint64(0x100000001B3)


def length_class(n: int) -> int:
    """The window length for items of ``n`` words: ``n`` itself up to 20, then at most a twentieth less."""
    if n <= 20:
        return n
    size = 20
    while (step := max(size + 1, math.floor(size * 1.05))) <= n:
        size = step
    return size


def max_edits(n: int, share: float) -> int:
    return math.floor(share * n + 1e-9)


def _random(*parts: int) -> int:
    h = np.zeros(1, dtype=np.uint64)
    for p in parts:
        h = mix(h * _ODD + np.uint64(p + 1))
    return int(h[0])


def sampled_places(size: int, repeat: int) -> list[int]:
    """The places of the walk that one repetition looks at, out of the ``2 * size`` steps."""
    return sorted(_random(size, repeat, k, 77) % (2 * size) for k in range(SAMPLED))


def walk_keys(words: np.ndarray, starts: np.ndarray, size: int, repeat: int) -> np.ndarray:
    """Keys of the windows of ``size`` words at ``starts``.

    The walk writes the current word at each step and moves on if a random bit of that word and step is set, so that
    two windows with few edits write the same words at most steps. The key hashes what it writes at the sampled places.
    """
    at = np.zeros(len(starts), dtype=np.int64)
    places = sampled_places(size, repeat)
    key = np.full(len(starts), np.uint64(_random(size, repeat)), dtype=np.uint64)
    for step in range(places[-1] + 1):
        now = np.where(at < size, words[np.minimum(starts + at, len(words) - 1)], np.uint64(0))
        for _ in range(places.count(step)):
            key = mix(key * _ODD + now)
        at += (mix(now * _ODD + np.uint64(_random(repeat, step, 5))) >> np.uint64(63)).astype(np.int64)
    return key.view(np.int64)


def edited_windows(size: int, edits: int, trials: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``trials`` windows of ``size`` random words, one after the other, and the same with ``edits`` random edits each."""
    rng = np.random.default_rng(seed)
    plain, edited = [], []
    for _ in range(trials):
        x = rng.integers(1, 1 << 62, size, dtype=np.uint64).tolist()
        y = list(x)
        for _ in range(edits):
            kind, p = rng.integers(0, 3), int(rng.integers(0, len(y)))
            if kind == 0 or len(y) < 2:
                y[p] = int(rng.integers(1, 1 << 62))
            elif kind == 1:
                y.insert(p, int(rng.integers(1, 1 << 62)))
            else:
                y.pop(p)
        plain += x
        edited += (y + [int(v) for v in rng.integers(1, 1 << 62, size)])[:size]
    return np.array(plain, dtype=np.uint64), np.array(edited, dtype=np.uint64)


def repeats_for(size: int, share: float, recall: float, trials: int = 1200, most: int = 4096, longest: int | None = None) -> int:
    """Repetitions after which ``recall`` of simulated windows met their item, with as many random edits as an item of
    ``longest`` words, the longest of the class, may have. Two independent sets of trials must both get there, so that
    a lucky one does not stop too early. Raises an error if ``most`` repetitions are not enough."""
    edits = max_edits(longest or size, share)
    starts = np.arange(trials, dtype=np.int64) * size
    sets = [(*edited_windows(size, edits, trials, seed), np.zeros(trials, dtype=bool)) for seed in (size, size + (1 << 20))]
    for repeat in range(most):
        for a, b, met in sets:
            met |= walk_keys(a, starts, size, repeat) == walk_keys(b, starts, size, repeat)
        if all(met.mean() >= recall for _, _, met in sets):
            return repeat + 1
    raise ValueError(f"no {most} repetitions reach a recall of {recall} for {size} words with a share of {share} edited")


def edit_match(item: list, segment: list) -> tuple[int, int, int]:
    """``(distance, first, last)`` of the part of ``segment`` nearest to ``item`` in word edits; the earliest end wins."""

    def ends(x: list, y: list) -> np.ndarray:
        codes: dict = {}
        u = np.array([codes.setdefault(w, len(codes)) for w in x])
        v = np.array([codes.setdefault(w, len(codes)) for w in y])
        index = np.arange(len(v) + 1)
        row = np.zeros(len(v) + 1, dtype=np.int64)
        for k, w in enumerate(u):
            step = np.minimum(np.concatenate(([k + 1], row[:-1] + (v != w))), row + 1)
            row = np.minimum.accumulate(step - index) + index
        return row

    row = ends(item, segment)
    last = int(np.argmin(row))
    back = ends(item[::-1], segment[:last][::-1])
    best = int(row[last])
    lengths = np.flatnonzero(back == best)
    return best, last - int(lengths[0] if len(lengths) else 0), last - 1


def window_starts(places: np.ndarray, n: int, size: int, least: int) -> np.ndarray:
    """Starts of windows of ``size`` among ``n`` words that hold at least ``least`` of the sorted ``places``."""
    if n < size:
        return np.empty(0, dtype=np.int64)
    if least <= 0:
        return np.arange(n - size + 1)
    if len(places) < least:
        return np.empty(0, dtype=np.int64)
    lo = np.maximum(places[least - 1 :] - size + 1, 0)
    hi = np.minimum(places[: len(places) - least + 1], n - size)
    lo, hi = lo[lo <= hi], hi[lo <= hi]
    if not len(lo):
        return lo
    lo = np.maximum(lo, np.concatenate(([0], np.maximum.accumulate(hi)[:-1] + 1)))  # each start once
    width = np.maximum(hi - lo + 1, 0)
    return np.repeat(lo - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.15, recall: float = 0.99) -> DataFrame:
    """``(doc_id, item_id, distance, first_word, last_word)`` of each document and benchmark item found in it.

    A document holds an item if some run of its words is at most ``share`` of the item's words away in edits (words
    inserted, deleted or replaced; lower case, split at white space); the nearest run is reported. Windows of an item's
    size start at every word of every document; behind its last word they run into as many empty words as edits are
    allowed, so that a copy with words deleted is met at the end of a document, or is all of it. A window is embedded
    only if it has as many words, and as many rare words, of the items of its size as any of them keeps after the
    allowed edits, which tables of fixed size tell without missing any. Repeated random walks and bit sampling give the
    keys; ``recall`` sets the number of repetitions. Embedded windows that overlap form a stretch of text; windows and
    items meet in a join on the keys, and the whole stretch around a window is verified exactly against each item that
    it met. Texts themselves are not shuffled.

    Null and empty texts hold nothing, and items without words are in nothing. Rows without doc_id or item_id are left
    out. Repeated documents with one id are reported once, with the best run of any; repeated items likewise. Texts of
    any length are searched whole, other columns are ignored, and an empty table on either side gives an empty result.
    """
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item")).where("item_id is not null and item is not null")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    shift = np.uint64(64 - VOCABULARY_BITS)

    def item_words(batches):
        hashes = WordHashes()
        for batch in batches:
            out = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = hashes.of(text.lower().split())
                n = len(words)
                out += [(item_id, n, length_class(n), k, w) for k, w in enumerate(words.view(np.int64).tolist())]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["item_id", "n", "size", "place", "word"])

    words = materialize(items.mapInArrow(item_words, "item_id long, n long, size long, place long, word long"), "items")
    n_items = words.select("item_id").distinct().count()
    spread = words.groupBy("word").agg(F.count_distinct("item_id").alias("df"))
    words = words.join(spread, "word").withColumn("rare", F.col("df") <= max(2, n_items // 100))
    per_item = words.where("place < size").groupBy("item_id", "n", "size").agg(F.count_distinct(F.when(F.col("rare"), F.col("word"))).alias("rare"))
    spared = F.floor(F.col("n") * share + 1e-9)
    needs = per_item.groupBy("size").agg(F.min(F.col("size") - spared).alias("known"), F.min(F.col("rare") - spared).alias("rare"), F.max(spared).alias("spared"), F.max("n").alias("longest")).collect()  # a few length classes
    need = {r["size"]: (r["known"], r["rare"], r["spared"], r["longest"]) for r in needs}
    pad = max((spared for _, _, spared, _ in need.values()), default=0)  # a copy with words deleted may end with its document
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("size", F.lit(64)).cast("int"))
    bucket = F.shiftrightunsigned("word", 64 - VOCABULARY_BITS)
    masks = words.groupBy(bucket.alias("b")).agg(F.bit_or(bit).alias("known"), F.bit_or(F.when(F.col("rare"), bit).otherwise(F.lit(0).cast("long"))).alias("rare")).toArrow()
    known_mask, rare_mask = np.zeros(1 << VOCABULARY_BITS, dtype=np.int64), np.zeros(1 << VOCABULARY_BITS, dtype=np.int64)
    at = masks.column("b").to_numpy()
    known_mask[at], rare_mask[at] = masks.column("known").to_numpy(), masks.column("rare").to_numpy()
    repeats = {c: repeats_for(c, share, recall, longest=longest) for c, (_, _, _, longest) in need.items()}
    packed = docs.sparkSession.sparkContext.broadcast((known_mask, rare_mask, need, repeats))  # fixed size

    def item_keys(batches):
        hashes = WordHashes()
        repeats_of = packed.value[3]
        for batch in batches:
            ids, keys = [], []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = hashes.of(text.lower().split())
                if len(words):
                    c = length_class(len(words))
                    for repeat in range(repeats_of[c]):
                        ids.append(item_id)
                        keys.append(int(walk_keys(words[:c], np.zeros(1, dtype=np.int64), c, repeat)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(keys, type=pa.int64())], names=["item_id", "key"])

    def window_keys(batches):
        hashes = WordHashes()
        known_of, rare_of, needed, repeats_of = packed.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts = [hashes.of(t.lower().split()) for t in texts]
            lengths = np.array([len(p) for p in parts], dtype=np.int64)
            if not lengths.sum():
                continue
            gap = np.zeros(pad, dtype=np.uint64)
            words = np.concatenate([w for p in parts for w in (p, gap)])
            first = np.concatenate(([0], np.cumsum(lengths + pad)[:-1]))
            spots = words >> shift
            known, rare = known_of[spots], rare_of[spots]
            gaps = ((first + lengths)[:, None] + np.arange(pad)).ravel()
            known[gaps] = rare[gaps] = 0
            marked = np.flatnonzero(rare)  # few words of a text are rare ones of the benchmark
            rare = rare[marked]
            for c in sorted(needed):
                least, least_rare, spared, longest = needed[c]
                starts = window_starts(marked[(rare >> np.int64(c % 64)) & 1 > 0], len(words), c, least_rare)
                if not len(starts):
                    continue
                doc = np.searchsorted(first, starts, side="right") - 1  # the last that begins here is not an empty one
                fits = starts + c <= (first + lengths)[doc] + spared
                starts, doc = starts[fits], doc[fits]
                enough = np.zeros(len(starts), dtype=np.int64)
                for j in range(c):
                    enough += (known[starts + j] >> np.int64(c % 64)) & 1
                starts, doc = starts[enough >= least], doc[enough >= least]
                if not len(starts):
                    continue
                keys = np.stack([walk_keys(words, starts, c, repeat) for repeat in range(repeats_of[c])])
                cuts = np.flatnonzero((np.diff(doc) > 0) | (np.diff(starts) > c)) + 1
                out, split = [], (None, None)
                for lo, hi in zip([0, *cuts], [*cuts, len(starts)]):
                    d = int(doc[lo])
                    if split[0] != d:
                        split = (d, texts[d].lower().split())
                    at = max(0, int(starts[lo] - first[d]) - spared)
                    stretch = split[1][at : int(starts[hi - 1] - first[d]) + longest + 2 * spared]
                    out.append((ids[d], at, c, " ".join(stretch), np.unique(keys[:, lo:hi]).tolist()))
                columns = [pa.array(x, type=t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "size", "stretch", "keys"])

    by_key = items.mapInArrow(item_keys, "item_id long, key long").distinct()
    stretches = materialize(rows.mapInArrow(window_keys, "doc_id long, at long, size long, stretch string, keys array<long>"), "stretch")
    where = ["doc_id", "at", "size"]
    met = stretches.select(*where, F.explode("keys").alias("key")).join(by_key, "key").select(*where, "item_id").distinct()
    found = stretches.select(*where, "stretch").join(met, where).join(items.distinct(), "item_id").select("doc_id", "item_id", "at", "stretch", "item")

    def verify(batches):
        for batch in batches:
            out = []
            for doc_id, item_id, at, stretch, item in zip(*(c.to_pylist() for c in batch.columns)):
                want = item.lower().split()
                distance, a, b = edit_match(want, stretch.split(" "))
                if distance <= max_edits(len(want), share):
                    out.append((doc_id, item_id, distance, at + a, at + b))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "first_word", "last_word"])

    leaks = found.mapInArrow(verify, "doc_id long, item_id long, distance long, first_word long, last_word long")
    best = leaks.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "first_word", "last_word")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.15, recall: float = 0.99) -> DataFrame:
    """All columns of the documents that hold no benchmark item; rows without doc_id stay."""
    gone = find_leaks(docs, benchmark, share, recall).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone.hint("merge"), F.col("doc_id").cast("long") == gone["gone"], "left_anti")
