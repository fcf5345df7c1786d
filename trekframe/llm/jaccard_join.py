"""Near-duplicate documents: a Jaccard join of word n-gram sets by MinHash banding."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekframe.llm.hot_groups import with_group_totals
from trekframe.llm.pair_blocks import linked
from trekframe.llm.words import WordHashes, mix, shingles, small_batches
from trekframe.operators.graph import connected_components
from trekframe.storage import materialize

BLOCK = 64  # members of one block of a unit; two blocks meet in one task
CLOSE = 3  # buckets shared with their least class from which on a class belongs to that one's crowd
CROWD_UNIT = -1  # the band of a unit that is a crowd, not a bucket
SALTS = 8  # parts of a large group, which meet what is joined with it in tasks of their own


def band_plan(threshold: float, recall: float = 0.999, spill: float = 0.2) -> tuple[int, int]:
    """``(bands, rows)``: the fewest rows a band at which pairs of half the threshold rarely meet, and as many bands as
    give pairs at the threshold the wanted chance to meet in one of them."""
    for rows in range(1, 65):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if 1 - (1 - (threshold / 2) ** rows) ** bands <= spill:
            return bands, rows
    raise ValueError("no plan for this threshold")


class MinHasher:
    """Band keys of a set of 64-bit n-gram hashes."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.c = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def keys(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max)
        for at in range(0, len(grams), 2048):
            low = np.minimum(low, (np.multiply.outer(self.a, grams[at : at + 2048]) + self.c[:, None]).min(axis=1))
        low = mix(low).reshape(self.bands, self.rows)
        key = self.salt.copy()
        for j in range(self.rows):
            key = mix(key * np.uint64(0x100000001B3) + low[:, j])
        return key.view(np.int64)


def text_grams(text: str | None, hashes: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text's lower-case words; a text of fewer words has one n-gram of all."""
    return np.unique(shingles(hashes.of((text or "").lower().split()), k))


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """``(doc_id, class_key, n_grams, bands)`` of each row; equal n-gram sets have equal class keys, empty ones none."""

    def sign(batches):
        hashes, hasher = WordHashes(), MinHasher(bands, rows)
        for batch in batches:
            keys, sizes, bands_of = [], [], []
            for text in batch.column(1).to_pylist():
                grams = text_grams(text, hashes, k)
                sizes.append(len(grams))
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                bands_of.append(hasher.keys(grams) if len(grams) else None)
            arrays = [batch.column(0), pa.array(keys, type=pa.binary()), pa.array(sizes, type=pa.int64()), pa.array(bands_of, type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "class_key", "n_grams", "bands"])

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows_in.mapInArrow(sign, "doc_id long, class_key binary, n_grams long, bands array<long>")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of ``left[i]`` and ``right[j]`` for each pair (i, j); all arrays sorted and distinct."""
    if len(pairs) <= 4 * (len(left) + len(right)):
        return np.array([len(np.intersect1d(left[i], right[j], assume_unique=True)) for i, j in pairs], dtype=np.int64)
    both = [*left, *right]
    values, column, counts = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    shared = counts[column] > 1
    row, column = row[shared], np.cumsum(counts > 1)[column[shared]] - 1
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    width = 16384
    for lo in range(0, int((counts > 1).sum()), width):
        a, b = np.searchsorted(column, (lo, lo + width))
        held = np.zeros((len(both), width), dtype=np.float32)
        held[row[a:b], column[a:b] - lo] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out[pairs[:, 0], pairs[:, 1]].round().astype(np.int64)


def least_common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first band in which rows of two matrices of band keys have the same key; -1 where there is none."""
    first = np.full((len(left), len(right)), -1)
    for band in range(left.shape[1] - 1, -1, -1):
        first[left[:, band, None] == right[None, :, band]] = band
    return first


def _beside(rows: DataFrame, few: DataFrame, on: list[str], large: Column) -> DataFrame:
    """``rows`` with the one row of ``few`` for their group; groups that ``few`` calls large are joined in parts."""
    part = F.pmod(F.xxhash64("class_id"), F.lit(SALTS)).cast("int")
    parted = rows.withColumn("salt", F.explode(F.array(F.lit(-1), part)))
    salts = F.when(large, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    return parted.join(few.withColumn("salt", F.explode(salts)).hint("merge"), [*on, "salt"]).drop("salt")


def comparison_units(signed: DataFrame) -> DataFrame:
    """``(class_id, crowd, band, key, own, skip_from, skip_to, blocks)``: where each of ``(class_id, bands)`` is compared.

    Classes meet in their buckets (band keys of several classes), which are never joined into larger groups: where
    chance hits chain a whole corpus, a class still takes part in one unit a band at most, and in its crowd. Two things
    save work and lose no pair:

    * A class that shares ``CLOSE`` buckets with the least class of them belongs to that one's crowd (the least such
      class; else a crowd of its own). Pairs of a crowd are compared once, in the crowd, and buckets compare only pairs
      of two crowds, so those within one crowd are dropped.
    * Of buckets with the same members, that of the first band is kept. A pair counts in its first common band.

    Units are cut into blocks of about ``BLOCK`` members, every two of which are to meet. In a bucket, a crowd of that
    size has blocks of its own, ``skip_from`` to before ``skip_to``, which need not meet each other.
    """
    keys = signed.select("class_id", F.posexplode("bands").alias("band", "key"))
    totals = {"lead": F.min("class_id"), "n": F.count(F.lit(1))}
    met = materialize(with_group_totals(keys, ["key"], totals, least=2).where("n > 1").drop("n"), "met")
    close = met.groupBy("class_id", "lead").agg(F.count("*").alias("n"))
    crowd = F.coalesce(F.min(F.when(F.col("n") >= CLOSE, F.col("lead"))), F.col("class_id")).alias("crowd")
    crowds = materialize(close.groupBy("class_id").agg(crowd), "crowd")
    placed = materialize(met.select("class_id", "band", "key").join(crowds.hint("merge"), "class_id"), "placed")
    hashed, wide = F.xxhash64("class_id"), F.ceil(F.col("size") / BLOCK).cast("int")

    within = with_group_totals(crowds, ["crowd"], {"size": F.count(F.lit(1))}, least=2).where("size > 1").withColumns({
        "band": F.lit(CROWD_UNIT), "key": F.col("crowd"), "own": F.pmod(hashed, wide).cast("int"),
        "skip_from": F.lit(0), "skip_to": F.lit(0), "blocks": wide,
    })

    members = [F.count("*").alias("n"), F.bit_xor(hashed).alias("x"), F.bit_xor(F.xxhash64("class_id", F.lit(1))).alias("y")]
    buckets = placed.groupBy("key").agg(F.min("band").alias("band"), F.min("crowd").alias("low"), F.max("crowd").alias("high"), *members)
    kept = buckets.where("low <> high").groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("first"))
    across = materialize(_beside(placed, kept.select("first.key", "n"), ["key"], F.col("n") >= BLOCK).drop("n"), "across")
    # a bucket's blocks: those of what is in no large crowd, then those of each large crowd
    shares = across.groupBy("key", "crowd").agg(F.count("*").alias("size"))
    shares = materialize(shares.withColumn("part", F.when(F.col("size") >= BLOCK, F.col("crowd"))), "shares")
    parts = shares.groupBy("key", "part").agg(F.sum("size").alias("size")).withColumn("wide", wide)
    bucket = Window.partitionBy("key")
    upto = F.sum("wide").over(bucket.orderBy(F.asc_nulls_first("part")).rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.select(F.col("key").alias("in"), F.col("part").alias("of"), "wide", (upto - F.col("wide")).cast("int").alias("at"), F.sum("wide").over(bucket).cast("int").alias("blocks"))
    laid = shares.join(parts, (F.col("key") == F.col("in")) & F.col("part").eqNullSafe(F.col("of"))).select("key", "crowd", "part", "wide", "at", "blocks")
    large = F.col("part").isNotNull()
    between = _beside(across, laid, ["key", "crowd"], large).withColumns({
        "own": (F.col("at") + F.pmod(hashed, "wide")).cast("int"),
        "skip_from": F.when(large, F.col("at")).otherwise(0),
        "skip_to": F.when(large, F.col("at") + F.col("wide")).otherwise(0),
    })
    columns = ["class_id", "crowd", "band", "key", "own", "skip_from", "skip_to", "blocks"]
    return materialize(within.select(*columns).unionByName(between.select(*columns)), "units")


def blocks_to_meet() -> Column:
    """The blocks of its unit that a row of ``comparison_units`` meets."""
    before = F.when(F.col("skip_from") > 0, F.sequence(F.lit(0), F.col("skip_from") - 1))
    after = F.when(F.col("skip_to") < F.col("blocks"), F.sequence(F.col("skip_to"), F.col("blocks") - 1))
    none = F.array().cast("array<int>")
    return F.concat(F.coalesce(before, none), F.coalesce(after, none))


def linked_pairs(sets_left: list[np.ndarray], sets_right: list[np.ndarray], threshold: float, same: bool, met: np.ndarray | None = None) -> np.ndarray:
    """Pairs (i, j) whose sets reach the threshold, of those ``met``; of one block with itself, those with i < j."""
    n_left, n_right = np.array([len(x) for x in sets_left])[:, None], np.array([len(x) for x in sets_right])[None, :]
    meet = np.minimum(n_left, n_right) >= threshold * np.maximum(n_left, n_right) - 1e-9
    if met is not None:
        meet &= met
    if same:
        meet = np.triu(meet, 1)
    pairs = np.argwhere(meet)
    if not len(pairs):
        return pairs
    both = _overlaps(sets_left, sets_right, pairs)
    union = n_left[pairs[:, 0], 0] + n_right[0, pairs[:, 1]] - both
    return pairs[both >= threshold * union - 1e-9]


def jaccard_links(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.9997) -> DataFrame:
    """``(doc_id, class_id, n_links, component_id, kept)`` of every row of ``docs``.

    Rows link if the Jaccard similarity of their sets of ``k``-word n-grams is at least ``threshold``. Rows with equal
    sets form a class (``class_id``: its smallest doc_id), and classes are compared, not rows. ``n_links`` counts the
    other rows that a row links with, its own class's included. ``component_id`` is the smallest doc_id reachable by
    links; ``kept`` marks that row.

    Band keys are shuffled, and classes meet in the buckets that they give (``comparison_units``); ``recall`` is the
    chance that a pair at the threshold shares one. Buckets, and crowds of classes that share many, are cut into blocks
    of about ``BLOCK`` members by hash, and each two blocks meet in a task of their own, where the pairs that share a
    band key are verified on their full sets. No task holds a whole bucket, and no pairs are written.

    A null text is empty, and a row without words has no set and links with nothing; an empty table gives an empty
    result. A row without doc_id links with nothing that has none, and counts as a copy of equal rows. Repeated rows are
    rows of their own with one id; rows of one id are expected to have one text. Texts of any length count whole, and
    other columns are ignored.
    """
    small_batches(docs.sparkSession)
    bands, rows = band_plan(threshold, recall)
    signed = materialize(signatures(docs, k, bands, rows), "sign")
    classes = signed.where("class_key is not null").groupBy("class_key")
    classes = materialize(classes.agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "class")
    known = classes.where("class_id is not null")
    units = comparison_units(known)

    def gather(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [text_grams(t, hashes, k) for t in batch.column("text").to_pylist()]
            digests = pa.array([xxhash.xxh3_128_digest(g.tobytes()) for g in sets], type=pa.binary())
            arrays = [batch.column("class_id"), digests, pa.array([g.tobytes() for g in sets], type=pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["class_id", "class_key", "grams"])

    texts = docs.select(F.col("doc_id").cast("long").alias("class_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(units.select("class_id").distinct().hint("merge"), "class_id", "left_semi")
    sets = texts.mapInArrow(gather, "class_id long, class_key binary, grams binary")
    sets = sets.join(known.select("class_id", "class_key", "copies", "bands"), ["class_id", "class_key"]).drop("class_key")
    members = units.join(sets.hint("merge"), "class_id").withColumnRenamed("class_id", "node")

    def load(block: pa.Table):
        grams = [np.frombuffer(g, dtype=np.uint64) for g in block.column("grams").to_pylist()]
        return grams, np.array(block.column("bands").to_pylist()), block.column("crowd").to_numpy(), block.column("band")[0].as_py()

    def compare(left, right, same: bool) -> np.ndarray:
        first, band = least_common(left[1], right[1]), left[3]
        met = first >= 0 if band == CROWD_UNIT else (first == band) & (left[2][:, None] != right[2][None, :])
        return linked_pairs(left[0], right[0], threshold, same, met)

    found = materialize(linked(members, ["band", "key"], "node", load, compare, blocks_to_meet()), "found")
    counts = found.where("links > 0").groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("outer"))
    joined = connected_components(found, "a", "b").select(F.col("node").alias("class_id"), F.col("component").alias("component_id"))
    reached = classes.join(counts, "class_id", "left").join(joined, "class_id", "left")
    reached = reached.select("class_key", "class_id", (F.col("copies") - 1 + F.coalesce("outer", F.lit(0))).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"))
    final = signed.select("doc_id", "class_key").join(reached, "class_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return final.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.9997) -> DataFrame:
    """All columns of the documents kept, one id of each group of near-duplicates. Rows without doc_id stay, and so do
    repeated rows of a kept id."""
    gone = jaccard_links(docs, threshold, k, recall).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone.hint("merge"), F.col("doc_id").cast("long") == gone["gone"], "left_anti")
