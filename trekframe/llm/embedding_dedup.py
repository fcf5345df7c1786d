"""Near-duplicate embeddings: windows over sorted random projections, counted by pair, then exact cosines."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.llm.pair_blocks import LINKS, deal, linked, spanning_edges
from trekframe.llm.words import small_batches
from trekframe.operators.graph import connected_components
from trekframe.storage import materialize

WINDOW = 0.5  # half width of the query-centred window, for projections of unit vectors on standard normal directions
LEAST = 3  # collisions that a pair needs, at any number of vectors
CROWD = 32  # vectors in one slot of a cell from which on it is looked at for crowds
BLOCK = 64  # vectors of a block of a crowd


def collision_plan(n: int, threshold: float, recall: float) -> tuple[int, int, int]:
    """``(bits, tables, count)`` for ``n`` vectors.

    A table sorts one projection within the cells of ``bits`` hyperplane signs. Alone, a window over a projection would
    hold a fixed share of all vectors; as the signs grow with log2(n), it holds a few others at any ``n``. A pair at
    the threshold collides in a table with probability p; there are as many tables as give it ``LEAST`` collisions with
    probability ``recall``, and ``count`` is the most collisions that it has with that probability.
    """
    bits = max(0, round(math.log2(max(n, 2))) - 4)
    apart = math.sqrt(2 - 2 * threshold)
    p = (1 - math.acos(threshold) / math.pi) ** bits * math.erf(WINDOW / apart / math.sqrt(2))

    def at_least(count: int, tables: int) -> float:
        return 1 - sum(math.comb(tables, k) * p**k * (1 - p) ** (tables - k) for k in range(count))

    tables = LEAST
    while at_least(LEAST, tables) < recall:
        tables += 1 + tables // 50
    count = LEAST
    while count < tables and at_least(count + 1, tables) >= recall:
        count += 1
    return bits, tables, count


def _unit(value) -> np.ndarray | None:
    """The vector at length one in double precision; none for null, empty, zero or non-finite ones."""
    if not value or any(x is None for x in value):
        return None
    v = np.array(value, dtype=np.float64)
    scale = np.abs(v).max()
    if not np.isfinite(v).all() or scale == 0:
        return None
    v = v / scale
    return v / np.sqrt(v @ v)


def _by_length(units: list[bytes]):
    """``(rows, matrix)`` of the vectors of each length."""
    dims = np.array([len(x) // 8 for x in units])
    for dim in np.unique(dims):
        own = np.flatnonzero(dims == dim)
        yield own, np.frombuffer(b"".join(units[k] for k in own), dtype=np.float64).reshape(-1, dim)


@lru_cache(maxsize=4)
def _directions(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng(dim).normal(size=(dim, tables * (bits + 1)))


def projections(m: np.ndarray, tables: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector in each table, numbered through all tables and lengths, and its projection there."""
    dim = m.shape[1]
    at = (m @ _directions(dim, tables, bits)).reshape(len(m), tables, bits + 1)
    signs = (at[:, :, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
    return signs + (((dim << 12) + np.arange(tables, dtype=np.int64)) << 40)[None, :], at[:, :, bits]


_NONE = -(1 << 63)  # the crowd of vectors in none


def _with_units(pairs: DataFrame, units: DataFrame) -> DataFrame:
    left = units.select(F.col("class_id").alias("a"), F.col("unit").alias("ua"), F.col("copies").alias("ca"))
    right = units.select(F.col("class_id").alias("b"), F.col("unit").alias("ub"), F.col("copies").alias("cb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ua", "ub", "ca", "cb")


def _verify(threshold: float, emit):
    """A task over rows of ``_with_units``: what ``emit`` makes of those whose cosine reaches the threshold."""

    def run(batches):
        for batch in batches:
            a, b, ua, ub, ca, cb = (c.to_pylist() for c in batch.columns)
            cosine = np.full(len(a), -1.0)
            same = np.array([len(x) == len(y) for x, y in zip(ua, ub)], dtype=bool)
            for own, x in _by_length([u if s else b"" for u, s in zip(ua, same)]):
                if x.shape[1]:
                    cosine[own] = np.einsum("ij,ij->i", x, np.frombuffer(b"".join(ub[k] for k in own), dtype=np.float64).reshape(x.shape))
            yield emit([(a[k], b[k], ca[k], cb[k]) for k in np.flatnonzero(cosine >= threshold).tolist()])

    return run


def _links(pairs: list[tuple]) -> pa.RecordBatch:
    total: dict[int, int] = {}
    for a, b, ca, cb in pairs:
        total[a] = total.get(a, 0) + cb
        total[b] = total.get(b, 0) + ca
    edges = [(x, y, 0) for x, y in spanning_edges([p[:2] for p in pairs])] + [(x, x, n) for x, n in total.items()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in list(zip(*edges)) or [()] * 3], names=["a", "b", "links"])


def _ends(pairs: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], type=pa.int64()) for k in (0, 1)], names=["a", "b"])


def _crowds(placed: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """``(node, crowd)`` of the vectors in crowds. The vectors of a crowded slot are held against the one with the least
    hash; each belongs to the crowd of the first by hash that it links with, itself included."""
    rank = F.struct(F.xxhash64("id").alias("h"), F.col("id"))
    slots = placed.groupBy("cell", "slot").agg(F.min(rank).alias("lead"), F.count("*").alias("n")).where(F.col("n") >= CROWD)
    stars = placed.join(slots, ["cell", "slot"]).select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct()
    near = _with_units(stars, units).mapInArrow(_verify(threshold, _ends), "a long, b long")
    return near.groupBy(F.col("b").alias("node")).agg(F.min(F.struct(F.xxhash64("a").alias("h"), F.col("a"))).alias("first")).select("node", F.col("first.a").alias("crowd"))


def embedding_links(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.998, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row.

    Rows link if the cosine of their vectors, in double precision, is at least ``threshold``. ``n_links`` counts the
    other rows that a row links with; ``component_id`` is the smallest id reachable by links; ``kept`` marks that row.
    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, nor do vectors of
    different lengths with each other.

    Equal vectors form a class, and classes are compared. Each table sorts a projection within cells, and every vector
    meets those of its cell whose projection lies within ``WINDOW`` above its own, through slots of that width, so that
    a crowded cell is many keys. Collisions are counted by pair over all tables, and pairs with the planned count are
    verified. Every vector is compared, none sampled; pairs at the threshold are found with probability ``recall``,
    closer ones more surely.

    Pairs of one crowd are counted without writing them: where a slot is crowded, its vectors are held against one of
    them, the same for most slots, and those linked with it are a crowd. A crowd is cut into blocks, and each two blocks
    meet in a task that counts the same collisions of all their pairs. Only pairs across crowds are written.

    Repeated rows are rows of their own with one id; rows without id link with nothing. An empty table gives an empty
    result, and other columns are ignored.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))

    def read(batches):
        for batch in batches:
            keys, units = [], []
            for value in batch.column(1).to_pylist():
                u = _unit(value)
                keys.append(None if u is None else xxhash.xxh3_128_digest(np.array(value, dtype=np.float64).tobytes()))
                units.append(None if u is None else u.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, type=pa.binary()), pa.array(units, type=pa.binary())], names=["vec_id", "class_key", "unit"])

    read_rows = materialize(rows.mapInArrow(read, "vec_id long, class_key binary, unit binary"), "unit")
    usable = read_rows.where("class_key is not null and vec_id is not null")
    classes = usable.groupBy("class_key").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    classes = materialize(classes, "class")
    bits, tables, count = collision_plan(classes.count(), threshold, recall)

    def project(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for own, m in _by_length(batch.column(1).to_pylist()):
                cells, p = projections(m, tables, bits)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(cells[:, t]), pa.array(p[:, t])], names=["id", "cell", "p"])

    units = classes.select("class_id", "unit", "copies")
    placed = units.select("class_id", "unit").mapInArrow(project, "id long, cell long, p double").withColumn("slot", F.floor(F.col("p") / WINDOW))
    crowds = materialize(_crowds(placed, units, threshold), "crowd")
    own_crowd = crowds.select(F.col("node").alias("id"), "crowd")
    marked = placed.join(own_crowd, "id", "left").withColumn("crowd", F.coalesce("crowd", F.lit(_NONE)))
    query = marked.select(F.col("id").alias("a"), "cell", F.col("p").alias("pa"), F.col("crowd").alias("of_a"), F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"))
    other = marked.select(F.col("id").alias("b"), F.col("cell").alias("cell_b"), F.col("p").alias("pb"), F.col("crowd").alias("of_b"), F.col("slot").alias("slot_b"))
    above = (F.col("pb") > F.col("pa")) | ((F.col("pb") == F.col("pa")) & (F.col("b") > F.col("a")))
    apart = (F.col("of_a") != F.col("of_b")) | (F.col("of_a") == _NONE)
    same_slot = (F.col("cell") == F.col("cell_b")) & (F.col("slot") == F.col("slot_b"))
    met = query.join(other, same_slot & apart & above & (F.col("pb") - F.col("pa") <= WINDOW))
    pairs = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= count)
    across = _with_units(pairs.select("a", "b"), units).mapInArrow(_verify(threshold, _links), LINKS)

    def load(block: pa.Table):
        return [(own, m, *projections(m, tables, bits)) for own, m in _by_length(block.column("unit").to_pylist())]

    def compare(left, right, same: bool) -> np.ndarray:
        out = [np.empty((0, 2), dtype=np.int64)]
        for own_l, m_l, cell_l, p_l in left:
            for own_r, m_r, cell_r, p_r in right:
                if m_l.shape[1] == m_r.shape[1]:
                    met = np.zeros((len(m_l), len(m_r)), dtype=np.int32)
                    for t in range(tables):
                        met += (cell_l[:, t, None] == cell_r[None, :, t]) & (np.abs(p_l[:, t, None] - p_r[None, :, t]) <= WINDOW)
                    hit = (met >= count) & (m_l @ m_r.T >= threshold)
                    pairs = np.argwhere(np.triu(hit, 1) if same else hit)
                    out.append(np.stack([own_l[pairs[:, 0]], own_r[pairs[:, 1]]], axis=1))
        return np.concatenate(out)

    members = deal(crowds, "crowd", "node", BLOCK).join(units.withColumnRenamed("class_id", "node"), "node")
    found = materialize(across.unionByName(linked(members, "crowd", "node", load, compare)), "found")
    counts = found.where("links > 0").groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("outer"))
    joined = connected_components(found, "a", "b").select(F.col("node").alias("class_id"), F.col("component").alias("component_id"))
    reached = classes.join(counts, "class_id", "left").join(joined, "class_id", "left")
    reached = reached.select("class_key", (F.col("copies") - 1 + F.coalesce("outer", F.lit(0))).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"))
    known = F.col("vec_id").isNotNull()
    final = read_rows.select("vec_id", F.when(known, F.col("class_key")).alias("class_key")).join(reached, "class_key", "left")
    component = F.coalesce("component_id", "vec_id")
    return final.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
