"""Codes of vectors by parts, with nearest entries found through lower bounds of segment means."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.llm.hot_groups import with_group_totals
from trekframe.storage import materialize

_LONG = (1 << 63) - 1


def segment_summaries(x: np.ndarray, n: int) -> np.ndarray:
    """Of each row cut into ``n`` segments: the segments' means times the roots of their lengths, then the norms of what is
    left beside the means. The squared distance of two rows is at least that of their summaries."""
    cuts = np.array_split(np.arange(x.shape[1]), n)
    means = [x[:, c].mean(axis=1) for c in cuts]
    rest = [np.sqrt(((x[:, c] - m[:, None]) ** 2).sum(axis=1)) for c, m in zip(cuts, means)]
    return np.stack([m * len(c) ** 0.5 for c, m in zip(cuts, means)] + rest, axis=1)


class Codebook:
    """Integer entries of one part, and their summaries by one, two, four and eight segments.

    In a segment of length L, with means m and residual norms r, a squared distance is at least
    ``L * (m1 - m2)^2 + (r1 - r2)^2``; summed over segments, and finer segments bound closer. A row's entries whose bound
    exceeds the exact distance to an entry met before are out; the rest go to the next level, and those left after the
    finest get exact integer distances. ``slack`` covers the rounding of the bounds, so no entry is lost to it.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.levels = [n for n in (1, 2, 4, 8) if n <= max(1, entries.shape[1] // 2)]
        self.top = max([abs(int(v)) for v in (entries.min(), entries.max())]) if entries.size else 0
        self.known = [segment_summaries(entries.astype(np.float64), n) for n in self.levels] if entries.size else []

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Per row the nearest entry (ties to the lower number), its squared distance, and how many distances were exact."""
        n, width = x.shape
        if n == 0 or width == 0:
            return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), 0
        top = max(self.top, abs(int(x.min())), abs(int(x.max())))
        wide = 4 * top * top * width >= _LONG  # squares of so large differences need whole numbers of any size
        entries = self.entries.astype(object) if wide else self.entries
        slack = 1e-9 * (float(top) ** 2 * width + 1)
        found = [self._nearest(x[a : a + 1024].astype(object if wide else np.int64), entries, slack) for a in range(0, n, 1024)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), sum(f[2] for f in found)

    def _nearest(self, x: np.ndarray, entries: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, int]:
        def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            d = x[i] - entries[j]
            return (d * d).sum(axis=1)

        real, every, most, n_exact = x.astype(np.float64), np.arange(len(x)), np.inf, 0
        alive = np.ones((len(x), len(entries)), dtype=bool)
        for level, known in zip(self.levels, self.known):
            own = segment_summaries(real, level)
            bound = (own * own).sum(axis=1)[:, None] + (known * known).sum(axis=1) - 2 * own @ known.T
            bound[~alive] = np.inf
            most = np.minimum(most, exact(every, bound.argmin(axis=1)).astype(np.float64))
            alive = bound <= most[:, None] + slack
            n_exact += len(x)
        i, j = np.nonzero(alive)
        far = exact(i, j)
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        least = np.minimum.reduceat(far, starts)
        at = np.flatnonzero(far == np.repeat(least, np.diff(starts, append=len(i))))
        at = at[np.flatnonzero(np.diff(i[at], prepend=-1))]
        return j[at], least, n_exact + len(i)


def part_cuts(width: int, parts: int) -> list[slice]:
    """Consecutive parts of equal size; where the width leaves a rest, the first parts hold one more."""
    sizes = [width // parts + (k < width % parts) for k in range(parts)]
    ends = np.cumsum(sizes)
    return [slice(int(e - s), int(e)) for s, e in zip(sizes, ends)]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), width)


def whole_vectors(vectors: DataFrame, vector: str, scale: int, keep: list[str]) -> DataFrame:
    """Rows whose vector and components are all there and finite, with the vector as whole numbers ``v``: the floors
    of ``scale`` times the components (of what a long can hold)."""
    v = F.col(vector).cast("array<double>")
    sane = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & sane).select(*keep, F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every row of ``vectors (vec_id, embedding, label)``.

    Vectors become whole numbers and are cut into ``parts``; each part is told by the number of its nearest entry in
    the part's codebook (at most 256 entries: two hex digits), trained in ``rounds`` of assignment and floored means
    over all rows. The codebooks start from the ``entries`` smallest ids. A round is one pass over the written
    integers: tasks sum up their rows by entry, sums meet in one small aggregation, and codebooks, whose size does not
    hang on the table, go out by broadcast. All sums and distances are whole numbers, so neither the order of rows nor
    a repeated task changes them.

    Rows whose vector is null or holds a null or non-finite component are left out, as are vectors of another
    length than that of the smallest id. Fewer rows than ``entries`` give smaller codebooks. Rows with equal ids count each
    (in the order of their vectors, then), rows without one come last. Null labels are one label. An empty vector has code
    zero and error 0. Components beyond a long are held to its range, and so are errors. An empty table gives an empty
    result. Other columns, whatever their names, are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries: 1 to 256, as a code has two hex digits")
    spark = vectors.sparkSession
    rows = whole_vectors(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").alias("label")), "embedding", scale, ["vec_id", "label"])
    rows = materialize(rows, "whole")
    order = (F.asc_nulls_last("vec_id"), "v")
    first = rows.orderBy(*order).limit(1).collect()
    width = len(first[0].v) if first else 0
    rows = rows.where(F.size("v") == width)
    start = [r.v for r in rows.orderBy(*order).limit(entries).select("v").collect()]
    start = np.array(start, dtype=np.int64).reshape(len(start), width)
    cuts = part_cuts(width, parts)
    books = [start[:, c] for c in cuts]
    for _ in range(rounds if len(start) and width else 0):
        books = _moved(rows, books, cuts, width)
    text = ",".join(str(int(v)) for b in books for v in b.ravel())
    shared = spark.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in shared.value]
        for batch in batches:
            x = _matrix(batch.column(2), width)
            found = [b.nearest(x[:, c])[:2] for b, c in zip(own, cuts)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8) if len(x) else np.empty((0, parts), np.uint8)
            errors = [min(sum(map(int, e)), _LONG) for e in zip(*[f[1] for f in found])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    coded = materialize(rows.select("vec_id", "label", "v").mapInArrow(encode, f"vec_id long, label {kind}, code string, error long"), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(_LONG)).cast("decimal(38,0)")).cast("long")
    out = with_group_totals(coded, ["label"], {"label_error": total})
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def _moved(rows: DataFrame, books: list[np.ndarray], cuts: list[slice], width: int) -> list[np.ndarray]:
    """Codebooks after one round: each entry at the floored mean of its parts; entries without any stay."""
    shared, n = rows.sparkSession.sparkContext.broadcast(books), len(books[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in shared.value]
        got = np.zeros((n, width + len(cuts)), dtype=object)  # sums of each component, then the parts' counts
        for batch in batches:
            x = _matrix(batch.column(0), width)
            wide = len(x) and int(max(abs(int(x.min())), abs(int(x.max())))) * len(x) > _LONG
            for k, (book, c) in enumerate(zip(own, cuts)):
                at = book.nearest(x[:, c])[0]
                if not len(at):
                    continue
                by = np.argsort(at, kind="stable")
                starts = np.flatnonzero(np.diff(at[by], prepend=-1))
                part = x[by, c].astype(object) if wide else x[by, c]
                if part.shape[1]:
                    got[at[by][starts], c] += np.add.reduceat(part, starts, axis=0).astype(object)
                got[:, width + k] += np.bincount(at, minlength=n).astype(object)
        slot = np.flatnonzero(got.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array([Decimal(int(v)) for v in got.ravel()[slot]], pa.decimal128(38, 0))], ["slot", "total"])

    met = rows.select("v").mapInArrow(sums, "slot long, total decimal(38,0)").groupBy("slot").agg(F.sum("total").alias("total"))
    flat = np.zeros(n * (width + len(cuts)), dtype=object)
    for r in met.collect():  # at most entries * (width + parts) numbers
        flat[r.slot] = int(r.total)
    table, out = flat.reshape(n, -1), []
    for k, (book, c) in enumerate(zip(books, cuts)):
        counts, moved = table[:, width + k], book.copy()
        for e in range(n):
            if counts[e]:
                moved[e] = [int(s) // int(counts[e]) for s in table[e, c]]
        out.append(moved)
    return out


def oracle_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same table in DuckDB, for vectors of one length."""
    assign = """a{r} AS (SELECT part, id, v, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT p.part, p.id, p.v, b.entry,
  CAST(list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, b.v) + list_dot_product(b.v, b.v) AS BIGINT) AS d FROM p JOIN b{r} b USING (part)) GROUP BY part, id, v)"""
    move = """m{r} AS (SELECT part, entry, list(CAST(c AS DOUBLE) ORDER BY i) AS v FROM (SELECT part, entry, i, floor(sum(v[i]) / count(*)) AS c FROM a{r}, range(1, CAST(len(v) + 1 AS BIGINT)) t(i) GROUP BY part, entry, i) GROUP BY part, entry),
b{n} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (part, entry))"""
    steps = ",\n".join(f"{assign.format(r=r)},\n{move.format(r=r, n=r + 1)}" for r in range(rounds))
    return f"""WITH w AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS id, vec_id, label, v FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
p AS (SELECT CAST(k AS BIGINT) AS part, id, v[CAST(k * len(v) // {parts} + 1 AS BIGINT):CAST((k + 1) * len(v) // {parts} AS BIGINT)] AS v FROM w, range(0, {parts}) t(k)),
b0 AS (SELECT part, id - 1 AS entry, v FROM p WHERE id <= {entries}),
{steps},
{assign.format(r=rounds)},
c AS (SELECT id, string_agg(lower(lpad(hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS sha FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h.sha AS codebooks_sha256 FROM w JOIN c USING (id), h"""
