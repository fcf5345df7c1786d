"""All pairs inside large groups, in tasks of two blocks each: no task holds a group, and no pairs are written."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINKS = "a long, b long, links long"


def spanning_edges(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A forest that joins what the pairs join."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def deal(groups: DataFrame, group: str, node: str, block: int) -> DataFrame:
    """``(node, group, blocks, own)``: each node's block of its group, by hash, for blocks of about ``block`` nodes."""
    sizes = groups.groupBy(group).agg(F.count("*").alias("size"))
    dealt = groups.join(sizes, group).select(node, group, F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    return dealt.withColumn("own", F.pmod(F.xxhash64(node), "blocks").cast("int"))


def linked(members: DataFrame, group: str | list[str], node: str, load: Callable, compare: Callable, others: Column | None = None) -> DataFrame:
    """``(a, b, links)`` of the linked pairs in all groups of ``members`` with ``blocks``, ``own`` and ``copies``.

    Each two blocks of a group meet in a task, or those that ``others`` lists for either. ``load(table)`` makes one side of the rows of a block, whose nodes are in
    ascending order; ``compare(left, right, same)`` returns an array of linked row numbers ``(i, j)``, i < j if both
    are one block. Links come back summed: a row ``(a, a, n)`` for the copies of others that a node links with, and rows
    ``(a, b, 0)`` of a forest that joins what the pairs join.
    """
    others = F.sequence(F.lit(0), F.col("blocks") - 1) if others is None else others
    spread = members.select("*", F.explode(others).alias("other"))
    spread = spread.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def work(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        table = table.sort_by(node)
        nodes, own = table.column(node).to_numpy(), table.column("own").to_numpy()
        first = np.concatenate(([True], nodes[1:] != nodes[:-1]))  # repeated rows of a node are one
        sides = [table.take(np.flatnonzero(first & (own == side))) for side in ((i,) if i == j else (i, j))]
        out = ([], [], [])
        if all(side.num_rows for side in sides):
            loaded = [load(side) for side in sides]
            pairs = compare(loaded[0], loaded[-1], i == j)
            ids, copies = [side.column(node).to_numpy() for side in sides], [side.column("copies").to_numpy() for side in sides]
            a, b = ids[0][pairs[:, 0]], ids[-1][pairs[:, 1]]
            ends, slot = np.unique(np.concatenate((a, b)), return_inverse=True)
            total = np.zeros(len(ends), dtype=np.int64)
            np.add.at(total, slot, np.concatenate((copies[-1][pairs[:, 1]], copies[0][pairs[:, 0]])))
            forest = spanning_edges(list(zip(a.tolist(), b.tolist())))
            out = ([*ends.tolist(), *(x for x, _ in forest)], [*ends.tolist(), *(y for _, y in forest)], [*total.tolist(), *[0] * len(forest)])
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("a", "b", "links"), out)})

    keys = [group] if isinstance(group, str) else group
    return spread.groupBy(*keys, "i", "j").applyInArrow(work, LINKS)
