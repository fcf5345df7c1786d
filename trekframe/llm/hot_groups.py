"""Aggregates of a row's group beside every row, whatever share of the rows one group holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trekframe.storage import materialize

HOT = 256


def with_group_totals(rows: DataFrame, keys: list[str], totals: dict[str, Column], least: int = 1) -> DataFrame:
    """``rows`` and, beside each, the aggregates ``totals`` of its group by ``keys`` (nulls are equal to each other).

    Groups of fewer than ``least`` rows get nulls. Aggregates are built map-side first. The ``HOT`` largest groups, a
    fixed number, are broadcast; any other holds less than 1/``HOT`` of the rows and is met in a shuffle join.
    ``rows`` is read three times: pass a written table.
    """
    names = [f"__key{i}" for i in range(len(keys))]
    groups = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias("__rows"), *[c.alias(n) for n, c in totals.items()])
    groups = materialize(groups.where(F.col("__rows") >= least), "groups")
    hot = groups.orderBy(F.desc("__rows"), *names).limit(HOT)
    same = lambda other: [F.col(k).eqNullSafe(other[n]) for k, n in zip(keys, names)]
    beside = rows.join(F.broadcast(hot), same(hot), "left")
    met = beside.where(F.col("__rows").isNotNull()).select(*rows.columns, *totals)
    rest = beside.where(F.col("__rows").isNull()).select(*rows.columns)
    cold = groups.join(F.broadcast(hot.select(*[F.col(n).alias(f"{n}h") for n in names])), [F.col(n).eqNullSafe(F.col(f"{n}h")) for n in names], "left_anti")
    return met.unionByName(rest.join(cold.hint("merge"), same(cold), "left").select(*rows.columns, *totals))
