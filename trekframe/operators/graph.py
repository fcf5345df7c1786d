"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.storage import materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


_SALTS = 8  # parts of a node's edges, so that those of a hub meet its least neighbour in several tasks


def _with_low(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` with the ``m`` of their ``u``."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(_SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    return salted.join(low.select("u", "m", salts).hint("merge"), ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_low(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    met = _with_low(down, low)
    return (
        met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(low.select("u", F.col("m").alias("v")))
        .distinct()
    )


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of an edge, the component being its smallest node.

    Every round is two aggregations and two joins on the node, written to the shared folder; hot nodes are combined
    before the shuffle and their join partitions are split at run time. Rows with a null end are ignored, self loops
    give a component of one node.
    """
    clean = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    alone = clean.where("u = v").select("u").distinct()
    current = materialize(_small_star(clean), "cc")
    seen = _signature(current)
    for _ in range(max_rounds):
        current = materialize(_small_star(_large_star(current)), "cc")
        now = _signature(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    # settled: every edge leads from a node to its root
    linked = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = linked.select(F.col("component").alias("node"), "component").distinct()
    known = linked.unionByName(roots)
    rest = alone.select(F.col("u").alias("node")).join(known.select("node"), "node", "left_anti")
    return known.unionByName(rest.withColumn("component", F.col("node")))
