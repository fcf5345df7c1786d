"""The operators' inputs, cut from the driver's tables, as DataFrames and as the same CTEs for the SQL twins.

A traveller's events are a track (``pts``), its kilometre axis (``km``) grows with the event id; customers and suppliers
get places from their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PTS = """pts AS (SELECT user_id AS trail_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS idx,
  -35 + ((event_id * 37) % 1000) / 10000.0 AS lat, 148 + ((event_id * 53) % 1000) / 10000.0 AS lon, value AS ele,
  event_id % 17 = 0 AS is_break, event_id, event_type, event_id / 100.0 AS km FROM events)"""
ENDS = """ends AS (SELECT user_id AS trail_id, 0.0 AS start_km, max(event_id) / 100.0 + 3 AS end_km FROM events GROUP BY user_id)"""
CUST = """cust AS (SELECT c_custkey AS place_id, (c_custkey * 7919 % 9000) / 1000.0 - 39 AS lat, (c_custkey * 104729 % 9000) / 1000.0 + 144 AS lon, c_name, c_mktsegment FROM customer)"""
SUPP = """supp AS (SELECT s_suppkey AS spot_id, (s_suppkey * 6151 % 9000) / 1000.0 - 39 AS lat, (s_suppkey * 3571 % 9000) / 1000.0 + 144 AS lon FROM supplier)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    idx = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    return e.select(
        F.col("user_id").alias("trail_id"), idx.alias("idx"), (-35 + ((F.col("event_id") * 37) % 1000) / 10000.0).alias("lat"),
        (148 + ((F.col("event_id") * 53) % 1000) / 10000.0).alias("lon"), F.col("value").alias("ele"), (F.col("event_id") % 17 == 0).alias("is_break"),
        "event_id", "event_type", (F.col("event_id") / 100.0).alias("km"),
    )


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("trail_id"))
    return e.agg(F.lit(0.0).alias("start_km"), (F.max("event_id") / 100.0 + 3).alias("end_km"))


def cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("place_id"), ((k * 7919 % 9000) / 1000.0 - 39).alias("lat"), ((k * 104729 % 9000) / 1000.0 + 144).alias("lon"), "c_name", "c_mktsegment")


def supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("spot_id"), ((k * 6151 % 9000) / 1000.0 - 39).alias("lat"), ((k * 3571 % 9000) / 1000.0 + 144).alias("lon"))


def hav(a: str, b: str, c: str, d: str) -> str:
    """Haversine metres in SQL."""
    h = f"(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2))"
    return f"(2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def rnd(x: str, n: int) -> str:
    return f"(floor(({x}) * 1e{n} + 0.5) / 1e{n})"
