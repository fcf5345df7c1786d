"""Queries that take whole tables, against brute force on the smallest ones."""

import duckdb
import pytest

from trekframe.operators.spatial import visits
from trekframe.plans import load_queries

SF = "/root/testdata/sf0.001"
QUERIES, TWINS = load_queries()


def test_components_over_all_of_lineitem(spark):
    edges = duckdb.sql(f"SELECT DISTINCT l_partkey, l_suppkey + 1000000 FROM read_parquet('{SF}/lineitem.parquet')").fetchall()
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = QUERIES["set08_components"](spark, SF).collect()
    assert len(got) == len(root) and {r.node: r.component for r in got} == {n: find(n) for n in root}


@pytest.mark.parametrize("name", ["jon14_snap_to_track", "jon13_visits"])
def test_all_suppliers_and_all_customers_take_part(spark, name):
    sf = SF.replace("0.001", "0.01")  # ten suppliers give no nation a trail
    con = duckdb.connect()
    for t in ("customer", "supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    frame = QUERIES[name](spark, sf)
    got = sorted(tuple(r) for r in frame.collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(frame.columns)} FROM ({TWINS[name]})").fetchall())
    if name == "jon13_visits":
        assert len({r[0] for r in got if r[0] >= 60}) > 1000
    else:
        trails = con.execute("SELECT count(*) FROM (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) > 1)").fetchone()[0]
        assert trails - 3 <= len({r[1] for r in got}) <= trails


def test_all_names_in_order(spark):
    want = duckdb.sql(f"SELECT p_partkey FROM read_parquet('{SF}/part.parquet') ORDER BY lower(p_name), p_partkey").fetchall()
    got = QUERIES["srt09_sorted_names"](spark, SF).collect()
    assert [(r.p_partkey, r.place) for r in got] == [(k, i + 1) for i, (k,) in enumerate(want)] and len(got) > 60


def test_entities_of_the_whole_text(spark, tmp_path):
    spark.createDataFrame([(1, "far from here &lt; &#65;"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.decoded for r in QUERIES["str12_python_text"](spark, str(tmp_path)).collect()}
    assert got == {1: "&é&#0;far from here < A", 2: None}


def test_the_end_of_a_loop_is_no_second_visit(spark):
    out = [(-35.0, 148.0 + k / 500) for k in range(40)]
    loop = [*out, *((-34.9, lon) for _, lon in out[::-1]), (-35.0, 148.0)]
    line = [*out, *out[::-1][:-5]]  # comes back, but not to its start
    rows = [(t, i, lat, lon) for t, points in ((1, loop), (2, line)) for i, (lat, lon) in enumerate(points)]
    points = spark.createDataFrame(rows, "trail_id long, idx long, lat double, lon double")
    places = spark.createDataFrame([(7, -35.0, 148.0), (8, -35.0, 148.02)], "place_id long, lat double, lon double")

    def seen(merge):
        return sorted((r.trail_id, r.place_id, r.visit, r.idx) for r in visits(places, points, 200, merge_loops=merge).collect())

    assert seen(False) == [(1, 7, 1, 0), (1, 7, 2, 80), (1, 8, 1, 10), (2, 7, 1, 0), (2, 8, 1, 10), (2, 8, 2, 69)]
    assert seen(True) == [v for v in seen(False) if v != (1, 7, 2, 80)]
