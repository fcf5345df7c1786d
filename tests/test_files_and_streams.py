import json
import math

from pyspark.sql import functions as F

from trekframe.operators.graph import connected_components
from trekframe.operators.sync import decode_cursor, encode_cursor
from trekframe.sources import files, sinks
from trekframe.streaming import feeds

GPX = """<?xml version="1.0"?><gpx xmlns:tn="urn:x"><trk><name>Main &amp; more</name><trkseg><trkpt lat="-35.0" lon="2"><ele>10</ele></trkpt><trkpt lat="-35.1" lon="2.5"><time> </time></trkpt></trkseg>
<trkseg><trkpt lat="99" lon="2"><ele>abc</ele></trkpt></trkseg></trk><rte><name>r</name><rtept lat="1" lon="1"/></rte>
<wpt lat="-35" lon="148"><name>Hut</name><type> Hut </type><extensions><tn:offTrailKm>1.5</tn:offTrailKm><tn:accessMode>teleport</tn:accessMode><tn:offTrailAscentM>-4</tn:offTrailAscentM></extensions></wpt></gpx>"""


def test_gpx_in_and_out(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(GPX)
    points = files.read_gpx_points(spark, str(tmp_path))
    rows = points.orderBy("segment", "seq").collect()
    assert [(r.segment, r.seq, r.lat, r.lon, r.ele, r.time) for r in rows] == [(0, 0, -35.0, 2.0, 10.0, None), (0, 1, -35.1, 2.5, 0.0, None), (1, 0, None, 2.0, 0.0, None)]
    assert files.bad_points(points).count() == 1
    w = files.read_gpx_waypoints(spark, str(tmp_path)).first()
    assert (w.name, w.type, w.off_trail_km, w.access_mode, w.off_trail_ascent_m) == ("Hut", "hut", 1.5, None, None)
    good = points.where("lat is not null").withColumn("idx", F.col("seq"))
    text = sinks.gpx_documents(good).first().gpx
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "out.gpx").write_text(text)
    again = files.read_gpx_points(spark, str(tmp_path / "b")).orderBy("seq").collect()
    assert [(r.track, r.lat, r.ele) for r in again] == [("Main & more", -35.0, 10.0), ("Main & more", -35.1, 0.0)]


def test_routes_stand_in_for_tracks(spark, tmp_path):
    (tmp_path / "r.gpx").write_text('<gpx><rte><name>r</name><rtept lat="1" lon="1"/><rtept lat="2" lon="1"/></rte></gpx>')
    assert files.read_gpx_points(spark, str(tmp_path)).count() == 2


def test_json_files(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return str(tmp_path / name)

    pois = put("p.json", {"trailId": "t", "rejected": ["node/2"], "pois": [{"id": 1, "type": "node", "lat": 1.0, "lon": 2.0, "tags": {"a": "b"}}, {"id": 2, "type": "node", "lat": 1.0, "lon": 2.0}, {"id": 3, "type": "blob", "lat": 1.0, "lon": 2.0}, {"id": 4, "type": "way"}]})
    assert [r.key for r in files.read_pois(spark, pois).collect()] == ["node/1"]
    over = put("o.json", {"elements": [{"type": "way", "id": 1, "center": {"lat": 1.0, "lon": 2.0}}, {"type": "node", "id": 2}]})
    assert [(r.id, r.lat) for r in files.read_overpass(spark, over).collect()] == [(1, 1.0)]
    climate = put("c.json", {"location": "x", "daily": {"time": ["2025-01-01", "2025-01-02"], "temperature_2m_max": [20.0, None], "temperature_2m_min": [5.0, 6.0], "precipitation_sum": [0.0, 4.0]}})
    assert [(str(r.day), r.t_max, r.rain) for r in files.read_daily_climate(spark, climate).collect()] == [("2025-01-01", 20.0, 0.0), ("2025-01-02", None, 4.0)]
    geo = put("g.json", {"features": [{"id": "f", "properties": {"class": "Folder", "title": "Huts"}}, {"id": "m", "geometry": {"type": "Point", "coordinates": [148.0, -35.0]}, "properties": {"class": "Marker", "title": " A ", "folderId": "f"}}]})
    m = files.read_markers(spark, geo).first()
    assert (m.name, m.folder, m.lat, m.lon) == ("A", "Huts", -35.0, 148.0)
    access = put("a.json", {"trailId": "t", "places": {"w1": {"method": "osm", "junction": [1.0, 2.0], "offTrailKm": 1.0}, "w2": {"method": "none"}, "w3": {"store": "yes"}}})
    assert {r.waypoint_id: r.valid for r in files.read_access(spark, access).collect()} == {"w1": True, "w2": False, "w3": True}
    texts = put("d.json", {"trailId": "t", "descriptions": [{"id": "a", "description": " x "}, {"id": "b", "description": ""}, {"id": "c", "description": "1"}, {"id": "c", "description": "2"}]})
    assert {(r.waypoint_id, r.refused) for r in files.read_descriptions(spark, texts, "t").collect()} == {("a", None), ("b", "empty"), ("c", "repeated")}
    good, bad = files.read_handoff(spark.createDataFrame([('{"a": 1}',), ("nonsense",)], "t string"), "t", "a int")
    assert [r.a for r in good.collect()] == [1] and bad.count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c', None)], "x int, y string, z string")
    assert sinks.csv_lines(rows).first().value == '1,"a ""b"", c",'
    line = spark.createDataFrame([(1, 0, 0, 1.0, 2.0), (1, 0, 1, 1.5, 2.0), (1, 1, 2, 9.0, 9.0)], "trail_id int, stretch int, idx int, lat double, lon double")
    assert json.loads(sinks.line_features(line).first().geometry)["coordinates"] == [[[2.0, 1.0], [2.0, 1.5]]]
    listed = sinks.publish(spark.createDataFrame([("a", "x"), ("b", "yy")], "id string, content string"), str(tmp_path / "pub"))
    assert {(r.id, r.bytes) for r in listed.collect()} == {("a", 1), ("b", 2)}


def test_cursors_and_pages():
    assert decode_cursor(encode_cursor("2024|1", "x")) == ("2024", "1|x")


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 100), (200, None)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100}


def test_pull_is_applied_once(spark, tmp_path):
    schema = "id long, v string, t long, deleted_at string"
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "a", 1, None), (2, "b", 1, None)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: feeds.pull_into(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "t"), "id", "t", str(tmp_path / "c")).awaitTermination()
    run()
    spark.createDataFrame([(1, None, 3, "gone"), (2, "old", 0, None), (3, "c", 1, None)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()
    rows = feeds.current(spark, str(tmp_path / "t")).where("deleted_at is null").collect()
    assert {(r.id, r.v) for r in rows} == {(2, "b"), (3, "c")}


def test_stream_rate_limit_equals_the_batch(spark):
    from trekframe.plans import load_queries

    q, _ = load_queries()
    a, b = (sorted(map(tuple, q[n](spark, "/root/testdata/sf0.001").collect())) for n in ("stm04_rate_limit", "stm04_rate_limit_stream"))
    assert a == b


def test_mobile_documents_are_thinned_by_stretch(spark):
    """All trails of the smallest tables: each stretch to its share of the target, breaks moved, climbs kept, as in a plain loop."""
    import numpy as np

    from trekframe.operators.sequential import simplify_to_target
    from trekframe.plans.files import snk06
    from trekframe.plans.tracks import measured

    sf = "/root/testdata/sf0.001"
    tracks = {}
    for r in sorted(measured(spark, sf).collect(), key=lambda r: (r.trail_id, r.idx)):
        tracks.setdefault(r.trail_id, []).append(r)
    rounded = lambda x, n=0: math.floor(x * 10**n + 0.5) / 10**n
    got = {r.trail_id: r for r in snk06(spark, sf).collect()}
    assert set(got) == set(tracks)
    several = 0
    for trail, rows in tracks.items():
        stretches = [[]]
        for r in rows:
            if r.is_break and stretches[-1]:
                stretches.append([])
            stretches[-1].append(r)
        kept, breaks = [], []
        for stretch in stretches:
            if kept:
                breaks.append(len(kept))
            at = simplify_to_target(np.array([r.lat for r in stretch]), np.array([r.lon for r in stretch]), max(2, math.floor(20 * len(stretch) / len(rows) + 0.5)))
            kept += [stretch[k] for k in at]
        several += len(breaks) > 1
        variants = {}
        for r in rows:
            if r.idx // 10 % 2 == 1:
                variants.setdefault(r.idx // 10, []).append(r)
        lines = [",".join(str(v[k].idx) for k in simplify_to_target(np.array([r.lat + 0.001 for r in v]), np.array([r.lon for r in v]), 6)) for _, v in sorted(variants.items())]
        out = got[trail]
        assert (out.points, out.breaks) == (",".join(str(r.idx) for r in kept), ",".join(map(str, breaks)))
        assert out.last_ascent == rounded(rounded(kept[-1].cum_ascent, 6)) and out.dist == rounded(max(r.dist for r in rows), 1)
        assert out.variants == ";".join(lines) and out.waypoints == sum(r.event_type == "purchase" for r in rows)
        places = 0 if trail % 3 == 0 else len(rows)
        assert out.pois == (places if trail % 5 else None)
    assert several > 3
