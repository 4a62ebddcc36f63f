"""Nulls, empty tables, degenerate shapes, high latitudes, ties, streams and formats of the geospatial operators."""

import math
import struct
import time

import pytest
from pyspark.sql import functions as F

from meridia.functions import geo, text
from meridia.operators import catalogue, classify, graph, places, runs, search, spatial, sync, tiles, tracks, traffic
from meridia.plans import network
from meridia.sources import formats
from meridia.streaming import ingest

POINT = "k long, lon double, lat double"
EDGE = "edge long, shape array<struct<lon: double, lat: double>>"
FIX = "event_id long, trip_id long, recorded_at timestamp, lon double, lat double, speed double, accuracy double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_nearest_edge_at_high_latitude_across_a_cell_and_without_length(spark):
    step = 19 / geo.DEGREE_M / math.cos(math.radians(60))
    points = spark.createDataFrame([(1, 10.0, 60.0), (2, 20.0, 60.0), (3, None, 1.0), (4, 50.0, 1.0)], POINT)
    edges = spark.createDataFrame([(7, [(10.0 + step, 59.999), (10.0 + step, 60.001)]), (8, [(20.0, 60.0001), (20.0, 60.0001)]), (9, [(20.0, 60.0001), (20.0, 60.0001)]), (5, None), (6, [(1.0, 1.0)])], EDGE)
    got = {r["k"]: (r["edge"], r["metres"]) for r in spatial.nearest_edges(points, edges, "k").collect()}
    assert set(got) == {1, 2} and got[1][0] == 7 and abs(got[1][1] - 19) < 0.01 and got[2] == (8, round(1e-4 * geo.DEGREE_M, 3))
    assert spatial.nearest_edges(points, edges.limit(0), "k").count() == 0 and spatial.nearest_edges(points.limit(0), edges, "k").count() == 0


def test_a_long_edge_and_a_wide_fence_touch_few_cells(spark):
    boxes = spark.createDataFrame([(1, -80.0, -3.0, -70.0, 7.0), (2, 0.0, 0.0, 0.0, 0.0)], "b long, west double, south double, east double, north double")
    assert {r["b"]: r["n"] for r in spatial.filed(boxes).groupBy("b").agg(F.count("*").alias("n")).collect()}[1] <= 4


def test_places_within_at_high_latitude_and_over_the_date_line(spark):
    side = 390 / geo.DEGREE_M / math.cos(math.radians(70))
    df = spark.createDataFrame([(1, 10.0 + side, 70.0), (2, 10.0, 70.0), (3, -179.9999, 0.0)], POINT)
    assert {r["k"] for r in spatial.within(df, 10.0, 70.0, 400.0).collect()} == {1, 2}
    assert {r["k"] for r in spatial.within(df, 179.9999, 0.0, 400.0).collect()} == {3}


def test_fence_boundary_holes_and_centre(spark):
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    fences = spark.createDataFrame([(1, 0.0, 0.0, None, [ring(0.0, 4.0), ring(1.0, 2.0)]), (2, 0.0, 0.0, 1000.0, None)], "fence long, lon double, lat double, radius double, rings array<array<struct<lon: double, lat: double>>>")
    points = spark.createDataFrame([(1, 0.0, 2.0), (2, 1.5, 1.5), (3, 3.0, 3.0), (4, 0.0, 0.008), (5, None, None), (6, 9.0, 9.0)], POINT)
    assert {(r["k"], r["fence"]) for r in spatial.inside_fences(points, fences, "k").collect()} == {(1, 1), (3, 1), (4, 1), (4, 2)}


def test_polyline_position(spark):
    df = spark.createDataFrame([(1, 0.5, 0.001, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), (2, 5.0, 5.0, [(0.0, 0.0), (0.0, 0.0)])], POINT + ", shape array<struct<lon: double, lat: double>>")
    got = {r["k"]: r["p"] for r in df.select("k", geo.locate(F.col("lon"), F.col("lat"), F.col("shape")).alias("p")).collect()}
    assert abs(got[1]["fraction"] - 0.25) < 1e-3 and abs(got[1]["lon"] - 0.5) < 1e-9 and got[2]["fraction"] == 0.0


def test_fold(spark):
    given = {"façade à la Größe": "facade a la gro e", "Malecón Simón-Bolívar (2000)": "malecon simon bolivar 2000", None: "", "Ñandú": "nandu", "é": "e"}
    df = spark.createDataFrame([(k,) for k in given], "t string")
    assert [r[0] for r in df.select(text.fold(F.col("t"))).collect()] == list(given.values())


def test_versions_and_numbers(spark):
    cases = {("2026.09", "2026.09.0"): 0, ("2026.09", "2026.09.01"): -1, ("2026.10", "2026.9"): 1, ("1.b", "1.a"): 1, (" 1-2 ", "1.2"): 0, ("", "0"): 0}
    df = spark.createDataFrame(list(cases), "a string, b string")
    assert [r[0] for r in df.select(text.versions_compared(F.col("a"), F.col("b"))).collect()] == list(cases.values())
    one = spark.createDataFrame([("500,5 - 750 mm", "12.5 m", "40'", "-2,19; -79,88", "S/N")], "a string, b string, c string, d string, e string")
    r = one.select(text.numbers_in(F.col("a")), text.metres_in(F.col("b")), text.metres_in(F.col("c")), text.point_in(F.col("d")), text.clean(F.col("e"))).collect()[0]
    assert r[0] == [500.5, 750.0] and r[1] == 12.5 and abs(r[2] - 12.192) < 1e-9 and tuple(r[3]) == (-2.19, -79.88) and r[4] is None


def test_status_and_speeds(spark):
    df = spark.createDataFrame([(1.0,), (0.75,), (0.6,), (0.3,), (0.1,)], "r double")
    assert [r[0] for r in df.select(traffic.status(F.col("r"))).collect()] == ["free", "free", "moderate", "slow", "jammed"]
    m = spark.createDataFrame([(1, t, v) for t, v in enumerate([1.0, 2.0, 3.0, 10.0])] + [(2, 0, 5.0)], "edge long, trip_id long, speed double")
    assert rows(traffic.edge_speeds(m, ["edge"], 3, 2)) == [(1, 4, 4, 10.8)]
    with pytest.raises(ValueError):
        traffic.valid_box((0, 0, 3, 1))


def test_thinning_keeps_ten_of_twenty_five(spark):
    fixes = spark.createDataFrame([(i, 1, i, -79.9 - 0.0005 * i, -2.19) for i in range(25)], "event_id long, trip_id long, recorded_at long, lon double, lat double")
    assert tracks.thinned(fixes, 10).count() == 10 and tracks.thinned(fixes.limit(0)).count() == 0
    assert 1300 < tracks.track_lengths(fixes).collect()[0]["metres"] < 1370


def test_feed_pages_over_ties(spark):
    live = spark.sql("select cast(id as long) route_id, 1L user_id, timestamp'2024-01-01' updated_at, id * 10 metres from range(4)")
    dead = spark.sql("select 9L route_id, 1L user_id, timestamp'2024-01-01' deleted_at")
    seen, after, more = [], ("2000-01-01 00:00:00", 0), True
    while more:
        page = sync.change_page(live, dead, 1, after, 2).orderBy("changed_at", "route_id").collect()
        seen += [(r["route_id"], r["deleted"]) for r in page]
        more, after = page[-1]["more"], (str(page[-1]["changed_at"]), page[-1]["route_id"])
    assert seen == [(0, False), (1, False), (2, False), (3, False), (9, True)]


def test_components_of_lone_nodes_and_loops(spark):
    nodes = spark.range(6).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 1), (4, 4)], "u long, v long")
    assert rows(graph.components(nodes, edges)) == [(0, -1, 0), (1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1), (5, -1, 0)]
    assert graph.components(nodes, edges.limit(0)).filter("component >= 0").count() == 0


def test_smoothing(spark):
    flags = [1, 0, 0, 1, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0]
    df = spark.createDataFrame([(1, i, bool(f)) for i, f in enumerate(flags)], "p long, i long, f boolean")
    assert [r["smooth"] for r in runs.smoothed(df, "p", ["i"], "f", 4).orderBy("i").collect()] == [True] * 5 + [False] * 9


def test_families(spark):
    given = {"Alborada IX Etapa": ["Alborada"], "Urb. Kennedy Norte - I Etapa / Sector A": ["Kennedy Norte", "Kennedy"], "Urdesa Central": ["Urdesa"], "Urdesa": []}
    df = spark.createDataFrame([(k,) for k in given], "n string")
    assert [r[0] for r in df.select(catalogue.families(F.col("n"))).collect()] == list(given.values())


def test_classes(spark):
    df = spark.createDataFrame([("Consultorio dental", "ACTIVO"), ("Ambulancia", None), ("Hospital general", "CERRADO"), ("x", None)], "t string, s string")
    got = [r[0] and r[0]["subclass"] for r in df.select(classify.health_class(F.col("t"), F.col("s"))).collect()]
    assert got == ["doctor", None, None, "clinic"]
    h = spark.createDataFrame([("12 m", None), (None, "3"), ("5000", None)], "h string, l string")
    none = F.lit(None).cast("string")
    assert [r[0]["height"] for r in h.select(classify.building_height(F.col("h"), F.col("l"), none, none)).collect()] == [12.0, 9.0, None]


def test_search_against_plain_code(spark):
    """Ranks of all entries by the same rules in plain code, near duplicates left out in order."""
    entries = [r.asDict() for r in network.search_entries(spark, "/root/testdata/sf0.001").collect()]
    soft = set(text.SOFT_WORDS)
    import re
    import unicodedata

    fold = lambda t: re.sub("[^0-9a-z]+", " ", "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not "̀" <= c <= "ͯ")).strip()
    for query, asked, lon, lat in network.ASKED:
        words = fold(asked).split()
        need = [w for w in words if w not in soft] or words
        hits = []
        for e in entries:
            name, around = fold(e["name"]).split(), fold(e["context"]).split()
            ok, met, only = True, set(), 0
            for w in need:
                forms = [w] + ([w[:-2]] if len(w) > 4 and w.endswith("es") else []) + ([w[:-1]] if len(w) > 3 and w.endswith("s") else [])
                open_ = not asked[-1].isspace() and w == words[-1] and len(w) >= 2
                fits = lambda x: x in forms or open_ and x.startswith(w)  # noqa: B023, E731
                first = next((x for x in name if fits(x)), None)
                if first:
                    met.add(first)
                elif any(map(fits, around)):
                    only += 1
                else:
                    ok = False
            if not ok or not met:
                continue
            hard = [w for w in name if w not in soft]
            area = e["kind"] in ("admin", "place")
            exact = " ".join(name) == fold(asked)
            km = math.hypot((e["lon"] - lon) * math.cos(math.radians(lat)), e["lat"] - lat) * geo.DEGREE_M / 1000
            near = 80 * math.exp(-km / 15) + 15 * math.exp(-km / 150) if e["kind"] in ("poi", "street") or e["type"] == "suburb" else 15 * math.exp(-km / 50) if e["type"] in search.MAJOR else 40 * math.exp(-km / 15) + 10 * math.exp(-km / 150)
            score = e["rank"] + 60 * sum(w in met for w in hard) / max(1, len(hard)) + 20 * exact + exact * area * search.EXACT_BONUS.get(e["type"], 0) + 10 * " ".join(name).startswith(fold(asked)) - 6 * only + near
            hits.append((round(score, 6), e, area))
        hits.sort(key=lambda h: (-h[0], len(h[1]["name"]), h[1]["entry"]))
        kept = []
        for score, e, area in hits:
            reach = 0.2 if area else 0.003
            if not any(fold(o["name"]) == fold(e["name"]) and a == area and abs(o["lon"] - e["lon"]) < reach and abs(o["lat"] - e["lat"]) < reach for _, o, a in kept):
                kept.append((score, e, area))
        got = search.search(network.search_entries(spark, "/root/testdata/sf0.001"), network.asked(spark).filter(F.col("query") == query)).orderBy("place").collect()
        assert [r["entry"] for r in got] == [e["entry"] for _, e, _ in kept[:10]]


def test_world_search(spark):
    cols = "id long, name string, name_es string, type string, country string, country_es string, country_code string, admin1 string, capital string, population long"
    df = spark.createDataFrame([(1, "Lima", None, "city", "Peru", "Perú", "PE", None, "2", 9), (2, "Lima Norte", None, "city", "Peru", None, "PE", None, None, 5), (3, "Nueva Lima", None, "city", "Spain", "España", "ES", None, None, 2_000_000)], cols)
    q = spark.createDataFrame([(1, "LIMA"), (2, "lima, per"), (3, "lima espana"), (4, "zz"), (5, None)], "query long, text string")
    got = [(r["query"], r["place"], r["id"], r["important"]) for r in search.world_search(df, q).orderBy("query", "place").collect()]
    assert got == [(1, 1, 1, True), (1, 2, 2, False), (1, 3, 3, False), (2, 1, 1, True), (2, 2, 2, False), (3, 1, 3, False)]


def test_curve_neighbours(spark):
    got = sorted(spark.range(256).select(tiles.hilbert(F.col("id") % 16, F.expr("id div 16"), 4).alias("h"), F.col("id") % 16, F.expr("id div 16")).collect())
    assert [r[0] for r in got] == list(range(85, 341)) and all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(got, got[1:]))


def test_regions_held_and_equal(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, 9.0, 9.0), ("b", 1.0, 1.0, 2.0, 2.0), ("c", 0.0, 0.0, 9.0, 9.0), ("d", 50.0, 0.0, 51.0, 1.0)], "code string, west double, south double, east double, north double")
    assert {r["code"] for r in places.outermost(df).collect()} == {"a", "d"}


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", ""), (2, None, "x")], "id long, name string, other string")
    formats.write_lines(df, f"{tmp_path}/n")
    assert rows(formats.read_lines(spark, f"{tmp_path}/n", "id long, name string, other string")) == [(1, "a", None), (2, None, "x")]
    pts = df.withColumn("g", formats.point_json(F.lit(1.5), F.lit(2.5)))
    formats.write_feature_lines(pts, f"{tmp_path}/f", "g")
    got = formats.read_feature_lines(spark, f"{tmp_path}/f").collect()
    assert {r["type"] for r in got} == {"Point"} and len(got) == 2
    (tmp_path / "c.json").write_text('{"type":"FeatureCollection","features":[{"id":"q","properties":{"n":1},"geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]}}]}')
    r = formats.read_geojson(spark, f"{tmp_path}/c.json").withColumn("s", formats.shape_of(F.col("geometry"))).collect()[0]
    assert r["id"] == "q" and [tuple(p) for p in r["s"]] == [(1.0, 2.0), (3.0, 4.0)]


def test_wkb_and_polylines(spark):
    point = struct.pack("<BIdd", 1, 1, 1.0, 2.0)
    line = struct.pack(">BIIdddd", 0, 2, 2, 1.0, 2.0, 3.0, 4.0)
    poly_z = struct.pack("<BIII", 1, 1003, 1, 2) + struct.pack("<6d", 0, 0, 9, 1, 1, 9)
    gpkg = b"GP\0\1" + struct.pack("<i", 4326) + struct.pack("<BIIBIdd", 1, 4, 1, 1, 1, 5.0, 6.0)
    df = spark.createDataFrame([(bytearray(b),) for b in (point, line, poly_z, gpkg)] + [(None,)], "b binary")
    got = [r[0] and [[tuple(p) for p in part] for part in r[0]] for r in df.select(formats.from_wkb(F.col("b"))).collect()]
    assert got == [[[(1.0, 2.0)]], [[(1.0, 2.0), (3.0, 4.0)]], [[(0.0, 0.0), (1.0, 1.0)]], [[(5.0, 6.0)]], None]
    s = spark.createDataFrame([([(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)],)], "s array<struct<lon: double, lat: double>>")
    t = s.withColumn("t", formats.polyline(F.col("s")))
    assert t.collect()[0]["t"] == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert [(p["lon"], p["lat"]) for p in t.select(formats.from_polyline(F.col("t"))).collect()[0][0]] == [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)]


def test_stream_equals_batch(spark, tmp_path):
    rows_ = [(i, i % 3, f"2024-01-01 00:{i % 20:02d}:00", -79.9, -2.2 if i % 11 else 95.0, 1.0, None) for i in range(60)]
    df = spark.createDataFrame(rows_, FIX.replace("recorded_at timestamp", "recorded_at string")).withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    for i, part in enumerate((df.filter("event_id < 40"), df.filter("event_id >= 20"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ingest.FIXES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ingest.into_table(stream, f"{tmp_path}/out", f"{tmp_path}/bad", "2024-01-02 00:00:00", f"{tmp_path}/check").awaitTermination()
        time.sleep(0.01)
    got = ingest.existing(spark, f"{tmp_path}/out")
    want = sync.ingested(df.limit(0), df, "2024-01-02 00:00:00")[0]
    key = lambda d: {(r["trip_id"], r["recorded_at"]) for r in d.collect()}
    assert key(got) == key(want) and got.count() == want.count()
    assert ingest.touched_lengths(spark, f"{tmp_path}/out", 0).count() == 3


def test_sliding_speeds_in_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, f"2024-01-01 00:{i:02d}:00", -79.9, -2.2, float(i), None) for i in range(30)], FIX.replace("recorded_at timestamp", "recorded_at string")).withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    q = ingest.sliding_speeds(spark.readStream.schema(ingest.FIXES).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("sliding").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("sliding")) == rows(ingest.sliding_speeds(df))
