"""Instructions, legs, slices and stored routes against plain code."""

import math

import pytest
from pyspark.sql import functions as F

from meridia.functions import linear
from meridia.operators import graph, guidance, legs, merge, repair, spatial, stored, validity
from meridia.plans import guiding
from meridia.sources.staging import cut
from meridia.sources.tables import APPROXIMATE, CONNECTOR, ROUNDABOUT, STATE, road_edges

LINE = "array<struct<lon: double, lat: double>>"
EDGE = f"edge long, u long, v long, name string, cls int, ref string, flags int, shape {LINE}"
D = 1 / 111195.08  # a metre near the equator


def straight(edge, u, v, a, b, name=None, cls=5, ref=None, flags=0):
    return (edge, u, v, name, cls, ref, flags, [(a[0] * D, a[1] * D), (b[0] * D, b[1] * D)])


# east along A, a connector, A again, a short stretch of B, A, a roundabout of two pieces with an exit in between, north along E1 (C), a guessed stretch, an unnamed lane
EDGES = [
    straight(1, 0, 1, (0, 0), (200, 0), "A"), straight(2, 1, 2, (200, 0), (260, 0), None, CONNECTOR), straight(3, 2, 3, (260, 0), (400, 0), "A"), straight(4, 3, 4, (400, 0), (420, 0), "B"), straight(5, 4, 5, (420, 0), (600, 0), "A"),
    straight(6, 5, 6, (600, 0), (620, 20), None, 5, None, ROUNDABOUT), straight(7, 6, 7, (620, 20), (600, 40), None, 5, None, ROUNDABOUT), straight(8, 7, 8, (600, 40), (600, 300), "C", 2, "E1", STATE),
    straight(9, 8, 9, (600, 300), (600, 1800), None, CONNECTOR, None, APPROXIMATE), straight(10, 9, 10, (600, 1800), (500, 1800), None, 6), straight(11, 6, 11, (620, 20), (700, 20), "X"), straight(12, 7, 12, (600, 40), (500, 40), "Y"),
]


@pytest.fixture(scope="module")
def network(spark):
    return spark.createDataFrame(EDGES, EDGE)


@pytest.fixture(scope="module")
def way(spark, network):
    snaps = spark.createDataFrame([(1, 1, 0.25, 10, 0.5), (2, 10, 0.5, 10, 0.25), (3, 1, 0.75, 1, 0.75)], "request long, from_edge long, from_part double, to_edge long, to_part double")
    return legs.legs(network, snaps, "CAR").cache()


def test_leg_pieces(way):
    got = [tuple(r)[1:6] for r in way.filter("request = 1").orderBy("seq").collect()]
    assert got == [(0, 1, False, 0.25, 1.0), *[(i - 1, i, False, 0.0, 1.0) for i in range(2, 10)], (9, 10, False, 0.0, 0.5)]
    assert [tuple(r)[1:6] for r in way.filter("request = 2").collect()] == [(0, 10, True, 0.5, 0.25)]
    assert [tuple(r)[1:7] for r in way.filter("request = 3").collect()] == [(0, 1, False, 0.75, 0.75, 0.0)]


def test_instructions_of_every_rule(spark, network, way):
    trip = spark.createDataFrame([(7, 0, 1), (7, 1, 2)], "trip long, leg int, request long")
    for language, texts in (("es", [
        "Dirígete al este por A", "En el redondel, toma la segunda salida hacia E1 (C)", "Sal del redondel por E1 (C)", "Continúa por el acceso local (tramo aproximado de 1,5 km, sin vía registrada)", "Gira a la izquierda en el pasaje", "Llegaste a la parada 1",
        "Desde la parada, dirígete al este por el pasaje", "Llegaste a tu destino"]), ("en", [
        "Head east on A", "At the roundabout, take the second exit onto E1 (C)", "Exit the roundabout onto E1 (C)", "Continue on the local access road (approximate stretch of 1.5 km, not mapped)", "Turn left onto the lane", "You have arrived at stop 1",
        "From the stop, head east on the lane", "You have arrived at your destination"])):
        got = guidance.steps(way, network, trip, language).orderBy("leg", "step").collect()
        assert [r["text"] for r in got] == texts
    assert [r["maneuver"] for r in got] == ["DEPART", "ROUNDABOUT_ENTER", "ROUNDABOUT_EXIT", "OTHER", "TURN_LEFT", "WAYPOINT", "WAYPOINT", "ARRIVE"]
    assert [r["metres"] for r in got] == [550, 57, 260, 1500, 50, 0, 25, 0]
    alone = guidance.steps(way, network, spark.createDataFrame([(9, 0, 3)], "trip long, leg int, request long")).orderBy("step").collect()
    assert [(r["text"], r["metres"], r["first"], r["last"]) for r in alone] == [("Dirígete al norte por A", 0, 0, 0), ("Llegaste a tu destino", 0, 0, 0)]
    route = legs.routes_of(way, trip, network).first()
    assert got[-1]["last"] == len(route["shape"]) - 1 and [r["first"] for r in got] == sorted(r["first"] for r in got)
    assert route["approximate"] == pytest.approx(1500, abs=1) and abs(sum(r["metres"] for r in got) - route["metres"]) < 4


def plain_runs(pieces):
    """(key, metres) by reading pieces one by one and then looking at each run's neighbours."""
    runs = []
    for p in pieces:
        key = "approximate" if p["flags"] & APPROXIMATE else "roundabout" if p["flags"] & ROUNDABOUT else "n" + p["name"] if p["name"] else "r" + p["ref"] if p["ref"] else "" if p["cls"] == CONNECTOR else f"c{p['cls']}"
        if runs and key in ("", runs[-1][0]):
            runs[-1][1] += p["metres"]
        else:
            runs.append([key or f"c{p['cls']}", p["metres"]])
    i = 1
    while i < len(runs) - 1:
        if runs[i][1] < 25 and runs[i - 1][0] == runs[i + 1][0] and runs[i][0] != "roundabout":
            runs[i - 1][1] += runs[i][1] + runs[i + 1][1]
            del runs[i : i + 2]
        else:
            i += 1
    return [(k, round(m, 1)) for k, m in runs]


def test_runs_of_the_road_graph(spark):
    sf = "/root/testdata/sf0.01"
    e = road_edges(spark, sf).cache()
    p = legs.legs(e, guiding.snaps(spark, sf), "CAR").cache()
    rows = {}
    for r in p.join(e.select("edge", "name", "ref", "cls", "flags"), "edge").orderBy("request", "seq").collect():
        rows.setdefault(r["request"], []).append(r)
    got = guidance.road_runs(p, e).select("request", F.transform("runs", lambda r: F.struct(r["key"].alias("key"), r["metres"].alias("metres"))).alias("r")).collect()
    assert len(got) == len(rows) > 100
    for r in got:
        assert [(x["key"], round(x["metres"], 1)) for x in r["r"]] == plain_runs(rows[r["request"]])


def test_artefacts_do_not_join_twice(spark):
    """X, then short P, Q, R of which P and R are one road: they join first, and the joined run does not join X again."""
    names = [("X", 100), ("P", 5), ("Q", 3), ("P", 5), ("X", 100), ("X2", 10), ("X", 50)]
    at, edges = 0, []
    for i, (n, m) in enumerate(names):
        edges.append(straight(i, i, i + 1, (at, 0), (at + m, 0), n))
        at += m
    e = spark.createDataFrame(edges, EDGE)
    p = spark.createDataFrame([(1, i, i, False, 0.0, 1.0, float(m), 1000, 0) for i, (_, m) in enumerate(names)], "request long, seq int, edge long, reverse boolean, a double, b double, metres double, ms long, delay int")
    runs = guidance.road_runs(p, e).first()["runs"]
    assert [(r["key"], r["metres"]) for r in runs] == [("nX", 100.0), ("nP", 13.0), ("nX", 160.0)]
    assert [len(r["points"]) for r in runs] == [2, 4, 4]


def test_slices(spark):
    shape = [(0.0, 0.0), (3.0, 0.0), (3.0, 4.0), (3.0, 4.0)]
    df = spark.createDataFrame([(shape, a, b) for a, b in ((0.0, 1.0), (0.25, 0.75), (0.75, 0.25), (0.5, 0.5), (0.0, 0.0))], f"shape {LINE}, a double, b double")
    got = [[tuple(p) for p in r[0]] for r in df.select(linear.cut_by_share(F.col("shape"), F.col("a"), F.col("b"))).collect()]
    assert got[0] == [(0.0, 0.0), (3.0, 0.0), (3.0, 4.0), (3.0, 4.0)] or got[0][0] == (0.0, 0.0) and got[0][-1] == (3.0, 4.0)
    assert got[2] == got[1][::-1] and got[1][1] == (3.0, 0.0) and got[3][0] == got[3][-1] and got[4][0] == got[4][-1] == (0.0, 0.0)
    one = spark.createDataFrame([(shape[:3],)], f"shape {LINE}")
    s = F.col("shape")
    q = one.select(
        linear.position(s, F.lit(1.0), F.lit(0.1), F.lit(0.0)), linear.position(s, F.lit(1.0), F.lit(0.1), F.lit(0.5)), linear.position(s, F.lit(1.0), F.lit(0.1), F.lit(2.0)), linear.between(s, F.lit(0.5), F.lit(1.5)), linear.between(s, F.lit(1.0), F.lit(1.0)), linear.between(s, F.lit(0.0), F.lit(2.0))).first()
    assert q[0] == pytest.approx(1 / 3) and q[1] == 0.5 and q[2] == 2.0
    assert [tuple(p) for p in q[3]] == [(1.5, 0.0), (3.0, 0.0), (3.0, 2.0)] and [tuple(p) for p in q[4]] == [(3.0, 0.0)] and len(q[5]) == 3


def test_stored_route_is_trimmed(spark):
    shape = [(i * 0.001, 0.0) for i in range(11)]
    step = "array<struct<first: int, last: int, metres: double, seconds: double, maneuver: string, text: string, names: array<string>>>"
    steps = [(0, 4, 400.0, 40.0, "DEPART", "go", ["Uno"]), (4, 8, 400.0, 80.0, "TURN_LEFT", "left", []), (8, 10, 200.0, 20.0, "CONTINUE", "on", []), (10, 10, 0.0, 0.0, "ARRIVE", "there", [])]
    routes = spark.createDataFrame([(5, "CAR", 140.0, shape, steps), (6, "CAR", 140.0, shape[::-1], steps), (7, "CAR", 99.0, shape, [])], f"route long, profile string, seconds double, shape {LINE}, steps {step}")
    ask = [(1, "CAR", 0.002, 0.0001, 0.007, 0.001, None), (2, "CAR", 0.0, 0.0, 0.01, 0.0, [(0.005, 0.0)]), (3, "CAR", 0.0, 0.0, 0.004, 0.0, [(0.006, 0.0)]), (4, "TRUCK", 0.0, 0.0, 0.01, 0.0, None), (5, "CAR", 0.0, 0.01, 0.01, 0.0, None)]
    got = {(r["request"], r["route"]): r for r in stored.offered(spark.createDataFrame(ask, f"request long, profile string, lon1 double, lat1 double, lon2 double, lat2 double, stops {LINE}"), routes).collect()}
    # the third asks for a stop behind its end: the nearest place ahead of the stop is too far away
    assert set(got) == {(1, 5), (1, 7), (2, 5), (2, 7)}
    r = got[1, 5]
    assert [(s["text"], s["maneuver"], s["first"], s["last"]) for s in r["steps"]] == [("Continúe por Uno.", "DEPART", 0, 2), ("left", "TURN_LEFT", 2, 5), ("Fin de la ruta guardada. Su destino está a 111 m.", "ARRIVE", 5, 5)]
    assert r["seconds"] == pytest.approx(20 + 60) and len(r["shape"]) == 6
    assert got[2, 5]["seconds"] == 140.0 and [s["text"] for s in got[2, 5]["steps"]] == ["go", "left", "on", "there"]
    assert got[1, 7]["seconds"] == pytest.approx(99.0 * 0.5)


def test_rejoined_ends_are_junctions(spark):
    """Every joined end shares a component with what it was joined to, and nothing else changes its length."""
    from meridia.plans import mending

    lines = mending.drawn(spark, "/root/testdata/sf0.001").cache()
    places = repair.joins(lines).cache()
    assert {r[0] for r in places.select("rule").distinct().collect()} == {1, 2, 3, 4, 5}
    parts = graph.noded(repair.rejoined(lines, places)).cache()
    before = graph.noded(lines).agg(F.sum("metres")).first()[0]
    drawn = parts.filter("line >= 0").agg(F.sum("metres")).first()[0]
    assert abs(before - drawn) < 0.5  # vertices put in are rounded to six digits
    number = {k: i for i, k in enumerate(sorted({r[c] for r in parts.select("u", "v").collect() for c in (0, 1)}))}
    df = spark.createDataFrame([(number[r["u"]], number[r["v"]]) for r in parts.collect()], "u long, v long")
    root = {r["node"]: r["root"] for r in graph.stars(df).collect()}
    ends = {(r["line"], r["i"]): r["key"] for r in graph.vertices(lines).collect()}
    key = lambda lon, lat: f"{round(lon * 1e6)}:{round(lat * 1e6)}"
    for r in places.collect():
        a, b = number[ends[r["line"], r["i"]]], number[key(r["plon"], r["plat"])]
        assert root.get(a, a) == root.get(b, b)


def test_bounded_search_against_a_heap(spark):
    """Loose ends see a node as joined exactly where a heap reaches it within the bound of its request."""
    import heapq

    from meridia.operators import paths

    edges = road_edges(spark, "/root/testdata/sf0.001").cache()
    steps = graph.priced(edges, "CAR").withColumnRenamed("ms", "price").cache()
    near = {}
    for r in steps.collect():
        near.setdefault(r["u"], []).append((r["v"], r["price"]))
    asked = [(1, 0, 20_000), (2, 77, 60_000), (3, 199, 5), (4, 105, None)]
    at = {r["node"]: r["block"] for r in graph.node_blocks(steps).collect()}
    seeds = spark.createDataFrame([(k, n, at[n], 0, -1, m) for k, n, m in asked], "request long, node long, block long, price long, edge long, most long")
    old, paths.BLOCK = paths.BLOCK, 0.05
    got = {}
    for r in paths.labels(paths.searched(paths.packed(steps), seeds)).collect():
        got.setdefault(r["request"], {})[r["node"]] = r["price"]
    paths.BLOCK = old
    for k, start, most in asked:
        best, heap = {start: 0}, [(0, start)]
        while heap:
            p, n = heapq.heappop(heap)
            if p == best[n]:
                for v, c in near.get(n, ()):
                    if (most is None or p + c <= most) and p + c < best.get(v, math.inf):
                        best[v] = p + c
                        heapq.heappush(heap, (p + c, v))
        assert got[k] == best


def test_merged_lines(spark):
    sq = lambda i, a, b, kind: (i, kind, [(a[0] * 0.001, a[1] * 0.001), (b[0] * 0.001, b[1] * 0.001)])
    rows = [sq(4, (0, 0), (1, 0), "a"), sq(2, (2, 0), (1, 0), "a"), sq(9, (2, 0), (3, 0), "a"), sq(5, (3, 0), (4, 0), "b")]  # one chain, one line of another kind
    rows += [sq(20 + i, a, b, "a") for i, (a, b) in enumerate([((0, 5), (1, 5)), ((1, 6), (1, 5)), ((1, 6), (0, 6)), ((0, 6), (0, 5))])]  # a loop
    rows += [sq(30 + i, (5, 5), p, "a") for i, p in enumerate([(6, 5), (5, 6), (4, 5)])]  # a fork stays apart
    rows += [sq(100 + i, (10 + i, 0), (11 + i, 0), None) for i in range(70)]  # a long chain of no kind
    rows += [(200, "a", [(1.0, 1.0), (1.1, 1.0), (1.0, 1.1), (1.0, 1.0)])]  # a loop of one line
    df = spark.createDataFrame(rows, f"line long, kind string, shape {LINE}")
    got = {r["line"]: r for r in merge.merged_lines(df, ["kind"]).collect()}
    assert {k: r["lines"] for k, r in got.items()} == {2: 3, 5: 1, 20: 4, 30: 1, 31: 1, 32: 1, 100: 70, 200: 1}
    xs = lambda k: [round(p["lon"] * 1000) for p in got[k]["shape"]]
    assert xs(2) == [3, 2, 1, 0] and xs(100) == list(range(10, 81)) and got[20]["shape"][0] == got[20]["shape"][-1] and len(got[20]["shape"]) == 5
    assert merge.merged_lines(df.limit(0), ["kind"]).count() == 0


def test_validity_on_edges(spark):
    p = f"polygon long, rings array<{LINE}>"
    sq = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    rows = [(1, None), (2, []), (3, [[]]), (4, [sq]), (5, [[(float(x), float(x % 2)) for x in range(200)] + [(199.0, 5.0), (0.0, 5.0), (0.0, 0.0)]]), (6, [sq, [(1.0, 0.0), (2.0, 1.0), (3.0, 0.0), (1.0, 0.0)]])]
    got = {r["polygon"]: r["reason"] for r in validity.validity(spark.createDataFrame(rows, p)).collect()}
    assert got == {1: "too few points", 2: "too few points", 3: "too few points", 4: None, 5: None, 6: "rings cross"}
    ring = spark.createDataFrame([([(0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (1.0, 1.0)],), ([(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)],)], f"r {LINE}")
    a, b = (r[0] for r in ring.select(validity.cleaned(F.col("r"))).collect())
    assert [tuple(q) for q in a] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)] and b is None


def test_outlines(spark):
    box = lambda i, k, x, y, w, h: (i, k, [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]])
    rows = [box(1, "over", 0.0, 0.0, 2.0, 2.0), box(2, "over", 1.0, 1.0, 2.0, 2.0), box(3, "side", 0.0, 0.0, 1.0, 1.0), box(4, "side", 1.0, 0.0, 1.0, 1.0), box(5, "corner", 0.0, 0.0, 1.0, 1.0), box(6, "corner", 1.0, 1.0, 1.0, 1.0)]
    rows += [box(7, "same", 0.0, 0.0, 1.0, 1.0), box(8, "same", 0.0, 0.0, 1.0, 1.0), box(9, "in", 0.0, 0.0, 4.0, 4.0), box(10, "in", 1.0, 1.0, 1.0, 1.0)]
    rows += [box(11, "ring", 0.0, 0.0, 3.0, 1.0), box(12, "ring", 0.0, 2.0, 3.0, 1.0), box(13, "ring", 0.0, 0.0, 1.0, 3.0), box(14, "ring", 2.0, 0.0, 1.0, 3.0)]
    rows += [(15, "hole", [[(0.0, 0.0), (0.0, 3.0), (3.0, 3.0), (3.0, 0.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]]), (16, "hole", [[(1.25, 1.25), (1.75, 1.25), (1.5, 4.0), (1.25, 1.25)]])]
    got = {}
    for r in merge.outlines(spark.createDataFrame(rows, f"area long, kind string, rings array<{LINE}>"), 1.0).collect():
        assert r["shape"][0] == r["shape"][-1]
        got.setdefault(r["kind"], []).append(round(r["area"], 5))
    assert {k: sorted(v) for k, v in got.items() if k != "hole"} == {"over": [7.0], "side": [2.0], "corner": [1.0, 1.0], "same": [1.0], "in": [16.0], "ring": [-1.0, 9.0]}
    # the square with a hole, and a wedge that begins in the hole and leaves by the upper side
    assert sum(got["hole"]) == pytest.approx(8 + wedge_outside(), abs=1e-4)


def wedge_outside():
    """Area of the wedge below 2 and above 3, which the square with its hole does not have."""
    width = lambda y: 0.5 * (4.0 - y) / 2.75
    return (width(1.25) + width(2.0)) / 2 * 0.75 + width(3.0) / 2


def test_rims_and_holes(spark):
    import numpy as np

    from meridia.operators import stencil

    rng = np.random.default_rng(2)
    whole = (rng.random((24, 32)) < 0.6).astype(np.uint8)
    for radius in (0, 1, 2):
        tiles = [(x, y, whole[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8].tobytes()) for y in range(3) for x in range(4)]
        got = np.zeros_like(whole)
        for r in stencil.small_holes(spark.createDataFrame(tiles, "tx long, ty long, mask binary"), 8, radius).collect():
            got[r["ty"] * 8 : r["ty"] * 8 + 8, r["tx"] * 8 : r["tx"] * 8 + 8] = np.frombuffer(bytes(r["holes"]), np.uint8).reshape(8, 8)
        n, m = whole.shape
        near = lambda a, y, x: a[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]
        grown = np.array([[near(whole, y, x).any() for x in range(m)] for y in range(n)])
        want = np.array([[near(grown, y, x).all() and not whole[y, x] for x in range(m)] for y in range(n)])
        assert (got == want).all()


def test_validity_broadcasts_no_side_that_grows(spark, capsys):
    """Files of polygons are a fraction of their sides and cells, so their size must not pick a broadcast."""
    ring = F.array(*[F.struct((x + F.col("polygon")).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0))])
    validity.validity(spark.range(40).select(F.col("id").cast("double").alias("polygon")).select("polygon", F.array(ring, ring).alias("rings"))).explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_steps_of_a_block_do_not_travel_with_each_request(spark):
    from meridia.operators import paths

    blocks = paths.packed(spark.createDataFrame([(k, k + 1, k, 5, 7, 7) for k in range(40)], "u long, v long, edge long, price long, ublock long, vblock long"))
    known = spark.range(600).select(F.col("id").alias("request"), F.lit(7).cast("long").alias("block"), F.array(F.struct(*[F.lit(0).cast("long").alias(c) for c in paths.LABEL])).alias("o"))
    limits = spark.range(600).select(F.col("id").alias("request"), F.lit(None).cast("long").alias("most"))
    n = dict(paths.dealt(known, blocks, [limits]).groupBy("kind").count().collect())
    assert n == {0: 3, 1: 600}


def test_pieces_meet_areas_of_their_own_kind_only(spark):
    from meridia.operators import spatial

    points = spark.range(6).select(F.col("id").alias("piece"), (F.col("id") % 3).alias("kind"), F.lit(0.5).alias("lon"), F.lit(0.5).alias("lat"))
    boxes = spark.range(3).select(F.col("id").alias("area"), F.col("id").alias("kind"), *[F.lit(v).alias(c) for c, v in zip(spatial.BOX, (0.0, 0.0, 1.0, 1.0))])
    got = spatial.cell_join(points, boxes, ("kind",)).select("piece", "kind", "area").collect()
    assert sorted(map(tuple, got)) == [(k, k % 3, k % 3) for k in range(6)]


def test_near_edges_are_contracted_before_the_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "cut", lambda df: written.append(1) or cut(df))
    chains = [(100 * c + k, 100 * c + k + 1) for c in range(3) for k in range(99)] + [(50, 250), (7, 7)]
    for name in (lambda n: n, lambda n: f"n{n:04d}"):
        written.clear()
        got = {r["node"]: r["root"] for r in graph.stars(spark.createDataFrame([(name(u), name(v)) for u, v in chains], ["u", "v"])).collect()}
        want = {name(n): name(100 if 100 <= n < 200 else 0) for n in range(300)}
        assert {n: got.get(n, n) for n in want} == want
        assert len(written) <= 8


def test_nodes_of_the_network_are_not_broadcast(spark):
    edges = road_edges(spark, "/root/testdata/sf0.001").select("u", "v")
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()


def test_touched_points_are_those_that_boxes_can_hold(spark):
    points = spark.createDataFrame([(k, k * 0.01, 0.0) for k in range(100)] + [(0, 0.0, 0.0)], "p long, lon double, lat double")
    boxes = spatial.padded(spark.createDataFrame([(0.3, 0.0, 0.3, 0.0), (0.3, 0.001, 0.3, 0.001)], "x1 double, y1 double, x2 double, y2 double"), 3000.0)
    got = [r["p"] for r in spatial.touched(points, boxes).collect()]
    held = {r["p"] for r in spatial.cell_join(points, boxes).collect()}
    assert len(got) == len(set(got)) < 20 and held == {28, 29, 30, 31, 32} <= set(got)
