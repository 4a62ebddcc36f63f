"""Paths with alternatives, conflation, projection and display texts."""

import heapq
import math

from pyspark.sql import functions as F

from meridia.functions import display, geo
from meridia.operators import conflate, graph
from meridia.plans import guiding
from meridia.sources.tables import road_edges


SF = "/root/testdata/sf0.01"


def corner(spark):
    """Six by three junctions of the first town, and a path apart from it in the second."""
    return road_edges(spark, SF).filter("u = 398 or u % 20 < 6 and v % 20 < 6 and u < 60 and v < 60")


def test_paths_against_a_heap(spark):
    edges = corner(spark)
    steps = [tuple(r) for r in graph.priced(edges, "CAR").select("u", "v", "ms", "edge").collect()]
    near = {}
    for u, v, ms, e in steps:
        near.setdefault(u, []).append((v, ms, e))
    asked = [(1, 0, 45), (2, 25, 42), (3, 0, 399), (4, 4, 4)]
    requests = spark.createDataFrame(asked, "request long, start long, goal long")
    got = {}
    for r in graph.paths(graph.priced(edges, "CAR"), requests).collect():
        got.setdefault(r["request"], []).append(r)
    for k, start, goal in asked:
        best, heap = {start: 0}, [(0, start)]
        while heap:
            c, n = heapq.heappop(heap)
            if c == best[n]:
                for v, ms, _ in near.get(n, ()):
                    if c + ms < best.get(v, 1 << 60):
                        best[v] = c + ms
                        heapq.heappush(heap, (c + ms, v))
        if goal in best and goal != start:
            assert sum(r["ms"] for r in got[k]) == best[goal]
            walk = [r["node"] for r in sorted(got[k], key=lambda r: -r["pos"])]
            assert walk[-1] == goal and len(set(walk)) == len(walk)
        else:
            assert k not in got


def test_alternatives_are_not_much_slower_nor_the_same(spark):
    found = graph.routes(corner(spark), spark.createDataFrame([(1, 0, 22)], "request long, start long, goal long"), "CAR", 2).collect()
    ways = {}
    for r in found:
        ways.setdefault(r["rank"], []).append(r)
    base = sum(r["ms"] for r in ways[0])
    for rank, way in ways.items():
        assert sum(r["ms"] for r in way) <= 1.45 * base
        for other in range(rank):
            same = {r["edge"] for r in ways[other]}
            assert sum(r["metres"] for r in way if r["edge"] in same) <= 0.7 * sum(r["metres"] for r in way)


def test_alternatives_of_every_request(spark):
    """The query against a heap: each supplier whose goal can be reached has its ways, none is left out."""
    steps = [tuple(r) for r in graph.priced(road_edges(spark, SF), "CAR").select("u", "v", "edge", "ms", "metres").collect()]
    into, out = {}, {}
    for u, v, e, ms, m in steps:
        out.setdefault(u, []).append((v, e, ms, m))
        into.setdefault(v, []).append((u, e, ms, m))

    def way(start, goal, dear):
        """(edge, ms, metres) of the cheapest way, ties to the least node before, or none."""
        price = lambda ms, e: max(1, round(ms * dear[e])) if e in dear else ms
        best, heap = {start: 0}, [(0, start)]
        while heap:
            c, n = heapq.heappop(heap)
            if c == best[n]:
                for v, e, ms, _ in out.get(n, ()):
                    if c + price(ms, e) < best.get(v, 1 << 60):
                        best[v] = c + price(ms, e)
                        heapq.heappush(heap, (best[v], v))
        walk, n = [], goal
        while n != start and goal in best:
            u, e, ms, m = min(s for s in into[n] if s[0] in best and best[s[0]] + price(s[2], s[1]) == best[n])
            walk.append((e, ms, m))
            n = u
        return walk

    want, asked = {}, guiding.requests(spark, SF).collect()
    for k, start, goal in asked:
        ways, dear = [w for w in [way(start, goal, {})] if w], {}
        for _ in range(4 if ways else 0):
            if len(ways) > 2:
                break
            for w in ways:
                for e, *_ in w:
                    dear[e] = dear.get(e, 1.0) * 1.6
            w = way(start, goal, dear)
            if sum(s[1] for s in w) > 1.45 * sum(s[1] for s in ways[0]):
                break
            if all(sum(round(m * 1000) for e, _, m in w if e in {s[0] for s in o}) <= 0.7 * sum(round(s[2] * 1000) for s in w) for o in ways):
                ways.append(w)
        want |= {(k, i): (sum(s[1] for s in w), len(w), (sum(round(s[2] * 1000) for s in w) + 500) // 1000) for i, w in enumerate(ways)}
    got = {(r["request"], r["rank"]): r for r in guiding.queries()["route_alternatives"](spark, SF).collect()}
    assert {k: (r["ms"], r["edges"], r["metres"]) for k, r in got.items()} == want
    assert len({k for k, _ in got}) > len(asked) // 2


def test_conflation(spark):
    """A street beside the first part of a state road, and one that crosses it."""
    up = 10 / geo.DEGREE_M
    line = "array<struct<lon: double, lat: double>>"
    roads = spark.createDataFrame([(1, 0, [(0.0, 0.0), (0.02, 0.0)])], f"line long, cls int, shape {line}")
    streets = spark.createDataFrame([(7, 5, [(0.0, up), (0.01, up)]), (8, 5, [(0.015, -0.001), (0.015, 0.001)])], f"street long, cls int, shape {line}")
    s = conflate.repeated(roads, streets)
    kept = conflate.kept_stretches(s).collect()
    assert len(kept) == 1 and 0.4 < kept[0]["length"] / s.count() < 0.6
    assert [tuple(r) for r in conflate.promoted(s, streets, roads).collect()] == [(7, 0)]
    assert conflate.repeated(roads.limit(0), streets).count() == 0


def test_utm(spark):
    df = spark.createDataFrame([(500000.0, 10_000_000.0), (622779.0, 9_758_000.0)], "x double, y double")
    a, b = (r[0] for r in df.select(geo.from_utm(F.col("x"), F.col("y"), 32717)).collect())
    assert abs(a["lon"] + 81) < 1e-9 and abs(a["lat"]) < 1e-9
    # the forward projection to second order gives the metres back
    k0, e2, r = 0.9996, 0.00669437999, 6378137.0
    lat, dl = math.radians(b["lat"]), math.radians(b["lon"] + 81)
    n = r / math.sqrt(1 - e2 * math.sin(lat) ** 2)
    t, c, q = math.tan(lat) ** 2, e2 / (1 - e2) * math.cos(lat) ** 2, math.cos(lat) * dl
    x = 500000 + k0 * n * (q + (1 - t + c) * q**3 / 6)
    assert abs(x - 622779.0) < 0.05
    assert tuple(df.select(geo.from_utm(F.col("x"), F.col("y"), 4326)).collect()[0][0]) == (500000.0, 10_000_000.0)


def test_display(spark):
    one = spark.createDataFrame([(850.0, 2500.0, 12345.0)], "a double, b double, c double")
    d, t, z = display.distance, display.duration, display.size
    lit = F.lit
    got = one.select(d(F.col("a")), d(F.col("b")), d(F.col("c")), t(lit(20.0)), t(lit(3900.0)), t(lit(7200.0)), z(lit(999)), z(lit(791_000)), z(lit(4_200_000)), z(lit(185_000_000)), z(lit(1_300_000_000)), display.percent(lit(0.679)), display.elapsed(lit(750)), display.elapsed(lit(360_061))).collect()[0]
    assert list(got) == ["850 m", "2,5 km", "12 km", "1 min", "1 h 05 min", "2 h", "999 B", "791 KB", "4,2 MB", "185 MB", "1,3 GB", "67 %", "00:12:30", "100:01:01"]
    now = lit("2024-01-31 12:00:00").cast("timestamp")
    ago = lambda s: display.since(now - F.expr(f"interval {s} seconds"), now)
    assert list(one.select(ago(5), ago(200), ago(7300), ago(200000)).collect()[0]) == ["hace 5 s", "hace 3 min", "hace 2 h", "29/01/2024 04:26"]
    x = one.select(display.crossing(lit("Amazonas & Colón"))["second"], display.crossing(lit("Colón")), display.address(lit("x · Tarqui, Cuenca, Azuay"))["city"], display.json_id(lit('{"id": "0A0a0a0a-0000-1111-2222-0123456789ab"}'), "id"), display.json_id(lit('{"id": 3}'), "id")).collect()[0]
    assert list(x) == ["Colón", None, "Cuenca", "0a0a0a0a-0000-1111-2222-0123456789ab", None]
