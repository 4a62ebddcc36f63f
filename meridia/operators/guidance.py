"""Spoken instructions of routes: pieces grouped into roads, turns between them, phrases in Spanish and English."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import DEGREE_M, sides, turn
from ..functions.linear import cut_by_share, joined
from ..sources.staging import cut
from ..sources.tables import APPROXIMATE, CONNECTOR, ROUNDABOUT, STATE
from . import graph

# fixed values: a run shorter than this between two runs of one road is an artefact; metres that a bearing is taken over; degree of a roundabout's exit
ARTEFACT_M, BEARING_M, EXIT_DEGREE = 25.0, 25.0, 3
# fixed values: the texts, by language; {h} heading, {r} road, {n} number, {m} distance
TEXTS = {
    "es": {
        "headings": ("norte", "noreste", "este", "sureste", "sur", "suroeste", "oeste", "noroeste"),
        "ordinals": ("primera", "segunda", "tercera", "cuarta", "quinta", "sexta", "séptima", "octava"),
        "unnamed": {"service": "el pasaje", "track": "el camino", "path": "el paso peatonal", "major": "la vía", "minor": "la calle"},
        "decimal": ",",
        "DEPART": "Dirígete al {h} por {r}", "FROM_STOP": "Desde la parada, dirígete al {h} por {r}", "CONTINUE": "Continúa por {r}",
        "SLIGHT_RIGHT": "Gira levemente a la derecha hacia {r}", "SLIGHT_LEFT": "Gira levemente a la izquierda hacia {r}", "TURN_RIGHT": "Gira a la derecha en {r}", "TURN_LEFT": "Gira a la izquierda en {r}",
        "SHARP_RIGHT": "Gira fuertemente a la derecha en {r}", "SHARP_LEFT": "Gira fuertemente a la izquierda en {r}", "UTURN": "Da la vuelta en U por {r}",
        "ROUNDABOUT_EXIT": "Sal del redondel por {r}", "ROUNDABOUT_ENTER": "En el redondel, toma la {n} salida hacia {r}", "ARRIVE": "Llegaste a tu destino", "STOP": "Llegaste a la parada {n}",
        "OTHER": "Continúa por el acceso local (tramo aproximado de {m}, sin vía registrada)",
    },
    "en": {
        "headings": ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest"),
        "ordinals": ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth"),
        "unnamed": {"service": "the lane", "track": "the track", "path": "the footpath", "major": "the road", "minor": "the road"},
        "decimal": ".",
        "DEPART": "Head {h} on {r}", "FROM_STOP": "From the stop, head {h} on {r}", "CONTINUE": "Continue on {r}",
        "SLIGHT_RIGHT": "Bear right onto {r}", "SLIGHT_LEFT": "Bear left onto {r}", "TURN_RIGHT": "Turn right onto {r}", "TURN_LEFT": "Turn left onto {r}",
        "SHARP_RIGHT": "Make a sharp right onto {r}", "SHARP_LEFT": "Make a sharp left onto {r}", "UTURN": "Make a U-turn on {r}",
        "ROUNDABOUT_EXIT": "Exit the roundabout onto {r}", "ROUNDABOUT_ENTER": "At the roundabout, take the {n} exit onto {r}", "ARRIVE": "You have arrived at your destination", "STOP": "You have arrived at stop {n}",
        "OTHER": "Continue on the local access road (approximate stretch of {m}, not mapped)",
    },
}
# fixed values: numbers of the classes that unnamed roads are told apart by
PRIMARY, SERVICE, TRACK, PATH, STEPS = 2, 6, 7, 8, 10


def road_label(name: Column, ref: Column, state: Column) -> Column:
    """What a road is called: a state road by its number first, another by its name."""
    both = name.isNotNull() & ref.isNotNull()
    of_state = F.when(both, F.concat(ref, F.lit(" ("), name, F.lit(")"))).otherwise(F.coalesce(ref, name))
    other = F.when(both & ~name.contains(ref), F.concat(name, F.lit(" ("), ref, F.lit(")"))).otherwise(F.coalesce(name, ref))
    return F.when(state, of_state).otherwise(other)


def end_bearing(points: Column, start: bool) -> Column:
    """Degrees from north of the first 25 m of a shape, or of its last 25 m, both in the direction of travel."""
    p = points if start else F.reverse(points)

    def far(acc: Column, s: Column) -> Column:
        kx = F.cos(F.radians(s["b"]["lat"])) * DEGREE_M
        gone = acc["gone"] + F.sqrt(F.pow((s["b"]["lon"] - s["a"]["lon"]) * kx, 2) + F.pow((s["b"]["lat"] - s["a"]["lat"]) * DEGREE_M, 2))
        return F.struct(F.when(acc["gone"] >= BEARING_M, acc["gone"]).otherwise(gone).alias("gone"), F.when(acc["gone"] >= BEARING_M, acc["to"]).otherwise(s["b"]).alias("to"))

    o = F.get(p, F.lit(0))
    to = F.coalesce(F.aggregate(sides(p), F.struct(F.lit(0.0).alias("gone"), o.alias("to")), far, lambda a: a["to"]), o)  # a lone point looks north
    angle = F.degrees(F.atan2((to["lon"] - o["lon"]) * F.cos(F.radians(o["lat"])), to["lat"] - o["lat"]))
    return F.pmod(angle + (360.0 if start else 540.0), F.lit(360.0))


def road_runs(pieces: DataFrame, edges: DataFrame) -> DataFrame:
    """request and its runs in order (key, label, cls, roundabout, metres, ms, exits, points).

    Pieces of one road follow each other: a road is its name, else its number, else its class; roundabouts and guessed
    stretches are roads of their own. A connector without a name belongs to the run before it. A run of under 25 m
    between two runs of one road joins both, unless it is a roundabout; what was joined does not join again.
    """
    c = F.col
    flag = lambda bit: c("flags").bitwiseAND(bit) > 0
    key = F.when(flag(APPROXIMATE), "approximate").when(flag(ROUNDABOUT), "roundabout").when(c("name").isNotNull(), F.concat(F.lit("n"), "name")).when(c("ref").isNotNull(), F.concat(F.lit("r"), "ref")).when(c("cls") != CONNECTOR, F.concat(F.lit("c"), "cls"))
    e = edges.select("edge", "u", "v", "cls", "flags", "shape", "name", "ref", key.alias("key"), road_label(c("name"), c("ref"), flag(STATE)).alias("label"), flag(ROUNDABOUT).alias("roundabout"))
    p = pieces.join(e, "edge").withColumn("node", F.when(c("reverse"), c("u")).otherwise(c("v"))).join(graph.node_degree(edges), "node", "left")
    p = cut(p.withColumns({"points": cut_by_share(c("shape"), c("a"), c("b")), "exit": (c("roundabout") & (F.coalesce("degree", F.lit(0)) >= EXIT_DEGREE)).cast("int")}))
    w = Window.partitionBy("request").orderBy("seq")
    p = p.withColumn("road", F.coalesce(F.last("key", True).over(w), F.concat(F.lit("c"), F.first("cls").over(w))))
    p = p.withColumn("new", (~c("road").eqNullSafe(F.lag("road").over(w))).cast("int")).withColumn("run", F.sum("new").over(w))
    r = p.groupBy("request", "run").agg(
        F.first("road").alias("key"), F.min_by(F.struct("label", "cls", "roundabout"), "seq").alias("one"), F.sum("metres").alias("metres"), F.sum("ms").alias("ms"), F.sum("exit").alias("exits"),
        joined(F.array_sort(F.collect_list(F.struct("seq", "points")))["points"]).alias("points"))  # one run's pieces
    r = r.select("request", F.struct("run", "key", c("one.label").alias("label"), c("one.cls").alias("cls"), c("one.roundabout").alias("roundabout"), "metres", "ms", "exits", "points", F.lit(False).alias("grown")).alias("r"))
    rows = r.groupBy("request").agg(F.array_sort(F.collect_list("r"), lambda a, b: (a["run"] - b["run"]).cast("int")).alias("runs"))  # one leg's runs

    def fold(acc: Column, x: Column) -> Column:
        n = F.size(acc)
        last, before = F.get(acc, n - 1), F.get(acc, n - 2)
        short = (n >= 2) & (last["metres"] < ARTEFACT_M) & ~last["roundabout"] & ~last["grown"] & (before["key"] == x["key"])
        tail = lambda pts: F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0)))
        both = F.struct(
            before["run"].alias("run"), before["key"].alias("key"), before["label"].alias("label"), before["cls"].alias("cls"), before["roundabout"].alias("roundabout"), *[(before[k] + last[k] + x[k]).alias(k) for k in ("metres", "ms")],
            before["exits"].alias("exits"), F.concat(before["points"], tail(last["points"]), tail(x["points"])).alias("points"), F.lit(True).alias("grown"))
        return F.when(short, F.concat(F.slice(acc, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(both))).otherwise(F.concat(acc, F.array(x)))

    return rows.select("request", F.aggregate("runs", F.slice("runs", 1, 0), fold).alias("runs"))


def _unnamed(cls: Column, t: dict) -> Column:
    u = t["unnamed"]
    return F.when(cls == SERVICE, u["service"]).when(cls == TRACK, u["track"]).when(cls.between(PATH, STEPS), u["path"]).when(cls <= PRIMARY, u["major"]).otherwise(u["minor"])


def _text(t: dict, name: str, **parts: Column) -> Column:
    out = F.lit(t[name])
    for k, v in parts.items():
        out = F.replace(out, F.lit(f"{{{k}}}"), v)
    return out


def _distance(metres: Column, decimal: str) -> Column:
    return F.when(metres >= 1000, F.concat(F.replace(F.round(metres / 1000, 1).cast("decimal(20,1)").cast("string"), F.lit("."), F.lit(decimal)), F.lit(" km"))).otherwise(F.concat(F.floor(metres + 0.5).cast("string"), F.lit(" m")))


def steps(pieces: DataFrame, edges: DataFrame, legs: DataFrame, language: str = "es") -> DataFrame:
    """trip, leg, step, maneuver, text, metres, seconds, label, first, last: what a driver is told, an arrival at the end of each leg.

    legs hold trip, leg (from 0) and request. first and last number the corners of the whole route's shape.
    """
    t = TEXTS[language]
    runs = cut(road_runs(pieces, edges)).join(legs.select("trip", "leg", "request"), "request")
    inside = F.aggregate("runs", F.lit(0), lambda acc, r: acc + F.size(r["points"]) - 1)
    w = Window.partitionBy("trip").orderBy("leg")
    runs = runs.withColumn("inside", inside).withColumns({"start": F.coalesce(F.sum("inside").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"), "legs": F.count("*").over(Window.partitionBy("trip"))})
    r = runs.select("trip", "leg", "legs", "start", "runs", F.posexplode("runs").alias("i", "r"))
    before, after = F.get("runs", F.col("i") - 1), F.get("runs", F.col("i") + 1)
    road = lambda x: F.coalesce(x["label"], _unnamed(x["cls"], t))
    points = F.col("r.points")
    heading = F.element_at(F.array(*[F.lit(x) for x in t["headings"]]), (F.floor(end_bearing(points, True) / 45 + 0.5) % 8 + 1).cast("int"))
    angle = turn(end_bearing(before["points"], False), end_bearing(points, True))
    r = r.withColumn("maneuver", F.when((F.col("i") == 0) & (F.col("leg") == 0), "DEPART").when(F.col("i") == 0, "WAYPOINT").when(F.col("r.roundabout"), "ROUNDABOUT_ENTER").when(before["roundabout"], "ROUNDABOUT_EXIT").when(F.col("r.key") == "approximate", "OTHER").otherwise(graph.turn_kind(angle)))
    number = F.greatest(F.col("r.exits"), F.lit(1)).cast("int")
    ordinal = F.element_at(F.array(*[F.lit(x) for x in t["ordinals"]]), F.least(number, F.lit(8)))
    to = F.when(after.isNotNull(), road(after)).otherwise(_unnamed(F.col("r.cls"), t))
    m = F.col("maneuver")
    text = F.when(m == "DEPART", _text(t, "DEPART", h=heading, r=road(F.col("r")))).when(m == "WAYPOINT", _text(t, "FROM_STOP", h=heading, r=road(F.col("r")))).when(m == "ROUNDABOUT_ENTER", _text(t, "ROUNDABOUT_ENTER", n=ordinal, r=to)).when(m == "OTHER", _text(t, "OTHER", m=_distance(F.col("r.metres"), t["decimal"])))
    for kind in ("ROUNDABOUT_EXIT", "CONTINUE", "SLIGHT_RIGHT", "SLIGHT_LEFT", "TURN_RIGHT", "TURN_LEFT", "SHARP_RIGHT", "SHARP_LEFT", "UTURN"):
        text = text.when(m == kind, _text(t, kind, r=road(F.col("r"))))
    first = F.col("start") + F.aggregate(F.slice("runs", F.lit(1), F.col("i")), F.lit(0), lambda acc, x: acc + F.size(x["points"]) - 1)
    told = r.select("trip", "leg", F.col("i").alias("step"), "maneuver", text.alias("text"), F.floor(F.col("r.metres") + 0.5).alias("metres"), F.floor(F.col("r.ms") / 1000 + 0.5).alias("seconds"), "r.label", first.alias("first"), (first + F.size(points) - 1).alias("last"))
    last_leg = F.col("leg") == F.col("legs") - 1
    end = F.col("start") + F.col("inside")
    zero = F.lit(0).cast("long")
    arrival = runs.select("trip", "leg", F.size("runs").alias("step"), F.when(last_leg, "ARRIVE").otherwise("WAYPOINT").alias("maneuver"), F.when(last_leg, t["ARRIVE"]).otherwise(_text(t, "STOP", n=(F.col("leg") + 1).cast("string"))).alias("text"), zero.alias("metres"), zero.alias("seconds"), F.lit(None).cast("string").alias("label"), end.alias("first"), end.alias("last"))
    return told.unionByName(arrival)
