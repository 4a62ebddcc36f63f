"""Stored routes that cover a trip: both ends, and the stops between in their order, lie near the route and ahead of each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import distance
from ..functions.geo import bounds, line_length
from ..functions.linear import between, let, metres_at, position, share
from ..sources.staging import cut
from . import spatial

# fixed values: reach of a stored route in metres, metres of a degree in its box test, other routes offered, metres that count as arrived
REACH_M, BOX_DEGREE_M, OTHERS, ARRIVED_M = 150.0, 111320.0, 2, 30.0
ARRIVE, DEPART = "ARRIVE", "DEPART"


def _near(lon: Column, lat: Column, box: Column, metres: float) -> Column:
    up = metres / BOX_DEGREE_M
    cos = F.abs(F.cos(F.radians(lat)))
    side = F.when(cos < 1e-6, F.lit(180.0)).otherwise(metres / (BOX_DEGREE_M * cos))
    return lat.between(box["south"] - up, box["north"] + up) & lon.between(box["west"] - side, box["east"] + side)


def covered(requests: DataFrame, routes: DataFrame, metres: float = REACH_M) -> DataFrame:
    """Columns of both with start and end positions and their distances, for each route that covers a request.

    requests hold request, profile, lon1, lat1, lon2, lat2 and stops (points, may be empty or null); routes route,
    profile, seconds, shape and steps. The start is matched anywhere on the route, each stop and the end only behind
    what was reached before, so a route that runs the other way, or passes the stops in another order, does not count.
    Routes are found by cells of their boxes; all else is tested per pair.
    """
    r = routes.filter(F.size("shape") >= 2).withColumn("box", bounds(F.col("shape")))
    up = metres / BOX_DEGREE_M
    side = F.lit(up) / F.cos(F.radians(F.least(F.greatest(F.abs("box.south"), F.abs("box.north")) + up, F.lit(89.9))))
    r = r.withColumns({"west": F.col("box.west") - side, "south": F.col("box.south") - up, "east": F.col("box.east") + side, "north": F.col("box.north") + up})
    near = spatial.cell_join(requests.select("request", F.col("lon1").alias("lon"), F.col("lat1").alias("lat")), r.select("route", *spatial.BOX)).select("request", "route")
    j = near.join(requests, "request").join(r.drop(*spatial.BOX), ["route", "profile"])
    stops = F.coalesce("stops", F.array().cast("array<struct<lon: double, lat: double>>"))
    j = j.filter(_near(F.col("lon1"), F.col("lat1"), F.col("box"), metres) & _near(F.col("lon2"), F.col("lat2"), F.col("box"), metres) & F.forall(stops, lambda p: _near(p["lon"], p["lat"], F.col("box"), metres)))
    s = F.col("shape")
    j = j.withColumn("start", position(s, F.col("lon1"), F.col("lat1"), F.lit(0.0))).withColumn("off1", metres_at(s, F.col("start"), F.col("lon1"), F.col("lat1"))).filter(F.col("off1") <= metres)

    def onward(acc: Column, p: Column) -> Column:
        return let(position(s, p["lon"], p["lat"], acc["pos"]), lambda pos: F.struct(pos.alias("pos"), (acc["ok"] & (metres_at(s, pos, p["lon"], p["lat"]) <= metres)).alias("ok")))

    j = j.withColumn("reached", F.aggregate(stops, F.struct(F.col("start").alias("pos"), F.lit(True).alias("ok")), onward)).filter("reached.ok")
    j = j.withColumn("end", position(s, F.col("lon2"), F.col("lat2"), F.col("reached.pos"))).withColumn("off2", metres_at(s, F.col("end"), F.col("lon2"), F.col("lat2")))
    return cut(j.filter((F.col("off2") <= metres) & (F.col("end") > F.col("start"))).drop("box", "reached"))


def _trimmed(start: Column, end: Column, shape: Column, steps: Column, part: Column, off: Column) -> Column:
    """Steps between two positions: numbered anew, cut ones in proportion, one already begun as a continuation, and an arrival."""
    last = F.size(part) - 1
    anew = lambda v: F.when(v <= start, 0).when(v >= end, last).otherwise((v - F.floor(start)).cast("int"))

    def one(t: Column) -> Column:
        passed, short = t["first"] < start, t["last"] > end
        a, b = F.when(passed, start).otherwise(t["first"].cast("double")), F.when(short, end).otherwise(t["last"].cast("double"))
        whole = F.slice(shape, t["first"] + 1, t["last"] - t["first"] + 1)
        part_ = F.when(passed | short, share(whole, a - t["first"], b - t["first"])).otherwise(1.0)
        on = F.when(F.size(t["names"]) > 0, F.concat(F.lit("Continúe por "), F.get(t["names"], F.lit(0)), F.lit("."))).otherwise("Continúe por la ruta guardada.")
        return let(part_, lambda k: F.struct(
            F.when(passed, on).otherwise(t["text"]).alias("text"), (t["metres"] * k).alias("metres"), (t["seconds"] * k).alias("seconds"), F.when(passed, DEPART).otherwise(t["maneuver"]).alias("maneuver"),
            F.when(passed, 0).otherwise(anew(t["first"])).alias("first"), F.when(short, last).otherwise(anew(t["last"])).alias("last")))

    inside = F.filter(steps, lambda t: (t["maneuver"] != ARRIVE) & (F.greatest(t["first"].cast("double"), start) < F.least(t["last"].cast("double"), end)))
    own = F.element_at(F.filter(steps, lambda t: t["maneuver"] == ARRIVE), -1)
    text = F.when((end == F.size(shape) - 1) & (F.element_at(steps, -1)["maneuver"] == ARRIVE), own["text"]).when(off <= ARRIVED_M, "Ha llegado a su destino.").otherwise(F.concat(F.lit("Fin de la ruta guardada. Su destino está a "), distance(off), F.lit(".")))
    arrival = F.struct(text.alias("text"), F.lit(0.0).alias("metres"), F.lit(0.0).alias("seconds"), F.lit(ARRIVE).alias("maneuver"), last.alias("first"), last.alias("last"))
    return F.concat(F.transform(inside, one), F.array(arrival))


def offered(requests: DataFrame, routes: DataFrame, metres: float = REACH_M, others: int = OTHERS) -> DataFrame:
    """request, place, route, start, end, off1, off2, shape, metres, seconds and steps: the stored routes that cover a trip, trimmed to it.

    Best is the least way to and from the route, then the least time, then the least route; `others` more are kept.
    Parts under a metre do not count. Steps hold text, metres, seconds, maneuver and the numbers of their first and
    last corner; metres and seconds are sums over steps, or in proportion to length for a route without steps.
    """
    j = covered(requests, routes, metres)
    j = j.withColumn("part", between(F.col("shape"), F.col("start"), F.col("end"))).filter(line_length(F.col("part")) >= 1)
    whole = (F.col("start") == 0) & (F.col("end") == F.size("shape") - 1)
    j = j.withColumn("trimmed", F.when(whole, F.transform("steps", lambda t: F.struct(t["text"].alias("text"), t["metres"].alias("metres"), t["seconds"].alias("seconds"), t["maneuver"].alias("maneuver"), t["first"].alias("first"), t["last"].alias("last")))).otherwise(_trimmed(F.col("start"), F.col("end"), F.col("shape"), F.col("steps"), F.col("part"), F.col("off2"))))
    k = line_length(F.col("part")) / F.greatest(line_length(F.col("shape")), F.lit(1.0))
    total = lambda c: F.aggregate("trimmed", F.lit(0.0), lambda acc, t: acc + t[c])
    seconds = F.when(whole, F.col("seconds")).when(F.size("trimmed") > 1, total("seconds")).otherwise(F.col("seconds") * k)
    length = F.when(F.size("trimmed") > 1, total("metres")).otherwise(line_length(F.col("part")))
    j = j.withColumns({"took": seconds, "metres": length})
    w = Window.partitionBy("request").orderBy(F.col("off1") + F.col("off2"), "took", "route")
    got = j.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= 1 + others)
    return got.select("request", "place", "route", "start", "end", "off1", "off2", F.col("part").alias("shape"), "metres", F.col("took").alias("seconds"), F.col("trimmed").alias("steps"))
