"""Queries over position fixes and trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..operators import runs, spatial, tracks, traffic
from ..sources.tables import AS_OF, EDGES_SQL, POINTS_SQL, SEGMENTS_SQL, TRIPS_SQL, load, road_edges, trip_points, trips
from .sqltext import CELL, KMH, great_circle, to_segment

BOX = (-79.9495, -2.1995, -79.9355, -2.1925)
WIDE = (-80.0, -2.5, -79.5, -2.0)
ZONE = "America/Guayaquil"
HALF = 15 * 24 * 60  # minutes: the live window of the fixtures, whose last quarter of an hour is nearly empty
NOON = "2024-01-31 17:30:00"


def good(s, d):
    return traffic.good_fixes(trip_points(s, d), trips(s, d))


def edges(s, d):
    return road_edges(s, d)


def routes(s, d):
    """Avenues of the towns as routes, with a length and a duration."""
    e = road_edges(s, d).filter("cls = 2")
    from ..functions.geo import line_length

    return e.select(F.col("edge").alias("route_id"), "shape", F.round(line_length(F.col("shape")), 3).alias("metres"), F.lit(8).alias("seconds"))


def zones(s, d):
    """Climate zones: squares of five hundredths of a degree, four side by side in each of the first towns, one of four with a hole."""
    k, i = F.col("n_nationkey"), F.col("n_nationkey") % 4
    west, south, side = F.lit(-79.9513) + i * 0.005 + F.expr("n_nationkey div 4") * 0.027, F.lit(-2.2013), F.lit(0.005)
    ring = lambda x, y, h: F.array(*[F.struct((x + a * h).alias("lon"), (y + b * h).alias("lat")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    text = F.concat((i * 250 + 500).cast("string"), F.lit(",5 - "), (i * 500 + 750).cast("string"), F.lit(" mm"))
    return load(s, d, "nation").select(k.alias("zone"), F.when(i == 3, "Sin rango").otherwise(text).alias("range"), F.when(i == 1, F.array(ring(west, south, side), ring(west + 0.001, south + 0.001, F.lit(0.002)))).otherwise(F.array(ring(west, south, side))).alias("rings"))


ZONES_SQL = "select k as zone, case when k % 4 = 3 then 'Sin rango' else (k % 4 * 250 + 500) || ',5 - ' || (k % 4 * 500 + 750) || ' mm' end as range, -79.9513e0 + k % 4 * 0.005e0 + k // 4 * 0.027e0 as west, -2.2013e0 as south, k % 4 = 1 as hole from (select n_nationkey as k from nation)"


def queries():
    p, t = trip_points, trips
    return {
        "traffic_cells": lambda s, d: traffic.traffic_cells(p(s, d), WIDE, AS_OF, HALF),
        "traffic_cells_box": lambda s, d: traffic.traffic_cells(p(s, d), BOX, AS_OF, HALF),
        "activity_cells": lambda s, d: traffic.activity_cells(p(s, d), WIDE, AS_OF, 24 * 8),
        "live_fix_filter": lambda s, d: good(s, d).filter(traffic.since("recorded_at", AS_OF, HALF, "minutes")).select("event_id", "trip_id", "profile", "speed"),
        "typical_fixes": lambda s, d: traffic.typical_fixes(good(s, d), NOON, ZONE, 28).select("event_id", "recorded_at"),
        "nearest_edge": lambda s, d: traffic.matched(good(s, d), edges(s, d)).select("event_id", "edge", "metres", "fraction"),
        "edge_speed_median": lambda s, d: traffic.edge_speeds(traffic.matched(good(s, d), edges(s, d)), ["edge"], 3, 2),
        "traffic_flow": lambda s, d: traffic.traffic_flow(p(s, d), t(s, d), edges(s, d), WIDE, NOON, ZONE, 24 * 60 * 4),
        "route_traffic": lambda s, d: traffic.route_traffic(p(s, d), routes(s, d), AS_OF, HALF),
        "route_climate": lambda s, d: traffic.route_climate(routes(s, d), zones(s, d)),
        "track_lengths": lambda s, d: tracks.track_lengths(p(s, d)),
        "track_thinned": lambda s, d: tracks.thinned(p(s, d)),
        "trip_latest_fix": lambda s, d: tracks.latest_fix(p(s, d)),
        "trip_points_counted": lambda s, d: t(s, d).join(p(s, d).groupBy("trip_id").agg(F.count("*").alias("points")), "trip_id", "left").select("trip_id", "profile", F.coalesce("points", F.lit(0)).alias("points")),
        "haversine_matrix": lambda s, d: tracks.latest_fix(p(s, d)).select("trip_id", F.round(haversine(F.col("lon"), F.col("lat"), F.lit(-79.88), F.lit(-2.19)), 2).alias("metres")),
        "run_length_steps": lambda s, d: runs.runs(load(s, d, "events"), "user_id", ["ts", "event_id"], "event_type", ["value"]),
        "gap_smoothing": lambda s, d: runs.smoothed(load(s, d, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 7 < 3).alias("flag")), "user_id", ["ts", "event_id"], "flag", 2).select("event_id", "flag", "smooth"),
    }


def oracle_sql():
    pts, trp = f"p as ({POINTS_SQL})", f"t as ({TRIPS_SQL})"
    fixes = f"{pts}, {trp}, g as (select p.*, profile from p join t using (trip_id) where speed >= 0 and speed < 70 and (accuracy is null or accuracy <= 50) and profile in ('CAR', 'MOTORCYCLE', 'TRUCK'))"
    local = "recorded_at - interval 5 hours"
    clock = f"greatest(isodow({local}), 5) = greatest(isodow(timestamp '{NOON}' - interval 5 hours), 5) and (hour({local}) - 12 + 24) % 24 in (0, 1, 23)"
    seg = f"s as ({SEGMENTS_SQL})"
    def near(of: str) -> str:
        d = to_segment("lon", "lat", "x1", "y1", "x2", "y2")
        return f"""{seg}, c as (select event_id, trip_id, speed, recorded_at, lon, lat, edge, round(min({d}), 3) as metres
          from {of} join s on cls <= 7 and lon between least(x1, x2) - 1e-3 and greatest(x1, x2) + 1e-3 and lat between least(y1, y2) - 1e-3 and greatest(y1, y2) + 1e-3 group by all),
          n as (select * from c where metres <= 25 qualify row_number() over (partition by event_id order by metres, edge) = 1)"""

    window = f"recorded_at >= timestamp '{AS_OF}' - interval {HALF} minutes"
    in_ = lambda b: f"lon between {b[0]} and {b[2]} and lat between {b[1]} and {b[3]}"
    cells = lambda b: f"with {pts} select {CELL}, count(*) as samples, count(distinct trip_id) as trips, {KMH} as kmh, max(recorded_at) as latest from p where {window} and speed is not null and {in_(b)} group by 1, 2 having count(*) >= 5 and count(distinct trip_id) >= 3 order by latest desc, 1, 2 limit 5000"
    town = "[80, 60, 55, 45, 35, 28, 15, 20, 0, 0, 0, 25]"
    free = f"(case when flags & 1 > 0 and cls <= 2 then [90, 65, 55][cls + 1] else {town}[cls + 1] end * case when flags & 2 > 0 then 0.6e0 else 1e0 end)"
    median = "round(list_sort(list(speed))[count(*) // 2 + 1] * 3.6e0, 6) as median_kph"
    length = f"e as ({EDGES_SQL}), r as (select edge as route_id, shape, round(list_sum(list_transform(range(1, len(shape)), lambda i: {great_circle('shape[i].lon', 'shape[i].lat', 'shape[i + 1].lon', 'shape[i + 1].lat')})), 3) as metres from e where cls = 2)"
    corner = "x - west > 0.001e0 and x - west < 0.003e0 and y - south > 0.001e0 and y - south < 0.003e0"
    return {
        "traffic_cells": cells(WIDE),
        "traffic_cells_box": cells(BOX),
        "activity_cells": f"with {pts} select {CELL}, count(*) as samples, count(distinct trip_id) as trips from p where recorded_at >= timestamp '{AS_OF}' - interval 192 hours and {in_(WIDE)} group by 1, 2 having count(distinct trip_id) >= 3",
        "live_fix_filter": f"with {fixes} select event_id, trip_id, profile, speed from g where {window}",
        "typical_fixes": f"with {fixes} select event_id, recorded_at from g where recorded_at >= timestamp '{NOON}' - interval 28 days and recorded_at < timestamp '{NOON}' - interval 15 minutes and {clock}",
        "nearest_edge": f"""with {fixes}, {near('g')}, a as (select n.*, i, {to_segment('lon', 'lat', 'x1', 'y1', 'x2', 'y2')} as d, (x2 - x1) * cos(radians(lat)) as wx, y2 - y1 as wy, (lon - x1) * cos(radians(lat)) as px, lat - y1 as py from n join s using (edge)),
          b as (select *, sqrt(wx * wx + wy * wy) as len, row_number() over (partition by event_id order by d, i) = 1 as best from a)
          select event_id, edge, metres, round(coalesce(sum(len) filter (i < bi), 0) / sum(len) + max(part) / sum(len), 6) as fraction from (select *, max(case when best then i end) over (partition by event_id) as bi, case when best then len * least(greatest((px * wx + py * wy) / (wx * wx + wy * wy), 0e0), 1e0) end as part from b) group by event_id, edge, metres""",
        "edge_speed_median": f"with {fixes}, {near('g')} select edge, count(*) as samples, count(distinct trip_id) as trips, {median} from n group by edge having count(*) >= 3 and count(distinct trip_id) >= 2",
        "traffic_flow": f"""with {fixes}, f as (select * from (select *, case when recorded_at >= timestamp '{NOON}' - interval 5760 minutes then 'live' when {clock} then 'typical' end as source from g where recorded_at >= timestamp '{NOON}' - interval 28 days and {in_(WIDE)}) where source is not null),
          {near('f')}, m as (select n.edge, source, count(*) as samples, count(distinct n.trip_id) as trips, list_sort(list(n.speed))[count(*) // 2 + 1] * 3.6e0 as kph from n join f using (event_id) group by n.edge, source having count(*) >= 3 and count(distinct n.trip_id) >= case source when 'live' then 2 else 3 end),
          b as (select * from m qualify row_number() over (partition by edge order by source) = 1), e as ({EDGES_SQL}), x as (select b.*, {free} as free from b join e using (edge)), y as (select *, least(1.5e0, round(kph, 6) / free) as ratio from x)
          select edge, source, samples, trips, cast(floor(kph + 0.5) as bigint) as kph, cast(floor(free + 0.5) as bigint) as free_kph, floor(ratio * 100 + 0.5) / 100 as ratio, case when ratio >= 0.75 then 'free' when ratio >= 0.5 then 'moderate' when ratio >= 0.25 then 'slow' else 'jammed' end as status from y""",
        "route_traffic": f"""with {pts}, {length}, sg as (select route_id, shape[i].lon as x1, shape[i].lat as y1, shape[i + 1].lon as x2, shape[i + 1].lat as y2 from (select *, unnest(range(1, len(shape))) as i from r)),
          q as (select route_id, event_id, trip_id, speed from p join sg on abs(lat - y1) < 0.01 and abs(lon - x1) < 0.01 where {window} and speed is not null group by all having min({to_segment('lon', 'lat', 'x1', 'y1', 'x2', 'y2')}) <= 150),
          v as (select route_id, count(*) as samples, count(distinct trip_id) as trips, {KMH} as kph from q group by route_id having count(*) >= 5 and count(distinct trip_id) >= 3)
          select r.route_id, coalesce(samples, 0) as samples, coalesce(trips, 0) as trips, kph, cast(floor(8 * case when kph > 0 and metres / 8 * 3.6 > kph then least(metres / 8 * 3.6 / kph, 2.5) else 1 end + 0.5) as bigint) as adjusted_seconds from r left join v using (route_id)""",
        "route_climate": f"""with {length}, z as ({ZONES_SQL}), v as (select route_id, unnest(shape) as pt from r), h as (select distinct route_id, range from (select *, pt.lon as x, pt.lat as y from v) join z on x > west and x < west + 0.005e0 and y > south and y < south + 0.005e0 and not (hole and {corner})),
          m as (select *, list_transform(regexp_extract_all(range, '\\d+(?:[.,]\\d+)?'), lambda s: replace(s, ',', '.')::double) as mm from h) select route_id, range, mm[1] as min_mm, coalesce(mm[2], mm[1]) as max_mm from m qualify row_number() over (partition by route_id order by coalesce(mm[2], mm[1], 0) desc, range) <= 20""",
        "track_lengths": f"with {pts}, q as (select *, lag(lon) over w as plon, lag(lat) over w as plat from p window w as (partition by trip_id order by recorded_at, event_id)) select trip_id, count(*) as points, round(coalesce(sum({great_circle('plon', 'plat', 'lon', 'lat')}), 0.0), 0) as metres from q group by trip_id",
        "track_thinned": f"with {pts}, q as (select *, row_number() over (partition by trip_id order by recorded_at, event_id) - 1 as pos, count(*) over (partition by trip_id) as n from p) select trip_id, event_id, pos, lon, lat from q where n <= 10 or pos = 0 or pos * 9 // (n - 1) > (pos - 1) * 9 // (n - 1)",
        "trip_latest_fix": f"with {pts} select trip_id, recorded_at, event_id, lon, lat from p qualify row_number() over (partition by trip_id order by recorded_at desc, event_id desc) = 1",
        "trip_points_counted": f"with {trp} select trip_id, profile, (select count(*) from events where user_id = trip_id) as points from t",
        "haversine_matrix": f"with {pts}, l as (select * from p qualify row_number() over (partition by trip_id order by recorded_at desc, event_id desc) = 1) select trip_id, round({great_circle('lon', 'lat', '-79.88e0', '-2.19e0')}, 2) as metres from l",
        "run_length_steps": "with a as (select *, row_number() over w as pos, case when event_type is distinct from lag(event_type) over w or row_number() over w = 1 then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)), b as (select *, sum(new) over (partition by user_id order by pos) as run from a) select user_id, cast(run as bigint) as run, event_type, min(pos) as first, count(*) as length, round(cast(sum(cast(value as decimal(24,6))) as double), 3) as value from b group by user_id, run, event_type",
        "gap_smoothing": """with a as (select user_id, event_id, event_id % 7 < 3 as flag, row_number() over (partition by user_id order by ts, event_id) as pos, count(*) over (partition by user_id) as n from events),
          b as (select *, max(case when flag then pos end) over (partition by user_id order by pos) as before, min(case when flag then pos end) over (partition by user_id order by pos rows between current row and unbounded following) as after from a),
          c as (select *, flag or (before is not null and after is not null and after - before - 1 <= 2) as filled from b),
          d as (select *, coalesce(lag(filled) over (partition by user_id order by pos), false) as l, coalesce(lead(filled) over (partition by user_id order by pos), false) as r from c)
          select event_id, flag, filled and (l or r) as smooth from d""",
    }
