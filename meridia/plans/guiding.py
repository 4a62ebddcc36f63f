"""Queries over routes: paths, alternatives, legs between places on edges, their shapes and instructions, stored routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import line_length
from ..operators import graph, guidance, legs, stored
from ..sources.tables import EDGES_SQL, NODES_SQL, load, point, road_edges, road_nodes
from .sqltext import great_circle

def requests(s, d):
    """A request per supplier from its town to a town of the same group."""
    k, town = F.col("s_suppkey"), F.expr("s_suppkey div 10")
    return load(s, d, "supplier").select(k.alias("request"), (town * 200 + k * 37 % 200).alias("start"), ((F.floor(town / 3) * 3 + k % 3) * 200 + (k * 53 + 11) % 200).alias("goal"))


def stops(s, d):
    """Three places on streets per supplier: edges and parts of their length."""
    k, town = F.col("s_suppkey"), F.expr("s_suppkey div 10")
    row = lambda t, a, b: (t * 200 + (k * a % 10) * 20 + k * b % 19) * 2
    near = F.floor(town / 3) * 3 + k % 3
    first = row(town, 7, 13)
    return load(s, d, "supplier").select(
        k.alias("trip"), first.alias("e0"), ((k % 7 + 1) * F.lit(0.125)).alias("p0"), F.when(k % 10 == 0, first).otherwise(row(near, 3, 11)).alias("e1"), ((k * 5 % 7 + 1) * F.lit(0.125)).alias("p1"),
        row(near, 9, 5).alias("e2"), ((k * 3 % 7 + 1) * F.lit(0.125)).alias("p2"))


def leg_list(s, d):
    """trip, leg, request: two legs for every third trip."""
    return stops(s, d).select("trip", F.explode(F.when(F.col("trip") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("leg")).withColumn("request", F.col("trip") * 2 + F.col("leg"))


def snaps(s, d):
    at = lambda i: (F.col(f"e{i}").alias("from_edge"), F.col(f"p{i}").alias("from_part"), F.col(f"e{i + 1}").alias("to_edge"), F.col(f"p{i + 1}").alias("to_part"))
    st = stops(s, d)
    return st.select((F.col("trip") * 2).alias("request"), *at(0)).unionByName(st.filter("trip % 3 = 0").select((F.col("trip") * 2 + 1).alias("request"), *at(1)))


def route_steps(s, d):
    e = road_edges(s, d)
    return guidance.steps(legs.legs(e, snaps(s, d), "CAR"), e, leg_list(s, d))


def kept_routes(s, d):
    """A stored route along each row of a town, eastwards in even rows and westwards in odd ones, with three steps and an arrival."""
    n = road_nodes(s, d).filter("x = 0")
    y = F.col("y")
    there = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda x: point(F.col("lon") + x * F.lit(1e-3), F.col("lat") + (x % 2) * F.lit(1e-4)))
    step = lambda a, b, m, t, name: F.struct(F.lit(a).alias("first"), F.lit(b).alias("last"), F.lit((b - a) * 110.0).alias("metres"), F.lit((b - a) * 10.0).alias("seconds"), F.lit(m).alias("maneuver"), F.lit(t).alias("text"), F.array(*([F.lit(name)] if name else [])).cast("array<string>").alias("names"))
    steps = F.array(step(0, 5, "DEPART", "Salga", "Uno"), step(5, 12, "TURN_LEFT", "Gire", None), step(12, 19, "CONTINUE", "Siga", "Dos"), step(19, 19, "ARRIVE", "Llegada", None))
    return n.select(F.col("node").alias("route"), F.when(y % 3 < 2, "CAR").otherwise("BICYCLE").alias("profile"), (y + 190).cast("double").alias("seconds"), F.when(y % 2 == 0, there).otherwise(F.reverse(there)).alias("shape"), steps.alias("steps"))


def asked(s, d):
    """A trip per customer along a row of its town, some against the direction of the stored route, some with a stop that is ahead or behind."""
    k, t = F.col("c_custkey"), F.expr("c_custkey div 150")
    lon = F.lit(-79.95) + (t % 200) * F.lit(2.7e-2)
    lat = F.lit(-2.2) + F.expr("c_custkey div 30000") * F.lit(2e-2) + (k % 10) * F.lit(1e-3) + F.lit(3e-4)
    east = lambda v: lon + v * F.lit(1e-3)
    stop = point(east(F.expr("c_custkey div 10 * 3 % 20")), lat)
    return load(s, d, "customer").select(
        k.alias("request"), F.when(k % 7 == 0, "BICYCLE").otherwise("CAR").alias("profile"), east(F.expr("c_custkey div 10 % 20") + F.lit(0.3)).alias("lon1"), lat.alias("lat1"), east(k * 7 % 20 + F.lit(0.6)).alias("lon2"), (lat - F.lit(2e-4)).alias("lat2"),
        F.when(k % 4 == 0, F.array(stop)).alias("stops"))


def queries():
    return {
        "route_paths": lambda s, d: graph.paths(graph.priced(road_edges(s, d), "CAR"), requests(s, d)),
        "route_alternatives": lambda s, d: graph.routes(road_edges(s, d), requests(s, d), "CAR", 2).groupBy("request", "rank").agg(F.sum("ms").alias("ms"), F.round(F.sum(graph.millimetres(F.col("metres"))) / 1000, 0).alias("metres"), F.count("*").alias("edges")),
        "route_legs": lambda s, d: legs.legs(road_edges(s, d), snaps(s, d), "CAR"),
        "route_shapes": lambda s, d: legs.routes_of(legs.legs(road_edges(s, d), snaps(s, d), "CAR"), leg_list(s, d), road_edges(s, d)).select("trip", F.round("metres", 2).alias("metres"), "ms", (F.abs(line_length(F.col("shape")) - F.col("metres")) < 0.5).alias("as_long")),
        "route_steps": route_steps,
        "stored_routes": lambda s, d: stored.offered(asked(s, d), kept_routes(s, d)).select("request", "place", "route", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.round(F.col("off1") + F.col("off2"), 3).alias("off"), F.size("shape").alias("corners"), F.round("seconds", 3).alias("seconds"), F.size("steps").alias("steps")),
    }


def oracle_sql():
    length = f"list_sum(list_transform(range(1, len(shape)), lambda i: {great_circle('shape[i].lon', 'shape[i].lat', 'shape[i + 1].lon', 'shape[i + 1].lat')}))"
    town = "[80, 60, 55, 45, 35, 28, 15, 20, 0, 0, 0, 25]"
    kph = f"(case when flags & 1 > 0 and cls <= 2 then [90, 65, 55][cls + 1] else {town}[cls + 1] end * case when flags & 2 > 0 then 0.6e0 else 1e0 end)"
    net = f"""e as ({EDGES_SQL}), dg as (select u as node, count(*) as degree from (select u from e union all select v from e) group by u),
      k as (select edge, u, v, round({length}, 3) as metres, greatest(cast(round({length} / ({kph} / 3.6) * 1000) as bigint), 1) as ms, flags & 1 > 0 as state from e where {kph} > 0),
      st as (select b.u, b.v, b.edge, b.metres, ms + case when not state and degree >= 3 then 3000 else 0 end as ms from (select u, v, edge, metres, ms, state from k union all select v, u, edge, metres, ms, state from k) b join dg on dg.node = b.v)"""
    # least prices from the seeds (request, node, ms), and of each node the step that it is reached by
    reach = """r using key (request, node) as (select request, node, min(ms) as ms from seeds group by all union select r.request, st.v, min(r.ms + st.ms) from r join st on st.u = r.node left join recurring.r old on old.request = r.request and old.node = st.v where old.ms is null or r.ms + st.ms < old.ms group by r.request, st.v),
      pred as (select b.request, b.node, a.node as back, st.edge, st.ms, st.metres from r b join st on st.v = b.node join r a on a.request = b.request and a.node = st.u and a.ms + st.ms = b.ms
        where not exists (select 1 from seeds s where s.request = b.request and s.node = b.node and s.ms = b.ms) qualify row_number() over (partition by b.request, b.node order by a.node, st.edge) = 1)"""
    trips = """tr as (select s_suppkey as trip, t, near, (t * 200 + s_suppkey * 7 % 10 * 20 + s_suppkey * 13 % 19) * 2 as e0, (s_suppkey % 7 + 1) * 0.125e0 as p0, case when s_suppkey % 10 = 0 then (t * 200 + s_suppkey * 7 % 10 * 20 + s_suppkey * 13 % 19) * 2 else (near * 200 + s_suppkey * 3 % 10 * 20 + s_suppkey * 11 % 19) * 2 end as e1,
        (s_suppkey * 5 % 7 + 1) * 0.125e0 as p1, (near * 200 + s_suppkey * 9 % 10 * 20 + s_suppkey * 5 % 19) * 2 as e2, (s_suppkey * 3 % 7 + 1) * 0.125e0 as p2 from (select *, s_suppkey // 10 as t, s_suppkey // 10 // 3 * 3 + s_suppkey % 3 as near from supplier)),
      sn as (select trip * 2 as request, e0 as fe, p0 as fp, e1 as te, p1 as tp from tr union all select trip * 2 + 1, e1, p1, e2, p2 from tr where trip % 3 = 0)"""
    leg = f"""{net}, {trips}, q as (select sn.*, a.u as fu, a.v as fv, a.ms as fms, b.u as tu, b.v as tv, b.ms as tms, case when fe = te then cast(round(b.ms * abs(tp - fp)) as bigint) end as direct from sn join k a on a.edge = fe join k b on b.edge = te),
      seeds as (select request, fu as node, cast(round(fms * fp) as bigint) as ms, -1 as mark from q union all select request, fv, cast(round(fms * (1 - fp)) as bigint), -2 from q), {reach},
      best as (select q.request, r.node, g.side, r.ms + g.tail as total, direct from q join lateral (select q.tu as node, cast(round(q.tms * q.tp) as bigint) as tail, 1 as side union all select q.tv, cast(round(q.tms * (1 - q.tp)) as bigint), 2) g on true join r on r.request = q.request and r.node = g.node
        qualify row_number() over (partition by q.request order by r.ms + g.tail, g.side) = 1),
      go as (select * from best where direct is null or total < direct),
      walk as (select go.request, 0 as pos, p.edge, p.node, p.back from go join pred p on p.request = go.request and p.node = go.node union all select w.request, pos + 1, p.edge, p.node, p.back from walk w join pred p on p.request = w.request and p.node = w.back),
      n as (select request, count(*) as n from walk group by request), seed_at as (select go.request, coalesce(arg_max(w.back, w.pos), any_value(go.node)) as node from go left join walk w using (request) group by go.request),
      mark as (select sa.request, max(s.mark) as mark from seed_at sa join seeds s on s.request = sa.request and s.node = sa.node join r on r.request = sa.request and r.node = sa.node and r.ms = s.ms group by sa.request),
      raw as (select request, 0 as seq, fe as edge, tp < fp as reverse, fp as a, tp as b from q where direct is not null and request not in (select request from go)
        union all select request, 0, fe, mark = -1, fp, case when mark = -1 then 0e0 else 1e0 end from mark join q using (request)
        union all select w.request, cast(n.n - pos as int), w.edge, w.node = k.u, case when w.node = k.u then 1e0 else 0e0 end, case when w.node = k.u then 0e0 else 1e0 end from walk w join n using (request) join k on k.edge = w.edge
        union all select go.request, cast(coalesce(n.n, 0) + 1 as int), te, side = 2, case when side = 2 then 1e0 else 0e0 end, tp from go join q using (request) left join n using (request)),
      pieces as (select request, seq, raw.edge, reverse, a, b, round(metres * abs(b - a), 3) as metres, cast(round(ms * abs(b - a)) as bigint) as ms, case when seq < max(seq) over (partition by request) and not state and degree >= 3 then 3000 else 0 end as delay, count(*) over (partition by request) as n from raw join k on k.edge = raw.edge join dg on dg.node = case when reverse then k.u else k.v end)"""
    near = """cast(lon + i * 1e-3 as double) as lon, cast(lat + i % 2 * 1e-4 as double) as lat"""
    kept = f"""rt as (select node as route, y, case when y % 3 < 2 then 'CAR' else 'BICYCLE' end as profile, y + 190e0 as seconds, lon, lat from ({NODES_SQL}) where x = 0),
      vx as (select route, profile, seconds, case when y % 2 = 0 then i else 19 - i end as i, {near} from (select rt.*, unnest(range(20)) as i from rt)),
      sg as (select route, i, lon as x1, lat as y1, lead(lon) over w as x2, lead(lat) over w as y2 from vx window w as (partition by route order by i) qualify x2 is not null),
      ask as (select c_custkey as request, case when c_custkey % 7 = 0 then 'BICYCLE' else 'CAR' end as profile, lon + (c_custkey // 10 % 20 + 0.3e0) * 1e-3 as lon1, lat as lat1, lon + (c_custkey * 7 % 20 + 0.6e0) * 1e-3 as lon2, lat - 2e-4 as lat2, case when c_custkey % 4 = 0 then lon + (c_custkey // 10 * 3 % 20) * 1e-3 end as slon
        from (select c_custkey, -79.95e0 + c_custkey // 150 % 200 * 2.7e-2 as lon, -2.2e0 + c_custkey // 30000 * 2e-2 + c_custkey % 10 * 1e-3 + 3e-4 as lat from customer))"""

    def located(name: str, of: str, lon: str, lat: str, after: str) -> str:
        """Rows of `of` with pos and off: the nearest place at or behind `after`."""
        ax, ay = f"((x1 - {lon}) * cos(radians({lat})))", f"(y1 - {lat})"
        dx, dy = f"((x2 - {lon}) * cos(radians({lat})) - {ax})", f"(y2 - {lat} - {ay})"
        t = f"greatest(least(coalesce(-({ax} * {dx} + {ay} * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0), 0e0), 1e0), case when i = floor({after}) then {after} - floor({after}) else 0e0 end)"
        d = f"pow({ax} + t * {dx}, 2) + pow({ay} + t * {dy}, 2)"
        return f"""{name}_a as (select o.*, i, x1, y1, x2, y2, {t} as t from {of} o join sg on sg.route = o.route and i >= floor({after}) and {after} < 19),
          {name} as (select * exclude (i, x1, y1, x2, y2, t), i + t as pos, {great_circle('(x1 + (x2 - x1) * t)', '(y1 + (y2 - y1) * t)', lon, lat)} as off from {name}_a qualify row_number() over (partition by request, route order by {d}, i) = 1
            union all select o.*, {after}, {great_circle('vx.lon', 'vx.lat', lon, lat)} from {of} o join vx on vx.route = o.route and vx.i = 19 where {after} >= 19)"""

    cut = lambda c, k: f"({c}1 + ({c}2 - {c}1) * {k})"
    piece = lambda lo, hi: great_circle(cut("x", f"greatest({lo} - i, 0)"), cut("y", f"greatest({lo} - i, 0)"), cut("x", f"least({hi} - i, 1)"), cut("y", f"least({hi} - i, 1)"))
    along = lambda lo, hi: f"(select sum({piece(lo, hi)}) from sg where sg.route = z.route and i < {hi} and i + 1 > {lo})"
    part = lambda a, b: f"case when greatest({a}e0, p0) >= least({b}e0, p2) then 0e0 when {a} >= p0 and {b} <= p2 then {(b - a) * 10.0} else {(b - a) * 10.0} * least(1e0, {along(f'greatest({a}e0, p0)', f'least({b}e0, p2)')} / {along(f'{a}e0', f'{b}e0')}) end"
    count = " + ".join(f"case when greatest({a}e0, p0) < least({b}e0, p2) then 1 else 0 end" for a, b in ((0, 5), (5, 12), (12, 19)))
    return {
        "route_paths": f"""with recursive {net}, q as (select s_suppkey as request, s_suppkey // 10 * 200 + s_suppkey * 37 % 200 as start, (s_suppkey // 10 // 3 * 3 + s_suppkey % 3) * 200 + (s_suppkey * 53 + 11) % 200 as goal from supplier),
          seeds as (select request, start as node, cast(0 as bigint) as ms from q where start in (select u from st)), {reach},
          walk as (select q.request, 0 as pos, p.edge, p.node, p.back, p.ms, p.metres from q join pred p on p.request = q.request and p.node = q.goal union all select w.request, pos + 1, p.edge, p.node, p.back, p.ms, p.metres from walk w join pred p on p.request = w.request and p.node = w.back)
          select request, pos, edge, node, ms, metres from walk""",
        "route_legs": f"with recursive {leg} select request, seq, edge, reverse, a, b, metres, ms, delay from pieces where a <> b or n = 1",
        "route_shapes": f"with recursive {leg}, l as (select trip, unnest(case when trip % 3 = 0 then [0, 1] else [0] end) as leg from tr) select trip, round(sum(metres), 2) as metres, cast(sum(ms + delay) as bigint) as ms, true as as_long from l join pieces p on p.request = trip * 2 + leg where a <> b or n = 1 group by trip having count(distinct leg) = case when trip % 3 = 0 then 2 else 1 end",
        "stored_routes": f"""with {kept}, j as (select ask.*, rt.route, seconds from ask join rt on rt.profile = ask.profile and abs(lon1 - lon) < 0.03 and abs(lat1 - lat) < 0.005),
          {located('s1', 'j', 'lon1', 'lat1', '0e0')}, f1 as (select * exclude (pos, off), pos as p0, off as o0, pos as p1 from s1 where off <= 150),
          {located('s2', "(select * exclude (p1), p1 as p1 from f1 where slon is not null)", 'slon', 'lat1', 'p0')}, f2 as (select * exclude (pos, off, p1), pos as p1 from s2 where off <= 150 union all select * exclude (p1), p1 from f1 where slon is null),
          {located('s3', 'f2', 'lon2', 'lat2', 'p1')}, z as (select request, route, seconds, p0, o0, pos as p2, off as o2 from s3 where off <= 150 and pos > p0),
          c as (select z.*, case when p0 = 0 and p2 = 19 then seconds else {part(0, 5)} + {part(5, 12)} + {part(12, 19)} end as took, case when p0 = 0 and p2 = 19 then 4 else {count} + 1 end as steps, {along('p0', 'p2')} as long from z)
          select request, cast(place as int) as place, route, round(p0, 6) as start, round(p2, 6) as "end", round(o0 + o2, 3) as off, cast(ceil(p2) - floor(p0) - 1 + 2 as int) as corners, round(took, 3) as seconds, steps
          from (select *, row_number() over (partition by request order by o0 + o2, took, route) as place from c where long >= 1) where place <= 3""",
    }
