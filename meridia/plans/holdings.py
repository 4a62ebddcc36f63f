"""Queries over places, fences, regions, feeds and pushed operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import places, spatial, sync, tracks
from ..streaming import queue as retry
from ..sources.tables import AS_OF, FAVOURITES_SQL, FENCES_SQL, HELD_SQL, OPERATIONS_SQL, PLACES_SQL, POINTS_SQL, REGIONS_SQL, ROUTES_SQL, TOMBSTONES_SQL, favourites, geofences, held_versions, load, operations, regions, routes, tombstones, trip_points
from ..sources import tables
from .sqltext import DEG, great_circle

HERE = (-79.9405, -2.1953, 400.0)
USER = 7
MIDDLE = "2024-01-15 00:00:00"


def known_operations(s, d):
    """Operations of the first half of the month with a status."""
    return operations(s, d).filter(f"created_at < timestamp'{MIDDLE}'").select("user_id", "operation_id", F.when(F.col("event_id") % 4 == 0, "FAILED").otherwise("APPLIED").alias("status"))


def later_operations(s, d):
    return operations(s, d).filter(f"created_at >= timestamp'{MIDDLE}'")


def batch(s, d):
    """Fixes of the second half, some with an impossible place or time."""
    p = trip_points(s, d).filter(f"recorded_at >= timestamp'{MIDDLE}'")
    return p.withColumn("lat", F.when(F.col("event_id") % 50 == 0, 91.0).otherwise(F.col("lat"))).withColumn("recorded_at", F.when(F.col("event_id") % 50 == 1, F.lit("1999-01-01").cast("timestamp")).otherwise(F.date_trunc("hour", "recorded_at")))


def held(s, d):
    return trip_points(s, d).filter("event_id % 3 = 0").withColumn("recorded_at", F.date_trunc("hour", "recorded_at"))


def manifests(s, d):
    r = regions(s, d)
    return r.filter("code <> 'r1'").select("code", F.concat("name", F.lit("!")).alias("name"), F.when(F.col("code") == "r2", "new").otherwise("old").alias("checksum"), F.when(F.col("code") == "r4", F.col("east")).otherwise(F.col("west")).alias("west"), "south", "east", "north").unionByName(
        r.filter("code = 'r0'").select(F.lit("r9").alias("code"), "name", F.lit("x").alias("checksum"), "west", "south", "east", "north"))


def queue(s, d):
    return operations(s, d).select("user_id", "event_id", "created_at", "operation_id", F.expr("created_at + make_interval(0, 0, 0, 0, int(event_id % 48))").alias("ready_at"), F.when(F.col("event_id") % 5 == 0, "COMPLETED").when(F.col("event_id") % 7 == 0, "FAILED").otherwise("PENDING").alias("status"), F.repeat("operation_id", (F.col("event_id") % 9).cast("int")).alias("payload"))


QUEUE_SQL = f"select user_id, event_id, created_at, operation_id, created_at + to_hours(event_id % 48) as ready_at, case when event_id % 5 = 0 then 'COMPLETED' when event_id % 7 = 0 then 'FAILED' else 'PENDING' end as status, repeat(operation_id, event_id % 9) as payload from ({OPERATIONS_SQL})"


def sends(s, d):
    """What became of the operations in the queue of each account: begun, failed for the n-th time, done."""
    e = F.col("event_id")
    kind = F.when(e % 5 < 2, "new").when(e % 35 == 4, "done").otherwise("failed")
    return load(s, d, "events").select(F.col("user_id").alias("account"), F.concat(F.lit("op"), e % 11).alias("op"), kind.alias("event"), F.when(kind == "failed", (e % 9 + 1).cast("int")).alias("attempt"), F.col("ts").cast("timestamp").alias("at"))


def queries():
    pl, fv = places.search_places, favourites
    found = lambda s, d, **k: pl(tables.places(s, d), fv(s, d), USER, **k)
    return {
        "places_nearby": lambda s, d: found(s, d, near=HERE).select("place_id", "metres", "favourite"),
        "places_text": lambda s, d: found(s, d, text="m_1", most=40, offset=5).select("place_id", "name", "category", "address", "favourite", "alias"),
        "places_favourites": lambda s, d: found(s, d, favourites_only=True, most=100000).select("place_id", "category", "alias"),
        "geofence_check": lambda s, d: spatial.inside_fences(tracks.latest_fix(trip_points(s, d)), geofences(s, d), "trip_id"),
        "region_locate": lambda s, d: places.located_regions(trip_points(s, d), regions(s, d), "event_id"),
        "regions_outermost": lambda s, d: places.outermost(regions(s, d).unionByName(regions(s, d).filter("code = 'r0'").withColumns({"code": F.lit("z"), "west": F.col("west") + 10, "east": F.col("east") + 10}))).select("code"),
        "version_updates": lambda s, d: places.version_updates(regions(s, d), held_versions(s, d)),
        "region_registry": lambda s, d: places.registered(regions(s, d).select("code", F.lit("old").alias("checksum")), manifests(s, d)),
        "feed_page": lambda s, d: sync.change_page(routes(s, d), tombstones(s, d), USER, ("1995-01-01 00:00:00", 100), 200).fillna(0, ["metres"]),
        "live_tombstones": lambda s, d: sync.live_tombstones(tombstones(s, d).unionByName(routes(s, d).filter("route_id % 2 = 0").selectExpr("route_id", "user_id", "updated_at as deleted_at")), routes(s, d)),
        "sync_push": lambda s, d: sync.pushed(known_operations(s, d), later_operations(s, d)),
        "ingest_dedupe": lambda s, d: sync.ingested(held(s, d), batch(s, d), AS_OF)[0].select("event_id", "trip_id", "recorded_at"),
        "ingest_rejected": lambda s, d: sync.ingested(held(s, d), batch(s, d), AS_OF)[1].select("event_id"),
        "ingest_counts": lambda s, d: sync.ingested(held(s, d), batch(s, d), AS_OF)[2],
        "routes_upserted": lambda s, d: sync.upserted(routes(s, d).select("route_id", "user_id", "metres"), routes(s, d).filter("route_id % 3 = 0").select("route_id", F.when(F.col("route_id") % 2 == 0, F.col("user_id")).otherwise(99).alias("user_id"), (F.col("metres") + 1).alias("metres")).unionByName(tombstones(s, d).select("route_id", "user_id", F.lit(5).cast("long").alias("metres"))), "route_id", "user_id"),
        "routes_patched": lambda s, d: sync.patched(routes(s, d).select("route_id", "user_id", "metres"), routes(s, d).filter("route_id % 4 = 0").select("route_id", F.when(F.col("route_id") % 3 == 0, F.lit(1)).cast("long").alias("metres")), "route_id"),
        "latest_per_user": lambda s, d: sync.latest_of(operations(s, d), ["user_id", "operation_id"], ["created_at", "event_id"]).select("user_id", "operation_id", "event_id", "operation"),
        "trip_states": lambda s, d: operations(s, d).select("event_id", sync.next_state(F.element_at(F.array(F.lit("ACTIVE"), F.lit("COMPLETED"), F.lit("CANCELLED")), (F.col("event_id") % 3 + 1).cast("int")), F.when(F.col("event_id") % 2 == 0, "finish").otherwise("cancel")).alias("state")),
        "point_chunks": lambda s, d: sync.numbered_chunks(trip_points(s, d), "trip_id", ["recorded_at", "event_id"], 25).groupBy("trip_id", "chunk").agg(F.count("*").alias("points"), F.min("event_id").alias("least")),
        "byte_batches": lambda s, d: sync.sized_batches(queue(s, d), "user_id", ["created_at", "event_id"], "payload", 200).select("event_id", "batch"),
        "queue_head": lambda s, d: sync.ready_head(queue(s, d), "user_id", ["created_at", "event_id"], "2024-01-10 00:00:00", 20).select("event_id"),
        "queue_status": lambda s, d: queue(s, d).groupBy("user_id").agg(F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "FAILED").alias("failed")),
        "queue_purged": lambda s, d: sync.purged(queue(s, d).withColumnRenamed("created_at", "updated_at"), AS_OF, 20).select("event_id", sync.backoff((F.col("event_id") % 12).cast("int")).alias("wait")),
        "remote_applied": lambda s, d: sync.remote_applied(routes(s, d).filter("route_id % 2 = 0").select("route_id", "user_id", "metres"), routes(s, d).filter("route_id % 5 = 0"), routes(s, d).filter("route_id % 3 = 0").select("route_id", "user_id", F.lit(0).cast("long").alias("metres")), routes(s, d).filter("route_id % 7 = 0"), USER),
        "queue_sendable": lambda s, d: retry.sendable_now(sends(s, d)),
    }


def oracle_sql():
    lon, lat, r = HERE
    away = great_circle("l.lon", "l.lat", "f.lon", "f.lat")
    pl = f"p as ({PLACES_SQL}), f as ({FAVOURITES_SQL}), v as (select p.*, f.alias, f.place_id is not null as favourite from p left join f on f.place_id = p.place_id and f.user_id = {USER} where p.user_id = {USER} or p.user_id is null)"
    spot = f"round({great_circle(f'{lon}e0', f'{lat}e0', 'lon', 'lat')}, 1)"
    half = "abs(l.lon - f.lon) <= half and abs(l.lat - f.lat) <= half and not (abs(l.lon - f.lon) < half / 4 and abs(l.lat - f.lat) < half / 4)"
    part = lambda x, i: f"coalesce(regexp_split_to_array(trim({x}), '[.\\-_]')[{i}], '0')"
    diff = lambda i: f"case when try_cast({part('latest', i)} as double) is not null and try_cast({part('held', i)} as double) is not null then sign(try_cast({part('latest', i)} as double) - try_cast({part('held', i)} as double)) when {part('latest', i)} > {part('held', i)} then 1 when {part('latest', i)} < {part('held', i)} then -1 else 0 end"
    ops = f"o as ({OPERATIONS_SQL})"
    b = f"b as (select event_id, user_id as trip_id, case when event_id % 50 = 1 then timestamp '1999-01-01' else date_trunc('hour', ts) end as recorded_at, event_id % 50 = 0 or event_id % 50 = 1 as bad from events where ts >= timestamp '{MIDDLE}'), h as (select user_id as trip_id, date_trunc('hour', ts) as recorded_at from events where event_id % 3 = 0)"
    new = "n as (select event_id, trip_id, recorded_at from b where not bad and not exists (select 1 from h where h.trip_id = b.trip_id and h.recorded_at = b.recorded_at) qualify row_number() over (partition by trip_id, recorded_at order by event_id) = 1)"
    rt = f"r as ({ROUTES_SQL}), t as ({TOMBSTONES_SQL})"
    q = f"q as ({QUEUE_SQL})"
    return {
        "places_nearby": f"with {pl}, w as (select place_id, {spot} as metres, favourite from v) select * from w where metres <= {r} order by metres, place_id limit 50",
        "places_text": f"with {pl} select place_id, name, category, address, favourite, alias from v where contains(lower(name), 'm_1') or contains(lower(coalesce(address, '')), 'm_1') or contains(lower(category), 'm_1') order by created_at desc, place_id limit 40 offset 5",
        "places_favourites": f"with {pl} select place_id, category, alias from v where favourite",
        "geofence_check": f"with p as ({POINTS_SQL}), l as (select * from p qualify row_number() over (partition by trip_id order by recorded_at desc, event_id desc) = 1), f as ({FENCES_SQL}) select trip_id, fence, round(coalesce(pi() * radius * radius, (pow(2 * half, 2) - pow(half / 2, 2)) * {DEG} * {DEG} * cos(radians(f.lat))), 0) as area from l join f on case when radius is not null then {away} <= radius else {half} end",
        "region_locate": f"with p as ({POINTS_SQL}), r as ({REGIONS_SQL}) select event_id, code, cast(row_number() over (partition by event_id order by (east - west) * (north - south), code) as int) as place from p join r on enabled and lon > west and lon < east and lat > south and lat < north",
        "regions_outermost": f"with a as (select code, west, south, east, north from ({REGIONS_SQL}) union all select 'z', west + 10, south, east + 10, north from ({REGIONS_SQL}) where code = 'r0') select code from a where not exists (select 1 from a b where b.code <> a.code and b.west <= a.west and b.south <= a.south and b.east >= a.east and b.north >= a.north)",
        "version_updates": f"with j as (select code, device, nullif(trim(h.version), '') as held, r.version as latest from ({HELD_SQL}) h join ({REGIONS_SQL}) r using (code) where enabled) select *, coalesce(nullif({diff(1)}, 0), nullif({diff(2)}, 0), nullif({diff(3)}, 0), {diff(4)}) > 0 as update from j",
        "region_registry": "select * from (values ('r0', 'unchanged', 'old'), ('r1', 'disabled', 'old'), ('r2', 'updated', 'new'), ('r3', 'unchanged', 'old'), ('r4', 'error', 'old'), ('r9', 'registered', 'x')) t(code, outcome, checksum)",
        "feed_page": f"with {rt}, c as (select route_id, updated_at as changed_at, false as deleted, metres from r where user_id = {USER} union all select route_id, deleted_at, true, null from t where user_id = {USER}), w as (select * replace (coalesce(metres, 0) as metres) from c where (changed_at, route_id) > (timestamp '1995-01-01', 100)) select *, (select count(*) from w) > 200 as more from w order by changed_at, route_id limit 200",
        "live_tombstones": f"with {rt} select user_id, route_id, max(deleted_at) as deleted_at from t group by all",
        "sync_push": f"with {ops}, k as (select distinct user_id, operation_id from o where created_at < timestamp '{MIDDLE}' and event_id % 4 <> 0), n as (select *, row_number() over (partition by user_id, operation_id order by created_at, event_id) as pos from o where created_at >= timestamp '{MIDDLE}') select event_id, user_id, operation_id, case when pos > 1 or exists (select 1 from k where k.user_id = n.user_id and k.operation_id = n.operation_id) then 'DUPLICATE' when operation = 'drop' or (entity = 'trip' and operation = 'delete') then 'FAILED' else 'APPLIED' end as status from n",
        "ingest_dedupe": f"with {b}, {new} select * from n",
        "ingest_rejected": f"with {b} select event_id from b where bad",
        "ingest_counts": f"with {b}, {new} select *, received - inserted - rejected as duplicates from (select (select count(*) from b) as received, (select count(*) from n) as inserted, (select count(*) from b where bad) as rejected)",
        "routes_upserted": f"with {rt} select route_id, user_id, case when route_id % 3 = 0 and (route_id % 2 = 0 or user_id = 99) then metres + 1 else metres end as metres from r union all select route_id, user_id, 5 from t",
        "routes_patched": f"with {rt} select route_id, user_id, case when route_id % 12 = 0 then 1 else metres end as metres from r",
        "latest_per_user": f"with {ops} select user_id, operation_id, event_id, operation from o qualify row_number() over (partition by user_id, operation_id order by created_at desc, event_id desc) = 1",
        "trip_states": "select event_id, case when event_id % 3 = 0 then case when event_id % 2 = 0 then 'COMPLETED' else 'CANCELLED' end when event_id % 3 = 1 and event_id % 2 = 0 then 'COMPLETED' when event_id % 3 = 2 and event_id % 2 = 1 then 'CANCELLED' end as state from events",
        "point_chunks": "with a as (select user_id as trip_id, event_id, (row_number() over (partition by user_id order by ts, event_id) - 1) // 25 as chunk from events) select trip_id, cast(chunk as int) as chunk, count(*) as points, min(event_id) as least from a group by all",
        "byte_batches": f"with {q} select event_id, cast((sum(strlen(payload)) over (partition by user_id order by created_at, event_id) - strlen(payload)) // 200 as int) as batch from q",
        "queue_head": f"with {q} select event_id from q qualify max(case when ready_at > timestamp '2024-01-10' then 1 else 0 end) over (partition by user_id order by created_at, event_id) = 0 and row_number() over (partition by user_id order by created_at, event_id) <= 20",
        "queue_status": f"with {q} select user_id, count(*) filter (status = 'PENDING') as pending, count(*) filter (status = 'FAILED') as failed from q group by user_id",
        "queue_purged": f"with {q} select event_id, cast(least(5 * pow(2, event_id % 12), 900) as int) as wait from q where status <> 'COMPLETED' or created_at >= timestamp '{AS_OF}' - interval 20 days",
        "remote_applied": f"with {rt}, c as (select route_id, user_id, 0 as metres from r where route_id % 3 = 0 and route_id % 5 <> 0) select * from c union all select route_id, user_id, metres from r where route_id % 2 = 0 and route_id not in (select route_id from c) and not (route_id % 7 = 0 and user_id = {USER})",
        "queue_sendable": """with e as (select user_id as account, 'op' || (event_id % 11) as op, case when event_id % 5 < 2 then 'new' when event_id % 35 = 4 then 'done' else 'failed' end as event, event_id % 9 + 1 as attempt, ts as moment from events),
          g as (select account, op, min(moment) filter (event = 'new') as created, coalesce(max(attempt) filter (event = 'failed'), 0) as attempts, coalesce(bool_or(event = 'done'), false) as done from e group by all),
          f as (select g.*, (select min(moment) from e where e.account = g.account and e.op = g.op and event = 'failed' and attempt = g.attempts) as failed from g),
          q as (select f.*, date_trunc('second', failed) + to_seconds(cast(least(5 * pow(2, attempts), 900) as bigint)) as next, now from f join (select account, max(moment) as now from e group by account) using (account) where not done and created is not null)
          select account, op, cast(attempts as int) as attempts from q qualify max(case when attempts > 0 and next > now then 1 else 0 end) over (partition by account order by created, op rows between unbounded preceding and current row) = 0""",
    }
