"""Geospatial inputs derived from the star-schema tables, each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import staging

PROFILES = ("CAR", "TRUCK", "MOTORCYCLE", "BICYCLE", "PEDESTRIAN")
AS_OF = "2024-01-31 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


POINTS_SQL = """select event_id, user_id as trip_id, ts as recorded_at,
  cast(-79.95 as double) + (event_id % 20) * cast(0.001 as double) + cast(0.0004 as double) as lon,
  cast(-2.20 as double) + (cast(floor(event_id / 20.0) as bigint) % 10) * cast(0.001 as double) + cast(0.00005 as double) as lat,
  value / cast(10.0 as double) as speed,
  case when event_id % 7 = 0 then null else cast(event_id % 60 as double) end as accuracy from events"""


def trip_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position fixes with trip, time, place, speed in m/s and accuracy in metres."""
    return load(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("trip_id"), F.col("ts").alias("recorded_at"),
        (F.lit(-79.95) + (F.col("event_id") % 20) * F.lit(0.001) + F.lit(0.0004)).alias("lon"),
        (F.lit(-2.20) + (F.expr("event_id div 20") % 10) * F.lit(0.001) + F.lit(0.00005)).alias("lat"),
        (F.col("value") / 10.0).alias("speed"),
        F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 60).cast("double")).alias("accuracy"),
    )


TRIPS_SQL = "select distinct user_id as trip_id, ['CAR', 'TRUCK', 'MOTORCYCLE', 'BICYCLE', 'PEDESTRIAN'][user_id % 5 + 1] as profile from events"


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = load(spark, sf_dir, "events").select(F.col("user_id").alias("trip_id")).distinct()
    return u.withColumn("profile", F.element_at(F.array(*[F.lit(p) for p in PROFILES]), (F.col("trip_id") % 5 + 1).cast("int")))


# Towns of 20 by 10 junctions stand side by side, a junction for each part. Some junctions miss a street, some towns have a
# footpath or a lone junction apart from the rest, and state roads join towns in groups of three.
NODES_SQL = """select *, -79.95e0 + (town % 200) * 2.7e-2 + x * 1e-3 as lon, -2.2e0 + (town // 200) * 2e-2 + y * 1e-3 as lat
  from (select p_partkey as node, p_partkey // 200 as town, p_partkey % 20 as x, p_partkey // 20 % 10 as y, p_size as size from part)"""
EDGES_SQL = f"""with n as ({NODES_SQL}), e as (
    select node * 2 as edge, node as u, node + 1 as v, case when apart then 'Sendero' when node % 17 <> 5 then 'C. ' || (y + 1) end as name, case when y % 2 = 0 then 2 when apart then 8 else 5 end as cls,
      case when y = 0 then 'E' || (town + 1) end as ref, case when y = 0 then 1 else 0 end + case when node % 200 in (50, 51) then 8 else 0 end as flags from (select *, town % 4 = 1 and node % 200 = 198 as apart from n)
      where x < 19 and not (town % 4 = 1 and node % 200 = 197) and not (town % 4 = 2 and node % 200 = 180)
    union all select node * 2 + 1, node, node + 20, 'Av. ' || chr((65 + x)::int), 5, null, 0 from n where y < 9 and size % 7 <> 0 and not (town % 4 = 1 and node % 200 in (178, 179)) and not (town % 4 = 2 and node % 200 = 160)
    union all select town * 400 + 399, node, node + 181, null, case when town % 3 = 0 then 11 else 1 end, case when town % 3 > 0 then 'E' || (town + 1) end, case when town % 3 > 0 then 1 else 0 end from n where node % 200 = 99 and (town + 1) % 3 > 0)
  select edge, u, v, name, cast(cls as int) as cls, ref, cast(flags + case when edge % 13 = 0 then 2 else 0 end as int) as flags, cast(u % 3 as bigint) as parish,
    case when edge % 3 = 0 then [{{'lon': a.lon, 'lat': a.lat}}, {{'lon': (a.lon + b.lon) / 2 + 2e-5, 'lat': (a.lat + b.lat) / 2 + 2e-5}}, {{'lon': b.lon, 'lat': b.lat}}]
      else [{{'lon': a.lon, 'lat': a.lat}}, {{'lon': b.lon, 'lat': b.lat}}] end as shape
  from e join n a on e.u = a.node join n b on e.v = b.node"""
SEGMENTS_SQL = f"select edge, cls, flags, name, i, shape[i].lon as x1, shape[i].lat as y1, shape[i + 1].lon as x2, shape[i + 1].lat as y2 from (select *, unnest(range(1, len(shape))) as i from ({EDGES_SQL}))"
STATE, UNPAVED, APPROXIMATE, ROUNDABOUT = 1, 2, 4, 8  # flags of an edge
MOTOR_CLASS = 7  # classes up to this one carry motors
CONNECTOR = 11


def road_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A junction for each part: node, town, place in the town's grid, position."""
    n = load(spark, sf_dir, "part").selectExpr("p_partkey as node", "p_partkey div 200 as town", "p_partkey % 20 as x", "p_partkey div 20 % 10 as y", "p_size as size")
    return n.withColumns({
        "lon": F.lit(-79.95) + (F.col("town") % 200) * F.lit(2.7e-2) + F.col("x") * F.lit(1e-3),
        "lat": F.lit(-2.2) + F.expr("town div 200") * F.lit(2e-2) + F.col("y") * F.lit(1e-3)})


def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets east and north of each junction and state roads between towns, with class, flags, name, number and shape; every third one bends."""
    n = road_nodes(spark, sf_dir)
    at, kind = F.col("node") % 200, F.col("town") % 4
    apart = (kind == 1) & (at == 198)
    east = n.filter((F.col("x") < 19) & ~((kind == 1) & (at == 197)) & ~((kind == 2) & (at == 180))).select(
        (F.col("node") * 2).alias("edge"), F.col("node").alias("u"), (F.col("node") + 1).alias("v"), F.when(apart, "Sendero").when(F.col("node") % 17 != 5, F.concat(F.lit("C. "), F.col("y") + 1)).alias("name"),
        F.when(F.col("y") % 2 == 0, 2).when(apart, 8).otherwise(5).alias("cls"), F.when(F.col("y") == 0, F.concat(F.lit("E"), F.col("town") + 1)).alias("ref"),
        (F.when(F.col("y") == 0, STATE).otherwise(0) + F.when(at.isin(50, 51), ROUNDABOUT).otherwise(0)).alias("flags"))
    north = n.filter((F.col("y") < 9) & (F.col("size") % 7 != 0) & ~((kind == 1) & at.isin(178, 179)) & ~((kind == 2) & (at == 160))).select(
        (F.col("node") * 2 + 1).alias("edge"), F.col("node").alias("u"), (F.col("node") + 20).alias("v"), F.concat(F.lit("Av. "), F.char(F.col("x") + 65)).alias("name"),
        F.lit(5).alias("cls"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("flags"))
    linked = F.col("town") % 3 > 0
    between = n.filter((at == 99) & ((F.col("town") + 1) % 3 > 0)).select(
        (F.col("town") * 400 + 399).alias("edge"), F.col("node").alias("u"), (F.col("node") + 181).alias("v"), F.lit(None).cast("string").alias("name"),
        F.when(linked, 1).otherwise(CONNECTOR).alias("cls"), F.when(linked, F.concat(F.lit("E"), F.col("town") + 1)).alias("ref"), F.when(linked, STATE).otherwise(0).alias("flags"))
    ends = n.select("node", "lon", "lat")
    e = east.unionByName(north).unionByName(between).join(staging.apart(ends.toDF("u", "ax", "ay")), "u").join(staging.apart(ends.toDF("v", "bx", "by")), "v")
    a, b = point(F.col("ax"), F.col("ay")), point(F.col("bx"), F.col("by"))
    mid = point((F.col("ax") + F.col("bx")) / 2 + F.lit(2e-5), (F.col("ay") + F.col("by")) / 2 + F.lit(2e-5))
    flags = F.col("flags") + F.when(F.col("edge") % 13 == 0, UNPAVED).otherwise(0)
    return e.select("edge", "u", "v", "name", "cls", "ref", flags.alias("flags"), (F.col("u") % 3).alias("parish"), F.when(F.col("edge") % 3 == 0, F.array(a, mid, b)).otherwise(F.array(a, b)).alias("shape"))


FENCES_SQL = """select n_nationkey as fence, -79.95e0 + (n_nationkey % 20) * 1e-3 as lon, -2.2e0 + (n_nationkey // 3) * 1e-3 as lat,
  case when n_nationkey % 2 = 0 then 150e0 + 10e0 * n_nationkey end as radius, 2e-3 + 1e-4 * n_nationkey as half from nation"""


def geofences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles (radius in metres) for even keys, else squares as closed rings with a square hole of a quarter of the side."""
    k = F.col("n_nationkey")
    f = load(spark, sf_dir, "nation").select(
        k.alias("fence"), (F.lit(-79.95) + (k % 20) * F.lit(1e-3)).alias("lon"), (F.lit(-2.2) + F.expr("n_nationkey div 3") * F.lit(1e-3)).alias("lat"),
        F.when(k % 2 == 0, F.lit(150.0) + F.lit(10.0) * k).alias("radius"), (F.lit(2e-3) + F.lit(1e-4) * k).alias("half"))
    ring = lambda h: F.array(*[point(F.col("lon") + x * h, F.col("lat") + y * h) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    return f.withColumn("rings", F.when(F.col("radius").isNull(), F.array(ring(F.col("half")), ring(F.col("half") / 4))))


PLACES_SQL = """select c_custkey as place_id, case when c_custkey % 10 <> 0 then c_nationkey end as user_id, c_name as name, c_mktsegment as category,
  case when c_custkey % 4 = 0 then 'Km_' || (c_custkey % 13) || ' 100%' end as address, timestamp '2024-01-01' + to_minutes(c_custkey % 500) as created_at,
  -79.95e0 + (c_custkey % 20) * 1e-3 as lon, -2.2e0 + ((c_custkey // 20) % 10) * 1e-3 as lat from customer"""
FAVOURITES_SQL = "select c_nationkey as user_id, c_custkey as place_id, 'fav ' || c_custkey as alias from customer where c_custkey % 3 = 0"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of users; those without a user are shared."""
    k = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(
        k.alias("place_id"), F.when(k % 10 != 0, F.col("c_nationkey")).alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"),
        F.when(k % 4 == 0, F.concat(F.lit("Km_"), k % 13, F.lit(" 100%"))).alias("address"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, int(c_custkey % 500))").alias("created_at"),
        (F.lit(-79.95) + (k % 20) * F.lit(1e-3)).alias("lon"), (F.lit(-2.2) + (F.expr("c_custkey div 20") % 10) * F.lit(1e-3)).alias("lat"))


def favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return load(spark, sf_dir, "customer").filter(k % 3 == 0).select(F.col("c_nationkey").alias("user_id"), k.alias("place_id"), F.concat(F.lit("fav "), k).alias("alias"))


REGIONS_SQL = """select 'r' || r_regionkey as code, r_name as name, '2026.0' || (r_regionkey + 1) || '.01' as version, r_regionkey <> 3 as enabled,
  -79.95e0 - 0.02e0 / (r_regionkey + 1) as west, -2.2e0 - 0.02e0 / (r_regionkey + 1) as south, -79.95e0 + 0.04e0 / (r_regionkey + 1) as east, -2.2e0 + 0.04e0 / (r_regionkey + 1) as north from region"""
HELD_SQL = "select 'r' || (s_suppkey % 6) as code, case s_suppkey % 4 when 0 then '2026.02' when 1 then ' 2026.2.1 ' when 2 then '2025-12-31' else '2026.03.01_b' end as version, s_suppkey as device from supplier"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested boxes of decreasing size, with data versions."""
    k = F.col("r_regionkey")
    return load(spark, sf_dir, "region").select(
        F.concat(F.lit("r"), k).alias("code"), F.col("r_name").alias("name"), F.concat(F.lit("2026.0"), k + 1, F.lit(".01")).alias("version"), (k != 3).alias("enabled"),
        (F.lit(-79.95) - F.lit(0.02) / (k + 1)).alias("west"), (F.lit(-2.2) - F.lit(0.02) / (k + 1)).alias("south"), (F.lit(-79.95) + F.lit(0.04) / (k + 1)).alias("east"), (F.lit(-2.2) + F.lit(0.04) / (k + 1)).alias("north"))


def held_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that devices hold, one region of them unknown."""
    s = F.col("s_suppkey")
    v = F.when(s % 4 == 0, "2026.02").when(s % 4 == 1, " 2026.2.1 ").when(s % 4 == 2, "2025-12-31").otherwise("2026.03.01_b")
    return load(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), s % 6).alias("code"), v.alias("version"), s.alias("device"))


ROUTES_SQL = "select o_orderkey as route_id, o_custkey % 20 as user_id, o_orderdate as updated_at, cast(round(o_totalprice) as bigint) as metres from orders where o_orderstatus <> 'F'"
TOMBSTONES_SQL = "select o_orderkey as route_id, o_custkey % 20 as user_id, o_orderdate as deleted_at from orders where o_orderstatus = 'F'"


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").selectExpr("o_orderkey as route_id", "o_custkey % 20 as user_id", "o_orderdate as updated_at", "cast(round(o_totalprice) as bigint) as metres")


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey as route_id", "o_custkey % 20 as user_id", "o_orderdate as deleted_at")


OPERATIONS_SQL = """select event_id, user_id, 'op' || json_extract_string(props, '$.k') as operation_id, ['route', 'trip', 'favorite', 'place'][event_id % 4 + 1] as entity,
  case when event_id % 9 = 0 then 'drop' when event_id % 3 = 0 then 'delete' else 'upsert' end as operation, ts as created_at from events"""


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations that clients push, many of them repeated."""
    e = F.col("event_id")
    return load(spark, sf_dir, "events").select(
        "event_id", "user_id", F.concat(F.lit("op"), F.get_json_object("props", "$.k")).alias("operation_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("route", "trip", "favorite", "place")]), (e % 4 + 1).cast("int")).alias("entity"),
        F.when(e % 9 == 0, "drop").when(e % 3 == 0, "delete").otherwise("upsert").alias("operation"), F.col("ts").alias("created_at"))


NAMES = ("Malecón Simón Bolívar", "Ambato", "Hospitales del Río", "Plaza de la Integración", "Calle Ñandú", "Ambato Norte", "Terminal Terrestre", "São Paulo")
NAMES_SQL = "['Malecón Simón Bolívar', 'Ambato', 'Hospitales del Río', 'Plaza de la Integración', 'Calle Ñandú', 'Ambato Norte', 'Terminal Terrestre', 'São Paulo']"
ENTRIES_SQL = f"""select p_partkey as entry, {NAMES_SQL}[p_partkey % 8 + 1] || case when p_partkey % 8 in (1, 6) and p_partkey % 3 > 0 then '' else ' ' || p_size end as name,
  ['admin', 'place', 'poi', 'street'][p_partkey % 4 + 1] as kind, ['city', 'suburb', 'hospital', 'avenida', 'town'][p_partkey % 5 + 1] as type, p_size as rank,
  'Tarqui, ' || p_brand as context, lpad((p_partkey % 300)::varchar, 6, '0') as parish, -79.95e0 + (p_partkey % 20) * 1e-3 as lon, -2.2e0 + ((p_partkey // 20) % 10) * 1e-3 as lat from part"""


def search_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named places, points of interest and streets."""
    k = F.col("p_partkey")
    at = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), (k % len(values) + 1).cast("int"))
    tail = F.when((k % 8).isin(1, 6) & (k % 3 > 0), "").otherwise(F.concat(F.lit(" "), F.col("p_size")))
    return load(spark, sf_dir, "part").select(
        k.alias("entry"), F.concat(at(NAMES), tail).alias("name"), at(("admin", "place", "poi", "street")).alias("kind"), at(("city", "suburb", "hospital", "avenida", "town")).alias("type"),
        F.col("p_size").alias("rank"), F.concat(F.lit("Tarqui, "), F.col("p_brand")).alias("context"), F.lpad((k % 300).cast("string"), 6, "0").alias("parish"),
        (F.lit(-79.95) + (k % 20) * F.lit(1e-3)).alias("lon"), (F.lit(-2.2) + (F.expr("p_partkey div 20") % 10) * F.lit(1e-3)).alias("lat"))
