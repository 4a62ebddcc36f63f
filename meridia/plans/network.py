"""Queries over the road graph, search, catalogue and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import catalogue, classify, graph, search, tagged, tiles
from ..sources.tables import EDGES_SQL, ENTRIES_SQL, NODES_SQL, NAMES_SQL, load, point, road_edges, road_nodes, search_entries, trip_points
from .sqltext import folded, great_circle, to_segment

ASKED = [(1, "malecon", -79.94, -2.195), (2, "Ambato", -79.945, -2.199), (3, "plaza integracion", -79.935, -2.2), (4, "hospitales rio ", -79.94, -2.19), (5, "calle nan", -79.932, -2.196)]


def lines(s, d):
    """Streets as they were drawn, per town: rows of the grid whole, columns whole, and some stubs."""
    k = F.col("node") % 200
    n = road_nodes(s, d).filter(k < 25).select((F.col("town") * 25 + k).alias("line"), k.alias("k"), (F.lit(-79.95) + (F.col("town") % 200) * F.lit(2.7e-2)).alias("lon"), (F.lit(-2.2) + F.expr("town div 200") * F.lit(2e-2)).alias("lat"))
    at = lambda x, y: point(F.col("lon") + x * F.lit(1e-3), F.col("lat") + y * F.lit(1e-3))
    row = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda x: at(x, F.col("k")))
    column = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda y: at(F.col("k") - 10, y))
    stub = F.array(at(F.col("k") - 15, F.lit(3)), at(F.col("k") - F.lit(14.5), F.lit(3.5)))
    return n.select("line", F.when(F.col("k") < 10, row).when(F.col("k") < 20, column).otherwise(stub).alias("shape"))


VERTEX_SQL = """select t * 25 + k as line, t, x, y from (select p_partkey // 200 as t, p_partkey % 200 as k from part where p_partkey % 200 < 25) l,
  (select 'r' as c, unnest(range(20)) * 1.0 as i union all select 'c', unnest(range(10)) * 1.0 union all select 's', unnest([0.0, 0.5])) v,
  lateral (select case when c = 'r' then i when c = 'c' then k - 10.0 else k - 15.0 + i end as x, case when c = 'r' then k * 1.0 when c = 'c' then i else 3.0 + i end as y)
  where c = case when k < 10 then 'r' when k < 20 then 'c' else 's' end"""
TOWN_LON, TOWN_LAT = "(-79.95e0 + t % 200 * 2.7e-2 + {} * 1e-3)", "(-2.2e0 + t // 200 * 2e-2 + {} * 1e-3)"


def asked(s):
    return s.createDataFrame(ASKED, "query long, text string, lon double, lat double")


def trips_asked(s, d):
    """Requests from one end of a town to the other, a dozen in each."""
    i, t = F.col("s_suppkey") % 20, F.expr("s_suppkey div 20")
    shift = (t % 200) * F.lit(2.7e-2)
    return load(s, d, "supplier").select(F.col("s_suppkey").alias("request"), (F.lit(-79.9503) + shift + i * 1.1e-3).alias("lon1"), (F.lit(-2.1985) + F.expr("s_suppkey div 4000") * 2e-2).alias("lat1"), (F.lit(-79.9317) + shift - i * 0.9e-3).alias("lon2"), (F.lit(-2.1928) + F.expr("s_suppkey div 4000") * 2e-2).alias("lat2"))


def streets(s, d):
    """Street segments from orders: a label, a parish, a kind, a name with an alias, and a bent shape."""
    o, k = load(s, d, "orders"), F.col("o_orderkey")
    x, y = F.lit(-79.95) + (k % 97) * F.lit(1e-4), F.lit(-2.2) + (k % 89) * F.lit(1e-4)
    kinds = ("AVENIDA", "CALLE", "PASAJE", "VIA", "AUTOPISTA")
    return o.select(
        F.concat(F.lit("C. "), F.col("o_custkey") % 50).alias("label"), (F.col("o_custkey") % 7).alias("parish"), F.element_at(F.array(*[F.lit(v) for v in kinds]), (F.col("o_custkey") % 5 + 1).cast("int")).alias("kind"),
        F.concat(F.lit("12 S-E (Alias "), k % 3, F.lit(")")).alias("name"),
        F.array(point(x, y), point(x + (k % 5 + 1) * F.lit(1e-4), y), point(x + F.lit(1e-4), y + (k % 3 + 1) * F.lit(1e-4))).alias("shape"))


STREETS_SQL = """select 'C. ' || (o_custkey % 50) as label, o_custkey % 7 as parish, ['AVENIDA', 'CALLE', 'PASAJE', 'VIA', 'AUTOPISTA'][o_custkey % 5 + 1] as kind, 'Alias ' || (o_orderkey % 3) as alias,
  -79.95e0 + (o_orderkey % 97) * 1e-4 as x1, -2.2e0 + (o_orderkey % 89) * 1e-4 as y1, x1 + (o_orderkey % 5 + 1) * 1e-4 as x2, y1 as y2, x1 + 1e-4 as x3, y1 + (o_orderkey % 3 + 1) * 1e-4 as y3 from orders"""


def suburbs(s, d):
    """Suburbs named by stage and sector, and places of a few of the families' names."""
    k = F.col("c_custkey")
    fam = F.element_at(F.array(*[F.lit(v) for v in ("Alborada", "Urb. Kennedy Norte", "Urdesa Central", "Cdla. Sauces")]), (k % 4 + 1).cast("int"))
    tail = F.when(k % 3 == 0, F.concat(F.lit(" "), k % 9 + 1, F.lit(" Etapa"))).when(k % 3 == 1, F.concat(F.lit(" - IX Etapa / Sector "), k % 5)).otherwise(F.concat(F.lit(" Sector "), k % 7))
    return load(s, d, "customer").select(
        k.alias("entry"), F.when(k % 97 == 0, "Sauces").otherwise(F.concat(fam, tail)).alias("name"), F.when(k % 97 == 0, "admin").otherwise("place").alias("kind"), F.when(k % 97 == 0, "parish").otherwise("suburb").alias("type"),
        (k % 30).cast("int").alias("rank"), F.lpad((k % 200).cast("string"), 6, "0").alias("parish"), (F.lit(-79.95) + (k % 100) * F.lit(1e-3)).alias("lon"), (F.lit(-2.2) + (k % 70) * F.lit(1e-3)).alias("lat"))


SUBURBS_SQL = """select c_custkey as entry, c_custkey % 97 = 0 as known, ['Alborada', 'Kennedy Norte', 'Urdesa Central', 'Sauces'][c_custkey % 4 + 1] as near, ['', 'Kennedy', 'Urdesa', ''][c_custkey % 4 + 1] as far,
  c_custkey % 30 as rank, substr(lpad((c_custkey % 200)::varchar, 6, '0'), 1, 4) as canton, -79.95e0 + (c_custkey % 100) * 1e-3 as lon, -2.2e0 + (c_custkey % 70) * 1e-3 as lat from customer"""


def poi_names(s, d):
    k = F.col("p_partkey")
    names = ("Hospital del Río", "Terminal Terrestre", "Plaza Comercial", "Parque La Carolina", "Café Ñandú", "Puerto Bolívar", "Puerto de la Camaronera", "UPC Norte", "Estación del Tren", "sin nada")
    cats = ("PARQUE", "TEMPLO RELIGIOSO", "OTRO", None)
    at = lambda v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    return load(s, d, "part").select(k.alias("id"), at(names).alias("name"), at(cats).alias("category"))


def areas(s, d):
    from ..sources.tables import geofences

    return geofences(s, d).filter("rings is not null").select(F.col("fence").alias("area"), "rings")


def cells(s, d):
    k = F.col("c_custkey")
    return load(s, d, "customer").select(k.alias("cell"), (F.lit(-79.952) + (k % 211) * F.lit(1.13e-4)).alias("lon"), (F.lit(-2.203) + (k % 173) * F.lit(1.07e-4)).alias("lat"), (k % 40).alias("people"))


def world(s, d):
    k = F.col("c_custkey")
    names = ("Lima", "Madrid", "Perú", "São Paulo", "New York", "Lima Norte", "Guayaquil")
    return load(s, d, "customer").select(
        k.alias("id"), F.element_at(F.array(*[F.lit(v) for v in names]), (k % 7 + 1).cast("int")).alias("name"), F.when(k % 7 == 4, "Nueva York").alias("name_es"), F.when(k % 7 == 2, "country").otherwise("city").alias("type"),
        F.element_at(F.array(F.lit("Peru"), F.lit("Spain"), F.lit("Brazil")), (k % 3 + 1).cast("int")).alias("country"), F.lit(None).cast("string").alias("country_es"), F.lit("XX").alias("country_code"), F.col("c_mktsegment").alias("admin1"),
        F.when(k % 5 == 0, "2").when(k % 5 == 1, "4").alias("capital"), (k * 7919 % 3000000).alias("population"))


WORLD_Q = [(1, "lima"), (2, "são"), (3, "lima, per"), (4, "nueva"), (5, "york"), (6, "lima spain"), (7, "x")]


def roads(s, d):
    k = F.col("p_partkey")
    cls = ("motorway", "trunk", "primary", "secondary", "tertiary", "street", "footway", "path")
    return load(s, d, "part").select(k.alias("road"), F.element_at(F.array(*[F.lit(c) for c in cls]), (k % 8 + 1).cast("int")).alias("class"), F.when(k % 3 > 0, F.col("p_name")).alias("name"), F.when(k % 5 == 0, F.concat(F.lit("E"), k % 40)).alias("ref"), F.when((k % 11 == 0) & (k % 8 < 3), "overview").alias("scope"))


def pixels(s, d):
    """Vectors as rows of pixels, 16 wide."""
    e = load(s, d, "embeddings").select(F.col("vec_id").alias("tile"), F.posexplode("embedding").alias("i", "value"))
    return e.select("tile", (F.col("i") % 16).cast("long").alias("x"), F.floor(F.col("i") / 16).alias("y"), F.round(F.col("value").cast("decimal(20,6)"), 6).cast("double").alias("value"), F.when(F.col("i") % 5 == 0, 0.0).otherwise(1.0).alias("weight"))


TAGS = (("amenity", "Hospital "), ("amenity", "fast_food"), ("shop", "vacant"), ("shop", "kiosk"), ("shop", "bakery"), ("aeroway", "aerodrome"), ("natural", "water"), ("natural", "wood"), ("waterway", "brook"), ("waterway", "dock"), ("landuse", "basin"), ("leisure", "park"), ("tourism", "zoo"), ("healthcare", "lab"), ("amenity", "parking"), ("none", ""))


BOTH = ("Lima", "São Paulo", "Quito", "Cuenca", "SAO PAULO")


def two_rankings(s, d):
    """For each nation a detailed ranking of parts and one of customers, with names in common, at a few places far apart; and its map."""
    from pyspark.sql import Window

    p, c, n = F.col("p_partkey"), F.col("c_custkey"), F.col("n_nationkey")
    at = lambda k, v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    rank = lambda *o: F.row_number().over(Window.partitionBy("query").orderBy(*o))
    a = load(s, d, "part").withColumn("query", p % 25).select("query", rank(F.desc("p_size"), p).alias("place"), p.alias("id"), at(F.expr("p_partkey div 25"), BOTH).alias("name"), at(F.expr("p_partkey div 75"), ("city", "town", "street")).alias("type"), (F.lit(-80.0) + F.expr("p_partkey div 125 % 3") * 9.0).alias("lon"), F.lit(-2.0).alias("lat"))
    b = load(s, d, "customer").withColumn("query", F.col("c_nationkey").cast("long")).select("query", rank(c).alias("place"), c.alias("id"), at(c, BOTH).alias("name"), (F.lit(-80.0) + F.expr("c_custkey div 5 % 4") * 9.0).alias("lon"), F.lit(-2.0).alias("lat"), (c % 3 == 0).alias("important"))
    return a, b, load(s, d, "nation").select(n.cast("long").alias("query"), F.when(n % 2 == 0, -78.0).alias("lon"), F.when(n % 2 == 0, -2.0).alias("lat"))


def tagged_rows(s, d):
    """A tag by key, and a second one for some."""
    k = F.col("p_partkey")
    at = lambda i: F.element_at(F.array(*[F.lit(t[i]) for t in TAGS]), (k % len(TAGS) + 1).cast("int"))
    return load(s, d, "part").select(k.alias("id"), F.map_concat(F.create_map(at(0), at(1)), F.when(k % 3 == 0, F.create_map(F.lit("covered"), F.lit("yes"), F.lit("iata"), F.lit("X"), F.lit("parking"), F.lit("rooftop"))).otherwise(F.create_map(F.lit("name"), F.lit("n")))).alias("tags"))


def borders(s, d):
    k = F.col("o_orderkey")
    ways = load(s, d, "orders").select(k.alias("way"), F.create_map(F.lit("boundary"), F.when(k % 5 == 0, "disputed").otherwise("administrative"), F.lit("admin_level"), (k % 13).cast("string"), F.lit("maritime"), F.when(k % 4 == 0, "yes").otherwise("no")).alias("tags"))
    members = load(s, d, "lineitem").select(F.col("l_orderkey").alias("way"), F.col("l_suppkey").alias("relation"))
    r = F.col("s_suppkey")
    relations = load(s, d, "supplier").filter(r % 8 == 3).select(r.alias("relation"), (r % 9 + 2).cast("int").alias("level"), (r % 7 == 0).alias("disputed"), (r % 11 == 0).alias("maritime"))  # the other members' relations are no borders
    return tagged.boundaries(ways, members, relations)


def queries():
    return {
        "node_degree": lambda s, d: graph.node_degree(road_edges(s, d)),
        "components": lambda s, d: graph.components(road_nodes(s, d), road_edges(s, d)),
        "components_motor": lambda s, d: graph.components(road_nodes(s, d), road_edges(s, d).filter(graph.for_motors())),
        "shortest_path_costs": lambda s, d: graph.travel_times(road_edges(s, d), road_nodes(s, d).filter("node % 1000 in (105, 580)").select("node"), "CAR"),
        "street_intersections": lambda s, d: graph.street_junctions(road_edges(s, d)),
        "turns": lambda s, d: graph.turns(road_edges(s, d)).select("node", "out_of", "into", "kind"),
        "noding": lambda s, d: graph.noded(lines(s, d)).select("line", "part", "metres"),
        "dead_ends": lambda s, d: graph.dead_ends(lines(s, d)),
        "snap_pairs": lambda s, d: graph.snap_pairs(trips_asked(s, d), road_edges(s, d), graph.components(road_nodes(s, d), road_edges(s, d)), "CAR", 90.0, 3).select("request", "metres"),
        "line_length": lambda s, d: road_edges(s, d).select("edge", F.round(geo.line_length(F.col("shape")), 3).alias("metres")),
        "ring_area": lambda s, d: areas(s, d).select("area", F.round(geo.ring_area(F.col("rings")[0]) * 1e6, 6).alias("square"), F.round(geo.ring_centre(F.col("rings")[0])["lon"], 9).alias("lon"), F.round(geo.ring_centre(F.col("rings")[0])["lat"], 9).alias("lat")),
        "search_fold_tokens": lambda s, d: search.token_counts(search_entries(s, d)),
        "search_ranked": lambda s, d: search.search(search_entries(s, d), asked(s)).select("query", "place", "entry", F.round("score", 4).alias("score")),
        "world_search": lambda s, d: search.world_search(world(s, d), s.createDataFrame(WORLD_Q, "query long, text string")),
        "reverse_geocode": lambda s, d: search.reverse(trip_points(s, d), search_entries(s, d), road_edges(s, d), "event_id"),
        "merged_search": lambda s, d: search.merged(*two_rankings(s, d)),
        "street_rollup": lambda s, d: catalogue.street_rollup(streets(s, d)).select("label", "parish", "metres", "rank", "aliases", *[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")]),
        "neighbourhood_groups": lambda s, d: catalogue.neighbourhood_groups(suburbs(s, d)).select("canton", "name", "members", "rank"),
        "alias_resolve": lambda s, d: catalogue.resolved_aliases(search_entries(s, d), s.createDataFrame([("M2000", "malecon simon", None, None), ("TT", "Terminal", "poi", None), ("AN", "ambato norte 7", None, "0001"), ("none", "nowhere", None, None)], "alias string, target string, kind string, prefix string")).fillna(-1, ["entry"]),
        "population_by_area": lambda s, d: catalogue.population(cells(s, d), areas(s, d)),
        "spelling_learner": lambda s, d: catalogue.spellings(search_entries(s, d).select("name")),
        "poi_classify": lambda s, d: poi_names(s, d).withColumn("c", classify.poi_class(F.col("name"), F.col("category"))).select("id", "c.class", "c.subclass", "c.rank"),
        "place_class": lambda s, d: cells(s, d).withColumn("c", classify.place_class(F.element_at(F.array(*[F.lit(x) for x in ("country", "region", "city", "town", "village", "suburb", "farm", "other")]), (F.col("cell") % 8 + 1).cast("int")), F.col("people") * 40000)).select("cell", "c.class", "c.rank", "c.zoom").fillna(0, ["rank", "zoom"]),
        "area_class": lambda s, d: cells(s, d).withColumn("c", classify.area_class(F.element_at(F.array(F.lit("CAPITAL PROVINCIAL"), F.lit("CABECERA CANTONAL"), F.lit("CABECERA PARROQUIAL"), F.lit("X")), (F.col("cell") % 4 + 1).cast("int")), F.col("people") * 40000)).select("cell", "c.class", "c.rank", "c.place_rank"),
        "tag_classes": lambda s, d: tagged_rows(s, d).withColumn("p", tagged.poi_of_tags(F.col("tags"))).select("id", "p.class", "p.subclass", F.coalesce("p.zoom", F.lit(-1)).alias("zoom"), F.coalesce("p.rank", F.lit(-1)).alias("rank"), tagged.landuse_of_tags(F.col("tags")).alias("landuse"), tagged.water_of_tags(F.col("tags")).alias("water"), tagged.waterway_of_tags(F.col("tags")).alias("waterway")),
        "boundaries": borders,
        "tile_of_point": lambda s, d: tiles.tiled(trip_points(s, d), 17).select("x", "y", "points", F.round("west", 6).alias("west"), F.round("north", 6).alias("north")),
        "tile_parents": lambda s, d: tiles.parents(tiles.tiled(trip_points(s, d), 17), 2),
        "tile_zoom_explode": lambda s, d: tiles.road_features(roads(s, d)),
        "label_grid_topn": lambda s, d: tiles.label_grid(search_entries(s, d).select(F.col("entry").alias("id"), "lon", "lat", (-F.col("rank")).alias("sort_key")), 14),
        "raster_block_mean": lambda s, d: tiles.halved(pixels(s, d)),
        "raster_pyramid": lambda s, d: tiles.pyramid(pixels(s, d), 2).groupBy("level", "tile").agg(F.count("*").alias("pixels"), F.round(F.sum("weight"), 3).alias("weight")),
        "terrarium_roundtrip": lambda s, d: tiles.encoded(load(s, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 64 - 500).alias("height"))).select("o_orderkey", "r", "g", "b", (F.abs(geo.from_terrarium(F.col("r"), F.col("g"), F.col("b")) - F.col("height")) <= 1 / 512).alias("near")),
        "tile_curve": lambda s, d: road_nodes(s, d).select(geo.tile_x(F.col("lon"), F.lit(16)).alias("x"), geo.tile_y(F.col("lat"), F.lit(16)).alias("y")).distinct().select("x", "y", tiles.hilbert(F.col("x"), F.col("y"), 16).alias("place")),
    }


def oracle_sql():
    e = f"e as ({EDGES_SQL})"
    both = "b as (select u, v from e union all select v, u from e)"
    comp = lambda w: f"with recursive {e}, k as (select * from e where {w}), b as (select u, v from k union all select v, u from k), r using key (node) as (select u as node, min(u) as c from b group by u union select b.v, min(r.c) from r join b on r.node = b.u left join recurring.r old on old.node = b.v where r.c < old.c group by b.v), z as (select c, count(*) as size from r group by c) select p_partkey as node, coalesce(c, -1) as component, coalesce(size, 0) as size from part left join r on r.node = p_partkey left join z using (c)"
    length = f"list_sum(list_transform(range(1, len(shape)), lambda i: {great_circle('shape[i].lon', 'shape[i].lat', 'shape[i + 1].lon', 'shape[i + 1].lat')}))"
    town = "[80, 60, 55, 45, 35, 28, 15, 20, 0, 0, 0, 25]"
    kph = f"(case when flags & 1 > 0 and cls <= 2 then [90, 65, 55][cls + 1] else {town}[cls + 1] end * case when flags & 2 > 0 then 0.6e0 else 1e0 end)"
    n = f"n as (select p_partkey as entry, {folded('name')} as key, * from ({ENTRIES_SQL}) x join part on p_partkey = x.entry)"
    seg = "s as (select edge, name, cls, shape[i].lon as x1, shape[i].lat as y1, shape[i + 1].lon as x2, shape[i + 1].lat as y2 from (select *, unnest(range(1, len(shape))) as i from e))"
    sub = f"s as ({SUBURBS_SQL}), m as (select * from (select s.*, unnest(list_filter([near, far], lambda f: f <> '')) as name from s where not known)), g as (select canton, name, count(*) as members, max(rank) + 2 as rank, min(lon) as w, max(lon) as e, min(lat) as so, max(lat) as no from m group by all having count(*) > 1)"
    pick = lambda v, m: f"{v}[p_partkey % {m} + 1]"
    px = "p as (select vec_id as tile, (i - 1) % 16 as x, (i - 1) // 16 as y, round(cast(embedding[i] as decimal(20,6)), 6)::double as value, case when (i - 1) % 5 = 0 then 0.0 else 1.0 end as weight from (select *, unnest(range(1, len(embedding) + 1)) as i from embeddings))"
    half = "h as (select tile, x // 2 as x, y // 2 as y, sum(cast(value as decimal(20,9)) * cast(weight as decimal(18,9))) as v, sum(weight) as w from p group by all having sum(weight) > 0)"
    merc = lambda z: f"(1 - asinh(tan(radians(lat))) / pi()) / 2 * {z}"
    z14 = 256 * 2**14 / 32
    zooms = "case when scope = 'overview' then case when class in ('motorway', 'trunk') then 5 else 7 end when class in ('motorway', 'trunk', 'primary') then case when ref is null then 10 else 12 end when class = 'secondary' then 11 when class in ('tertiary', 'street') then 13 else 14 end"
    spot = "sqrt(pow((n.lon - p.lon) * cos(radians(p.lat)), 2) + pow(n.lat - p.lat, 2)) * 111195.08"
    return {
        "node_degree": f"with {e}, {both} select u as node, count(*) as degree from b group by u",
        "components": comp("true"),
        "components_motor": comp("cls <= 7 or cls = 11"),
        "shortest_path_costs": f"with recursive {e}, d as (select u as node, count(*) as degree from (select u from e union all select v from e) group by u), k as (select u, v, cast(round({length} / ({kph} / 3.6) * 1000) as bigint) as ms, flags & 1 > 0 as state from e where {kph} > 0), b as (select u, v, ms + case when not state and dv.degree >= 3 then 3000 else 0 end as ms from (select u, v, ms, state from k union all select v, u, ms, state from k) q join d dv on dv.node = q.v), r using key (source, node) as (select s as source, s as node, cast(0 as bigint) as ms from (select p_partkey as s from part where p_partkey % 1000 in (105, 580)) union select source, v, min(c) as ms from (select r.source, b.v, r.ms + b.ms as c, old.ms as had from r join b on r.node = b.u left join recurring.r old on old.source = r.source and old.node = b.v) where had is null or c < had group by all) select cast(source as bigint) as source, cast(node as bigint) as node, ms from r",
        "street_intersections": f"with {e}, k as (select distinct u as node, name from e union select distinct v, name from e) select a.name as first, b.name as second, a.node from k a join k b on a.node = b.node and a.name < b.name",
        "noding": f"with v as ({VERTEX_SQL}), g as (select line, t, x, y, row_number() over (partition by line order by x + y) as i, count(*) over (partition by line) as n from v), c as (select t, x, y from g group by all having bool_or(i > 1 and i < n) and (bool_or(i = 1 or i = n) or count(distinct case when i > 1 and i < n then line end) > 1)), s as (select g.*, lead(x) over w as nx, lead(y) over w as ny, coalesce(sum(case when c.x is not null and i > 1 and i < n then 1 else 0 end) over (partition by line order by i), 0) as part from g left join c using (t, x, y) window w as (partition by line order by i)) select line, cast(part as int) as part, round(sum({great_circle(TOWN_LON.format('x'), TOWN_LAT.format('y'), TOWN_LON.format('nx'), TOWN_LAT.format('ny'))}), 3) as metres from s where nx is not null group by line, part",
        "turns": f"""with {e}, k as (select edge, u, v, shape[1].lon as x1, shape[1].lat as y1, shape[2].lon as x2, shape[2].lat as y2, shape[-2].lon as x3, shape[-2].lat as y3, shape[-1].lon as x4, shape[-1].lat as y4 from e),
          w as (select edge, v as node, degrees(atan2((x4 - x3) * cos(radians((y3 + y4) / 2)), y4 - y3)) as b from k union all select edge, u, degrees(atan2((x1 - x2) * cos(radians((y1 + y2) / 2)), y1 - y2)) from k),
          t as (select p.node, p.edge as out_of, q.edge as "into", q.b + 180 - p.b + 720 as raw from w p join w q on p.node = q.node and p.edge <> q.edge), a as (select *, case when raw % 360 > 180 then raw % 360 - 360 else raw % 360 end as d from t)
          select node, out_of, "into", case when round(abs(d), 3) < 20 then 'CONTINUE' when round(abs(d), 3) >= 170 then 'UTURN' else case when round(abs(d), 3) < 45 then 'SLIGHT_' when round(abs(d), 3) < 135 then 'TURN_' else 'SHARP_' end || case when d > 0 then 'RIGHT' else 'LEFT' end end as kind from a""",
        "dead_ends": "with l as (select p_partkey // 200 as t, p_partkey % 200 as k from part where p_partkey % 200 < 25) select t * 25 + k as line, (-79931000 + t % 200 * 27000) || ':' || (-2200000 + t // 200 * 20000 + k * 1000) as key from l where k < 10 union all select t * 25 + k, (-79964500 + t % 200 * 27000 + k * 1000) || ':' || (-2196500 + t // 200 * 20000) from l where k >= 20",
        "snap_pairs": f"with {e}, {seg}, q as (select s_suppkey as request, -79.9503e0 + x + i * 1.1e-3 as px, -2.1985e0 + y as py, -79.9317e0 + x - i * 0.9e-3 as qx, -2.1928e0 + y as qy from (select s_suppkey, s_suppkey % 20 as i, s_suppkey // 20 % 200 * 2.7e-2 as x, s_suppkey // 4000 * 2e-2 as y from supplier)), d as (select request, round(min({to_segment('px', 'py', 'x1', 'y1', 'x2', 'y2')}), 3) as a, round(min({to_segment('qx', 'qy', 'x1', 'y1', 'x2', 'y2')}), 3) as b from q, s where cls <> 8 and abs(x1 - px) < 0.027 group by request) select request, round(a + b, 3) as metres from d where a <= 90 and b <= 90",
        "line_length": f"with {e} select edge, round({length}, 3) as metres from e",
        "ring_area": "select n_nationkey as area, round(pow(2 * (2e-3 + 1e-4 * n_nationkey), 2) * 1e6, 6) as square, round(-79.95e0 + (n_nationkey % 20) * 1e-3, 9) as lon, round(-2.2e0 + (n_nationkey // 3) * 1e-3, 9) as lat from nation where n_nationkey % 2 = 1",
        "search_fold_tokens": f"select token, count(*) as entries from (select distinct entry, unnest(string_split({folded('name')}, ' ')) as token from ({ENTRIES_SQL})) where token <> '' group by token",
        "reverse_geocode": f"""with {e}, {seg}, p as (select event_id, -79.95e0 + (event_id % 20) * 0.001e0 + 0.0004e0 as lon, -2.2e0 + ((event_id // 20) % 10) * 0.001e0 + 0.00005e0 as lat from events), n as ({ENTRIES_SQL}),
          q as (select distinct lon, lat from p), a as (select p.lon, p.lat, n.name from q p join n on kind = 'poi' and {spot} <= 25 qualify row_number() over (partition by p.lon, p.lat order by round({spot}, 3), entry) = 1),
          b as (select q.lon, q.lat, s.name as road from q join s on s.name is not null and cls <> 11 and abs(q.lon - x1) < 3e-3 and abs(q.lat - y1) < 3e-3 and {to_segment('q.lon', 'q.lat', 'x1', 'y1', 'x2', 'y2')} <= 60 qualify row_number() over (partition by q.lon, q.lat order by round({to_segment('q.lon', 'q.lat', 'x1', 'y1', 'x2', 'y2')}, 3), edge) = 1),
          c as (select p.lon, p.lat, n.name from q p join n on kind = 'place' and {spot} <= 3000 qualify row_number() over (partition by p.lon, p.lat order by round({spot}, 3), entry) = 1)
          select event_id, case when a.name is not null then 'poi' when road is not null then 'street' when c.name is not null then 'place' end as kind, coalesce(a.name, case when road is null then c.name end, road) as name, road from p left join a using (lon, lat) left join b using (lon, lat) left join c using (lon, lat)""",
        "merged_search": """with a as (select p_partkey % 25 as query, row_number() over (partition by p_partkey % 25 order by p_size desc, p_partkey) as place, p_partkey as id, p_partkey // 25 % 5 as name, p_partkey // 75 % 3 as type, p_partkey // 125 % 3 as spot from part),
          w as (select a.*, min(case when query % 2 = 0 and type < 2 and spot < 2 then 1 else 0 end) over (partition by query order by place) as lead_ from a),
          u as (select query, 'detailed' as source, id, place, case name when 4 then 1 else name end as name, spot, case when lead_ = 1 then 0 else 2 end as part from w
            union all select c_nationkey, 'world', c_custkey, row_number() over (partition by c_nationkey order by c_custkey), case c_custkey % 5 when 4 then 1 else c_custkey % 5 end, c_custkey // 5 % 4, case when c_custkey % 3 = 0 then 1 else 3 end from customer),
          k as (select * from u qualify row_number() over (partition by query, name, spot order by part, place, id) = 1)
          select query, cast(r as int) as place, source, id, part from (select *, row_number() over (partition by query order by part, place, id) as r from k) where r <= 10""",
        "street_rollup": f"""with s as (select *, round({great_circle('x1', 'y1', 'x2', 'y2')} + {great_circle('x2', 'y2', 'x3', 'y3')}, 3) as m from ({STREETS_SQL})) select label, parish, round(cast(sum(cast(m as decimal(18,3))) as double), 1) as metres,
          case min(kind) when 'AUTOPISTA' then 58 when 'VIA' then 58 when 'AVENIDA' then 54 when 'CALLE' then 44 else 34 end + cast(least(6, floor(sum(cast(m as decimal(18,3))) / 1000)) as int) as rank, array_to_string(list_sort(list_distinct(list(alias))), '|') as aliases,
          round(min(least(x1, x2, x3)), 6) as west, round(min(least(y1, y3)), 6) as south, round(max(greatest(x1, x2, x3)), 6) as east, round(max(greatest(y1, y3)), 6) as north from s group by label, parish""",
        "neighbourhood_groups": f"with {sub} select canton, name, members, rank from g where not (name = 'Sauces' and exists (select 1 from s where known and s.canton = g.canton and lon between w - 0.01 and e + 0.01 and lat between so - 0.01 and no + 0.01))",
        "alias_resolve": f"select alias, coalesce(found, -1) as entry from (with n as (select *, string_split({folded('name')}, ' ') as w from ({ENTRIES_SQL})), a as (select * from (values ('M2000', ['malecon', 'simon'], null, null), ('TT', ['terminal'], 'poi', null), ('AN', ['ambato', 'norte', '7'], null, '0001'), ('none', ['nowhere'], null, null)) t(alias, need, of, prefix)) select alias, (select entry from n where list_has_all(w, need) and (of is null or of = kind) and (prefix is null or starts_with(parish, prefix)) order by rank desc, entry limit 1) as found from a)",
        "population_by_area": "with c as (select c_custkey as cell, -79.952e0 + (c_custkey % 211) * 1.13e-4 as x, -2.203e0 + (c_custkey % 173) * 1.07e-4 as y, c_custkey % 40 as people from customer), f as (select n_nationkey as area, -79.95e0 + (n_nationkey % 20) * 1e-3 as lon, -2.2e0 + (n_nationkey // 3) * 1e-3 as lat, 2e-3 + 1e-4 * n_nationkey as half from nation where n_nationkey % 2 = 1), h as (select cell, min(area) as area from c join f on abs(x - lon) < half and abs(y - lat) < half and not (abs(x - lon) < half / 4 and abs(y - lat) < half / 4) group by cell) select area, cast(sum(people) as bigint) as people from h join c using (cell) group by area",
        "spelling_learner": f"with w as (select lower(unnest(regexp_extract_all(name, '\\p{{L}}+'))) as spelling from ({ENTRIES_SQL})), k as (select strip_accents(spelling) as word, spelling, count(*) as seen from w where strip_accents(spelling) <> spelling group by all) select * from k where seen >= 2 qualify row_number() over (partition by word order by seen desc, spelling) = 1",
        "poi_classify": f"""with k as (select p_partkey as id, {pick("['hospital', 'bus', 'shop', 'park', 'restaurant', 'ferry', '', 'police', 'rail', '']", 10)} as c, {pick("['hospital', 'bus_station', 'mall', 'park', 'restaurant', 'ferry_terminal', '', 'police', 'station', '']", 10)} as s, {pick('[8, 6, 8, 14, 20, 14, 0, 16, 12, 0]', 10)} as r, p_partkey % 4 as f from part)
          select id, case when c <> '' then c when f = 0 then 'park' when f = 1 then 'place_of_worship' else 'building' end as class, case when c <> '' then s when f = 0 then 'park' when f = 1 then 'place_of_worship' else 'landmark' end as subclass, case when c <> '' then r when f = 0 then 18 when f = 1 then 20 else 24 end as rank from k""",
        "place_class": "select c_custkey as cell, ['country', 'state', 'city', 'town', 'village', 'suburb', 'locality', null][k + 1] as class, [1, 2, 3, 4, 5, 6, 8, 0][k + 1] as rank, case k when 0 then 2 when 1 then 4 when 2 then case when p >= 1000000 then 4 when p >= 250000 then 5 else 6 end when 3 then case when p >= 50000 then 7 else 8 end when 4 then 11 when 5 then 11 when 6 then 14 else 0 end as zoom from (select c_custkey, c_custkey % 8 as k, c_custkey % 40 * 40000 as p from customer)",
        "area_class": "select c_custkey as cell, ['city', 'town', 'village', 'hamlet'][k + 1] as class, [88, 80, 66, 56][k + 1] + case when p >= 200000 then 6 else 0 end as rank, case k when 0 then case when p > 1000000 then 1 else 2 end else k + 2 end as place_rank from (select c_custkey, c_custkey % 4 as k, c_custkey % 40 * 40000 as p from customer)",
        "tag_classes": """with t as (select p_partkey as id, p_partkey % 16 as k, p_partkey % 3 = 0 as more from part),
          p as (select * from (values (0, 'hospital', 'hospital', 12, 5), (1, 'food', 'fast_food', 14, 30), (3, 'shop', 'kiosk', 14, 40), (4, 'grocery', 'bakery', 14, 30), (5, 'airport', 'aerodrome', 11, 1), (11, 'park', 'park', 12, 15), (12, 'attraction', 'zoo', 13, 10), (13, 'health', 'lab', 14, 20), (14, 'parking', 'parking', 14, 40)) v(k, class, subclass, zoom, rank))
          select id, class, subclass, case when k = 5 and more then 9 else coalesce(zoom, -1) end as zoom, coalesce(rank, -1) as rank, case k when 0 then 'hospital' when 5 then 'aerodrome' when 7 then 'forest' when 11 then 'park' when 14 then case when not more then 'parking' end end as landuse,
            case when not more then case k when 6 then 'lake' when 9 then 'dock' when 10 then 'basin' end end as water, case k when 8 then 'stream' end as waterway from t left join p using (k)""",
        "boundaries": """with w as (select o_orderkey as way from orders), m as (select l_orderkey as way, min(r % 9 + 2) as level, bool_or(r % 7 = 0) as d, bool_or(r % 11 = 0) as mar from (select l_orderkey, s_suppkey as r from lineitem join supplier on s_suppkey = l_suppkey and s_suppkey % 8 = 3) group by 1),
          j as (select way, coalesce(level, case when way % 5 <> 0 and way % 13 between 2 and 10 then way % 13 end) as level, way % 5 = 0 or coalesce(d, false) as disputed, way % 4 = 0 or coalesce(mar, false) as maritime from w left join m using (way))
          select way, cast(level as int) as level, disputed, maritime, case when level <= 2 then 0 when level <= 4 then 4 when level <= 6 then 8 else 10 end as zoom from j where level is not null""",
        "tile_of_point": f"with p as (select -79.95e0 + (event_id % 20) * 0.001e0 + 0.0004e0 as lon, -2.2e0 + ((event_id // 20) % 10) * 0.001e0 + 0.00005e0 as lat from events), t as (select cast(floor((lon + 180) / 360 * 131072) as bigint) as x, cast(floor({merc(131072)}) as bigint) as y, count(*) as points from p group by 1, 2) select x, y, points, round(x / 131072 * 360 - 180, 6) as west, round(degrees(atan(sinh(pi() * (1 - 2 * y / 131072)))), 6) as north from t",
        "tile_parents": f"with p as (select -79.95e0 + (event_id % 20) * 0.001e0 + 0.0004e0 as lon, -2.2e0 + ((event_id // 20) % 10) * 0.001e0 + 0.00005e0 as lat from events), t as (select cast(floor((lon + 180) / 360 * 131072) as bigint) as x, cast(floor({merc(131072)}) as bigint) as y, count(*) as points from p group by 1, 2) select x // 4 as x, y // 4 as y, cast(sum(points) as bigint) as points, count(*) as children from t group by 1, 2",
        "tile_zoom_explode": f"""with r as (select p_partkey as road, {pick("['motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'street', 'footway', 'path']", 8)} as class, case when p_partkey % 3 > 0 then p_name end as name, case when p_partkey % 5 = 0 then 'E' || (p_partkey % 40) end as ref, case when p_partkey % 11 = 0 and p_partkey % 8 < 3 then 'overview' end as scope from part),
          z as (select *, unnest(range(first, case when scope = 'overview' then 12 else 15 end)) as zoom from (select *, {zooms} as first from r))
          select road, cast(zoom as int) as zoom, case class when 'street' then 'minor' when 'footway' then 'path' else class end as class, case when class in ('street', 'footway') then class end as subclass, case when zoom >= greatest(first, case when class in ('motorway', 'trunk', 'primary') then 12 when class = 'secondary' then 13 else 14 end) then name end as name, case when zoom >= greatest(first, 8) then ref end as ref, {"case class when 'motorway' then 90 when 'trunk' then 80 when 'primary' then 70 when 'secondary' then 60 when 'tertiary' then 50 when 'street' then 40 else 20 end"} as sort_key from z""",
        "label_grid_topn": f"with n as (select entry as id, cast(floor((lon + 180) / 360 * {z14}) as bigint) as gx, cast(floor({merc(z14)}) as bigint) as gy, rank from ({ENTRIES_SQL})) select id, gx, gy, cast(row_number() over (partition by gx, gy order by rank desc, id) as int) as place from n qualify place <= 4",
        "raster_block_mean": f"with {px}, {half} select tile, x, y, round(cast(v as double) / w, 9) as value, cast(w as double) as weight from h",
        "raster_pyramid": f"with {px}, {half}, h2 as (select tile, x // 2 as x, y // 2 as y, sum(w) as w from h group by all) select 0 as level, tile, count(*) as pixels, cast(round(sum(weight), 3) as double) as weight from p group by tile union all select 1, tile, count(*), cast(round(sum(w), 3) as double) from h group by tile union all select 2, tile, count(*), cast(round(sum(w), 3) as double) from h2 group by tile",
        "tile_curve": f"with recursive t as (select distinct cast(floor((lon + 180) / 360 * 65536) as bigint) as ox, cast(floor({merc(65536)}) as bigint) as oy from ({NODES_SQL})), h as (select ox, oy, ox as x, oy as y, cast(0 as bigint) as d, cast(32768 as bigint) as s from t union all select ox, oy, case when y & s > 0 then x when x & s > 0 then 65535 - y else y end, case when y & s > 0 then y when x & s > 0 then 65535 - x else x end, d + s * s * case when y & s > 0 then case when x & s > 0 then 2 else 1 end when x & s > 0 then 3 else 0 end, s // 2 from h where s > 0) select ox as x, oy as y, d + 1431655765 as place from h where s = 0",
        "terrarium_roundtrip": "with k as (select o_orderkey, cast(round((o_totalprice / 64 - 500 + 32768) * 256) as bigint) as v from orders) select o_orderkey, v >> 16 as r, (v >> 8) & 255 as g, v & 255 as b, true as near from k",
    }
