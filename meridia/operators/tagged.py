"""Classes of map features by their tags (a map column), as rule tables: the first rule that holds gives the class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import first_rule

# fixed values: key, values ("*": any), class, first zoom, rank; in this order. The subclass is the tag's value
POI = (
    ("amenity", ("restaurant", "fast_food", "food_court"), "food", 14, 30),
    ("amenity", ("cafe", "ice_cream"), "cafe", 14, 30),
    ("amenity", ("bar", "pub", "biergarten", "nightclub"), "bar", 14, 35),
    ("amenity", ("hospital",), "hospital", 12, 5),
    ("amenity", ("clinic", "doctors", "dentist"), "health", 14, 20),
    ("amenity", ("pharmacy",), "pharmacy", 14, 15),
    ("amenity", ("university", "college"), "college", 13, 10),
    ("amenity", ("school", "kindergarten"), "school", 14, 20),
    ("amenity", ("library",), "library", 14, 25),
    ("amenity", ("bank", "atm", "bureau_de_change"), "bank", 14, 25),
    ("amenity", ("fuel",), "fuel", 13, 15),
    ("amenity", ("charging_station",), "charging_station", 14, 25),
    ("amenity", ("parking",), "parking", 14, 40),
    ("amenity", ("bus_station",), "bus_station", 12, 8),
    ("amenity", ("ferry_terminal",), "ferry_terminal", 12, 8),
    ("amenity", ("taxi",), "taxi", 14, 40),
    ("amenity", ("police", "fire_station"), "emergency", 14, 15),
    ("amenity", ("townhall", "courthouse", "embassy"), "government", 13, 12),
    ("amenity", ("post_office",), "post", 14, 25),
    ("amenity", ("place_of_worship",), "worship", 14, 25),
    ("amenity", ("theatre", "cinema", "arts_centre"), "culture", 14, 20),
    ("amenity", ("marketplace",), "market", 14, 20),
    ("aeroway", ("aerodrome",), "airport", 11, 1),
    ("aeroway", ("terminal",), "airport", 13, 10),
    ("railway", ("station", "halt"), "railway_station", 12, 5),
    ("railway", ("tram_stop",), "tram_stop", 14, 30),
    ("public_transport", ("station",), "transit_station", 13, 10),
    ("highway", ("bus_stop",), "bus_stop", 14, 45),
    ("shop", ("mall", "department_store"), "mall", 13, 10),
    ("shop", ("supermarket",), "supermarket", 14, 20),
    ("shop", ("convenience", "bakery", "butcher", "greengrocer", "grocery"), "grocery", 14, 30),
    ("shop", ("*",), "shop", 14, 40),
    ("tourism", ("hotel", "motel", "hostel", "guest_house", "apartment"), "lodging", 14, 25),
    ("tourism", ("camp_site", "caravan_site"), "campsite", 13, 25),
    ("tourism", ("museum", "gallery"), "museum", 13, 10),
    ("tourism", ("attraction", "viewpoint", "theme_park", "zoo", "aquarium"), "attraction", 13, 10),
    ("leisure", ("park", "garden", "nature_reserve"), "park", 12, 15),
    ("leisure", ("stadium",), "stadium", 13, 8),
    ("leisure", ("sports_centre", "fitness_centre", "swimming_pool"), "sports", 14, 30),
    ("leisure", ("playground",), "playground", 14, 45),
    ("boundary", ("national_park",), "park", 8, 3),
    ("historic", ("monument", "memorial", "castle", "ruins", "archaeological_site", "fort"), "historic", 14, 20),
    ("healthcare", ("*",), "health", 14, 20),
    ("office", ("government",), "government", 14, 20),
)
# fixed values: class, and the tags of which one gives it; in this order
LANDUSE = (
    ("park", {"leisure": ("park", "garden", "playground", "nature_reserve", "recreation_ground", "dog_park"), "boundary": ("national_park",), "landuse": ("recreation_ground", "village_green")}),
    ("forest", {"landuse": ("forest",), "natural": ("wood",)}),
    ("wetland", {"natural": ("wetland",)}),
    ("glacier", {"natural": ("glacier",)}),
    ("sand", {"natural": ("beach", "sand", "dune")}),
    ("rock", {"natural": ("bare_rock", "scree", "shingle")}),
    ("scrub", {"natural": ("scrub", "heath")}),
    ("grass", {"landuse": ("grass", "meadow"), "natural": ("grassland",)}),
    ("farmland", {"landuse": ("farmland", "orchard", "vineyard", "plant_nursery", "greenhouse_horticulture", "farmyard", "allotments", "aquaculture")}),
    ("aerodrome", {"aeroway": ("aerodrome",)}),
    ("apron", {"aeroway": ("apron",)}),
    ("cemetery", {"landuse": ("cemetery",), "amenity": ("grave_yard",)}),
    ("hospital", {"amenity": ("hospital", "clinic")}),
    ("school", {"amenity": ("school", "university", "college", "kindergarten")}),
    ("sports", {"leisure": ("stadium", "sports_centre", "pitch", "track")}),
    ("parking", {"amenity": ("parking",)}),
    ("military", {"landuse": ("military",)}),
    ("residential", {"landuse": ("residential",)}),
    ("commercial", {"landuse": ("commercial", "retail")}),
    ("industrial", {"landuse": ("industrial", "railway", "port", "quarry", "landfill")}),
    ("construction", {"landuse": ("construction", "brownfield")}),
)
# fixed values: class of a water area by its kind, and of a waterway
WATER = {
    "river": ("river", "stream", "canal", "ditch", "drain", "oxbow", "rapids", "lock"),
    "reservoir": ("reservoir",),
    "lagoon": ("lagoon",),
    "pond": ("pond", "fishpond", "moat"),
    "basin": ("basin", "wastewater", "reflecting_pool", "pool"),
}
WATERWAY = {
    "river": ("river",),
    "canal": ("canal",),
    "stream": ("stream", "tidal_channel", "brook"),
    "drain": ("drain", "ditch"),
}
# fixed values: first zooms
LANDUSE_ZOOM = {
    7: ("forest", "wetland", "glacier", "sand", "rock", "scrub", "grass", "farmland"),
    9: ("park", "residential", "commercial", "industrial", "military", "aerodrome"),
}
WATER_ZOOM = {
    0: ("ocean",),
    4: ("lake", "reservoir", "lagoon"),
    6: ("river",),
}


def tag(tags: Column, key: str) -> Column:
    """Lower-case value of a tag without blanks around it; null for none."""
    return F.nullif(F.lower(F.trim(F.try_element_at(tags, F.lit(key)))), F.lit(""))


def _is(tags: Column, key: str, values: tuple[str, ...]) -> Column:
    v = tag(tags, key)
    return F.coalesce(v.isin(*values) if values != ("*",) else ~v.isin("no", "vacant"), F.lit(False))


def poi_of_tags(tags: Column) -> Column:
    """class, subclass, zoom and rank of a point of interest; null for others. An airport with a code shows from zoom 9."""
    zoom = lambda c, z: F.when(tag(tags, "iata").isNotNull(), 9).otherwise(z) if (c, z) == ("airport", 11) else F.lit(z)
    return first_rule([(_is(tags, k, v), F.struct(F.lit(c).alias("class"), tag(tags, k).alias("subclass"), zoom(c, z).alias("zoom"), F.lit(r).alias("rank"))) for k, v, c, z, r in POI], F.lit(None))


def landuse_of_tags(tags: Column) -> Column:
    """Land-use class of an area; car parks below or above ground are none."""
    from functools import reduce

    hidden = _is(tags, "parking", ("underground", "multi-storey", "rooftop"))
    rules = [(reduce(Column.__or__, [_is(tags, k, v) for k, v in any_.items()]) & (~hidden if c == "parking" else F.lit(True)), F.lit(c)) for c, any_ in LANDUSE]
    return first_rule(rules, F.lit(None))


def water_of_tags(tags: Column) -> Column:
    """Class of a water body in sight; null for covered ones and others."""
    hidden = _is(tags, "covered", ("yes",)) | _is(tags, "location", ("underground",)) | _is(tags, "tunnel", ("yes", "culvert"))
    lake = first_rule([(_is(tags, "water", v), F.lit(c)) for c, v in WATER.items()], F.lit("lake"))
    rules = [(_is(tags, "natural", ("water",)), lake), (_is(tags, "waterway", ("riverbank",)), F.lit("river")), (_is(tags, "waterway", ("dock",)), F.lit("dock")), (_is(tags, "landuse", ("reservoir",)), F.lit("reservoir")), (_is(tags, "landuse", ("basin",)), F.lit("basin"))]
    return F.when(~hidden, first_rule(rules, F.lit(None)))


def waterway_of_tags(tags: Column) -> Column:
    return first_rule([(_is(tags, "waterway", v), F.lit(c)) for c, v in WATERWAY.items()], F.lit(None))


def _zoom(cls: Column, table: dict[int, tuple[str, ...]], rest: int) -> Column:
    return F.when(cls.isNotNull(), first_rule([(cls.isin(*v), F.lit(z)) for z, v in table.items()], F.lit(rest)))


def landuse_zoom(cls: Column) -> Column:
    return _zoom(cls, LANDUSE_ZOOM, 12)


def water_zoom(cls: Column) -> Column:
    return _zoom(cls, WATER_ZOOM, 10)


def boundary_zoom(level: Column) -> Column:
    return F.when(level <= 2, 0).when(level <= 4, 4).when(level <= 6, 8).otherwise(10)


def boundaries(ways: DataFrame, members: DataFrame, relations: DataFrame, least: int = 2, most: int = 10) -> DataFrame:
    """way, level, disputed, maritime and zoom of border lines: the lowest level of the relations a way is in, else its own.

    ways holds way, tags; members way, relation; relations relation, level, disputed, maritime. Ways without a level go.
    """
    r = members.join(relations, "relation").groupBy("way").agg(F.min("level").alias("of"), F.bool_or("disputed").alias("d"), F.bool_or("maritime").alias("m"))
    t = F.col("tags")
    own = tag(t, "admin_level").try_cast("int")
    yes = lambda k: _is(t, k, ("yes", "true", "1"))
    level = F.coalesce("of", F.when(_is(t, "boundary", ("administrative",)) & own.between(least, most), own))
    w = ways.join(r, "way", "left").withColumn("level", level).filter("level is not null")
    disputed = _is(t, "boundary", ("disputed",)) | yes("disputed") | F.coalesce("d", F.lit(False))
    maritime = yes("maritime") | _is(t, "natural", ("coastline",)) | _is(t, "boundary_type", ("maritime",)) | F.coalesce("m", F.lit(False))
    return w.select("way", "level", disputed.alias("disputed"), maritime.alias("maritime"), boundary_zoom(F.col("level")).alias("zoom"))
