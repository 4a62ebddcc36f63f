"""Geometry as column expressions. Points are lon and lat in degrees; a shape is an array of structs of them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: mean earth radius and metres of a degree of latitude
EARTH_M = 6371008.8
DEGREE_M = 111195.08
MERCATOR_LAT = 85.0511


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1.0, 1.0).otherwise(a)))  # not least(): it passes over nulls


def lon_gap(a: Column, b: Column) -> Column:
    """Degrees between two longitudes, the short way round."""
    d = F.abs(a - b)
    return F.least(d, F.lit(360.0) - d)


def grid(value: Column, digits: int) -> Column:
    """A coordinate rounded half up through decimals, so that engines agree."""
    return F.round(value.cast("decimal(18,9)"), digits).cast("double")


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive on all sides; box is west, south, east, north."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def inside_box(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Strictly inside: a point on the boundary is not."""
    return (lon > west) & (lon < east) & (lat > south) & (lat < north)


def boxes_meet(a: str, b: str, closed: bool = True) -> Column:
    """Whether two boxes with the prefixes a and b meet; a shared side counts where closed."""
    low = (lambda x, y: x <= y) if closed else (lambda x, y: x < y)
    c = F.col
    return low(c(f"{a}west"), c(f"{b}east")) & low(c(f"{b}west"), c(f"{a}east")) & low(c(f"{a}south"), c(f"{b}north")) & low(c(f"{b}south"), c(f"{a}north"))


def box_holds(a: str, b: str) -> Column:
    c = F.col
    return (c(f"{a}west") <= c(f"{b}west")) & (c(f"{a}south") <= c(f"{b}south")) & (c(f"{a}east") >= c(f"{b}east")) & (c(f"{a}north") >= c(f"{b}north"))


def bounds(shape: Column) -> Column:
    """west, south, east, north of a shape."""
    lons, lats = F.transform(shape, lambda p: p["lon"]), F.transform(shape, lambda p: p["lat"])
    return F.struct(F.array_min(lons).alias("west"), F.array_min(lats).alias("south"), F.array_max(lons).alias("east"), F.array_max(lats).alias("north"))


def sides(shape: Column) -> Column:
    """Neighbouring points of a shape as structs a, b; none for fewer than two points."""
    n = F.size(shape)
    return F.when(n > 1, F.zip_with(F.slice(shape, 1, n - 1), F.slice(shape, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def line_length(shape: Column) -> Column:
    """Metres along a shape; 0 for fewer than two points."""
    return F.coalesce(total(F.transform(sides(shape), lambda s: haversine(s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"]))), F.lit(0.0))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test of a point against a closed ring; half open, as a tiling of rings needs it."""

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < at)

    return F.size(F.filter(sides(ring), crosses)) % 2 == 1


def in_polygon(lon: Column, lat: Column, rings: Column) -> Column:
    """Inside the first ring and in none of the others, which are holes."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return in_ring(lon, lat, F.get(rings, F.lit(0))) & ~F.exists(holes, lambda r: in_ring(lon, lat, r))


def on_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point lies on a side."""

    def touches(s: Column) -> Column:
        a, b = s["a"], s["b"]
        turn = (b["lon"] - a["lon"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lon - a["lon"])
        return (turn == 0) & lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))

    return F.exists(sides(ring), touches)


def _from_first(ring: Column) -> Column:
    """Ring with its first corner as origin, which keeps products of coordinates small."""
    p = F.get(ring, F.lit(0))
    return F.transform(ring, lambda q: F.struct((q["lon"] - p["lon"]).alias("lon"), (q["lat"] - p["lat"]).alias("lat")))


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring in square degrees, counter-clockwise positive."""
    return total(F.transform(sides(_from_first(ring)), lambda s: s["a"]["lon"] * s["b"]["lat"] - s["b"]["lon"] * s["a"]["lat"])) / 2


def ring_centre(ring: Column) -> Column:
    """lon and lat of the centroid; the mean of the corners where the ring has no area."""
    near, first = _from_first(ring), F.get(ring, F.lit(0))
    cross = lambda s: s["a"]["lon"] * s["b"]["lat"] - s["b"]["lon"] * s["a"]["lat"]
    mean = lambda k: total(F.transform(near, lambda p: p[k])) / F.size(ring)
    part = lambda k: total(F.transform(sides(near), lambda s: (s["a"][k] + s["b"][k]) * cross(s))) / (6 * F.nullif(ring_area(ring), F.lit(0.0)))
    return F.struct(*[(F.coalesce(part(k), mean(k)) + first[k]).alias(k) for k in ("lon", "lat")])


def square_metres(area: Column, lat: Column) -> Column:
    """An area in square degrees at a latitude."""
    return F.abs(area) * DEGREE_M * DEGREE_M * F.cos(F.radians(lat))


def segment_part(lon: Column, lat: Column, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """How far along a segment the place nearest to a point is, 0 to 1, in the plane at the point's latitude; 0 on a segment without length."""
    kx = F.cos(F.radians(lat)) * DEGREE_M
    px, py, dx, dy = (lon - lon1) * kx, (lat - lat1) * DEGREE_M, (lon2 - lon1) * kx, (lat2 - lat1) * DEGREE_M
    return F.coalesce(F.least(F.greatest((px * dx + py * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def segment_metres(lon: Column, lat: Column, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance of a point to a segment in the plane at the point's latitude; a segment without length is a point."""
    kx = F.cos(F.radians(lat)) * DEGREE_M
    px, py, dx, dy = (lon - lon1) * kx, (lat - lat1) * DEGREE_M, (lon2 - lon1) * kx, (lat2 - lat1) * DEGREE_M
    t = segment_part(lon, lat, lon1, lat1, lon2, lat2)
    return F.sqrt(F.pow(px - t * dx, 2) + F.pow(py - t * dy, 2))


def shape_metres(lon: Column, lat: Column, shape: Column) -> Column:
    """Distance of a point to a polyline."""
    return F.array_min(F.transform(sides(shape), lambda s: segment_metres(lon, lat, s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"])))


def locate(lon: Column, lat: Column, shape: Column) -> Column:
    """metres, fraction, lon, lat of the point of a polyline nearest to a point; the first of ties.

    Lengths are measured in the plane at the point's latitude; the fraction is 0 on a line without length.
    """
    kx = F.cos(F.radians(lat)) * DEGREE_M

    def step(acc: Column, s: Column) -> Column:
        ax, ay = (s["a"]["lon"] - lon) * kx, (s["a"]["lat"] - lat) * DEGREE_M
        dx, dy = (s["b"]["lon"] - s["a"]["lon"]) * kx, (s["b"]["lat"] - s["a"]["lat"]) * DEGREE_M
        t = F.coalesce(F.least(F.greatest(-(ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        d = F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))
        long_ = F.sqrt(dx * dx + dy * dy)
        new = d < acc["metres"]
        pick = lambda name, value: F.when(new, value).otherwise(acc[name]).alias(name)
        return F.struct(
            pick("metres", d), pick("along", acc["gone"] + t * long_),
            pick("lon", s["a"]["lon"] + t * (s["b"]["lon"] - s["a"]["lon"])), pick("lat", s["a"]["lat"] + t * (s["b"]["lat"] - s["a"]["lat"])),
            (acc["gone"] + long_).alias("gone"),
        )

    zero = F.struct(F.lit(math.inf).alias("metres"), F.lit(0.0).alias("along"), F.lit(math.nan).alias("lon"), F.lit(math.nan).alias("lat"), F.lit(0.0).alias("gone"))
    return F.aggregate(sides(shape), zero, step, lambda a: F.struct(a["metres"].alias("metres"), F.coalesce(a["along"] / F.nullif(a["gone"], F.lit(0.0)), F.lit(0.0)).alias("fraction"), a["lon"].alias("lon"), a["lat"].alias("lat")))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Degrees clockwise from north in the plane, 0 to 360."""
    return F.pmod(F.degrees(F.atan2((lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)), lat2 - lat1)) + 360.0, F.lit(360.0))


def turn(before: Column, after: Column) -> Column:
    """Change of bearing, over -180 up to 180; right is positive."""
    d = F.pmod(after - before, F.lit(360.0))
    return F.when(d > 180.0, d - 360.0).otherwise(d)


def undirected_gap(a: Column, b: Column) -> Column:
    """Degrees between two lines whatever their direction, 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def tile_x(lon: Column, zoom: Column) -> Column:
    n = F.pow(F.lit(2.0), zoom)
    return F.least(F.greatest(F.floor((lon + 180.0) / 360.0 * n), F.lit(0)), (n - 1).cast("long"))


def tile_y(lat: Column, zoom: Column) -> Column:
    n = F.pow(F.lit(2.0), zoom)
    r = F.radians(F.least(F.greatest(lat, F.lit(-MERCATOR_LAT)), F.lit(MERCATOR_LAT)))
    return F.least(F.greatest(F.floor((1.0 - F.asinh(F.tan(r)) / F.pi()) / 2.0 * n), F.lit(0)), (n - 1).cast("long"))


def tile_west(x: Column, zoom: Column) -> Column:
    return x / F.pow(F.lit(2.0), zoom) * 360.0 - 180.0


def tile_north(y: Column, zoom: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * y / F.pow(F.lit(2.0), zoom)))))


def terrarium(height: Column) -> Column:
    """r, g, b of a height in metres, to 1/256 of a metre."""
    v = F.round((height + 32768.0) * 256.0).cast("long")
    return F.struct(F.shiftright(v, 16).alias("r"), F.shiftright(v, 8).bitwiseAND(F.lit(255)).alias("g"), v.bitwiseAND(F.lit(255)).alias("b"))


def from_terrarium(r: Column, g: Column, b: Column) -> Column:
    return r * 256.0 + g + b / 256.0 - 32768.0


# fixed values: zone and southern half of the UTM codes in use, and codes of plain degrees
UTM = {31992: (17, True), 31993: (18, True), 31976: (17, False), 32717: (17, True), 32617: (17, False), 32715: (15, True), 32716: (16, True)}
DEGREES = (4326, 4674, 4190)


def from_utm(x: Column, y: Column, code: int) -> Column:
    """lon and lat of UTM metres, by the series of the inverse transverse Mercator projection to the sixth order of n."""
    if code in DEGREES:
        return F.struct(x.alias("lon"), y.alias("lat"))
    zone, south = UTM[code]
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256) * 0.9996
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
        4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
        4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
        20648693 * n**6 / 638668800,
    )
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45 + 26 * n**5 / 45 - 2854 * n**6 / 675,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45 + 2704 * n**5 / 315 + 2323 * n**6 / 945,
        56 * n**3 / 15 - 136 * n**4 / 35 - 1262 * n**5 / 105 + 73814 * n**6 / 2835,
        4279 * n**4 / 630 - 332 * n**5 / 35 - 399572 * n**6 / 14175,
        4174 * n**5 / 315 - 144838 * n**6 / 6237,
        601676 * n**6 / 22275,
    )
    xi, eta = (y - (10_000_000.0 if south else 0.0)) / radius, (x - 500_000.0) / radius
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.struct((F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + (zone * 6 - 183)).alias("lon"), F.degrees(lat).alias("lat"))
