"""Tiles: points and features by tile, label limits, raster pyramids, curve order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import terrarium, tile_north, tile_west, tile_x, tile_y
from .classify import road_name_zoom, road_sort_key, road_zoom


def tiled(points: DataFrame, zoom: int) -> DataFrame:
    """Points per web-mercator tile, with the tile's west and north side."""
    z = F.lit(zoom)
    t = points.groupBy(tile_x(F.col("lon"), z).alias("x"), tile_y(F.col("lat"), z).alias("y")).agg(F.count("*").alias("points"))
    return t.select("x", "y", "points", F.round(tile_west(F.col("x"), z), 9).alias("west"), F.round(tile_north(F.col("y"), z), 9).alias("north"))


def parents(tiles: DataFrame, levels: int = 1) -> DataFrame:
    """Counts of tiles summed into their parents some levels up."""
    return tiles.groupBy(F.shiftright("x", levels).alias("x"), F.shiftright("y", levels).alias("y")).agg(F.sum("points").alias("points"), F.count("*").alias("children"))


def road_features(roads: DataFrame, max_zoom: int = 14) -> DataFrame:
    """A row per road and zoom where it shows: layer class, and name and number only from their own first zoom on.

    roads holds road, class, name, ref, scope. The overview network ends at zoom 11, where the detailed one takes over.
    """
    over = F.coalesce(F.col("scope") == "overview", F.lit(False))
    first = F.when(over, F.when(F.col("class").isin("motorway", "trunk"), 5).otherwise(7)).otherwise(road_zoom(F.col("class"), F.col("ref").isNotNull()))
    r = roads.withColumn("first", first).withColumn("zoom", F.explode(F.sequence(F.col("first"), F.when(over, 11).otherwise(max_zoom))))
    layer = F.when(F.col("class") == "street", "minor").when(F.col("class").isin("footway", "steps"), "path").otherwise(F.col("class"))
    from_ = lambda c, z: F.when(F.col("zoom") >= F.greatest(F.col("first"), z), F.col(c))
    return r.select("road", "zoom", layer.alias("class"), F.when(layer != F.col("class"), F.col("class")).alias("subclass"), from_("name", road_name_zoom(F.col("class"))).alias("name"), from_("ref", F.lit(8)).alias("ref"), road_sort_key(F.col("class")).alias("sort_key"))


def label_grid(points: DataFrame, zoom: int, pixels: int = 32, most: int = 4) -> DataFrame:
    """The first `most` labels by sort key in each cell of some pixels of a tile of 256."""
    scale = F.lit(float(256 << zoom) / pixels)
    x = F.floor((F.col("lon") + 180.0) / 360.0 * scale)
    y = F.floor((1.0 - F.asinh(F.tan(F.radians("lat"))) / F.pi()) / 2.0 * scale)
    p = points.withColumns({"gx": x, "gy": y})
    n = F.row_number().over(Window.partitionBy("gx", "gy").orderBy("sort_key", "id"))
    return p.withColumn("n", n).filter(F.col("n") <= most).select("id", "gx", "gy", F.col("n").alias("place"))


def halved(pixels: DataFrame) -> DataFrame:
    """Blocks of two by two pixels as one: mean weighted by weight; pixels of weight 0 or none do not count. A block without weight goes."""
    p = pixels.groupBy("tile", F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y"))
    num = lambda c: c.cast("decimal(20,9)")
    out = p.agg(F.sum(num(F.col("value") * F.col("weight"))).alias("v"), F.sum(num(F.col("weight"))).alias("w")).filter("w > 0")
    return out.select("tile", "x", "y", F.round(F.col("v").cast("double") / F.col("w").cast("double"), 9).alias("value"), F.col("w").cast("double").alias("weight"))


def pyramid(pixels: DataFrame, levels: int) -> DataFrame:
    """All levels of a raster with the level's number; each is reduced from the one below."""
    out, cur = pixels.select(F.lit(0).alias("level"), "tile", "x", "y", "value", "weight"), pixels
    for level in range(1, levels + 1):
        cur = halved(cur)
        out = out.unionByName(cur.select(F.lit(level).alias("level"), "tile", "x", "y", "value", "weight"))
    return out


def first_known(layers: list[Column]) -> Column:
    """The first value that is not 0, which stands for no data; else null."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in layers])


def encoded(heights: DataFrame) -> DataFrame:
    """Heights with their three bytes."""
    return heights.withColumn("c", terrarium(F.col("height"))).select(*heights.columns, "c.r", "c.g", "c.b")


def hilbert(x: Column, y: Column, zoom: int) -> Column:
    """Place of a tile along the Hilbert curve of a zoom, after all tiles of the zooms before."""
    start = ((1 << 2 * zoom) - 1) // 3

    def step(acc: Column, k: Column) -> Column:
        s = F.expr("shiftleft(1L, 0)") * F.pow(F.lit(2.0), F.lit(zoom - 1) - k).cast("long")
        rx = F.when(acc["x"].bitwiseAND(s) > 0, 1).otherwise(0)
        ry = F.when(acc["y"].bitwiseAND(s) > 0, 1).otherwise(0)
        d = acc["d"] + s * s * ((3 * rx).bitwiseXOR(ry)).cast("long")
        fx = F.when((ry == 0) & (rx == 1), s - 1 - acc["x"]).otherwise(acc["x"])
        fy = F.when((ry == 0) & (rx == 1), s - 1 - acc["y"]).otherwise(acc["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    begin = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.lit(start) + F.aggregate(F.sequence(F.lit(0), F.lit(zoom - 1)), begin, step, lambda a: a["d"])


def stored_once(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tiles in curve order with the id of their content, and each content once. tiles holds tile, data."""
    t = tiles.withColumn("content", F.sha2("data", 256))
    return t.select("tile", "content").orderBy("tile"), t.groupBy("content").agg(F.min("tile").alias("tile"), F.first("data").alias("data"))
