"""Places, favourites and map regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import box_holds, inside_box
from ..functions.text import like_escaped, versions_compared
from . import spatial


def visible(user: int) -> Column:
    """Places of the user and shared ones."""
    return (F.col("user_id") == user) | F.col("user_id").isNull()


def search_places(places: DataFrame, favourites: DataFrame, user: int, text: str | None = None, near: tuple[float, float, float] | None = None, favourites_only: bool = False, most: int = 50, offset: int = 0) -> DataFrame:
    """Visible places with the user's alias; by text in name, address or category, and around a point (lon, lat, metres).

    Nearest first where a point is given, else newest first; ties go by place.
    """
    tests = [visible(user)]
    if text:
        pattern = f"%{like_escaped(text)}%"
        tests.append(reduce(Column.__or__, [F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in ("name", "address", "category")]))
    got = places.filter(reduce(Column.__and__, tests))
    got = spatial.within(got, *near) if near else got.withColumn("metres", F.lit(None).cast("double"))
    fav = favourites.filter(F.col("user_id") == user).select("place_id", "alias")
    got = got.join(fav, "place_id", "inner" if favourites_only else "left").withColumn("favourite", F.lit(True) if favourites_only else F.col("alias").isNotNull())
    order = [F.col("metres")] if near else [F.col("created_at").desc()]
    return got.orderBy(*order, "place_id").offset(offset).limit(most).select("place_id", "name", "category", "address", "favourite", "alias", "metres")


def located_regions(points: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Enabled regions that hold a point, not on their boundary, smallest first by place."""
    r = regions.filter("enabled").select("code", "west", "south", "east", "north")
    hit = spatial.cell_join(points.select(key, "lon", "lat"), r).filter(inside_box(*[F.col(c) for c in ("lon", "lat", *spatial.BOX)]))
    area = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(area, "code"))
    return hit.select(key, "code", place.alias("place"))


def outermost(regions: DataFrame) -> DataFrame:
    """Regions that no other region holds; of equal boxes the least code stays. Candidates come by cells, not by all pairs."""
    a = regions.select("code", *spatial.BOX)
    b = a.select(F.col("code").alias("other"), *[F.col(c).alias(f"b{c}") for c in spatial.BOX])
    mid = a.withColumns({"lon": (F.col("west") + F.col("east")) / 2, "lat": (F.col("south") + F.col("north")) / 2}).toDF("code", *[f"a{c}" for c in spatial.BOX], "lon", "lat")
    wide = b.select("other", *[F.col(f"b{c}").alias(c) for c in spatial.BOX])
    pairs = spatial.cell_join(mid, wide).filter("code <> other").select("code", "other", *[f"a{c}" for c in spatial.BOX], *spatial.BOX)
    same = reduce(Column.__and__, [F.col(f"a{c}") == F.col(c) for c in spatial.BOX])
    held = pairs.filter(box_holds("", "a") & (~same | (F.col("other") < F.col("code")))).select("code").distinct()
    return a.join(held, "code", "left_anti")


def version_updates(regions: DataFrame, held: DataFrame) -> DataFrame:
    """Held versions of known regions, and whether a later one is offered; a blank held version is none."""
    local = F.nullif(F.trim("held"), F.lit(""))
    r = regions.filter("enabled").select("code", F.col("version").alias("latest"))
    got = held.withColumnRenamed("version", "held").join(r, "code")
    return got.select("code", "device", local.alias("held"), "latest", F.when(local.isNull(), False).otherwise(versions_compared(F.col("latest"), local) > 0).alias("update"))


def registered(registry: DataFrame, manifests: DataFrame) -> DataFrame:
    """What becomes of each region when manifests are registered: registered, updated, unchanged, disabled or error."""
    new = manifests.select("code", F.col("name").alias("new_name"), F.col("checksum").alias("new_sum"), *[F.col(c).alias(f"new_{c}") for c in spatial.BOX])
    bad = ~F.coalesce(F.col("code").rlike("^[a-z0-9][a-z0-9-]*$"), F.lit(False)) | ~F.coalesce((F.col("new_west") < F.col("new_east")) & (F.col("new_south") < F.col("new_north")), F.lit(False))
    j = registry.select("code", F.col("checksum").alias("old_sum"), F.lit(True).alias("known")).join(new, "code", "full")
    what = F.when(F.col("new_sum").isNull(), "disabled").when(bad, "error").when(F.col("known").isNull(), "registered").when(F.col("old_sum") == F.col("new_sum"), "unchanged").otherwise("updated")
    return j.select("code", what.alias("outcome"), F.coalesce("new_sum", "old_sum").alias("checksum"))


def asset_problems(assets: DataFrame, known: tuple[str, ...], files: DataFrame) -> DataFrame:
    """Assets of a region by kind: ok, unknown, duplicate or missing (its file is not there)."""
    n = F.count("*").over(Window.partitionBy("code", "kind"))
    a = assets.withColumn("n", n).join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    what = F.when(~F.col("kind").isin(*known), "unknown").when(F.col("n") > 1, "duplicate").when(F.col("there").isNull(), "missing").otherwise("ok")
    return a.select("code", "kind", "path", what.alias("outcome"))


def grown_box(box: tuple[float, float, float, float], step: float) -> tuple[float, float, float, float]:
    """The box moved outward to a grid, so that near views share one key."""
    import math

    return tuple(f(v / step) * step for f, v in zip((math.floor, math.floor, math.ceil, math.ceil), box))
