"""Neighbourhood operations on raster tiles: each tile is worked on with a rim of its neighbours' cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: brightness, gamma and saturation of the picture, and what a colour counts for brightness
GAIN, GAMMA, SATURATION = 3.0, 1.7, 1.35
LUMA = (0.2126, 0.7152, 0.0722)
FULL = 10000.0  # fixed value: reflectance that counts as one


def natural_colour(red: Column, green: Column, blue: Column) -> Column:
    """r, g, b (0 to 255) and valid of a cell's reflectances; a cell without any is not valid and black."""
    light = [F.pow(F.least(F.greatest(c / FULL * GAIN, F.lit(0.0)), F.lit(1.0)), F.lit(1 / GAMMA)) for c in (red, green, blue)]
    valid = (red != 0) | (green != 0) | (blue != 0)
    luma = sum(k * c for k, c in zip(LUMA, light))
    byte = lambda c: F.when(valid, F.bround(F.least(F.greatest(luma + (c - luma) * SATURATION, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")).otherwise(0)
    return F.struct(*[byte(c).alias(n) for n, c in zip("rgb", light)], valid.alias("valid"))


def box_count(mask: np.ndarray, radius: int) -> np.ndarray:
    """Number of set cells in the square of 2 radius + 1 around each cell, by sums over the corner of the picture; outside is not set."""
    n, m = mask.shape
    total = np.zeros((n + 1, m + 1), np.int64)
    total[1:, 1:] = mask.cumsum(0).cumsum(1)
    top, bottom = np.clip(np.arange(n) - radius, 0, n), np.clip(np.arange(n) + radius + 1, 0, n)
    left, right = np.clip(np.arange(m) - radius, 0, m), np.clip(np.arange(m) + radius + 1, 0, m)
    part = lambda r, c: total[np.ix_(r, c)]
    return part(bottom, right) - part(top, right) - part(bottom, left) + part(top, left)


def with_rims(tiles: DataFrame, size: int, rim: int) -> DataFrame:
    """tx, ty, picture: each tile (tx, ty, mask: size x size bytes by rows) within a rim of its neighbours; 2 stands where no tile is.

    A tile sends each of its eight neighbours only the strip that lies in their rim, so what is shuffled is the tile
    and its border. rim is at most size.
    """
    if not 0 <= rim <= size:
        raise ValueError("a rim reaches into the next tiles only")

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = {-1: slice(0, rim), 0: slice(None), 1: slice(size - rim, None)}  # what a neighbour on that side needs of this tile
        for b in batches:
            rows = []
            for tx, ty, mask in zip(b["tx"], b["ty"], b["mask"]):
                m = np.frombuffer(mask, np.uint8).reshape(size, size)
                rows += [(tx + dx, ty + dy, -dx, -dy, m[cut[dy], cut[dx]].tobytes()) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if rim or dx == dy == 0]
            yield pd.DataFrame(rows, columns=["tx", "ty", "dx", "dy", "strip"])

    strips = tiles.select(F.col("tx").cast("long"), F.col("ty").cast("long"), "mask").mapInPandas(sent, "tx long, ty long, dx int, dy int, strip binary")
    whole = size + 2 * rim
    got = strips.groupBy("tx", "ty").agg(F.collect_list(F.struct("dx", "dy", "strip")).alias("s"), F.max((F.col("dx") == 0) & (F.col("dy") == 0)).alias("own")).filter("own")  # nine at most

    def laid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {-1: slice(0, rim), 0: slice(rim, rim + size), 1: slice(rim + size, whole)}
        for b in batches:
            pictures = []
            for strips_ in b["s"]:
                p = np.full((whole, whole), 2, np.uint8)
                for s in strips_:
                    target = p[at[s["dy"]], at[s["dx"]]]
                    target[...] = np.frombuffer(s["strip"], np.uint8).reshape(target.shape)
                pictures.append(p.tobytes())
            yield pd.DataFrame({"tx": b["tx"], "ty": b["ty"], "picture": pictures})

    return got.select("tx", "ty", "s").mapInPandas(laid, "tx long, ty long, picture binary")


def small_holes(tiles: DataFrame, size: int, radius: int) -> DataFrame:
    """tx, ty, holes: cells without data that a closing of the data by a square of `radius` covers, as bytes by rows.

    Holes and notches of up to about twice the radius count, the open outside does not. The result is that of the whole
    picture, whatever the tiles; where no tile is, the picture ends.
    """
    rim, whole = 2 * radius, size + 4 * radius

    def closed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            holes = []
            for picture in b["picture"]:
                p = np.frombuffer(picture, np.uint8).reshape(whole, whole)
                grown = box_count(p == 1, radius) > 0
                hole = (box_count(~grown & (p != 2), radius) == 0) & (p == 0)
                holes.append(hole[rim : rim + size, rim : rim + size].astype(np.uint8).tobytes())
            yield pd.DataFrame({"tx": b["tx"], "ty": b["ty"], "holes": holes})

    return with_rims(tiles, size, rim).mapInPandas(closed, "tx long, ty long, holes binary")
