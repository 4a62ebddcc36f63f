"""Readers and writers of geospatial formats: GeoJSON, NDJSON, WKB, encoded polylines."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FEATURES = "features array<struct<id: string, properties: map<string, string>, geometry: string>>"
LINE = "coordinates array<array<double>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """id, properties, type and geometry (JSON) of the features of collections; a file is one record, as its format demands."""
    raw = spark.read.text(path, wholetext=True)
    f = raw.select(F.explode(F.from_json("value", FEATURES)["features"]).alias("f"))
    return f.select("f.id", "f.properties", F.get_json_object("f.geometry", "$.type").alias("type"), F.col("f.geometry").alias("geometry"))


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """As read_geojson for files of one feature a line, which Spark can split; blank and broken lines go."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    f = raw.select(F.from_json("value", "id string, properties map<string, string>, geometry string").alias("f")).filter("f.geometry is not null")
    return f.select("f.id", "f.properties", F.get_json_object("f.geometry", "$.type").alias("type"), F.col("f.geometry").alias("geometry"))


def write_feature_lines(df: DataFrame, path: str, geometry: str) -> None:
    """One feature a line; the column geometry holds its JSON text, the others are properties, empty ones left out."""
    names = [c for c in df.columns if c != geometry]
    props = F.to_json(F.struct(*[F.when(F.col(c).cast("string") != "", F.col(c)).alias(c) for c in names]))
    df.select(F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), F.col(geometry), F.lit("}")).alias("value")).write.text(path)


def read_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of one JSON object a line; blank lines go, fields that are not there are null."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    return raw.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_lines(df: DataFrame, path: str, digits: dict[str, int] | None = None) -> None:
    """One JSON object a line; empty texts and nulls are left out, numbers rounded as digits says."""
    kinds = dict(df.dtypes)
    value = lambda c: F.round(c, digits[c]) if digits and c in digits else F.when(F.col(c) != "", F.col(c)) if kinds[c] == "string" else F.col(c)
    df.select(F.to_json(F.struct(*[value(c).alias(c) for c in df.columns])).alias("value")).write.text(path)


def point_json(lon: Column, lat: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def shape_of(geometry: Column) -> Column:
    """Shape of a GeoJSON LineString."""
    return F.transform(F.from_json(geometry, LINE)["coordinates"], lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))


def valid_features(df: DataFrame, types: tuple[str, ...], box: tuple[float, float, float, float], margin: float = 1.0) -> Column:
    """Whether a feature with lon and lat has an expected type and lies in a box with a margin."""
    w, s, e, n = box
    return F.coalesce(F.col("type").isin(*types) & F.col("lon").between(w - margin, e + margin) & F.col("lat").between(s - margin, n + margin), F.lit(False))


def _wkb(data: bytes) -> list | None:
    """Rings or parts of a WKB, EWKB or GeoPackage geometry as lists of (lon, lat); Z and M are passed over."""
    if data is None or len(data) < 5:
        return None
    if data[:2] == b"GP":
        if data[3] >> 4 & 1:
            return []
        data = data[8 + (0, 32, 48, 48, 64)[data[3] >> 1 & 7] :]

    def one(at: int) -> tuple[list, int]:
        end = "<" if data[at] else ">"
        kind = struct.unpack_from(end + "I", data, at + 1)[0]
        at += 5 + (4 if kind & 0x20000000 else 0)
        base, size = (kind & 0xFF) if kind & 0xE0000000 else kind % 1000, 2
        size += bool(kind & 0x80000000) + bool(kind & 0x40000000) if kind & 0xE0000000 else (0, 1, 1, 2)[kind // 1000 % 4]

        def run(at: int, n: int) -> tuple[list, int]:
            v = struct.unpack_from(f"{end}{n * size}d", data, at)
            return [(v[i], v[i + 1]) for i in range(0, n * size, size)], at + 8 * n * size

        if base == 1:
            p, at = run(at, 1)
            return [p], at
        n = struct.unpack_from(end + "I", data, at)[0]
        at += 4
        if base == 2:
            p, at = run(at, n)
            return [p], at
        out = []
        for _ in range(n):
            if base == 3:
                m = struct.unpack_from(end + "I", data, at)[0]
                p, at = run(at + 4, m)
                out.append(p)
            else:
                p, at = one(at)
                out += p
        return out, at

    return one(0)[0]


def from_wkb(data: Column) -> Column:
    """Parts of a binary geometry (point, line, polygon and their multiples), rings of all polygons in order."""

    def parts(d) -> list | None:
        g = _wkb(None if d is None else bytes(d))
        return None if g is None else [[{"lon": x, "lat": y} for x, y in p] for p in g]

    return F.pandas_udf(lambda s: s.map(parts), "array<array<struct<lon: double, lat: double>>>")(data)


def _encoded(shape, precision: int) -> str:
    out, last = [], (0, 0)
    for p in shape:
        now = tuple(int((v * 10**precision) + (0.5 if v >= 0 else -0.5)) for v in (p["lat"], p["lon"]))
        for a, b in zip(now, last):
            d = (a - b) << 1
            d = ~d if a < b else d
            while d >= 0x20:
                out.append(chr((0x20 | (d & 0x1F)) + 63))
                d >>= 5
            out.append(chr(d + 63))
        last = now
    return "".join(out)


def _decoded(text: str, precision: int) -> list[dict]:
    values, shift, value = [], 0, 0
    for c in text:
        b = ord(c) - 63
        value |= (b & 0x1F) << shift
        shift += 5
        if b < 0x20:
            values.append(~(value >> 1) if value & 1 else value >> 1)
            shift = value = 0
    out, at = [], [0, 0]
    for i in range(0, len(values) - 1, 2):
        at = [at[0] + values[i], at[1] + values[i + 1]]
        out.append({"lat": at[0] / 10**precision, "lon": at[1] / 10**precision})
    return out


def polyline(shape: Column, precision: int = 5) -> Column:
    """Shape as an encoded polyline."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else _encoded(x, precision)), "string")(shape)


def from_polyline(text: Column, precision: int = 5) -> Column:
    """Shape of an encoded polyline."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else _decoded(x, precision)), "array<struct<lat: double, lon: double>>")(text)
