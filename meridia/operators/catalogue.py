"""Catalogue building: street roll-up, neighbourhood groups, aliases, population, spelling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import bounds, line_length
from ..functions.text import bracketed, fold, tokens, without_marks
from . import spatial
from .classify import street_rank


def street_rollup(streets: DataFrame) -> DataFrame:
    """One row per label and parish: metres, box, aliases, rank, and the segment middle nearest to the centre weighted by length.

    streets holds label, parish, kind, name, shape. Sums are partial aggregates; the point comes by a second one
    against the centres, so that a street with very many segments is no long list.
    """
    s = streets.withColumn("m", F.round(line_length(F.col("shape")), 3).cast("decimal(18,3)")).withColumn("mid", F.element_at("shape", (F.floor(F.size("shape") / 2) + 1).cast("int"))).withColumn("b", bounds(F.col("shape")))
    key = ["label", "parish"]
    alias = s.select(*key, F.explode(bracketed(F.col("name"))).alias("a")).groupBy(*key).agg(F.array_sort(F.collect_set("a")).alias("aliases"))
    total = F.greatest(F.sum("m"), F.lit(0.001)).cast("double")
    sums = s.groupBy(*key).agg(
        F.min("kind").alias("kind"), F.sum("m").cast("double").alias("metres"), F.min("b.west").alias("west"), F.min("b.south").alias("south"), F.max("b.east").alias("east"), F.max("b.north").alias("north"),
        (F.sum(F.col("mid.lon").cast("decimal(12,9)") * F.col("m")).cast("double") / total).alias("cx"), (F.sum(F.col("mid.lat").cast("decimal(12,9)") * F.col("m")).cast("double") / total).alias("cy"))
    far = F.round((F.pow(F.col("mid.lon") - F.col("cx"), 2) + F.pow(F.col("mid.lat") - F.col("cy"), 2)) * 1e12, 0)
    at = s.select(*key, "mid").join(sums.select(*key, "cx", "cy"), key).groupBy(*key).agg(F.min(F.struct(far.alias("d"), F.col("mid.lon").alias("lon"), F.col("mid.lat").alias("lat"))).alias("p"))
    out = sums.join(at, key).join(alias, key, "left")
    return out.select(*key, F.round("metres", 1).alias("metres"), "west", "south", "east", "north", street_rank(F.col("kind"), F.col("metres")).alias("rank"), F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"), F.array_join("aliases", "|").alias("aliases"))


# fixed values: patterns of what a family's name goes without: the sort of settlement before it, its stage, its sector, a
# mark left at its end; and the side of a family within a wider one
SORT = "(?i)^(?:cdla\\.?|ciudadela|urb\\.?|urbanizaci[oó]n|coop\\.?|cooperativa)\\s+"
STAGE = "(?i)\\s*[-/,]?\\s*\\b(?:\\d+(?:-?[a-z])?|[ivxl]+)(?:\\s*-\\s*(?:\\d+|[ivxl]+))?\\s*(?:ra|da|ta|er|era|a|°|º)?\\.?\\s+etapa\\b.*$|\\s*[-/,]?\\s*\\betapa\\s+(?:\\d+|[ivxl]+)\\b.*$"
SECTOR = "(?i)\\s*[-/,]\\s*(?:sector|zona|bloque)\\b.*$|\\s+(?:sector|zona|bloque)\\s+\\S+$"
MARK = "\\s*[-/,]\\s*$"
SIDE = "(?i)\\s+(?:central|norte|sur|este|oeste)$"
SHORTEST = 4  # fixed value: letters that a family's name has at least


def families(name: Column) -> Column:
    """Names of the wider neighbourhoods that a stage or sector belongs to, nearest first; the name itself is none."""
    without = lambda text, *patterns: reduce(lambda t, p: F.trim(F.regexp_replace(t, p, "")), patterns, F.trim(text))
    own = F.struct(fold(name).alias("key"))
    wide = F.transform(F.array(without(name, SORT, STAGE, SECTOR, MARK), without(name, SORT, STAGE, SECTOR, MARK, SIDE)), lambda f: F.struct(fold(f).alias("key"), F.concat(F.upper(F.left(f, F.lit(1))), F.substring(f, 2, 1 << 20)).alias("name")))
    return F.array_distinct(F.filter(wide, lambda f: (F.length(f["key"]) >= SHORTEST) & (f["key"] != own["key"]))["name"])


def neighbourhood_groups(entries: DataFrame) -> DataFrame:
    """One row per family of two suburbs or more in a canton (the first four digits of the parish): name, members, box, rank, entry nearest to its middle.

    A family whose name a place or division in its box, widened by 0.01 degree, has already is left out.
    """
    e = entries.select("entry", "name", "kind", "type", "rank", "lon", "lat", F.substring("parish", 1, 4).alias("canton"))
    m = e.filter("kind = 'place' and type = 'suburb'").withColumn("family", F.explode(families(F.col("name")))).withColumn("key", fold(F.col("family")))
    g = m.groupBy("key", "canton").agg(
        F.min_by("family", "entry").alias("name"), F.count("*").alias("members"), (F.max("rank") + 2).alias("rank"),
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north")).filter("members > 1")
    known = e.filter("kind in ('place', 'admin')").select(fold(F.col("name")).alias("key"), "canton", F.col("lon").alias("x"), F.col("lat").alias("y"))
    there = g.join(known, ["key", "canton"]).filter("x between west - 0.01 and east + 0.01 and y between south - 0.01 and north + 0.01").select("key", "canton").distinct()
    g = g.join(there, ["key", "canton"], "left_anti")
    far = F.round((F.pow(F.col("lon") - (F.col("west") + F.col("east")) / 2, 2) + F.pow(F.col("lat") - (F.col("south") + F.col("north")) / 2, 2)) * 1e12, 0)
    at = m.select("key", "canton", "entry", "lon", "lat").join(g.select("key", "canton", "west", "east", "south", "north"), ["key", "canton"]).groupBy("key", "canton").agg(F.min(F.struct(far.alias("d"), "entry")).alias("p"))
    return g.join(at, ["key", "canton"]).select("key", "canton", "name", "members", "rank", F.col("p.entry").alias("anchor"), "west", "south", "east", "north")


def resolved_aliases(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """alias and entry: the best ranked entry that has all words of the alias's target, is of its kind and lies in its parish; null for none.

    aliases holds alias, target, kind, prefix. Candidates come by one equi-join on words.
    """
    need = aliases.withColumn("need", F.array_distinct(tokens(fold(F.col("target")))))
    have = entries.select("entry", "kind", "parish", "rank", F.explode(F.array_distinct(tokens(fold(F.col("name"))))).alias("word"))
    hit = need.select("alias", F.col("kind").alias("of"), "prefix", F.size("need").alias("n"), F.explode("need").alias("word")).join(have, "word")
    hit = hit.filter((F.col("of").isNull() | (F.col("of") == F.col("kind"))) & (F.col("prefix").isNull() | F.col("parish").startswith(F.col("prefix"))))
    full = hit.groupBy("alias", "entry", "rank", "n").agg(F.count("*").alias("met")).filter("met = n")
    best = full.groupBy("alias").agg(F.min(F.struct((-F.col("rank")).alias("r"), "entry")).alias("b"))
    return aliases.select("alias").join(best, "alias", "left").select("alias", F.col("b.entry").alias("entry"))


def population(cells: DataFrame, areas: DataFrame) -> DataFrame:
    """People per area: each cell counts for the first area that holds it."""
    hit = spatial.first_area(cells, areas, "cell").join(cells.select("cell", "people"), "cell")
    return hit.groupBy("area").agg(F.sum("people").alias("people"))


def spellings(names: DataFrame, least: int = 2) -> DataFrame:
    """Folded word and its most common accented spelling, where that was seen `least` times; of ties the first in order."""
    w = names.select(F.explode(F.regexp_extract_all("name", F.lit("([\\p{L}]+)"), 1)).alias("w")).select(F.lower("w").alias("spelling"))
    w = w.withColumn("word", without_marks(F.col("spelling"), "NFKD")).filter("word <> spelling")
    n = w.groupBy("word", "spelling").agg(F.count("*").alias("n"))
    best = n.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("n"), "spelling")).alias("b")).filter(-F.col("b.n") >= least)
    return best.select("word", "b.spelling", (-F.col("b.n")).alias("seen"))


def fingerprint(rows: DataFrame, key: str, part: list[str]) -> DataFrame:
    """A hash of the rows of each chunk that does not depend on their order: rows are hashed, and the hashes summed."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*part)), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.select(key, h.alias("h")).groupBy(key).agg(F.count("*").alias("rows"), F.sum("h").cast("string").alias("sum"))


def layer_counts(rows: DataFrame, layer: str) -> DataFrame:
    return rows.groupBy(layer).agg(F.count("*").alias("rows"))


def missing_layers(wanted: list[str], rows: DataFrame, layer: str) -> DataFrame:
    """Wanted layers that have no row."""
    spark = rows.sparkSession
    return spark.createDataFrame([(x,) for x in wanted], f"{layer} string").join(rows.select(layer).distinct(), layer, "left_anti")
