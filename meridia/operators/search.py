"""Search over named entries: postings, ranked matches, near duplicates, world places, reverse lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import DEGREE_M, haversine
from ..functions.text import SOFT_WORDS, fold, fold_world, meaningful, tokens, variants
from ..sources.staging import cut
from . import spatial

# fixed values: bonus of a place or division named exactly as asked, and the types that proximity hardly moves
EXACT_BONUS = {"city": 100, "state": 90, "town": 80, "county": 70, "administrative": 40}
MAJOR = ("city", "town", "state", "county")


def postings(entries: DataFrame) -> DataFrame:
    """entry and each token of its folded name."""
    return entries.select("entry", F.explode(F.array_distinct(tokens(fold(F.col("name"))))).alias("token"))


def token_counts(entries: DataFrame) -> DataFrame:
    return postings(entries).groupBy("token").agg(F.count("*").alias("entries"))


def asked_words(queries: DataFrame) -> DataFrame:
    """query, word, forms (the word and its singulars) and prefix: whether the word may go on; soft words do not filter."""
    q = queries.select("query", "text", tokens(fold(F.col("text"))).alias("words"))
    last = F.element_at("words", -1)
    w = q.filter(F.size("words") > 0).select("query", "text", last.alias("last"), F.explode(F.array_distinct(meaningful(F.col("words")))).alias("word"))
    prefix = ~F.col("text").rlike("\\s$") & (F.col("word") == F.col("last")) & (F.length("word") >= 2)
    return w.select("query", "word", variants(F.col("word")).alias("forms"), prefix.alias("prefix"))


def _met(words: Column, forms: Column, prefix: Column, word: Column) -> Column:
    """Words that a form names, or that go on from it."""
    return F.filter(words, lambda w: F.array_contains(forms, w) | (prefix & w.startswith(word)))


def search(entries: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """query, place, entry, name, score: the best entries of each query (query, text, lon, lat).

    Each word that is not soft must stand in the name or the context, one at least in the name. Candidates come
    by an equi-join on tokens (exact words, singulars, and words that go on, by their first two letters), never
    by pairing queries with all entries. Score: rank, share of the best name's words met, bonus for an exact or
    leading name, malus for words met in the context only, proximity by kind. Of entries of one folded name that
    lie close, the best stays. Ties go by length of name, then entry.
    """
    asked = asked_words(queries)
    post = postings(entries)
    exact = asked.select("query", F.explode("forms").alias("token")).join(post, "token").select("query", "entry")
    open_ = asked.filter("prefix").select("query", "word", F.substring("word", 1, 2).alias("two"))
    begun = open_.join(post.withColumn("two", F.substring("token", 1, 2)), "two").filter(F.col("token").startswith(F.col("word"))).select("query", "entry")
    hit = exact.unionByName(begun).distinct()
    need = asked.groupBy("query").agg(F.collect_list(F.struct("word", "forms", "prefix")).alias("need"))  # words of one query
    c = hit.join(need, "query").join(queries.select("query", fold(F.col("text")).alias("q"), F.col("lon").alias("qlon"), F.col("lat").alias("qlat")), "query").join(entries, "entry")
    c = c.withColumn("key", fold(F.col("name"))).withColumn("words", tokens(F.col("key"))).withColumn("around", tokens(fold(F.col("context"))))
    found = F.transform("need", lambda n: F.struct(
        F.get(_met(F.col("words"), n["forms"], n["prefix"], n["word"]), F.lit(0)).alias("name"), (F.size(_met(F.col("around"), n["forms"], n["prefix"], n["word"])) > 0).alias("near")))
    c = c.withColumn("found", found).filter(F.forall("found", lambda f: f["name"].isNotNull() | f["near"]) & F.exists("found", lambda f: f["name"].isNotNull()))
    soft = F.array(*[F.lit(w) for w in SOFT_WORDS])
    hard = F.filter("words", lambda w: ~F.array_contains(soft, w))
    met = F.transform("found", lambda f: f["name"])
    share = F.when(F.size(hard) > 0, F.size(F.filter(hard, lambda w: F.coalesce(F.array_contains(met, w), F.lit(False)))) / F.size(hard)).otherwise(0.0)
    area = F.col("kind").isin("admin", "place")
    bonus = reduce(lambda x, t: F.when(F.col("type") == t[0], t[1]).otherwise(x), EXACT_BONUS.items(), F.lit(0))
    same = F.col("key") == F.col("q")
    only = F.size(F.filter("found", lambda f: f["name"].isNull()))
    score = F.col("rank") + share * 60 + F.when(same, 20).otherwise(0) + F.when(same & area, bonus).otherwise(0) + F.when(F.col("key").startswith(F.col("q")), 10).otherwise(0) - only * 6
    km = F.sqrt(F.pow((F.col("lon") - F.col("qlon")) * F.cos(F.radians("qlat")), 2) + F.pow(F.col("lat") - F.col("qlat"), 2)) * DEGREE_M / 1000
    nearby = (F.when(F.col("kind").isin("poi", "street") | (F.col("type") == "suburb"), 80 * F.exp(-km / 15) + 15 * F.exp(-km / 150))
              .when(F.col("type").isin(*MAJOR), 15 * F.exp(-km / 50)).otherwise(40 * F.exp(-km / 15) + 10 * F.exp(-km / 150)))
    c = c.withColumn("score", F.round(score + F.coalesce(nearby, F.lit(0.0)), 6)).withColumn("area", area)
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.length("name"), "entry")
    kept = without_near(c.withColumn("n", F.row_number().over(w)))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("n"))).filter(F.col("place") <= most).select("query", "place", "entry", "name", "score")


def without_near(ranked: DataFrame) -> DataFrame:
    """Ranked hits without those that follow a kept hit of the same folded name and class close by.

    Inside a name and class the hits of one query are folded in order of rank: each is kept if no kept one is near.
    """
    reach = F.when(F.col("area"), 0.2).otherwise(0.003)
    hits = ranked.groupBy("query", "key", "area").agg(F.array_sort(F.collect_list(F.struct("n", "lon", "lat"))).alias("h"))  # hits of one name
    hits = hits.withColumn("reach", reach)
    none = F.array().cast("array<struct<n:int,lon:double,lat:double>>")
    kept = F.aggregate("h", none, lambda k, x: F.when(
        F.exists(k, lambda o: (F.abs(o["lon"] - x["lon"]) < F.col("reach")) & (F.abs(o["lat"] - x["lat"]) < F.col("reach"))), k).otherwise(F.concat(k, F.array(x))))
    left = hits.select("query", F.explode(F.transform(kept, lambda x: x["n"])).alias("n"))
    return ranked.join(left, ["query", "n"])


def tier(names: Column, asked: Column) -> Column:
    """0 exact name, 1 a name begins so, 2 a word of it does; null for none."""
    of = lambda n: F.when(n == asked, 0).when(n.startswith(asked), 1).when(n.contains(F.concat(F.lit(" "), asked)), 2)
    return F.array_min(F.transform(names, of))


def world_search(places: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """query, place, id, tier and important for countries and cities by the start of their names or of a word in them.

    What follows a comma narrows by country, code or province. Where nothing is found, the last word is tried as
    that. Queries are few; candidates come by the first two letters of a name's words.
    """
    parts = F.transform(F.split("text", ","), fold_world)
    q = queries.withColumn("asked", F.get(parts, F.lit(0))).withColumn("narrow", F.concat_ws(" ", F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != ""))).filter("length(asked) >= 2")
    p = places.withColumn("names", F.array_distinct(F.filter(F.transform(F.array("name", "name_es"), fold_world), lambda n: n != "")))
    p = p.withColumn("around", F.filter(F.transform(F.array("country", "country_es", "country_code", "admin1"), fold_world), lambda n: n != ""))
    starts = p.select("id", F.explode(F.array_distinct(F.flatten(F.transform("names", lambda n: F.transform(tokens(n), lambda w: F.substring(w, 1, 2)))))).alias("two"))

    def matched(asked: DataFrame) -> DataFrame:
        hit = asked.withColumn("two", F.substring("asked", 1, 2)).join(starts, "two").join(p, "id")
        ok = (F.col("narrow") == "") | F.exists("around", lambda a: a.startswith(F.col("narrow")))
        return hit.filter(ok).withColumn("tier", tier(F.col("names"), F.col("asked"))).filter("tier is not null").select("query", "id", "tier", "type", "capital", "population")

    first = matched(q)
    words = F.split("asked", " ")
    again = q.filter("narrow = '' and instr(asked, ' ') > 0").join(first.select("query").distinct(), "query", "left_anti")
    again = again.withColumns({"narrow": F.element_at(words, -1), "asked": F.array_join(F.slice(words, 1, F.size(words) - 1), " ")})
    got = first.unionByName(matched(again))
    kind = F.when(F.col("type") == "country", 0).when(F.col("capital") == "2", 1).when(F.col("capital") == "4", 2).otherwise(3)
    important = (F.col("tier") <= 1) & ((F.col("type") == "country") | F.coalesce(F.col("capital") == "2", F.lit(False)) | (F.col("population") >= 1_000_000))
    w = Window.partitionBy("query").orderBy("tier", kind, F.desc("population"), "id")
    return got.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("query", "place", "id", "tier", important.alias("important"))


def reverse(points: DataFrame, entries: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, kind, name, road: a point of interest within 25 m, else a named street within 60 m, else a place within 3 km, else nothing.

    Each position is looked up once, however many rows stand there.
    """
    spots = cut(points.filter("lon is not null and lat is not null").groupBy("lon", "lat").agg(F.min(key).alias(key)))
    poi = spatial.nearest_points(spots, entries.filter("kind = 'poi'"), key, "entry", 25.0).select(key, F.col("entry").alias("poi"))
    road = cut(spatial.nearest_edges(spots.select(key, "lon", "lat"), edges.filter("name is not null and cls <> 11"), key, 60.0).join(edges.select("edge", F.col("name").alias("road")), "edge").select(key, "road"))
    rest = spots.join(poi.select(key), key, "left_anti").join(road.select(key), key, "left_anti")
    place = spatial.nearest_points(rest, entries.filter("kind = 'place'"), key, "entry", 3000.0).select(key, F.col("entry").alias("place"))
    got = spots.join(poi, key, "left").join(road, key, "left").join(place, key, "left")
    neither = F.col("poi").isNull() & F.col("road").isNull()
    pick = F.coalesce("poi", F.when(neither, F.col("place")))
    got = got.withColumn("entry", pick).join(entries.select("entry", "name"), "entry", "left")
    kind = F.when(F.col("poi").isNotNull(), "poi").when(F.col("road").isNotNull(), "street").when(F.col("place").isNotNull(), "place")
    named = got.select("lon", "lat", kind.alias("kind"), F.coalesce("name", "road").alias("name"), "road")
    return points.select(key, "lon", "lat").join(named, ["lon", "lat"], "left").select(key, "kind", "name", "road")


# fixed values: two results of one name nearer than this are one place; how near to the map's middle a place comes first; types of places
SAME_M, PREFERRED_M = 25_000.0, 1_500_000.0
PLACE_TYPES = ("capital", "city", "town", "state", "county", "administrative")


def merged(detailed: DataFrame, world: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """query, place, source, id, part: two rankings as one, in four parts.

    detailed holds query, place, id, name, type, lon, lat; world the same with important; queries query, lon, lat (null
    where the map shows nothing). Part 0: the places that lead the detailed ranking, up to the first that is no place
    or lies too far from the map's middle; 1: important places of the world; 2: the rest of the detailed ranking; 3: the
    rest of the world. Of results of one name that lie close together the first stays, `most` are kept.
    """
    at = queries.select("query", F.col("lon").alias("qlon"), F.col("lat").alias("qlat"))
    first = Window.partitionBy("query").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = F.coalesce(F.col("type").isin(*PLACE_TYPES) & (haversine(F.col("lon"), F.col("lat"), F.col("qlon"), F.col("qlat")) <= PREFERRED_M), F.lit(False))
    d = detailed.join(at, "query", "left").withColumn("part", F.when(F.min(fits.cast("int")).over(first) == 1, 0).otherwise(2))
    cols = [F.col(c) for c in ("query", "place", "id", "name", "lon", "lat", "part")]
    both = d.select(*cols, F.lit("detailed").alias("source")).unionByName(world.withColumn("part", F.when(F.col("important"), 1).otherwise(3)).select(*cols, F.lit("world").alias("source")))
    both = both.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("part", "place", "id"))).withColumn("key", fold_world(F.col("name")))
    hits = both.groupBy("query", "key").agg(F.array_sort(F.collect_list(F.struct("n", "lon", "lat"))).alias("h"))  # results of one name
    none = F.array().cast("array<struct<n:int,lon:double,lat:double>>")
    kept = F.aggregate("h", none, lambda k, x: F.when(F.exists(k, lambda o: haversine(o["lon"], o["lat"], x["lon"], x["lat"]) < SAME_M), k).otherwise(F.concat(k, F.array(x))))
    left = both.join(hits.select("query", F.explode(F.transform(kept, lambda x: x["n"])).alias("n")), ["query", "n"])
    ranked = left.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("n"))).filter(F.col("place") <= most)
    return ranked.select("query", "place", "source", "id", "part")
