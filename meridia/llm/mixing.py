"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, words

UNIT = 1 << 20  # expected copies are whole multiples of 1/UNIT, so that sums are exact
WEIGHTS = (5, 2, 1)


def offset(seed: int) -> int:
    return random.Random(seed).randrange(UNIT)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """One row per source: source_size, target, and copies in units. The windows here see one row per source."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    t = total.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), k + 1).cast("long"))
    t = t.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    order = every.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
                     / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    t = t.withColumn("final", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(every)["level"])
    t = t.withColumn("target", F.when(F.col("final").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("w") * F.col("final"))))
    units = F.when(F.col("source_size") > 0, F.round(UNIT * F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return t.select("source", "source_size", "target", units.alias("units"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), *more)


def _mixed(sizes: DataFrame, seed: int) -> DataFrame:
    """Adds source_size, target and copies to rows of doc_id, source, size; texts are not among them.

    Rows of a source stand in the order of size, then doc_id; their expected copies are prefix-summed
    and a row is emitted once for each whole number its sum, moved by one random offset, passes.
    Rows are range-partitioned, so a hot source spreads; partition sums give each partition its base.
    """
    ranged = sizes.repartitionByRange(F.col("source"), F.col("size"), F.col("doc_id"))
    placed = staged(ranged.withColumn("pid", F.spark_partition_id()))
    targets = staged(source_targets(placed.select("source", "size")))
    t = targets.select(F.col("source").alias("s"), "source_size", "target", "units")
    counts = placed.groupBy("pid", "source").agg(F.count("*").alias("n"))
    base = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(counts.withColumn("base", F.coalesce(F.sum("n").over(base), F.lit(0)))).select(F.col("pid").alias("p"), F.col("source").alias("b"), "base")
    df = placed.join(t, placed["source"].eqNullSafe(t["s"]))
    df = df.join(bases, (F.col("pid") == F.col("p")) & F.col("source").eqNullSafe(F.col("b")))
    inside = Window.partitionBy("pid", "source").orderBy("size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("base") * F.col("units") + F.sum("units").over(inside) + F.lit(offset(seed))
    return df.withColumn("end", end).withColumn("copies", F.expr(f"(end div {UNIT}) - ((end - units) div {UNIT})"))


def mix_table(docs: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of each row of docs.

    Null text has size 0; a null source is a source, the last one; a null doc_id stands before others of its
    size. Equal rows share a place in the order, so which of them is emitted is open, but not how many: ties
    leave the result as it is. Repeated rows are counted one by one; an empty table gives an empty table; other
    columns are not read. The words taken of a source differ from its target by less than twice its largest document.
    """
    return _mixed(_sized(docs), seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The mix itself: each row as often as its copies say, with the columns of docs. Cases as in mix_table.

    A row is known by two hashes of all its columns (maps left out); equal rows sum their copies. Copies are
    worked out on ids and sizes, and texts are shuffled once, to meet them.
    """
    plain = [c for c, t in docs.dtypes if "map<" not in t]
    key = [F.xxhash64(*plain).alias("__a"), F.xxhash64(F.lit("mix"), *plain).alias("__b")]
    copies = _mixed(_sized(docs, *key), seed).groupBy("__a", "__b").agg(F.sum("copies").alias("__n")).filter("__n > 0")
    row = docs.select(F.struct(*docs.columns).alias("__row"), *key)
    got = row.join(staged(copies).hint("merge"), ["__a", "__b"]).dropDuplicates(["__a", "__b"])
    return got.select("__row", F.explode(F.sequence(F.lit(1), F.col("__n")))).select("__row.*")


ORACLE = f"""
with d as (select doc_id, source, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as bigint) size from documents),
s as (select source, cast(sum(size) as bigint) source_size from d group by source),
w as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::bigint w from s),
r as (select *, 3 * source_size cap, (3 * source_size)::double / w ratio from w),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
  / (sum(w) over () - coalesce(sum(w) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))::double lv from r),
f as (select (select lv from l where ratio > lv order by ratio, lv limit 1) fin),
t as (select source, source_size, case when fin is null then cap::double else least(cap::double, w * fin) end target from l, f),
u as (select *, case when source_size > 0 then round({UNIT} * target / source_size) else 0 end::bigint units from t),
c as (select doc_id, size, source_size, target, units, units * row_number() over (partition by d.source order by size, doc_id) + {offset(11)} e
  from d join u on d.source is not distinct from u.source)
select doc_id, size, source_size, target, cast(((e // {UNIT}) - ((e - units) // {UNIT})) * size as bigint) taken from c
"""
