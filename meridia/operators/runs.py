"""Runs of equal values, gaps, and shares of runs, as window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, part: str, order: list[str], value: str, sums: list[str] = ()) -> DataFrame:
    """Runs of equal values in order: first position, length and sums of other columns."""
    w = Window.partitionBy(part).orderBy(*order)
    p = df.withColumns({"pos": F.row_number().over(w), "new": (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")})
    r = p.withColumn("run", F.sum("new").over(w)).groupBy(part, "run", value)
    return r.agg(F.min("pos").cast("long").alias("first"), F.count("*").alias("length"), *[F.round(F.sum(F.col(c).cast("decimal(24,6)")).cast("double"), 3).alias(c) for c in sums])


def smoothed(df: DataFrame, part: str, order: list[str], flag: str, gap: int = 4) -> DataFrame:
    """Flags with gaps of up to `gap` rows between set ones filled, and then set rows that stand alone cleared."""
    w = Window.partitionBy(part).orderBy(*order)
    p = df.withColumn("new", (~F.col(flag).eqNullSafe(F.lag(flag).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    p = p.withColumn("run", F.sum("new").over(w))
    one = Window.partitionBy(part, "run")
    p = p.withColumns({"length": F.count("*").over(one), "lead": F.row_number().over(w), "last": F.max("run").over(Window.partitionBy(part))})
    p = p.withColumn("filled", F.col(flag) | ((F.col("run") > 1) & (F.col("run") < F.col("last")) & (F.col("length") <= gap)))
    alone = ~F.coalesce(F.lag("filled").over(w), F.lit(False)) & ~F.coalesce(F.lead("filled").over(w), F.lit(False))
    return p.withColumn("smooth", F.col("filled") & ~alone).select(*df.columns, "smooth")
