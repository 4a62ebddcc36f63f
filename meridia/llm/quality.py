"""Quality rules with robust multivariate outliers (minimum covariance determinant), JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, staged, words

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
P = 4  # features


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base statistics of each whole text. Null counts as empty.

    Repeated 3-word windows are found inside the row: windows as 64-bit hashes with their
    positions, sorted, equal neighbours marked. Rows whose windows are all distinct skip the sort.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    w, h, s = fresh(docs, "w"), fresh(docs, "h"), fresh(docs, "s")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn(w, words(F.col(text)))
    n = F.size(w)
    df = df.withColumn(
        h,
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>")),
    ).withColumn(
        s,
        F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
    )
    m = F.size(s)
    twice = F.filter(
        F.transform(F.sequence(F.lit(0), m - 1), lambda k: F.when(
            (F.get(s, k)["h"] == F.get(s, k - 1)["h"]).eqNullSafe(True) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"]).eqNullSafe(True), F.get(s, k)["i"])),
        lambda x: x.isNotNull(),
    )
    cover = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))
    return df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.when(F.col(s).isNull(), F.lit(0)).otherwise(cover).cast("long"),
    }).drop(w, h, s)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log1p(F.col("n_words").cast("double")), F.log1p(F.col("word_chars") / n),
            F.sqrt(F.col("n_symbols") / n), F.sqrt((F.col("n_repeat_words") + F.col("n_dup_lines")) / n)]


def _distance() -> Column:
    """Squared Mahalanobis distance by Cholesky factors held in the columns l_ij and m_i."""
    ys: list[Column] = []
    for i in range(P):
        r = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            r = r - F.col(f"l{i}{j}") * ys[j]
        ys.append(r / F.col(f"l{i}{i}"))
    out = ys[0] * ys[0]
    for y in ys[1:]:
        out = out + y * y
    return out


def _fit(rows: DataFrame, key: list[str], ridge: float) -> DataFrame:
    """Mean and Cholesky factor of the covariance per group; partial aggregates, so hot groups spread."""
    agg = rows.groupBy(*key).agg(
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(P)],
        *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)],
    )
    for i in range(P):
        for j in range(i + 1):
            v = F.col(f"c{i}{j}") + (F.lit(ridge) if i == j else F.lit(0.0))
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            agg = agg.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(ridge))) if i == j else v / F.col(f"l{j}{j}"))
    return agg.drop(*[f"c{i}{j}" for i in range(P) for j in range(i + 1)])


def _joined(rows: DataFrame, params: DataFrame, key: list[str]) -> DataFrame:
    p = params.select(*[F.col(k).alias(f"p_{k}") for k in key], *[c for c in params.columns if c not in key])
    on = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"p_{k}"))
    return rows.join(p, on, "left").drop(*[f"p_{k}" for k in key])


def mcd_models(stats: DataFrame, key: list[str], share: float = 0.75, steps: int = 3, ridge: float = 4e-3) -> DataFrame:
    """Minimum-covariance-determinant fit per group by concentration steps.

    The start is each group's median and spread; a step keeps the `share` of rows nearest by
    Mahalanobis distance and fits again. Cut points come from mergeable quantile sketches.
    The result has one row per group, with its median distance.
    """
    x = stats.select(*key, *[f.alias(f"x{i}") for i, f in enumerate(_features())])
    start = x.groupBy(*key).agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(P)])
    for i in range(P):
        q = F.col(f"q{i}")
        start = start.withColumn(f"m{i}", q[1]).withColumn(f"l{i}{i}", F.greatest((q[2] - q[0]) / 1.349, F.lit(ridge**0.5)))
        for j in range(i):
            start = start.withColumn(f"l{i}{j}", F.lit(0.0))
    params = staged(start.drop(*[f"q{i}" for i in range(P)]))
    for _ in range(steps):
        d = _joined(x, params, key).withColumn("d2", _distance())
        cut = staged(d.groupBy(*key).agg(F.percentile_approx("d2", share, 1000).alias("cut")))
        near = _joined(d.select(*key, *[f"x{i}" for i in range(P)], "d2"), cut, key).filter("d2 <= cut")
        params = staged(_fit(near, key, ridge))
    mid = staged(_joined(x, params, key).withColumn("d2", _distance()).groupBy(*key).agg(F.percentile_approx("d2", 0.5, 1000).alias("mid")))
    return staged(_joined(params, mid, key))


def judge(stats: DataFrame, key: list[str], limit: float = 80.0) -> DataFrame:
    """Adds distance, base_failed and kept.

    Only rows that pass the base rules shape the models. A row goes if it fails the base rules or
    if its scaled squared distance is over `limit` (chi-square of 4 degrees leaves 1e-16 beyond 80;
    heavy-tailed prose needs such a wide margin). A group without a model keeps its rows. Null group
    keys form a group. Repeated rows are judged one by one; an empty table gives an empty table.
    """
    models = mcd_models(stats.filter(~base_failed()), key)
    # 3.357 is the median of chi-square with 4 degrees of freedom; a wider median shrinks distances, a narrower one leaves them
    d = _joined(stats.withColumns({f"x{i}": f for i, f in enumerate(_features())}), models, key)
    d = d.withColumn("distance", F.coalesce(_distance() * 3.357 / F.greatest(F.col("mid"), F.lit(3.357)), F.lit(0.0)))
    drop = [c for c in models.columns if c not in key] + [f"x{i}" for i in range(P)]
    return d.drop(*drop).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= limit))


def quality_table(docs: DataFrame) -> DataFrame:
    """doc_id, base statistics, base_failed, distance and kept of each row of docs; cases as in with_stats and judge.

    A null doc_id is kept; null lang and source form groups; rows with equal distances share a verdict; other
    columns are not read.
    """
    stats = staged(with_stats(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    return judge(stats, ["lang", "source"]).select("doc_id", *STATS, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns, whatever these are named. Cases as in judge; repeated rows pass or go together."""
    inner = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"), F.col("lang"), F.col("source"))
    stats = staged(with_stats(inner).drop("text"))
    return judge(stats, ["lang", "source"]).filter("kept").select("row.*")
