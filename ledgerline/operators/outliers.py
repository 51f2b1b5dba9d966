"""Price outliers in the context of like vehicles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import repeated_digits

#: Levels from fine to coarse: columns and the least number of prices (fixed values).
LEVELS = (
    (("canonical_make", "canonical_model", "canonical_year", "canonical_trim"), 6),
    (("canonical_make", "canonical_model", "canonical_year"), 10),
    (("canonical_make", "canonical_model"), 20),
)


#: Ranges of a price that grows e-fold; doubles make at most about 91,000 in all.
RANGES = 64


def _ranked() -> list[Column]:
    """n, median and quartiles of histogram rows (__p, __to: how many prices are
    up to it, __n: all); null without any."""

    def at(rank):
        return F.min(F.when(F.col("__to") > rank, F.col("__p")))

    n1 = F.col("__n") - 1
    return [
        F.max("__n").alias("n"),
        ((at(F.floor(n1 / 2)) + at(F.ceil(n1 / 2))) / 2.0).alias("med"),
        at(F.round(n1 * 0.25)).cast("double").alias("q1"),
        at(F.round(n1 * 0.75)).cast("double").alias("q3"),
    ]


def price_stats(df: DataFrame, price: str, keys: tuple[str, ...]) -> DataFrame:
    """n, median (linear) and quartiles (nearest value) of each group.

    The quartiles come from a histogram per group (one row per price), so no
    group's prices are gathered: running counts find the value at the rank."""
    grouped = df.where(F.col(price).isNotNull()).groupBy(*keys, F.col(price).alias("__p")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys)
    h = grouped.withColumn("__n", F.sum("__c").over(w)).withColumn("__to", F.sum("__c").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)))

    return h.groupBy(*keys).agg(*_ranked())


def whole_stats(df: DataFrame, price: str) -> DataFrame:
    """price_stats() of all rows as one group, without one task for all prices:
    the histogram is cut into ranges of the price's logarithm, whose totals are
    one small table; running counts go over a range at a time."""
    h = df.where(F.col(price).isNotNull()).groupBy(F.col(price).alias("__p")).agg(F.count("*").alias("__c"))
    h = h.withColumn("__b", F.signum("__p") * F.floor(F.log1p(F.abs(F.col("__p").cast("double"))) * RANGES))
    totals = h.groupBy("__b").agg(F.sum("__c").alias("__t"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__start"), F.sum("__t").over(Window.partitionBy()).alias("__n"))
    inside = Window.partitionBy("__b").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    placed = h.withColumn("__in", F.sum("__c").over(inside)).join(F.broadcast(starts), "__b").withColumn("__to", F.col("__start") + F.col("__in"))
    return placed.agg(*_ranked())


def contextual_stats(df: DataFrame, price: str, levels: tuple = LEVELS) -> DataFrame:
    """Adds ctx_n, ctx_med, ctx_q1, ctx_q3, ctx_level: of the first level with
    enough prices, else of all. Groups with a null key match no row. The levels
    meet in a table of the different keys, so that the rows are joined once."""
    own = [(keys, least, i + 1) for i, (keys, least) in enumerate(levels) if set(keys) <= set(df.columns)]
    every = list(dict.fromkeys(k for keys, _, _ in own for k in keys))
    whole = whole_stats(df, price).select(F.struct("n", "med", "q1", "q3", F.lit(0).alias("level")).alias("__whole"))
    groups = df.select(*every).distinct() if every else df.sparkSession.range(1)
    for keys, least, level in own:
        s = price_stats(df.dropna(subset=list(keys)), price, keys)
        groups = groups.join(s.select(*keys, F.when(F.col("n") >= least, F.struct("n", "med", "q1", "q3", F.lit(level).alias("level"))).alias(f"__ctx{level}")), list(keys), "left")
    groups = groups.crossJoin(F.broadcast(whole)).select(*[F.col(k).alias(f"__{k}") for k in every], F.coalesce(*[f"__ctx{level}" for _, _, level in own], "__whole").alias("__ctx"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in every]
    found = df.join(groups, reduce(lambda a, b: a & b, same)) if every else df.crossJoin(F.broadcast(groups))
    return found.select(*df.columns, *[F.col(f"__ctx.{f}").alias(f"ctx_{f}") for f in ("n", "med", "q1", "q3", "level")])


def flag_outliers(df: DataFrame, price: str, levels: tuple = LEVELS) -> DataFrame:
    """Adds `outlier`: high, low, repeated or null, by ratio to the median of
    the context and fences of its quartiles."""
    d = contextual_stats(df, price, levels)
    p, med, q1, q3 = F.col(price), F.col("ctx_med"), F.col("ctx_q1"), F.col("ctx_q3")
    iqr = F.greatest(q3 - q1, F.lit(0.0))
    valid = (F.col("ctx_n") >= 6) & (med >= 5000)
    high = valid & (p > 3.5 * med) & (p > F.greatest(q3 + 3 * iqr, med + 25_000))
    low = valid & (p < 0.25 * med) & (p < F.least(F.greatest(q1 - 3 * iqr, F.lit(0.0)), 0.5 * med))
    again = valid & repeated_digits(p) & (((p > 2 * med) & (p > F.greatest(q3 + 1.5 * iqr, med + 15_000))) | ((p < 0.5 * med) & (p < q1)))
    return d.withColumn("outlier", F.when(high, "high").when(low, "low").when(again, "repeated"))


def drop_outliers(df: DataFrame, price: str, levels: tuple = LEVELS) -> DataFrame:
    """Rows without an outlier mark; a null price goes as well."""
    return flag_outliers(df, price, levels).where(F.col("outlier").isNull() & F.col(price).isNotNull()).select(*df.columns)

