"""Samples and splits of tables, deterministic by hashes or total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scoped(df: DataFrame, n: int, strategy: str, recent: list[Column]) -> DataFrame:
    """recent: the n rows that come first in the given order; none: any n rows;
    all rows for n <= 0. The order is a sampling feature and must be total."""
    if n <= 0:
        return df
    if strategy == "recent":
        return df.orderBy(*recent).limit(n)
    if strategy == "none":
        return df.limit(n)
    raise ValueError(f"unknown strategy {strategy}")


def evenly_numbered(df: DataFrame, number: str, n: int) -> DataFrame:
    """Rows at n row numbers spread evenly up to the largest, 1 + trunc(i (max -
    1) / n) for i from 0. Numbers that don't exist give no row."""
    spark = df.sparkSession
    top = df.agg(F.max(number).alias("__top"))
    picks = spark.range(n).crossJoin(F.broadcast(top)).select((F.lit(1) + F.floor(F.col("id") * (F.col("__top") - 1.0) / n)).cast("long").alias("__pick"))
    return df.join(picks, F.col(number) == F.col("__pick")).drop("__pick")


def recent_keys_full_history(df: DataFrame, key: str, n: int, recent: list[Column]) -> DataFrame:
    """All rows of the keys that occur in the n most recent rows."""
    return df.join(df.orderBy(*recent).limit(n).select(key).distinct(), key, "left_semi")


def stratified(df: DataFrame, stratum: str, ident: str, most: int, seed: int = 42) -> DataFrame:
    """Exactly `most` rows (all, if fewer): each stratum gives its share, rounded
    half to even and at least one; what is over goes and what is under is filled
    in the order of a hash of the row's identity."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")))
    sizes = df.groupBy(F.col(stratum).alias("__s")).agg(F.count("*").alias("__size"))
    total = sizes.agg(F.sum("__size").alias("__n"))
    quota = sizes.crossJoin(F.broadcast(total)).select("__s", "__n", F.least("__size", F.greatest(F.lit(1), F.bround(F.col("__size") * most / F.col("__n"), 0))).cast("long").alias("__quota"))
    # a row behind `most` others of its stratum is never taken; with this bound Spark drops such rows before the shuffle
    ranked = df.withColumn("__h", order).withColumn("__rank", F.row_number().over(Window.partitionBy(stratum).orderBy("__h", ident))).where(F.col("__rank") <= most)
    ranked = ranked.join(quota, F.col(stratum).eqNullSafe(F.col("__s")))
    inside = (F.col("__rank") > F.col("__quota")).cast("int")
    return ranked.withColumn("__late", inside).orderBy("__late", (F.col("__rank") > 1).cast("int"), "__h", ident).limit(most).drop("__h", "__rank", "__s", "__n", "__quota", "__late")


def split_by_time(df: DataFrame, key: str, day: str, share: float = 0.8, least_train: int = 100, least_test: int = 50) -> DataFrame:
    """Adds `part`: test from the day quantile on, train before it without the
    keys of the test rows (part null). With fewer than two days, or too few rows
    on a side, keys are dealt by hash instead, a whole key to one side."""
    numbered = df.withColumn("__day", F.unix_date(F.col(day).cast("date")).cast("double"))
    cut = numbered.agg(F.percentile("__day", share).alias("__cut"), F.min("__day").alias("__lo"), F.max("__day").alias("__hi"))
    tagged = numbered.crossJoin(F.broadcast(cut)).withColumn("__test", F.col("__day") >= F.col("__cut"))
    late = tagged.where("__test").select(F.col(key).alias("__key")).distinct().withColumn("__seen", F.lit(True))
    tagged = tagged.join(late, F.col(key) == F.col("__key"), "left")
    part = F.when(F.col("__test"), "test").when(F.col("__seen").isNull(), "train")
    counts = tagged.agg(F.count_if(part == "train").alias("__train"), F.count_if(part == "test").alias("__tests"))
    dealt = F.when(F.pmod(F.xxhash64(key), F.lit(100)) < int(share * 100), "train").otherwise("test")
    good = (F.col("__lo") < F.col("__hi")) & (F.col("__train") >= least_train) & (F.col("__tests") >= least_test)
    return tagged.crossJoin(F.broadcast(counts)).withColumn("part", F.when(good, part).otherwise(dealt)).drop("__day", "__cut", "__lo", "__hi", "__test", "__key", "__seen", "__train", "__tests")


def choose_cutoff(panel: DataFrame, month: str = "month_start", target_month: str = "target_month", target: str = "target", least: int = 2) -> object | None:
    """First candidate month with at least `least` rows on both sides: train rows
    have their target month before it, test rows their month from it on.
    Candidates are the quantiles .8 to .15, then every month; their counts are
    running sums over one row per month."""
    days = panel.where(F.col(target).isNotNull())
    marks = days.agg(F.percentile(F.unix_date(month).cast("double"), [0.8, 0.85, 0.75, 0.65, 0.55, 0.45, 0.35, 0.25, 0.15]).alias("q")).select(F.posexplode("q").alias("rank", "day")).select("rank", F.date_from_unix_date(F.col("day").cast("int")).alias("cutoff"))
    every = days.select(F.lit(100).alias("rank"), F.col(month).alias("cutoff")).distinct()
    counts = lambda c, name: days.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("cutoff")).agg(F.count("*").alias(name))
    dated = marks.unionByName(every).unionByName(counts(target_month, "targets"), True).unionByName(counts(month, "months"), True)
    before = Window.orderBy(F.unix_date("cutoff")).rangeBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.unix_date("cutoff")).rangeBetween(0, Window.unboundedFollowing)
    counted = dated.where(F.col("cutoff").isNotNull()).select("rank", "cutoff", F.sum("targets").over(before).alias("train"), F.sum("months").over(later).alias("test")).where(F.col("rank").isNotNull())
    row = counted.where((F.col("train") >= least) & (F.col("test") >= least)).orderBy("rank", "cutoff").first()
    return row["cutoff"] if row else None


def split_for_horizon(panel: DataFrame, cutoff, month: str = "month_start", target_month: str = "target_month") -> tuple[DataFrame, DataFrame]:
    """(train, test) without leakage: train targets lie before the cutoff."""
    return panel.where(F.col(target_month) < F.lit(cutoff)), panel.where(F.col(month) >= F.lit(cutoff))
