"""Histories of a key: latest rows, fills, changes, as-of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the (total) order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def latest_values(df: DataFrame, key: str, day: str, *columns: str) -> DataFrame:
    """The last day and the columns' values on it, as an aggregate: no sort, no window."""
    best = F.max(F.struct(day, *columns))
    return df.groupBy(key).agg(best.alias("__m")).select(key, *[F.col(f"__m.{c}").alias(c) for c in (day, *columns)])


def earliest_price(df: DataFrame, key: str, day: str, price: str, out: str) -> DataFrame:
    """First positive price of each key, the lowest of its day."""
    return df.where(F.col(price) > 0).groupBy(key).agg(F.min(F.struct(day, price)).alias("__m")).select(key, F.col(f"__m.{price}").alias(out))


def fill_base_price(base: DataFrame, first: DataFrame, second: DataFrame, key: str = "vin", price: str = "base_price", history_day: str = "history_date", history_price: str = "price") -> DataFrame:
    """Base price if positive, else the earliest of the first history, else of
    the second; with its source."""
    a = earliest_price(first, key, history_day, history_price, "__a")
    b = earliest_price(second, key, history_day, history_price, "__b")
    own = F.when(F.col(price) > 0, F.col(price).cast("double"))
    j = base.join(a, key, "left").join(b, key, "left")
    return j.withColumn("base_price_source", F.when(own.isNotNull(), "nhtsa").when(F.col("__a").isNotNull(), "price_history").when(F.col("__b").isNotNull(), "listing_history").otherwise("missing")).withColumn(price, F.coalesce(own, F.col("__a").cast("double"), F.col("__b").cast("double"))).drop("__a", "__b")


def fill_both_ways(df: DataFrame, key: str, order: list[Column], column: str) -> DataFrame:
    """Nulls take the last value before them, else the first after them."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.last(column, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(column, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(column, F.coalesce(before, after))


def changes(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Adds change (from the row before) and change_from_first with its share."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumns({"change": F.col(value) - F.lag(value).over(w), "change_from_first": F.col(value) - first, "change_share": F.try_divide((F.col(value) - first).cast("double"), F.nullif(first, F.lit(0)).cast("double"))})


def emit_changes(df: DataFrame, key: str, order: list[Column], *values: str) -> DataFrame:
    """Rows that are the first of their key or differ from the row before in a value."""
    w = Window.partitionBy(key).orderBy(*order)
    differs = F.row_number().over(w) == 1
    for v in values:
        differs = differs | ~F.col(v).eqNullSafe(F.lag(v).over(w))
    return df.withColumn("__emit", differs).where("__emit").drop("__emit")


def asof_backward(left: DataFrame, right: DataFrame, key: str, day: str, right_value: str, tie: list[Column], days: int = 7) -> DataFrame:
    """Left rows with right_day and right_value of the nearest right row of the
    key at or before the day, within so many days; rows without one go.

    One union, one shuffle and one sort by key: the last right row is carried
    forward, which is linear whatever the rows per key. Of right rows of one day
    the first in the `tie` order counts."""
    one = latest(right.withColumn("__k", F.struct(key, day)), "__k", *tie).select(key, F.col(day).alias("__day"), F.struct(F.col(day).alias("d"), F.col(right_value).alias("v")).alias("__r"), F.lit(0).alias("__side"))
    rows = left.select(key, F.col(day).alias("__day"), F.lit(None).cast(one.schema["__r"].dataType).alias("__r"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"))
    both = one.withColumn("__l", F.lit(None).cast(rows.schema["__l"].dataType)).unionByName(rows)
    w = Window.partitionBy(key).orderBy("__day", "__side").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("__r", F.last("__r", True).over(w)).where("__side = 1")
    return hit.where(F.datediff("__day", F.col("__r.d")) <= days).select("__l.*", F.col("__r.d").alias("right_day"), F.col("__r.v").alias("right_value"))


def overlap_rate(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n and share of equal values over the rows that agree on the keys (0.0 for none)."""
    j = left.select(*keys, F.col(value).alias("__a")).join(right.select(*keys, F.col(value).alias("__b")), keys)
    return j.agg(F.count("*").alias("n_overlap"), F.coalesce(F.avg(F.when(F.col("__a") == F.col("__b"), 1.0).otherwise(0.0)), F.lit(0.0)).alias("equal_rate"))


def gap_report(left: DataFrame, right: DataFrame, key: str, day: str, value: str, tie: list[Column], days: int = 7) -> DataFrame:
    """As-of matched rows with their gap, and the label of the pair of histories."""
    rate = overlap_rate(left, right, [key, day], value)
    label = F.when((F.col("n_overlap") > 0) & (F.col("equal_rate") >= 0.95), "duplicate_like_price_trajectory").otherwise("distinct_price_trajectory")
    m = asof_backward(left, right, key, day, value, tie, days).crossJoin(F.broadcast(rate))
    return m.withColumns({"absolute_gap": F.abs(F.col(value) - F.col("right_value")), "percent_gap": F.try_divide((F.col(value) - F.col("right_value")).cast("double"), F.nullif(F.col("right_value"), F.lit(0)).cast("double")), "days_gap": F.datediff(day, "right_day"), "label": label})


def depreciation(history: DataFrame, identity: DataFrame, key: str = "vin", day: str = "history_date", price: str = "price", mileage: str = "mileage", year: str = "canonical_year", tie: str = "seq") -> DataFrame:
    """First price in the model year against the latest, per key."""
    j = history.join(identity, key)
    first = latest(j.where((F.year(day) == F.col(year)) & (F.col(price) > 1234)), key, F.col(day), F.col(tie), F.col(price), F.col(mileage).asc_nulls_last())
    last = latest(j.where(F.col(price) > 1234), key, F.col(day).desc(), F.col(tie).desc(), F.col(price).desc(), F.col(mileage).desc_nulls_last())
    f = first.select(key, F.col(day).alias("first_day"), F.col(price).alias("first_price"), F.col(mileage).alias("first_mileage"))
    d = f.join(last.select(key, F.col(day).alias("last_day"), F.col(price).alias("last_price"), F.col(mileage).alias("last_mileage")), key)
    years = F.when(F.datediff("last_day", "first_day") == 0, 0.001).otherwise(F.datediff("last_day", "first_day") / 365.25)
    lost = F.col("first_price") - F.col("last_price")
    driven = F.when(F.col("last_mileage") - F.col("first_mileage") == 0, 1).otherwise(F.col("last_mileage") - F.col("first_mileage"))
    return d.withColumns({"depreciation": lost, "depreciation_share": lost / F.col("first_price"), "per_year": lost / years, "per_mile": lost / driven})
