"""Monthly cohort panels with lags, rolling statistics, market index and targets."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mode_or_unknown(c: str):
    """Most frequent non-blank upper-cased value, the smallest of ties, else UNKNOWN."""
    v = F.nullif(F.upper(F.trim(c)), F.lit(""))
    return F.coalesce(F.mode(v, True), F.lit("UNKNOWN"))


#: What the whole panel takes besides prices: modes, means and medians by cohort.
PANEL_MODES = ("body_class", "drive_type", "fuel_type", "electrification_level", "seller_type", "source_name")
PANEL_MEANS = ("vehicle_age_months", "miles_per_year", "price_down", "sentiment_score", "sentiment_comment_count", "sentiment_video_count")
PANEL_MEDIANS = ("engine_hp", "engine_cylinders", "total_recalls", "total_complaints")


def panel_inputs(history: DataFrame, year: str = "model_year", day: str = "history_date", mileage: str = "mileage", trend: str = "trend") -> DataFrame:
    """Adds vehicle_age_months (since January of the model year, not below 0),
    miles_per_year (of a quarter at least) and price_down (1 where the trend
    tells of a lower price, else 0; a null trend: 0). A missing count of comments
    or videos is 0, as no comment is known."""
    age = F.greatest(F.datediff(day, F.make_date(F.col(year), F.lit(1), F.lit(1))) / 30.4375, F.lit(0.0))
    d = history.withColumn("vehicle_age_months", age)
    d = d.withColumns({"miles_per_year": F.col(mileage) / F.greatest(F.col("vehicle_age_months") / 12, F.lit(0.25)), "price_down": F.coalesce(F.lower(trend), F.lit("")).rlike("down|drop|decrease").cast("int")})
    return d.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("sentiment_comment_count", "sentiment_video_count") if c in history.columns})


def full_panel(history: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """The monthly panel with all its statistics, of a history that has the
    columns of PANEL_MODES and PANEL_MEDIANS and the sentiment of each row. Scores
    are short decimals whose means are often halves of a place: they are exact."""
    return monthly(panel_inputs(history, **columns), keys, modes=PANEL_MODES, means=PANEL_MEANS, medians=PANEL_MEDIANS, exact=("sentiment_score",))


def exact_mean(c: str):
    """The mean of a double by sums of decimals (12 places), which no order of the
    rows changes; with a value that these do not hold, the mean of the doubles."""
    d = F.col(c).try_cast("decimal(30,12)")
    return F.when(F.count(d) == F.count(c), F.avg(d).cast("double")).otherwise(F.avg(c))


def monthly(history: DataFrame, keys: list[str], day: str = "history_date", price: str = "price", mileage: str = "mileage", ident: str | None = "vin", modes: tuple[str, ...] = (), means: tuple[str, ...] = (), medians: tuple[str, ...] = (), exact: tuple[str, ...] = ()) -> DataFrame:
    """One row per cohort and month: price statistics, volume, distinct keys, and
    the modes, means and medians that are asked for (mode_x, avg_x, median_x;
    means of the columns in exact by exact_mean()).
    Keys are counted apart: beside the other aggregates a distinct count makes
    buffers of all of them for every key of a cohort and month. Without ident
    they are not counted."""
    history = history.withColumn("month_start", F.trunc(day, "month"))
    found = history.groupBy(*keys, "month_start").agg(
        F.percentile(price, F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75))).alias("__price"),
        F.avg(price).alias("avg_price"),
        F.avg(mileage).alias("avg_mileage"),
        F.percentile(mileage, 0.5).alias("median_mileage"),
        F.count("*").alias("volume"),
        *[mode_or_unknown(m).alias(f"mode_{m}") for m in modes],
        *[(exact_mean(m) if m in exact else F.avg(m)).alias(f"avg_{m}") for m in means],
        *[F.percentile(m, 0.5).alias(f"median_{m}") for m in medians],
    )
    at = {f"{name}_price": F.col("__price")[i] for i, name in enumerate(("median", "p25", "p75"))}
    more = found.columns[len(keys) + 3 :]
    if ident is not None:
        by = [*keys, "month_start"]
        counted = history.groupBy(*by).agg(F.count_distinct(ident).alias("unique_vins")).toDF(*[f"__{k}" for k in by], "unique_vins")
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]
        found = found.join(counted, functools.reduce(lambda a, b: a & b, same))
        more.insert(more.index("volume") + 1, "unique_vins")
    return found.select(*keys, "month_start", at["median_price"].alias("median_price"), "avg_price", at["p25_price"].alias("p25_price"), at["p75_price"].alias("p75_price"), *more)


def supported(panel: DataFrame, keys: list[str], least_vins: int, least_months: int) -> DataFrame:
    """Rows with enough keys, of cohorts that then still have enough months."""
    kept = panel.where(F.col("unique_vins") >= least_vins)
    return kept.withColumn("__m", F.count("*").over(Window.partitionBy(*keys))).where(F.col("__m") >= least_months).drop("__m")


def market_index(panel: DataFrame) -> DataFrame:
    """(month_start, market_median, market_volume, market_index): over the
    panel's months, the index relative to the first month. One row a month, so
    the running parts work on a bounded table."""
    m = panel.groupBy("month_start").agg(F.percentile("median_price", 0.5).alias("market_median"), F.sum("volume").alias("market_volume"))
    base = m.agg(F.min_by("market_median", "month_start").alias("__base"))
    return m.crossJoin(F.broadcast(base)).withColumn("market_index", F.try_divide("market_median", F.nullif("__base", F.lit(0.0)))).drop("__base")


def features(panel: DataFrame, keys: list[str], horizons: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Lags, rolling statistics over the three rows before, the market's index
    and row-based targets. All windows share one partitioning and order, so the
    panel is shuffled and sorted once."""
    base = panel.join(market_index(panel), "month_start")
    part = Window.partitionBy(*keys)
    w = part.orderBy("month_start")
    three = w.rowsBetween(-3, -1)
    first_month = F.first("month_start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    first_price = F.first("median_price").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ratio = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
    d = base.withColumns(
        {
            "month": F.month("month_start"),
            "quarter": F.quarter("month_start"),
            "cohort_month_number": F.row_number().over(w) - 1,
            "cohort_age_months": (F.year("month_start") - F.year(first_month)) * 12 + F.month("month_start") - F.month(first_month),
            "price_index": ratio(F.col("median_price"), first_price),
            "price_lag_1": F.lag("median_price", 1).over(w),
            "price_lag_2": F.lag("median_price", 2).over(w),
            "rolling_median_3": F.percentile("median_price", 0.5).over(three),
            "rolling_mileage_3": F.avg("avg_mileage").over(three),
            "rolling_volume_3": F.avg("volume").over(three),
        }
    )
    d = d.withColumns({"cumulative_change": F.col("price_index") - 1, "index_lag_1": F.lag("price_index").over(w), "__change": ratio(F.col("median_price"), F.col("price_lag_1")) - 1})
    d = d.withColumn("rolling_change_3", F.avg("__change").over(three)).drop("__change")
    for h in horizons:
        d = d.withColumns({f"target_month_{h}m": F.lead("month_start", h).over(w), f"target_price_{h}m": F.lead("median_price", h).over(w)})
        d = d.withColumn(f"target_change_{h}m", ratio(F.col(f"target_price_{h}m"), F.col("median_price")) - 1)
    return d


def eligible_origins(panel: DataFrame, keys: list[str], target: str, least_months: int = 6) -> DataFrame:
    """Months at which a cohort has a history of so many months and a target."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("month_start"))
    return panel.withColumn("__n", n).where((F.col("__n") >= least_months) & F.col(target).isNotNull()).select("month_start").distinct()


def calendar_series(panel: DataFrame, keys: list[str], value: str = "median_price") -> DataFrame:
    """Every month from a cohort's first to its last; missing values by linear
    interpolation between their neighbours."""
    grid = panel.groupBy(*keys).agg(F.min("month_start").alias("__a"), F.max("month_start").alias("__b")).select(*keys, F.explode(F.expr("sequence(__a, __b, interval 1 month)")).alias("month_start"))
    own = panel.groupBy(*keys, "month_start").agg(F.max(value).alias(value))
    w = Window.partitionBy(*keys).orderBy("month_start")
    at = F.year("month_start") * 12 + F.month("month_start")
    j = grid.join(own, [*keys, "month_start"], "left").withColumn("__p", F.when(F.col(value).isNotNull(), F.struct(at.alias("m"), F.col(value).alias("v"))))
    j = j.withColumns({"__lo": F.last("__p", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__hi": F.first("__p", True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    step = (F.col("__hi.v") - F.col("__lo.v")) * (at - F.col("__lo.m")) / F.nullif(F.col("__hi.m") - F.col("__lo.m"), F.lit(0))
    return j.withColumn("interpolated", F.col(value).isNull()).withColumn(value, F.coalesce(F.col(value), F.col("__lo.v") + step)).drop("__p", "__lo", "__hi")


def top_cohorts(panel: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n cohorts with the most months, volume, recency and last support."""
    s = panel.groupBy(*keys).agg(F.count_distinct("month_start").alias("months"), F.sum("volume").alias("total_volume"), F.max("month_start").alias("last_month"), F.max_by("unique_vins", "month_start").alias("last_vins"))
    return s.orderBy(F.desc("months"), F.desc("total_volume"), F.desc("last_month"), F.desc("last_vins"), *keys).limit(n)
