"""Seasonal autoregression of cohort series by column functions: differences,
running sums of lag products, least squares in closed form, and the forecast as
a fold over the last values. No origin is fitted on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Months without which a series is not forecast, and from which it is seasonal.
LEAST_MONTHS, LEAST_SEASONAL, SEASON = 6, 36, 12


def _solve(n: Column, x: Column, u: Column, y: Column, xx: Column, xu: Column, uu: Column, xy: Column, uy: Column) -> tuple[Column, Column, Column]:
    """(intercept, weight of x, weight of u) of y by least squares from sums;
    null where they are not determined."""
    a, b, c = xx - x * x / n, xu - x * u / n, uu - u * u / n
    p, q = xy - x * y / n, uy - u * y / n
    det = a * c - b * b
    fits = (n >= 4) & (det > F.lit(1e-10) * a * c)
    w = F.when(fits, (c * p - b * q) / det)
    v = F.when(fits, (a * q - b * p) / det)
    return (y - w * x - v * u) / n, w, v


def seasonal_ar(series: DataFrame, keys: list[str], month: str = "month_start", value: str = "median_price", least_months: int = LEAST_MONTHS, least_seasonal: int = LEAST_SEASONAL, season: int = SEASON) -> DataFrame:
    """One row per month of every series, fitted on the months up to it: keys,
    month, value, n_months, seasonal, intercept, phi, seasonal_phi, reason and
    `last`, the values that a forecast needs.

    The model of z is z[t] = intercept + phi z[t-1] + seasonal_phi z[t-season],
    z being the difference of the differences a season apart from least_seasonal
    months on, else z[t] = intercept + phi z[t-1] of the plain differences.
    reason says why there is no model: too few months, or a series whose lags do
    not vary. The series has a row for every month and no missing value (see
    calendar_series); a cohort's months are one window, bounded by the
    calendar."""
    w = Window.partitionBy(*keys).orderBy(month)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    y = F.col(value).cast("double")
    d = series.withColumns({"__n": F.row_number().over(w), "__d": y - F.lag(y, 1).over(w)})
    d = d.withColumn("__z", F.col("__d") - F.lag("__d", season).over(w))
    d = d.withColumns({"__d1": F.lag("__d", 1).over(w), "__z1": F.lag("__z", 1).over(w), "__zs": F.lag("__z", season).over(w)})

    def sums(c: dict[str, Column], known: Column) -> dict[str, Column]:
        return {k: F.sum(F.when(known, v)).over(upto) for k, v in c.items()}

    z, z1, zs, e, e1 = (F.col(c) for c in ("__z", "__z1", "__zs", "__d", "__d1"))
    full = zs.isNotNull() & z1.isNotNull() & z.isNotNull()
    plain = e.isNotNull() & e1.isNotNull()
    one = F.lit(1.0)
    d = d.withColumns({f"__s_{k}": v for k, v in sums({"n": one, "x": z1, "u": zs, "y": z, "xx": z1 * z1, "xu": z1 * zs, "uu": zs * zs, "xy": z1 * z, "uy": zs * z}, full).items()})
    d = d.withColumns({f"__p_{k}": v for k, v in sums({"n": one, "x": e1, "y": e, "xx": e1 * e1, "xy": e1 * e}, plain).items()})
    d = d.withColumn("last", F.collect_list(y).over(w.rowsBetween(-2 * season, 0)))
    s = lambda k: F.col(f"__s_{k}")
    p = lambda k: F.col(f"__p_{k}")
    intercept, phi, seasonal_phi = _solve(*[s(k) for k in ("n", "x", "u", "y", "xx", "xu", "uu", "xy", "uy")])
    var = p("xx") - p("x") * p("x") / p("n")
    slope = F.when((p("n") >= 3) & (var > 1e-10 * p("xx")), (p("xy") - p("x") * p("y") / p("n")) / var)
    seasonal = F.col("__n") >= least_seasonal
    out = d.withColumns({"seasonal": seasonal, "phi": F.when(seasonal, phi).otherwise(slope), "seasonal_phi": F.when(seasonal, seasonal_phi), "intercept": F.when(seasonal, intercept).otherwise((p("y") - slope * p("x")) / p("n"))})
    reason = F.when(F.col("__n") < least_months, "too few months").when(F.col("phi").isNull(), "lags do not vary")
    blank = lambda c: F.when(reason.isNull(), F.col(c)).alias(c)
    rest = [c for c in series.columns if c not in (*keys, month, value)]
    return out.select(*keys, month, value, *rest, F.col("__n").cast("long").alias("n_months"), "seasonal", blank("intercept"), blank("phi"), blank("seasonal_phi"), reason.alias("reason"), "last")


def forecast_ar(fitted: DataFrame, periods: int, season: int = SEASON) -> Column:
    """Array of the next values (not below 0) of rows of seasonal_ar(); null
    where there is no model."""
    back = lambda a, k: F.element_at(a, F.lit(-1 - k))
    step = lambda a, k: back(a, k) - back(a, k + 1)
    twice = lambda a, k: step(a, k) - step(a, k + season)

    def further(a: Column, _: Column) -> Column:
        # z a season before the next one is twice(a, season - 1)
        z = F.col("intercept") + F.col("phi") * twice(a, 0) + F.col("seasonal_phi") * twice(a, season - 1)
        plain = F.col("intercept") + F.col("phi") * step(a, 0)
        return F.concat(a, F.array(back(a, 0) + F.when(F.col("seasonal"), z + step(a, season - 1)).otherwise(plain)))

    grown = F.aggregate(F.sequence(F.lit(1), F.lit(periods)), F.col("last"), further)
    return F.when(F.col("reason").isNull(), F.transform(F.slice(grown, F.size("last") + 1, periods), lambda v: F.greatest(v, F.lit(0.0))))


def seasonal_backtest(series: DataFrame, keys: list[str], horizon: int, least_months: int = LEAST_MONTHS, month: str = "month_start", value: str = "median_price") -> DataFrame:
    """Backtest rows of every observed origin whose month `horizon` later is
    observed too; origins without a model give none."""
    w = Window.partitionBy(*keys).orderBy(month)
    fitted = seasonal_ar(series, keys, month, value, least_months)
    later = fitted.withColumns({"__month": F.lead(month, horizon).over(w), "__actual": F.lead(value, horizon).over(w), "__seen": ~F.col("interpolated") & F.lead(~F.col("interpolated"), horizon).over(w)})
    rows = later.where(F.col("__seen") & F.col("reason").isNull()).withColumn("__next", forecast_ar(later, horizon)[horizon - 1])
    return rows.select(*keys, F.col(month).alias("origin_month"), F.col("__month").alias("forecast_month"), F.col(value).alias("naive"), F.col("__actual").alias("actual"), F.col("__next").alias("predicted"), F.lit("seasonal_ar").alias("model_family"))
