"""Forecast and model metrics, distributions and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def _spread(c: Column) -> Column:
    """Sum of squared deviations from the mean; doubles, as squares of whole
    numbers' sums outgrow a long."""
    return F.sum(c.cast("double") * c) - F.sum(c).cast("double") * F.sum(c) / F.count("*")


def forecast_metrics(actual: str = "actual", predicted: str = "predicted", naive: str = "naive") -> list[Column]:
    """MAE, RMSE, bias, R2, WAPE, the naive forecast's MAE and WAPE, and skill;
    null where a denominator is 0."""
    e, n = F.col(predicted) - F.col(actual), F.col(naive) - F.col(actual)
    count = F.count("*")
    mae, naive_mae = F.avg(F.abs(e)), F.avg(F.abs(n))
    spread = _spread(F.col(actual))
    return [
        count.alias("n_rows"),
        mae.alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
        F.when(count >= 2, 1 - _ratio(F.sum(e * e), spread)).alias("r2"),
        _ratio(F.sum(F.abs(e)), F.sum(F.abs(F.col(actual)))).alias("wape"),
        naive_mae.alias("naive_mae"),
        _ratio(F.sum(F.abs(n)), F.sum(F.abs(F.col(actual)))).alias("naive_wape"),
        (1 - _ratio(mae, naive_mae)).alias("skill"),
    ]


def kpi_scopes(rows: DataFrame, model: list[str], cohort: list[str], **names: str) -> DataFrame:
    """Metrics by model and by model and cohort, in one pass over the rows with
    all inputs: grouping sets, the scope told by the grouping id."""
    inputs = [names.get(k, k) for k in ("actual", "predicted", "naive")]
    full = rows.dropna(subset=inputs)
    out = full.groupingSets([[F.col(c) for c in model], [F.col(c) for c in [*model, *cohort]]], *[F.col(c) for c in [*model, *cohort]]).agg(F.grouping_id().alias("__g"), *forecast_metrics(*inputs))
    return out.withColumn("scope", F.when(F.col("__g") == 0, "cohort_horizon").otherwise("model_horizon")).drop("__g")


def regression_metrics(actual: str, predicted: str) -> list[Column]:
    """MAE, RMSE, RMSLE (negatives as 0), MAPE, R2."""
    a, p = F.col(actual), F.col(predicted)
    e = p - a
    log = F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(F.greatest(a, F.lit(0.0)))
    return [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg(log * log)).alias("rmsle"), F.avg(F.abs(_ratio(e, a.cast("double")))).alias("mape"), (1 - _ratio(F.sum(e * e), _spread(a))).alias("r2")]


def segment_metrics(rows: DataFrame, segments: list[str], actual: str, predicted: str) -> DataFrame:
    """(segment, value, n_rows, mae) for each of the segment columns, in one pass."""
    sets = [[F.col(s)] for s in segments]
    g = rows.groupingSets(sets, *[F.col(s) for s in segments]).agg(F.grouping_id().alias("__g"), F.count("*").alias("n_rows"), F.avg(F.abs(F.col(predicted) - F.col(actual))).alias("mae"))
    full = (1 << len(segments)) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, s in enumerate(segments):
        here = F.col("__g") == full - (1 << (len(segments) - 1 - i))
        name, value = F.when(here, s).otherwise(name), F.when(here, F.col(s).cast("string")).otherwise(value)
    return g.select(name.alias("segment"), value.alias("value"), "n_rows", "mae")


def distribution(df: DataFrame, column: str, label: str = "NULL") -> DataFrame:
    """(value, n, share) with null under a label."""
    total = df.agg(F.count("*").alias("__n"))
    g = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(label)).alias("value")).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("__n")).alias("share"))


def percentile_rank(df: DataFrame, column: str, value) -> DataFrame:
    """Share of the non-null values that are at most `value`."""
    return df.where(F.col(column).isNotNull()).agg(F.avg((F.col(column) <= value).cast("double")).alias("percentile_rank"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin from 1, n) of equal width from the least to the largest value."""
    ends = df.agg(F.min(column).cast("double").alias("__lo"), F.max(column).cast("double").alias("__hi"))
    at = F.least(F.floor((F.col(column) - F.col("__lo")) / F.nullif((F.col("__hi") - F.col("__lo")) / bins, F.lit(0.0))) + 1, F.lit(bins))
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, by: str, column: str) -> DataFrame:
    """count, mean, std, min, five percentiles and max by group."""
    q = F.percentile(column, F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))
    g = df.groupBy(by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"), q.alias("__q"))
    return g.select("*", *[F.col("__q")[i].alias(f"p{p}") for i, p in enumerate((10, 25, 50, 75, 90))]).drop("__q")


def segment_table(df: DataFrame, row: str, column: str, values: list[str], actual: str, predicted: str) -> DataFrame:
    """Wide table of mae per row and segment value, and the ratio of the last to the first."""
    p = df.groupBy(row).pivot(column, values).agg(F.avg(F.abs(F.col(predicted) - F.col(actual))))
    return p.withColumn("ratio", _ratio(F.col(values[-1]), F.col(values[0])))


def long_metrics(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(ids, metrics, "metric", "value")


def rollup_counts(df: DataFrame, levels: list[str], *sums: str) -> DataFrame:
    """Sums by all prefixes of the levels down to the whole."""
    return df.rollup(*levels).agg(*[F.sum(s).alias(s) for s in sums], F.count("*").alias("n"))


def segments_from_report(df: DataFrame, metrics: str) -> DataFrame:
    """Rows (model, segment, value, mae) of a map of maps, as reports hold them."""
    return df.select("model", F.explode(metrics).alias("segment", "__m")).select("model", "segment", F.explode("__m").alias("value", "mae"))
