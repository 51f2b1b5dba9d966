"""Forecasts and backtests of cohort panels."""

from __future__ import annotations

import datetime
import functools
import importlib.util
import itertools
import random
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.history import latest
from ledgerline.operators.models import preprocessor
from ledgerline.operators.moments import matrix, product_sums, ridge, running_sums
from ledgerline.operators.seasonal import seasonal_backtest
from ledgerline.operators.trees import Ensemble, Windows, boost_windows, ensemble_of, value_bins, vector
from ledgerline.session import cut_lineage
from ledgerline.sources import samples

#: Families of other libraries, by module; they are reported as skipped.
OPTIONAL_FAMILIES = {"sarimax": "statsmodels", "prophet": "prophet", "timesfm": "timesfm"}


def parse_families(value: str, known: tuple[str, ...] = ("global", "drift", "seasonal_naive", "seasonal_ar", *OPTIONAL_FAMILIES)) -> list[str]:
    """Comma-separated families, lower case, each once, in order; unknown ones raise."""
    names = list(dict.fromkeys(x.strip().lower() for x in value.split(",") if x.strip()))
    if bad := [n for n in names if n not in known]:
        raise ValueError(f"unknown model families {bad}")
    return names


#: Values that the temporal search draws from, and how many sets it draws.
CHANGE_GRID = {"maxIter": (10, 20, 30), "stepSize": (0.05, 0.1, 0.2), "maxDepth": (3, 5), "minInstancesPerNode": (1, 5, 20), "subsamplingRate": (0.75, 0.85, 1.0)}
CANDIDATES = 8


def fit_change_model(train: DataFrame, numeric: list[str], target: str, max_iter: int = 10, params: dict | None = None, least_rows: int = 2) -> PipelineModel:
    """A tree ensemble for the change of price over the horizon; with fewer rows
    than least_rows, or one value of the target, its mean (0 without rows)."""
    data = train.dropna(subset=[target]).withColumn("label", F.col(target).cast("double"))
    seen = data.agg(F.count("*").alias("rows"), F.min("label").alias("least"), F.max("label").alias("most"), F.avg("label").alias("mean")).first()
    if seen["rows"] < least_rows or seen["least"] == seen["most"]:
        return PipelineModel([SQLTransformer(statement=f"SELECT *, CAST('{seen['mean'] or 0.0!r}' AS DOUBLE) AS change FROM __THIS__")])
    regressor = GBTRegressor(featuresCol="features", labelCol="label", predictionCol="change", seed=42).setParams(**{"maxIter": max_iter, "maxDepth": 3, **(params or {})})
    return Pipeline(stages=[*preprocessor(numeric), regressor]).fit(data)


def change_candidates(n: int = CANDIDATES, grid: dict[str, tuple] = CHANGE_GRID, seed: int = 42) -> list[dict]:
    """n different sets of parameters, drawn from the grid (all, if it has fewer)."""
    sets = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    return random.Random(seed).sample(sets, min(n, len(sets)))


def tune_change_model(train: DataFrame, numeric: list[str], horizon: int, strata: list[str], candidates: list[dict] | None = None, most_rows: int = 200_000) -> tuple[dict, dict]:
    """(best parameters, report): the candidates are fitted on the earlier part
    of the training rows and measured by mean absolute error on the later part,
    targets of the first lying before the second begins. The search reads a
    stratified sample of at most most_rows rows; the final fit reads all. With
    no leakage-safe split the parameters are empty and the report says why."""
    target, month = f"target_change_{horizon}m", f"target_month_{horizon}m"
    sets = change_candidates() if candidates is None else candidates
    rows = train.where(F.col(target).isNotNull()).select(*dict.fromkeys([*strata, *numeric, "month_start", month, target]))
    rows = rows.withColumn("__stratum", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")) for c in strata], F.quarter("month_start").cast("string")))
    rows = rows.withColumn("__row", F.concat_ws("|", "__stratum", F.col("month_start").cast("string")))
    if rows.count() > most_rows:
        rows = samples.stratified(rows, "__stratum", "__row", most_rows)
    rows = cut_lineage(rows)
    cutoff = samples.choose_cutoff(rows, "month_start", month, target)
    if cutoff is None:
        return {}, {"enabled": False, "reason": "no split in time with two rows on both sides"}
    early, late = (part.persist() for part in samples.split_for_horizon(rows, cutoff, "month_start", month))
    try:
        errors = [fit_change_model(early, numeric, target, params=p).transform(late).agg(F.avg(F.abs(F.col("change") - F.col(target)))).first()[0] for p in sets]
        best = min(range(len(sets)), key=lambda i: (errors[i], i))
        return sets[best], {"enabled": True, "candidates": len(sets), "cutoff": cutoff, "train_rows": early.count(), "validation_rows": late.count(), "errors": errors, "best": sets[best]}
    finally:
        early.unpersist()
        late.unpersist()


def direct_forecast(model: PipelineModel, panel: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """The forecast of each cohort's last month, so many months ahead."""
    panel = panel.withColumn("__key", F.struct(*keys))
    last = latest(panel, "__key", F.desc("month_start")).drop("__key")
    scored = model.transform(last)
    return scored.select(*keys, "month_start", F.col("median_price").alias("observed_price"), F.add_months("month_start", horizon).alias("forecast_month"), F.greatest(F.col("median_price") * (1 + F.col("change")), F.lit(0.0)).alias("predicted_price"), F.lit("direct").alias("forecast_method"))


#: Columns that a predicted price replaces.
_FED_BACK = ("median_price", "avg_price", "p25_price", "p75_price", "price_lag_1", "rolling_median_3")


def recursive_forecast(model: PipelineModel | Ensemble, panel: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """Month by month: each predicted price is fed back as price, quartiles, lag
    and rolling median, and into the index and change since the cohort's first
    price; other features stay. The fitted trees are arrays, so that all steps of
    a cohort are one fold inside one Arrow pass over the last rows."""
    trees = model if isinstance(model, Ensemble) else ensemble_of(model)
    last = latest(panel.withColumn("__key", F.struct(*keys)), "__key", F.desc("month_start"))
    used = list(dict.fromkeys([*trees.inputs, "median_price", *(c for c in ("price_index",) if c in panel.columns)]))
    state = last.select(F.struct(*keys).alias("__key"), F.col("month_start").cast("date").alias("__month"), *[F.col(c).cast("double").alias(c) for c in used])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = {c: batch.column(i + 2).to_numpy(zero_copy_only=False).astype(float) for i, c in enumerate(used)}
            days = batch.column(1).to_numpy(zero_copy_only=False).astype("datetime64[M]")
            observed, index = value["median_price"], value.get("price_index")
            for step in range(1, steps + 1):
                x = np.column_stack([value[c] for c in trees.inputs]) if trees.inputs else np.zeros((batch.num_rows, 0))
                price = value["median_price"] * (1 + trees.predict(x))
                price = np.where(price < 0, 0.0, price)
                if index is not None:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        base = value["median_price"] / np.where(index == 0, np.nan, index)
                        index = price / np.where(base == 0, np.nan, base)
                months = (days + step).astype("datetime64[D]")
                number = months.astype("datetime64[M]").astype(int) % 12
                moved = {c: price for c in _FED_BACK} | {"month": number + 1.0, "quarter": number // 3 + 1.0}
                if index is not None:
                    moved |= {"price_index": index, "cumulative_change": index - 1}
                moved |= {c: value[c] + 1 for c in ("cohort_month_number", "cohort_age_months") if c in value}
                value |= {c: v for c, v in moved.items() if c in value}
                with np.errstate(divide="ignore", invalid="ignore"):
                    change = price / np.where(observed == 0, np.nan, observed) - 1
                steps_taken = pa.array(np.full(batch.num_rows, step, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), steps_taken, pa.array(months), pa.array(price, from_pandas=True), pa.array(change, from_pandas=True)], ["__key", "step", "forecast_month", "predicted_price", "change_from_observed"])

    kind = f"__key {dict(state.dtypes)['__key']}, step int, forecast_month date, predicted_price double, change_from_observed double"
    return state.mapInArrow(run, kind).select(*[F.col("__key")[k].alias(k) for k in keys], "step", "forecast_month", "predicted_price", "change_from_observed")


BACKTEST_FAMILIES = ("global", "global_linear")


def global_backtest(panel: DataFrame, keys: list[str], numeric: list[str], horizon: int, origins: list, least_months: int = 6, families: tuple[str, ...] = BACKTEST_FAMILIES, rounds: int = 10, depth: int = 3, rate: float = 0.3, penalty: float = 1.0) -> DataFrame:
    """Expanding rolling origins: trained on rows whose target month is at or
    before the origin, tested at the origin on cohorts with enough history.

    No origin is fitted on its own: boosted trees ("global") grow level by level
    for all origins in one grouped pass each, linear models ("global_linear")
    are solved from running sums of products. Origins with fewer than two
    training rows give no rows; neither do linear test rows with a missing
    input."""
    target, month, price = f"target_change_{horizon}m", f"target_month_{horizon}m", f"target_price_{horizon}m"
    seen = F.row_number().over(Window.partitionBy(*keys).orderBy("month_start"))
    columns = list(dict.fromkeys([*keys, "month_start", "median_price", *numeric, target, month, price]))
    rows = cut_lineage(panel.select(*columns).withColumn("__seen", seen).where(F.col(target).isNotNull()).withColumns({"__at": F.unix_date(F.col("month_start").cast("date")).cast("long"), "__ends": F.unix_date(F.col(month).cast("date")).cast("long")}))
    ats = [(o - datetime.date(1970, 1, 1)).days for o in origins]
    test = rows.where(F.col("__at").isin(ats) & (F.col("__seen") >= least_months)) if ats else rows.limit(0)
    parts = []
    if "global" in families:
        order = sorted(range(len(ats)), key=ats.__getitem__)
        member = np.zeros((len(ats), len(ats)), bool)
        for place, k in enumerate(order):
            member[order[: place + 1], k] = True  # a group is the first origin at or after the target's month
        group = F.array_position(F.array(*[F.lit(a).cast("long") for a in ats]), _first_origin(ats)) - 1
        model = boost_windows(rows, vector(numeric), len(numeric), F.col(target), F.when(group >= 0, group), member, rounds, depth, rate) if ats else Windows(depth, np.zeros(0), [], [], [])
        parts.append(_window_predictions(test, model, ats, numeric).withColumn("model_family", F.lit("global")))
    if "global_linear" in families:
        parts.append(linear_predictions(test, expanding_ridge(rows, numeric, target, ats, penalty), numeric).withColumn("model_family", F.lit("global_linear")))
    out = functools.reduce(DataFrame.unionByName, parts)
    predicted = F.greatest(F.col("median_price") * (1 + F.col("change")), F.lit(0.0))
    return out.where("change is not null").select(*keys, F.col("month_start").cast("date").alias("origin_month"), F.col(month).alias("forecast_month"), F.col("median_price").alias("naive"), F.col(price).alias("actual"), predicted.alias("predicted"), "model_family")


def _window_predictions(test: DataFrame, model: Windows, ats: list[int], numeric: list[str]) -> DataFrame:
    """test with the change that its own origin's trees predict."""
    place = {at: k for k, at in enumerate(ats)}
    names = test.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([place[v] for v in batch.column(names.index("__at")).to_pylist()], np.int64).reshape(-1, 1)
            x = np.column_stack([batch.column(names.index(c)).to_numpy(zero_copy_only=False).astype(float) for c in numeric])
            change = model.predict(value_bins(x), at)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(change, from_pandas=True)], [*names, "change"])

    doubles = test.select(*[F.col(c).cast("double").alias(c) if c in numeric else c for c in names])
    return doubles.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in doubles.schema) + ", change double")


def _first_origin(ats: list[int], ends: str = "__ends") -> Column:
    """The first origin at or after the month of a row's target; null without."""
    return F.array_min(F.filter(F.array(*[F.lit(a).cast("long") for a in ats]), lambda a: a >= F.col(ends)))


def expanding_sums(rows: DataFrame, numeric: list[str], target: str, ats: list[int], ends: str = "__ends") -> DataFrame:
    """(origin, i, j, value): sums of products of 1, the inputs and the target
    over the complete rows that end at or before each origin, by one pass over
    the rows and running sums over the months."""
    columns = [*numeric, target]
    return running_sums(product_sums(rows, _first_origin(ats, ends), vector(columns), len(columns))).withColumnRenamed("g", "origin")


def expanding_ridge(rows: DataFrame, numeric: list[str], target: str, ats: list[int], penalty: float) -> DataFrame:
    """(origin, weights): intercept and weights of every origin. An origin before
    which nothing new ended has the weights of the one before it."""
    if not ats:
        return rows.sparkSession.createDataFrame([], "origin long, weights array<double>")
    size = len(numeric) + 2
    lists = expanding_sums(rows, numeric, target, ats).groupBy("origin").agg(F.collect_list(F.struct("i", "j", "value")).alias("cells"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matrix(((c["i"], c["j"], c["value"]) for c in cells), size) for cells in batch.column(1).to_pylist()]
            weights = [ridge(m, penalty).tolist() if m[0, 0] >= 2 else None for m in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights, pa.list_(pa.float64()))], ["origin", "weights"])

    solved = lists.mapInArrow(run, "origin long, weights array<double>")
    every = rows.sparkSession.createDataFrame([(a,) for a in sorted(ats)], "origin long").join(solved, "origin", "left")
    upto = Window.orderBy("origin").rowsBetween(Window.unboundedPreceding, 0)  # one row an origin
    return every.select("origin", F.last("weights", True).over(upto).alias("weights"))


def linear_predictions(test: DataFrame, weights: DataFrame, numeric: list[str]) -> DataFrame:
    """test with the change that its origin's weights predict; the weights are
    one row an origin."""
    x = functools.reduce(lambda a, b: a + b, [F.col("weights")[i + 1] * F.col(c) for i, c in enumerate(numeric)], F.col("weights")[0])
    return test.join(F.broadcast(weights.withColumnRenamed("origin", "__at")), "__at").withColumn("change", x).drop("weights")


def drift(values: np.ndarray, n: int) -> np.ndarray:
    """Last value, moved on by the mean step."""
    step = (values[-1] - values[0]) / (len(values) - 1) if len(values) > 1 else 0.0
    return np.maximum(values[-1] + step * np.arange(1, n + 1), 0.0)


def seasonal_naive(values: np.ndarray, n: int, season: int = 12) -> np.ndarray:
    """The value a season before; the last value for shorter series."""
    if len(values) < season:
        return np.repeat(values[-1], n)
    return values[-season:][np.arange(n) % season]


LOCAL: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {"drift": drift, "seasonal_naive": seasonal_naive}


def local_backtest(series: DataFrame, keys: list[str], family: str, horizon: int, least_months: int = 6, value: str = "median_price") -> DataFrame:
    """Per cohort (a bounded monthly series): at each observed origin with
    enough history, forecast from the months up to it and compare."""
    model = LOCAL[family]
    fields = ", ".join(f"`{k}` {dict(series.dtypes)[k]}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month_start")
        v, months, seen = pdf[value].to_numpy(float), pdf["month_start"].tolist(), (~pdf["interpolated"]).to_numpy()
        rows = []
        for i in range(least_months - 1, len(v) - horizon):
            if seen[i] and seen[i + horizon]:
                rows.append((*[pdf[k].iloc[0] for k in keys], months[i], months[i + horizon], v[i], v[i + horizon], float(model(v[: i + 1], horizon)[-1]), family))
        return pd.DataFrame(rows, columns=[*keys, "origin_month", "forecast_month", "naive", "actual", "predicted", "model_family"])

    return series.groupBy(*keys).applyInPandas(run, f"{fields}, origin_month date, forecast_month date, naive double, actual double, predicted double, model_family string")


def run_families(series: DataFrame, keys: list[str], families: list[str], horizon: int) -> tuple[DataFrame | None, dict[str, str]]:
    """Backtest rows of the local families that can run, and why others can't."""
    rows, skipped = None, {}
    for f in families:
        if f in LOCAL or f == "seasonal_ar":
            part = local_backtest(series, keys, f, horizon) if f in LOCAL else seasonal_backtest(series, keys, horizon)
            rows = part if rows is None else rows.unionByName(part)
        elif f in OPTIONAL_FAMILIES:
            skipped[f] = "its library is not installed" if importlib.util.find_spec(OPTIONAL_FAMILIES[f]) is None else "no adapter is written for it"
    return rows, skipped

