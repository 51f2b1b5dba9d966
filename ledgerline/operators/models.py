"""Price models on MLlib: preprocessing, routed experts, search, champions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, TargetEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.encoders import feature_names, price_stages
from ledgerline.operators.kpi import regression_metrics
from ledgerline.operators.search import GRIDS, grouped_search

HIGH_VALUE, CUTOFF, BLEND, LEAST_HIGH = 150_000, 0.35, 0.85, 50
#: Different vectors that a task of a level of trees goes over, at least.
TASK_VECTORS = 10_000


def preprocessor(numeric: list[str], low: list[str] = (), high: list[str] = (), label: str = "label", scaled: bool = False) -> list:
    """Stages: medians for missing numbers, one-hot for few values, smoothed
    target encoding for many, one vector; unknown values are kept apart."""
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}__i" for c in numeric])]
    parts = [f"{c}__i" for c in numeric]
    for c in [*low, *high]:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__x", handleInvalid="keep"))
    if low:
        stages.append(OneHotEncoder(inputCols=[f"{c}__x" for c in low], outputCols=[f"{c}__o" for c in low], handleInvalid="keep"))
        parts += [f"{c}__o" for c in low]
    if high:
        stages.append(TargetEncoder(inputCols=[f"{c}__x" for c in high], outputCols=[f"{c}__t" for c in high], labelCol=label, targetType="continuous", smoothing=10.0, handleInvalid="keep"))
        parts += [f"{c}__t" for c in high]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features__raw" if scaled else "features", handleInvalid="keep"))
    if scaled:
        stages.append(StandardScaler(inputCol="features__raw", outputCol="features"))
    return stages


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds prediction: back from the logarithm, not below 0."""
    return model.transform(df).withColumn("prediction", F.greatest(F.expm1("log_prediction"), F.lit(0.0)))


@dataclass
class RoutedModel:
    """A classifier sends rows to an expert for high or for other prices; with
    too few of either there is only the global regressor."""

    overall: PipelineModel
    gate: PipelineModel | None = None
    low: PipelineModel | None = None
    high: PipelineModel | None = None
    cutoff: float = CUTOFF

    def predict(self, df: DataFrame) -> DataFrame:
        out = predict(self.overall, df).select(*df.columns, F.col("prediction").alias("__all"))
        if self.gate is None:
            return out.withColumnRenamed("__all", "prediction")
        out = self.gate.transform(out).select(*df.columns, "__all", vector_to_array("probability")[1].alias("__p"))
        out = predict(self.low, out).select(*df.columns, "__all", "__p", F.col("prediction").alias("__low"))
        out = predict(self.high, out).select(*df.columns, "__all", "__p", "__low", F.col("prediction").alias("__high"))
        expert = F.when(F.col("__p") >= self.cutoff, F.col("__high")).otherwise(F.col("__low"))
        return out.select(*df.columns, F.greatest(BLEND * expert + (1 - BLEND) * F.col("__all"), F.lit(0.0)).alias("prediction"))


def gathered(rows: DataFrame) -> DataFrame:
    """The rows in at most two partitions a core: every level of every tree sends
    the driver a result for each partition, some 2.5 KB over hundreds of levels."""
    return rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)


class CountedTrees(Estimator):
    """Fits MLlib's boosted trees on one weighted row for each different vector
    instead of on all rows. No split parts rows of one vector, so a regressor of
    squared errors needs only their count and the mean of their labels, and a
    classifier their count by class: the sums, gains and leaves are the same.
    Bounds of the bins are quantiles of all rows where there are at most 10,000
    different vectors; MLlib draws them from about as many rows."""

    def __init__(self, trees: GBTRegressor | GBTClassifier) -> None:
        super().__init__()
        self.trees = trees

    def _fit(self, dataset: DataFrame) -> Model:
        x, y = self.trees.getFeaturesCol(), self.trees.getLabelCol()
        if isinstance(self.trees, GBTClassifier):
            counted = dataset.groupBy(x, y).agg(F.count("*").cast("double").alias("__rows"))
        else:
            counted = dataset.groupBy(x).agg(F.avg(y).alias(y), F.count(y).cast("double").alias("__rows"))
        counted = counted.persist()
        try:
            few = gathered(counted).coalesce(1 + counted.count() // TASK_VECTORS)  # most levels are over in less than a task takes to start
            return self.trees.copy({self.trees.weightCol: "__rows"}).fit(few)
        finally:
            counted.unpersist()


def fit_routed(train: DataFrame, stages: list, label: str, threshold: float = HIGH_VALUE, least_high: int = LEAST_HIGH) -> RoutedModel:
    """The rows are read once; a few more passes over them count vectors, and
    trees are grown over these counts."""
    kept = gathered(train).persist()
    data = kept.withColumns({"label": F.col(label).cast("double"), "log_label": F.log1p(F.greatest(F.col(label).cast("double"), F.lit(0.0))), "is_high": (F.col(label) > threshold).cast("double")})
    try:
        regressor = GBTRegressor(featuresCol="features", labelCol="log_label", predictionCol="log_prediction", seed=42, maxIter=20)
        fit = lambda rows: Pipeline(stages=[*stages, CountedTrees(regressor)]).fit(rows)
        counts = data.agg(F.count_if(F.col("is_high") == 1.0), F.count_if(F.col("is_high") == 0.0)).first()
        if counts[0] < least_high or counts[1] == 0:
            return RoutedModel(fit(data))
        gate = Pipeline(stages=[*stages, CountedTrees(GBTClassifier(labelCol="is_high", featuresCol="features", maxIter=10, seed=42))]).fit(data)
        return RoutedModel(fit(data), gate, fit(data.where("is_high = 0")), fit(data.where("is_high = 1")))
    finally:
        kept.unpersist()


def champion(reports: dict[str, float]) -> str:
    """The family with the least error, by name on ties."""
    return min(reports, key=lambda k: (reports[k], k))


def feature_weights(model: PipelineModel, n: int = 20) -> list[tuple[str, float, float]]:
    """(name, weight or importance, its share of all absolute ones) of the n
    inputs of greatest absolute value, by name on ties; of a fitted model as of
    one that was saved and loaded."""
    names, values = feature_names(model), model.stages[-1].importance()
    values = values + [0.0] * (len(names) - len(values))
    whole = sum(map(abs, values)) or 1.0
    ranked = sorted(((name, float(v), abs(float(v)) / whole) for name, v in zip(names, values, strict=True)), key=lambda r: (-abs(r[1]), r[0]))
    return ranked[:n]


def train_price_models(df: DataFrame, numeric: list[str], low: list[str], high: list[str], label: str, key: str, families: tuple[str, ...] = tuple(GRIDS)) -> tuple[str, PipelineModel, DataFrame]:
    """Search each family, measure it on rows with part = 'test', and return the
    champion, its model and its scored test rows."""
    train, test = df.where("part = 'train'"), df.where("part = 'test'")
    found = grouped_search(train, price_stages(numeric, low, high), label, key, families)
    errors = {f: predict(r.model, test).agg(*regression_metrics(label, "prediction")).first()["mae"] for f, r in found.items()}
    best = champion({f: e if e is not None else float("inf") for f, e in errors.items()})
    return best, found[best].model, predict(found[best].model, test).select(*test.columns, "prediction")


def score_filtered(model: PipelineModel, rows: DataFrame, where: Column | str = "true", order: str = "vin", most: int = 100) -> DataFrame:
    """Predictions of at most so many rows that pass a filter, the first by order."""
    asked = rows.where(where).orderBy(order, *[c for c in rows.columns if c != order and not dict(rows.dtypes)[c].startswith("map")]).limit(most)
    return predict(model, asked).select(*rows.columns, "prediction")
