"""Stages of price models that MLlib lacks. All are saved and loaded with the
pipelines they are part of."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import Imputer, ImputerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.trees import Windows, value_bins
from ledgerline.session import cut_lineage

UNKNOWN = "UNKNOWN"
#: Values up to which a table of means is broadcast, so that the rows stay where they are.
MOST_BROADCAST = 100_000


class _Stage(Params):
    """Input and output column, and setting of params by keyword."""

    inputCol = Param(Params._dummy(), "inputCol", "input column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "output column", TypeConverters.toString)

    def __init__(self, **params) -> None:
        super().__init__()
        self._set(**params)

    def _value(self) -> Column:
        return F.coalesce(F.col(self.getOrDefault("inputCol")).cast("string"), F.lit(UNKNOWN))


class FrequentOneHot(_Stage, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """One slot for each value of at least leastRows rows, for the most frequent
    ones if there are more than mostSlots (the first by name of equal ones), and
    one last slot for all infrequent values, if there are any."""

    leastRows = Param(Params._dummy(), "leastRows", "rows of a value with a slot", TypeConverters.toInt)
    mostSlots = Param(Params._dummy(), "mostSlots", "slots, the infrequent one included", TypeConverters.toInt)

    def __init__(self, **params) -> None:
        super().__init__(**({"leastRows": 10, "mostSlots": 25} | params))

    def _fit(self, dataset: DataFrame) -> FrequentOneHotModel:
        least, most = self.getOrDefault("leastRows"), self.getOrDefault("mostSlots")
        counts = dataset.groupBy(self._value().alias("value")).agg(F.count("*").alias("n"))
        top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "value").limit(most + 1).collect()
        kinds = counts.count()
        rare = kinds > min(len(top), most)
        values = [r["value"] for r in top[: most - 1 if rare else most]]
        rare = kinds > len(values)
        return FrequentOneHotModel(inputCol=self.getOrDefault("inputCol"), outputCol=self.getOrDefault("outputCol"), values=values, infrequent=rare)


class FrequentOneHotModel(_Stage, Model, DefaultParamsReadable, DefaultParamsWritable):
    """A null is the value UNKNOWN; a value not seen goes to the infrequent slot,
    or to none where there is no such slot."""

    values = Param(Params._dummy(), "values", "values with a slot", TypeConverters.toListString)
    infrequent = Param(Params._dummy(), "infrequent", "whether there is an infrequent slot", TypeConverters.toBoolean)

    def slots(self) -> list[str]:
        name = self.getOrDefault("inputCol")
        return [f"{name}={v}" for v in self.getOrDefault("values")] + [f"{name}=(infrequent)"] * self.getOrDefault("infrequent")

    def slot_of(self) -> Column:
        """1 and up; 0 for none."""
        values = self.getOrDefault("values")
        at = F.array_position(F.array(*map(F.lit, values)) if values else F.array().cast("array<string>"), self._value())
        return F.when(at == 0, len(values) + 1 if self.getOrDefault("infrequent") else 0).otherwise(at).cast("int")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = self.slots()
        at = self.slot_of()
        entries = F.array(*[(at == i + 1).cast("double") for i in range(len(names))]) if names else F.array().cast("array<double>")
        about = {"ml_attr": {"attrs": {"numeric": [{"idx": i, "name": x} for i, x in enumerate(names)]}, "num_attrs": len(names)}}
        return dataset.withColumn(self.getOrDefault("outputCol"), array_to_vector(entries).alias(self.getOrDefault("outputCol"), metadata=about))


class SigmoidTarget(_Stage, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Mean of the label by value, blended with the mean of all rows by a sigmoid
    of the value's rows: weight 1 / (1 + exp((leaf - rows) / smoothing))."""

    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)
    leaf = Param(Params._dummy(), "leaf", "rows at which both means weigh the same", TypeConverters.toFloat)
    smoothing = Param(Params._dummy(), "smoothing", "width of the sigmoid", TypeConverters.toFloat)

    def __init__(self, **params) -> None:
        super().__init__(**({"leaf": 20.0, "smoothing": 10.0} | params))

    def _fit(self, dataset: DataFrame) -> SigmoidTargetModel:
        label = F.col(self.getOrDefault("labelCol")).cast("double")
        prior = dataset.agg(F.avg(label)).first()[0]
        weight = 1 / (1 + F.exp((self.getOrDefault("leaf") - F.col("n")) / self.getOrDefault("smoothing")))
        stats = dataset.where(label.isNotNull()).groupBy(self._value().alias("value")).agg(F.count("*").alias("n"), F.avg(label).alias("mean"))
        table = stats.select("value", (F.lit(prior).cast("double") * (1 - weight) + F.col("mean") * weight).alias("encoded"))
        model = SigmoidTargetModel(inputCol=self.getOrDefault("inputCol"), outputCol=self.getOrDefault("outputCol"), prior=prior or 0.0)
        model.table = cut_lineage(table)
        return model


class SigmoidTargetModel(_Stage, Model, MLWritable, MLReadable):
    """Any number of values: they are a table (value, encoded) that a join brings
    in, and that is saved as one. Values not seen get the mean of all rows."""

    prior = Param(Params._dummy(), "prior", "mean of all rows", TypeConverters.toFloat)
    table: DataFrame

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = self.getOrDefault("outputCol")
        found = self.table.select(F.col("value").alias("__value"), F.col("encoded").alias("__encoded"))
        if not self.table.offset(MOST_BROADCAST).take(1):
            found = F.broadcast(found)
        joined = dataset.withColumn("__value", self._value()).join(found, "__value", "left")
        return joined.withColumn(out, F.coalesce("__encoded", F.lit(self.getOrDefault("prior")))).drop("__value", "__encoded")

    def write(self) -> MLWriter:
        return _TableWriter(self)

    def copy(self, extra=None) -> SigmoidTargetModel:
        that = super().copy(extra)
        that.table = self.table
        return that

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader()


class _TableWriter(MLWriter):
    def __init__(self, instance: SigmoidTargetModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def load(self, path: str) -> SigmoidTargetModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = SigmoidTargetModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.table = self.sparkSession.read.schema("value string, encoded double").parquet(f"{path}/table")
        return model


class LinearScore(_Stage, Model, DefaultParamsReadable, DefaultParamsWritable):
    """Intercept and weights over a vector."""

    intercept = Param(Params._dummy(), "intercept", "intercept", TypeConverters.toFloat)
    weights = Param(Params._dummy(), "weights", "weights", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = vector_to_array(self.getOrDefault("inputCol"))
        terms = F.zip_with(x, F.array(*map(F.lit, self.getOrDefault("weights"))), lambda a, b: a * b)
        return dataset.withColumn(self.getOrDefault("outputCol"), F.aggregate(terms, F.lit(self.getOrDefault("intercept")), lambda a, b: a + b))

    def importance(self) -> list[float]:
        return list(self.getOrDefault("weights"))


class TreeScore(_Stage, Model, DefaultParamsReadable, DefaultParamsWritable):
    """The mean of the windows' trees over a vector; the trees are JSON."""

    trees = Param(Params._dummy(), "trees", "trees", TypeConverters.toString)

    @classmethod
    def of(cls, model: Windows, windows: list[int], **columns) -> TreeScore:
        pick = lambda arrays: [a[windows].tolist() for a in arrays]
        return cls(trees=json.dumps({"depth": model.depth, "base": model.base[windows].tolist(), "feature": pick(model.feature), "bin": pick(model.bin), "leaf": pick(model.leaf)}), **columns)

    def model(self) -> Windows:
        t = json.loads(self.getOrDefault("trees"))
        return Windows(t["depth"], np.array(t["base"], float), [np.array(a) for a in t["feature"]], [np.array(a) for a in t["bin"]], [np.array(a) for a in t["leaf"]])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model = self.model()
        every = np.arange(len(model.base))[None, :]

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            bins = value_bins(np.stack(x.to_list()).astype(float))
            return pd.Series(model.predict(bins, np.repeat(every, len(bins), 0)).mean(axis=1))

        return dataset.withColumn(self.getOrDefault("outputCol"), score(vector_to_array(self.getOrDefault("inputCol"))))

    def importance(self) -> list[float]:
        """Splits of each input, as a share of all."""
        model = self.model()
        used = np.concatenate([f[f >= 0] for f in model.feature]) if model.feature else np.zeros(0, int)
        counts = np.bincount(used) if len(used) else np.zeros(1)
        return (counts / max(1, counts.sum())).tolist()


def price_stages(numeric: list[str], low: list[str], high: list[str], label: str = "log_label", least_rows: int = 10, most_slots: int = 25) -> list:
    """Medians for missing numbers, frequent values as slots, blended means of
    the label for columns of many values, one vector."""
    stages: list = [Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}__i" for c in numeric])] if numeric else []
    stages += [FrequentOneHot(inputCol=c, outputCol=f"{c}__o", leastRows=least_rows, mostSlots=most_slots) for c in low]
    stages += [SigmoidTarget(inputCol=c, outputCol=f"{c}__t", labelCol=label) for c in high]
    return [*stages, VectorAssembler(inputCols=[*(f"{c}__i" for c in numeric), *(f"{c}__o" for c in low), *(f"{c}__t" for c in high)], outputCol="features", handleInvalid="keep")]


def feature_names(model: PipelineModel) -> list[str]:
    """Names of the slots of the vector that the fitted stages make."""
    out: list[str] = []
    for stage in model.stages:
        if isinstance(stage, ImputerModel):
            out += list(stage.getInputCols())
        elif isinstance(stage, FrequentOneHotModel):
            out += stage.slots()
        elif isinstance(stage, SigmoidTargetModel):
            out.append(f"{stage.getOrDefault('inputCol')} (mean)")
    return out
