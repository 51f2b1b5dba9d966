"""Saved models: versions of a name in a folder, with what is known of them."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KIND = "name string, version long, saved_at timestamp, path string, facts string"


def save_model(root: str, name: str, model: PipelineModel, facts: dict, version: int | None = None) -> int:
    """Save a fitted pipeline and its facts (family, parameters, metrics) as a
    new version of a name, the next one if none is given. The entry of the
    catalog is written last, so a version that is listed is complete; a version
    that exists is an error."""
    spark = SparkSession.active()
    known = [r["version"] for r in list_models(spark, root, name).select("version").collect()]
    version = version or max(known, default=0) + 1
    if version in known:
        raise ValueError(f"{name} has a version {version}")
    path = f"{root.rstrip('/')}/models/{name}/{version}-{uuid.uuid4().hex[:8]}"
    model.write().save(path)
    entry = (name, version, datetime.now(timezone.utc), path, json.dumps(facts, sort_keys=True))
    spark.createDataFrame([entry], _KIND).coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/catalog")
    return version


def list_models(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """The catalog: one row a version; empty without any."""
    path = f"{root.rstrip('/')}/catalog"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], _KIND)
    rows = spark.read.schema(_KIND).parquet(path)
    return rows if name is None else rows.where(F.col("name") == name)


def load_model(spark: SparkSession, root: str, name: str, version: int | None = None) -> tuple[PipelineModel, dict]:
    """(model, facts) of a version, the latest by default; none is an error."""
    rows = list_models(spark, root, name)
    if version is not None:
        rows = rows.where(F.col("version") == version)
    row = rows.orderBy(F.desc("version")).first()
    if row is None:
        raise LookupError(f"no model {name}" + (f" of version {version}" if version else ""))
    return PipelineModel.load(row["path"]), json.loads(row["facts"]) | {"version": row["version"]}
