"""The upsert family: each takes the stored and the new rows and returns the new
state, to be written beside the old one. Keys with a null part are distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return df.withColumn("__whole", whole).withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the last in the (total) order; rows with a null key go."""
    return _ranked(df.dropna(subset=keys), keys, order).where("__rank = 1").drop("__rank", "__whole")


def keep_first_or_null(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per whole key, the first in the order; every row whose key holds
    a null stays."""
    return _ranked(df, keys, order).where("__rank = 1 OR NOT __whole").drop("__rank", "__whole")


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Insert or replace: per key the new row with the highest seq, else the old
    one. Columns that a side lacks are null there."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, [F.desc("__new"), F.desc_nulls_last(seq)]).drop("__new")


def insert_new(old: DataFrame, new: DataFrame, key: str, order: list) -> DataFrame:
    """Rows of `new` whose key is not stored, the first of each key."""
    return keep_last(new.join(old.select(key), key, "left_anti"), [key], order)


def merge_rows(old: DataFrame, new: DataFrame, key: str, overwrite: list[str] = (), keep_old: list[str] = ()) -> DataFrame:
    """Upsert by key: `overwrite` columns take the new value where there is a new
    row, `keep_old` columns the old value if it is there, and all others the new
    value unless it is null."""
    o, n = old.alias("o"), new.withColumn("__hit", F.lit(True)).alias("n")
    both = o.join(n, key, "full")
    out = [F.col(key)]
    for c in old.columns:
        if c == key:
            continue
        a, b = F.col(f"o.{c}"), (F.col(f"n.{c}") if c in new.columns else F.lit(None))
        out.append((F.when(F.col("__hit"), b).otherwise(a) if c in overwrite else F.coalesce(a, b) if c in keep_old else F.coalesce(b, a)).alias(c))
    return both.select(*out)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that forbid a unique index: (key, n) with n > 1 or a null key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull())


def write_swapped(df: DataFrame, path: str) -> str:
    """Write beside `path` first, then rename over it, so readers see the old or
    the new table, never a part. Returns the path."""
    spark = df.sparkSession
    staged = f"{path}__new"
    df.write.mode("overwrite").parquet(staged)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old, new, gone = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, staged, f"{path}__old"))
    fs = old.getFileSystem(conf)
    fs.delete(gone, True)
    if fs.exists(old):
        fs.rename(old, gone)
    fs.rename(new, old)
    fs.delete(gone, True)
    return path
