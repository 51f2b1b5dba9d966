"""Readers with explicit schemas. Files are opened by Spark, so any store works."""

from __future__ import annotations

import csv
import io
import itertools
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import text

CATALOG = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("year", T.IntegerType()), ("make", T.StringType()), ("model", T.StringType()), ("baseModel", T.StringType()))])
#: Texts that stand for null in catalog files (fixed values).
NULL_TOKENS = ("", "NA", "N/A")
FORECAST = "cohort_id string, model_family string, forecast_method string, forecast_month date, forecast_horizon_months double, predicted_price double"


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; columns it lacks come as null strings."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*select_or_null(df, columns))


def select_or_null(df: DataFrame, columns: list[str], kind: str = "string") -> list[Column]:
    return [F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c in columns]


def query(spark: SparkSession, sql: str, args: dict | None = None, **views: DataFrame) -> DataFrame:
    """SQL with bind parameters over the given frames."""
    return spark.sql(sql, args=args, **views)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """An official model catalog (CSV, or CSV in a ZIP archive): null tokens read as null, unreadable
    values too, baseModel from model where it is missing, and normalised keys.
    id, year, make and model must be there; rows without them go."""
    zipped = path.lower().endswith(".zip")
    raw = read_zip_csv(spark, path) if zipped else spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    raw = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns if not c.startswith("__")])
    missing = {"id", "year", "make", "model"} - set(raw.columns)
    if missing:
        raise ValueError(f"catalog lacks {sorted(missing)}")
    clean = lambda n: F.when(F.col(n).isin(*NULL_TOKENS), None).otherwise(F.col(n))
    base = clean("baseModel") if "baseModel" in raw.columns else F.lit(None).cast("string")
    df = raw.select(clean("id").try_cast("long").alias("id"), clean("year").try_cast("int").alias("year"), clean("make").alias("make"), clean("model").alias("model"), F.coalesce(base, clean("model")).alias("baseModel"))
    return normalize_catalog(df.dropna(subset=["id", "year", "make", "model"]))


def read_zip_csv(spark: SparkSession, path: str, infer_rows: int = 10_000, null_tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """All CSV members of ZIP archives as one frame, with __member and __row.

    Tasks stream the members of their archive; the header of the first member by
    name gives the columns, and other members' columns are found by name. A
    column is long or double if all values of the first infer_rows rows of each
    member are, else a string; later values that do not fit are null, as are the
    null tokens. Members without rows give none; an archive without CSV raises."""

    def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for member in sorted(n for n in archive.namelist() if n.lower().endswith(".csv")):
                        with archive.open(member) as raw:
                            rows = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))
                            header, some, start = next(rows, []), [], 0
                            for row in itertools.chain(rows, [None]):
                                if row:
                                    some.append(dict(zip(header, row, strict=False)))
                                if some and (row is None or len(some) >= 1000):
                                    n = len(some)
                                    yield pa.RecordBatch.from_arrays([pa.array([f"{name}/{member}"] * n), pa.array(range(start, start + n), pa.int64()), pa.array([list(r.items()) for r in some], pa.map_(pa.string(), pa.string()))], ["__member", "__row", "values"])
                                    start, some = start + n, []
                            if not start:
                                yield pa.RecordBatch.from_arrays([pa.array([f"{name}/{member}"]), pa.array([-1], pa.int64()), pa.array([[(h, "") for h in header]], pa.map_(pa.string(), pa.string()))], ["__member", "__row", "values"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(members, "__member string, __row long, values map<string, string>")
    first = rows.orderBy("__member", "__row").select(F.map_keys("values")).first()
    if first is None:
        raise ValueError(f"no CSV in {path}")
    value = lambda c: F.when(~F.col("values")[c].isin(*null_tokens), F.col("values")[c])
    seen = rows.where(F.col("__row").between(0, infer_rows - 1))
    bad = seen.agg(*[F.count_if(value(c).isNotNull() & value(c).try_cast(t).isNull()).alias(f"{i}{t}") for i, c in enumerate(first[0]) for t in ("long", "double")]).first()
    kinds = ["long" if not bad[f"{i}long"] else "double" if not bad[f"{i}double"] else "string" for i in range(len(first[0]))]
    return rows.where("__row >= 0").select("__member", "__row", *[value(c).try_cast(t).alias(c) for c, t in zip(first[0], kinds, strict=True)])


def normalize_catalog(df: DataFrame) -> DataFrame:
    return df.withColumns({"normalized_make": text.normalize_vehicle(F.col("make")), "normalized_model": text.normalize_vehicle(F.col("model")), "normalized_base_model": text.normalize_vehicle(F.col("baseModel"))})


def empty_catalog(spark: SparkSession) -> DataFrame:
    return normalize_catalog(spark.createDataFrame([], CATALOG))


def catalog_metadata(catalog: DataFrame, version: str) -> DataFrame:
    """One row: record_count, min_year, max_year, normalization_version."""
    return catalog.agg(F.count("*").alias("record_count"), F.min("year").alias("min_year"), F.max("year").alias("max_year")).withColumn("normalization_version", F.lit(version))


def latest_file(spark: SparkSession, pattern: str) -> str:
    """The newest path of those that fit a pattern, of equally new ones the last
    by name; raises if there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        raise FileNotFoundError(pattern)
    return max((f.getModificationTime(), f.getPath().toString()) for f in found)[1]


def read_listing_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Scraped listings (CSV); loaddate from a name like CAR_DATA_2026-01-03.csv
    where the column is missing, columns it lacks as null."""
    raw = spark.read.option("header", True).option("nanValue", "").csv(path)
    if "loaddate" not in raw.columns:
        raw = raw.withColumn("loaddate", F.nullif(F.regexp_extract(F.input_file_name(), r"CAR_DATA_(\d{4}-\d{2}-\d{2})\.csv", 1), F.lit("")))
    return raw.select(*select_or_null(raw, columns))


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Forecast files of any age: the horizon in months from days where only
    those are given, cohort and family from their defaults."""
    raw = spark.read.option("header", True).csv(path)
    has = set(raw.columns)
    months = F.col("forecast_horizon_months").try_cast("double") if "forecast_horizon_months" in has else F.lit(None).cast("double")
    days = F.col("forecast_horizon_days").try_cast("double") / 30.4375 if "forecast_horizon_days" in has else F.lit(None).cast("double")
    parts = [F.col(c) for c in ("make", "model", "model_year", "trim_proxy") if c in has]
    return raw.select(
        F.col("cohort_id") if "cohort_id" in has else text.joined_key(*parts).alias("cohort_id"),
        F.coalesce(F.col("model_family") if "model_family" in has else F.lit(None), F.lit("global")).alias("model_family"),
        *select_or_null(raw, ["forecast_method"]),
        F.col("forecast_month").try_cast("date").alias("forecast_month"),
        F.coalesce(months, days).alias("forecast_horizon_months"),
        F.col("predicted_price").try_cast("double").alias("predicted_price") if "predicted_price" in has else F.lit(None).cast("double").alias("predicted_price"),
    )


def read_listing_items(df: DataFrame, body: str = "body") -> DataFrame:
    """Rows of captured API answers (JSON text with queueResults): details parts
    joined, the first image that is there, currency marks off the price, nested
    histories as JSON text."""
    item = "array<struct<vin: string, title: string, details: array<string>, img: string, imgUrl: string, image: string, price: string, mileage: string, priceHistory: string, listingHistory: string>>"
    rows = df.select(F.inline(F.from_json(F.get_json_object(body, "$.results"), item)))
    first = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("img", "imgUrl", "image")])
    price = F.regexp_replace("price", "[$,]", "").try_cast("double").try_cast("long")
    mileage = F.regexp_replace("mileage", "[^0-9.]", "").try_cast("double").try_cast("long")
    return rows.select("vin", "title", F.array_join("details", " ").alias("details"), first.alias("img"), price.alias("price"), mileage.alias("mileage"), "priceHistory", "listingHistory")


def stream_listing_items(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from a folder that JSON answers arrive in."""
    return read_listing_items(spark.readStream.schema("results string").option("wholetext", True).json(path).select(F.to_json(F.struct("results")).alias("body")))


def profile(df: DataFrame, *numeric: str) -> DataFrame:
    """Row count and min, mean, max of columns in one pass."""
    return df.agg(F.count("*").alias("n_rows"), *[f(c).alias(f"{n}_{c}") for c in numeric for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max))])
