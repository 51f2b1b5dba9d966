"""Functions for JSON texts and arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HISTORY = "array<struct<date: string, price: double, mileage: double, trend: string>>"


def parse_history(c: Column) -> Column:
    """The history of a JSON text; null if it is no list."""
    return F.when(F.ltrim(c).startswith("["), F.from_json(c, HISTORY))


def flatten_history(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """One row per history entry with the key columns; rows without entries go."""
    return df.select(*keys, F.inline(F.col(column)))


def error_reason(c: Column) -> Column:
    return F.get_json_object(c, "$.error.errors[0].reason")


def prefixed(df: DataFrame, names: list[str], prefix: str = "nhtsa_") -> list[Column]:
    """The named columns under a prefix, '' where a value or the column is missing."""
    return [(F.coalesce(F.col(n).cast("string"), F.lit("")) if n in df.columns else F.lit("")).alias(prefix + n) for n in names]


def first_distinct(items: Column, field: str, n: int = 3) -> Column:
    """The distinct non-empty values of a field of the first n items, joined."""
    values = F.transform(F.slice(items, 1, n), lambda x: x[field])
    return F.array_join(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))), "; ")


def recall_summary(items: Column) -> Column:
    """count, components and first_date of an array of recalls."""
    return F.struct(F.coalesce(F.size(items), F.lit(0)).alias("count"), first_distinct(items, "component").alias("components"), F.try_element_at(items, F.lit(1))["date"].alias("first_date"))


def complaint_summary(items: Column) -> Column:
    """count, injuries, deaths, crashes, fires and areas of an array of complaints."""
    total = lambda name: F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x[name].cast("long"), F.lit(0).cast("long")))
    return F.struct(
        F.coalesce(F.size(items), F.lit(0)).alias("count"),
        total("injuries").alias("injuries"),
        total("deaths").alias("deaths"),
        F.size(F.filter(items, lambda x: x["crash"])).alias("crashes"),
        F.size(F.filter(items, lambda x: x["fire"])).alias("fires"),
        first_distinct(items, "area").alias("areas"),
    )
