"""Cleaning: filters, normalised columns and layout checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import dates, numbers, text

#: Vehicles whose listings are known to be wrong (fixed values).
VIN_BLACKLIST = ("1GCUY6ED0LF228114", "1FTFW6L8XSFB63087")


def non_empty(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(F.trim(F.col(c).cast("string")) != "")
    return df


def in_price_range(df: DataFrame, column: str, low: int = 1_000, high: int = 1_000_000) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def ensure_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Columns that are missing are added as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})


def conform(df: DataFrame, layout: dict[str, str]) -> DataFrame:
    """Exactly the columns of the layout, in order, cast leniently."""
    return ensure_columns(df, **layout).select(*[F.col(c).try_cast(k).alias(c) for c, k in layout.items()])


def normalize_dates(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: dates.parse_date(F.col(c)) for c in columns if c in df.columns})


def normalize_numbers(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: numbers.to_int_ceil(F.col(c)) for c in columns if c in df.columns})


def clean_listings(df: DataFrame, layout: dict[str, str], price: str = "price", vin: str = "vin") -> DataFrame:
    """Raw listings to typed ones: known columns, valid vehicles off the
    blacklist, dates and whole prices, rows without a day or price in range out."""
    days = [c for c, k in layout.items() if k == "date"]
    df = non_empty(df.select(*[c for c in layout if c in df.columns]), vin).where(~F.col(vin).isin(*VIN_BLACKLIST))
    df = normalize_numbers(normalize_dates(df, *days), price).dropna(subset=[c for c in days if c in df.columns])
    return conform(in_price_range(df, price), layout)


def legacy_aliases(df: DataFrame) -> DataFrame:
    """Old names of the identity columns, where all three are there."""
    names = {"canonical_make": "make", "canonical_model": "model", "canonical_trim": "trim_combined"}
    return df.withColumns({new: F.col(old) for old, new in names.items()}) if set(names) <= set(df.columns) else df


def filters(df: DataFrame, price: str = "price", **equal: object) -> DataFrame:
    """Conjunction of the given equalities (None: any), on rows with a price."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    return df.where(F.col(price) > 0)


def trim_proxy(df: DataFrame, trim: str = "canonical_trim") -> DataFrame:
    return df.withColumn("trim_proxy", text.normalize_trim(F.col(trim), "UNKNOWN_TRIM") if trim in df.columns else F.lit("UNKNOWN_TRIM"))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def reduce_cardinality(df: DataFrame, columns: list[str], threshold: float = 0.005, other: str = "Other") -> DataFrame:
    """Values with less than the share of rows become `other`. The frequent
    values are fewer than 1 / threshold, so the joined side is bounded."""
    for c in columns:
        total = df.select(F.count("*").alias("__n"))
        often = df.groupBy(F.col(c).alias("__v")).agg(F.count("*").alias("__k")).crossJoin(F.broadcast(total)).where(F.col("__k") >= threshold * F.col("__n")).select("__v", F.lit(True).alias("__often"))
        df = df.join(F.broadcast(often), F.col(c) == F.col("__v"), "left").withColumn(c, F.when(F.col(c).isNull() | F.col("__often"), F.col(c)).otherwise(other)).drop("__v", "__often")
    return df
