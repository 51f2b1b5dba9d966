"""Number functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Right-closed mileage and price bands: (upper edge, label), the last open (fixed values).
MILEAGE_BANDS = ((100, "delivery"), (5_000, "under_5k"), (25_000, "5k_25k"), (60_000, "25k_60k"), (100_000, "60k_100k"), (150_000, "100k_150k"), (None, "150k_plus"))
PRICE_BANDS = ((25_000, "under_25k"), (50_000, "25k_50k"), (100_000, "50k_100k"), (150_000, "100k_150k"), (None, "150k_plus"))
HIGH_VALUE = 150_000


def to_int_ceil(c: Column) -> Column:
    """Whole number at or above what the text says, without $ and commas; null if it says none."""
    return F.ceil(F.regexp_replace(c.cast("string"), "[$,]", "").try_cast("double"))


def to_int(c: Column) -> Column:
    return c.cast("string").try_cast("double").try_cast("long")


def to_float(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def repeated_digits(c: Column) -> Column:
    """Five or more digits, all the same and not 0."""
    return F.coalesce(c.cast("long").cast("string").rlike(r"^([1-9])\1{4,}$"), F.lit(False))


def band(c: Column, bands: tuple, lowest: float) -> Column:
    """Label of the right-closed band; null at or below `lowest`."""
    out = F.when(c.isNull() | (c <= lowest), F.lit(None))
    for edge, label in bands:
        out = out.otherwise(F.lit(label)) if edge is None else out.when(c <= edge, label)
    return out


def year_bucket(c: Column, width: int = 5) -> Column:
    return (F.floor(c / width) * width).cast("long")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; null for a zero or null denominator."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def comment_weight(likes: Column, words: Column) -> Column:
    """1 + log10(likes + 1), a fifth more for 20 words or more."""
    return (1 + F.log10(F.greatest(F.coalesce(likes, F.lit(0)), F.lit(0)) + 1)) * F.when(words >= 20, 1.2).otherwise(1.0)


def aspect_score(positive: Column, negative: Column, least: float = 0.40) -> Column:
    """(p - n) / (p + n) where either reaches `least`, else null."""
    return F.when(F.greatest(positive, negative) >= least, (positive - negative) / (positive + negative + 1e-9))


def step_rate(total: Column, step: float, whole: float) -> Column:
    """Growth of one step of a growth over the whole time, compounding."""
    return F.pow(1 + total, F.lit(step / whole)) - 1


def nearest_quantile(values: Column, q: float) -> Column:
    """Quantile of an array without interpolation: the value at round((n - 1) q)."""
    sorted_values = F.array_sort(values)
    return F.when(F.size(values) > 0, F.element_at(sorted_values, (F.round((F.size(values) - 1) * q) + 1).cast("int")))
