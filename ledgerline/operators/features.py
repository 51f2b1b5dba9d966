"""Features of a listing's current price, and the contract that keeps answers out."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import unwrap_udt

from ledgerline.functions import numbers, text
from ledgerline.session import cut_lineage

#: Columns that hold the answer, or know it (fixed values).
ANSWERS = ("price", "price_band", "log_price", "is_high_value", "target_price", "target_change")
FORCED_CARDINALITY = ("vin", "title", "trim", "model", "location")


def current_price_features(df: DataFrame, as_of_year: int, price: str = "price", mileage: str = "mileage", year: str = "canonical_year", day: str = "loaddate", title: str = "title", source: str = "source_name") -> DataFrame:
    """Numeric, band, flag and key features; the year is a parameter, so that
    reruns agree. Recency needs the last day of the table, one aggregated row."""
    last = df.agg(F.max(day).alias("__last"))
    age = F.greatest(F.lit(as_of_year) - F.col(year), F.lit(0)).cast("double")
    miles = F.when(F.col(mileage) < 0, 0.0).otherwise(F.col(mileage).cast("double"))
    d = df.crossJoin(F.broadcast(last)).withColumns({"vehicle_age": age, "log_mileage": F.log1p(miles)})
    return d.withColumns(
        {
            "age_squared": age * age,
            "mileage_per_year": miles / F.greatest(age, F.lit(0.25)),
            "age_mileage": age * miles,
            "year_bucket": numbers.year_bucket(F.col(year)),
            "mileage_band": numbers.band(F.col(mileage), numbers.MILEAGE_BANDS, -1),
            "price_band": numbers.band(F.col(price), numbers.PRICE_BANDS, 0),
            "is_high_value": (F.col(price) >= numbers.HIGH_VALUE).cast("int"),
            "days_since_listed": F.datediff("__last", day),
            "load_month": F.month(day),
            "load_quarter": F.quarter(day),
            "load_week": F.weekofyear(day),
            "title_length": F.length(F.coalesce(F.col(title), F.lit(""))),
            "title_words": text.word_count(F.col(title)),
            "title_certified": text.flag(F.col(title), "certified|cpo"),
            "title_awd": text.flag(F.col(title), "awd|4wd|4x4|all wheel"),
            "title_luxury": text.flag(F.col(title), r"\b(premium|platinum|limited|reserve|s|amg|m sport|rs|performance|gt350|gt500)\b"),
            "source_is_marketplace": text.flag(F.col(source), "cars.com|truecar|cargurus|autotempest"),
            "make_model_year": F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")) for c in ("canonical_make", "canonical_model", year)]),
        }
    ).drop("__last")


def feature_matrix(df: DataFrame, answers: tuple[str, ...] = ANSWERS, diagnostic: tuple[str, ...] = ()) -> DataFrame:
    """The frame without answers and diagnostics; raises if one is left."""
    out = df.drop(*answers, *diagnostic)
    left = [c for c in out.columns if c in answers or c.startswith("target_")]
    if left:
        raise ValueError(f"features know the answer: {left}")
    return out


def column_kinds(df: DataFrame, most: int = 50, forced: tuple[str, ...] = FORCED_CARDINALITY) -> dict[str, list[str]]:
    """numeric, low and high cardinality columns; one pass counts all texts."""
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")]
    texts = [c for c, t in df.dtypes if t == "string"]
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in texts]).first().asDict() if texts else {}
    high = [c for c in texts if counts[c] > most or any(f in c.split("_") for f in forced)]
    return {"numeric": numeric, "low": [c for c in texts if c not in high], "high": high}


def feature_space(train: DataFrame, stages: list, most_rows: int | None = None, top: int = 25) -> dict:
    """Size of the vectors that the stages make of a training frame, fitted and
    measured on all its rows. A caller who gives most_rows gets both on that many
    rows in a hash order, projected to all. A dense vector takes eight bytes a
    slot, a sparse one twelve an entry. Counts of distinct texts are of the whole
    frame. The frame is written once, and so is such a sample, since the stages
    read it many times."""
    train = cut_lineage(train)
    rows = train.count()
    texts = [c for c, t in train.dtypes if t == "string"]
    sample = train if most_rows is None or rows <= most_rows else cut_lineage(train.orderBy(F.xxhash64(*train.columns)).limit(most_rows))
    made = Pipeline(stages=stages).fit(sample).transform(sample).select(unwrap_udt("features").alias("v"))
    sparse = F.col("v.type") == 0
    slots = F.when(sparse, F.col("v.size")).otherwise(F.size("v.values"))
    held = F.when(sparse, 12 * F.size("v.values")).otherwise(8 * F.size("v.values"))
    seen = made.agg(F.count("*").alias("n"), F.max(slots).alias("width"), F.sum(held).alias("bytes"), F.sum(F.size(F.filter("v.values", lambda x: x != 0.0))).alias("nonzero"), F.count_if(sparse).alias("sparse")).first()
    counts = train.agg(*[F.count_distinct(c).alias(c) for c in texts]).first().asDict() if texts else {}
    ranked = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:top]
    sampled_mb = (seen["bytes"] or 0) / 1024**2
    return {"profile_rows": seen["n"], "training_rows": rows, "width": seen["width"] or 0, "nonzero_entries": seen["nonzero"] or 0, "sparse_rows": seen["sparse"], "sample_mb": sampled_mb, "projected_mb": sampled_mb * rows / max(1, seen["n"]), "top_cardinality": ranked}
