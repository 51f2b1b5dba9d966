"""Files written and read back, table swaps, the catalog, and queries of single
operators that the reports only use inside."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import cohort, features, identity
from ledgerline.plans.registry import query
from ledgerline.session import new_folder
from ledgerline.sources import files, upserts

COHORT = ["canonical_make"]


def _folder(m, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return new_folder(m.spark, name)


def _catalog(m):
    return m.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5 + 1990).cast("int").alias("year"), F.col("p_brand").alias("make"), F.col("p_type").alias("model"), F.element_at(F.split("p_type", " "), 1).alias("baseModel"))


@query("s07_catalog_file", "SELECT p_partkey AS id, (1990 + p_size % 5)::INT AS year, p_brand AS make, p_type AS model, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE split_part(p_type, ' ', 1) END AS \"baseModel\", replace(upper(p_brand), '#', ' ') AS normalized_make FROM part WHERE p_partkey % 10 <> 0")
def s07(m):
    """A catalog as CSV with null tokens, unreadable ids and missing base models."""
    bad = F.when(F.col("id") % 10 == 0, "n/a?").otherwise(F.col("id").cast("string"))
    path = _folder(m, "catalog")
    _catalog(m).select(bad.alias("id"), "year", "make", "model", F.when(F.col("id") % 4 != 0, F.col("baseModel")).alias("baseModel")).write.option("header", True).csv(path)
    return files.read_catalog(m.spark, path).select("id", "year", "make", "model", "baseModel", "normalized_make")


@query("s09_listing_csv", "SELECT vin, price::VARCHAR AS price, CASE WHEN seq % 2 = 0 THEN '2026-01-03' ELSE '2026-01-04' END AS loaddate, NULL::VARCHAR AS colour FROM {listings}")
def s09(m):
    """Scraped listings: the load date from the file's name, a column it lacks."""
    path, rows = _folder(m, "csv"), m.listings.select("vin", "price", (F.col("seq") % 2).alias("odd"))
    out = None
    for odd, day in ((0, "2026-01-03"), (1, "2026-01-04")):
        one = f"{path}/CAR_DATA_{day}.csv"
        rows.where(F.col("odd") == odd).drop("odd").write.option("header", True).csv(one)
        got = files.read_listing_csv(m.spark, one, ["vin", "price", "loaddate", "colour"])
        out = got if out is None else out.unionByName(got)
    return out


@query("s13_listing_items", "SELECT 'V' || p_partkey AS vin, p_name AS title, p_brand || ' ' || p_type AS details, CASE WHEN p_partkey % 2 = 0 THEN 'a' || p_partkey ELSE 'b' || p_partkey END AS img, p_size * 1000 AS price, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey::BIGINT END AS mileage FROM part")
def s13(m):
    """Captured API answers, some items without an image or a mileage."""
    item = F.struct(
        F.concat(F.lit("V"), "p_partkey").alias("vin"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("details"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a"), "p_partkey")).otherwise("").alias("img"),
        F.concat(F.lit("b"), "p_partkey").alias("image"), F.concat(F.lit("$"), F.format_number(F.col("p_size") * 1000, 0)).alias("price"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.col("p_partkey").cast("string"), F.lit(" mi."))).alias("mileage"),
    )
    answers = m.part.select(F.to_json(F.struct(F.array(item).alias("results"))).alias("body"))
    return files.read_listing_items(answers).select("vin", "title", "details", "img", "price", "mileage")


@query("s23_forecast_file", "SELECT p_partkey::VARCHAR AS cohort_id, CASE WHEN p_partkey % 2 = 0 THEN 'global' ELSE 'drift' END AS model_family, DATE '2026-01-01' + p_size::INT AS forecast_month, round(p_size / 30.4375, 9) AS months, round(p_retailprice, 2) AS predicted_price FROM part")
def s23(m):
    """A forecast file of an older layout: horizons in days, families missing."""
    path = _folder(m, "forecasts")
    rows = m.part.select(F.col("p_partkey").alias("cohort_id"), F.when(F.col("p_partkey") % 2 == 1, "drift").alias("model_family"), F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size").cast("int")).alias("forecast_month"), F.col("p_size").alias("forecast_horizon_days"), F.round("p_retailprice", 2).alias("predicted_price"))
    rows.write.option("header", True).csv(path)
    return files.read_forecasts(m.spark, path).select("cohort_id", "model_family", "forecast_month", F.round("forecast_horizon_months", 9).alias("months"), "predicted_price")


@query("s19_latest_file", "SELECT count(*) AS n FROM part WHERE p_size > 10")
def s19(m):
    """The newest of several files of one kind, by modification time."""
    path = _folder(m, "dated")
    m.part.select("p_partkey").write.parquet(f"{path}/old")
    m.part.where("p_size > 10").select("p_partkey").write.parquet(f"{path}/new")
    return m.spark.read.parquet(files.latest_file(m.spark, f"{path}/*")).agg(F.count("*").alias("n"))


@query("k08_k10_swapped_table", "SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def k08(m):
    """A table is written, replaced by its next version, and read back."""
    path = _folder(m, "swapped")
    old = m.customer.select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"), F.lit(0).alias("seq"))
    upserts.write_swapped(old, path)
    new = old.where("c_custkey % 3 = 0").withColumns({"c_acctbal": F.col("c_acctbal") + 1, "seq": F.lit(1)})
    upserts.write_swapped(upserts.replace_rows(m.spark.read.parquet(path), new, ["c_custkey"], "seq"), path)
    return m.spark.read.parquet(path).drop("seq")


@query("k11_report_files", "SELECT c_mktsegment, count(*)::BIGINT AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def k11(m):
    """A report as CSV and as JSON lines; both hold the same rows."""
    path = _folder(m, "report")
    report = m.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    report.write.option("header", True).csv(f"{path}/csv")
    report.write.json(f"{path}/json")
    kinds = "c_mktsegment string, n long, total double"
    a, b = m.spark.read.schema(kinds).option("header", True).csv(f"{path}/csv"), m.spark.read.schema(kinds).json(f"{path}/json")
    return a.intersect(b)


@query("k03_k07_replace_dynamic", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_name END AS p_name, p_size, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS p_brand FROM part")
def k03(m):
    """Replacing rows that have other columns: what a side lacks is null."""
    old = m.part.select("p_partkey", "p_name", "p_size", F.lit(0).alias("seq"))
    new = m.part.where("p_partkey % 2 = 0").select("p_partkey", "p_brand", "p_size", F.lit(1).alias("seq"))
    return upserts.replace_rows(old, new, ["p_partkey"], "seq").select("p_partkey", "p_name", "p_size", "p_brand")


_CATALOG_SQL = """
WITH c AS (SELECT 1990 + p_size % 5 AS year, p_brand, upper(p_type) AS model, min(p_partkey) AS id, count(*) AS n FROM part GROUP BY 1, 2, 3),
l AS (SELECT row_number() OVER () AS row, l.vin, l.seq, l.price, 1990 + p_size % 5 AS year, p_brand, ' ' || trim(regexp_replace(upper(l.title), '[^A-Z0-9]+', ' ', 'g')) || ' ' AS title FROM {listings} l JOIN part ON p_partkey = CAST(substr(l.vin, 4) AS BIGINT)),
r AS (SELECT l.*, c.model, c.id, c.n, row_number() OVER (PARTITION BY row ORDER BY len(string_split(model, ' ')) DESC, length(model) DESC, model) AS rn FROM l JOIN c USING (year, p_brand) WHERE contains(title, ' ' || model || ' '))
SELECT vin, seq, price, year::INT AS canonical_year, replace(upper(p_brand), '#', ' ') AS canonical_make, model AS canonical_model, id AS epa_vehicle_id, CASE WHEN n > 1 THEN 'ambiguous_best' ELSE 'exact' END AS epa_match_status FROM r WHERE rn = 1
"""


@query("i02_i06_catalog_identity", _CATALOG_SQL)
def i02(m):
    """Only the make is registered: the year comes from the title, the model is
    the longest catalog name in it, and the catalog entry is found by them."""
    none = F.lit(None).cast("string")
    rows = m.listings.join(m.identity.select("vin", F.col("canonical_make").alias("make")), "vin").withColumns({"model": none, "year": F.lit(None).cast("int"), "trim": none})
    out = identity.normalize_listings(rows, _catalog(m))
    return out.select("vin", "seq", "price", "canonical_year", "canonical_make", "canonical_model", "epa_vehicle_id", "epa_match_status")


#: What parts are called here, by their number: make, model, words of the title.
_CARS = (
    ("Toyota", "Tacoma", "TRD Off-Road Premium"), ("Toyota", "Tacoma", "TRD Pro 4x4"), ("Ford", "Mustang", "Shelby GT500"), ("Ford", "Mustang", "Shelby GT350R Coupe"), ("BMW", "M3", "Competition xDrive"), ("BMW", "M3", "Competition"),
    ("Mazda", "CX-5", "Signature"), ("Mazda", "CX-5", ""), ("Honda", "Pilot", "EX-L"), ("Ram", "1500", "Big Horn TRD Sport"), ("Ford", "F-150", "King Ranch"), ("Toyota", "Tundra", "TRD Off Road"),
)
_I04 = (
    "WITH c(place, make, model, words) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{w}')" for i, (a, b, w) in enumerate(_CARS)) + "), "
    "a(mk, md, y0, y1, alias, name, rank) AS (VALUES " + ", ".join([f"('{a}', '{b}', {y}, {z}, '{p}', '{n}', 1)" for a, b, y, z, p, n in identity.SCOPED_ALIASES] + [f"(NULL, NULL, NULL, NULL, '{p}', '{n}', 2)" for p, n in identity.TRIM_ALIASES.items()]) + "), "
    """
l AS (SELECT p_partkey, 2001 + p_partkey % 31 AS year, make, model, trim(concat_ws(' ', 2001 + p_partkey % 31, make, model, words)) AS title FROM part JOIN c ON p_partkey % 12 = place),
t AS (SELECT *, ' ' || trim(regexp_replace(upper(title), '[^A-Z0-9]+', ' ', 'g')) || ' ' AS said FROM l),
h AS (SELECT t.*, name, row_number() OVER (PARTITION BY p_partkey ORDER BY rank, length(alias) DESC, alias) AS rn FROM t LEFT JOIN a ON contains(said, ' ' || alias || ' ') AND (rank = 2 OR (mk = upper(make) AND md = upper(model) AND year BETWEEN y0 AND y1)))
SELECT p_partkey, title, CASE WHEN name IS NOT NULL THEN name WHEN model = 'CX-5' AND contains(title, 'Signature') THEN 'SIGNATURE' WHEN model = 'M3' THEN 'M3_COMPETITION' || CASE WHEN contains(title, 'xDrive') THEN '_XDRIVE' ELSE '' END ELSE 'UNKNOWN_TRIM' END AS canonical_trim,
       CASE WHEN name IS NOT NULL THEN 'title_alias' WHEN model = 'CX-5' AND NOT contains(title, 'Signature') THEN 'unresolved' ELSE 'title_remainder' END AS canonical_trim_source,
       CASE WHEN name IS NOT NULL THEN 'medium' WHEN model = 'CX-5' AND NOT contains(title, 'Signature') THEN 'unresolved' ELSE 'medium' END AS canonical_match_confidence
FROM h WHERE rn = 1
"""
)


@query("i04_i07_trim_aliases", _I04)
def i04(m):
    """Every part under one of twelve titles and a year: aliases scoped by make,
    model and years, general ones, the remainder, and nothing; how sure each is."""
    at = F.col("p_partkey") % len(_CARS)
    pick = lambda i: F.array(*[F.lit(c[i]) for c in _CARS])[at.cast("int")]
    year = (F.col("p_partkey") % 31 + 2001).cast("int")
    rows = m.part.select("p_partkey", F.trim(F.concat_ws(" ", year, pick(0), pick(1), pick(2))).alias("title"), pick(0).alias("make"), pick(1).alias("model"), year.alias("year"), F.lit(None).cast("string").alias("trim"))
    return identity.parse_titles(rows).select("p_partkey", "title", "canonical_trim", "canonical_trim_source", "canonical_match_confidence")


_MONTHS = "SELECT canonical_make, date_trunc('month', history_date)::DATE AS month_start, median(price) AS median_price, avg(mileage) AS avg_mileage, count(*) AS volume FROM {price_history} JOIN {identity} USING (vin) GROUP BY 1, 2"
_W08 = f"""
WITH p AS ({_MONTHS})
SELECT canonical_make, month_start, lag(median_price, 1) OVER w AS price_lag_1, lag(median_price, 2) OVER w AS price_lag_2,
  median(median_price) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rolling_median_3,
  round(avg(avg_mileage) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS rolling_mileage_3, round(avg(volume) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS rolling_volume_3,
  lead(month_start, 3) OVER w AS target_month_3m, lead(median_price, 3) OVER w AS target_price_3m
FROM p WINDOW w AS (PARTITION BY canonical_make ORDER BY month_start)
"""


@query("w08_w11_lags_and_leads", _W08)
def w08(m):
    """Lags, leads and rolling statistics of the monthly panel."""
    history = m.price_history.join(m.identity.select("vin", *COHORT), "vin")
    panel = cohort.features(cohort.monthly(history, COHORT), COHORT, (3,))
    return panel.select("canonical_make", "month_start", "price_lag_1", "price_lag_2", "rolling_median_3", F.round("rolling_mileage_3", 4).alias("rolling_mileage_3"), F.round("rolling_volume_3", 6).alias("rolling_volume_3"), "target_month_3m", "target_price_3m")


_A03 = """
SELECT canonical_make, date_trunc('month', history_date)::DATE AS month_start, median(price) AS median_price, round(avg(price), 4) AS avg_price, quantile_cont(price, 0.25) AS p25_price, quantile_cont(price, 0.75) AS p75_price,
  round(avg(mileage), 4) AS avg_mileage, median(mileage) AS median_mileage, count(*) AS volume, count(DISTINCT vin) AS unique_vins, round(avg(canonical_year), 6) AS avg_canonical_year, round(avg(base_price), 4) AS avg_base_price
FROM {price_history} JOIN {identity} USING (vin) GROUP BY 1, 2
"""
_A03_MODES = """
WITH h AS (SELECT canonical_make, date_trunc('month', history_date)::DATE AS month_start, trend, body_class FROM {price_history} JOIN {identity} USING (vin)),
t AS (SELECT canonical_make, month_start, trend, row_number() OVER (PARTITION BY canonical_make, month_start ORDER BY count(*) DESC, trend) AS rn FROM h GROUP BY 1, 2, 3),
b AS (SELECT canonical_make, month_start, body_class, row_number() OVER (PARTITION BY canonical_make, month_start ORDER BY count(*) DESC, body_class) AS rn FROM h GROUP BY 1, 2, 3)
SELECT m.*, t.trend AS mode_trend, b.body_class AS mode_body_class FROM (_A03_) m JOIN t USING (canonical_make, month_start) JOIN b USING (canonical_make, month_start) WHERE t.rn = 1 AND b.rn = 1
"""


@query("a03_cohort_month_modes_means", _A03_MODES.replace("_A03_", _A03))
def a03(m):
    """The monthly panel with the modes and means of what identifies a cohort."""
    history = m.price_history.join(m.identity.select("vin", *COHORT, "body_class", "canonical_year", "base_price"), "vin")
    panel = cohort.monthly(history, COHORT, modes=("trend", "body_class"), means=("canonical_year", "base_price"))
    return panel.select("canonical_make", "month_start", "median_price", F.round("avg_price", 4).alias("avg_price"), "p25_price", "p75_price", F.round("avg_mileage", 4).alias("avg_mileage"), "median_mileage", "volume", "unique_vins", F.round("avg_canonical_year", 6).alias("avg_canonical_year"), F.round("avg_base_price", 4).alias("avg_base_price"), "mode_trend", "mode_body_class")


_HISTORY = """
SELECT h.vin, history_date, price, mileage, canonical_make, canonical_year AS model_year, body_class, seq,
  CASE WHEN trend = 'R' THEN 'Price drop' WHEN trend = 'N' THEN 'up' END AS trend,
  CASE WHEN seq % 3 = 0 THEN 'fwd' WHEN seq % 3 = 1 THEN 'awd' END AS drive_type, CASE WHEN seq % 5 < 3 THEN 'gas' ELSE 'diesel ' END AS fuel_type, CASE WHEN seq % 4 = 0 THEN '' ELSE 'none' END AS electrification_level,
  CASE WHEN mileage > 20000 THEN 'dealer' ELSE 'private' END AS seller_type, CASE WHEN price % 2 = 0 THEN 'site a' ELSE 'site b' END AS source_name,
  CASE WHEN seq % 6 > 0 THEN CAST(seq % 100 AS DOUBLE) / 100 END AS sentiment_score, CASE WHEN seq % 2 = 0 THEN seq % 9 END AS sentiment_comment_count, CASE WHEN seq % 3 = 0 THEN seq % 4 END AS sentiment_video_count,
  CASE WHEN seq % 7 > 0 THEN 100 + seq % 200 END AS engine_hp, 4 + seq % 3 * 2 AS engine_cylinders, seq % 5 AS total_recalls, seq % 11 AS total_complaints
FROM {price_history} h JOIN {identity} i ON h.vin = i.vin
"""
_A03_FULL = "WITH h AS (" + _HISTORY + """),
a AS (SELECT *, date_trunc('month', history_date)::DATE AS month_start, greatest(date_diff('day', make_date(model_year::BIGINT, 1, 1), history_date) / 30.4375, 0) AS age FROM h),
""" + ",\n".join(f"m_{c} AS (SELECT canonical_make, month_start, v, row_number() OVER (PARTITION BY canonical_make, month_start ORDER BY (v IS NULL)::INT, count(*) DESC, v) AS rn FROM (SELECT canonical_make, month_start, nullif(upper(trim({c})), '') AS v FROM a) GROUP BY 1, 2, 3)" for c in cohort.PANEL_MODES) + """
SELECT a.canonical_make, a.month_start, median(price) AS median_price, count(*) AS volume, """ + ", ".join(f"coalesce(max(m_{c}.v), 'UNKNOWN') AS mode_{c}" for c in cohort.PANEL_MODES) + """,
  round(avg(age), 6) AS avg_vehicle_age_months, round(avg(mileage / greatest(age / 12, 0.25)), 4) AS avg_miles_per_year, round(avg(CASE WHEN regexp_matches(lower(coalesce(trend, '')), 'down|drop|decrease') THEN 1 ELSE 0 END), 6) AS avg_price_down,
  round(avg(sentiment_score), 6) AS avg_sentiment_score, round(avg(coalesce(sentiment_comment_count, 0)), 6) AS avg_sentiment_comment_count, round(avg(coalesce(sentiment_video_count, 0)), 6) AS avg_sentiment_video_count,
  median(engine_hp) AS median_engine_hp, median(engine_cylinders) AS median_engine_cylinders, median(total_recalls) AS median_total_recalls, median(total_complaints) AS median_total_complaints
FROM a """ + " ".join(f"JOIN m_{c} ON m_{c}.canonical_make = a.canonical_make AND m_{c}.month_start = a.month_start AND m_{c}.rn = 1" for c in cohort.PANEL_MODES) + " GROUP BY 1, 2"


@query("a03_full_panel", _A03_FULL)
def a03_full(m):
    """All statistics of the panel, over a history with its further columns."""
    history = m.spark.sql(_HISTORY.replace("{price_history} h", "{h} h").replace("{identity} i", "{i} i"), h=m.price_history, i=m.identity)
    panel = cohort.full_panel(history, COHORT)
    rounded = {f"avg_{c}": 4 if c == "miles_per_year" else 6 for c in cohort.PANEL_MEANS}
    return panel.select("canonical_make", "month_start", "median_price", "volume", *[f"mode_{c}" for c in cohort.PANEL_MODES], *[F.round(c, n).alias(c) for c, n in rounded.items()], *[f"median_{c}" for c in cohort.PANEL_MEDIANS])


@query("p17_column_kinds", "SELECT * FROM (VALUES ('p_partkey', 'numeric'), ('p_size', 'numeric'), ('p_retailprice', 'numeric'), ('p_brand', 'low'), ('p_name', 'high')) v(name, kind) WHERE name <> 'p_brand' OR (SELECT count(DISTINCT p_brand) FROM part) <= 50")
def p17(m):
    """Numeric columns, and texts with at most and with more than 50 values."""
    kinds = features.column_kinds(m.part.select("p_partkey", "p_size", "p_retailprice", "p_brand", "p_name"))
    return m.spark.createDataFrame([(n, k) for k, names in kinds.items() for n in names], "name string, kind string")


@query("j19_exact_catalog_match", "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_size % 5, p_brand, p_type) AS epa_vehicle_id FROM part")
def j19(m):
    """Every part finds its catalog entry by year, make and model."""
    none = F.lit(None).cast("string")
    rows = _catalog(m).select(F.col("id").alias("p_partkey"), F.concat_ws(" ", "year", "make", "model").alias("title"), "make", "model", "year", none.alias("trim"))
    return identity.parse_titles(rows, _catalog(m)).select("p_partkey", "epa_vehicle_id")
