"""Aggregations, windows, panels and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import cleaning, cohort, history, kpi
from ledgerline.plans.registry import query

KEYS = ["canonical_make", "canonical_model"]
_H = "{price_history} h JOIN {identity} i ON h.vin = i.vin"
_MONTHLY = f"SELECT canonical_make, canonical_model, date_trunc('month', history_date)::DATE AS month_start, median(price) AS median_price, avg(price) AS avg_price, quantile_cont(price, 0.25) AS p25_price, quantile_cont(price, 0.75) AS p75_price, avg(mileage) AS avg_mileage, median(mileage) AS median_mileage, count(*) AS volume, count(DISTINCT h.vin) AS unique_vins FROM {_H} GROUP BY 1, 2, 3"
_PANEL = f"m AS ({_MONTHLY}), ix AS (SELECT month_start, median(median_price) AS market_median, sum(volume)::BIGINT AS market_volume FROM m GROUP BY 1), ib AS (SELECT *, market_median / first(market_median) OVER (ORDER BY month_start) AS market_index FROM ix)"
_W = "PARTITION BY canonical_make, canonical_model ORDER BY month_start"


def _history(m):
    return m.price_history.join(m.identity.select("vin", *KEYS, "canonical_year", "canonical_trim", "body_class"), "vin")


def _panel(m):
    return cohort.monthly(_history(m), KEYS)


def _rounded(df, *columns, n=4):
    return df.withColumns({c: F.round(c, n) for c in columns})


@query("a03_cohort_month", f"SELECT canonical_make, canonical_model, month_start, round(median_price, 4) AS median_price, round(avg_price, 4) AS avg_price, round(p25_price, 4) AS p25_price, round(p75_price, 4) AS p75_price, round(avg_mileage, 4) AS avg_mileage, round(median_mileage, 4) AS median_mileage, volume, unique_vins FROM ({_MONTHLY})")
def a03(m):
    return _rounded(_panel(m), "median_price", "avg_price", "p25_price", "p75_price", "avg_mileage", "median_mileage")


@query("a04_mode_smallest_tie", "WITH c AS (SELECT canonical_make, upper(trim(canonical_trim)) AS v, count(*) AS n FROM {identity} WHERE trim(canonical_trim) <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY canonical_make ORDER BY n DESC, v) AS rn FROM c) SELECT canonical_make, v AS usual_trim FROM r WHERE rn = 1")
def a04(m):
    return m.identity.groupBy("canonical_make").agg(cohort.mode_or_unknown("canonical_trim").alias("usual_trim"))


@query("a05_market_index", f"WITH {_PANEL} SELECT month_start, round(market_median, 4) AS market_median, market_volume, round(market_index, 6) AS market_index FROM ib")
def a05(m):
    return cohort.market_index(_panel(m)).select("month_start", F.round("market_median", 4).alias("market_median"), "market_volume", F.round("market_index", 6).alias("market_index"))


_FORECASTS = "SELECT l_shipmode_model AS model, horizon, cohort, actual, predicted, naive FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'global' ELSE 'drift' END AS l_shipmode_model, l_linenumber % 3 AS horizon, l_returnflag AS cohort, l_extendedprice AS actual, l_extendedprice * (1 - l_discount) AS predicted, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_quantity * 1500.0 END AS naive FROM lineitem)"
_METRICS = "count(*) AS n_rows, round(avg(abs(predicted - actual)), 4) AS mae, round(sqrt(avg((predicted - actual) ** 2)), 4) AS rmse, round(avg(predicted - actual), 4) AS bias, round(1 - sum((predicted - actual) ** 2) / nullif(sum(actual * actual) - sum(actual) * sum(actual) / count(*), 0), 6) AS r2, round(sum(abs(predicted - actual)) / nullif(sum(abs(actual)), 0), 6) AS wape, round(avg(abs(naive - actual)), 4) AS naive_mae, round(sum(abs(naive - actual)) / nullif(sum(abs(actual)), 0), 6) AS naive_wape, round(1 - avg(abs(predicted - actual)) / nullif(avg(abs(naive - actual)), 0), 6) AS skill"


def _forecasts(m):
    return m.lineitem.select(
        F.when(F.col("l_linenumber") % 2 == 0, "global").otherwise("drift").alias("model"),
        (F.col("l_linenumber") % 3).alias("horizon"),
        F.col("l_returnflag").alias("cohort"),
        F.col("l_extendedprice").alias("actual"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("predicted"),
        F.when(F.col("l_orderkey") % 9 != 0, F.col("l_quantity") * 1500.0).alias("naive"),
    )


@query("a06_a07_kpi_scopes", f"WITH f AS ({_FORECASTS}), g AS (SELECT * FROM f WHERE naive IS NOT NULL) SELECT model, horizon, cohort, 'cohort_horizon' AS scope, {_METRICS} FROM g GROUP BY 1, 2, 3 UNION ALL SELECT model, horizon, NULL, 'model_horizon', {_METRICS} FROM g GROUP BY 1, 2")
def a07(m):
    return _rounded(_rounded(kpi.kpi_scopes(_forecasts(m), ["model", "horizon"], ["cohort"]), "mae", "rmse", "bias", "naive_mae"), "r2", "wape", "naive_wape", "skill", n=6)


@query("a08_regression_metrics", f"WITH f AS ({_FORECASTS}) SELECT model, round(avg(abs(predicted - actual)), 4) AS mae, round(sqrt(avg((predicted - actual) ** 2)), 4) AS rmse, round(sqrt(avg((ln(1 + greatest(predicted, 0)) - ln(1 + greatest(actual, 0))) ** 2)), 6) AS rmsle, round(avg(abs((predicted - actual) / nullif(actual, 0))), 6) AS mape, round(1 - sum((predicted - actual) ** 2) / nullif(sum(actual * actual) - sum(actual) * sum(actual) / count(*), 0), 6) AS r2 FROM f GROUP BY 1")
def a08(m):
    return _rounded(_rounded(_forecasts(m).groupBy("model").agg(*kpi.regression_metrics("actual", "predicted")), "mae", "rmse"), "rmsle", "mape", "r2", n=6)


@query("a09_segment_metrics", f"WITH f AS ({_FORECASTS}) SELECT 'model' AS segment, model AS value, count(*) AS n_rows, round(avg(abs(predicted - actual)), 4) AS mae FROM f GROUP BY 2 UNION ALL SELECT 'cohort', cohort, count(*), round(avg(abs(predicted - actual)), 4) FROM f GROUP BY 2 UNION ALL SELECT 'horizon', horizon::VARCHAR, count(*), round(avg(abs(predicted - actual)), 4) FROM f GROUP BY 2")
def a09(m):
    return _rounded(kpi.segment_metrics(_forecasts(m), ["model", "cohort", "horizon"], "actual", "predicted"), "mae")


@query("a12_a13_vin_support", "SELECT vin, count(*) AS n_listings, count(DISTINCT source_name) + max(CASE WHEN source_name IS NULL THEN 1 ELSE 0 END) AS n_sources FROM {listings} GROUP BY 1")
def a12(m):
    return m.listings.groupBy("vin").agg(F.count("*").alias("n_listings"), (F.count_distinct("source_name") + F.max(F.col("source_name").isNull().cast("int"))).alias("n_sources"))


@query("a15_latest_values", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY loaddate DESC, price DESC) AS rn FROM {listings}) SELECT vin, loaddate, price FROM r WHERE rn = 1")
def a15(m):
    return history.latest_values(m.listings, "vin", "loaddate", "price")


@query("a16_earliest_price", "WITH r AS (SELECT vin, price, row_number() OVER (PARTITION BY vin ORDER BY history_date, price) AS rn FROM {listing_history} WHERE price > 0) SELECT vin, price AS earliest FROM r WHERE rn = 1")
def a16(m):
    return history.earliest_price(m.listing_history, "vin", "history_date", "price", "earliest")


@query("a18_cohort_daily", "SELECT history_date, median(price) AS median_price, round(avg(price), 4) AS mean_price, count(DISTINCT h.vin) AS vins, count(*) AS n FROM " + _H + " WHERE canonical_make = 'BRAND#3' GROUP BY 1")
def a18(m):
    return _history(m).where("canonical_make = 'BRAND#3'").groupBy("history_date").agg(F.percentile("price", 0.5).alias("median_price"), F.round(F.avg("price"), 4).alias("mean_price"), F.count_distinct("vin").alias("vins"), F.count("*").alias("n"))


@query("a22_distribution", "SELECT coalesce(canonical_trim, 'NULL') AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM {identity} GROUP BY 1")
def a22(m):
    return _rounded(kpi.distribution(m.identity, "canonical_trim"), "share", n=6)


@query("a24_percentile_rank", "SELECT round(avg(CASE WHEN l_extendedprice <= 30000 THEN 1.0 ELSE 0.0 END), 6) AS percentile_rank FROM lineitem")
def a24(m):
    return _rounded(kpi.percentile_rank(m.lineitem, "l_extendedprice", 30000), "percentile_rank", n=6)


@query("a25_rare_to_other", "WITH n AS (SELECT p_brand, count(*) AS k FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN k >= 0.04 * (SELECT count(*) FROM part) THEN p_brand ELSE 'Other' END AS p_brand FROM part JOIN n USING (p_brand)")
def a25(m):
    return cleaning.reduce_cardinality(m.part.select("p_partkey", "p_brand"), ["p_brand"], 0.04)


@query("a26_top_cohorts", f"WITH m AS ({_MONTHLY}), s AS (SELECT canonical_make, canonical_model, count(DISTINCT month_start) AS months, sum(volume)::BIGINT AS total_volume, max(month_start) AS last_month, arg_max(unique_vins, month_start) AS last_vins FROM m GROUP BY 1, 2) SELECT * FROM s ORDER BY months DESC, total_volume DESC, last_month DESC, last_vins DESC, canonical_make, canonical_model LIMIT 25")
def a26(m):
    return cohort.top_cohorts(_panel(m), KEYS, 25)


@query("a27_describe", "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1")
def a27(m):
    return _rounded(kpi.describe(m.lineitem, "l_returnflag", "l_extendedprice"), "mean", "std", "p10", "p25", "p50", "p75", "p90")


@query("a28_pivot_segments", f"WITH f AS ({_FORECASTS}), p AS (SELECT model, avg(abs(predicted - actual)) FILTER (cohort = 'A') AS a, avg(abs(predicted - actual)) FILTER (cohort = 'R') AS r FROM f GROUP BY 1) SELECT model, round(a, 4) AS \"A\", round(r, 4) AS \"R\", round(r / a, 6) AS ratio FROM p")
def a28(m):
    return _rounded(_rounded(kpi.segment_table(_forecasts(m), "model", "cohort", ["A", "R"], "actual", "predicted"), "A", "R"), "ratio", n=6)


@query("a29_unpivot", "SELECT c_custkey, 'acctbal' AS metric, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::DOUBLE FROM customer")
def a29(m):
    return kpi.long_metrics(m.customer.select("c_custkey", F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").cast("double").alias("nation")), ["c_custkey"], ["acctbal", "nation"])


@query("a32_histogram", "WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 40)) + 1, 40)::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1")
def a32(m):
    return kpi.histogram(m.lineitem, "l_extendedprice", 40)


@query("a33_cardinality", "SELECT count(DISTINCT p_brand) AS p_brand, count(DISTINCT p_type) AS p_type, count(DISTINCT p_name) AS p_name FROM part")
def a33(m):
    return m.part.agg(*[F.count_distinct(c).alias(c) for c in ("p_brand", "p_type", "p_name")])


@query("a35_date_quantile", "SELECT quantile_cont(epoch_us(l_shipdate), 0.8)::BIGINT AS cutoff_us FROM lineitem")
def a35(m):
    return m.lineitem.agg(F.round(F.percentile(F.unix_micros(F.col("l_shipdate").cast("timestamp")), 0.8)).cast("long").alias("cutoff_us"))


@query("a36_rollup", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def a36(m):
    return kpi.rollup_counts(m.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity")


@query("w01_latest_row", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY loaddate DESC, date DESC, seq DESC, price DESC) AS rn FROM {listings}) SELECT vin, loaddate, price, title FROM r WHERE rn = 1")
def w01(m):
    return history.latest(m.listings, "vin", F.desc("loaddate"), F.desc("date"), F.desc("seq"), F.desc("price")).select("vin", "loaddate", "price", "title")


@query("w05_fill_both_ways", "WITH h AS (SELECT vin, history_date, seq, price, mileage, row_number() OVER (PARTITION BY vin ORDER BY history_date, seq, price, mileage NULLS LAST) AS rn FROM {price_history}) SELECT vin, history_date, seq, price, coalesce(last_value(mileage IGNORE NULLS) OVER (PARTITION BY vin ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(mileage IGNORE NULLS) OVER (PARTITION BY vin ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS mileage FROM h")
def w05(m):
    order = [F.asc("history_date"), F.asc("seq"), F.asc("price"), F.asc_nulls_last("mileage")]
    return history.fill_both_ways(m.price_history, "vin", order, "mileage").select("vin", "history_date", "seq", "price", "mileage")


_FEATURES = f"""WITH {_PANEL}, j AS (SELECT m.*, market_index FROM m JOIN ib USING (month_start)),
f AS (SELECT *, row_number() OVER w - 1 AS cohort_month_number, first(median_price) OVER w AS fp, lag(median_price, 1) OVER w AS price_lag_1, lag(median_price, 2) OVER w AS price_lag_2,
 median(median_price) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rolling_median_3, avg(avg_mileage) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rolling_mileage_3, avg(volume) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rolling_volume_3,
 lead(month_start, 1) OVER w AS target_month_1m, lead(median_price, 1) OVER w AS target_price_1m, lead(median_price, 3) OVER w AS target_price_3m FROM j WINDOW w AS ({_W})),
g AS (SELECT *, median_price / nullif(price_lag_1, 0) - 1 AS change FROM f)
SELECT canonical_make, canonical_model, month_start, month(month_start)::INT AS month, cohort_month_number::INT AS cohort_month_number, round(median_price / nullif(fp, 0), 6) AS price_index, round(price_lag_1, 4) AS price_lag_1, round(price_lag_2, 4) AS price_lag_2, round(rolling_median_3, 4) AS rolling_median_3,
 round(rolling_mileage_3, 4) AS rolling_mileage_3, round(rolling_volume_3, 4) AS rolling_volume_3, round(avg(change) OVER (PARTITION BY canonical_make, canonical_model ORDER BY month_start ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS rolling_change_3,
 target_month_1m, round(target_price_1m / nullif(median_price, 0) - 1, 6) AS target_change_1m, round(target_price_3m / nullif(median_price, 0) - 1, 6) AS target_change_3m, round(market_index, 6) AS market_index FROM g"""


@query("w06_w12_panel_features", _FEATURES)
def w12(m):
    f = cohort.features(_panel(m), KEYS)
    r = lambda c, n: F.round(c, n).alias(c)
    return f.select(*KEYS, "month_start", "month", "cohort_month_number", r("price_index", 6), r("price_lag_1", 4), r("price_lag_2", 4), r("rolling_median_3", 4), r("rolling_mileage_3", 4), r("rolling_volume_3", 4), r("rolling_change_3", 6), "target_month_1m", r("target_change_1m", 6), r("target_change_3m", 6), r("market_index", 6))


@query("w13_change_from_first", "WITH h AS (SELECT vin, history_date, price, seq, row_number() OVER (PARTITION BY vin ORDER BY history_date, seq, price) AS rn FROM {listing_history}) SELECT vin, history_date, price, seq, price - lag(price) OVER (PARTITION BY vin ORDER BY rn) AS change, price - first(price) OVER (PARTITION BY vin ORDER BY rn) AS change_from_first, round((price - first(price) OVER (PARTITION BY vin ORDER BY rn)) / nullif(first(price) OVER (PARTITION BY vin ORDER BY rn), 0), 6) AS change_share FROM h")
def w13(m):
    c = history.changes(m.listing_history, ["vin"], [F.asc("history_date"), F.asc("seq"), F.asc("price")], "price")
    return c.select("vin", "history_date", "price", "seq", "change", "change_from_first", F.round("change_share", 6).alias("change_share"))


@query("w15_top_per_group", "WITH r AS (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) SELECT c_nationkey, c_custkey, c_acctbal FROM r WHERE rn <= 3")
def w15(m):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return m.customer.select("c_nationkey", "c_custkey", "c_acctbal").withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")


@query("w16_eligible_origins", f"WITH m AS ({_MONTHLY}), r AS (SELECT *, row_number() OVER ({_W}) AS n, lead(median_price) OVER ({_W}) AS target FROM m) SELECT DISTINCT month_start FROM r WHERE n >= 6 AND target IS NOT NULL")
def w16(m):
    p = _panel(m).withColumn("target", F.lead("median_price").over(Window.partitionBy(*KEYS).orderBy("month_start")))
    return cohort.eligible_origins(p, KEYS, "target", 6)


@query("w18_recency", "SELECT vin, loaddate, seq, price, date_diff('day', loaddate, (SELECT max(loaddate) FROM {listings}))::INT AS days FROM {listings}")
def w18(m):
    last = m.listings.agg(F.max("loaddate").alias("last"))
    return m.listings.crossJoin(F.broadcast(last)).select("vin", "loaddate", "seq", "price", F.datediff("last", "loaddate").alias("days"))


@query("w19_calendar_interpolation", f"""WITH m AS ({_MONTHLY}), e AS (SELECT canonical_make, canonical_model, min(month_start) AS a, max(month_start) AS b FROM m GROUP BY 1, 2),
g AS (SELECT canonical_make, canonical_model, unnest(generate_series(a, b, INTERVAL 1 MONTH))::DATE AS month_start FROM e),
j AS (SELECT g.*, m.median_price, year(g.month_start) * 12 + month(g.month_start) AS t FROM g LEFT JOIN m USING (canonical_make, canonical_model, month_start)),
k AS (SELECT *, last_value(CASE WHEN median_price IS NOT NULL THEN t END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0, last_value(median_price IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p0,
 first_value(CASE WHEN median_price IS NOT NULL THEN t END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1, first_value(median_price IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1 FROM j WINDOW w AS ({_W}))
SELECT canonical_make, canonical_model, month_start, round(coalesce(median_price, p0 + (p1 - p0) * (t - t0) / nullif(t1 - t0, 0)), 4) AS median_price, median_price IS NULL AS interpolated FROM k""")  # fmt: skip
def w19(m):
    return _rounded(cohort.calendar_series(_panel(m), KEYS), "median_price")


@query("t01_change_detection", "WITH h AS (SELECT event_id, user_id, ts, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, user_id, event_type FROM h WHERE rn = 1 OR event_type IS DISTINCT FROM before")
def t01(m):
    return history.emit_changes(m.events, "user_id", [F.asc("ts"), F.asc("event_id")], "event_type").select("event_id", "user_id", "event_type")
