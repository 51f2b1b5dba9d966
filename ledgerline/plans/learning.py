"""Models, forecasts and backtests, and the streaming forms run to completion."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import artifacts, cohort, encoders, features, forecast, kpi, models, search, seasonal
from ledgerline.plans.registry import query
from ledgerline.session import cut_lineage, new_folder, written
from ledgerline.sources import samples
from ledgerline.streaming import changes

COHORT = ["canonical_make"]
NUMERIC = ["median_price", "price_lag_1", "rolling_median_3", "market_index", "cohort_age_months"]


def _rows(m):
    return m.listings.join(m.identity.select("vin", "canonical_make", "canonical_model", "canonical_year"), "vin")


def _panel(m):
    h = m.price_history.join(m.identity.select("vin", *COHORT), "vin")
    # one row per cohort and month: written once, as fits and forecasts read it many times
    return cut_lineage(cohort.features(cut_lineage(cohort.monthly(h, COHORT, ident=None)), COHORT, (1,)))


@query("m01_m08_price_champion")
def m08(m):
    """Searches four families on time-split listings; scored test rows of the best."""
    # the joins are run once, for the columns that are used; the split reads its rows four times, the search and its errors read both parts
    rows = written(_rows(m).select("vin", "seq", "loaddate", "price", "mileage", "canonical_year", "seller_type", "canonical_model"))
    rows = written(samples.split_by_time(rows, "vin", "loaddate", least_train=1, least_test=1).drop("loaddate").where("part is not null"))
    _, _, scored = models.train_price_models(rows, ["mileage", "canonical_year"], ["seller_type"], ["canonical_model"], "price", "vin")
    return scored.select("vin", "seq", "price", F.round("prediction", 2).alias("prediction"))


_M01 = """
WITH l AS (SELECT seq, coalesce(source_name, 'UNKNOWN') AS v, coalesce(upper(title_desc), 'UNKNOWN') AS d, ln(1 + price) AS y, location_code FROM {listings}),
c AS (SELECT v, count(*) AS n FROM l GROUP BY v),
r AS (SELECT v, row_number() OVER (ORDER BY n DESC, v) AS place FROM c WHERE n >= 10),
k AS (SELECT CASE WHEN (SELECT count(*) FROM c) > (SELECT count(*) FROM r) OR (SELECT count(*) FROM r) > 25 THEN 24 ELSE 25 END AS most),
t AS (SELECT location_code, count(*) AS n, avg(y) AS mean FROM l GROUP BY 1),
p AS (SELECT avg(y) AS prior FROM l)
SELECT seq, CASE WHEN place <= most THEN v ELSE '(infrequent)' END AS slot, round(prior * (1 - 1 / (1 + exp((20 - n) / 10.0))) + mean / (1 + exp((20 - n) / 10.0)), 6) AS encoded
FROM l LEFT JOIN r USING (v) JOIN t USING (location_code), k, p
"""


@query("m01_encodings", _M01)
def m01(m):
    """Slot of each listing's source and blended mean of its location."""
    rows = m.listings.select("seq", "source_name", F.col("location_code"), F.log1p(F.col("price")).alias("log_label"))
    hot = encoders.FrequentOneHot(inputCol="source_name", outputCol="hot").fit(rows)
    mean = encoders.SigmoidTarget(inputCol="location_code", outputCol="encoded", labelCol="log_label").fit(rows)
    names = F.array(*[F.lit(x.split("=", 1)[1]) for x in hot.slots()])
    return mean.transform(rows).select("seq", F.get(names, hot.slot_of() - 1).alias("slot"), F.round("encoded", 6).alias("encoded"))


@query("k12_m10_m12_saved_model")
def saved(m):
    """Saves the best linear model, loads it by name and scores at most 100 rows
    of one make; the weights of the loaded one come along as text."""
    rows = _rows(m)
    found = search.grouped_search(rows, encoders.price_stages(["mileage", "canonical_year"], ["seller_type"], ["canonical_model"]), "price", "vin", ("ridge", "elastic_net"))
    best = min(found.values(), key=lambda f: (f.error, f.family))
    root = _folder(m.spark)
    artifacts.save_model(root, "price", best.model, {"family": best.family, "error": best.error, **best.best})
    model, facts = artifacts.load_model(m.spark, root, "price")
    top = models.feature_weights(model, 3)
    scored = models.score_filtered(model, rows.select("vin", "seq", "price", "mileage", "canonical_year", "seller_type", "canonical_model"), F.col("canonical_year") == 1990, "seq")
    return scored.select("vin", "seq", "price", F.round("prediction", 2).alias("prediction"), F.lit(facts["family"]).alias("family"), F.lit(facts["version"]).alias("version"), F.lit(", ".join(n for n, _, _ in top)).alias("top_inputs"))


@query("m02_routed_experts")
def m02(m):
    """Experts for high and other prices behind a classifier."""
    rows = m.listings.select("vin", "seq", "price", "mileage", F.length("title").alias("title_length"))
    fitted = models.fit_routed(rows.where("seq % 5 > 0").select("price", "mileage", "title_length"), models.preprocessor(["mileage", "title_length"]), "price", threshold=80_000)
    return fitted.predict(rows.where("seq % 5 = 0")).select("vin", "seq", "price", F.round("prediction", 2).alias("prediction"))


@query("m05_tuned_forecast")
def m05(m):
    """Parameters of the change model by a holdout in time, then the next month of every cohort."""
    panel = _panel(m)
    best, _ = forecast.tune_change_model(panel, NUMERIC, 1, COHORT)
    return forecast.direct_forecast(forecast.fit_change_model(panel, NUMERIC, "target_change_1m", params=best), panel, COHORT, 1)


@query("m09_feature_space")
def m09(m):
    """Counts of the vectors that the price model's stages make of all listings."""
    rows = m.listings.join(m.identity.select("vin", "canonical_model", "canonical_year"), "vin").select("mileage", "canonical_year", "seller_type", "canonical_model", F.col("price").cast("double").alias("label"))
    found = features.feature_space(rows, models.preprocessor(["mileage", "canonical_year"], ["seller_type"], ["canonical_model"]))
    counts = [(k, float(v)) for k, v in found.items() if k != "top_cardinality"] + [(f"distinct_{c}", float(n)) for c, n in found["top_cardinality"]]
    return m.spark.createDataFrame(counts, "measure string, value double")


@query("t08_global_backtest")
def t08(m):
    """Expanding rolling origins over the cohort panel, and their metrics by model."""
    panel = _panel(m)
    origins = [r[0] for r in cohort.eligible_origins(panel, COHORT, "target_price_1m", 6).collect()]
    rows = forecast.global_backtest(panel, COHORT, NUMERIC, 1, sorted(origins))
    return kpi.kpi_scopes(rows, ["model_family"], COHORT)


_T08_SUMS = """
WITH h AS (SELECT canonical_make AS k, date_trunc('month', history_date)::DATE AS m, quantile_cont(price, 0.5) AS v, avg(price) AS a
           FROM {price_history} p JOIN {identity} i ON p.vin = i.vin GROUP BY 1, 2),
l AS (SELECT *, lead(m) OVER w AS ends, lead(v) OVER w / nullif(v, 0) - 1 AS y, lag(v) OVER w AS lag, row_number() OVER w AS n FROM h WINDOW w AS (PARTITION BY k ORDER BY m)),
o AS (SELECT DISTINCT m AS origin FROM l WHERE n >= 6 AND ends IS NOT NULL)
SELECT origin, count(*)::BIGINT AS n, round(avg(v), 4) AS price, round(avg(y), 8) AS change, round(avg(y * y), 8) AS change_2, round(avg(v * y), 4) AS price_change, round(avg(v * lag), 0) AS price_lag
FROM o JOIN l ON l.ends <= o.origin WHERE y IS NOT NULL AND lag IS NOT NULL GROUP BY 1
"""


@query("t08_origin_sums", _T08_SUMS)
def t08_sums(m):
    """Means of products over every origin's training rows, from one pass and running sums."""
    panel = _panel(m)
    origins = sorted(r[0] for r in cohort.eligible_origins(panel, COHORT, "target_price_1m", 6).collect())
    rows = panel.withColumn("__ends", F.unix_date(F.col("target_month_1m").cast("date")))
    days = [(o - datetime.date(1970, 1, 1)).days for o in origins]
    sums = forecast.expanding_sums(rows, ["median_price", "price_lag_1"], "target_change_1m", days)
    cell = lambda i, j: F.sum(F.when((F.col("i") == i) & (F.col("j") == j), F.col("value")))
    n = cell(0, 0)
    return sums.groupBy(F.date_from_unix_date(F.col("origin").cast("int")).alias("origin")).agg(n.cast("long").alias("n"), *[F.round(cell(i, j) / n, d).alias(c) for c, i, j, d in (("price", 0, 1, 4), ("change", 0, 3, 8), ("change_2", 3, 3, 8), ("price_change", 1, 3, 4), ("price_lag", 1, 2, 0))])


_SERIES = """
WITH h AS (SELECT canonical_make AS k, date_trunc('month', history_date)::DATE AS m, quantile_cont(price, 0.5) AS v FROM {price_history} p JOIN {identity} i ON p.vin = i.vin GROUP BY 1, 2),
g AS (SELECT k, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH))::DATE AS m FROM h GROUP BY k),
j AS (SELECT g.k, g.m, v, year(g.m) * 12 + month(g.m) AS a FROM g LEFT JOIN h ON g.k = h.k AND g.m = h.m),
f AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN struct_pack(a := a, v := v) END IGNORE NULLS) OVER (PARTITION BY k ORDER BY m) AS lo,
             first_value(CASE WHEN v IS NOT NULL THEN struct_pack(a := a, v := v) END IGNORE NULLS) OVER (PARTITION BY k ORDER BY m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM j),
y AS (SELECT k, m, v IS NOT NULL AS seen, coalesce(v, lo.v + (hi.v - lo.v) * (a - lo.a) / (hi.a - lo.a)) AS y FROM f)
"""
_T09 = _SERIES + """,
n AS (SELECT *, row_number() OVER w AS n, first_value(y) OVER w AS y0, lag(y, 9) OVER w AS back, lead(y, 3) OVER w AS actual, lead(m, 3) OVER w AS later, lead(seen, 3) OVER w AS seen3 FROM y WINDOW w AS (PARTITION BY k ORDER BY m)),
o AS (SELECT * FROM n WHERE n >= 6 AND seen AND seen3)
SELECT k AS canonical_make, m AS origin_month, later AS forecast_month, y AS naive, actual, greatest(y + (y - y0) / (n - 1) * 3, 0) AS predicted, 'drift' AS model_family FROM o
UNION ALL SELECT k, m, later, y, actual, CASE WHEN n >= 12 THEN back ELSE y END, 'seasonal_naive' FROM o
"""


@query("t09_local_backtest", _T09)
def t09(m):
    """Per-cohort forecasters at every origin, one task per cohort's series."""
    series = cohort.calendar_series(_panel(m), COHORT)
    rows, _ = forecast.run_families(series, COHORT, ["drift", "seasonal_naive", "prophet"], 3)
    return rows


_M07 = _SERIES + """,
d AS (SELECT *, y - lag(y) OVER w AS d, row_number() OVER w AS n FROM y WINDOW w AS (PARTITION BY k ORDER BY m)),
z AS (SELECT *, d - lag(d, 12) OVER w AS z FROM d WINDOW w AS (PARTITION BY k ORDER BY m)),
l AS (SELECT *, lag(z) OVER w AS x, lag(z, 12) OVER w AS u FROM z WINDOW w AS (PARTITION BY k ORDER BY m)),
c AS (SELECT k, var_pop(x) AS a, covar_pop(x, u) AS b, var_pop(u) AS c, covar_pop(x, z) AS p, covar_pop(u, z) AS q, avg(x) AS mx, avg(u) AS mu, avg(z) AS mz FROM l WHERE z IS NOT NULL AND x IS NOT NULL AND u IS NOT NULL GROUP BY k),
w AS (SELECT *, (c * p - b * q) / (a * c - b * b) AS phi, (a * q - b * p) / (a * c - b * b) AS sphi FROM c),
t AS (SELECT l.*, lag(z, 11) OVER o AS z12, lag(d, 11) OVER o AS d12, row_number() OVER (PARTITION BY k ORDER BY m DESC) AS back FROM l WINDOW o AS (PARTITION BY k ORDER BY m))
SELECT t.k AS canonical_make, m AS month_start, n::BIGINT AS n_months, round(mz - phi * mx - sphi * mu, 3) AS intercept, round(phi, 6) AS phi, round(sphi, 6) AS seasonal_phi,
       round(greatest(y + (mz - phi * mx - sphi * mu) + phi * z + sphi * z12 + d12, 0), 2) AS next_price
FROM t JOIN w ON t.k = w.k WHERE back = 1
"""


@query("m07_seasonal_ar", _M07)
def m07(m):
    """Seasonal autoregression of every cohort at its last month, one step on."""
    fitted = seasonal.seasonal_ar(cohort.calendar_series(_panel(m), COHORT), COHORT)
    last = fitted.withColumn("__back", F.row_number().over(Window.partitionBy(*COHORT).orderBy(F.desc("month_start")))).where("__back = 1")
    step = seasonal.forecast_ar(last, 1)[0]
    return last.select(*COHORT, "month_start", "n_months", F.round("intercept", 3).alias("intercept"), F.round("phi", 6).alias("phi"), F.round("seasonal_phi", 6).alias("seasonal_phi"), F.round(step, 2).alias("next_price"))


@query("t10_recursive_forecast")
def t10(m):
    """Sixty months ahead, each step fed back into the next."""
    panel = _panel(m)
    return forecast.recursive_forecast(forecast.fit_change_model(panel, NUMERIC, "target_change_1m"), panel, COHORT, 60)


@query("t11_direct_forecast")
def t11(m):
    panel = _panel(m)
    return forecast.direct_forecast(forecast.fit_change_model(panel, NUMERIC, "target_change_1m"), panel, COHORT, 1)


@query("ext_windowed_stream", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed(m):
    """Event-time windows over the events as a stream, run to its end."""
    stream = m.spark.readStream.schema(m.events.schema).option("pathGlobFilter", "events.parquet").parquet(m.folder)
    counts = changes.windowed_counts(stream.withColumn("at", F.col("ts").cast("timestamp")), "at", "event_type", "value")
    path = _folder(m.spark)
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return m.spark.read.parquet(f"{path}/out").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


_T02 = """
WITH e AS (SELECT user_id, event_id, floor(value)::DOUBLE AS price, length(event_type)::DOUBLE AS mileage FROM events),
l AS (SELECT *, lag(price) OVER w AS p, lag(mileage) OVER w AS q, row_number() OVER w AS rn FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, price, mileage FROM l WHERE rn = 1 OR price IS DISTINCT FROM p OR mileage IS DISTINCT FROM q
"""


@query("t02_change_stream", _T02)
def t02(m):
    """Change detection with keyed state over micro-batches."""
    stream = m.spark.readStream.schema(m.events.schema).option("pathGlobFilter", "events.parquet").parquet(m.folder)
    rows = stream.select("user_id", "event_id", F.floor("value").cast("double").alias("price"), F.length("event_type").cast("double").alias("mileage"))
    path = _folder(m.spark)
    start = lambda: changes.emit_changes_stream(rows, "user_id", "event_id", ("price", "mileage"), path, f"{path}/state")
    changes.append_until_idle(start, pause=0.0)
    return m.spark.read.schema(rows.schema).parquet(f"{path}/out/*")


def _folder(spark) -> str:
    """A new folder that driver and executors share."""
    return new_folder(spark, "stream")
