"""Report and state queries that round off the inventory."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import dates, text
from ledgerline.operators import cleaning, cohort, history, identity, kpi, sentiment, workqueue
from ledgerline.plans.aggregates import KEYS, _forecasts, _history, _panel, _rounded
from ledgerline.plans.registry import query
from ledgerline.sources import files, samples, upserts

_H = "{price_history} h JOIN {identity} i ON h.vin = i.vin"


@query("p01_p02_keep_and_drop_lists", "SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM orders")
def p01(m):
    return m.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority").drop("o_totalprice", "o_comment")


@query("p05_p06_nulls_and_ranges", "SELECT vin, history_date, price, mileage FROM {price_history} WHERE mileage IS NOT NULL AND price BETWEEN 1000 AND 1000000 AND history_date IS NOT NULL")
def p05(m):
    return cleaning.in_price_range(m.price_history.dropna(subset=["history_date", "mileage"]), "price").select("vin", "history_date", "price", "mileage")


@query("p08_legacy_aliases", "SELECT vin, canonical_make AS make, canonical_model AS model, canonical_trim AS trim_combined FROM {identity}")
def p08(m):
    return cleaning.legacy_aliases(m.identity).select("vin", "make", "model", "trim_combined")


@query("p10_history_bounds", "SELECT h.vin, price, mileage FROM " + _H + " WHERE price >= 1000 AND price <= 90000 AND mileage >= 0 AND canonical_make <> 'UNKNOWN'")
def p10(m):
    return _history(m).where((F.col("price") >= 1000) & (F.col("price") <= 90_000) & (F.col("mileage") >= 0) & (F.col("canonical_make") != "UNKNOWN")).select("vin", "price", "mileage")


@query("p13_complete_cases", "SELECT vin, base_price, canonical_trim FROM {identity} WHERE base_price IS NOT NULL AND canonical_trim IS NOT NULL")
def p13(m):
    return m.identity.dropna(subset=["base_price", "canonical_trim"]).select("vin", "base_price", "canonical_trim")


@query("p18_p20_guards_and_point_lookup", "SELECT vin, history_date, price FROM {price_history} WHERE vin = 'VIN00000011' AND price > 1234")
def p18(m):
    return m.price_history.where((F.col("vin") == "VIN00000011") & (F.col("price") > 1234)).select("vin", "history_date", "price")


@query("p23_trim_proxy", "SELECT vin, coalesce(canonical_trim, 'UNKNOWN_TRIM') AS trim_proxy FROM {identity}")
def p23(m):
    return cleaning.trim_proxy(m.identity).select("vin", "trim_proxy")


@query("j05_key_set_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j05(m):
    return m.orders.select("o_orderkey", "o_custkey").join(m.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")


_MONTHLY = "SELECT canonical_make, canonical_model, date_trunc('month', history_date)::DATE AS month_start, median(price) AS median_price, count(*) AS volume FROM " + _H + " GROUP BY 1, 2, 3"


@query("j10_market_on_panel", f"WITH m AS ({_MONTHLY}), x AS (SELECT month_start, median(median_price) AS market FROM m GROUP BY 1) SELECT canonical_make, canonical_model, m.month_start, round(median_price / nullif(market, 0), 6) AS to_market FROM m JOIN x ON m.month_start = x.month_start")
def j10(m):
    p = _panel(m)
    j = p.join(cohort.market_index(p), "month_start")
    return j.select(*KEYS, "month_start", F.round(F.try_divide("median_price", F.nullif("market_median", F.lit(0.0))), 6).alias("to_market"))


@query("j11_earliest_of_two", "WITH a AS (SELECT vin, arg_min(price, (history_date, price)) AS p FROM {price_history} GROUP BY 1), b AS (SELECT vin, arg_min(price, (history_date, price)) AS p FROM {listing_history} GROUP BY 1) SELECT i.vin, coalesce(CASE WHEN length(i.vin) > 0 AND i.canonical_year > 1991 THEN a.p END, b.p) AS first_price FROM {identity} i LEFT JOIN a ON i.vin = a.vin LEFT JOIN b ON i.vin = b.vin")
def j11(m):
    a = history.earliest_price(m.price_history, "vin", "history_date", "price", "a")
    b = history.earliest_price(m.listing_history, "vin", "history_date", "price", "b")
    j = m.identity.join(a, "vin", "left").join(b, "vin", "left")
    return j.select("vin", F.coalesce(F.when(F.col("canonical_year") > 1991, F.col("a")), F.col("b")).alias("first_price"))


@query("j13_enrichment_left_merge", "SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def j13(m):
    return m.customer.join(m.nation.where("n_regionkey < 3"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "n_name")


@query("j15_a18_cohort_history", "SELECT history_date, round(avg(price), 4) AS mean_price, count(DISTINCT h.vin) AS vins FROM " + _H + " WHERE canonical_make = 'BRAND#9' AND canonical_year = 1991 GROUP BY 1")
def j15(m):
    rows = _history(m).where("canonical_make = 'BRAND#9' AND canonical_year = 1991")
    return rows.groupBy("history_date").agg(F.round(F.avg("price"), 4).alias("mean_price"), F.count_distinct("vin").alias("vins"))


@query("j17_history_counts", "SELECT vin, history_date, seq, price, count(*) OVER (PARTITION BY vin) AS n FROM {price_history}")
def j17(m):
    return m.price_history.select("vin", "history_date", "seq", "price", F.count("*").over(Window.partitionBy("vin")).alias("n"))


@query("j18_merge_kpis_by_name", "WITH a AS (SELECT l_returnflag AS model, round(avg(l_tax), 6) AS mae FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag AS model, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) SELECT a.model, mae, n FROM a LEFT JOIN b ON a.model = b.model")
def j18(m):
    a = m.lineitem.groupBy(F.col("l_returnflag").alias("model")).agg(F.round(F.avg("l_tax"), 6).alias("mae"))
    return a.join(m.lineitem.where("l_returnflag <> 'R'").groupBy(F.col("l_returnflag").alias("model")).agg(F.count("*").alias("n")), "model", "left")


@query("j19_catalog_lookup_priority", "WITH e AS (SELECT canonical_year AS y, canonical_make AS mk, canonical_model AS md, min(CAST(substr(vin, 4) AS BIGINT)) AS id FROM {identity} WHERE canonical_year <> 1992 GROUP BY 1, 2, 3), f AS (SELECT canonical_make AS mk, min(CAST(substr(vin, 4) AS BIGINT)) AS id FROM {identity} GROUP BY 1) SELECT i.vin, coalesce(e.id, f.id) AS catalog_id, CASE WHEN e.id IS NOT NULL THEN 'exact' ELSE 'base_model' END AS status FROM {identity} i LEFT JOIN e ON canonical_year = y AND canonical_make = e.mk AND canonical_model = md LEFT JOIN f ON canonical_make = f.mk")
def j19(m):
    i = m.identity.withColumn("id", F.substring("vin", 4, 8).cast("bigint"))
    exact = i.where("canonical_year <> 1992").groupBy("canonical_year", "canonical_make", "canonical_model").agg(F.min("id").alias("exact"))
    base = i.groupBy("canonical_make").agg(F.min("id").alias("base"))
    j = i.join(exact, ["canonical_year", "canonical_make", "canonical_model"], "left").join(base, "canonical_make", "left")
    return j.select("vin", F.coalesce("exact", "base").alias("catalog_id"), F.when(F.col("exact").isNotNull(), "exact").otherwise("base_model").alias("status"))


@query("a17_title_summary", "SELECT canonical_model, count(*) AS n, round(avg(price), 4) AS mean_price, round(avg(mileage), 4) AS mean_mileage, round(avg(canonical_year), 4) AS mean_year FROM " + _H + " GROUP BY 1")
def a17(m):
    return _history(m).groupBy("canonical_model").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("mean_price"), F.round(F.avg("mileage"), 4).alias("mean_mileage"), F.round(F.avg("canonical_year"), 4).alias("mean_year"))


@query("a21_first_item_fields", "SELECT o_custkey, count(*)::INT AS n, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_priority FROM orders GROUP BY 1")
def a21(m):
    items = m.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))).alias("items"))
    return items.select("o_custkey", F.size("items").alias("n"), F.get("items", F.lit(0))["o_orderpriority"].alias("first_priority"))


@query("a23_scope_metrics", "SELECT count(DISTINCT h.vin) AS vins, median(price) AS median_price, round(avg(mileage), 4) AS mean_mileage FROM " + _H + " WHERE canonical_make = 'BRAND#6'")
def a23(m):
    return _history(m).where("canonical_make = 'BRAND#6'").agg(F.count_distinct("vin").alias("vins"), F.percentile("price", 0.5).alias("median_price"), F.round(F.avg("mileage"), 4).alias("mean_mileage"))


@query("a30_forecast_coverage", "SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'global' ELSE 'drift' END AS model, l_linenumber % 3 AS horizon, count(*) AS n, count(DISTINCT l_returnflag) AS cohorts FROM lineitem GROUP BY 1, 2")
def a30(m):
    return _forecasts(m).groupBy("model", "horizon").agg(F.count("*").alias("n"), F.count_distinct("cohort").alias("cohorts"))


@query("a34_row_counts", "SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'region', count(*) FROM region")
def a34(m):
    out = None
    for t in ("customer", "part", "region"):
        row = m.table(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("a37_catalog_metadata", "SELECT count(*) AS record_count, min(canonical_year) AS min_year, max(canonical_year) AS max_year, 'ledgerline-1' AS normalization_version FROM {identity}")
def a37(m):
    return files.catalog_metadata(m.identity.select(F.col("canonical_year").alias("year")), identity.VERSION)


@query("w02_first_in_model_year", "SELECT vin, price FROM (SELECT h.vin, price, row_number() OVER (PARTITION BY h.vin ORDER BY history_date, seq, price) AS rn FROM " + _H + " WHERE year(history_date) = canonical_year + 5) WHERE rn = 1")
def w02(m):
    rows = _history(m).where(F.year("history_date") == F.col("canonical_year") + 5)
    return history.latest(rows, "vin", F.asc("history_date"), F.asc("seq"), F.asc("price")).select("vin", "price")


@query("w03_keep_last_by_sort", "SELECT vin, loaddate, seller_type FROM (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY loaddate DESC, seq DESC, seller_type DESC, price DESC) AS rn FROM {listings}) WHERE rn = 1")
def w03(m):
    return upserts.keep_last(m.listings, ["vin"], [F.desc("loaddate"), F.desc("seq"), F.desc("seller_type"), F.desc("price")]).select("vin", "loaddate", "seller_type")


@query("w07_w17_group_transforms", "SELECT o_orderkey, min(o_orderdate) OVER (PARTITION BY o_custkey)::DATE AS first_day, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def w07(m):
    w = Window.partitionBy("o_custkey")
    return m.orders.select("o_orderkey", F.min("o_orderdate").over(w).cast("date").alias("first_day"), F.count("*").over(w).alias("n"))


@query("w14_last_month_per_cohort", f"SELECT canonical_make, canonical_model, month_start, round(median_price, 4) AS median_price FROM (SELECT *, row_number() OVER (PARTITION BY canonical_make, canonical_model ORDER BY month_start DESC) AS rn FROM ({_MONTHLY})) WHERE rn = 1")
def w14(m):
    p = _panel(m).withColumn("k", F.struct(*KEYS))
    return history.latest(p, "k", F.desc("month_start")).select(*KEYS, "month_start", F.round("median_price", 4).alias("median_price"))


@query("w20_rank_in_model", "SELECT l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linestatus)::INT AS rank FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def w20(m):
    c = m.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return c.select("l_returnflag", "l_linestatus", F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.desc("n"), "l_linestatus")).alias("rank"))


@query("o02_o03_top_n", "SELECT comment_id, like_count FROM {comments} ORDER BY like_count DESC, comment_id LIMIT 5")
def o02(m):
    return m.comments.select("comment_id", "like_count").orderBy(F.desc("like_count"), "comment_id").limit(5)


@query("o05_top_by_absolute", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20")
def o05(m):
    return m.customer.select("c_custkey", "c_acctbal").orderBy(F.desc(F.abs("c_acctbal")), "c_custkey").limit(20)


@query("o10_hashed_subsample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 3000")
def o10(m):
    return m.orders.select("o_orderkey", "o_totalprice").orderBy(F.md5(F.concat(F.lit("42:"), F.col("o_orderkey").cast("string"))), "o_orderkey").limit(3000)


@query("u02_concat_missing_columns", "SELECT c_custkey AS key, c_name AS name, NULL AS size FROM customer UNION ALL SELECT p_partkey, p_name, p_size FROM part")
def u02(m):
    a = m.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return a.unionByName(m.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size")), allowMissingColumns=True)


@query("u05_u09_distinct_keys", "SELECT DISTINCT status FROM {queue_state} WHERE status IS NOT NULL")
def u05(m):
    return m.queue_state.where("status is not null").select("status").distinct()


@query("u08_ordered_dedup_tokens", "SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) THEN split_part(p_name, ' ', 1) ELSE p_name END AS tokens FROM part")
def u08(m):
    return m.part.select("p_partkey", F.array_join(F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_name"), " ")), " ").alias("tokens"))


@query("f02_vehicle_text", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE trim(regexp_replace(upper(p_brand || '/' || p_type), '[^A-Z0-9]+', ' ', 'g')) END AS text FROM part")
def f02(m):
    c = F.when(F.col("p_partkey") % 4 == 0, "other").otherwise(F.concat("p_brand", F.lit("/"), "p_type"))
    return m.part.select("p_partkey", text.normalize_vehicle(c).alias("text"))


@query("f05_trim_remainder", "SELECT p_partkey, replace(upper(p_name), 'NEW ', '') AS rest FROM part")
def f05(m):
    return m.part.select("p_partkey", text.clean_trim_remainder(F.concat_ws(" ", F.lit("used"), "p_name", F.lit("for sale 12345 low-miles"))).alias("rest"))


_TRIMS_SQL = ", ".join(f"'{t}'" for t in text.KNOWN_TRIMS)
_STOPS_SQL = ", ".join(f"'{t}'" for t in text.TITLE_STOPWORDS)
_F07 = f"""
WITH t AS (SELECT seq, vin, price, trim(regexp_replace(upper(title || CASE seq % 5 WHEN 0 THEN ' Trd Off-Road' WHEN 1 THEN ' 12 x Sport' ELSE '' END), '[^A-Z0-9]+', ' ', 'g')) AS s,
  string_split(trim(regexp_replace(upper(split_part(title, ' ', 2)), '[^A-Z0-9]+', ' ', 'g')) || ' STANDARD ' || split_part(title, ' ', 1), ' ') AS own FROM {{listings}}),
k AS (SELECT *, list_filter([{_TRIMS_SQL}], lambda x: contains(' ' || s || ' ', ' ' || x || ' ')) AS known,
  list_filter(string_split(s, ' '), lambda w: w <> '' AND NOT list_contains(own, w) AND w NOT IN ({_STOPS_SQL}) AND NOT regexp_full_match(w, '[0-9]+') AND length(w) > 1) AS words FROM t)
SELECT seq, vin, price, CASE WHEN len(known) > 0 THEN replace(known[1], ' ', '_') ELSE left(array_to_string(words[1:2], '_'), 40) END AS trim FROM k
"""


@query("f07_known_trims", _F07)
def f07(m):
    """Titles of all listings, some with a known trim at their end; make and year
    of the title and one word of the model are known."""
    more = F.when(F.col("seq") % 5 == 0, " Trd Off-Road").when(F.col("seq") % 5 == 1, " 12 x Sport").otherwise("")
    words = F.split("title", " ")
    return m.listings.select("seq", "vin", "price", text.extract_clean_trim(words[1], F.lit("Standard"), words[0].cast("int"), F.concat("title", more)).alias("trim"))


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_F08 = f"""
WITH t AS (SELECT seq, vin, trim(regexp_replace(upper(title || CASE seq % 5 WHEN 0 THEN ' SE 4WD Pro-4x' WHEN 1 THEN ' 12 x Gas' WHEN 2 THEN ' High Country' ELSE '' END), '[^A-Z0-9]+', ' ', 'g')) AS s,
  string_split(trim(regexp_replace(upper(split_part(title, ' ', 2)), '[^A-Z0-9]+', ' ', 'g')) || ' STANDARD ' || split_part(title, ' ', 1), ' ') AS own FROM {{listings}}),
k AS (SELECT *, list_filter([{_quoted(text.PROXY_TRIMS)}], lambda x: contains(' ' || s || ' ', ' ' || x || ' ')) AS known,
  list_filter(string_split(s, ' '), lambda w: w <> '' AND NOT list_contains(own, w) AND w NOT IN ({_quoted(text.PROXY_STOPWORDS)}) AND NOT regexp_full_match(w, '[0-9]+') AND length(w) > 1) AS words FROM t)
SELECT seq, vin, CASE WHEN len(known) > 0 THEN replace(known[1], ' ', '_') WHEN len(words) > 0 THEN left(array_to_string(words[1:2], '_'), 40) ELSE 'UNKNOWN_TRIM' END AS trim_proxy FROM k
"""


@query("f08_trim_proxy", _F08)
def f08(m):
    """The older title rule over all listings, some with words that its lists tell apart."""
    more = F.when(F.col("seq") % 5 == 0, " SE 4WD Pro-4x").when(F.col("seq") % 5 == 1, " 12 x Gas").when(F.col("seq") % 5 == 2, " High Country").otherwise("")
    words = F.split("title", " ")
    return m.listings.select("seq", "vin", text.title_trim_proxy(F.concat("title", more), words[1], F.lit("Standard"), words[0].cast("int")).alias("trim_proxy"))


@query("f20_entity_labels", "SELECT vin, canonical_year || ' ' || canonical_make || ' ' || canonical_model AS entity FROM {identity} WHERE lower(canonical_make) = lower('Brand#12') AND starts_with(lower(canonical_model), 'lar')")
def f20(m):
    i = m.identity.where((F.lower("canonical_make") == "brand#12") & F.lower("canonical_model").startswith("lar"))
    return i.select("vin", F.concat_ws(" ", F.col("canonical_year").cast("string"), "canonical_make", "canonical_model").alias("entity"))


@query("f34_f38_ages_and_epochs", "SELECT o_orderkey, greatest(2000 - year(o_orderdate), 0)::INT AS age, strftime(o_orderdate, '%m-%d-%Y') AS shown, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS epoch_days FROM orders")
def f34(m):
    d = F.col("o_orderdate")
    return m.orders.select("o_orderkey", F.greatest(F.lit(2000) - F.year(d), F.lit(0)).alias("age"), dates.us_text(d).alias("shown"), dates.epoch_days(d).alias("epoch_days"))


@query("f54_clip_and_blend", "SELECT l_orderkey, l_linenumber, l_tax, l_discount, round(greatest(0.85 * (l_tax - 0.03) + 0.15 * l_discount, 0), 6) AS blended FROM lineitem")
def f54(m):
    return m.lineitem.select("l_orderkey", "l_linenumber", "l_tax", "l_discount", F.round(F.greatest(0.85 * (F.col("l_tax") - 0.03) + 0.15 * F.col("l_discount"), F.lit(0.0)), 6).alias("blended"))


@query("f65_token_filters", "SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) NOT IN ('red', 'small', 'ring') THEN split_part(p_name, ' ', 1) WHEN split_part(p_name, ' ', 2) NOT IN ('red', 'small', 'ring') THEN split_part(p_name, ' ', 2) END AS token FROM part")
def f65(m):
    return m.part.select("p_partkey", F.get(F.filter(F.split("p_name", " "), lambda x: ~x.isin("red", "small", "ring")), F.lit(0)).alias("token"))


@query("t03_queue_after_run", "SELECT video_id, CASE WHEN video_id % 3 = 0 THEN 'complete' ELSE status END AS status, CASE WHEN video_id % 3 = 0 THEN DATE '1999-01-31' ELSE next_eligible END AS next_eligible FROM {queue_state}")
def t03(m):
    done = m.queue_state.where("video_id % 3 = 0").select("video_id", F.lit("complete").alias("status"))
    return workqueue.record_outcomes(m.queue_state.select("video_id", "status", "next_eligible"), done, F.lit("1999-01-01").cast("date"))


@query("t07_leakage_safe_split", f"WITH m AS (SELECT *, lead(month_start) OVER (PARTITION BY canonical_make, canonical_model ORDER BY month_start) AS t FROM ({_MONTHLY})) SELECT canonical_make, canonical_model, month_start, CASE WHEN t < DATE '2000-01-01' THEN 'train' WHEN month_start >= DATE '2000-01-01' THEN 'test' END AS part FROM m WHERE t < DATE '2000-01-01' OR month_start >= DATE '2000-01-01'")
def t07(m):
    p = _panel(m).withColumn("target_month", F.lead("month_start").over(Window.partitionBy(*KEYS).orderBy("month_start")))
    train, test = samples.split_for_horizon(p, datetime.date(2000, 1, 1))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.select(*KEYS, "month_start", "part")


@query("t12_backtest_rows", "SELECT model, horizon, cohort, round(predicted - actual, 4) AS error, round(actual - naive, 4) AS actual_change FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'global' ELSE 'drift' END AS model, l_linenumber % 3 AS horizon, l_returnflag AS cohort, l_extendedprice AS actual, l_extendedprice * (1 - l_discount) AS predicted, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_quantity * 1500.0 END AS naive FROM lineitem)")
def t12(m):
    return _forecasts(m).select("model", "horizon", "cohort", F.round(F.col("predicted") - F.col("actual"), 4).alias("error"), F.round(F.col("actual") - F.col("naive"), 4).alias("actual_change"))


@query("x05_history_rows", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS at FROM orders")
def x05(m):
    a = m.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("h"))
    return a.select("o_custkey", F.posexplode("h").alias("at", "x")).select("o_custkey", F.col("x.o_orderkey").alias("o_orderkey"), F.col("at").cast("long").alias("at"))


@query("d04_cohort_prices_with_fallback", "WITH x AS (SELECT history_date, price, canonical_trim FROM " + _H + " WHERE canonical_make = 'BRAND#8' AND canonical_model = 'PROMO') SELECT history_date, median(price) AS median_price, count(*) AS n FROM x WHERE canonical_trim = 'NOSUCH' OR NOT EXISTS (SELECT 1 FROM x WHERE canonical_trim = 'NOSUCH') GROUP BY 1")
def d04(m):
    x = _history(m).where("canonical_make = 'BRAND#8' AND canonical_model = 'PROMO'").withColumn("hit", F.coalesce(F.col("canonical_trim") == "NOSUCH", F.lit(False)))
    some = x.agg(F.coalesce(F.max("hit"), F.lit(False)).alias("some"))
    return x.crossJoin(F.broadcast(some)).where("hit OR NOT some").groupBy("history_date").agg(F.percentile("price", 0.5).alias("median_price"), F.count("*").alias("n"))


@query("d08_forecast_match", f"WITH m AS (SELECT *, row_number() OVER (PARTITION BY canonical_make, month_start ORDER BY volume DESC, canonical_model) AS rn FROM ({_MONTHLY})) SELECT canonical_make, month_start, canonical_model, volume FROM m WHERE rn = 1")
def d08(m):
    p = _panel(m).withColumn("k", F.struct("canonical_make", "month_start"))
    return history.latest(p, "k", F.desc("volume"), F.asc("canonical_model")).select("canonical_make", "month_start", "canonical_model", "volume")


@query("d09_d15_metric_tables", "WITH k AS (SELECT l_returnflag AS model, avg(l_tax) AS mae, CASE WHEN l_returnflag = 'N' THEN NULL ELSE avg(l_discount) END AS skill FROM lineitem GROUP BY 1) SELECT model, round(mae, 6) AS mae, round(skill, 6) AS skill, row_number() OVER (ORDER BY skill DESC NULLS LAST, mae)::INT AS place FROM k")
def d09(m):
    k = m.lineitem.groupBy(F.col("l_returnflag").alias("model")).agg(F.avg("l_tax").alias("mae"), F.avg("l_discount").alias("s")).select("model", "mae", F.when(F.col("model") != "N", F.col("s")).alias("skill"))
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("skill"), "mae"))
    return k.select("model", F.round("mae", 6).alias("mae"), F.round("skill", 6).alias("skill"), place.alias("place"))


@query("d11_leaderboard", "WITH e AS (SELECT l_linestatus AS family, l_returnflag AS segment, avg(abs(l_discount - l_tax)) AS mae, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT family, segment, round(mae, 6) AS mae, n FROM e WHERE n >= 10 ORDER BY mae, family, segment LIMIT 4")
def d11(m):
    e = m.lineitem.groupBy(F.col("l_linestatus").alias("family"), F.col("l_returnflag").alias("segment")).agg(F.avg(F.abs(F.col("l_discount") - F.col("l_tax"))).alias("mae"), F.count("*").alias("n"))
    return _rounded(e.where("n >= 10").orderBy("mae", "family", "segment").limit(4), "mae", n=6)


@query("d13_selected_vehicle", "SELECT i.vin, canonical_year || ' ' || canonical_make || ' ' || canonical_model AS label, count(*) AS n, min(price) AS low, max(price) AS high FROM " + _H + " WHERE i.vin = 'VIN00000021' GROUP BY 1, 2")
def d13(m):
    rows = _history(m).where("vin = 'VIN00000021'")
    label = F.concat_ws(" ", F.col("canonical_year").cast("string"), "canonical_make", "canonical_model")
    return rows.groupBy("vin", label.alias("label")).agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))


@query("d14_sentiment_cards", "SELECT round((avg(q) + 1) * 50, 4) AS score FROM (SELECT l.quality - 0.5 AS q FROM documents d JOIN labels l USING (doc_id) WHERE d.source = 'src4' ORDER BY n_chars DESC, doc_id LIMIT 5)")
def d14(m):
    top = m.documents.where("source = 'src4'").join(m.labels, "doc_id").orderBy(F.desc("n_chars"), "doc_id").limit(5)
    return top.agg(F.round((F.avg(F.col("quality") - 0.5) + 1) * 50, 4).alias("score"))


@query("x02_weighted_comments", "SELECT doc_id, round((1 + log10(n_chars + 1)) * CASE WHEN len(regexp_split_to_array(trim(text), '\\s+')) >= 20 THEN 1.2 ELSE 1.0 END, 6) AS weight FROM documents")
def x02(m):
    w = sentiment.apply_weights(m.documents.withColumnRenamed("n_chars", "like_count"))
    return w.select("doc_id", F.round("weight", 6).alias("weight"))


@query("a31_bands_by_share", "SELECT p_brand AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM part GROUP BY 1 HAVING count(*) > 1")
def a31(m):
    return _rounded(kpi.distribution(m.part, "p_brand").where("n > 1"), "share", n=6)
