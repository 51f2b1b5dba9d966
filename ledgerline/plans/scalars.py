"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import dates, nested, numbers, text
from ledgerline.plans.registry import query

_SQUEEZE = "trim(regexp_replace(upper({0}), '[^A-Z0-9]+', ' ', 'g'))"


def _squeeze(c):
    return _SQUEEZE.replace("{0}", c)


# the oracle's upper() leaves the one letter whose capital form has two
_F01 = _squeeze("replace(text, 'ß', 'SS')")


@query("f01_normalize_trim", f"SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'NONE_GIVEN' WHEN {_F01} IN ('', 'N A', 'NA', 'NONE', 'NULL', 'UNKNOWN', 'NOT APPLICABLE') THEN 'NONE_GIVEN' ELSE {_F01} END AS trim FROM documents")
def f01(m):
    c = F.when(F.col("doc_id") % 9 == 0, F.lit(None)).otherwise(F.col("text"))
    return m.documents.select("doc_id", text.normalize_trim(c, "NONE_GIVEN").alias("trim"))


@query("f03_canonical_token", f"SELECT p_partkey, replace({_squeeze('p_brand || p_name')}, ' ', '_') AS token FROM part")
def f03(m):
    return m.part.select("p_partkey", text.canonical_token(F.concat("p_brand", "p_name")).alias("token"))


@query("f04_phrases", "SELECT p_partkey, contains(' ' || p_name || ' ', ' ring ') AS has, CASE WHEN contains(' ' || p_name || ' ', ' ring ') THEN trim(replace(' ' || p_name || ' ', ' ring ', ' ')) ELSE p_name END AS rest FROM part")
def f04(m):
    return m.part.select("p_partkey", text.has_phrase(F.col("p_name"), "ring").alias("has"), text.remove_phrase(F.col("p_name"), "ring").alias("rest"))


@query("f06_title_year", "SELECT seq, price, try_cast(regexp_extract(title, '\\b(19[89]\\d|20[0-3]\\d)\\b', 1) AS INT) AS year FROM {listings}")
def f06(m):
    return m.listings.select("seq", "price", text.title_year(F.col("title")).alias("year"))


_F09 = f"""
WITH p AS (SELECT p_partkey, replace({_squeeze("p_name")}, ' ', '_') AS a, CASE WHEN p_partkey % 4 = 0 THEN 'UNKNOWN_TRIM' WHEN p_partkey % 4 = 1 THEN replace({_squeeze("p_type")}, ' ', '_') WHEN p_partkey % 4 = 2 THEN replace({_squeeze("p_name")}, ' ', '_') ELSE '' END AS b FROM part)
SELECT p_partkey, CASE WHEN b IN ('', 'UNKNOWN_TRIM', a) THEN a ELSE a || ' ' || b END AS trims FROM p
"""


@query("f09_combine_trims", _F09)
def f09(m):
    other = F.when(F.col("p_partkey") % 4 == 0, F.lit("unknown trim")).when(F.col("p_partkey") % 4 == 1, F.col("p_type")).when(F.col("p_partkey") % 4 == 2, F.upper("p_name"))
    return m.part.select("p_partkey", text.combine_trims(F.col("p_name"), other).alias("trims"))


@query("f10_normalize_label", "SELECT vin, seq, price, coalesce(upper(trim(regexp_replace(source_name, '\\s+', ' ', 'g'))), 'UNKNOWN') AS source FROM {listings}")
def f10(m):
    return m.listings.select("vin", "seq", "price", text.normalize_label(F.col("source_name")).alias("source"))


@query("f15_word_count", "SELECT doc_id, length(text)::INT AS chars, CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text), '\\s+')) END::INT AS words FROM documents")
def f15(m):
    return m.documents.select("doc_id", F.length("text").alias("chars"), text.word_count(F.col("text")).alias("words"))


@query("f16_keyword_flags", "SELECT doc_id, regexp_matches(text, '(?i)license|copyright')::INT AS licensed, regexp_matches(text, '(?i)rights')::INT AS rights FROM documents")
def f16(m):
    return m.documents.select("doc_id", text.flag(F.col("text"), "license|copyright").alias("licensed"), text.flag(F.col("text"), "rights").alias("rights"))


@query("f17_zero_fill", "SELECT c_custkey, CASE WHEN length(c_custkey::VARCHAR) >= 3 THEN c_custkey::VARCHAR ELSE lpad(c_custkey::VARCHAR, 3, '0') END AS code FROM customer")
def f17(m):
    return m.customer.select("c_custkey", text.zero_fill(F.col("c_custkey").cast("string"), 3).alias("code"))


@query("f18_joined_keys", "SELECT vin, canonical_make || '|' || canonical_model || '|' || canonical_year || '|' || coalesce(canonical_trim, 'UNKNOWN') AS cohort_id FROM {identity}")
def f18(m):
    return m.identity.select("vin", text.joined_key(*[F.col(c) for c in ("canonical_make", "canonical_model", "canonical_year", "canonical_trim")]).alias("cohort_id"))


@query("f19_transmission", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN p_type || ' / ' || p_size ELSE NULL END AS transmission FROM part")
def f19(m):
    style = F.when(F.col("p_partkey") % 3 < 2, F.col("p_type"))
    speeds = F.when(F.col("p_partkey") % 3 == 1, F.col("p_size").cast("string")).when(F.col("p_partkey") % 3 == 2, " ")
    return m.part.select("p_partkey", text.transmission(style, speeds).alias("transmission"))


@query("f21_formats", "SELECT o_orderkey, '$' || format('{{:,.0f}}', o_totalprice::DOUBLE) AS price, CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE format('{{:,.1f}}', (o_orderkey % 100 / 100.0::DOUBLE) * 100) || '%' END AS share FROM orders".replace("{{", "{").replace("}}", "}"))
def f21(m):
    share = F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 100) / 100.0)
    return m.orders.select("o_orderkey", text.currency(F.col("o_totalprice")).alias("price"), text.percent(share).alias("share"))


@query("f22_truthy", "SELECT o_orderkey, (o_orderstatus IN ('F'))::INT AS done FROM orders")
def f22(m):
    return m.orders.select("o_orderkey", text.truthy(F.when(F.col("o_orderstatus") == "F", "Yes").otherwise(F.col("o_orderstatus"))).alias("done"))


@query("f23_horizon_months", "SELECT l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber::DOUBLE ELSE round(l_linenumber * 30 / 30.4375, 6) END AS months FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def f23(m):
    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("target_"), F.col("l_linenumber"), F.lit("m"))).otherwise(F.concat(F.lit("target_"), F.col("l_linenumber") * 30, F.lit("d")))
    return m.lineitem.select("l_linenumber").distinct().select("l_linenumber", F.round(text.horizon_months(name), 6).alias("months"))


@query("f25_error_kinds", "SELECT event_id, CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'quota' WHEN event_type = 'error' AND user_id % 3 = 1 THEN 'comments_disabled' ELSE 'other' END AS kind FROM events")
def f25(m):
    err = F.col("event_type") == "error"
    status = F.when(err, 403).otherwise(200)
    reason = F.when(err & (F.col("user_id") % 3 == 0), "quotaExceeded").when(err & (F.col("user_id") % 3 == 1), "commentsDisabled").otherwise("none")
    return m.events.select("event_id", text.api_error_kind(status, reason).alias("kind"))


@query("f30_date_formats", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def f30(m):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    shown = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MM/dd/yyyy")).when(k == 2, F.date_format(d, "yyyy/MM/dd")).when(k == 3, F.date_format(d, "MMM dd yyyy")).when(k == 4, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return m.orders.select("o_orderkey", dates.parse_date(shown).alias("day"))


@query("f31_calendar_parts", "SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month_start, month(o_orderdate)::INT AS month, quarter(o_orderdate)::INT AS quarter, week(o_orderdate)::INT AS week, year(o_orderdate)::INT AS year FROM orders")
def f31(m):
    d = F.col("o_orderdate").cast("date")
    return m.orders.select("o_orderkey", dates.month_start(d).alias("month_start"), F.month(d).alias("month"), F.quarter(d).alias("quarter"), F.weekofyear(d).alias("week"), F.year(d).alias("year"))


@query("f32_ages", "SELECT h.vin, h.seq, h.price, round(greatest(date_diff('day', make_date(i.canonical_year, 1, 1), h.history_date) / 30.4375, 0), 6) AS age, ((year(h.history_date) - 1995) * 12 + month(h.history_date) - 1)::INT AS months FROM {price_history} h JOIN {identity} i ON h.vin = i.vin")
def f32(m):
    j = m.price_history.join(m.identity, "vin")
    return j.select("vin", "seq", "price", F.round(dates.age_months(F.col("history_date"), F.col("canonical_year")), 6).alias("age"), dates.months_between_starts(F.col("history_date"), F.lit("1995-01-01").cast("date")).alias("months"))


@query("f33_add_months", "SELECT o_orderkey, (o_orderdate + INTERVAL 6 MONTH)::DATE AS later FROM orders")
def f33(m):
    return m.orders.select("o_orderkey", F.add_months(F.col("o_orderdate").cast("date"), 6).alias("later"))


@query("f35_ownership_years", "SELECT o_orderkey, round(CASE WHEN o_orderdate::DATE = DATE '1998-01-01' THEN 0.001 ELSE date_diff('day', DATE '1998-01-01', o_orderdate::DATE) / 365.25 END, 6) AS years FROM orders")
def f35(m):
    return m.orders.select("o_orderkey", F.round(dates.ownership_years(F.col("o_orderdate").cast("date"), F.lit("1998-01-01").cast("date")), 6).alias("years"))


@query("f36_next_eligible", "SELECT video_id, CASE WHEN status IN ('complete', 'zero_comments', 'comments_disabled') THEN TIMESTAMP '2026-01-31 00:00:00' WHEN status IN ('quota_exhausted', 'api_error') THEN TIMESTAMP '2026-01-02 00:00:00' ELSE TIMESTAMP '2026-01-01 00:00:00' END AS due FROM {queue_state}")
def f36(m):
    return m.queue_state.select("video_id", dates.next_eligible(F.col("status"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).alias("due"))


@query("f40_text_to_int", "SELECT l_orderkey, l_linenumber, l_extendedprice, ceil(l_extendedprice)::BIGINT AS price FROM lineitem")
def f40(m):
    shown = F.concat(F.lit("$"), F.format_string("%,.2f", "l_extendedprice"))
    return m.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", numbers.to_int_ceil(shown).alias("price"))


@query("f41_lenient_casts", "SELECT c_custkey, trunc(c_acctbal)::BIGINT AS whole, try_cast(CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE c_acctbal::VARCHAR END AS DOUBLE) AS number FROM customer")
def f41(m):
    return m.customer.select("c_custkey", numbers.to_int(F.col("c_acctbal")).alias("whole"), numbers.to_float(F.when(F.col("c_custkey") % 3 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))).alias("number"))


@query("f43_repeated_digits", "SELECT price, price IN (11111, 22222, 33333, 44444, 55555, 66666, 77777, 88888, 99999, 111111) AS repeated FROM (SELECT price FROM {price_history} UNION ALL SELECT 44444 UNION ALL SELECT 1111)")
def f43(m):
    rows = m.price_history.select("price").union(m.spark.sql("SELECT * FROM VALUES (44444L), (1111L)"))
    return rows.select("price", numbers.repeated_digits(F.col("price")).alias("repeated"))


@query("f44_numeric_features", "SELECT l_orderkey, l_linenumber, l_quantity, round(ln(1 + l_quantity), 6) AS log_q, round(l_extendedprice / greatest(l_discount * 10, 0.25), 4) AS ratio FROM lineitem")
def f44(m):
    return m.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.round(F.log1p("l_quantity"), 6).alias("log_q"), F.round(F.col("l_extendedprice") / F.greatest(F.col("l_discount") * 10, F.lit(0.25)), 4).alias("ratio"))


@query("f45_bands", "SELECT vin, seq, price, mileage, CASE WHEN mileage IS NULL OR mileage <= -1 THEN NULL WHEN mileage <= 100 THEN 'delivery' WHEN mileage <= 5000 THEN 'under_5k' WHEN mileage <= 25000 THEN '5k_25k' WHEN mileage <= 60000 THEN '25k_60k' WHEN mileage <= 100000 THEN '60k_100k' WHEN mileage <= 150000 THEN '100k_150k' ELSE '150k_plus' END AS mileage_band, CASE WHEN price <= 0 THEN NULL WHEN price <= 25000 THEN 'under_25k' WHEN price <= 50000 THEN '25k_50k' WHEN price <= 100000 THEN '50k_100k' WHEN price <= 150000 THEN '100k_150k' ELSE '150k_plus' END AS price_band FROM {price_history}")
def f45(m):
    return m.price_history.select("vin", "seq", "price", "mileage", numbers.band(F.col("mileage"), numbers.MILEAGE_BANDS, -1).alias("mileage_band"), numbers.band(F.col("price"), numbers.PRICE_BANDS, 0).alias("price_band"))


@query("f46_year_bucket", "SELECT vin, (floor(canonical_year / 5) * 5)::BIGINT AS bucket FROM {identity}")
def f46(m):
    return m.identity.select("vin", numbers.year_bucket(F.col("canonical_year")).alias("bucket"))


@query("f47_comment_weight", "SELECT doc_id, round((1 + log10(n_chars + 1)) * CASE WHEN trim(text) <> '' AND len(regexp_split_to_array(trim(text), '\\s+')) >= 20 THEN 1.2 ELSE 1.0 END, 6) AS weight FROM documents")
def f47(m):
    return m.documents.select("doc_id", F.round(numbers.comment_weight(F.col("n_chars"), text.word_count(F.col("text"))), 6).alias("weight"))


@query("f48_aspect_score", "SELECT l_orderkey, l_linenumber, l_discount, l_tax, CASE WHEN greatest(l_discount * 8, l_tax * 8) >= 0.4 THEN round((l_discount * 8 - l_tax * 8) / (l_discount * 8 + l_tax * 8 + 1e-9), 6) END AS score FROM lineitem")
def f48(m):
    return m.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_tax", F.round(numbers.aspect_score(F.col("l_discount") * 8, F.col("l_tax") * 8), 6).alias("score"))


@query("f53_step_rate", "SELECT l_linenumber, round(pow(1 + l_linenumber / 10.0, 1.0 / 3) - 1, 6) AS rate FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def f53(m):
    return m.lineitem.select("l_linenumber").distinct().select("l_linenumber", F.round(numbers.step_rate(F.col("l_linenumber") / 10.0, 1, 3), 6).alias("rate"))


@query("f60_f61_json_history", "SELECT user_id, event_type AS trend, value AS price, json_extract_string(props, '$.k')::DOUBLE AS mileage FROM events")
def f61(m):
    entry = F.to_json(F.array(F.struct(F.lit("2024-01-01").alias("date"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("mileage"), F.col("event_type").alias("trend"))))
    parsed = m.events.select("user_id", nested.parse_history(entry).alias("h"))
    return nested.flatten_history(parsed, "h", "user_id").select("user_id", "trend", "price", "mileage")


@query("f62_f63_json_texts", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS props, CASE WHEN event_type = 'error' THEN 'quotaExceeded' END AS reason FROM events")
def f62(m):
    body = F.when(F.col("event_type") == "error", '{"error": {"errors": [{"reason": "quotaExceeded"}]}}').otherwise("{}")
    return m.events.select("event_id", F.to_json(F.from_json("props", "k int")).alias("props"), nested.error_reason(body).alias("reason"))


@query("f64_prefixed_fields", "SELECT p_partkey, coalesce(p_brand, '') AS nhtsa_p_brand, '' AS nhtsa_doors FROM part")
def f64(m):
    return m.part.select("p_partkey", *nested.prefixed(m.part, ["p_brand", "doors"]))


@query("a19_a20_item_summaries", "SELECT l_orderkey, count(*)::INT AS n, sum(l_linenumber)::BIGINT AS injuries, count(*) FILTER (l_returnflag = 'R')::INT AS crashes FROM lineitem GROUP BY 1")
def a20(m):
    items = m.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("injuries"), F.lit(0).alias("deaths"), (F.col("l_returnflag") == "R").alias("crash"), F.lit(False).alias("fire"), F.col("l_linestatus").alias("area"))).alias("items"))
    s = items.select("l_orderkey", nested.complaint_summary(F.col("items")).alias("s"))
    return s.select("l_orderkey", F.col("s.count").alias("n"), "s.injuries", "s.crashes")
