"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import history, outliers
from ledgerline.plans.registry import query



def _tie():
    return [F.asc("seq"), F.asc("price"), F.asc_nulls_last("mileage")]


@query("j01_inner", "SELECT l.vin, l.price, i.canonical_make, i.body_class FROM {listings} l JOIN {identity} i ON l.vin = i.vin WHERE i.canonical_year >= 1993")
def j01(m):
    return m.listings.select("vin", "price").join(m.identity.where("canonical_year >= 1993").select("vin", "canonical_make", "body_class"), "vin")


@query("j02_semi", "SELECT vin, history_date, price FROM {price_history} WHERE vin IN (SELECT vin FROM {identity} WHERE canonical_make = 'BRAND#7')")
def j02(m):
    return m.price_history.select("vin", "history_date", "price").join(m.identity.where("canonical_make = 'BRAND#7'").select("vin"), "vin", "left_semi")


@query(
    "j03_history_latest_identity_sentiment",
    "WITH l AS (SELECT vin, seller_type, source_name FROM (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY loaddate DESC, seq DESC, price DESC, source_name NULLS LAST, seller_type) AS rn FROM {listings}) WHERE rn = 1), s AS (SELECT upper(lang) AS k, round(avg(n_chars), 4) AS score FROM documents GROUP BY 1) SELECT h.vin, h.history_date, h.price, h.seq, l.seller_type, i.canonical_model, s.score FROM {price_history} h LEFT JOIN l ON h.vin = l.vin LEFT JOIN {identity} i ON h.vin = i.vin LEFT JOIN s ON lower(s.k) = lower(CASE WHEN i.canonical_year = 1990 THEN 'en' WHEN i.canonical_year = 1991 THEN 'de' ELSE 'xx' END)",
)
def j03(m):
    last = history.latest(m.listings, "vin", F.desc("loaddate"), F.desc("seq"), F.desc("price"), F.asc_nulls_last("source_name"), F.asc("seller_type")).select("vin", "seller_type")
    score = m.documents.groupBy(F.lower("lang").alias("k")).agg(F.round(F.avg("n_chars"), 4).alias("score"))
    ident = m.identity.withColumn("k", F.when(F.col("canonical_year") == 1990, "en").when(F.col("canonical_year") == 1991, "de").otherwise("xx"))
    return m.price_history.select("vin", "history_date", "price", "seq").join(last, "vin", "left").join(ident.select("vin", "canonical_model", "k"), "vin", "left").join(score, "k", "left").drop("k")


@query("j04_anti", "SELECT comment_id, video_id FROM {comments} WHERE comment_id NOT IN (SELECT doc_id FROM labels)")
def j04(m):
    return m.comments.select("comment_id", "video_id").join(m.labels.select(F.col("doc_id").alias("comment_id")), "comment_id", "left_anti")


_ASOF = "WITH r AS (SELECT vin, history_date, price FROM (SELECT *, row_number() OVER (PARTITION BY vin, history_date ORDER BY seq, price, mileage NULLS LAST) AS rn FROM {listing_history}) WHERE rn = 1) "


@query("j06_asof", _ASOF + "SELECT p.vin, p.history_date, p.price, p.seq, r.history_date AS right_day, r.price AS right_value FROM {price_history} p ASOF JOIN r ON p.vin = r.vin AND p.history_date >= r.history_date WHERE date_diff('day', r.history_date, p.history_date) <= 7")
def j06(m):
    return history.asof_backward(m.price_history.select("vin", "history_date", "price", "seq"), m.listing_history, "vin", "history_date", "price", _tie())


@query("j07_same_day_check", "SELECT count(*) AS n_overlap, round(coalesce(avg(CASE WHEN p.price = l.price THEN 1.0 ELSE 0.0 END), 0.0), 6) AS equal_rate FROM {price_history} p JOIN {listing_history} l ON p.vin = l.vin AND p.history_date = l.history_date")
def j07(m):
    return history.overlap_rate(m.price_history, m.listing_history, ["vin", "history_date"], "price").withColumn("equal_rate", F.round("equal_rate", 6))




@query("j08_a01_contextual_stats", "SELECT canonical_make, canonical_model, count(*) AS n, median(price) AS med, list_sort(list(price))[round((count(*) - 1) * 0.25)::INT + 1]::DOUBLE AS q1, list_sort(list(price))[round((count(*) - 1) * 0.75)::INT + 1]::DOUBLE AS q3 FROM {price_history} h JOIN {identity} i ON h.vin = i.vin GROUP BY 1, 2")
def j08(m):
    rows = m.price_history.join(m.identity, "vin")
    return outliers.price_stats(rows, "price", ("canonical_make", "canonical_model"))


@query("j09_expression_key", "SELECT d.doc_id, n.n_name FROM documents d LEFT JOIN nation n ON 'NATION_' || (d.doc_id % 30) = n.n_name")
def j09(m):
    return m.documents.join(m.nation, F.concat(F.lit("NATION_"), (F.col("doc_id") % 30).cast("string")) == F.col("n_name"), "left").select("doc_id", "n_name")


@query("j12_null_safe_context_join", "WITH c AS (SELECT DISTINCT canonical_make, canonical_trim FROM {identity}), p AS (SELECT *, coalesce(canonical_trim, 'NONE') || '/' || canonical_make AS label FROM c) SELECT i.vin, p.label FROM {identity} i JOIN p ON i.canonical_make = p.canonical_make AND i.canonical_trim IS NOT DISTINCT FROM p.canonical_trim")
def j12(m):
    c = m.identity.select("canonical_make", "canonical_trim").distinct().withColumn("label", F.concat(F.coalesce("canonical_trim", F.lit("NONE")), F.lit("/"), F.col("canonical_make")))
    i = m.identity.select("vin", "canonical_make", "canonical_trim").alias("i")
    return i.join(c.alias("c"), F.col("i.canonical_make").eqNullSafe(F.col("c.canonical_make")) & F.col("i.canonical_trim").eqNullSafe(F.col("c.canonical_trim"))).select("vin", "label")


@query("j14_exists_flag", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_finished FROM customer")
def j14(m):
    done = m.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has_finished", F.lit(True))
    return m.customer.select("c_custkey").join(done, "c_custkey", "left").withColumn("has_finished", F.coalesce("has_finished", F.lit(False)))


@query("j16_first_year_vs_latest",
    "WITH j AS (SELECT h.vin, history_date, price, mileage, seq, canonical_year FROM {price_history} h JOIN {identity} i ON h.vin = i.vin WHERE price > 1234), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY history_date, seq, price, mileage NULLS LAST) AS rn FROM j WHERE year(history_date) = canonical_year + 5) WHERE rn = 1), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY history_date DESC, seq DESC, price DESC, mileage DESC NULLS LAST) AS rn FROM j) WHERE rn = 1) SELECT f.vin, f.price AS first_price, l.price AS last_price, f.price - l.price AS depreciation, round((f.price - l.price) / f.price, 6) AS depreciation_share, round((f.price - l.price) / CASE WHEN l.history_date = f.history_date THEN 0.001 ELSE date_diff('day', f.history_date, l.history_date) / 365.25 END, 4) AS per_year FROM f JOIN l ON f.vin = l.vin")
def j16(m):
    ident = m.identity.select("vin", (F.col("canonical_year") + 5).alias("canonical_year"))
    d = history.depreciation(m.price_history, ident)
    return d.select("vin", "first_price", "last_price", "depreciation", F.round("depreciation_share", 6).alias("depreciation_share"), F.round("per_year", 4).alias("per_year"))


@query("j20_cross_one_row", "SELECT c_custkey, c_acctbal - (SELECT max(c_acctbal) FROM customer) AS below_top FROM customer")
def j20(m):
    top = m.customer.agg(F.max("c_acctbal").alias("top"))
    return m.customer.crossJoin(F.broadcast(top)).select("c_custkey", (F.col("c_acctbal") - F.col("top")).alias("below_top"))


@query("j21_range_rule_lookup", "WITH r(lo, hi, phrase, label) AS (VALUES (1990, 1992, 'RING', 'early ring'), (1993, 1994, 'RING', 'late ring'), (1990, 1994, 'BOLT', 'bolt'), (1991, 1994, 'G', 'g')) SELECT i.vin, arg_max(r.label, length(r.phrase)) AS label FROM {identity} i JOIN r ON canonical_year BETWEEN lo AND hi AND contains(canonical_trim, phrase) GROUP BY 1")
def j21(m):
    rules = m.spark.createDataFrame([(1990, 1992, "RING", "early ring"), (1993, 1994, "RING", "late ring"), (1990, 1994, "BOLT", "bolt"), (1991, 1994, "G", "g")], "lo int, hi int, phrase string, label string")
    hit = F.col("canonical_year").between(F.col("lo"), F.col("hi")) & F.col("canonical_trim").contains(F.col("phrase"))
    return m.identity.join(F.broadcast(rules), hit).groupBy("vin").agg(F.max_by("label", F.length("phrase")).alias("label"))


@query("t13_gap_report", _ASOF + "SELECT p.vin, p.history_date, p.seq, p.price, abs(p.price - r.price) AS absolute_gap, round((p.price - r.price) / nullif(r.price, 0), 6) AS percent_gap, date_diff('day', r.history_date, p.history_date)::INT AS days_gap, CASE WHEN (SELECT count(*) > 0 AND avg(CASE WHEN a.price = b.price THEN 1.0 ELSE 0.0 END) >= 0.95 FROM {price_history} a JOIN {listing_history} b ON a.vin = b.vin AND a.history_date = b.history_date) THEN 'duplicate_like_price_trajectory' ELSE 'distinct_price_trajectory' END AS label FROM {price_history} p ASOF JOIN r ON p.vin = r.vin AND p.history_date >= r.history_date WHERE date_diff('day', r.history_date, p.history_date) <= 7")
def t13(m):
    g = history.gap_report(m.price_history.select("vin", "history_date", "price", "seq"), m.listing_history, "vin", "history_date", "price", _tie())
    return g.select("vin", "history_date", "seq", "price", "absolute_gap", F.round("percent_gap", 6).alias("percent_gap"), "days_gap", "label")
