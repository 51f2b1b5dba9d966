"""Composite operators and the report queries built on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import numbers, text
from ledgerline.operators import aspects, cleaning, features, history, identity, kpi, outliers, sentiment, workqueue
from ledgerline.plans.registry import query
from ledgerline.sources import samples, upserts

KEYS = ["canonical_make", "canonical_model", "canonical_year", "canonical_trim"]
_LIST = "{price_history} h JOIN {identity} i ON h.vin = i.vin"


def _stat(keys: str) -> str:
    cols = keys.split(", ")
    where = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return f"SELECT {keys}, count(*) AS n, median(price) AS med, list_sort(list(price))[round((count(*) - 1) * 0.25)::INT + 1]::DOUBLE AS q1, list_sort(list(price))[round((count(*) - 1) * 0.75)::INT + 1]::DOUBLE AS q3 FROM x WHERE {where} GROUP BY {keys}"


_OUTLIERS = f"""WITH x AS (SELECT h.vin, h.seq, CASE WHEN h.seq % 997 = 0 THEN 444444 WHEN h.seq % 991 = 0 THEN 1111 ELSE h.price END AS price, canonical_make, canonical_model, canonical_year, canonical_trim FROM {_LIST}),
a AS ({_stat('canonical_make, canonical_model, canonical_year, canonical_trim')}), b AS ({_stat('canonical_make, canonical_model, canonical_year')}), c AS ({_stat('canonical_make, canonical_model')}),
g AS (SELECT count(*) AS n, median(price) AS med, list_sort(list(price))[round((count(*) - 1) * 0.25)::INT + 1]::DOUBLE AS q1, list_sort(list(price))[round((count(*) - 1) * 0.75)::INT + 1]::DOUBLE AS q3 FROM x),
s AS (SELECT x.*, CASE WHEN a.n >= 6 THEN a.n WHEN b.n >= 10 THEN b.n WHEN c.n >= 20 THEN c.n ELSE g.n END AS n, CASE WHEN a.n >= 6 THEN a.med WHEN b.n >= 10 THEN b.med WHEN c.n >= 20 THEN c.med ELSE g.med END AS med,
 CASE WHEN a.n >= 6 THEN a.q1 WHEN b.n >= 10 THEN b.q1 WHEN c.n >= 20 THEN c.q1 ELSE g.q1 END AS q1, CASE WHEN a.n >= 6 THEN a.q3 WHEN b.n >= 10 THEN b.q3 WHEN c.n >= 20 THEN c.q3 ELSE g.q3 END AS q3, CASE WHEN a.n >= 6 THEN 1 WHEN b.n >= 10 THEN 2 WHEN c.n >= 20 THEN 3 ELSE 0 END AS level
 FROM x LEFT JOIN a ON x.canonical_make = a.canonical_make AND x.canonical_model = a.canonical_model AND x.canonical_year = a.canonical_year AND x.canonical_trim = a.canonical_trim LEFT JOIN b ON x.canonical_make = b.canonical_make AND x.canonical_model = b.canonical_model AND x.canonical_year = b.canonical_year LEFT JOIN c ON x.canonical_make = c.canonical_make AND x.canonical_model = c.canonical_model, g),
f AS (SELECT *, greatest(q3 - q1, 0) AS iqr, n >= 6 AND med >= 5000 AS valid FROM s)
SELECT vin, seq, price, level, CASE WHEN valid AND price > 3.5 * med AND price > greatest(q3 + 3 * iqr, med + 25000) THEN 'high' WHEN valid AND price < 0.25 * med AND price < least(greatest(q1 - 3 * iqr, 0), 0.5 * med) THEN 'low'
 WHEN valid AND regexp_matches(price::VARCHAR, '^(1{{5,}}|2{{5,}}|3{{5,}}|4{{5,}}|5{{5,}}|6{{5,}}|7{{5,}}|8{{5,}}|9{{5,}})$') AND ((price > 2 * med AND price > greatest(q3 + 1.5 * iqr, med + 15000)) OR (price < 0.5 * med AND price < q1)) THEN 'repeated' END AS outlier FROM f"""


def _priced(m):
    price = F.when(F.col("seq") % 997 == 0, 444_444).when(F.col("seq") % 991 == 0, 1111).otherwise(F.col("price"))
    return m.price_history.withColumn("price", price).join(m.identity.select("vin", *KEYS), "vin")


@query("f52_contextual_outliers", _OUTLIERS)
def f52(m):
    return outliers.flag_outliers(_priced(m), "price").select("vin", "seq", "price", F.col("ctx_level").alias("level"), "outlier")


@query("f51_base_price_cascade", "WITH a AS (SELECT vin, price FROM (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY history_date, price) AS rn FROM {price_history} WHERE price > 0) WHERE rn = 1), b AS (SELECT vin, price FROM (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY history_date, price) AS rn FROM {listing_history} WHERE price > 0) WHERE rn = 1) SELECT i.vin, CASE WHEN i.base_price > 0 THEN i.base_price ELSE coalesce(a.price, b.price)::DOUBLE END AS base_price, CASE WHEN i.base_price > 0 THEN 'nhtsa' WHEN a.price IS NOT NULL THEN 'price_history' WHEN b.price IS NOT NULL THEN 'listing_history' ELSE 'missing' END AS base_price_source FROM {identity} i LEFT JOIN a ON i.vin = a.vin LEFT JOIN b ON i.vin = b.vin")
def f51(m):
    return history.fill_base_price(m.identity.select("vin", "base_price"), m.price_history, m.listing_history)


@query("i01_catalog_ids", "SELECT canonical_year AS year, canonical_make AS make, canonical_model AS model, min(p_partkey)::BIGINT AS id, count(*) AS n FROM (SELECT *, CAST(substr(vin, 4) AS BIGINT) AS p_partkey FROM {identity}) GROUP BY 1, 2, 3")
def i01(m):
    c = m.identity.select(F.col("canonical_year").alias("year"), F.col("canonical_make").alias("make"), F.col("canonical_model").alias("model"), F.substring("vin", 4, 8).cast("bigint").alias("id"))
    return c.groupBy("year", "make", "model").agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query("i08_normalize_listings", "SELECT l.vin, l.seq, l.price, i.canonical_year, replace(upper(p_brand), '#', ' ') AS canonical_make, i.canonical_model, replace(trim(regexp_replace(upper(p_name), '\\bNEW\\b', '')), ' ', '_') AS canonical_trim, 'title_remainder' AS canonical_trim_source, CASE WHEN i.canonical_trim IS NOT NULL THEN i.canonical_trim = replace(trim(regexp_replace(upper(p_name), '\\bNEW\\b', '')), ' ', '_') END AS nhtsa_trim_agrees, TRUE AS nhtsa_make_agrees FROM {listings} l JOIN {identity} i ON l.vin = i.vin JOIN part ON p_partkey = CAST(substr(l.vin, 4) AS BIGINT)")
def i08(m):
    rows = m.listings.join(m.identity.select("vin", F.col("canonical_make").alias("make"), F.col("canonical_model").alias("model"), F.col("canonical_year").alias("year"), F.col("canonical_trim").alias("trim")), "vin")
    out = identity.normalize_listings(rows)
    return out.select("vin", "seq", "price", "canonical_year", "canonical_make", "canonical_model", "canonical_trim", "canonical_trim_source", "nhtsa_trim_agrees", "nhtsa_make_agrees")


@query("i09_consensus", """WITH x AS (SELECT CAST(l.l_partkey AS BIGINT) AS vin, l_shipdate::DATE AS loaddate, l_returnflag AS canonical_trim, CASE WHEN l_linenumber % 3 = 0 THEN 'high' WHEN l_linenumber % 3 = 1 THEN 'medium' ELSE 'low' END AS confidence FROM lineitem l),
s AS (SELECT vin, canonical_trim, count(*) AS support FROM x GROUP BY 1, 2), j AS (SELECT x.*, support, row_number() OVER (PARTITION BY x.vin ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, support DESC, loaddate DESC, x.canonical_trim) AS rn FROM x JOIN s ON x.vin = s.vin AND x.canonical_trim = s.canonical_trim),
v AS (SELECT vin, count(*) AS n, count(DISTINCT canonical_trim) AS d FROM x GROUP BY 1) SELECT j.vin, canonical_trim, confidence, support, n AS supporting, (d - 1)::BIGINT AS conflict_count FROM j JOIN v ON j.vin = v.vin WHERE rn = 1""")  # fmt: skip
def i09(m):
    k = F.col("l_linenumber") % 3
    x = m.lineitem.select(F.col("l_partkey").alias("vin"), F.col("l_shipdate").cast("date").alias("loaddate"), F.col("l_returnflag").alias("canonical_trim"), F.when(k == 0, "high").when(k == 1, "medium").otherwise("low").alias("confidence"))
    c = identity.consensus(x, confidence="confidence", keys=("canonical_trim",))
    return c.select("vin", "canonical_trim", "confidence", F.col("winning_identity_support_count").alias("support"), F.col("supporting_listing_count").alias("supporting"), "conflict_count")


@query("p12_current_price_features", "SELECT l.vin, l.seq, l.price, greatest(2000 - canonical_year, 0)::DOUBLE AS vehicle_age, round(ln(1 + mileage), 6) AS log_mileage, (date_diff('day', l.loaddate, (SELECT max(loaddate) FROM {listings})))::INT AS days_since_listed, length(title)::INT AS title_length, canonical_make || '_' || canonical_model || '_' || canonical_year AS make_model_year FROM {listings} l JOIN {identity} i ON l.vin = i.vin")
def p12(m):
    rows = m.listings.join(m.identity.select("vin", *KEYS), "vin")
    f = features.feature_matrix(features.current_price_features(rows, 2000).withColumn("listed_price", F.col("price")))
    return f.select("vin", "seq", F.col("listed_price").alias("price"), "vehicle_age", F.round("log_mileage", 6).alias("log_mileage"), "days_since_listed", "title_length", "make_model_year")


#: Any character six times in a row, spelt out: the engine of the oracle has no back references.
_SIX = "|".join(f"\\x{{{c:x}}}{{6}}" for c in (9, *range(0x20, 0x250)))
_F13 = r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, 'https?://\S+|www\.\S+', '', 'g'), '<[^\n]*?>', '', 'g')) AS t FROM documents),
k AS (SELECT *, lower(t) IN ('first', 'first!', 'first!!', 'first comment', 'subscribe', 'sub')
  OR regexp_matches(t, '(?i)\bsubscribe\b|\bmy channel\b|\bcheck out my\b|\bclick the link\b|\bclick here\b|\btelegram\b|\bwhatsapp\b|\bcontact me\b|\bpromo\b|\bdiscount\b|\bgiveaway\b')
  OR regexp_matches(t, '\+\d{1,3}[-.\s]?\d{3,4}[-.\s]?\d{4}|\b0x[a-fA-F0-9]{40}\b|\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b')
  OR regexp_matches(t, '_SIX_') AS junk FROM c),
o AS (SELECT doc_id, junk, trim(regexp_replace(regexp_replace(regexp_replace(t, '!{2,}', '!', 'g'), '\?{2,}', '?', 'g'), '\.{4,}', '...', 'g')) AS t FROM k)
SELECT doc_id, CASE WHEN NOT junk AND t <> '' AND len(regexp_split_to_array(t, '\s+')) >= 3 THEN t END AS clean FROM o
"""


@query("f13_clean_comments", _F13.replace("_SIX_", _SIX))
def f13(m):
    return m.documents.select("doc_id", sentiment.clean_comment(F.col("text")).alias("clean"))


@query("f14_chunks")
def f14(m):
    # the outer form: for the inner one Spark filters by the array's size first, and so cuts each text twice
    return m.comments.select("comment_id", F.posexplode_outer(sentiment.chunks(F.col("text"))).alias("chunk", "text")).where("chunk is not null")


_LEXICON_SQL = "WITH w AS (SELECT doc_id AS comment_id, regexp_split_to_array(lower(text), '[^a-z-]+') AS w FROM documents) SELECT comment_id, " + ", ".join(
    f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in own.split())}))) / greatest(len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in ' '.join(both).split())}))), 1) AS {aspect}_{side}"
    for aspect, both in sentiment.LEXICON.items()
    for side, own in zip(("positive", "negative"), both, strict=True)
) + " FROM w"


@query("x06_lexicon_aspects", _LEXICON_SQL)
def x06(m):
    return m.comments.select("comment_id", *[c.alias(n) for n, c in sentiment.lexicon_scores(F.col("text")).items()])


@query("x06_fitted_aspects")
def x06_fitted(m):
    """Aspects learnt from the labelled documents (good or poor, decent or toxic),
    scored by chunks and put together for every document."""
    known = m.documents.join(m.labels, "doc_id")
    labelled = known.select("doc_id", "text", F.col("quality").alias("quality_positive"), (1 - F.col("quality")).alias("quality_negative"), (1 - F.col("toxic")).alias("tone_positive"), F.col("toxic").alias("tone_negative"))
    cut = labelled.select("doc_id", F.explode_outer(sentiment.chunks(F.col("text"))).alias("text"), *[c for c in labelled.columns if "_" in c and c != "doc_id"]).where("text is not null")
    model = aspects.fit_aspects(cut, key="doc_id", aspects=("quality", "tone"))
    scored = aspects.score_comments(m.documents.select("doc_id", "text"), model, "doc_id", aspects=("quality", "tone"))
    return scored.select("doc_id", *[F.round(c, 6).alias(c) if dict(scored.dtypes)[c] == "double" else c for c in scored.columns if c != "doc_id"])


_SCORED = "SELECT doc_id, d.source AS entity, DATE '2026-01-01' + CAST(doc_id % 90 AS INT) AS published_at, 1 + log10(n_chars + 1) AS weight, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE l.quality - 0.5 END AS reliability_sentiment, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 0.5 - l.toxic END AS value_sentiment FROM documents d JOIN labels l USING (doc_id)"


def _scored(m):
    d = m.documents.join(m.labels, "doc_id")
    return d.select(
        "doc_id",
        F.col("source").alias("entity"),
        F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")).alias("published_at"),
        (1 + F.log10(F.col("n_chars") + 1)).alias("weight"),
        F.when(F.col("doc_id") % 5 != 0, F.col("quality") - 0.5).cast("double").alias("reliability_sentiment"),
        F.when(F.col("doc_id") % 3 != 0, 0.5 - F.col("toxic")).cast("double").alias("value_sentiment"),
    )


@query("a10_sentiment_index", f"""WITH s AS ({_SCORED}), b AS (SELECT entity, count(*) AS sample_size, (sum(reliability_sentiment * weight) / (sum(CASE WHEN reliability_sentiment IS NOT NULL THEN weight END) + 1e-9) + 1) * 50 AS r,
 ((coalesce(sum(reliability_sentiment * weight), 0) + coalesce(sum(value_sentiment * weight), 0)) / nullif(coalesce(sum(CASE WHEN reliability_sentiment IS NOT NULL THEN weight END), 0) + coalesce(sum(CASE WHEN value_sentiment IS NOT NULL THEN weight END), 0), 0) + 1) * 50 AS e FROM s GROUP BY 1),
p AS (SELECT entity, date_diff('day', DATE '1970-01-01', published_at)::DOUBLE AS x, reliability_sentiment::DOUBLE AS y FROM s WHERE reliability_sentiment IS NOT NULL UNION ALL SELECT entity, date_diff('day', DATE '1970-01-01', published_at)::DOUBLE, value_sentiment::DOUBLE FROM s WHERE value_sentiment IS NOT NULL),
q AS (SELECT entity, count(*) AS n, stddev_pop(y) AS sd, covar_samp(x, y) / nullif(var_pop(x), 0) AS slope FROM p GROUP BY 1)
SELECT b.entity, sample_size, round(r, 4) AS reliability_score, round(e, 4) AS enthusiast_index, CASE WHEN n >= 5 THEN round(sd, 6) END AS volatility, CASE WHEN n >= 5 THEN round(coalesce(slope, 0), 6) END AS trend, CASE WHEN sample_size >= 30 THEN 'High' ELSE 'Low' END AS confidence FROM b LEFT JOIN q USING (entity)""")  # fmt: skip
def a10(m):
    s = sentiment.sentiment_index(_scored(m), aspects=("reliability", "value"))
    return s.select("entity", "sample_size", F.round("reliability_score", 4).alias("reliability_score"), F.round("enthusiast_index", 4).alias("enthusiast_index"), F.round("volatility", 6).alias("volatility"), F.round("trend", 6).alias("trend"), "confidence")


@query("a11_chunk_to_comment", "SELECT conv_id, max(turn > 1) AS x_mentioned, round(max(length(text) / 2000.0), 6) AS x_confidence, round(sum((turn % 3 - 1) * (length(text) / 2000.0)) / nullif(sum(length(text) / 2000.0), 0), 6) AS x_sentiment FROM conversations GROUP BY 1")
def a11(m):
    c = m.conversations.select("conv_id", (F.col("turn") > 1).alias("x_mentioned"), (F.length("text") / 2000.0).alias("x_confidence"), (F.col("turn") % 3 - 1).cast("double").alias("x_sentiment"))
    out = sentiment.comment_aspects(c, "conv_id", "x")
    return out.select("conv_id", "x_mentioned", F.round("x_confidence", 6).alias("x_confidence"), F.round("x_sentiment", 6).alias("x_sentiment"))


@query("d06_cohort_comments", f"WITH s AS ({_SCORED}) SELECT doc_id, entity, 'exact' AS match_type, round(weight, 6) AS weight FROM s WHERE lower(entity) = 'src3' ORDER BY s.weight DESC, published_at DESC, doc_id LIMIT 5")
def d06(m):
    return sentiment.cohort_comments(_scored(m), "entity", "SRC3", "src", tie="doc_id").select("doc_id", "entity", "match_type", F.round("weight", 6).alias("weight"))


_QUEUE = "WITH c AS (SELECT DISTINCT o_custkey AS video_id FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT q.*, c.video_id IS NOT NULL AS has_comments, status IS NULL OR status = 'pending' AS fresh, status IN ('quota_exhausted', 'api_error') AND (next_eligible IS NULL OR next_eligible <= DATE '1999-01-01') AS again FROM {queue_state} q LEFT JOIN c ON q.video_id = c.video_id), b AS (SELECT *, CASE WHEN fresh AND NOT has_comments THEN 1 WHEN again AND NOT has_comments THEN 2 WHEN fresh THEN 3 WHEN again THEN 3 WHEN status IN ('complete', 'zero_comments', 'comments_disabled') AND (next_eligible IS NULL OR next_eligible <= DATE '1999-01-01') THEN 5 ELSE 99 END AS bucket FROM s) "


@query("o04_queue_order", _QUEUE + "SELECT video_id, bucket, has_comments, next_eligible FROM b WHERE bucket < 6 ORDER BY bucket, has_comments, next_eligible NULLS FIRST, video_id LIMIT 400")
def o04(m):
    commented = m.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("video_id"))
    return workqueue.candidates(m.queue_state, commented, F.lit("1999-01-01").cast("date"), 400).select("video_id", "bucket", "has_comments", "next_eligible")


@query("a14_completion", "SELECT playlist_id, count(*) AS total, count(*) FILTER (status IS NULL OR status = 'pending') AS pending, count(*) FILTER (status IN ('complete', 'zero_comments', 'comments_disabled')) AS completed, count(*) FILTER (status IN ('quota_exhausted', 'api_error')) AS retryable FROM {queue_state} GROUP BY 1")
def a14(m):
    return workqueue.completion(m.queue_state, "playlist_id")


@query("t04_unscored_comments", "SELECT comment_id, like_count FROM {comments} WHERE comment_id NOT IN (SELECT doc_id FROM labels) ORDER BY like_count, comment_id LIMIT 100")
def t04(m):
    return workqueue.unscored(m.comments, m.labels.select(F.col("doc_id").alias("comment_id")), order="like_count", n=100).select("comment_id", "like_count")


_T05 = """
WITH d AS (SELECT o_orderkey, o_orderstatus, md5('42:' || o_orderkey) AS h FROM orders),
q AS (SELECT o_orderstatus, least(count(*), greatest(1, round_even(count(*) * 1000 / (SELECT count(*) FROM d), 0)))::BIGINT AS quota FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY h, o_orderkey) AS rn FROM d JOIN q USING (o_orderstatus))
SELECT o_orderkey, o_orderstatus FROM r ORDER BY (rn > quota)::INT, (rn > 1)::INT, h, o_orderkey LIMIT 1000
"""


@query("t05_stratified_sample", _T05)
def t05(m):
    return samples.stratified(m.orders, "o_orderstatus", "o_orderkey", 1000).select("o_orderkey", "o_orderstatus")


@query("t06_time_split", "WITH d AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS x FROM orders), c AS (SELECT quantile_cont(x, 0.8) AS cut FROM d), t AS (SELECT DISTINCT o_custkey FROM d, c WHERE x >= cut) SELECT o_orderkey, CASE WHEN x >= cut THEN 'test' WHEN o_custkey NOT IN (SELECT o_custkey FROM t) THEN 'train' END AS part FROM d, c")
def t06(m):
    return samples.split_by_time(m.orders, "o_custkey", "o_orderdate", least_train=1, least_test=1).select("o_orderkey", "part")


@query("d01_facets", "SELECT 'make' AS facet, canonical_make AS value, count(*) AS n FROM {identity} GROUP BY 2 UNION ALL SELECT 'year', canonical_year::VARCHAR, count(*) FROM {identity} GROUP BY 2")
def d01(m):
    i = m.identity
    f = lambda name, c: i.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("facet"), "value", "n")
    return f("make", "canonical_make").unionByName(f("year", "canonical_year"))


@query("d02_filtered_latest_listings", "WITH l AS (SELECT l.*, canonical_year, row_number() OVER (PARTITION BY l.vin ORDER BY loaddate DESC, date DESC, seq DESC, price DESC) AS rn FROM {listings} l JOIN {identity} i ON l.vin = i.vin WHERE canonical_make = 'BRAND#5' AND price > 0) SELECT vin, loaddate, price, canonical_year FROM l WHERE rn = 1 ORDER BY loaddate DESC, price DESC, vin LIMIT 50")
def d02(m):
    j = cleaning.filters(m.listings.join(m.identity.select("vin", "canonical_make", "canonical_year"), "vin"), canonical_make="BRAND#5")
    rows = history.latest(j, "vin", F.desc("loaddate"), F.desc("date"), F.desc("seq"), F.desc("price"))
    return rows.select("vin", "loaddate", "price", "canonical_year").orderBy(F.desc("loaddate"), F.desc("price"), "vin").limit(50)


@query("d03_vin_history", "WITH u AS (SELECT 'price_history' AS origin, history_date, price, seq FROM {price_history} WHERE vin = 'VIN00000042' UNION ALL SELECT 'listing_history', history_date, price, seq FROM {listing_history} WHERE vin = 'VIN00000042'), r AS (SELECT *, row_number() OVER (PARTITION BY origin, history_date ORDER BY seq, price) AS k FROM u) SELECT origin, history_date, price, price - lag(price) OVER (PARTITION BY origin ORDER BY history_date) AS change FROM r WHERE k = 1")
def d03(m):
    one = F.col("vin") == "VIN00000042"
    cols = ["history_date", "price", "seq"]
    u = m.price_history.where(one).select(F.lit("price_history").alias("origin"), *cols).unionByName(m.listing_history.where(one).select(F.lit("listing_history").alias("origin"), *cols))
    u = upserts.keep_last(u, ["origin", "history_date"], [F.asc("seq"), F.asc("price")])
    return history.changes(u, ["origin"], [F.asc("history_date")], "price").select("origin", "history_date", "price", "change")


@query("d05_position_in_cohort", "WITH r AS (SELECT vin, base_price, canonical_make FROM {identity} WHERE base_price IS NOT NULL) SELECT vin, round(cume_dist() OVER (PARTITION BY canonical_make ORDER BY base_price), 6) AS position, round(base_price / median(base_price) OVER (PARTITION BY canonical_make), 6) AS to_median FROM r")
def d05(m):
    r = m.identity.where("base_price is not null")
    med = r.groupBy("canonical_make").agg(F.percentile("base_price", 0.5).alias("med"))
    w = Window.partitionBy("canonical_make").orderBy("base_price")
    return r.join(med, "canonical_make").select("vin", F.round(F.cume_dist().over(w), 6).alias("position"), F.round(numbers.safe_ratio(F.col("base_price"), F.col("med")), 6).alias("to_median"))


@query("d07_quality_metrics", "SELECT count(*) AS vehicles, round(avg(CASE WHEN canonical_trim IS NULL THEN 0.0 ELSE 1.0 END), 6) AS trim_coverage, count(*) FILTER (confidence = 'high') AS high FROM {identity}")
def d07(m):
    return m.identity.agg(F.count("*").alias("vehicles"), F.round(F.avg(F.col("canonical_trim").isNotNull().cast("double")), 6).alias("trim_coverage"), F.count_if(F.col("confidence") == "high").alias("high"))


@query("d10_depreciation_by_model", "SELECT i.canonical_model, count(*) AS n, round(avg(h.price), 4) AS mean_price FROM " + _LIST + " GROUP BY 1")
def d10(m):
    return m.price_history.join(m.identity, "vin").groupBy("canonical_model").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("mean_price"))


@query("d12_schema_check", "SELECT 'part' AS table_name, count(*) AS n_rows, 0::BIGINT AS n_missing FROM part UNION ALL SELECT 'orders', count(*), 1 FROM orders")
def d12(m):
    want = {"part": ["p_partkey", "p_brand"], "orders": ["o_orderkey", "o_comment"]}
    out = None
    for t, columns in want.items():
        df = m.table(t)
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows", F.lit(len(cleaning.missing_columns(df, columns))).cast("long").alias("n_missing"))
        out = row if out is None else out.unionByName(row)
    return out


@query("d16_flattened_sources", "SELECT d.area, d.doc_id FROM (SELECT 'prices' AS area, doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'cohorts', doc_id FROM documents WHERE doc_id % 3 = 0) d")
def d16(m):
    report = lambda area, k: m.documents.where(F.col("doc_id") % k == 0).groupBy("source").agg(F.collect_list("doc_id").alias("ids")).select(F.lit(area).alias("area"), F.explode("ids").alias("doc_id"))
    return report("prices", 2).unionByName(report("cohorts", 3))


@query("a38_segments_from_map", "SELECT l_returnflag AS model, 'status' AS segment, l_linestatus AS value, round(avg(l_tax), 6) AS mae FROM lineitem GROUP BY 1, 3")
def a38(m):
    inner = m.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_tax"), 6).alias("mae"))
    maps = inner.groupBy(F.col("l_returnflag").alias("model")).agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "mae"))).alias("m"))
    return kpi.segments_from_report(maps.select("model", F.create_map(F.lit("status"), F.col("m")).alias("metrics")), "metrics")


@query("f12_vehicle_entities")
def f12(m):
    titles = m.listings.select("seq", F.concat_ws(" ", F.substring("title", 1, 4), F.lit("Toyota"), F.initcap("seller_type"), F.lit("review")).alias("title"))
    return titles.select("seq", sentiment.vehicle_entity(F.col("title")).alias("entity"), text.word_count(F.col("title")).alias("words"))
