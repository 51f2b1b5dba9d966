"""Sources, projections, filters, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import cleaning, history
from ledgerline.plans.registry import query
from ledgerline.sources import files, samples, upserts


@query("s01_scan_projection", "SELECT vin, history_date, price FROM {price_history} WHERE price BETWEEN 1000 AND 1000000 AND mileage IS NOT NULL")
def s01(m):
    return cleaning.in_price_range(m.price_history, "price").where("mileage is not null").select("vin", "history_date", "price")


@query("s02_bound_sql", "SELECT vin, canonical_make, canonical_year FROM {identity} WHERE canonical_year = 1992 AND canonical_make = 'BRAND#2'")
def s02(m):
    return files.query(m.spark, "SELECT vin, canonical_make, canonical_year FROM {ident} WHERE canonical_year = :y AND canonical_make = :k", {"y": 1992, "k": "BRAND#2"}, ident=m.identity)


@query("s03_recent_sample", "SELECT vin, history_date, price, seq FROM {price_history} ORDER BY history_date DESC, seq DESC, vin DESC, price DESC LIMIT 500")
def s03(m):
    return samples.scoped(m.price_history.select("vin", "history_date", "price", "seq"), 500, "recent", [F.desc(c) for c in ("history_date", "seq", "vin", "price")])


@query("s04_even_sample", "WITH t AS (SELECT max(o_orderkey) AS top FROM orders), p AS (SELECT 1 + floor(i * (top - 1.0) / 200)::BIGINT AS pick FROM range(200) r(i), t) SELECT o_orderkey, o_custkey FROM orders JOIN p ON o_orderkey = pick")
def s04(m):
    return samples.evenly_numbered(m.orders.select("o_orderkey", "o_custkey"), "o_orderkey", 200)


@query("s05_recent_keys_full_history", "WITH h AS (SELECT vin, history_date, price, seq FROM {price_history}), r AS (SELECT DISTINCT vin FROM (SELECT vin FROM h ORDER BY history_date DESC, seq DESC, vin DESC, price DESC LIMIT 100)) SELECT h.* FROM h WHERE vin IN (SELECT vin FROM r)")
def s05(m):
    return samples.recent_keys_full_history(m.price_history.select("vin", "history_date", "price", "seq"), "vin", 100, [F.desc(c) for c in ("history_date", "seq", "vin", "price")])


@query("s10_schema_tolerant_read", "SELECT c_custkey, NULL::VARCHAR AS c_phone, c_name FROM customer")
def s10(m):
    return m.customer.select(*files.select_or_null(m.customer, ["c_custkey", "c_phone", "c_name"]))


@query("s17_profile", "SELECT count(*) AS n_rows, min(price) AS min_price, round(avg(price), 4) AS avg_price, max(price) AS max_price FROM {price_history}")
def s17(m):
    return files.profile(m.price_history, "price").withColumn("avg_price", F.round("avg_price", 4))


@query("s24_empty_relation", "SELECT p_partkey AS id, (1990 + p_size % 5)::INT AS year, p_brand AS make, p_type AS model, NULL::VARCHAR AS \"baseModel\", NULL::VARCHAR AS normalized_make, NULL::VARCHAR AS normalized_model, NULL::VARCHAR AS normalized_base_model FROM part")
def s24(m):
    """The typed empty catalog gives its columns and types to rows that lack some."""
    rows = m.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5 + 1990).cast("int").alias("year"), F.col("p_brand").alias("make"), F.col("p_type").alias("model"))
    return files.empty_catalog(m.spark).unionByName(rows, allowMissingColumns=True)


@query("p03_non_empty", "SELECT doc_id, n_chars FROM documents WHERE trim(text) <> '' AND trim(lang) <> ''")
def p03(m):
    return cleaning.non_empty(m.documents, "text", "lang").select("doc_id", "n_chars")


@query("p04_blacklist", "SELECT vin, price FROM {listings} WHERE vin NOT IN ('VIN00000001', 'VIN00000002')")
def p04(m):
    return m.listings.where(~F.col("vin").isin("VIN00000001", "VIN00000002")).select("vin", "price")


@query("p07_ensure_columns", "SELECT p_partkey, NULL::DOUBLE AS msrp, NULL::VARCHAR AS trim2 FROM part")
def p07(m):
    return cleaning.ensure_columns(m.part.select("p_partkey"), msrp="double", trim2="string")


@query("p09_conjunctive_filters", "SELECT vin, canonical_model, base_price FROM {identity} WHERE canonical_make = 'BRAND#4' AND canonical_year = 1993 AND base_price > 0")
def p09(m):
    return cleaning.filters(m.identity, "base_price", canonical_make="BRAND#4", canonical_model=None, canonical_year=1993).select("vin", "canonical_model", "base_price")


@query("p11_valid_vin", "SELECT c_custkey, c_name FROM customer WHERE length(trim(c_name)) >= 3 AND NOT contains(c_name, '*') AND NOT contains(lower(c_name), 'invalid')")
def p11(m):
    from ledgerline.functions.text import valid_vin

    return m.customer.where(valid_vin(F.col("c_name"))).select("c_custkey", "c_name")


@query("p14_support_filters", "WITH c AS (SELECT l_partkey AS k, date_trunc('month', l_shipdate)::DATE AS month_start, count(*) AS unique_vins FROM lineitem GROUP BY 1, 2), f AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM c WHERE unique_vins >= 2) SELECT k, month_start, unique_vins FROM f WHERE n >= 3")
def p14(m):
    from ledgerline.operators.cohort import supported

    c = m.lineitem.groupBy(F.col("l_partkey").alias("k"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month_start")).agg(F.count("*").alias("unique_vins"))
    return supported(c, ["k"], 2, 3)


@query("p15_filter_after_limit", "WITH t AS (SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000) SELECT * FROM t WHERE o_orderpriority = '1-URGENT'")
def p15(m):
    return m.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1000).where("o_orderpriority = '1-URGENT'")


@query("p21_in_list_latest", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY loaddate DESC, seq DESC, price DESC) AS rn FROM {listings} WHERE vin IN ('VIN00000003', 'VIN00000005', 'VIN00000007')) SELECT vin, loaddate, price FROM r WHERE rn = 1")
def p21(m):
    hits = m.listings.where(F.col("vin").isin("VIN00000003", "VIN00000005", "VIN00000007"))
    return history.latest(hits, "vin", F.desc("loaddate"), F.desc("seq"), F.desc("price")).select("vin", "loaddate", "price")


@query("p22_conform_layout", "SELECT try_cast(event_id AS VARCHAR) AS event_id, NULL::INTEGER AS like_count, try_cast(value AS DOUBLE) AS value FROM events")
def p22(m):
    return cleaning.conform(m.events, {"event_id": "string", "like_count": "int", "value": "double"})


@query("o01_mixed_sort", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")
def o01(m):
    return m.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy("o_orderstatus", F.desc("o_totalprice"), "o_orderkey")


@query("o07_nulls_last_sort", "SELECT vin, mileage, seq, price FROM {price_history} ORDER BY mileage NULLS LAST, seq, vin, price")
def o07(m):
    return m.price_history.select("vin", "mileage", "seq", "price").orderBy(F.asc_nulls_last("mileage"), "seq", "vin", "price")


@query("u01_union_sources", "SELECT vin, history_date, price, 'price_history' AS origin, trend FROM {price_history} UNION ALL SELECT vin, history_date, price, 'listing_history', NULL FROM {listing_history}")
def u01(m):
    a = m.price_history.select("vin", "history_date", "price", F.lit("price_history").alias("origin"), "trend")
    return a.unionByName(m.listing_history.select("vin", "history_date", "price", F.lit("listing_history").alias("origin")), allowMissingColumns=True)


@query("u03_distinct_options", "SELECT DISTINCT canonical_make, canonical_year FROM {identity}")
def u03(m):
    return m.identity.select("canonical_make", "canonical_year").distinct()


@query("u04_keep_first_last", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS z FROM orders) SELECT o_custkey, max(CASE WHEN a = 1 THEN o_orderkey END) AS first_order, max(CASE WHEN z = 1 THEN o_orderkey END) AS last_order FROM r GROUP BY 1")
def u04(m):
    first = upserts.keep_last(m.orders, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")])
    last = upserts.keep_last(m.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return first.select("o_custkey", F.col("o_orderkey").alias("first_order")).join(last.select("o_custkey", F.col("o_orderkey").alias("last_order")), "o_custkey")


@query("u06_set_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def u06(m):
    return m.part.select("p_partkey").subtract(m.lineitem.where("l_quantity > 40").select("l_partkey"))


@query("k01_replace_rows", "WITH o AS (SELECT vin, loaddate, price, seq, 0 AS new FROM {listings} WHERE seq % 3 > 0), n AS (SELECT vin, loaddate, price + 1 AS price, seq, 1 AS new FROM {listings} WHERE seq % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vin, loaddate ORDER BY new DESC, seq DESC, price DESC) AS rn FROM (SELECT * FROM o UNION ALL SELECT * FROM n)) SELECT vin, loaddate, price, seq FROM r WHERE rn = 1")
def k01(m):
    rows = m.listings.select("vin", "loaddate", "price", (F.col("seq") * 1_000_000 + F.col("price")).alias("order"), "seq")
    out = upserts.replace_rows(rows.where("seq % 3 > 0"), rows.where("seq % 3 = 0").withColumns({"price": F.col("price") + 1, "order": F.col("order") + 1}), ["vin", "loaddate"], "order")
    return out.select("vin", "loaddate", "price", "seq")


@query("k02_first_wins_null_distinct", "WITH r AS (SELECT vin, history_date, price, mileage, seq, row_number() OVER (PARTITION BY vin, history_date, mileage ORDER BY seq, price) AS rn FROM {listing_history}) SELECT vin, history_date, price, mileage, seq FROM r WHERE rn = 1 OR mileage IS NULL")
def k02(m):
    return upserts.keep_first_or_null(m.listing_history, ["vin", "history_date", "mileage"], [F.asc("seq"), F.asc("price")])


@query("k04_insert_new", "SELECT doc_id AS comment_id, source, strftime(DATE '2026-01-03' + CAST(doc_id % 300 AS INT), '%m-%d-%Y') AS published FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k04(m):
    from ledgerline.functions.dates import us_text

    new = m.documents.select(F.col("doc_id").alias("comment_id"), "source")
    out = upserts.insert_new(m.labels.select(F.col("doc_id").alias("comment_id")), new, "comment_id", [F.asc("source")])
    return out.withColumn("published", us_text(F.date_add(F.lit("2026-01-03").cast("date"), (F.col("comment_id") % 300).cast("int"))))


@query("k05_merge_keep_old", "WITH n AS (SELECT video_id, CASE WHEN video_id % 5 = 0 THEN NULL ELSE 'complete' END AS status, 'P2' AS playlist_id FROM {queue_state} WHERE video_id % 2 = 0 UNION ALL SELECT 900000001, 'pending', 'P9') SELECT coalesce(o.video_id, n.video_id) AS video_id, CASE WHEN n.video_id IS NOT NULL THEN n.status ELSE o.status END AS status, coalesce(o.playlist_id, n.playlist_id) AS playlist_id, o.comments_seen FROM {queue_state} o FULL JOIN n ON o.video_id = n.video_id")
def k05(m):
    s = m.queue_state.select("video_id", "status", "playlist_id", "comments_seen")
    n = s.where("video_id % 2 = 0").select("video_id", F.when(F.col("video_id") % 5 == 0, None).otherwise("complete").alias("status"), F.lit("P2").alias("playlist_id"))
    n = n.unionByName(m.spark.sql("SELECT 900000001L AS video_id, 'pending' AS status, 'P9' AS playlist_id"))
    return upserts.merge_rows(s, n, "video_id", overwrite=["status"], keep_old=["playlist_id"])


@query("k14_duplicate_keys", "SELECT l_orderkey * 10 + l_linenumber AS seq, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def k14(m):
    return upserts.duplicate_keys(m.price_history, "seq")
