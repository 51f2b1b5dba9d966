"""Market-shaped views over the star-schema tables.

The operators take any columns; these views give the TPC-H-like tables the shape
of listings, histories, identities and comments. Each is one SELECT that Spark
and other engines read alike, so an oracle can start from the same rows. Nulls
are put in by key arithmetic, as the tables have none."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_VIN = "concat('VIN', lpad(CAST({0} AS STRING), 8, '0'))"
_PRICE = "CAST(round(l_extendedprice) AS BIGINT) AS price"
_MILEAGE = "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(round(l_quantity * 1000) AS BIGINT) END AS mileage"
_SEQ = "l_orderkey * 10 + l_linenumber AS seq"

VIEWS = {
    "price_history": f"SELECT {_VIN.format('l_partkey')} AS vin, CAST(l_shipdate AS DATE) AS history_date, {_PRICE}, {_MILEAGE}, l_returnflag AS trend, {_SEQ} FROM lineitem",
    "listing_history": f"SELECT {_VIN.format('l_partkey')} AS vin, CAST(o_orderdate AS DATE) AS history_date, {_PRICE}, {_MILEAGE}, {_SEQ} FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "listings": f"SELECT {_VIN.format('l_partkey')} AS vin, CAST(l_shipdate AS DATE) AS loaddate, CAST(o_orderdate AS DATE) AS date, {_PRICE}, {_MILEAGE}, {_SEQ}, "
    "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE s_name END AS source_name, l_linestatus AS seller_type, l_returnflag AS listing_type, "
    "concat_ws(' ', CAST(1990 + p_size % 5 AS STRING), p_brand, p_type, p_name) AS title, o_orderpriority AS title_desc, s_nationkey AS location_code "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey",
    "identity": f"SELECT {_VIN.format('p_partkey')} AS vin, upper(p_brand) AS canonical_make, upper(p_type) AS canonical_model, 1990 + p_size % 5 AS canonical_year, "
    "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE upper(split_part(p_name, ' ', 2)) END AS canonical_trim, upper(split_part(p_name, ' ', 1)) AS body_class, "
    "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS base_price, CASE WHEN p_partkey % 3 = 0 THEN 'high' WHEN p_partkey % 3 = 1 THEN 'medium' ELSE 'low' END AS confidence FROM part",
    "comments": "SELECT doc_id AS comment_id, source AS video_id, text, n_chars AS like_count, lang FROM documents",
    "queue_state": "SELECT c_custkey AS video_id, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN 'pending' WHEN c_custkey % 7 = 2 THEN 'quota_exhausted' WHEN c_custkey % 7 = 3 THEN 'api_error' WHEN c_custkey % 7 = 4 THEN 'complete' "
    "WHEN c_custkey % 7 = 5 THEN 'zero_comments' ELSE 'comments_disabled' END AS status, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST('1998-01-01' AS DATE) + CAST(c_custkey % 800 AS INT) END AS next_eligible, "
    "c_mktsegment AS playlist_id, c_acctbal AS comments_seen FROM customer",
}


def sql_of(text: str) -> str:
    """A query in which {view} stands for the SELECT of that view."""
    return re.sub(r"\{(\w+)\}", lambda m: f"({VIEWS[m[1]]})" if m[1] in VIEWS else m[0], text)


class Market:
    """The tables of a folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.table(name)
        used = {t for t in ("lineitem", "orders", "part", "supplier", "customer", "documents") if re.search(rf"\b{t}\b", VIEWS[name])}
        return self.spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", VIEWS[name]), **{t: self.table(t) for t in used})
