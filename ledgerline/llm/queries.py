"""Thin queries over the corpus tables, one per operator."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.chat_tools import link_tool_calls, schema_table, tool_calls_and_exchanges
from ledgerline.llm.common import materialize, shared_path
from ledgerline.llm.decontam import find_contamination
from ledgerline.llm.fim import fill_in_middle, restore
from ledgerline.llm.html_text import extract_main_text
from ledgerline.llm.line_dedup import dedup_lines
from ledgerline.llm.mixing import mix
from ledgerline.llm.ngram_join import ngram_join
from ledgerline.llm.quality import quality_rules
from ledgerline.llm.token_counts import length_histogram, suffix_sums
from ledgerline.llm.token_files import read_token_files, write_token_files
from ledgerline.llm.toxicity import fit_on_labels, score
from ledgerline.llm.turn_repair import damaged, joined_text, repair_conversations
from ledgerline.llm.url_filter import addresses_of_labelled, filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file: in $TOKENIZER_DIR, else in the installed set."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals for every context limit; null texts are empty, repeated rows and null
    ids count, texts are encoded whole; no documents give no rows."""
    histogram = materialize(length_histogram(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken")), "lengths")
    return suffix_sums(histogram)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, distance); nulls and empty texts match nothing, repeated
    rows repeat, null ids stay null; an empty table gives no rows."""
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with what stays of them, as dedup_lines() says of nulls, repeats, long
    lines and empty tables."""
    return dedup_lines(_table(spark, sf_dir, "documents"), with_text=False)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; null texts have size 0, a null source is
    one of its own, repeated rows are taken apart; no documents give no rows."""
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The order by md5 keys, the water level and the cut are all plain SQL.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'text:' || coalesce(md5(text), ''))) AS key
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT] AS weight,
         3 * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER ())::BIGINT AS total FROM w),
l AS (
  SELECT *, (total - coalesce((sum(cap) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))
            / sum(weight) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
v AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, src LIMIT 1),
t AS (SELECT src, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM v) * weight, 0.0)) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce((sum(d.size) OVER (PARTITION BY d.src ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS prior
  FROM d JOIN t USING (src))
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size
             + greatest(0, least(size, budget % source_size - prior)) ELSE 0 END)::BIGINT AS taken
FROM p
"""


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all addresses; those of labelled documents' pages teach the model."""
    pages = _table(spark, sf_dir, "pages")
    return filter_urls(pages, _table(spark, sf_dir, "documents"), labelled=addresses_of_labelled(pages, _table(spark, sf_dir, "labels")))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from the files; null texts are the end id alone, null
    ids come first, repeated rows stay; no documents give no rows."""
    path = shared_path(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return read_token_files(spark, path)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document; texts without words, null ones too, have
    no links, repeated rows are copies; no documents give no rows."""
    return ngram_join(_table(spark, sf_dir, "documents"))


def op8_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked records of all conversations; null turns come first and stay null, null
    texts are left out of the JSON, repeated rows are kinds of their own."""
    return link_tool_calls(*tool_calls_and_exchanges(_table(spark, sf_dir, "conversations")), schema_table(spark))


#: Plain exchanges have no repeated identifiers and no dependency on a later
#: turn, so plain joins give the records and the turn their order.
OP8_SQL = """
WITH u AS (SELECT * FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, conv_id || ':' || turn AS call_id, text FROM u),
r AS (
  SELECT c.conv_id, c.turn, 'call' AS kind, c.call_id, 'reply' AS name, a.turn IS NOT NULL AS linked,
         '{"arguments":{"text":' || to_json(c.text)::VARCHAR || ',"turn":' || c.turn || '},"call_id":"' || c.call_id || '","name":"reply"'
         || CASE WHEN a.turn IS NOT NULL THEN ',"result":' || to_json(a.text)::VARCHAR || ',"result_turn":' || a.turn ELSE '' END
         || ',"turn":' || c.turn || '}' AS json
  FROM c LEFT JOIN a USING (conv_id, call_id)
  UNION ALL
  SELECT a.conv_id, a.turn, 'orphan_result', a.call_id, NULL, FALSE,
         '{"call_id":"' || a.call_id || '","content":' || to_json(a.text)::VARCHAR || ',"turn":' || a.turn || '}'
  FROM a WHERE call_id NOT IN (SELECT call_id FROM c)
  UNION ALL
  SELECT conv_id, turn, 'message', NULL, NULL, FALSE,
         '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || ',"turn":' || turn || '}'
  FROM conversations WHERE role NOT IN ('user', 'assistant'))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, kind, call_id) - 1 AS seq, turn, kind, call_id, name,
       linked, TRUE AS valid, '' AS errors, json
FROM r
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts; null texts have no words and fail the base rules,
    repeated rows and null ids are judged alike; no documents give no rows."""
    rules = quality_rules(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "byte_share", "evenness")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document; null and empty texts have no features,
    repeated rows are scored alike; no documents give no rows."""
    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit_on_labels(docs, _table(spark, sf_dir, "labels")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the code point form of every document and of the text restored
    from it; a null text is empty, repeated rows stay, no documents give no rows."""
    cut = fill_in_middle(_table(spark, sf_dir, "documents"))
    back = restore(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (
  SELECT doc_id, t, n, ('0x' || substring(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substring(h, 9, 8))::BIGINT % (n + 1) AS y,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substring(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substring(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b FROM g),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired text of every
    conversation, after the planted damage; zeros, an empty audit and the digest
    of nothing where no row is left."""
    turns = _table(spark, sf_dir, "conversations")
    report, repaired = repair_conversations(damaged(turns), copies_col="copies")
    key = F.coalesce(F.concat(F.lit("s"), F.col("conv_id").cast("string")), F.lit("t"))
    every = turns.groupBy("conv_id").agg(F.lit(1)).select("conv_id", key.alias("conv"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    found = every.join(report.drop("conv_id"), "conv", "left").join(joined_text(repaired), "conv", "left")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest.alias("repaired_sha256"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article text of every page; nulls, empty pages, repeats and long pages as
    extract_main_text() says."""
    return extract_main_text(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_decontamination, op3_line_dedup, op4_mix_sources, op5_url_filter, op6_token_files, op7_ngram_jaccard_join, op8_chat_tools, op9_quality_rules, op10_toxicity, op11_fill_in_middle, op12_turn_repair, op13_html_text)}
ORACLES: dict[str, str] = {"op4_mix_sources": OP4_SQL, "op8_chat_tools": OP8_SQL, "op11_fill_in_middle": OP11_SQL}
