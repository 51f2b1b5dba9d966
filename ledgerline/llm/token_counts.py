"""Exact length histogram of encoded documents.

Documents are aggregated by the number of their tokens. Sums over the suffix of
the histogram, the longer documents, then answer totals, quantiles and
truncated totals for every context limit without touching a document again."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bound_arrow, prefix_sums, text_slices, trimmed

#: Pre-tokenisation pattern of the 50k byte-level vocabularies (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths that share a range of the histogram in the distributed sums.
RANGE = 1 << 10

_encodings: dict[str, object] = {}


def byte_bpe(path: str):
    """The encoding of a file of base64 ranks, loaded once per worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def with_lengths(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns and `length`, the number of tokens of the whole text
    (null or empty: 0)."""
    source = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    names = [*keep, "length"]
    bound_arrow(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_bpe(vocabulary)
        for part, texts in text_slices(batches, "__text"):
            sizes = pa.array([len(encoding.encode_ordinary(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], sizes], names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return source.mapInArrow(trimmed(run), ", ".join([*fields, "length long"]))


def length_histogram(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """Rows (length, n_docs), one per occurring length; an empty table gives none.
    Null and empty texts have length 0, repeated rows and null ids count, texts
    of any length are encoded whole, extra columns are ignored."""
    return with_lengths(docs, vocabulary, text_col).groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L: n_docs, docs_longer and tokens_longer (of documents
    with more than L tokens), and for L as context limit truncated_total, the
    tokens that are left, and lost_total, the tokens cut off; total_docs and
    total_tokens are those of the whole table, share_within the documents that
    fit. An empty histogram gives no rows; a length stands in it once, other
    columns are ignored."""
    h = histogram.withColumn("__range", -F.floor(F.col("length") / RANGE)).withColumn("__order", -F.col("length")).withColumn("__tokens", F.col("length") * F.col("n_docs"))
    whole = h.agg(F.sum("n_docs").alias("total_docs"), F.sum("__tokens").alias("total_tokens"))
    s = prefix_sums(h, [], "__range", ["__order"], {"docs_longer": "n_docs", "tokens_longer": "__tokens"}).join(F.broadcast(whole))
    lost = F.col("tokens_longer") - F.col("length") * F.col("docs_longer")
    return s.select(
        "length",
        "n_docs",
        "docs_longer",
        "tokens_longer",
        (F.col("total_tokens") - lost).alias("truncated_total"),
        lost.alias("lost_total"),
        "total_docs",
        "total_tokens",
        ((F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs")).alias("share_within"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_longer, truncated_total) for any context limits, read off
    the suffix sums: of the lengths above a limit only the least one counts."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "limit long")
    aggs = []
    for x in sorted(set(limits)):
        above = F.when(F.col("length") > x, F.struct("length", (F.col("docs_longer") + F.col("n_docs")).alias("d"), (F.col("tokens_longer") + F.col("n_docs") * F.col("length")).alias("t")))
        aggs.append(F.struct(F.lit(int(x)).cast("long").alias("limit"), F.min(above).alias("at"), F.max("total_tokens").alias("total")).alias(f"l{x}"))
    row = sums.agg(*aggs).select(F.explode(F.array(*[f"l{x}" for x in sorted(set(limits))])).alias("x"))
    lost = F.coalesce(F.col("x.at.t") - F.col("x.limit") * F.col("x.at.d"), F.lit(0))
    got = row.select(F.col("x.limit").alias("limit"), F.coalesce(F.col("x.at.d"), F.lit(0)).alias("docs_longer"), (F.coalesce(F.col("x.total"), F.lit(0)) - lost).alias("truncated_total"))
    return asked.join(got, "limit")


def length_quantiles(sums: DataFrame, qs: list[float]) -> DataFrame:
    """(q, length): the least length that at least a share q of the documents
    does not exceed; null for an empty table."""
    aggs = [F.struct(F.lit(float(q)).alias("q"), F.min(F.when(F.col("total_docs") - F.col("docs_longer") >= F.lit(float(q)) * F.col("total_docs"), F.col("length"))).alias("length")).alias(f"q{i}") for i, q in enumerate(qs)]
    return sums.agg(*aggs).select(F.explode(F.array(*[f"q{i}" for i in range(len(qs))])).alias("x")).select("x.q", "x.length")
