"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing and
token files, each stage over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import materialize, scratch, shared_path
from ledgerline.llm.decontam import decontaminate
from ledgerline.llm.mixing import mix, repeat_documents
from ledgerline.llm.ngram_join import keep_representatives
from ledgerline.llm.queries import vocabulary
from ledgerline.llm.token_files import read_token_files, write_token_files
from ledgerline.llm.toxicity import drop_toxic, fit_on_labels

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


# Every stage takes any documents with COLUMNS (further ones are left out) and
# gives an empty table for an empty one; a null text is an empty one.


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject, row by row: whole texts
    of any length, repeated rows alike; null and empty texts and null ids stay.
    Without labels of both kinds nothing goes."""
    model = fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return drop_toxic(docs.select(*COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies, the one with the
    least id (null last, then the least hash of its text). Of rows alike in id
    and text one stays; texts without words, null ones too, stay otherwise."""
    return keep_representatives(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, row by row; null and empty
    texts and null ids stay, without a benchmark everything does."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, cut at the budgets.
    A null source is one of its own; texts without words take no part and go;
    repeated rows and ids count one by one, in an order that reruns repeat."""
    mixed = mix(docs.select(*COLUMNS), carry=COLUMNS)
    return repeat_documents(mixed).select(*COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The coded files' documents: doc_id, start, n_tokens, ids_crc32, one row
    per document, null ids first, rows that share an id by a hash of their ids."""
    path = shared_path(spark, "token-files")
    write_token_files(docs, path, vocabulary("word_bpe_49k.json"))
    return read_token_files(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: No stage but the mixing can be said in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again, and what a
    stage made on its way is deleted before the next one starts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        with scratch():
            docs = materialize(stage(spark, docs, sf_dir), name, path)
    return STAGES[-1][1](spark, docs, sf_dir)
