"""Quality rules by tokeniser fertility.

One pass measures each whole text: word and line counts for the base rules, and
under a public vocabulary with byte fallback the characters per token, the share
of byte-fallback tokens and the evenness of the tokens (their entropy over that
of as many different tokens). Rejection bands per language, or per script where
no language is known, are robust fences around the quartiles of all documents
of that group which pass the base rules."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import ASCII_WORD, bound_arrow, materialize, mix64, text_slices, trimmed, word_codes

#: Characters that count as symbols (fixed value).
SYMBOLS = "#*$%&|<>"
#: Words of a window in the repetition rule.
WINDOW = 8
#: Script names with their code point ranges (fixed values).
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F))),
    ("greek", ((0x370, 0x3FF),)),
    ("cyrillic", ((0x400, 0x52F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF),)),
    ("devanagari", ((0x900, 0x97F),)),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x4E00, 0x9FFF),)),
    ("hangul", ((0xAC00, 0xD7AF),)),
)
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_bytes_tokens", "n_chars_total")
_BLANK_BYTES = tuple(f"<0x{b:02X}>" for b in (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20))
#: Tokens without a byte that every text is taken to hold besides its own: the
#: share of a short text says little, and one odd letter is three byte tokens.
PRIOR_TOKENS = 300
#: Rows of fences that are broadcast at most; more are joined in a shuffle.
FENCES = 10_000
_models: dict[str, object] = {}


def piece_model(path: str):
    """The sentencepiece model of a file, loaded once per worker."""
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def repeated_words(codes: np.ndarray, cuts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For texts laid end to end as word codes (cuts: where each starts, plus
    the end), the words in windows that their text holds twice or more."""
    n = len(codes) - window + 1
    if n <= 0:
        return np.zeros(len(cuts) - 1, np.int64)
    doc = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    with np.errstate(over="ignore"):
        key = mix64(doc[:n].astype(np.uint64) + np.uint64(1))
        for i in range(window):
            key = mix64(key * np.uint64(31) + codes[i : n + i].astype(np.uint64) + np.uint64(1))
    whole = np.flatnonzero(doc[:n] == doc[window - 1 :])
    key = key[whole]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    starts = whole[twice]
    edge[starts] += 1
    np.subtract.at(edge, starts + window, 1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return covered[cuts[1:]] - covered[cuts[:-1]]


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if ASCII_WORD.search(x)]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """Script of most letters of a text ('none' without letters of a known one)."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    counts = [sum(int(((points >= a) & (points <= b)).sum()) for a, b in ranges) for _, ranges in SCRIPTS]
    return SCRIPTS[int(np.argmax(counts))][0] if any(counts) else "none"


def token_evenness(ids: list[list[int]]) -> np.ndarray:
    """Entropy of each text's tokens over the logarithm of their number; 1 for
    fewer than two tokens."""
    out = np.ones(len(ids))
    for i, own in enumerate(ids):
        n = len(own)
        if n > 1:
            counts = np.unique(np.asarray(own, np.int32), return_counts=True)[1]
            out[i] = (np.log(n) - (counts * np.log(counts)).sum() / n) / np.log(n)
    return out


def _measure(model_path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        # line ends and tabs are byte tokens in any text; they say nothing of its fit
        byte_ids = np.array([model.is_byte(i) and model.id_to_piece(i) not in _BLANK_BYTES for i in range(model.get_piece_size())])
        for part, texts in text_slices(batches, "text"):
            lists = [ASCII_WORD.findall(t) for t in texts]
            flat = [w for x in lists for w in x]
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            codes = word_codes(flat)[0] if flat else np.zeros(0, np.int32)
            chars = np.concatenate([[0], np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))])
            ids = model.encode(texts, num_threads=1)
            groups = [g.as_py() if g.is_valid else None for g in part.column(part.schema.get_field_index("lang"))]
            columns = [
                np.diff(cuts),
                chars[cuts[1:]] - chars[cuts[:-1]],
                np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
                np.array([repeated_lines(t) for t in texts], np.int64),
                repeated_words(codes, cuts),
                np.array([len(x) for x in ids], np.int64),
                np.array([int(byte_ids[x].sum()) if x else 0 for x in ids], np.int64),
                np.array([len(t) for t in texts], np.int64),
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([f"lang:{g}" if g else f"script:{script_of(t)}" for g, t in zip(groups, texts, strict=True)], pa.string()),
                    *[pa.array(c.astype(np.int64)) for c in columns],
                    pa.array(token_evenness(ids)),
                ],
                ["id", "band", *_MEASURES, "evenness"],
            )

    return trimmed(run)


def measure(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Measures of every whole text: (id_col, band, the counts, evenness,
    chars_per_token, byte_share). byte_share is drawn towards 0 by PRIOR_TOKENS,
    at every length. Null and empty texts count nothing; their ratios are 0."""
    source = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    bound_arrow(docs.sparkSession)
    got = source.mapInArrow(_measure(model_path), f"id {kind}, band string, " + ", ".join(f"{m} long" for m in _MEASURES) + ", evenness double")
    per = F.when(F.col("n_tokens") > 0, F.col("n_chars_total") / F.col("n_tokens")).otherwise(0.0)
    share = F.when(F.col("n_tokens") > 0, F.col("n_bytes_tokens") / (F.col("n_tokens") + PRIOR_TOKENS)).otherwise(0.0)
    return got.withColumn("chars_per_token", per).withColumn("byte_share", share).withColumnRenamed("id", id_col)


def judge(measures: DataFrame, spread: float = 4.0, least_width: float = 0.01, max_repeat_percent: int = 30, min_words: int = 20) -> DataFrame:
    """Adds base_failed, the fences of the row's band and kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent of
    the words in repeated windows. The fences are `spread` interquartile ranges
    (of least_width, only where the quartiles are equal) beyond the quartiles of
    the documents that pass the base rules: chars_per_token on both sides,
    byte_share above, evenness below. Quartiles are exact over measures of four
    decimals, so that reruns agree. A group in which nothing passes the base rules rejects nothing more.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    m = measures.withColumn("base_failed", failed)
    quartiles = m.where(~F.col("base_failed")).groupBy("band").agg(*[F.percentile(F.round(c, 4), F.array(F.lit(0.25), F.lit(0.75))).alias(f"q_{c}") for c in ("chars_per_token", "byte_share", "evenness")])

    def fence(c: str, side: int):
        q = F.col(f"q_{c}")
        width = F.when(q[1] > q[0], q[1] - q[0]).otherwise(F.lit(least_width))
        return (q[1] + spread * width) if side > 0 else (q[0] - spread * width)

    bands = materialize(quartiles, "quartiles").select(
        F.col("band").alias("__band"), fence("chars_per_token", -1).alias("min_chars_per_token"), fence("chars_per_token", 1).alias("max_chars_per_token"), fence("byte_share", 1).alias("max_byte_share"), fence("evenness", -1).alias("min_evenness")
    )
    inside = F.col("chars_per_token").between(F.col("min_chars_per_token"), F.col("max_chars_per_token")) & (F.col("byte_share") <= F.col("max_byte_share")) & (F.col("evenness") >= F.col("min_evenness"))
    if bands.count() <= FENCES:
        bands = F.broadcast(bands)
    return m.join(bands, F.col("band") == F.col("__band"), "left").drop("__band").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def quality_rules(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """Measures and verdict of every document, one row per input row (repeated
    rows and null ids included; a null text has no words and fails). Texts of any
    length are measured whole, a null language goes by script, extra columns are
    ignored; no documents give no rows."""
    return judge(materialize(measure(docs, model_path, id_col, text_col, lang_col), "measures"), **how)
