"""Fitted aspect scores of text chunks: hashed words and word pairs, one logistic
regression for each side of an aspect, in the shape that comment_aspects() takes.

Labels are columns (aspect_positive, aspect_negative) of 1, 0 or null for not
known. Where no labels are at hand, cue words give weak ones; chunks whose cues
are all of one side then teach the words around them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import numbers
from ledgerline.operators import sentiment
from ledgerline.session import cut_lineage

SIDES = ("positive", "negative")
#: Slots of words and of pairs; rows that a model is fitted on at most.
SLOTS, MOST_ROWS = 1 << 13, 20_000


def features(text_col: str = "text") -> list:
    """Stages from a text to its vector of hashed words and pairs."""
    return [
        RegexTokenizer(inputCol=text_col, outputCol="__words", pattern=r"[^\p{L}\p{N}']+", toLowercase=True),
        NGram(n=2, inputCol="__words", outputCol="__pairs"),
        HashingTF(numFeatures=SLOTS, binary=True, inputCol="__words", outputCol="__w"),
        HashingTF(numFeatures=SLOTS, binary=True, inputCol="__pairs", outputCol="__p"),
        VectorAssembler(inputCols=["__w", "__p"], outputCol="__x"),
    ]


def weak_labels(chunks: DataFrame, text_col: str = "text", lexicon: dict[str, tuple[str, str]] = sentiment.LEXICON, hide_percent: int = 50) -> DataFrame:
    """chunks with label columns from cue words: 1 for a side whose cues alone
    occur, 0 for the other side and for texts of other aspects' cues, null where
    no cue of any aspect or cues of both sides occur. In hide_percent of the
    chunks, by a hash, the cues are taken out of the text, so that the words
    around them are learnt too."""
    words = F.split(F.lower(text_col), r"[^a-z-]+")
    hits = {(a, s): F.arrays_overlap(words, F.array(*map(F.lit, cues.split()))) for a, both in lexicon.items() for s, cues in zip(SIDES, both, strict=True)}
    any_hit = F.lit(False)
    for h in hits.values():
        any_hit = any_hit | h
    labels = {}
    for a in lexicon:
        good, bad = hits[a, "positive"], hits[a, "negative"]
        known = any_hit & ~(good & bad)
        labels[f"{a}_positive"], labels[f"{a}_negative"] = F.when(known, good.cast("int")), F.when(known, bad.cast("int"))
    cues = "|".join(sorted({w for both in lexicon.values() for c in both for w in c.split()}, key=len, reverse=True))
    hidden = F.when(F.pmod(F.xxhash64(text_col), F.lit(100)) < hide_percent, F.regexp_replace(text_col, rf"(?i)\b({cues})\b", " ")).otherwise(F.col(text_col))
    return chunks.withColumns(labels).withColumn(text_col, hidden)


@dataclass
class AspectModel:
    """Shared feature stages, and a regression or the constant share of 1 for
    each label; held_out has rows, positives and the area under the curve of each
    label on rows that the fit did not see."""

    stages: PipelineModel
    scorers: dict[str, PipelineModel | float]
    held_out: dict[str, tuple[int, int, float | None]]


def fit_aspects(labelled: DataFrame, text_col: str = "text", key: str | None = None, aspects: tuple[str, ...] = sentiment.ASPECTS, most_rows: int = MOST_ROWS, penalty: float = 0.01) -> AspectModel:
    """Fit on at most most_rows rows, chosen by a hash of the text. A fifth of
    the keys (texts without one) is held out for the figures. A label of one
    value only is that value."""
    names = [f"{a}_{s}" for a in aspects for s in SIDES]
    ident = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.col(text_col))
    rows = labelled.where(F.col(text_col).isNotNull() & (F.greatest(*names).isNotNull())).select(text_col, *names, ident.alias("__id"))
    rows = rows.orderBy("__id", F.xxhash64(text_col)).limit(most_rows)
    stages = Pipeline(stages=features(text_col)).fit(rows)
    # the rows are few: a fit is many short jobs, each better with few tasks
    made = cut_lineage(stages.transform(rows.repartition(2, "__id")).select("__x", "__id", *names)).persist()
    apart = F.pmod(F.col("__id"), F.lit(5)) == 0
    scorers: dict[str, PipelineModel | float] = {}
    held: dict[str, tuple[int, int, float | None]] = {}
    for name in names:
        own = made.where(F.col(name).isNotNull()).withColumn("label", F.col(name).cast("double"))
        fit = lambda d, n=name: Pipeline(stages=[LogisticRegression(featuresCol="__x", labelCol="label", predictionCol=f"__{n}_y", probabilityCol=f"__{n}_p", rawPredictionCol=f"__{n}_r", regParam=penalty, maxIter=15)]).fit(d)
        seen = own.groupBy(apart.alias("a")).agg(F.count("*").alias("n"), F.sum("label").alias("s")).collect()
        parts = {r["a"]: (r["n"], r["s"]) for r in seen}
        total, ones = sum(n for n, _ in parts.values()), sum(s for _, s in parts.values())
        if not total or ones in (0, total):
            scorers[name], held[name] = (ones / total if total else 0.0), (0, 0, None)
            continue
        both = [0 < s < n for n, s in (parts.get(True, (0, 0)), parts.get(False, (0, 0)))]
        model = fit(own.where(~apart) if all(both) else own)
        area = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol=f"__{name}_r").evaluate(model.transform(own.where(apart))) if all(both) else None
        held[name], scorers[name] = (*map(int, parts.get(True, (0, 0))), area), model
    made.unpersist()
    return AspectModel(stages, scorers, held)


def score_chunks(chunks: DataFrame, model: AspectModel, aspects: tuple[str, ...] = sentiment.ASPECTS, least: float = 0.40) -> DataFrame:
    """chunks with mentioned, confidence and sentiment of each aspect: mentioned
    if the likelier side reaches `least`, else confidence 0 and no sentiment. A
    null text mentions nothing; repeated rows are scored alike."""
    text = model.stages.stages[0].getInputCol()
    out = model.stages.transform(chunks.withColumn("__given", F.col(text)).withColumn(text, F.coalesce(text, F.lit(""))))
    for name, scorer in model.scorers.items():
        out = out.withColumn(f"__{name}", F.lit(float(scorer))) if isinstance(scorer, float) else scorer.transform(out).withColumn(f"__{name}", vector_to_array(f"__{name}_p")[1])
    columns: list[Column] = []
    for a in aspects:
        good, bad = (F.when(F.col("__given").isNotNull(), F.col(f"__{a}_{s}")).otherwise(0.0) for s in SIDES)
        top = F.greatest(good, bad)
        columns += [(top >= least).alias(f"{a}_mentioned"), F.when(top >= least, top).otherwise(0.0).alias(f"{a}_confidence"), numbers.aspect_score(good, bad).alias(f"{a}_sentiment")]
    return out.select(*[F.col("__given").alias(c) if c == text else c for c in chunks.columns], *columns)


def score_comments(comments: DataFrame, model: AspectModel, key: str, text_col: str = "text", aspects: tuple[str, ...] = sentiment.ASPECTS) -> DataFrame:
    """(key, mentioned, confidence and sentiment of each aspect): comments are
    cut into chunks, scored, and put together by comment_aspects()."""
    cut = comments.select(key, F.explode_outer(sentiment.chunks(F.col(text_col))).alias(text_col))
    return sentiment.comment_aspects(score_chunks(cut, model, aspects), key, *aspects)
