"""Mixing sources to target weights.

Every row gets a hash-random key; the keys' leading digits cut each source into
ranges of bounded size, so that "sort each source by key and add up" becomes a
sort of many small ranges plus running sums of range totals. Each source is then
cut at its exact budget, after as many whole epochs as the budget holds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, prefix_sums

#: Pattern of a word, as the size of a document counts them.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows that a range of keys holds on average at most.
RANGE_ROWS = 20_000


def source_targets(totals: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Word budgets of the sources: rows (src, source_size) give (src,
    source_size, weight, target).

    The weights repeat over the sources in order of src. All words are shared
    by weight; no target exceeds max_epochs times its source's size and what is
    cut off is shared again, which is the water level of the sorted ratios cap
    / weight. Works on one row per source; the sums run in one sorted pass."""
    everything = Window.partitionBy()
    by_name = Window.orderBy("src")
    by_ratio = Window.orderBy("ratio", "src")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = totals.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", (F.col("source_size") * max_epochs).cast("long")).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = (
        t.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(everything)["level"])
    )
    return t.select("src", "source_size", "weight", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document a mix with the target weights takes: one
    row per input row with id_col, the carried columns, size, source_size,
    target (double, its source's), prior (words of the source before it in the
    random order) and taken.

    Sizes count the runs of anything but ASCII white space (null text: 0).
    Sources weigh by their code-point order, null last, the weights repeating.
    taken = epochs * size + what the cut in the last epoch leaves of it, so the
    taken words of a source add up to floor(target) exactly and no row exceeds
    max_epochs * size. The order is a function of seed and id (of the text where
    the id is null), then size, so reruns agree; rows that tie in all of these
    are alike. An empty table gives no rows; a column of docs that is not
    carried plays no part, whatever its name."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.md5(F.col(text_col).cast("string")), F.lit(""))))))
    base = materialize(
        docs.select(
            F.col(id_col),
            *[F.col(c) for c in carry if c != id_col],
            F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t")).alias("__src"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("__size"),
            key.alias("__key"),
        ),
        "sized",
    )
    digits = max(0, math.ceil(math.log(max(1, base.count()) / RANGE_ROWS, 16)))
    base = base.withColumn("__range", F.substring("__key", 1, digits))
    totals = base.groupBy(F.col("__src").alias("src")).agg(F.sum("__size").alias("source_size"))
    targets = materialize(source_targets(totals, weights, max_epochs), "targets")
    placed = prefix_sums(base, ["__src"], "__range", ["__key", "__size"], {"prior": "__size"})
    budget = F.floor("target")
    rest = F.when(F.col("source_size") > 0, budget % F.col("source_size")).otherwise(0)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    return placed.join(targets, F.col("__src") == F.col("src")).select(
        id_col,
        *[c for c in carry if c != id_col],
        F.col("__size").alias("size"),
        "source_size",
        "target",
        "prior",
        (epochs * F.col("__size") + F.greatest(F.lit(0), F.least(F.col("__size"), rest - F.col("prior")))).cast("long").alias("taken"),
    )


def repeat_documents(mixed: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """Rows of mix() that carry the text, repeated as the mix takes them: a
    document comes once per whole epoch and, where the cut falls into it, once
    more with the words that are left; documents with nothing taken go. size 0
    documents hold no words and go too."""
    full = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    grown = mixed.withColumn("__part", part).withColumn("__times", full + (part > 0).cast("int")).where("__times > 0")
    grown = grown.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    cut = (F.col("__copy") == F.col("__times")) & (F.col("__part") > 0)
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD_PATTERN}[\\x20\\x09-\\x0D]*)"), F.lit(1))
    out = grown.withColumn(text_col, F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("__part").cast("int")), "")).otherwise(F.col(text_col)))
    if length_col and length_col in out.columns:
        out = out.withColumn(length_col, F.when(cut, F.length(text_col).cast("long")).otherwise(F.col(length_col)))
    return out.drop("__part", "__times", "__copy")
