"""Comments: entities, cleaning, chunks, scores, weights and the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import numbers, text

#: Makes by precedence, and their display names (fixed values).
MAKES = (
    "Toyota", "Lexus", "Honda", "Acura", "Ford", "Lincoln", "Chevrolet", "Chevy", "Cadillac", "GMC", "Buick",
    "Jeep", "Dodge", "Ram", "Chrysler", "Subaru", "Nissan", "Infiniti", "Mazda", "Mitsubishi", "Hyundai",
    "Kia", "Genesis", "Volkswagen", "VW", "Audi", "Porsche", "BMW", "Mercedes-Benz", "Mercedes", "Volvo",
    "Land Rover", "Jaguar", "Tesla", "Rivian", "Lucid", "Polestar", "Fiat", "Alfa Romeo", "Ferrari", "Lamborghini",
)
MAKE_NAMES = {"chevy": "Chevrolet", "vw": "Volkswagen", "mercedes": "Mercedes-Benz", "mercedes-benz": "Mercedes-Benz"}
#: Words that end a model's name (fixed values).
STOP_WORDS = (
    "review", "reviews", "vs", "versus", "comparison", "walkaround", "interior", "exterior",
    "drive", "first", "test", "is", "the", "with", "and", "at", "for", "on", "by", "new",
    "cheap", "expensive", "best", "worst", "good", "bad", "reliability", "problems", "issues",
    "buying", "guide", "channel", "care", "nut", "pov", "pros", "cons", "features", "options",
    "specs", "spec", "price", "worth", "cost", "value", "verdict", "thoughts", "opinion",
    "opinions", "real", "truth", "honest", "why", "how", "what", "to", "buy", "avoid", "hate",
    "love", "broken", "fail", "failed", "garbage", "trash", "perfect", "amazing", "ultimate",
    "owner", "owners", "ownership", "mile", "miles", "k", "years", "year", "month", "months",
)
#: Patterns of comments that are no opinion (fixed values).
SPAM = (
    r"\bsubscribe\b", r"\bmy channel\b", r"\bcheck out my\b", r"\bclick the link\b",
    r"\bclick here\b", r"\btelegram\b", r"\bwhatsapp\b", r"\bcontact me\b",
    r"\bpromo\b", r"\bdiscount\b", r"\bgiveaway\b",
)
OTHER_JUNK = (r"([^\n])\1{5,}", r"\+\d{1,3}[-.\s]?\d{3,4}[-.\s]?\d{4}", r"\b0x[a-fA-F0-9]{40}\b", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b")
#: Comments that are no opinion as a whole (fixed values).
FILLERS = ("first", "first!", "first!!", "first comment", "subscribe", "sub")
ASPECTS = ("reliability", "value", "performance", "comfort")
#: Words of the stand-in scorer, as no language model is at hand.
LEXICON = {
    "reliability": ("reliable reliability dependable durable solid trouble-free", "unreliable broken problem problems issue issues recall fail failed"),
    "value": ("value cheap affordable worth bargain deal", "expensive overpriced pricey costly"),
    "performance": ("fast quick power powerful handling fun", "slow sluggish underpowered weak"),
    "comfort": ("comfortable comfort quiet smooth spacious", "uncomfortable harsh noisy cramped stiff"),
}


def vehicle_entity(title: Column) -> Column:
    """`year Make Model words` of a video title: the first year, the first make
    in list order, then up to three words of the model. The walk over the words
    is one fold: it ends before a word that begins with a separator, a stop word
    or a lower-case word without digit or hyphen, after a taken word that ends
    with a mark, and passes over years and words of marks only."""
    year = F.nullif(F.regexp_extract(title, r"\b(19[89]\d|20[0-2]\d)\b", 1), F.lit(""))
    found = F.coalesce(*[F.when(title.rlike(rf"(?i)\b{m}\b"), F.struct(F.lit(m).alias("make"), F.regexp_extract(title, rf"(?is)\b{m}\b(.*)$", 1).alias("rest"))) for m in MAKES])
    state = F.struct(F.array().cast("array<string>").alias("words"), F.lit(False).alias("done"))

    def step(acc: Column, raw: Column) -> Column:
        return text.once(F.regexp_replace(raw, r"""^[.,;:!?|()\-–—"'\[\]{}]+|[.,;:!?|()\-–—"'\[\]{}]+$""", ""), lambda word: after(acc, raw, word))

    def after(acc: Column, raw: Column, word: Column) -> Column:
        skip = (word == "") | word.rlike(r"^(\d{4})$")
        starts, ends = raw.rlike(r"^[-|:/\\–—]"), raw.rlike(r"[-:|.?!–—]$")
        plain = (word == F.lower(word)) & (word != F.upper(word)) & ~word.rlike("[0-9-]")
        stop = starts | (~skip & (F.lower(word).isin(*STOP_WORDS) | plain))
        take = ~acc["done"] & ~stop & ~skip
        return F.struct(F.when(take, F.array_append(acc["words"], word)).otherwise(acc["words"]).alias("words"), (acc["done"] | stop | (take & ends)).alias("done"))

    def named(f: Column) -> Column:
        words = F.slice(F.aggregate(F.split(F.trim(f["rest"]), r"\s+"), state, step)["words"], 1, 3)
        low = F.lower(f["make"])
        shown = F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 100))
        for known, name in MAKE_NAMES.items():
            shown = F.when(low == known, name).otherwise(shown)
        return text.once(words, lambda w: F.when(F.size(w) > 0, F.concat_ws(" ", year, shown, F.array_join(w, " "))))

    # bound once: the makes would be sought again, and the words walked again, for each of their uses
    return F.when(year.isNotNull(), text.once(found, named))


def clean_comment(c: Column) -> Column:
    """The comment without addresses and tags, marks squeezed; null for filler,
    advertising, repeated characters, contacts and fewer than three words."""
    t = F.trim(F.regexp_replace(F.regexp_replace(c, r"https?://\S+|www\.\S+", ""), "<[^\n]*?>", ""))
    junk = F.lower(t).isin(*FILLERS)
    for p in SPAM:
        junk = junk | t.rlike(f"(?i){p}")
    for p in OTHER_JUNK:
        junk = junk | t.rlike(p)
    out = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"!{2,}", "!"), r"\?{2,}", "?"), r"\.{4,}", "..."))
    return F.when(~junk & (text.word_count(out) >= 3), out)


def chunks(c: Column, most: int = 45) -> Column:
    """Sentences packed greedily into chunks of at most `most` words; a longer
    sentence is cut after every `most` words, and its pieces stay apart from
    their neighbours. A blank text is one empty chunk, a null or empty one has
    none. One fold over the pieces' numbers of words finds where chunks start;
    each chunk is then one slice of the pieces, so the work is linear."""
    sentences = F.filter(F.split(c, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")

    def cut(s: Column) -> Column:
        def pieces(words: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.ceil(F.size(words) / most).cast("int") - 1), lambda i: F.struct(F.array_join(F.slice(words, i * most + 1, F.lit(most)), " ").alias("text"), F.least(F.size(words) - i * most, F.lit(most)).alias("n"), (F.size(words) > most).alias("whole")))

        # bound once: a long sentence would be split again for each of its pieces
        return text.once(F.split(F.regexp_replace(s, r"^\s+|\s+$", ""), r"\s+"), pieces)

    def step(acc: Column, p: Column) -> Column:
        starts = p["whole"] | (acc["open"] == 0) | (acc["open"] + p["n"] > most)
        held = F.when(p["whole"], 0).when(starts, p["n"]).otherwise(acc["open"] + p["n"])
        return F.struct(held.alias("open"), (acc["at"] + 1).alias("at"), F.when(starts, F.array_append(acc["starts"], acc["at"])).otherwise(acc["starts"]).alias("starts"))

    def packed(pieces: Column) -> Column:
        state = F.struct(F.lit(0).alias("open"), F.lit(1).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(pieces, state, step, lambda acc: F.array_append(acc["starts"], acc["at"]))
        spans = F.transform(F.array(F.struct(starts.alias("s"), F.transform(pieces, lambda p: p["text"]).alias("t"))), lambda x: F.transform(F.sequence(F.lit(1), F.size(x["s"]) - 1), lambda i: F.array_join(F.slice(x["t"], F.element_at(x["s"], i), F.element_at(x["s"], i + 1) - F.element_at(x["s"], i)), " ")))
        return spans[0]

    # bound once: the pieces would be cut again for each of their uses
    found = F.transform(F.array(F.flatten(F.transform(sentences, cut))), lambda p: F.when(F.size(p) > 0, packed(p)))[0]
    blank = F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(F.lit("")))
    return F.when(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "") == "", blank).otherwise(found)


def lexicon_scores(c: Column) -> dict[str, Column]:
    """Stand-in for the aspect model: per aspect the share of its good and bad
    words among those found, as (positive, negative). Any columns of that shape
    can replace it."""
    words = F.split(F.lower(c), r"[^a-z-]+")
    hits = lambda listed: F.size(F.filter(words, lambda w: w.isin(*listed.split())))
    out = {}
    for aspect, (good, bad) in LEXICON.items():
        g, b = hits(good), hits(bad)
        total = F.greatest(g + b, F.lit(1))
        out[f"{aspect}_positive"], out[f"{aspect}_negative"] = g / total, b / total
    return out


def comment_aspects(chunked: DataFrame, key: str, *aspects: str) -> DataFrame:
    """Chunk scores to comment scores: mentioned if any chunk is, the highest
    confidence, the sentiment weighted by confidence. All aspects are one pass."""
    return chunked.groupBy(key).agg(*[c for a in aspects for c in _aspect_sums(a)])


def _aspect_sums(aspect: str) -> list[Column]:
    s, conf = F.col(f"{aspect}_sentiment"), F.col(f"{aspect}_confidence")
    weight = F.when(s.isNotNull(), conf)
    return [F.max(F.col(f"{aspect}_mentioned")).alias(f"{aspect}_mentioned"), F.max(conf).alias(f"{aspect}_confidence"), F.try_divide(F.sum(s * weight), F.nullif(F.sum(weight), F.lit(0.0))).alias(f"{aspect}_sentiment")]


def apply_weights(df: DataFrame, likes: str = "like_count", words_of: str = "text") -> DataFrame:
    return df.withColumn("weight", numbers.comment_weight(F.col(likes), text.word_count(F.col(words_of))))


def sentiment_index(scored: DataFrame, entity: str = "entity", weight: str = "weight", day: str = "published_at", aspects: tuple[str, ...] = ASPECTS) -> DataFrame:
    """Per entity: sample size, reliability and enthusiast index (0 to 100),
    volatility and trend of the scores (five at least), confidence. The trend is
    the sample covariance over the population variance, as the index is defined."""
    total, mass = F.lit(0.0), F.lit(0.0)
    for a in aspects:
        s = F.col(f"{a}_sentiment")
        total = total + F.coalesce(F.sum(s * F.col(weight)), F.lit(0.0))
        mass = mass + F.coalesce(F.sum(F.when(s.isNotNull(), F.col(weight))), F.lit(0.0))
    rel = F.col("reliability_sentiment")
    rel_mass = F.sum(F.when(rel.isNotNull(), F.col(weight)))
    base = scored.groupBy(entity).agg(
        F.count("*").alias("sample_size"),
        ((F.sum(rel * F.col(weight)) / (rel_mass + 1e-9) + 1) * 50).alias("reliability_score"),
        ((F.try_divide(total, F.nullif(mass, F.lit(0.0))) + 1) * 50).alias("enthusiast_index"),
    )
    points = scored.select(entity, F.unix_date(F.col(day).cast("date")).cast("double").alias("__x"), F.explode(F.array(*[F.col(f"{a}_sentiment").cast("double") for a in aspects])).alias("__y")).where("__x is not null and __y is not null")
    moments = points.groupBy(entity).agg(F.count("*").alias("__n"), F.stddev_pop("__y").alias("__sd"), F.covar_samp("__x", "__y").alias("__c"), F.var_pop("__x").alias("__v"))
    j = base.join(moments, entity, "left")
    many = F.coalesce(F.col("__n") >= 5, F.lit(False))
    slope = F.when(F.col("__v") == 0, 0.0).otherwise(F.try_divide("__c", "__v"))
    return j.withColumns({"volatility": F.when(many, F.col("__sd")), "trend": F.when(many, slope), "confidence": F.when(F.col("sample_size") >= 30, "High").otherwise("Low")}).drop("__n", "__sd", "__c", "__v")


def cohort_comments(scored: DataFrame, entity: str, exact: str, fallback: str, weight: str = "weight", day: str = "published_at", tie: str = "comment_id", n: int = 5) -> DataFrame:
    """The n heaviest comments of the exact entity (any case), or of all whose
    entity starts with the fallback if the exact one has none; with match_type."""
    name = F.lower(F.col(entity))
    hits = scored.where((name == exact.lower()) | name.startswith(fallback.lower())).withColumn("__exact", name == exact.lower())
    any_exact = hits.agg(F.coalesce(F.max("__exact"), F.lit(False)).alias("__any"))
    kept = hits.crossJoin(F.broadcast(any_exact)).where("__exact = __any OR NOT __any")
    return kept.withColumn("match_type", F.when(F.col("__any"), "exact").otherwise("make/model/year fallback")).drop("__exact", "__any").orderBy(F.desc(weight), F.desc(day), tie).limit(n)
