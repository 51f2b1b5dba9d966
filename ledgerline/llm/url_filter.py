"""URL filters: rules by host and path prefix, else a verdict by the words of the
address.

1. Host, path and the rule that decides are column functions.
2. Each distinct run of letters of host and path is segmented by Viterbi under a
   unigram model: the word counts of all documents. A run meets the counts of
   its own substrings in a hash join, so the whole vocabulary counts and none of
   it is broadcast. Only substrings that can be words are asked for: from each
   letter, those of a length that some word with the same first letters has.
3. Multinomial naive Bayes scores the words of each distinct address. It is
   fitted on a bounded sample of labelled addresses. How far its log-odds must
   speak for blocking is measured on hosts that it has not seen; where no
   log-odds are precise enough there, it blocks nothing."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bound_arrow, materialize, scratch, shared_path, trimmed

#: (verdict, host, path prefix) of the standing rules (fixed values).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Cost of a letter that no word explains; a run of them is one word.
LETTER = math.log(26) + 1.0
#: Width and number of the bins of held-out log-odds on either side of 0.
_BIN, _BINS = 0.1, 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first :// up to /, ?, # or the end, A-Z
    lower-cased; the path from there up to ?, # or the end. Both empty for null
    or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def deciding_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule, the first listed of equal ones,
    or null. A rule fits its host and all subdomains if the path starts with the
    rule's. Rules are literals of the plan: some hundreds at most."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2]))[::-1]:
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of all runs of letters a-z of the lower-cased texts, of any length."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col).cast("string")), "[^a-z]+")).alias("word"))
    return words.where("word != ''").groupBy("word").agg(F.count("*").alias("n"))


def segment(run: str, known: dict[tuple[int, int], float], start: float) -> list[str]:
    """Cheapest words of a run of letters: each step takes a known word, (first,
    end) with its cost, or lengthens a run of unknown letters, which costs
    `start` and LETTER for each. Of equal ways the one with the longest last
    unknown run, then the longest last word, counts."""
    n = len(run)
    ends: dict[int, list[tuple[int, float]]] = {}
    for (a, b), cost in sorted(known.items()):
        ends.setdefault(b, []).append((a, cost))
    best = [(0.0, 0)] + [(math.inf, 0)] * n
    loose = [(math.inf, 0)] * (n + 1)
    for j in range(1, n + 1):
        fresh, longer = best[j - 1][0] + start + LETTER, loose[j - 1][0] + LETTER
        loose[j] = (longer, loose[j - 1][1]) if longer <= fresh else (fresh, j - 1)
        best[j] = loose[j]
        for a, cost in ends.get(j, ()):
            if best[a][0] + cost < best[j][0]:
                best[j] = (best[a][0] + cost, a)
    words = []
    while n:
        words.append(run[best[n][1] : n])
        n = best[n][1]
    return words[::-1]


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) of distinct runs of letters under the word counts."""
    bound_arrow(runs.sparkSession)
    total = counts.agg(F.sum("n")).first()[0] or 0
    # Lengths of words by their first letters: 26 + 26^2 + 26^3 rows at most.
    lengths = counts.groupBy(F.substring("word", 1, 3).alias("first")).agg(F.collect_set(F.length("word")).alias("sizes"))
    bits = F.col("run").cast("binary")  # a-z only: substrings of bytes need no search for their start
    starts = runs.select(F.md5("run").alias("key"), bits.alias("bits"), F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    left = F.length("bits") - F.col("at") + 1
    heads = starts.select("*", left.alias("left"), F.explode(F.sequence(F.lit(1), F.least(F.lit(3), left))).alias("n_first"))
    heads = heads.withColumn("first", F.substring("bits", F.col("at"), F.col("n_first")).cast("string"))
    spans = heads.join(F.broadcast(lengths), "first").select("key", "bits", "at", "left", F.explode("sizes").alias("size")).where("size <= left")
    spans = spans.select("key", "at", "size", F.substring("bits", F.col("at"), F.col("size")).cast("string").alias("word"))
    found = spans.join(counts, "word").groupBy("key").agg(F.collect_list(F.struct("at", "size", "n")).alias("found"))
    start = math.log(total + 1)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words = [segment(t, {(x["at"] - 1, x["at"] - 1 + x["size"]): math.log(total / x["n"]) for x in own or ()}, start) for t, own in zip(texts, lists, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["run", "words"])

    whole = runs.withColumn("key", F.md5("run")).join(found, "key", "left").select("run", "found")
    return whole.mapInArrow(trimmed(cut), "run string, words array<string>")


@dataclass
class AddressModel:
    """Log-odds of blocking per word (word, odds), the prior log-odds, what an
    address's log-odds must exceed to be blocked (None: nothing is blocked), and
    the figures of the held-out hosts."""

    odds: DataFrame
    prior: float
    threshold: float | None
    report: dict


def word_odds(counted: DataFrame, by: list[str], smoothing: float) -> DataFrame:
    """Multinomial naive Bayes: counted (by, word, bad, good) with the log-odds
    that each word speaks for blocking, smoothed over the words of each `by`.
    The sums are one row for each `by`; words that never occur say nothing."""
    sums = counted.groupBy(*by).agg(F.sum("bad").alias("bads"), F.sum("good").alias("goods"), F.count("*").alias("kinds"))
    joined = counted.join(F.broadcast(sums), by) if by else counted.crossJoin(F.broadcast(sums))
    share = lambda n, total: (F.col(n) + smoothing) / (F.col(total) + smoothing * F.col("kinds"))
    return joined.select(*by, "word", (F.log(share("bad", "bads")) - F.log(share("good", "goods"))).alias("odds"))


def choose_threshold(bins: dict[int, tuple[int, int]], least_precision: float, least_support: int) -> float | None:
    """Least log-odds, not below 0, above which held-out addresses are bad in at
    least so large a share of at least so many; None without such. bins: number
    of the bin -> (bad, good)."""
    for t in range(max(bins, default=-1) + 1):
        bad = sum(b for i, (b, _) in bins.items() if i >= t)
        good = sum(g for i, (_, g) in bins.items() if i >= t)
        if bad + good >= least_support and bad >= least_precision * (bad + good):
            return t * _BIN
    return None


def held_out_report(bins: dict[int, tuple[int, int]], threshold: float | None) -> dict:
    """Addresses, blocked ones, precision, recall and the area under the curve
    (of equal bins half) of held-out scores."""
    bad, good = sum(b for b, _ in bins.values()), sum(g for _, g in bins.values())
    above = [(b, g) for i, (b, g) in bins.items() if threshold is not None and i * _BIN >= threshold - 1e-9]
    hit, miss = sum(b for b, _ in above), sum(g for _, g in above)
    area, below = 0.0, 0
    for i in sorted(bins):
        b, g = bins[i]
        area += b * (below + g / 2)
        below += g
    return {"held_out": bad + good, "bad": bad, "blocked": hit + miss, "precision": hit / (hit + miss) if hit + miss else None, "recall": hit / bad if bad else None, "area": area / (bad * good) if bad * good else None, "threshold": threshold}


def fit_addresses(words: DataFrame, labelled: DataFrame, prior: float = 0.0, smoothing: float = 0.5, folds: int = 5, least_precision: float = 0.9, least_support: int = 20) -> AddressModel:
    """The model of labelled addresses (key, fold, bad), from the words (key,
    word) of addresses. Hosts lie whole in one fold. Every address is scored by
    the counts of the other folds, which are all counts less those of its own.

    The prior is a parameter, neutral by default, as labelled addresses are not a
    fair sample of the others. With labels of one kind only nothing is blocked."""
    seen = words.join(labelled, "key")
    counts = materialize(seen.groupBy("fold", "word").agg(F.sum("bad").cast("long").alias("bad"), F.sum(1 - F.col("bad")).cast("long").alias("good")), "fold-counts")
    total = counts.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = word_odds(total, [], smoothing)
    every = F.array(*[F.lit(i) for i in range(folds)])
    rest = total.withColumn("fold", F.explode(every)).join(counts.select("fold", "word", F.col("bad").alias("b"), F.col("good").alias("g")), ["fold", "word"], "left")
    rest = rest.select("fold", "word", (F.col("bad") - F.coalesce("b", F.lit(0))).alias("bad"), (F.col("good") - F.coalesce("g", F.lit(0))).alias("good")).where("bad + good > 0")
    scored = seen.join(word_odds(rest, ["fold"], smoothing), ["fold", "word"]).groupBy("key").agg(F.first("bad").alias("bad"), (F.sum("odds") + prior).alias("odds"))
    at = F.greatest(F.lit(-_BINS), F.least(F.lit(_BINS), F.floor(F.col("odds") / _BIN)))
    bins = {r["at"]: (r["bad"], r["good"]) for r in scored.groupBy(at.alias("at")).agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect()}
    kinds = labelled.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.count("*")).first()
    both = 0 < kinds[0] < kinds[1]
    threshold = choose_threshold(bins, least_precision, least_support) if both else None
    return AddressModel(odds, prior, threshold, held_out_report(bins, threshold) | {"labelled": kinds[1]})


def filter_urls(
    pages: DataFrame, docs: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "text",
    max_rows: int = 20_000, named: bool = False, prior: float = 0.0, least_precision: float = 0.9, least_support: int = 20, report: dict | None = None,
) -> DataFrame:
    """(id_col, host, path, rule, verdict, log_odds) of every row.

    rule is the rule that decides (host and path run together), else null;
    verdict is the rule's, else block if the log-odds of the address's words
    exceed the threshold that held-out hosts gave, else allow: an address none
    of whose words the model knows is allowed. The model is fitted on at most
    max_rows distinct labelled addresses, chosen by a hash: rows (host, path,
    verdict) if given, else those of pages that a rule decides; of these words
    that a rule names count only if `named`. report, if given, gets the figures
    of the held-out hosts.

    A null address and one without :// have empty parts and no words. Repeated
    rows and null ids are judged like any other; addresses and words of any
    length count whole; extra columns are ignored. Without labels of both kinds
    only rules block. Empty pages give no rows; without documents every run of
    letters is one word."""
    spark = pages.sparkSession
    rules = list(rules)
    url = F.col(url_col).cast("string")
    host, path = url_parts(url)
    judged = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    key = F.struct(F.xxhash64("host", "path").alias("a"), F.xxhash64("path", "host").alias("b"))
    odds_at = shared_path(spark, "odds")
    with scratch():
        addresses = materialize(judged.select("host", "path").distinct().select(key.alias("key"), "host", "path", deciding_rule(F.col("host"), F.col("path"), rules)["verdict"].alias("verdict")), "addresses")
        spread = addresses.select("key", F.explode(F.concat(_runs(F.col("host")), _runs(F.col("path")))).alias("run"))
        runs = materialize(spread.select("run").distinct(), "runs")
        counts = materialize(word_counts(docs, text_col), "words")
        cuts = materialize(segmented(runs, counts), "segments")
        words = materialize(spread.join(cuts, "run").select("key", F.explode("words").alias("word")), "address-words")
        own = addresses.where("verdict is not null") if labelled is None else labelled
        fold = F.pmod(F.xxhash64(F.col("host")), F.lit(5)).cast("int")
        sample = own.select(key.alias("key"), fold.alias("fold"), (F.col("verdict") == "block").cast("int").alias("bad")).groupBy("key", "fold").agg(F.max("bad").alias("bad"))
        sample = materialize(sample.orderBy(F.xxhash64("key"), "key").limit(max_rows), "sample")
        used = words
        if labelled is None and not named:
            said = sorted({w for _, h, p in rules for w in f"{h}{p}".replace("/", " ").replace(".", " ").replace("-", " ").split()})
            used = words.where(~F.col("word").isin(said)) if said else words
        model = fit_addresses(used, sample, prior, least_precision=least_precision, least_support=least_support)
        if report is not None:
            report.update(model.report)
        odds = materialize(model.odds, "word-odds")
        scored = materialize(words.join(odds, "word").groupBy("key").agg(F.sum("odds").alias("odds")), "odds", odds_at)
    rule = deciding_rule(F.col("host"), F.col("path"), rules)
    out = judged.withColumn("key", key).join(scored, "key", "left").withColumn("log_odds", F.lit(model.prior) + F.coalesce("odds", F.lit(0.0))).withColumn("rule", rule)
    speaks = F.lit(False) if model.threshold is None else F.col("odds").isNotNull() & (F.col("log_odds") > model.threshold)
    verdict = F.coalesce(F.col("rule.verdict"), F.when(speaks, "block").otherwise("allow"))
    return out.select(id_col, "host", "path", F.col("rule.rule").alias("rule"), verdict.alias("verdict"), "log_odds")


def addresses_of_labelled(pages: DataFrame, labels: DataFrame, id_col: str = "doc_id", url_col: str = "url") -> DataFrame:
    """(host, path, verdict) of pages whose path ends in the id of a labelled
    document (also /id/ and /id.html): block if the document is toxic or of low
    quality, else allow. Pages without such an id and null labels give no rows."""
    host, path = url_parts(F.col(url_col).cast("string"))
    number = F.regexp_extract("path", r"/(\d{1,18})(?:\.html?)?/?$", 1)
    numbered = pages.select(host.alias("host"), path.alias("path")).withColumn("number", F.nullif(number, F.lit("")).cast("long")).where("number is not null")
    known = labels.where("toxic is not null or quality is not null").groupBy(F.col(id_col).alias("number")).agg(F.max(F.greatest(F.coalesce("toxic", F.lit(0)), 1 - F.coalesce("quality", F.lit(1)))).alias("bad"))
    return numbered.join(known, "number").select("host", "path", F.when(F.col("bad") == 1, "block").otherwise("allow").alias("verdict"))
