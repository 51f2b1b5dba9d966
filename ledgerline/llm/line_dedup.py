"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

1. Lines are aggregated by their hash (a very common line is one row per task)
   and written once, bucketed by the hash, so that no later step moves texts
   which it does not compare.
2. A line's shingles are the runs of `width` characters from every character of
   the lower-cased line. Their hashes are made 32 at a time as columns of one
   row, minima of them under XOR permutations give the bands.
3. Lines that share a band are compared exactly, by the Jaccard similarity of
   their full shingle sets: first each with its bucket's smallest line, then in
   what is left apart each with the largest, then, in buckets that still hold
   lines of different components, all lines of different components, in blocks
   of bounded size: by sketches first, which rule out most pairs and never a
   near one. In large buckets a line is first linked to the nearest one of a few
   blocks, so that few pairs of a dense group are still of two components. A
   comparison returns the components it joins, never pairs.
4. Union-find over the links; each component keeps the line that comes first."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import connected_components, materialize, scratch, shared_path, shuffles_dropped

#: Lines of a block in the exact comparison, on average.
BLOCK = 64
#: Shingles whose hashes are columns of one row, and shingles of a segment that is cut into such rows.
_ROW, _SEGMENT = 32, 256
#: Words of 64 bits in the sketch of a set, a power of two.
_WORDS = 16
#: Bands that are shuffled together.
_BANDS = 4
#: White space that does not count at a line's ends.
_BLANK = " \t\r\x0b\x0c"


def _permutation(i: int, of: int) -> int:
    """The i-th of `of` XOR constants, as a signed integer: a multiplicative
    sequence under leading bits that are all different, since minima under
    constants that begin alike are often those of one shingle."""
    x = (i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    bits = max(1, (of - 1).bit_length())
    x = (x ^ x >> 31) >> bits | int(f"{i:0{bits}b}"[::-1], 2) << 64 - bits
    return x - (1 << 64) if x >> 63 else x


def band_rows(minima: int, rows: int, bands: int) -> list[list[int]]:
    """The minima of each band: first disjoint runs, then strides across them,
    which share one minimum with a run at most."""
    runs = minima // rows
    if bands > 2 * runs or rows > runs and bands > runs:
        raise ValueError(f"{minima} minima make no {bands} bands of {rows}")
    return [[r * rows + i for i in range(rows)] for r in range(runs)][:bands] + [[(i * rows + (i + s) % rows + s // rows * rows) % minima for i in range(rows)] for s in range(max(0, bands - runs))]


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _held(value: Column) -> Column:
    """value as a column of its own: Spark does not move a generated one into each
    of its uses, where it would be computed again."""
    return F.explode(F.array(value))


def _points(line: Column) -> Column:
    """The lower-cased line as four bytes a character."""
    return F.encode(F.lower(line), "UTF-32")


def _shingles(points: Column, width: int) -> Column:
    """How many shingles a line has: a shorter line is one."""
    return F.greatest(F.lit(1), (F.length(points) / 4).cast("int") - (width - 1))


def shingle_hashes(line: Column, width: int = 5) -> Column:
    """Distinct hashes of the line's shingles: `width` characters from every one."""
    return F.array_distinct(_once(_points(line), lambda p: F.transform(F.sequence(F.lit(1), 4 * _shingles(p, width) - 3, F.lit(4)), lambda i: F.xxhash64(F.substring(p, i, F.lit(4 * width))))))


def _signed(lines: DataFrame, key: str, minima: int, width: int) -> DataFrame:
    """(key, m0, m1, ...): minima of the shingles' hashes under each permutation."""
    rows = lines.select(key, _points(F.col("line")).alias("p")).withColumn("n", _shingles(F.col("p"), width))
    for step in (_SEGMENT, _ROW):  # two cuts, so that a very long line is not copied for each row of it
        at = F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / step).cast("int"))).alias("at")
        rows = rows.select(key, "p", "n", at).select(key, F.substring("p", F.col("at") * (4 * step) + 1, F.lit(4 * (step + width - 1))).alias("p")).withColumn("n", _shingles(F.col("p"), width))
    hashed = rows.select(key, "p", "n", F.xxhash64(F.substring("p", 1, 4 * width)).alias("h0"))
    more = [F.when(F.col("n") > j, F.xxhash64(F.substring("p", 4 * j + 1, 4 * width))).otherwise(F.col("h0")).alias(f"h{j}") for j in range(1, _ROW)]
    hashed = hashed.select(key, "h0", *more)
    least = lambda i: F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(_permutation(i, minima))) for j in range(_ROW)])
    return hashed.groupBy(key).agg(*[F.min(least(i)).alias(f"m{i}") for i in range(minima)])


def _document(id_col: str, text_col: str) -> list[Column]:
    """What tells documents apart, in their order: id (null last), then text."""
    ident = F.col(id_col).cast("long")
    return [ident.isNull().alias("none"), F.coalesce(ident, F.lit(0)).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("words")]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, place, line) of every line that holds more than white space."""
    # the outer form: for the inner one Spark filters by the array's size first, and so splits each text twice
    rows = docs.select(*_document(id_col, text_col), F.posexplode_outer(F.split(F.col(text_col).cast("string"), "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(_BLANK))).where("line != ''")
    return rows.select(F.xxhash64("line").alias("k1"), F.xxhash64("line", F.lit(1)).alias("k2"), F.struct("none", "id", "words", "pos").alias("place"), "line")


@contextmanager
def _bucketed(df: DataFrame, key: str, name: str) -> Iterator[DataFrame]:
    """df as a table in the shared folder, bucketed by key; joins and aggregations
    by key then leave it where it is."""
    spark: SparkSession = df.sparkSession
    path = shared_path(spark, name)
    table = "ledgerline_" + path.rsplit("/", 1)[1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_dropped(spark):
        df.write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _near(a: Column, b: Column, threshold: Fraction) -> Column:
    """Whether |a and b| / |a or b| reaches the threshold, in whole numbers."""
    n, d = threshold.numerator, threshold.denominator
    return (d * F.size(a) >= n * F.size(b)) & (d * F.size(b) >= n * F.size(a)) & ((n + d) * F.size(F.array_intersect(a, b)) >= n * (F.size(a) + F.size(b)))


def _near_pairs(pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """(src, dst): roots of the pairs (a, b), structs (root, grams), of two
    components that are near. Pairs are rows, as Spark compiles the comparison of
    rows but interprets one inside a lambda."""
    apart = pairs.where(F.col("a.root") != F.col("b.root")).where(_near(F.col("a.grams"), F.col("b.grams"), threshold))
    return apart.select(F.col("a.root").alias("src"), F.col("b.root").alias("dst"))


def _texts(some: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """The rows of some with their lines: by hash, so that the texts of all lines
    are neither moved nor sorted."""
    return lines.select(key, "line").join(some.hint("shuffle_hash"), key)


def _star(pairs: DataFrame, lines: DataFrame, threshold: Fraction, width: int) -> DataFrame:
    """The pairs (src, hub) that are near: a hub's text goes once to each block of
    about BLOCK lines that are compared with it, and is cut up once there."""
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = pairs.join(blocks, "hub").select("src", "hub", F.pmod(F.xxhash64("src"), F.col("blocks")).alias("block"))
    hubs = blocks.select(F.col("hub").alias("src"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    texts = _texts(dealt.unionByName(hubs), lines.withColumnRenamed("k1", "src"), "src")
    sets = texts.groupBy("hub", "block").agg(F.max(F.when(F.col("src") == F.col("hub"), F.col("line"))).alias("own"), F.collect_list(F.when(F.col("src") != F.col("hub"), F.struct("src", "line"))).alias("members"))
    own = sets.select("hub", "members", _held(shingle_hashes(F.col("own"), width)).alias("g")).select("hub", "g", F.explode("members").alias("m"))
    rows = own.select("hub", "g", "m.src", _held(shingle_hashes(F.col("m.line"), width)).alias("grams"))
    return rows.where(_near(F.col("grams"), F.col("g"), threshold)).select("src", F.col("hub").alias("dst"))


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, root), joined by links between their roots: only the
    roots that are linked go through union-find again."""
    joined = materialize(connected_components(links), "merged")
    old = classes.join(joined.toDF("root", "__root"), "root", "left").select("node", F.coalesce("__root", "root").alias("root"))
    return old.unionByName(joined).distinct()  # a line that had no component yet is its own root


def _apart(keyed: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Of the buckets with at least `least` lines, of more than one component: the
    lines (band, k1, root, top: the bucket's largest component, n: its lines)."""
    rooted = keyed.join(classes.withColumnRenamed("node", "k1"), "k1", "left").withColumn("root", F.coalesce("root", "k1"))
    counted = rooted.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "root"))["root"].alias("top"), F.sum("n").alias("n"), F.count("*").alias("roots"))
    open_ = counted.where((F.col("roots") > 1) & (F.col("n") >= least)).drop("roots")
    return materialize(rooted.join(open_, "band"), "apart")


def _sketched(lines: DataFrame, width: int) -> DataFrame:
    """(k1, size, bits) of lines: how many different hashes its set has, and the set
    as bits: a hash flips one of 64 * _WORDS. Two sketches differ in no more bits
    than the sets in hashes, so many differing bits rule a pair out. Hashes are
    rows here, as Spark compiles what it does with rows."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("g").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    word = F.shiftright("g", 6).bitwiseAND(F.lit(_WORDS - 1).cast("long"))
    grams = lines.select("k1", F.explode(shingle_hashes(F.col("line"), width)).alias("g"))
    words = grams.groupBy("k1").agg(F.count("*").cast("int").alias("size"), *[F.bit_xor(F.when(word == w, one).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(_WORDS)])
    return words.select("k1", "size", F.array(*[f"w{w}" for w in range(_WORDS)]).alias("bits"))


def _sketches(apart: DataFrame, lines: DataFrame, width: int) -> DataFrame:
    """The sketches of the lines in apart, written once."""
    return materialize(_sketched(_texts(apart.select("k1").distinct(), lines, "k1"), width), "sketches")


def _differing(a: Column, b: Column) -> Column:
    """In how many bits the sketches of a and b differ."""
    return sum((F.bit_count(a["bits"][i].bitwiseXOR(b["bits"][i])) for i in range(1, _WORDS)), F.bit_count(a["bits"][0].bitwiseXOR(b["bits"][0])))


def _may_be_near(a: Column, b: Column, threshold: Fraction) -> Column:
    """False only where the sizes and sketches of a and b show that they are not near."""
    n, d = threshold.numerator, threshold.denominator
    sized = (d * a["size"] >= n * b["size"]) & (d * b["size"] >= n * a["size"])
    return sized & ((n + d) * _differing(a, b) <= (d - n) * (a["size"] + b["size"]))


def _candidates(apart: DataFrame, lines: DataFrame, threshold: Fraction, width: int, thin: bool = False, sketches: DataFrame | None = None) -> DataFrame:
    """The different pairs (src, dst) of one bucket and two components that may be
    near: lines are dealt to blocks, and those outside the bucket's largest
    component meet every block, by size and sketch alone. No text is moved, a line
    is cut up once for all its buckets, and a pair of many buckets is made in the
    first of them only. Thin: such a line meets its own block and those 1, 2, 4, ...
    after it, and makes one pair with each at most, of the sketches that differ least."""
    sketches = _sketches(apart, lines, width) if sketches is None else sketches
    own = sketches.join(apart.groupBy("k1").agg(F.array_sort(F.collect_set("band")).alias("bands")), "k1")
    dealt = apart.withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("k1"), F.col("blocks"))).join(own, "k1")
    member = F.struct("k1", "root", "size", "bits", "bands")
    whole = materialize(dealt.groupBy("band", "block", "blocks", "top").agg(F.collect_list(member).alias("members"), F.collect_list(F.when(F.col("root") != F.col("top"), member)).alias("strays")), "blocks")
    right = whole.select("band", F.col("block").alias("other"), F.col("members").alias("others"))
    apart_by = F.transform(F.sequence(F.lit(0), F.floor(F.log2("blocks")).cast("int")), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    meets = F.array_distinct(F.concat(F.array("block"), F.transform(apart_by, lambda x: (F.col("block") + x) % F.col("blocks")))) if thin else F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    left = whole.where(F.size("strays") > 0).select("band", "block", "top", "strays", F.explode(meets).alias("other"))
    once = lambda a, b: (b["root"] == F.col("top")) | (F.col("block") < F.col("other")) | (F.col("block") == F.col("other")) & (a["k1"] < b["k1"])  # noqa: E731  two strays meet once
    first = lambda a, b: F.get(F.array_intersect(a["bands"], b["bands"]), F.lit(0)) == F.col("band")
    may = lambda a: F.filter("others", lambda b: (a["root"] != b["root"]) & (F.lit(True) if thin else once(a, b)) & _may_be_near(a, b, threshold) & first(a, b))
    pair = lambda a, b: F.struct(F.least(a["k1"], b["k1"]).alias("src"), F.greatest(a["k1"], b["k1"]).alias("dst"))
    least = lambda a: F.array_compact(F.array(F.array_min(F.transform(may(a), lambda b: F.struct(_differing(a, b).alias("bits"), pair(a, b).alias("pair"))))["pair"]))
    of = least if thin else lambda a: F.transform(may(a), lambda b: pair(a, b))
    found = left.join(right, ["band", "other"]).select(F.explode(F.flatten(F.transform("strays", of))).alias("pair")).select("pair.*")
    return found.distinct() if thin else found  # two lines may each be the other's nearest


def _blocks(apart: DataFrame, lines: DataFrame, threshold: Fraction, width: int, thin: bool = False, sketches: DataFrame | None = None) -> DataFrame:
    """Links between components of one bucket: the candidates, compared in full."""
    pairs = materialize(_candidates(apart, lines, threshold, width, thin, sketches), "candidates")
    known = _texts(apart.select("k1", "root").distinct(), lines, "k1")
    side = lambda c, name: known.select(F.col("k1").alias(c), F.struct("k1", "root", "line").alias(name))
    texts = pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst")
    grams = lambda m: _held(F.struct(F.col(f"{m}.root").alias("root"), shingle_hashes(F.col(f"{m}.line"), width).alias("grams"))).alias(m)
    return _near_pairs(texts.select(grams("a"), "b").select("a", grams("b")), threshold)


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, minima: int = 60, rows: int = 6, bands: int = 16) -> DataFrame:
    """The lines that occur more than once or have a near copy: (k1, k2: hashes
    of the trimmed line, n: its occurrences, keep: the place whose line its class
    keeps, links: whether the class holds different lines). With the defaults a
    pair at the threshold shares a band with a probability of about 0.98, a
    nearer one with a higher one. Bands are shuffled a few at a time,
    so that shuffle files stay smaller than the texts."""
    limit = Fraction(threshold).limit_denominator(1000)
    lines = _lines(docs, id_col, text_col)
    one = lines.groupBy("k1").agg(F.min(F.struct("k2", "place", "line")).alias("one"), F.count("*").alias("n")).select("k1", "one.k2", "n", "one.place", "one.line")
    at = shared_path(docs.sparkSession, "line-classes")
    with scratch():
        with _bucketed(one, "k1", "lines") as table:
            design = band_rows(minima, rows, bands)
            signed = _signed(table, "k1", minima, width)
            signed = materialize(signed.select("k1", *[F.xxhash64(F.lit(b), *[f"m{i}" for i in own]).alias(f"b{b}") for b, own in enumerate(design)]), "bands")
            keyed = None
            for at_band in range(0, bands, _BANDS):
                some = signed.select("k1", F.explode(F.array(*[f"b{b}" for b in range(at_band, min(bands, at_band + _BANDS))])).alias("band"))
                hubs = some.groupBy("band").agg(F.min("k1").alias("hub"), F.max("k1").alias("far")).where("hub != far")
                found = materialize(some.join(hubs.hint("shuffle_hash"), "band"), "buckets")  # the many rows need no sort
                keyed = found if keyed is None else keyed.unionByName(found)
            pairs = keyed.where("k1 != hub").select(F.col("k1").alias("src"), "hub").distinct()
            links = materialize(_star(pairs, table, limit, width), "links")
            classes = materialize(connected_components(links), "components")
            apart = _apart(keyed.select("k1", "band", "far"), classes, 3)
            if not apart.isEmpty():
                roots = apart.select(F.col("k1").alias("hub"), F.col("root").alias("far_root")).distinct()
                pairs = apart.where("k1 != far").select(F.col("k1").alias("src"), F.col("far").alias("hub"), "root").join(roots, "hub").where("root != far_root").select("src", "hub").distinct()
                own, far = (apart.select(F.col("k1").alias(c), F.col("root").alias(f"{c}_root")).distinct() for c in ("src", "dst"))
                found = _star(pairs, table, limit, width).join(own, "src").join(far, "dst")
                classes = materialize(_merged(classes, found.select(F.col("src_root").alias("src"), F.col("dst_root").alias("dst"))), "components")
                apart = _apart(apart.select("k1", "band", "far"), classes, 4)
            sketches, large = None, apart.where(F.col("n") > BLOCK)
            if not large.isEmpty():  # in a large bucket a few links a line first, else each pair of a dense group would be a row
                sketches = _sketches(apart, table, width)
                classes = materialize(_merged(classes, _blocks(large, table, limit, width, True, sketches)), "components")
                apart = _apart(apart.select("k1", "band"), classes, 4)
            if not apart.isEmpty():
                classes = _merged(classes, _blocks(apart, table, limit, width, False, sketches))
            joined = table.select("k1", "k2", "n", "place").join(classes.withColumnRenamed("node", "k1").hint("shuffle_hash"), "k1", "left").where("n > 1 or root is not null")
            joined = materialize(joined.withColumn("root", F.coalesce("root", "k1")), "classes")
        kept = joined.groupBy("root").agg(F.min("place").alias("keep"), F.count("*").alias("texts"))
        found = joined.join(kept, "root").select("k1", "k2", "n", "keep", (F.col("texts") > 1).alias("links"))
        return materialize(found, "line-classes", at)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(none, id, words, dropped): positions of the lines that go, of the
    documents that lose any, told apart as dedup_lines() does."""
    classes = line_classes(docs, id_col, text_col, **how)
    gone = _lines(docs, id_col, text_col).select("k1", "k2", "place").join(classes.select("k1", "k2", "keep"), ["k1", "k2"]).where("place != keep")
    return gone.groupBy("place.none", "place.id", "place.words").agg(F.array_sort(F.collect_set("place.pos")).alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, **how) -> DataFrame:
    """Every document with the repeated and nearly repeated lines of the whole
    table taken out: all columns of docs, the text without the dropped lines
    (unless with_text is off), n_lines, n_dropped and dropped (positions).

    Of each class of lines the first by (id, text's hash, position) stays, null
    ids last. Lines are compared without white space at their ends; blank lines
    are never dropped; a line of fewer than `width` characters is one shingle.
    Two lines are near if the Jaccard similarity of their shingle sets is at
    least `threshold`; case does not count. A null text has no lines and stays
    null. Documents are told apart by id and text: rows with one id (or none)
    and different texts are different documents, rows alike in both are one and
    lose the same lines. Lines are told apart by 128-bit hashes: of two lines
    with one 64-bit hash the second stays wherever it is. Extra columns pass
    through, but for those with the names of results, which are replaced. An
    empty table gives no rows."""
    key = ["__none", "__id", "__words"]
    gone = dropped_lines(docs, id_col, text_col, **how).toDF(*key, "__dropped")
    text = F.col(text_col).cast("string")
    n_lines = F.greatest(F.coalesce(F.size(F.split(text, "\n")), F.lit(0)), F.lit(0)).cast("long")
    base = docs.select(*(docs.columns if with_text else [id_col]), *[c.alias(k) for c, k in zip(_document(id_col, text_col), key, strict=True)], n_lines.alias("__n_lines"))
    out = base.join(gone, key, "left").withColumn("__dropped", F.coalesce("__dropped", F.array().cast("array<int>")))
    if with_text:
        stay = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col("__dropped"), i))
        out = out.withColumn(text_col, F.when(F.size("__dropped") == 0, F.col(text_col)).otherwise(F.array_join(stay, "\n")))
    made = {"n_lines": F.col("__n_lines"), "n_dropped": F.size("__dropped").cast("long"), "dropped": F.col("__dropped")}
    return out.select(*[c for c in (docs.columns if with_text else [id_col]) if c not in made], *[c.alias(n) for n, c in made.items()])
