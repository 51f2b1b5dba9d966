"""N-gram Jaccard join by MinHash banding.

1. One pass over the texts gives each document a 128-bit fingerprint of its
   word sequence and the hashes of its MinHash bands. Band and row counts are
   chosen for a target recall at the threshold.
2. Documents with one fingerprint are copies: they become one node, so a group
   of copies is collapsed by map-side aggregation before anything else.
3. Nodes are shuffled on band hashes. A bucket contributes a star (each member
   to its smallest), never all its pairs; components of the stars hold every
   pair that shares a band.
4. Pairs are verified on full n-gram sets inside their component or, where that
   compares less (long chains of near neighbours), inside their buckets, of which
   those of the same members count once and a pair only in the first that it
   shares. Groups larger than `block` are split into blocks, and each pair of
   blocks is a task of bounded size which counts the links and returns a spanning
   forest of them.
5. Components of the verified links are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD, bound_arrow, connected_components, materialize, mix64, scratch, shared_path, text_slices, trimmed, word_hashes

#: Shingle hashes whose permutations are computed at once (keeps them in cache).
_CHUNK = 1 << 15
#: Columns of an incidence matrix in the verification.
_COLUMNS = 4096
#: What tells documents apart, in their order: null ids last, then the text's hash.
_KEY = ("none", "id", "words")
#: What goes through the pass that makes a node's n-gram set.
_CARRIED = ("node", "copies", "bands", "groups")


def _key(id_col: str, text_col: str) -> list[Column]:
    ident = F.col(id_col).cast("long")
    return [ident.isNull().alias("none"), F.coalesce(ident, F.lit(0)).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("words")]


def banding(threshold: float, recall: float, rows: int = 8) -> tuple[int, int]:
    """(bands, rows): the fewest bands of `rows` rows that find a pair at the
    threshold with the target recall, 1 - (1 - t^rows)^bands."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return base[:n], base[n:] | np.uint64(1)


def shingles(words: list[str], n: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a shorter text has
    one n-gram, all of it, and an empty one none."""
    h = word_hashes(words) if hashes is None else hashes
    if not len(h):
        return np.zeros(0, np.uint64)
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        acc = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            acc = mix64(acc * np.uint64(31) + h[i : len(h) - n + 1 + i])
    return np.unique(acc)


def signature(sets: list[np.ndarray], size: int) -> np.ndarray:
    """MinHash signatures, one row of `size` minima per non-empty set."""
    xors, muls = _seeds(size)
    out = np.empty((len(sets), size), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(sets):
            j, held = i, 0
            while j < len(sets) and (j == i or held + len(sets[j]) <= _CHUNK):
                held += len(sets[j])
                j += 1
            flat = np.concatenate(sets[i:j])
            starts = np.cumsum([0, *map(len, sets[i : j - 1])])
            work = np.empty_like(flat)
            for k in range(size):
                np.bitwise_xor(flat, xors[k], out=work)
                np.multiply(work, muls[k], out=work)
                out[i:j, k] = np.minimum.reduceat(work, starts)
            i = j
    return out


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """64-bit hash of each band (its number included), as signed integers."""
    sig = signature(sets, bands * rows).reshape(len(sets), bands, rows)
    with np.errstate(over="ignore"):
        acc = mix64(np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), bands)))
        for r in range(rows):
            acc = mix64(acc * np.uint64(31) + sig[:, :, r])
    return acc.view(np.int64)


def _word_lists(texts: list[str]) -> tuple[list[list[str]], list[np.ndarray]]:
    lists = [WORD.findall(t.lower()) for t in texts]
    flat = word_hashes([w for x in lists for w in x])
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    return lists, np.split(flat, cuts)


def _signer(n: int, bands: int, rows: int):
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            lists, hashes = _word_lists(texts)
            sets = [shingles(w, n, h) for w, h in zip(lists, hashes, strict=True)]
            full = [i for i, s in enumerate(sets) if len(s)]
            digest = [xxhash.xxh3_128_digest(h.tobytes()) for h in hashes]
            pairs = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2) if digest else np.zeros((0, 2), np.int64)
            counts = np.zeros(len(texts), np.int64)
            counts[full] = bands
            values = band_hashes([sets[i] for i in full], bands, rows).reshape(-1) if full else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(part.schema.get_field_index(c)) for c in _KEY],
                    pa.array(pairs[:, 0]),
                    pa.array(pairs[:, 1]),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values)),
                ],
                [*_KEY, "fp1", "fp2", "bands"],
            )

    return trimmed(sign)


def _set_maker(n: int):
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            lists, hashes = _word_lists(texts)
            sets = [shingles(w, n, h).tobytes() for w, h in zip(lists, hashes, strict=True)]
            keep = [part.column(part.schema.get_field_index(c)) for c in _CARRIED]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sets, pa.binary())], [*_CARRIED, "grams"])

    return trimmed(make)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets."""
    universe = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(universe), _COLUMNS):
        some = universe[at : at + _COLUMNS]

        def rows(sets: list[np.ndarray], some: np.ndarray = some) -> np.ndarray:
            grid = np.zeros((len(sets), len(some)), np.float32)
            for i, s in enumerate(sets):
                own = s[np.searchsorted(s, some[0]) : np.searchsorted(s, some[-1], "right")]
                at = np.searchsorted(some, own)
                grid[i, at[some[at] == own]] = 1
            return grid

        a = rows(left)
        out += a @ (a if right is left else rows(right)).T
    return out


def _verifier(threshold: float):
    def verify(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        node = table.column("node").to_numpy()
        copies = table.column("copies").to_numpy()
        block = table.column("block").to_numpy()
        place = table.column("place")[0].as_py()
        bands = np.array(table.column("bands").to_pylist(), np.int64) if place > 0 else None
        grams = [np.frombuffer(b, np.uint64) for b in table.column("grams").to_pylist()]
        one, two = np.flatnonzero(block == x), np.flatnonzero(block == y)
        sizes = np.array([len(g) for g in grams], np.float64)
        left = [grams[i] for i in one]
        right = left if x == y else [grams[i] for i in two]
        links = np.zeros(len(node), np.int64)
        others = np.zeros(len(node), np.int64)
        parent = np.arange(len(node))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        if left and right:
            both = overlaps(left, right)
            total = sizes[one][:, None] + sizes[two][None, :] - both
            near = both >= threshold * total - 1e-9
            if x == y:
                np.fill_diagonal(near, False)
                near = np.triu(near)
            if place > 0:  # pairs that an earlier bucket has
                i, j = np.nonzero(near)
                seen = (bands[one[i], :place] == bands[two[j], :place]).any(axis=1)
                near[i[seen], j[seen]] = False
            a, b = one[np.nonzero(near)[0]], two[np.nonzero(near)[1]]
            np.add.at(links, a, 1)
            np.add.at(links, b, 1)
            np.add.at(others, a, copies[b])
            np.add.at(others, b, copies[a])
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                p, q = root(i), root(j)
                if p != q:
                    lo, hi = (p, q) if node[p] <= node[q] else (q, p)
                    parent[hi] = lo
        tops = node[[root(i) for i in range(len(node))]]
        return pa.table({"node": node, "links": links, "others": others, "top": tops})

    return verify


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.997, block: int = 256) -> DataFrame:
    """All pairs of texts with a Jaccard similarity of word n-grams of at least
    `threshold`, as one row per input row: (id_col, class_id, n_links,
    n_link_docs, n_copies).

    class_id is the smallest id of the documents joined by chains of links or
    copies (null if none of them has one); n_links counts the different texts
    linked to the document's text, n_link_docs the documents that have them,
    n_copies the documents with its text. Words are lower-cased runs of letters
    and digits.

    Null or wordless texts have no n-grams: they form classes of their own,
    without links. Texts under n words have one n-gram, the whole text. Rows
    that share an id, or have none, are told apart by their texts: each belongs
    to the class of its own text. Extra columns are ignored; an empty table
    gives no rows. Word sequences are told apart by 128-bit hashes, of which 64
    bits name them in candidate pairs."""
    told = _classified(docs, id_col, text_col, n, threshold, recall, block)
    ident = F.when(~F.col("none"), F.col("id"))
    first = F.when(~F.col("first.none"), F.col("first.id"))
    return told.select(ident.alias(id_col), first.alias("class_id"), "n_links", "n_link_docs", "n_copies")


def _classified(docs: DataFrame, id_col: str, text_col: str, n: int = 5, threshold: float = 0.8, recall: float = 0.997, block: int = 256) -> DataFrame:
    """Per input row its key (none, id, words), the key `first` of its class's
    first document and the counts of ngram_join()."""
    spark = docs.sparkSession
    bound_arrow(spark)
    bands, rows = banding(threshold, recall)
    text = F.col(text_col).cast("string")
    source = docs.select(*_key(id_col, text_col), text.alias("text"))
    key = "none boolean, id long, words long"
    signed_at, told_at = (shared_path(spark, name) for name in ("signed", "told"))
    signed = materialize(source.mapInArrow(_signer(n, bands, rows), f"{key}, fp1 long, fp2 long, bands array<long>"), "signed", signed_at)
    real = signed.where(F.size("bands") > 0)
    with scratch():
        nodes = real.groupBy("fp1", "fp2").agg(F.min(F.struct(*_KEY)).alias("one"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
        nodes = materialize(nodes.withColumn("node", F.col("fp1")), "nodes")
        keyed = nodes.select("node", F.posexplode("bands").alias("place", "band"))
        buckets = keyed.groupBy("band", "place").agg(F.min("node").alias("hub"), F.max("node").alias("far"), F.count("*").alias("size"), F.expr("bit_xor(xxhash64(node))").alias("x1"), F.expr("bit_xor(xxhash64(node, 1))").alias("x2"))
        buckets = materialize(buckets.where("hub != far"), "buckets")
        stars = keyed.join(buckets.select("band", "hub"), "band").where("node != hub").select(F.col("node").alias("src"), F.col("hub").alias("dst"))
        comps = materialize(connected_components(stars), "candidates")

        # Buckets of the same members say the same pairs: the first of them counts.
        distinct = buckets.groupBy("size", "x1", "x2").agg(F.min(F.struct("place", "band", "hub")).alias("b")).select("size", "b.*")
        distinct = distinct.join(comps.withColumnRenamed("node", "hub"), "hub")
        costs = distinct.groupBy("root").agg(F.sum(F.col("size") * F.col("size")).alias("by_bucket")).join(comps.groupBy("root").agg(F.count("*").alias("n")), "root")
        costs = materialize(costs.select("root", "n", (F.col("by_bucket") < F.col("n") * F.col("n")).alias("split")), "costs")
        whole = comps.join(costs.where("not split"), "root").select("node", F.col("root").alias("comp"), F.lit(-1).alias("place"), F.ceil(F.col("n") / block).alias("blocks"))
        chosen = distinct.join(costs.where("split").select("root"), "root").select("band", F.ceil(F.col("size") / block).alias("blocks"))
        parts = keyed.join(chosen, "band").select("node", F.col("band").alias("comp"), "place", "blocks")
        # A node is in one component, or in one bucket for each band at most.
        groups = whole.unionByName(parts).groupBy("node").agg(F.collect_list(F.struct("comp", "place", "blocks")).alias("groups"))
        wanted = nodes.select("node", "one.*", "copies", "bands").join(groups, "node")
        texts = source.join(wanted, list(_KEY)).dropDuplicates(["node"])
        grams = texts.select(*_CARRIED, "text").mapInArrow(_set_maker(n), "node long, copies long, bands array<long>, groups array<struct<comp: long, place: int, blocks: long>>, grams binary")
        dealt = (
            grams.withColumn("group", F.explode("groups"))
            .select("node", "copies", "bands", "grams", "group.*")
            .withColumn("bands", F.when(F.col("place") > 0, F.slice("bands", F.lit(1), F.greatest("place", F.lit(0)))))
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .select("comp", "place", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "copies", "grams", "bands")
        )
        found = materialize(dealt.groupBy("comp", "place", "x", "y").applyInArrow(_verifier(threshold), "node long, links long, others long, top long"), "links")
        counts = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("others").alias("others"))
        classes = connected_components(found.where("links > 0").select(F.col("node").alias("src"), F.col("top").alias("dst")))
        none = F.lit(0).cast("long")
        linked = nodes.select("node", "fp1", "fp2", "one", "copies").join(counts, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
        firsts = linked.groupBy("root").agg(F.min("one").alias("first"))
        told = materialize(linked.join(firsts, "root").select("fp1", "fp2", "first", F.coalesce("links", none).alias("n_links"), F.coalesce("others", none).alias("n_link_docs"), F.col("copies").alias("n_copies")), "told", told_at)
    rest = signed.where(F.size("bands") == 0).select(*_KEY, F.struct(*_KEY).alias("first"), none.alias("n_links"), none.alias("n_link_docs"), (none + 1).alias("n_copies"))
    return real.select(*_KEY, "fp1", "fp2").join(told, ["fp1", "fp2"]).select(*_KEY, "first", "n_links", "n_link_docs", "n_copies").unionByName(rest)


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with one row per near-duplicate class left, the one with
    the smallest id (null ids last, then the least hash of the text). Texts
    without words stay, repeated rows excepted: of rows alike in id and text one
    stays. All columns come through; an empty table gives no rows. The rows to
    drop are found without their texts, which are shuffled once."""
    names = [f"__{k}" for k in _KEY]
    told = _classified(docs, id_col, text_col, **how)
    drop = told.where(F.struct(*_KEY) != F.col("first")).select(*[F.col(k).alias(x) for k, x in zip(_KEY, names, strict=True)]).distinct()
    keyed = docs.select("*", *[c.alias(x) for c, x in zip(_key(id_col, text_col), names, strict=True)])
    return keyed.join(drop, names, "left_anti").dropDuplicates(names).select(*docs.columns)
