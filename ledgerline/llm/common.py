"""Shared pieces of the corpus operators: tables in the shared folder, Arrow
slicing by text volume, word hashing, distributed union-find and prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the size and quality contracts: runs of anything but ASCII white space.
ASCII_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words for near-duplicate work: letters, digits and underscore of any script.
WORD = re.compile(r"\w+")

#: Characters of text that a Python worker turns into words at a time.
SLICE_CHARS = 1 << 20

#: Bytes of an Arrow batch that goes to a Python worker, about.
ARROW_BYTES = 4 << 20

_own_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local
    session without one gets a new folder that is then set as such; on a cluster
    its absence is an error, as executors would not see each other's files."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='ledgerline-')}"
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by the scratch() around it, else
    when the driver's Python ends."""
    path = f"{shared_dir(spark)}/ledgerline/{name}-{uuid.uuid4().hex[:12]}"
    _own_tables.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder (at path, if given) and read it
    back: this cuts the lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when the write has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are made inside are deleted at the end; what is returned from
    inside must not read them any more."""
    start = len(_own_tables)
    try:
        yield
    finally:
        _delete(start)


@atexit.register
def release_tables() -> None:
    """Delete the tables that materialize() and shared_path() made."""
    _delete(0)


def _delete(start: int) -> None:
    for spark, path in reversed(_own_tables[start:]):
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # that session may be gone already; its folder goes with it
            continue
    del _own_tables[start:]


def bound_arrow(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches: with the default count of
    rows a batch of long texts would take hundreds of megabytes on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = str(spark.conf.get(name)).lower().rstrip("b")
    if not bound.isdigit() or int(bound) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def trimmed(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker hands its free memory back: Spark keeps
    workers for the next stage."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def text_slices(batches: Iterable[pa.RecordBatch], column: str, budget: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches so that a slice has about `budget` characters (or one
    longer text); null texts come as empty strings."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        start, held, some = 0, 0, []
        for i in range(batch.num_rows):
            text = texts[i].as_py() or ""
            if some and held + len(text) > budget:
                yield batch.slice(start, i - start), some
                start, held, some = i, 0, []
            some.append(text)
            held += len(text)
        if some:
            yield batch.slice(start), some


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers (murmur3's finaliser)."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_codes(words: list[str]) -> tuple[np.ndarray, list[str]]:
    """Index of each word in the list of the distinct ones."""
    coded = pa.array(words, pa.string()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def word_hashes(words: list[str]) -> np.ndarray:
    """Stable 64-bit hash of each word; equal words are hashed once."""
    if not words:
        return np.zeros(0, np.uint64)
    codes, distinct = word_codes(words)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    return hashed[codes]


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Distributed union-find: edges (src, dst) of one orderable type give rows
    (node, root), root being the smallest node of the component.

    Alternates the large-star and small-star rewrites until the edge set is
    stable, so each round costs a few shuffles of at most the edge set and no
    component is ever held by one task. Nulls and self-loops are ignored."""
    e = materialize(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        "edges",
    )
    state = _edge_state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        out = small.select(F.col("u"), F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = materialize(out.distinct(), "edges")
        before, state = state, _edge_state(e)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _edge_state(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
    return row["n"], row["h"]


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """For each (out, amount) of sums, the sum of `amount` over the rows before
    each row of its group, in the order of (bucket, order).

    No task holds more than one bucket or the list of the bucket totals of one
    group: totals per bucket come from a partial aggregation, their running sums
    from a window over the totals alone."""
    totals = df.groupBy(*group, bucket).agg(*[F.sum(a).alias(f"__sum_{o}") for o, a in sums.items()])
    over = Window.partitionBy(*group).orderBy(F.col(bucket).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(g).alias(f"__{g}") for g in group],
        F.col(bucket).alias("__bucket"),
        *[F.coalesce(F.sum(f"__sum_{o}").over(over), F.lit(0)).alias(f"__start_{o}") for o in sums],
    )
    match = F.col(bucket) == F.col("__bucket")
    for g in group:
        match = match & (F.col(g) == F.col(f"__{g}"))
    inside = Window.partitionBy(*group, bucket).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.select("*", *[F.coalesce(F.sum(a).over(inside), F.lit(0)).alias(f"__in_{o}") for o, a in sums.items()]).join(starts, match)
    return placed.select(*df.columns, *[(F.col(f"__start_{o}") + F.col(f"__in_{o}")).alias(o) for o in sums])
