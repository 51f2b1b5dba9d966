"""Change detection and upserts over micro-batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


class _Changes(StatefulProcessor):
    """Emits rows whose values differ from the last ones of their key. The last
    values are the only state; rows of a batch come sorted, in bounded pieces."""

    def __init__(self, order: str, values: tuple[str, str]) -> None:
        self.order, self.values = order, values

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "a double, b double, is_set boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        last = np.array([self.last.get()[:2]], float) if self.last.exists() else None
        for piece in rows:
            now = piece[list(self.values)].to_numpy(float, na_value=np.nan)
            before = np.concatenate([last if last is not None else now[:1], now[:-1]])
            changed = ~((now == before) | (np.isnan(now) & np.isnan(before))).all(axis=1)
            if last is None and len(now):
                changed[0] = True
            if len(now):
                last = now[-1:]
            yield piece[changed]
        if last is not None:
            self.last.update((*(None if np.isnan(v) else float(v) for v in last[0]), True))

    def close(self) -> None:
        pass


def changes_by_state(stream: DataFrame, key: str, order: str, values: tuple[str, str]) -> DataFrame:
    """Rows of a stream whose values differ from the last ones of their key.

    For streams whose rows of a key arrive in order, over batches and within
    them. The rows pass through in pieces of bounded size and only the last
    values are kept; needs the RocksDB state store."""
    kinds = dict(stream.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in stream.columns)
    return stream.groupBy(key).transformWithStateInPandas(_Changes(order, values), schema, "Append", "None")


def emit_changes_stream(stream: DataFrame, key: str, order: str, values: tuple[str, str], path: str, checkpoint: str):
    """Start a query that appends to `path`/out the rows whose values differ from
    the last ones of their key, in the order of `order` within a batch.

    Every micro-batch is one window over the batch and the last rows of its keys:
    Spark sorts and spills, no key is held by Python. The last rows are a table
    by batch number; a batch that is run again reads what it read before and
    replaces what it wrote, and the table before the last one is deleted. A null
    key is one of its own; of rows equal in `order` either may come first."""
    columns = stream.columns

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("__new", F.lit(True))
        before = latest_version(spark, path, number)
        if before is not None:
            last = spark.read.schema(rows.schema).parquet(f"{path}/last/v={before}")
            rows = rows.unionByName(last.withColumn("__new", F.lit(False)))
        w = Window.partitionBy(key).orderBy("__new", order)
        same = F.lit(True)
        for v in values:
            same = same & F.col(v).eqNullSafe(F.lag(v).over(w))
        marked = rows.withColumns({"__changed": ~same | (F.row_number().over(w) == 1), "__last": F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__new"), F.desc(order))) == 1})
        marked = marked.persist(StorageLevel.DISK_ONLY)
        try:
            marked.where("__new and __changed").select(*columns).write.mode("overwrite").parquet(f"{path}/out/batch={number}")
            marked.where("__last").select(*columns).write.mode("overwrite").parquet(f"{path}/last/v={number}")
        finally:
            marked.unpersist()
        drop_versions(spark, f"{path}/last", keep_from=before)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _children(spark: SparkSession, path: str) -> list:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(fs, f.getPath()) for f in fs.listStatus(at)] if fs.exists(at) else []


def latest_version(spark: SparkSession, path: str, before: int, folder: str = "last") -> int | None:
    """The newest whole version below a batch number; None without."""
    found = [(int(p.getName()[2:]), fs, p) for fs, p in _children(spark, f"{path}/{folder}") if p.getName().startswith("v=")]
    done = [v for v, fs, p in found if v < before and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=None)


def drop_versions(spark: SparkSession, path: str, keep_from: int | None) -> None:
    """Delete the versions below keep_from."""
    for fs, p in _children(spark, path):
        if keep_from is not None and p.getName().startswith("v=") and int(p.getName()[2:]) < keep_from:
            fs.delete(p, True)


def append_until_idle(start: Callable[[], StreamingQuery], pause: float = 1.0, empty: int = 3, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run an append loop: start() begins a query that takes what is there and
    ends; the loop stops after `empty` runs in a row without a row. Returns the
    rows that were read. A failed run ends the loop with its error; the query's
    checkpoint lets the next loop go on from there."""
    idle = total = 0
    while idle < empty:
        query = start()
        query.awaitTermination()
        rows = sum(p.numInputRows for p in query.recentProgress)
        total, idle = total + rows, 0 if rows else idle + 1
        if idle < empty and not rows:
            sleep(pause)
    return total


def windowed_counts(stream: DataFrame, ts: str, by: str, value: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window, late rows up to the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def upsert_stream(stream: DataFrame, path: str, keys: list[str], seq: str, checkpoint: str):
    """Merge each micro-batch into the table at `path` (versions beside each
    other, the newest named by the batch), last write per key. Versions before
    the one that a batch read are deleted."""
    from ledgerline.sources.upserts import replace_rows

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = latest_version(spark, path, number, ".")
        old = spark.read.parquet(f"{path}/v={before}") if before is not None else batch.limit(0)
        replace_rows(old, batch, keys, seq).write.mode("overwrite").parquet(f"{path}/v={number}")
        drop_versions(spark, path, before)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
