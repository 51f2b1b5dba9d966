"""Several tables replaced at once: every version of a set of tables is one small
manifest file that names their folders, and is written last.

A reader resolves the newest whole manifest once and sees its tables only. A
crash before the manifest leaves the old set, one while it is written leaves a
manifest that cannot be read and is passed over."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class VersionTaken(Exception):
    """Another writer committed this version first."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _write_new(spark: SparkSession, path: str, body: str) -> None:
    """Create a file that must not exist yet."""
    fs, at = _fs(spark, path)
    try:
        out = fs.create(at, False)
    except Exception as error:
        if "exist" in str(error).lower():
            raise VersionTaken(path) from error
        raise
    try:
        out.write(bytearray(body, "utf-8"))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()


def versions(spark: SparkSession, root: str) -> dict[int, dict[str, str]]:
    """Whole manifests by version: {table: folder}."""
    fs, at = _fs(spark, f"{root}/_versions")
    found: dict[int, dict[str, str]] = {}
    if not fs.exists(at):
        return found
    for f in fs.listStatus(at):
        name = f.getPath().getName()
        if name.endswith(".json") and name[:-5].isdigit():
            try:
                body = json.loads(_read_text(spark, f.getPath().toString()))
                found[int(name[:-5])] = dict(body["tables"])
            except (ValueError, KeyError, TypeError):
                continue  # written in part
    return found


def _taken(spark: SparkSession, root: str) -> int:
    fs, at = _fs(spark, f"{root}/_versions")
    if not fs.exists(at):
        return 0
    return max((int(n[:-5]) for n in (f.getPath().getName() for f in fs.listStatus(at)) if n.endswith(".json") and n[:-5].isdigit()), default=0)


def commit_tables(tables: dict[str, DataFrame], root: str) -> int:
    """Write the tables beside the old ones and make all of them current in one
    step; tables that are not given stay what they are. Returns the version. Of
    two writers that started from one version the second gets VersionTaken and
    changes nothing."""
    spark = next(iter(tables.values())).sparkSession
    known = versions(spark, root)
    current = known[max(known)] if known else {}
    version = _taken(spark, root) + 1
    folders = {name: f"{root}/{name}/{version}-{uuid.uuid4().hex[:8]}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(folders[name])
    _write_new(spark, f"{root}/_versions/{version:012d}.json", json.dumps({"tables": current | folders}))
    return version


def read_tables(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of one version, the newest by default; all of them belong together."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        raise LookupError(f"no version {version or ''} in {root}")
    chosen = known[max(known) if version is None else version]
    return {name: spark.read.parquet(path) for name, path in chosen.items()}


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete all but the newest versions and the folders that only they name.
    Readers that resolved an older one before must have ended."""
    known = versions(spark, root)
    old = sorted(known)[:-keep] if keep else sorted(known)
    needed = {p for v, tables in known.items() if v not in old for p in tables.values()}
    for v in old:
        fs, at = _fs(spark, f"{root}/_versions/{v:012d}.json")
        fs.delete(at, False)
        for path in set(known[v].values()) - needed:
            fs, at = _fs(spark, path)
            fs.delete(at, True)
    return old
