"""Several tables committed as one: a snapshot lists the files of each table, and is there whole or not at all.

A store is a folder with ``data`` (files, never changed) and ``snapshots`` (``version=n``: the files of each table after commit n).  A commit
writes its new files first and the list last.  A list is only made where none of that number is: of two commits that start from
the same version the second fails and may try again, and one that is killed leaves files that no list names.  The refusal is that of
Spark's writer, which looks before it writes and holds no lock: jobs that may commit within the same second need one of their own.

Tables are stored in ranges of their key, so erasing keys writes anew only the files that hold one of them.  The lists hold one row per file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FILES = "name string, schema string, path string"


class Conflict(RuntimeError):
    """Another commit has taken the version; read the newest one and try again."""


def _list(spark: SparkSession, folder: str, version: int) -> list:
    return spark.read.schema(FILES).parquet(f"{folder}/snapshots/version={version}").collect()  # one row per file


def version(spark: SparkSession, folder: str) -> int:
    """The newest version; -1 for a folder that holds none."""
    try:
        listed = spark.read.schema(f"{FILES}, version int").parquet(f"{folder}/snapshots")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1
    newest = listed.agg(F.max("version")).first()[0]
    return -1 if newest is None else newest


def _publish(spark: SparkSession, folder: str, base: int, files: list[tuple[str, str, str]]) -> int:
    rows = spark.createDataFrame(files, FILES).coalesce(1)
    try:
        rows.write.mode("error").parquet(f"{folder}/snapshots/version={base + 1}")
    except AnalysisException as taken:
        if taken.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise Conflict(f"version {base + 1} of {folder} is there already") from taken
    return base + 1


def _store(df: DataFrame, folder: str, name: str, key: str, files: int | None = None) -> list[tuple[str, str, str]]:
    """Write a table's rows in ranges of ``key``; the files they went to.  ``files`` bounds their number."""
    path = f"{folder}/data/{name}/{uuid.uuid4().hex}"
    (df.repartitionByRange(files, key) if files else df.repartitionByRange(key)).sortWithinPartitions(key).write.parquet(path)
    shape = df.schema.json()
    written = df.sparkSession.read.schema(df.schema).parquet(path).select("_metadata.file_path").distinct().collect()
    # A table without rows still has its columns.
    return [(name, shape, r.file_path) for r in written] or [(name, shape, "")]


def commit(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], keys: Mapping[str, str], base: int | None = None, replace: bool = False) -> int:
    """Add the rows of all ``tables`` (or with ``replace`` put them in place of what is there) as one version; its number.

    ``keys`` names the column that each table is ranged by.  ``base`` is the version the caller has read, by default the newest.
    """
    base = version(spark, folder) if base is None else base
    held = [tuple(r) for r in _list(spark, folder, base)] if base >= 0 else []
    files = [f for f in held if not (replace and f[0] in tables)]
    for name, df in tables.items():
        files += _store(df, folder, name, keys[name])
    return _publish(spark, folder, base, files)


def read(spark: SparkSession, folder: str, name: str, at: int | None = None) -> DataFrame:
    """A table as of a version, by default the newest."""
    listed = [r for r in _list(spark, folder, version(spark, folder) if at is None else at) if r.name == name]
    if not listed:
        raise KeyError(f"{folder} holds no table {name}")
    schema = StructType.fromJson(json.loads(listed[0].schema))
    paths = [r.path for r in listed if r.path]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def erase(spark: SparkSession, folder: str, erased: DataFrame, key: str, names: list[str], base: int | None = None) -> tuple[int, int, int]:
    """Erase the keys listed in ``erased`` from all tables ``names`` as one version.

    Only files that hold one of the keys are read whole and written anew.  Earlier versions keep theirs until ``vacuum``.  Returns the
    version, the files written anew, and the files left alone.
    """
    base = version(spark, folder) if base is None else base
    gone = erased.select(key).distinct()
    held, out, touched = [tuple(r) for r in _list(spark, folder, base)], [], 0
    for name in names:
        own = [f for f in held if f[0] == name and f[2]]
        rows = read(spark, folder, name, base)
        hit = {r.file_path for r in rows.select(key, "_metadata.file_path").join(gone, key, "left_semi").select("file_path").distinct().collect()} if own else set()
        out += [f for f in own if f[2] not in hit]
        touched += len(hit)
        if hit:
            left = spark.read.schema(rows.schema).parquet(*sorted(hit)).join(gone, key, "left_anti")
            out += _store(left, folder, name, key, len(hit))
        elif not own:
            out += [f for f in held if f[0] == name]
    out += [f for f in held if f[0] not in names]
    return _publish(spark, folder, base, out), touched, sum(bool(f[2]) for f in held) - touched


def unlisted(spark: SparkSession, folder: str, keep: int) -> DataFrame:
    """Files of no version from ``keep`` on: what a cleaning job may delete, for instance after an erasure."""
    listed = spark.read.schema(f"{FILES}, version int").parquet(f"{folder}/snapshots").where(F.col("version") >= keep).select("path")
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{folder}/data").select("path")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  local paths are spelt in two ways
    return stored.join(listed.select(plain("path").alias("known")).distinct(), plain("path") == F.col("known"), "left_anti")
