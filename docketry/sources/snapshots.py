"""Derived tables that belong together, written as one version and switched to at once.

Each version has a folder of its own; a pointer file names the current one and is replaced by a rename when all tables
are written. A writer that dies leaves the pointer as it was, and a reader never sees tables of two versions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER, DONE = "CURRENT", "_SUCCESS"


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, folder: str) -> str | None:
    """The name of the version that the pointer names, None without one."""
    at, store = _at(spark, f"{folder}/{POINTER}")
    if not store.exists(at):
        return None
    return spark.read.text(f"{folder}/{POINTER}").first()[0]


def write(tables: dict[str, DataFrame], folder: str) -> str:
    """Writes all tables as a new version, then switches to it. Returns the version's name."""
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    switch(spark, folder, version)
    return version


def switch(spark: SparkSession, folder: str, version: str) -> None:
    """Replaces the pointer in one step."""
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    fresh, store = _at(spark, f"{folder}/.{POINTER}.{uuid.uuid4().hex}")
    out = store.create(fresh, True)
    out.write(bytearray(version, "utf-8"))
    out.close()
    options = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.makeQualified(fresh).toUri(), context._jsc.hadoopConfiguration())
    files.rename(fresh, _at(spark, f"{folder}/{POINTER}")[0], options)


def whole(spark: SparkSession, folder: str, version: str, names: list[str]) -> bool:
    """Whether every table of a version was written to its end."""
    found = [_at(spark, f"{folder}/{version}/{name}/{DONE}") for name in names]
    return all(store.exists(at) for at, store in found)


def load(spark: SparkSession, folder: str, names: list[str], rebuild: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables of the current version; built anew where there is none or it lacks a table."""
    version = current(spark, folder)
    if version is None or not whole(spark, folder, version, names):
        version = write(rebuild(), folder)
    return {name: spark.read.parquet(f"{folder}/{version}/{name}") for name in names}
