"""Shared folders, Arrow mapping and small helpers of the corpus operators."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and runs on one machine, as in tests.
FALLBACK_DIR = "file:///tmp/checkpoints/docketry"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, FALLBACK_DIR on one machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or FALLBACK_DIR).rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders of the tables that materialise() has written and discard() has not yet removed.
_written: list[str] = []


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """The driver removes what is there when it ends, unless discard() has before: results that are read lazily need it until then."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends there and no step runs twice. See gone_at_exit()."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    gone_at_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def mark() -> int:
    """For discard(): the tables written from now on."""
    return len(_written)


def discard(spark: SparkSession, *tables: DataFrame, since: int | None = None, but: DataFrame | None = None) -> None:
    """Removes these tables of materialise(), or all since a mark() but one, when what was made from them has been written."""
    paths = [t.stored_at for t in tables] + ([] if since is None else _written[since:])
    context = spark.sparkContext
    for path in dict.fromkeys(paths):
        if path in _written and path != getattr(but, "stored_at", None):
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
            _written.remove(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df hasn't got."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"__{name}{k or ''}" for k in range(len(taken) + 1)) if n not in taken)


def lookup(rows: DataFrame, keys: list[str], table: DataFrame, deal_by: list[str], parts: int, how: str = "inner") -> DataFrame:
    """rows with the columns of table, which has each key once (how: inner or left). The rows of a key are dealt into parts,
    and what goes to a key's task is one row a part: no key meets in one task, however many rows it has."""
    part = unused(rows, "part")
    rows = rows.withColumn(part, F.pmod(F.xxhash64(*deal_by), F.lit(parts)).cast("int"))
    asked = rows.select(*keys, part).distinct().join(table, keys)
    return rows.join(asked, [*keys, part], how).drop(part)


def tasks_for(total: int | None, each: int) -> int:
    """How many tasks take ``each`` of the total: a number that adaptive execution doesn't lower."""
    return max(1, -(-(total or 0) // each))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate, for a scan the bytes of its files; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 2**60 else 0


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


#: Bytes of text that a mapping sees at once; one text may be longer.
SLICE_BYTES = 1 << 20


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the values of column come to about ``most`` bytes: arrays made from them stay small."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, text: str | None = None) -> DataFrame:
    """mapInArrow; with text, over batches cut by the bytes of that column."""
    return df.mapInArrow(fn if text is None else lambda batches: fn(sliced(batches, text)), schema)


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path, None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def open_store(uri: str):
    """(file system, path) for a folder's URI; pyarrow opens file:, hdfs:, s3: and gs: alike."""
    from pyarrow import fs

    path = local_path(uri)
    if path is not None:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, name: str, write: Callable) -> str:
    """Calls write(stream) on a file of this attempt's own, then renames it: a task that runs again replaces a whole file."""
    store, root = open_store(uri)
    store.create_dir(root, recursive=True)
    attempt = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as out:
        write(out)
    store.move(attempt, f"{root}/{name}")
    return f"{root}/{name}"


def bounded(cache: dict, most: int) -> None:
    if len(cache) > most:
        cache.clear()


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def env_single_thread() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
