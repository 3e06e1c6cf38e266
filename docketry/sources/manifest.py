"""Manifests and HTML pages as tables, and single-file sinks."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a manifest, in order.
COLUMNS = ("record_key", "bucket_name", "order_date", "title", "external_record_id", "detail_url", "pdf_url", "local_filename", "status", "error", "first_seen_at", "last_seen_at")
REQUIRED = ("record_key", "bucket_name", "title", "status", "first_seen_at", "last_seen_at")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS] + [T.StructField("_corrupt", T.StringType())])


def read_manifests(spark: SparkSession, root: str, name: str = "orders_manifest.csv") -> DataFrame:
    """Every manifest under root, with the errors of each row; rows that don't have the twelve columns are bad ones."""
    rows = spark.read.csv(root, schema=SCHEMA, header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", pathGlobFilter=name, recursiveFileLookup=True, multiLine=True)
    rows = rows.withColumn("folder", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    return validate(rows)


def validate(rows: DataFrame) -> DataFrame:
    """errors: what is wrong with each row; typed dates and times beside the raw columns."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    zoned = lambda c: F.when(F.col(c).rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.col(c).try_cast("timestamp"))
    rows = rows.withColumns({"order_day": F.col("order_date").try_cast("date"), "first_seen": zoned("first_seen_at"), "last_seen": zoned("last_seen_at")})
    checks = [F.when(blank(c), F.lit(f"{c} is blank")) for c in REQUIRED]
    checks += [
        F.when(~blank("order_date") & F.col("order_day").isNull(), F.lit("order_date is no date")),
        F.when(F.col("first_seen").isNull() & ~blank("first_seen_at"), F.lit("first_seen_at is no time with an offset")),
        F.when(F.col("last_seen").isNull() & ~blank("last_seen_at"), F.lit("last_seen_at is no time with an offset")),
        F.when(F.col("first_seen") > F.col("last_seen"), F.lit("first_seen_at is after last_seen_at")),
    ]
    if "folder" in rows.columns:
        checks.append(F.when(F.col("bucket_name") != F.col("folder"), F.lit("bucket_name isn't the folder")))
    if "_corrupt" in rows.columns:
        checks.append(F.when(F.col("_corrupt").isNotNull(), F.lit("not twelve columns")))
    return rows.withColumn("errors", F.array_compact(F.array(*checks)))


def latest_by_key(rows: DataFrame) -> DataFrame:
    """The row of each record_key that was seen last, ties by all columns; for the last row of a file see last_rows()."""
    best = F.max_by(F.struct(*rows.columns), F.struct("last_seen_at", *[c for c in COLUMNS if c in rows.columns])).alias("r")
    return rows.groupBy("record_key").agg(best).select("r.*")


def last_rows(spark: SparkSession, path: str) -> DataFrame:
    """One manifest, the last row of each record_key as the file has them."""
    rows = spark.read.csv(path, schema=SCHEMA, header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", multiLine=True).where("_corrupt is null").drop("_corrupt")
    return rows.withColumn("__at", F.monotonically_increasing_id()).groupBy("record_key").agg(F.max_by(F.struct(*COLUMNS), "__at").alias("r")).select("r.*")


def write_manifest(rows: DataFrame, path: str) -> None:
    """One CSV file, the newest first; a manifest is a listing of bounded size."""
    rows.orderBy(F.desc("order_date"), F.desc(F.lower("title")), F.desc("record_key")).coalesce(1).write.mode("overwrite").csv(path, header=True)


def file_snapshots(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, size and sha256 of every file, also of empty ones, which a scan passes over."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    read = files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    # the scan's own listing, which is on the driver
    listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(x)),) for x in files.inputFiles()], "path string")
    empty = listed.join(files.select("path"), "path", "left_anti")
    return read.unionByName(empty.select("path", F.lit(0).cast("long").alias("size"), F.sha2(F.lit(""), 256).alias("sha256")))


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, place, href and the text of each link."""
    tag = r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    hits = F.arrays_zip(F.regexp_extract_all("html", F.lit(tag), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(tag), F.lit(2)).alias("label"))
    rows = pages.select("page_id", F.posexplode(hits).alias("place", "a"))
    return rows.select("page_id", "place", F.col("a.href").alias("href"), F.trim(F.regexp_replace(F.regexp_replace("a.label", "<[^>]*>", ""), r"\s+", " ")).alias("label"))


def titles(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"))
