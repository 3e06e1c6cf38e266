"""Reads of the catalogue: turns in order, coverage, counts over sources, scopes, ranges, ids and versions of datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, by: str, *order: Column | str, name: str = "place") -> DataFrame:
    """rows with their place (from 1) within a key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def repeated_shares(rows: DataFrame, by: str, values: dict[str, Column]) -> DataFrame:
    """For each key and value the share of rows that repeat another one's."""
    return rows.groupBy(by).agg(*[F.round(1 - F.countDistinct(v) / F.count("*"), 6).alias(name) for name, v in values.items()])


def coverage(records: DataFrame, done: Column, owner: str, large: Column, parts: DataFrame, key: str, part_key: str) -> DataFrame:
    """One row: docs, finished ones, owners, owners of large ones, and the finished records that have parts."""
    finished = records.where(done).select(F.col(key).alias(part_key))
    a = records.agg(F.count("*").alias("docs"), F.count_if(done).alias("finished"), F.countDistinct(owner).alias("owners"), F.countDistinct(F.when(large, F.col(owner))).alias("large_owners"))
    b = parts.join(finished, part_key, "left_semi").agg(F.countDistinct(part_key).alias("with_parts"))
    return a.crossJoin(b)  # one row each


def source_counts(sources: dict[str, DataFrame]) -> DataFrame:
    """src and n over the union of all sources; an empty source has no row."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("src")) for name, df in sources.items()]).groupBy("src").agg(F.count("*").alias("n"))


def local_share(rows: DataFrame, by: str, local: Column, key: str) -> DataFrame:
    """For each key: rows, local ones, missing ones, and the range of ids."""
    n = F.count_if(local)
    return rows.groupBy(by).agg(F.count("*").alias("n_docs"), n.alias("local_docs"), F.greatest(F.count("*") - n, F.lit(0)).alias("missing"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))


def in_either(rows: DataFrame, key: str, *scopes: DataFrame) -> DataFrame:
    """The rows whose key is in any of the scopes (each with that key)."""
    return rows.join(reduce(DataFrame.unionByName, [s.select(key) for s in scopes]).distinct(), key, "left_semi")


def with_counts(rows: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the number of their children, 0 without any. Both sides have the key."""
    n = children.groupBy(key).agg(F.count("*").alias(name))
    return rows.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def in_order(rows: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """For each key the values in their order as one text with commas."""
    held = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("__p"))
    return held.select(by, F.array_join(F.transform("__p", lambda x: x[value].cast("string")), ",").alias(name))


def latest(rows: DataFrame, k: int, *order: str) -> DataFrame:
    """The k rows that come last in this order."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(k)


def value_ranges(rows: DataFrame, by: str, value: str, expected: int) -> DataFrame:
    """For each key: rows, least and greatest value, and how many rows are missing from the expected number."""
    return rows.groupBy(by).agg(F.count("*").alias("cases"), F.min(value).alias("least"), F.max(value).alias("most"), F.greatest(expected - F.count("*"), F.lit(0)).alias("missing"))


def last_of_kinds(rows: DataFrame, by: str, kind: str, order: str, value: str, kinds: list[str]) -> DataFrame:
    """For each key the last value of each kind, null where it has none."""
    return rows.groupBy(by).agg(*[F.max_by(value, F.when(F.col(kind) == k, F.col(order))).alias(f"last_{k}") for k in kinds])


def case_id(said: Column, most: int = 72) -> Column:
    """case:, the words of a question and ten letters of its hash."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(said), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("case:"), F.coalesce(F.nullif(F.substring(bare, 1, most), F.lit("")), F.lit("case")), F.lit(":"), F.substring(F.sha1(said), 1, 10))


#: Lanes of a dataset's hash and the hexadecimal digits of each: sums of so many bits stay exact in a decimal.
LANES, DIGITS = 4, 15


def canonical(rows: DataFrame) -> Column:
    """A row as JSON with its columns by name; null ones are left out."""
    return F.to_json(F.struct(*sorted(rows.columns)))


def dataset_version(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (a row for each key of ``by``): n_rows and version, a hash of the rows whatever their order and partitions.

    The hash of each row's JSON is cut into lanes, which are summed: a partial aggregate, with repeated rows counted each. No rows: version of the empty set; by keys: no row."""
    keys = by or []
    sha = rows.select(*keys, F.sha2(canonical(rows), 256).alias("__sha"))
    lane = lambda k: F.conv(F.substring("__sha", k * DIGITS + 1, DIGITS), 16, 10).cast("decimal(20,0)")
    sums = [(F.coalesce(F.sum(lane(k)), F.lit(0)) % (1 << 4 * DIGITS)).cast("decimal(20,0)").alias(f"__{k}") for k in range(LANES)]
    out = sha.groupBy(*keys).agg(F.count("*").alias("n_rows"), *sums)
    parts = [F.lpad(F.lower(F.conv(F.col(f"__{k}").cast("string"), 10, 16)), DIGITS, "0") for k in range(LANES)]
    return out.select(*keys, "n_rows", F.substring(F.sha1(F.concat(F.col("n_rows").cast("string"), *parts)), 1, 12).alias("version"))
