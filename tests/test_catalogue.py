"""Versions of datasets, and derived tables that are switched to at once."""

import pytest
from pyspark.sql import functions as F

from docketry.operators import catalogue
from docketry.sources import snapshots

ROWS = [(1, "a", None), (2, "b", 2.5), (2, "b", 2.5), (3, None, 0.0)]
SCHEMA = "id int, said string, value double"


def version(df, by=None):
    return sorted((tuple(r) for r in catalogue.dataset_version(df, by).collect()), key=str)


def test_a_version_follows_from_the_rows_alone(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    (n, name), = version(df)
    assert n == 4 and len(name) == 12
    assert version(df.repartition(7, "value")) == version(spark.createDataFrame(ROWS[::-1], SCHEMA)) == version(df.select("value", "said", "id")) == [(4, name)]
    others = [ROWS[:3], [*ROWS, ROWS[0]], [*ROWS[:3], (3, None, 0.1)], [*ROWS[:3], (3, "", 0.0)], []]
    names = {version(spark.createDataFrame(rows, SCHEMA))[0] for rows in others}
    assert len(names) == 5 and (4, name) not in names
    assert version(df, ["said"]) != version(df.withColumn("value", F.lit(1.0)), ["said"]) and len(version(df, ["said"])) == 3 and version(df.limit(0), ["said"]) == []


NAMES = ["people", "offices", "counts"]


def tables(spark, n):
    return {name: spark.range(n).select("id", F.lit(name).alias("of")) for name in NAMES}


def test_a_writer_that_dies_leaves_a_whole_version(spark, tmp_path):
    folder, calls = f"file://{tmp_path}/derived", []

    def rebuild():
        calls.append(1)
        return tables(spark, 3)

    counts = lambda: {name: df.count() for name, df in snapshots.load(spark, folder, NAMES, rebuild).items()}
    assert counts() == dict.fromkeys(NAMES, 3) and len(calls) == 1 and counts() == dict.fromkeys(NAMES, 3) and len(calls) == 1
    broken = tables(spark, 5) | {"counts": spark.range(5).select(F.raise_error(F.lit("lost")).alias("id"))}
    with pytest.raises(Exception, match="lost"):
        snapshots.write(broken, folder)
    assert counts() == dict.fromkeys(NAMES, 3) and len(calls) == 1
    snapshots.write(tables(spark, 6), folder)
    assert counts() == dict.fromkeys(NAMES, 6)


def test_a_half_written_version_is_built_anew(spark, tmp_path):
    folder = f"file://{tmp_path}/derived"
    name = snapshots.write({k: v for k, v in tables(spark, 2).items() if k != "counts"}, folder)
    assert snapshots.current(spark, folder) == name and not snapshots.whole(spark, folder, name, NAMES)
    found = snapshots.load(spark, folder, NAMES, lambda: tables(spark, 4))
    assert found["counts"].count() == 4 and snapshots.current(spark, folder) != name
    assert snapshots.current(spark, f"{folder}-none") is None
