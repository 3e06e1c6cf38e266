"""Connected components by alternating stars. Edges stay in tables; the driver sees one checksum a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import discard, lookup, materialise

MAX_ROUNDS = 60
#: The edges of a node are dealt into this many parts at least, and into one for each EDGES_A_PART edges there are.
PARTS, EDGES_A_PART = 64, 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v, both of one type that has an order. Returns node and root, the smallest node of its component, for nodes other than roots.

    The middle of a star meets in no task: its smallest neighbour is a partial aggregate, and goes to its edges part by part."""
    u, v, spark = F.col("u"), F.col("v"), edges.sparkSession
    edges = materialise(edges.where("u <> v").select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    count, seen = edges.count(), None
    for _ in range(MAX_ROUNDS):
        parts = max(PARTS, count // EDGES_A_PART)
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v0")).select("u", F.least("u", "v0").alias("m"))
        large = lookup(both.where("v > u"), ["u"], least, ["v"], parts).select(v.alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup(large, ["u"], least, ["v"], parts).select(v.alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, edges = edges, materialise(small.where("u <> v").distinct(), "edges")
        discard(spark, before)
        count, mixed = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (count, mixed) == seen:
            return edges.select(u.alias("node"), v.alias("root"))
        seen = (count, mixed)
    raise RuntimeError("the components did not settle")
