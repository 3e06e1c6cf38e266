"""Metrics of question-answering runs: groups, calibration, comparison, release gate, retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import scoring


def mean(c: Column) -> Column:
    return F.coalesce(F.round(F.avg(c.cast("double")), 6), F.lit(0.0))


def group_metrics(cases: DataFrame, key: str) -> DataFrame:
    """cases: passed, confidence, abstained. A null key is a group of its own."""
    return cases.groupBy(key).agg(F.count("*").alias("cases"), mean(F.col("passed")).alias("pass_rate"), mean(F.col("confidence")).alias("mean_confidence"), mean(F.col("abstained")).alias("abstain_rate"))


def tag_metrics(cases: DataFrame, tags: str) -> DataFrame:
    rows = cases.withColumn("tag", F.explode(tags)).where("tag is not null and trim(tag) <> ''")
    return group_metrics(rows, "tag")


def confusion(cases: DataFrame, expected: str, actual: str, values: list) -> DataFrame:
    return cases.groupBy(expected).pivot(actual, values).count().na.fill(0)


def calibration(cases: DataFrame) -> DataFrame:
    return cases.groupBy(scoring.bin_label(F.col("confidence")).alias("bin")).agg(F.count("*").alias("cases"), mean(F.col("confidence")).alias("mean_confidence"), mean(F.col("passed")).alias("precision"))


def calibration_errors(cases: DataFrame) -> DataFrame:
    """Expected calibration error over the bins, and the Brier score."""
    bins = cases.groupBy(scoring.bin_label(F.col("confidence")).alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("passed").cast("double")).alias("p"))
    ece = bins.agg(F.round(F.sum(F.abs(F.col("p") - F.col("c")) * F.col("n")) / F.sum("n"), 6).alias("ece"))
    brier = cases.agg(F.round(F.avg(F.pow(F.col("confidence") - F.col("passed").cast("double"), F.lit(2.0))), 6).alias("brier"))
    return ece.crossJoin(brier)  # one row each


def compare_runs(base: DataFrame, head: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Outer join on a key that may be null; what one side lacks counts as 0."""
    b = base.select(F.col(key).alias("bk"), F.lit(1).alias("in_b"), *[F.col(m).alias(f"base_{m}") for m in metrics])
    h = head.select(F.col(key).alias("hk"), F.lit(1).alias("in_h"), *[F.col(m).alias(f"head_{m}") for m in metrics])
    out = b.join(h, F.col("bk").eqNullSafe(F.col("hk")), "full_outer")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    cols = [x for m in metrics for x in (zero(f"base_{m}").alias(f"base_{m}"), zero(f"head_{m}").alias(f"head_{m}"), F.round(zero(f"head_{m}") - zero(f"base_{m}"), 6).alias(f"delta_{m}"))]
    return out.select(F.coalesce("bk", "hk").alias(key), *cols)


#: Metric, whether it must be at least or at most, threshold.
GATE = (
    ("contamination_count", "<=", 0.0), ("regression_pass_rate", ">=", 1.0), ("structured_accuracy", ">=", 0.9), ("numeric_accuracy", ">=", 0.9),
    ("equivalent_route_accuracy", ">=", 0.85), ("candidate_list_correctness", ">=", 0.95), ("request_failures", "<=", 0.0), ("true_bugs", "<=", 0.0),
)


def release_gate(summary: DataFrame, gate=GATE) -> DataFrame:
    """summary: one row with a column a metric; a row for each check."""
    checks = [F.struct(F.lit(m).alias("metric"), F.lit(op).alias("op"), F.lit(t).alias("threshold"), F.col(m).cast("double").alias("observed")) for m, op, t in gate]
    rows = summary.select(F.explode(F.array(*checks)).alias("c")).select("c.*")
    ok = F.when(F.col("op") == "<=", F.col("observed") <= F.col("threshold")).otherwise(F.col("observed") >= F.col("threshold"))
    return rows.withColumn("passed", F.coalesce(ok, F.lit(False)))


def retrieval(contexts: DataFrame, expected: DataFrame) -> DataFrame:
    """contexts: case_id, rank, record, chunk; expected: case_id, record. Precision, recall, weighted relevance, purity, redundancy."""
    gold = expected.select("case_id", "record").distinct().withColumn("gold", F.lit(1))
    rows = contexts.join(gold, ["case_id", "record"], "left").withColumn("hit", F.coalesce("gold", F.lit(0)))
    purity = rows.groupBy("case_id", "record").agg(F.count("*").alias("n")).groupBy("case_id").agg((F.max("n") / F.sum("n")).alias("purity"))
    main = rows.groupBy("case_id").agg(F.avg("hit").alias("precision"), F.countDistinct(F.when(F.col("hit") == 1, F.col("record"))).alias("found"), (F.sum(F.col("hit") / F.col("rank")) / F.sum(1.0 / F.col("rank"))).alias("relevance"), (1 - F.countDistinct("chunk") / F.count("*")).alias("duplicate_ratio"))
    want = gold.groupBy("case_id").agg(F.count("*").alias("wanted"))
    out = main.join(want, "case_id", "left").join(purity, "case_id")
    recall = F.coalesce(F.col("found") / F.col("wanted"), F.lit(0.0))
    return out.select("case_id", *[F.round(c, 6).alias(n) for c, n in ((F.col("precision"), "precision"), (recall, "recall"), (F.col("relevance"), "relevance"), (F.col("purity"), "purity"), (F.col("duplicate_ratio"), "duplicate_ratio"))])


#: The weights of the chunk audit's flags.
AUDIT = {"oversized": 4, "duplicate": 4, "overfragmented": 3, "dense": 2, "heading_only": 1, "tiny": 1, "section_jump": 1}


def severity(flags: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.sum(flag.cast("int")) * AUDIT[name] for name, flag in flags.items()])


def passes(must_abstain: Column, must_clarify: Column, status: Column, route_ok: Column, correctness: Column, faithfulness: Column, numeric: Column) -> Column:
    answered = route_ok & (correctness >= 0.7) & (faithfulness >= 0.7) & (numeric == 1.0) & (status == "answered")
    return F.when(must_abstain, status.isin("abstained", "clarify")).when(must_clarify, status == "clarify").otherwise(answered)
