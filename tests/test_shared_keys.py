"""Pairs of rows with a common key, each once, against plain versions."""

from pyspark.sql import functions as F

from docketry.operators import matters, relational


def exchanges(df) -> int:
    """How often rows are shuffled after the join that makes the pairs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("Join")].count("Exchange")


def test_memory_scope(spark):
    states = [(1, [10, None], [1], [1]), (2, None, [1, 2, 1, None], [7]), (3, [], None, [7, 8]), (4, None, None, None), (2, None, [3], None), (5, [30], None, None), (5, None, [1], None), (None, None, [2], None)]
    versions = [(v, v % 4, v % 9, v % 5 != 0) for v in range(60)] + [(31, 2, 7, True), (30, 1, None, True), (77, None, 8, True)]
    want = {(s, v) for s, vs, _, _ in states for v in vs or ()}
    want |= {(s, v) for s, vs, rs, ds in states if not vs for v, r, d, now in versions if now and (r is not None and r in (rs or ()) or d is not None and d in (ds or ()))}
    a = spark.createDataFrame(states, "session_id long, version_ids array<long>, record_keys array<long>, document_ids array<long>")
    b = spark.createDataFrame(versions, "version long, record_key long, document_id long, current boolean")
    found = matters.memory_scope(a, b)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert exchanges(found) == 0


def test_staff_lookup(spark):
    asked = [(1, "E-1"), (1, "e 2"), (2, "E2"), (3, None), (4, " - "), (5, "zz"), (2, "E2")]
    raw = [("r1", "E1"), ("r2", "e-1"), ("r3", "E2"), ("r4", None), (None, "E2")]
    people = [(n, f"e{n % 3}", [f"r{n % 4}", "x"]) for n in range(20)] + [(20, None, ["r1", "r2", "r3"]), (21, "zz", None), (20, "E.1", None)]
    key = lambda t: "".join(c for c in (t or "").lower() if c.isascii() and c.isalnum())
    want = {(q, p) for q, n in asked for p, own, rows in people if key(n) and (key(own) == key(n) or any(r in (rows or ()) for r, m in raw if r and key(m) == key(n)))}
    a, b = spark.createDataFrame(asked, "query_id int, staff_no string"), spark.createDataFrame(raw, "row_key string, staff_no string")
    found = matters.staff_lookup(a, b, spark.createDataFrame(people, "person_id long, staff_no string, row_keys array<string>"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert exchanges(found) == 0


def test_a_frequent_key_is_dealt(spark):
    left, right = spark.range(5).select(F.col("id").alias("a"), F.lit("k").alias("__key")), spark.range(2000).select(F.col("id").alias("b"), F.lit("k").alias("__key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sizes = [n for n in relational.sharing(left, right, "a", "b").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 10000 and max(sizes) < 5000
