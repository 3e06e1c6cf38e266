"""What is worked out once: frames of running text, and pages one at a time."""

import tracemalloc

from pyspark.sql import functions as F

from docketry.operators import blocks, numbers


def test_frames_are_looked_for_once(spark):
    body = "Post listing on May 1, 2020 at Rs. 10 per share it increased by 5% during the period May 2, 2020 to May 3, 2020 and closed at Rs. 12. The highest price of Rs. 20, which is 200% of the listing price, on May 4, 2020."
    pages = spark.createDataFrame([(1, "In the matter of X", 1, body), (2, None, 2, None), (3, "Y", 1, "listing increased highest price")], "doc int, title string, page int, body string")
    chunks = spark.createDataFrame([], "doc int, title string, page_start int, page_end int, body string")
    found = numbers.numeric_facts(pages, chunks)
    rows = found.collect()
    assert {(r.doc, r.fact_type, r.value, r.context) for r in rows} == {
        (1, "listing_price", 10.0, "listed on May 1, 2020"), (1, "percentage_change", 5.0, "May 2, 2020 to May 3, 2020"), (1, "closing_price", 12.0, "on May 3, 2020"),
        (1, "highest_price", 20.0, "on May 4, 2020"), (1, "percentage_change_from_listing", 200.0, "highest price on May 4, 2020"),
    }
    alone = pages.select(F.explode(numbers.page_facts(F.col("body"), numbers.subject_of(F.col("title")))).alias("f")).select("f.*").collect()
    assert sorted(map(str, alone)) == sorted(str(r) for r in found.drop("doc", "page_start", "page_end").collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(said#") == len(numbers.GROUPS)


def test_pages_are_read_one_at_a_time(spark):
    def peak(pages):
        tracemalloc.start()
        held = sorted(tracemalloc.get_traced_memory()[0] for _ in pages)
        tracemalloc.stop()
        yield len(held), "", held[len(held) // 2]

    pages = spark.range(900).select(F.lit("a").alias("doc"), F.col("id").cast("int").alias("page"), F.repeat(F.lit("x"), 50_000).alias("body"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 300)
    try:
        (row,) = blocks._streamed(pages, peak, "doc string, n int, body string, top long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # a batch has 15 MB; its pages all at once would be 15 MB more
    assert row.n == 900 and row.top < 22 << 20


def test_facts_are_not_dealt(spark):
    """The texts are, so that equal facts meet: of a page that comes twice, or in two texts, each fact stays once."""
    pages = spark.createDataFrame([(1, "X", 1, "a low price of Rs. 5 on May 1, 2020"), (1, "X", 1, "its low price of Rs. 5 on May 1, 2020 was\n  seen"), (1, "X", 2, "a low price of Rs. 5 on May 1, 2020")], "doc int, title string, page int, body string")
    chunks = spark.createDataFrame([(1, "X", 2, 3, "A fine and fee of Rs. 2 crore. No penalty."), (1, "X", 2, 3, "A fine and fee of Rs. 2 crore.")], "doc int, title string, page_start int, page_end int, body string")
    found = numbers.numeric_facts(pages, chunks)
    got = sorted((r.fact_type, r.value, r.unit, r.page_start) for r in found.collect())
    assert got == [("fee_amount", 2e7, "INR_crore", 2), ("lowest_price", 5.0, "INR", 1), ("lowest_price", 5.0, "INR", 2), ("penalty_amount", 2e7, "INR_crore", 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("== Initial Plan ==") :] if "== Initial Plan ==" in plan else plan
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 2 and all("fact_type" not in line for line in moved)
    # the text is marked once: its condition is on the sentence as it is
    assert "Filter RLIKE" in plan and "Filter Contains" not in plan
