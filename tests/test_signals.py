"""Signals, intents and plans of questions in words."""

import pytest
from pyspark.sql import functions as F

from docketry.operators import routing, signals

QUESTIONS = [
    ("Hello!", False, {"smalltalk"}, "general_knowledge"), ("", False, {"empty"}, "abstain"), (None, False, {"empty"}, "abstain"), ("Who signed the order?", True, {"metadata_asked", "active_override", "likely_follow_up"}, "order_metadata"),
    ("What is a settlement order?", False, {"explanatory"}, "general_knowledge"), ("How many orders are there in each bucket?", False, {"corpus_metadata"}, "order_metadata"), ("Latest news about markets", False, {"current_news", "live"}, "current_news"),
    ("Who is the CEO of Foo Limited", False, {"company_role"}, "official_web"), ("Who was the previous chairman", False, {"historical_official"}, "official_web"), ("Order in the matter of Foo", False, {"matter_specific", "title_or_party"}, "order_corpus_rag"),
    ("Foo vs Bar, appeal no 7 of 2019", False, {"matter_specific", "title_or_party", "court_style"}, "order_corpus_rag"), ("Compare both", False, {"comparison"}, None), ("Which sections were violated in this case?", True, {"metadata_asked", "active_override", "outcome"}, "order_metadata"),
    ("explain regulation 30", False, {"explanatory", "asks_provision"}, "general_knowledge"), ("what was the listing price of Foo in the matter of Foo", False, {"metadata_asked", "title_or_party"}, "clarify"), ("zebra", False, set(), "general_knowledge"),
    ("Who are the board members", False, {"structured_info"}, "structured_current_info"), ("what is the weather today", False, {"live", "explanatory"}, "general_knowledge"),
]


def test_flags_and_plans(spark):
    df = spark.createDataFrame([(k, q, s) for k, (q, s, _, _) in enumerate(QUESTIONS)], "id int, query string, session_scope boolean")
    rows = {r.id: r for r in routing.planned(signals.flags(df)).collect()}
    assert set(routing.SIGNALS) <= set(df.columns) | set(signals.flags(df).columns)
    for k, (query, _, wanted, plan) in enumerate(QUESTIONS):
        on = {s for s in routing.SIGNALS if rows[k][s]}
        assert wanted <= on, (query, wanted - on)
        assert plan is None or rows[k].plan == plan, (query, rows[k].plan, rows[k].reason, on)
        assert "smalltalk" not in on or query == "Hello!"


@pytest.mark.parametrize(("query", "names", "want", "focused"), [
    ("what is a settlement", [], "generic", False), ("what is the settlement of Foo", ["foo"], "substantive", True), ("explain the penalty", [], "substantive", False), ("terms of settlement", None, "substantive", True),
    ("Foo v. Bar", None, "party_or_title", False), ("appeal of Foo", None, "substantive", False), ("appeal no 5", None, "party_or_title", False), ("Insider trading rules", None, "regulation", False), ("hello", None, "generic", False), (None, None, "generic", False), ("outsettled unheld", None, "generic", False),
])
def test_intents(spark, query, names, want, focused):
    df = spark.createDataFrame([(query, names)], "q string, n array<string>")
    row = df.select(signals.intent(F.col("q"), F.col("n")).alias("i"), signals.settlement_focused(F.col("q"), F.col("n")).alias("f")).first()
    assert (row.i, row.f) == (want, focused)
