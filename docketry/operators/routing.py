"""Rules that classify questions, as cascades over a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Routes by the first rule that holds.
ROUTES = (("greeting", r"^\s*(hi|hello|hey|thanks)\b"), ("corpus_stats", r"\bhow many (orders|documents)\b"), ("directory", r"\b(chairman|director|office|phone|email|address)\b"), ("current_news", r"\b(latest|today|news)\b"), ("exact_lookup", r"\b(order|matter) (of|in)\b"))


def cascade(c: Column, rules, default: str) -> Column:
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(F.lower(c).rlike(pattern), name).otherwise(out)
    return out


def route(c: Column) -> Column:
    return cascade(c, ROUTES, "hierarchical_search")


#: What a question's signals lead to: the plan, its reason, and the condition on the signals; the first that holds counts.
PLANS = (
    ("abstain", "empty_query", "empty"), ("general_knowledge", "smalltalk", "smalltalk"), ("current_news", "current_news_lookup", "current_news"), ("order_metadata", "corpus_metadata_first", "corpus_metadata"),
    ("order_metadata", "active_matter_metadata_follow_up", "active_override and metadata_asked"), ("structured_current_info", "structured_current_info", "structured_info"),
    ("official_web", "historical_official_lookup", "historical_official"), ("official_web", "official_public_fact", "current_official"), ("official_web", "company_role_current_fact", "company_role"),
    ("general_knowledge", "general_knowledge", "metadata_asked and explanatory and not matter_specific"), ("order_metadata", "exact_order_fact_metadata_first", "metadata_asked and (named_order or has_variants or session_scope)"),
    ("clarify", "missing_order_scope_for_metadata", "metadata_asked"), ("order_corpus_rag", "active_matter_corpus_follow_up", "active_override"), ("general_knowledge", "general_knowledge", "explanatory and not matter_specific"),
    ("order_corpus_rag", "named_matter_query", "matter_specific or named_order"), ("general_knowledge", "general_knowledge", "explanatory or other_person"), ("official_web", "live_public_fact", "live"), ("clarify", "ambiguous_query", "ambiguous"),
)
#: How a plan is carried out: the mode, the plan, and the condition.
MODES = (
    ("abstain", "abstain", "true"), ("clarify", "clarify", "true"), ("smalltalk", "general_knowledge", "smalltalk"), ("current_news_lookup", "current_news", "true"), ("structured_current_info", "structured_current_info", "true"),
    ("general_knowledge", "official_web", "company_role"), ("historical_official_lookup", "official_web", "historical_official"), ("current_official_lookup", "official_web", "true"), ("corpus_metadata", "order_metadata", "corpus_metadata"),
    ("memory_scoped_rag", "order_metadata", "active_override and session_scope"), ("hierarchical_rag", "order_metadata", "true"), ("memory_scoped_rag", "order_corpus_rag", "active_override and session_scope"),
    ("exact_lookup", "order_corpus_rag", "not comparison and (strict_scope or title_or_party or court_style or has_variants)"), ("hierarchical_rag", "order_corpus_rag", "true"),
)
#: What a question is called in logs.
LABELS = (
    ("smalltalk", "smalltalk"), ("current_news_lookup", "current_news"), ("historical_official_lookup", "historical_official"), ("corpus_metadata", "corpus_metadata"), ("structured_current_info", "structured_info"),
    ("follow_up", "active_override and session_scope"), ("general_knowledge", "company_role"), ("current_official_lookup", "current_official"), ("follow_up", "likely_follow_up and session_scope"), ("document_lookup", "title_or_party"),
    ("legal_explanation", "asks_provision"), ("general_knowledge", "explanatory"), ("substantive_outcome", "outcome or settlement"), ("matter_specific", "matter_specific"),
)
SIGNALS = ("empty", "smalltalk", "current_news", "corpus_metadata", "active_override", "metadata_asked", "structured_info", "historical_official", "current_official", "company_role", "explanatory", "matter_specific", "named_order", "has_variants", "session_scope", "other_person", "live", "ambiguous", "comparison", "strict_scope", "title_or_party", "court_style", "likely_follow_up", "asks_provision", "outcome", "settlement")


def first_holding(rules: list[tuple[Column, str]], default: str) -> Column:
    out = F.lit(default)
    for holds, name in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def planned(questions: DataFrame) -> DataFrame:
    """Adds plan, reason, mode and label to questions with SIGNALS as boolean columns; a null signal is false."""
    rows = questions.withColumns({s: F.coalesce(F.col(s), F.lit(False)) for s in SIGNALS})
    rows = rows.withColumns({"plan": first_holding([(F.expr(c), p) for p, _, c in PLANS], "general_knowledge"), "reason": first_holding([(F.expr(c), r) for _, r, c in PLANS], "general_knowledge_default")})
    modes = [((F.col("plan") == plan) & F.expr(c), mode) for mode, plan, c in MODES]
    return rows.withColumns({"mode": first_holding(modes, "general_knowledge"), "label": first_holding([(F.expr(c), name) for name, c in LABELS], "ambiguous")})
