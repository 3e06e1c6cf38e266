"""Column functions of retrieval scoring. Constants are fixed values of the scoring model."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K, LEXICAL, VECTOR, PARENT = 60, 1.0, 1.15, 0.15
SECTION_PRIORS = {
    "operative_order": 1.35, "directions": 1.30, "findings": 1.25, "issues": 1.15, "reply_or_submissions": 1.05, "background": 1.00,
    "facts": 1.00, "show_cause_notice": 0.98, "other": 0.92, "table_block": 0.90, "annexure": 0.88, "header": 0.70,
}
#: What the intent of a query makes of a section's type.
INTENT_SECTION = {
    "substantive": {
        "operative_order": 1.20, "directions": 1.18, "findings": 1.15, "issues": 1.08, "reply_or_submissions": 1.03, "background": 0.98,
        "facts": 0.98, "show_cause_notice": 0.96, "other": 0.92, "table_block": 0.92, "annexure": 0.90, "header": 0.75,
    },
    "party_or_title": {
        "operative_order": 0.94, "directions": 0.94, "findings": 0.95, "issues": 0.96, "reply_or_submissions": 0.98, "background": 1.00,
        "facts": 1.00, "show_cause_notice": 0.98, "other": 1.05, "table_block": 0.95, "annexure": 0.94, "header": 2.00,
    },
    "regulation": {
        "operative_order": 1.00, "directions": 0.98, "findings": 1.06, "issues": 1.10, "reply_or_submissions": 1.02, "background": 1.04,
        "facts": 1.04, "show_cause_notice": 1.01, "other": 1.00, "table_block": 0.92, "annexure": 0.95, "header": 0.94,
    },
}
#: The order in which comparisons show sections; others come last.
COMPARED = {"operative_order": 0, "directions": 1, "findings": 2, "facts": 3, "background": 4, "issues": 5, "reply_or_submissions": 6, "table_block": 7, "annexure": 8, "other": 9, "header": 10}
SETTLEMENT, LOCKED, UNLOCKED, CONFUSION = 1.12, 1.45, 0.62, 0.08
#: Types of sections that outrank a header, and types that aren't substantive.
STRONG, WEAK = ("operative_order", "findings", "directions"), ("header", "other", "table_block", "annexure")
#: How far above a strong section a header is put below it, and where; the share of a header's score from which a substantive hit is lifted.
HEADER_ABOVE, HEADER_BELOW, COMPETITIVE = 1.25, 0.995, 0.93


def lookup(table: dict, key: Column, default: float) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def reciprocal(rank: Column, weight: float = 1.0, k: int = RRF_K) -> Column:
    return F.coalesce(F.lit(weight) / (F.lit(k) + rank), F.lit(0.0))


def fused(lexical_rank: Column, vector_rank: Column, parent: Column | None = None) -> Column:
    out = reciprocal(lexical_rank, LEXICAL) + reciprocal(vector_rank, VECTOR)
    return out if parent is None else out + PARENT * F.greatest(F.coalesce(parent, F.lit(0.0)), F.lit(0.0))


def section_prior(section: Column) -> Column:
    return lookup(SECTION_PRIORS, section, 1.0)


def intent_factor(intent: Column, section: Column) -> Column:
    out = F.lit(1.0)
    for name, row in INTENT_SECTION.items():
        out = F.when(intent == name, lookup(row, section, 1.0)).otherwise(out)
    return out


def comparison_priority(section: Column) -> Column:
    return lookup(COMPARED, F.lower(F.trim(F.coalesce(section, F.lit("")))), len(COMPARED))


def lock_factor(record_key: Column, locked: list) -> Column:
    return F.when(record_key.isin(locked), LOCKED).otherwise(UNLOCKED) if locked else F.lit(1.0)


#: Phrases of settlement texts, of their headings, and of chunks that are only a header.
BODY_TERMS = ("settlement amount", "settled on the following terms", "terms proposed by the applicant", "notice of demand", "remittance of the aforesaid amount", "remitted the said settlement amount", "credit of the same", "credit of said amount", "it is hereby ordered", "no enforcement action", "proceedings that may be initiated", "settlement proceedings")
HEADING_TERMS = ("settlement order", "terms of settlement", "settlement proceedings", "settlement application")
HEADING_BODY = ("it is hereby ordered", "settlement amount", "notice of demand", "remitted")
HEADER_MARKERS = ("securities and exchange board of india", "settlement order", "in respect of", "in the matter of")


def alignment_factor(title: Column, focused: Column, terms: Column) -> Column:
    """How many of the names a settlement question has stand in the title; 1 for other questions and those with fewer than two."""
    own = F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")
    asked = F.coalesce(F.array_distinct(terms), F.array().cast("array<string>"))
    shared = F.size(F.array_intersect(asked, own))
    factor = F.when(shared >= F.greatest(F.lit(2), F.size(asked)), 1.18).when(shared >= 2, 1.12).when(shared == 1, 1.06).otherwise(0.96)
    return F.when(F.coalesce(focused, F.lit(False)) & (F.size(asked) >= 2) & (F.size(own) > 0), factor).otherwise(1.0)


def content_factor(body: Column, headings: Column, section: Column, focused: Column, chunk: bool) -> Column:
    """For settlement questions: body texts gain 1.10 (sections 1.04), chunks that are only a header lose (0.72)."""
    low = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    said, above = low(body), low(headings)
    words = F.when(said == "", 0).otherwise(F.size(F.split(said, " ")))
    count = lambda c, terms: sum((c.contains(t).cast("int") for t in terms), F.lit(0))
    full = (words >= 30) & ((count(said, BODY_TERMS) > 0) | (count(above, HEADING_TERMS) > 0) & (count(said, HEADING_BODY) > 0))
    bare = F.lit(chunk) & section.isin("header", "operative_order") & (words > 0) & (words <= 28) & (count(said, HEADER_MARKERS) >= 2) & ~said.rlike("[.:] |;")
    return F.when(~F.coalesce(focused, F.lit(False)), 1.0).when(F.coalesce(bare, F.lit(False)), 0.72).when(full, 1.10 if chunk else 1.04).otherwise(1.0)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def confidence(top: Column, second: Column, substantive: Column, agreement: Column, strict: Column, settlement: Column) -> Column:
    """The weighted sum of seven signals, clamped."""
    return clamp(0.35 * clamp(top / 0.08) + 0.15 * clamp((top - second) / 0.02) + 0.20 * substantive + 0.15 * agreement + 0.15 * strict + 0.05 * settlement + 0.05)


def answer_status(score: Column, threshold: float = 0.35) -> Column:
    return F.when(score < 0.75 * threshold, "abstain").when(score < threshold, "hedge").otherwise("answer")


def bin_label(c: Column) -> Column:
    """0.1 bins; 1.0 has its own."""
    low = F.floor(clamp(c) * 10 + 1e-9) / 10
    return F.concat(F.format_string("%.1f", low), F.lit("-"), F.format_string("%.1f", F.least(low + 0.1, F.lit(1.0))))
