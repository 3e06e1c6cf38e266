"""Queries of evaluation runs: equal routes, failure buckets, summaries. Their cases are drawn from the numbers of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import failures, routing
from docketry.plans.catalog import query
from docketry.session import table

ROUTES = ["exact_lookup", "hierarchical_rag", "memory_scoped_rag", "direct_llm", "general_knowledge", "smalltalk", "structured_current_info", "current_official_lookup", "historical_official_lookup", "current_news_lookup", "corpus_metadata"]
#: Column, how far the event's mixed number is shifted, and what its rest picks.
PICKS = {
    "route_expected": (7, [*ROUTES, None]), "route_mode": (11, ROUTES), "answer_status": (17, ["answered", "abstained", "clarify"]), "allowed_routes": (5, [["smalltalk", "corpus_metadata"], None, [], ["direct_llm"]]),
    "expected_keys": (9, [[], ["a"], ["a", "b"], None]), "actual_keys": (12, [[], ["a"], ["b", "a"], None, ["a", "a"]]), "candidate_keys": (15, [None, ["a", "b", "c"], ["b"]]),
    "tags": (19, [["person_vs_trust"], ["company_role", "x"], ["settlement_amount"], ["wrong_answer_regression", ""], None]), "judge_modes": (23, [["current-fact-vs-order confusion"], [], None, []]),
    "numeric_accuracy": (22, [1.0, 0.5, None]), "expected_fact_count": (21, [0, 2, None]), "candidate_list_correctness": (24, [0.0, 1.0, None]), "answer_correctness": (25, [1.0, 0.5, None]),
    "faithfulness": (8, [0.0, 0.25, 0.5, 1.0, None]), "hallucination_rate": (10, [0.0, 0.5, 1.0]), "reasoning_quality": (16, [0.25, 0.75, None]), "passed": (13, [True, False, None]),
    "query": (14, ["What is the designation of X?", "Please CLARIFY this", "income of Y", "tell me more", None]), "issue_class": (18, ["regression", "open_ended", None]),
    "answer_text": (20, ["This is the Final Order.", "Other words", None]), "prompt_family": (6, ["lookup", "follow up", None]), "planned_route": (26, [*ROUTES, "", None]),
}
FLAGS = ["must_clarify", "must_abstain", "must_use_metadata", "must_use_active_matter", "must_use_structured_current_info", "must_use_official_web", "must_not_use_web", "general_explanatory", "matter_specific", "strict_scope", "strict_single", "candidate_list_used", "structured_info", "current_official", "historical_official", "current_news", "mixed_contamination", "hallucination_detected", "metadata_used", "abstain_correct", "active_order_override", "official_web_attempted", "general_web_attempted", "planner_used"]


def _sql(value, opening: str, closing: str) -> str:
    if isinstance(value, list):
        return opening + ", ".join(_sql(v, opening, closing) for v in value) + closing
    return "null" if value is None else f"'{value}'" if isinstance(value, str) else f"cast({value} as double)" if isinstance(value, float) else str(value).lower()


def _picked(k: int, values: list, opening: str, closing: str) -> str:
    cases = " ".join(f"when {i} then " + ("cast(array() as array<string>)" if v == [] and opening == "array(" else "cast([] as varchar[])" if v == [] else _sql(v, opening, closing)) for i, v in enumerate(values) if v is not None)
    return f"case (h >> {k}) % {len(values)} {cases} end"


def _columns(opening: str, closing: str) -> list[str]:
    flags = [f"case when (h >> {k % 14 + 3}) % 11 = 0 then null else (h >> {k + 4}) % 3 = 0 end as {name}" for k, name in enumerate(FLAGS)]
    return ["event_id as case_id", "((h >> 6) % 101) / 100.0 as confidence", *[f"{_picked(k, v, opening, closing)} as {n}" for n, (k, v) in PICKS.items()], *flags]


def run_cases(spark, d):
    """A case for each event; also null flags, empty and missing lists."""
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") * 2654435761).alias("h"))
    return rows.selectExpr(*_columns("array(", ")")).withColumn("confidence", F.col("confidence").cast("double"))


_CASES = "h as (select event_id, event_id * 2654435761 as h from events), c as (select " + ", ".join(_columns("[", "]")) + " from h)"
#: The rules once more, in SQL, with every name written out.
_ROUTED = _CASES + """,
k as (select *, coalesce(expected_keys, []) as ek, coalesce(actual_keys, []) as ak, coalesce(candidate_keys, []) as ck, coalesce(allowed_routes, []) as ar, coalesce(tags, []) as tg from c),
r as (select *, case when route_expected is null then null when route_mode = route_expected then 'strict_route_match'
 when route_expected in ('direct_llm', 'general_knowledge', 'smalltalk') and route_mode in ('direct_llm', 'general_knowledge', 'smalltalk') and general_explanatory is true and matter_specific is not true then 'general_explanatory_equivalent'
 when route_expected in ('exact_lookup', 'hierarchical_rag', 'memory_scoped_rag') and route_mode in ('exact_lookup', 'hierarchical_rag', 'memory_scoped_rag') and len(ek) > 0 and list_sort(list_distinct(ek)) = list_sort(list_distinct(ak)) and strict_scope is true then 'named_single_matter_equivalent'
 when answer_status = 'clarify' and candidate_list_used is true and strict_scope is true and strict_single is not true and len(ek) > 0 and list_has_all(ck, ek) then 'ambiguous_named_matter_clarify'
 when route_expected in ('structured_current_info', 'current_official_lookup', 'historical_official_lookup') and route_mode in ('structured_current_info', 'current_official_lookup', 'historical_official_lookup')
  and (must_use_structured_current_info is true or must_use_official_web is true or structured_info is true or current_official is true or historical_official is true) then 'current_info_equivalent'
 when route_expected in ('current_news_lookup', 'current_official_lookup') and route_mode in ('current_news_lookup', 'current_official_lookup') and current_news is true then 'latest_news_equivalent'
 when list_contains(ar, route_mode) then 'allowed_route_override' end as equivalent_route_reason,
 route_expected is null or route_mode = route_expected as strict_route_match from k),
q as (select *, strict_route_match or equivalent_route_reason is not null as equivalent_route_match from r)"""
_FAILED = _ROUTED + """,
b as (select *, list_filter([
 case when mixed_contamination is true or (hallucination_detected is true and len(ek) > 0) then 'contamination' end,
 case when must_clarify is true and answer_status <> 'clarify' then 'missing clarify' end,
 case when must_abstain is true and answer_status not in ('abstained', 'clarify') then 'missing abstain' end,
 case when not strict_route_match and not equivalent_route_match then 'wrong route' end,
 case when must_clarify is true and candidate_list_used is true and candidate_list_correctness = 0 then 'wrong candidate ranking' end,
 case when must_use_metadata is true and metadata_used is not true and not (must_abstain is true and abstain_correct is true and answer_status in ('abstained', 'clarify')) then 'weak metadata support' end,
 case when ((must_use_structured_current_info is true or must_use_official_web is true) and route_mode in ('hierarchical_rag', 'memory_scoped_rag', 'exact_lookup')) or list_contains(coalesce(judge_modes, []), 'current-fact-vs-order confusion') then 'current-fact-vs-order confusion' end,
 case when list_contains(tg, 'person_vs_trust') and numeric_accuracy < 1 then 'person-vs-trust confusion' end,
 case when contains(array_to_string(tg, ' '), 'settlement') and contains(lower(answer_text), 'final order') then 'settlement/final-order phrasing issue' end,
 case when expected_fact_count > 0 and numeric_accuracy < 1 then 'numeric fact extraction miss' end,
 case when must_use_active_matter is true and active_order_override is not true then 'stale session context leak' end,
 case when must_use_official_web is true and official_web_attempted is not true and route_mode not in ('current_official_lookup', 'historical_official_lookup', 'current_news_lookup') then 'weak official-web fallback' end,
 case when must_use_structured_current_info is true and route_mode <> 'structured_current_info' then 'structured-current-info mismatch' end,
 case when must_abstain is not true and must_clarify is not true and answer_status = 'abstained' then 'over-abstain' end,
 case when equivalent_route_match and not strict_route_match then 'stale expectation' end], lambda x: x is not null) as found from q),
f as (select *, case when len(found) > 0 then found when answer_correctness < 0.99 then ['wrong answer despite correct route'] else ['pass'] end as failure_buckets from b),
z as (select *, failure_buckets[1] as primary_failure_bucket, list_contains(failure_buckets, 'stale expectation') as stale_expectation,
 not list_contains(failure_buckets, 'stale expectation') and failure_buckets[1] <> 'pass' as true_bug from f)"""


def judged(spark, d):
    return failures.failure_modes(failures.route_metrics(run_cases(spark, d)))


@query(f"with {_ROUTED} select case_id, strict_route_match, equivalent_route_match, equivalent_route_reason from q")
def route_equivalence(spark, d):
    return failures.route_metrics(run_cases(spark, d)).select("case_id", "strict_route_match", "equivalent_route_match", "equivalent_route_reason")


@query(f"""with {_ROUTED}, w as (select *, official_web_attempted is true or general_web_attempted is true as web,
 official_web_attempted is true or route_mode in ('structured_current_info', 'current_official_lookup', 'historical_official_lookup') as official from q)
select case_id, case when planner_used is true and planned_route <> '' then planned_route = route_mode end as planner_choice_correct,
 case when must_not_use_web is true then not web when must_use_official_web is true then official end as internal_first_policy_correct,
 case when must_use_official_web is true then official when must_not_use_web is true then not web end as web_fallback_correct,
 case when must_use_active_matter is true then active_order_override is true and route_mode = 'memory_scoped_rag' end as active_matter_follow_up_correct,
 case when list_contains(tg, 'company_role') then route_mode in ('current_official_lookup', 'general_knowledge') end as company_role_routing_correct from w""")
def route_policies(spark, d):
    checks = ("planner_choice_correct", "internal_first_policy_correct", "web_fallback_correct", "active_matter_follow_up_correct", "company_role_routing_correct")
    return failures.policy_metrics(run_cases(spark, d)).select("case_id", *checks)


@query(f"with {_FAILED} select case_id, array_to_string(failure_buckets, '; ') as failure_buckets, primary_failure_bucket, stale_expectation, true_bug from z")
def failure_modes(spark, d):
    return judged(spark, d).select("case_id", F.array_join("failure_buckets", "; ").alias("failure_buckets"), "primary_failure_bucket", "stale_expectation", "true_bug")


@query(f"with {_FAILED} select primary_failure_bucket, count(*) as cases, count(*) filter (where stale_expectation) as stale_expectations, count(*) filter (where true_bug) as true_bugs from z group by 1")
def bug_queue(spark, d):
    return failures.bug_queue(judged(spark, d))


@query(f"""with {_FAILED}, t as (select *, lower(coalesce(query, '')) as lq, cast(confidence as double) as cf, cast(cast(passed as int) as double) as ps, cast(cast(equivalent_route_match as int) as double) as em from z),
bins as (select format('{{:.1f}}', floor(cf * 10 + 1e-9) / 10) as bin, count(*) as n, avg(cf) as a, avg(ps) as p from t group by 1)
select count(*) as total_cases, count(*) filter (where passed) as passed_cases, count(*) filter (where passed is not true) as failed_cases,
 coalesce(round(avg(cast(cast(strict_route_match as int) as double)), 4), 0) as strict_route_accuracy, coalesce(round(avg(em), 4), 0) as equivalent_route_accuracy,
 coalesce(round(avg(faithfulness), 4), 0) as faithfulness_average, coalesce(round(avg(hallucination_rate), 4), 0) as hallucination_rate,
 count(*) filter (where list_contains(failure_buckets, 'contamination')) as contamination_count,
 coalesce(round(avg(candidate_list_correctness) filter (where primary_failure_bucket = 'wrong candidate ranking' or contains(lq, 'clarif') or answer_status = 'clarify'), 4), 0) as candidate_list_correctness,
 coalesce(round(avg(numeric_accuracy) filter (where expected_fact_count > 0), 4), 0) as numeric_fact_accuracy,
 coalesce(round(avg(em) filter (where contains(lq, 'designation') or contains(lq, 'chairman') or contains(lq, 'income') or contains(lq, 'charge') or route_expected in ('structured_current_info', 'current_official_lookup', 'historical_official_lookup')), 4), 0) as structured_current_info_accuracy,
 coalesce(round(avg(em) filter (where route_expected in ('structured_current_info', 'current_official_lookup', 'historical_official_lookup', 'current_news_lookup')), 4), 0) as current_fact_routing_accuracy,
 count(*) filter (where passed and (issue_class = 'regression' or list_contains(tg, 'wrong_answer_regression'))) as wrong_answer_regression_pass_count,
 count(*) filter (where issue_class = 'regression' or list_contains(tg, 'wrong_answer_regression')) as wrong_answer_regression_total,
 count(*) filter (where stale_expectation) as stale_expectation_count, count(*) filter (where true_bug) as true_bug_count,
 coalesce(round(avg((cf - ps) ** 2), 4), 0) as confidence_brier, (select coalesce(round(sum(abs(p - a) * n) / sum(n), 4), 0) from bins) as confidence_ece from t""")
def evaluation_summary(spark, d):
    return failures.summary(judged(spark, d))


_MEAN = "round(avg(cast(cast({c} as int) as double)), 6) as {n}"


@query(f"with {_FAILED}, t as (select *, unnest(tg) as tag from z) select tag, count(*) as cases, {_MEAN.format(c='passed', n='pass_rate')}, {_MEAN.format(c='strict_route_match', n='strict_route_accuracy')}, {_MEAN.format(c='equivalent_route_match', n='equivalent_route_accuracy')}, round(avg(faithfulness), 6) as faithfulness_average, round(avg(numeric_accuracy), 6) as numeric_fact_accuracy from t where tag <> '' group by tag")
def run_by_tag(spark, d):
    return failures.by_tag(judged(spark, d))


@query(f"with {_FAILED} select route_expected, count(*) as cases, {_MEAN.format(c='passed', n='pass_rate')}, {_MEAN.format(c='strict_route_match', n='strict_route_accuracy')}, {_MEAN.format(c='equivalent_route_match', n='equivalent_route_accuracy')}, round(avg(hallucination_rate), 6) as hallucination_rate from z group by 1")
def run_by_route(spark, d):
    return failures.by_route(judged(spark, d))


@query(f"with {_CASES} select prompt_family, count(*) as cases, {_MEAN.format(c='passed', n='pass_rate')}, round(avg(faithfulness), 6) as faithfulness_average, round(avg(answer_correctness), 6) as answer_correctness, round(avg(reasoning_quality), 6) as reasoning_quality from c group by 1")
def run_by_family(spark, d):
    return failures.by_family(run_cases(spark, d))


@query(f"""with {_CASES}, t as (select *, floor(confidence * 10 + 1e-9) / 10 as low from c) select format('{{:.1f}}', low) || '-' || format('{{:.1f}}', least(low + 0.1, 1.0)) as bin, count(*) as cases, round(avg(cast(confidence as double)), 6) as mean_confidence,
{_MEAN.format(c='passed', n='precision')}, round(avg(case when answer_status in ('abstained', 'clarify') then 1.0 else 0.0 end), 6) as abstain_rate from t group by 1""")
def run_calibration(spark, d):
    return failures.calibration(run_cases(spark, d))


#: Signals of the questions, by the places of the events' mixed number.
_SIGNALS = ", ".join(f"case when (h >> {k + 2}) % 13 = 0 then null else (h >> {k + 3}) % 5 = 0 end as {name}" for k, name in enumerate(routing.SIGNALS))


@query(f"""with h as (select event_id, event_id * 2654435761 as h from events), s as (select event_id, {_SIGNALS} from h),
p as (select *, case when empty then 'abstain empty_query' when smalltalk then 'general_knowledge smalltalk' when current_news then 'current_news current_news_lookup' when corpus_metadata then 'order_metadata corpus_metadata_first'
 when active_override and metadata_asked then 'order_metadata active_matter_metadata_follow_up' when structured_info then 'structured_current_info structured_current_info' when historical_official then 'official_web historical_official_lookup'
 when current_official then 'official_web official_public_fact' when company_role then 'official_web company_role_current_fact' when metadata_asked and explanatory and matter_specific is not true then 'general_knowledge general_knowledge'
 when metadata_asked and (named_order or has_variants or session_scope) then 'order_metadata exact_order_fact_metadata_first' when metadata_asked then 'clarify missing_order_scope_for_metadata' when active_override then 'order_corpus_rag active_matter_corpus_follow_up'
 when explanatory and matter_specific is not true then 'general_knowledge general_knowledge' when matter_specific or named_order then 'order_corpus_rag named_matter_query' when explanatory or other_person then 'general_knowledge general_knowledge'
 when live then 'official_web live_public_fact' when ambiguous then 'clarify ambiguous_query' else 'general_knowledge general_knowledge_default' end as pr from s),
q as (select *, split_part(pr, ' ', 1) as plan, split_part(pr, ' ', 2) as reason from p)
select event_id, plan, reason, case plan when 'abstain' then 'abstain' when 'clarify' then 'clarify' when 'current_news' then 'current_news_lookup' when 'structured_current_info' then 'structured_current_info'
 when 'general_knowledge' then case when smalltalk then 'smalltalk' else 'general_knowledge' end
 when 'official_web' then case when company_role then 'general_knowledge' when historical_official then 'historical_official_lookup' else 'current_official_lookup' end
 when 'order_metadata' then case when corpus_metadata then 'corpus_metadata' when active_override and session_scope then 'memory_scoped_rag' else 'hierarchical_rag' end
 else case when active_override and session_scope then 'memory_scoped_rag' when comparison is not true and (strict_scope or title_or_party or court_style or has_variants) then 'exact_lookup' else 'hierarchical_rag' end end as mode,
 case when smalltalk then 'smalltalk' when current_news then 'current_news_lookup' when historical_official then 'historical_official_lookup' when corpus_metadata then 'corpus_metadata' when structured_info then 'structured_current_info' when active_override and session_scope then 'follow_up'
 when company_role then 'general_knowledge' when current_official then 'current_official_lookup' when likely_follow_up and session_scope then 'follow_up' when title_or_party then 'document_lookup' when asks_provision then 'legal_explanation' when explanatory then 'general_knowledge'
 when outcome or settlement then 'substantive_outcome' when matter_specific then 'matter_specific' else 'ambiguous' end as label from q""")
def route_plans(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") * 2654435761).alias("h")).selectExpr("event_id", *_SIGNALS.split(", "))
    return routing.planned(rows).select("event_id", "plan", "reason", "mode", "label")
