"""Routes that count as equal, failure buckets and the summary of an evaluation run.

A case is one row: what was expected (route_expected, allowed_routes, expected_keys, tags, must_* flags), what was done (route_mode,
answer_status, answer_text, actual_keys), metrics, and the run's signals as boolean columns. A null flag is false, a null array empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import scoring

#: Routes that may stand for each other.
MATTER_ROUTES = ("exact_lookup", "hierarchical_rag", "memory_scoped_rag")
GENERAL_ROUTES = ("direct_llm", "general_knowledge", "smalltalk")
CURRENT_ROUTES = ("structured_current_info", "current_official_lookup", "historical_official_lookup")
NEWS_ROUTES = ("current_news_lookup", "current_official_lookup")
#: Failure buckets, the most telling first.
BUCKETS = (
    "contamination", "missing clarify", "missing abstain", "wrong route", "wrong candidate ranking", "weak metadata support", "current-fact-vs-order confusion",
    "person-vs-trust confusion", "settlement/final-order phrasing issue", "numeric fact extraction miss", "stale session context leak", "weak official-web fallback",
    "structured-current-info mismatch", "over-abstain", "wrong answer despite correct route", "stale expectation",
)


def is_set(name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def items(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def either(name: str, routes: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(name).isin(*routes), F.lit(False))


def both_in(routes: tuple[str, ...]) -> Column:
    return either("route_expected", routes) & either("route_mode", routes)


def same_items(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def route_metrics(cases: DataFrame) -> DataFrame:
    """Adds strict_route_match, equivalent_route_match and equivalent_route_reason: the first rule that makes the routes equal.

    Signals: general_explanatory, matter_specific, strict_scope, strict_single, candidate_list_used, candidate_keys, structured_info,
    current_official, historical_official, current_news."""
    expected, wanted = F.col("route_expected"), items("expected_keys")
    strict = expected.isNull() | F.coalesce(F.col("route_mode") == expected, F.lit(False))
    has_keys = F.size(wanted) > 0
    asked_current = reduce(lambda a, b: a | b, map(is_set, ("must_use_structured_current_info", "must_use_official_web", "structured_info", "current_official", "historical_official")))
    rules = {
        "general_explanatory_equivalent": both_in(GENERAL_ROUTES) & is_set("general_explanatory") & ~is_set("matter_specific"),
        "named_single_matter_equivalent": both_in(MATTER_ROUTES) & has_keys & same_items(items("actual_keys"), wanted) & is_set("strict_scope"),
        "ambiguous_named_matter_clarify": F.coalesce(F.col("answer_status") == "clarify", F.lit(False)) & is_set("candidate_list_used") & is_set("strict_scope") & ~is_set("strict_single") & has_keys & (F.size(F.array_except(wanted, items("candidate_keys"))) == 0),
        "current_info_equivalent": both_in(CURRENT_ROUTES) & asked_current,
        "latest_news_equivalent": both_in(NEWS_ROUTES) & is_set("current_news"),
        "allowed_route_override": F.coalesce(F.array_contains(items("allowed_routes"), F.col("route_mode")), F.lit(False)),
    }
    reason = F.when(strict, F.when(expected.isNotNull(), "strict_route_match"))
    for name, holds in rules.items():
        reason = reason.when(holds, name)
    return cases.withColumns({"strict_route_match": strict, "equivalent_route_reason": reason, "equivalent_route_match": strict | reason.isNotNull()})


def policy_metrics(cases: DataFrame) -> DataFrame:
    """Adds whether planner, internal-first rule, web fallback, active matter and company role were right; null where they weren't asked for."""
    web = is_set("official_web_attempted") | is_set("general_web_attempted")
    official = is_set("official_web_attempted") | either("route_mode", CURRENT_ROUTES)
    none, official_asked = is_set("must_not_use_web"), is_set("must_use_official_web")
    planned = F.trim(F.coalesce("planned_route", F.lit("")))
    return cases.withColumns({
        "planner_choice_correct": F.when(is_set("planner_used") & (planned != ""), planned == F.col("route_mode")),
        "internal_first_policy_correct": F.when(none, ~web).when(official_asked, official),
        "web_fallback_correct": F.when(official_asked, official).when(none, ~web),
        "active_matter_follow_up_correct": F.when(is_set("must_use_active_matter"), is_set("active_order_override") & F.coalesce(F.col("route_mode") == "memory_scoped_rag", F.lit(False))),
        "company_role_routing_correct": F.when(F.array_contains(items("tags"), "company_role"), either("route_mode", ("current_official_lookup", "general_knowledge"))),
    })


def failure_modes(cases: DataFrame) -> DataFrame:
    """Adds failure_buckets, primary_failure_bucket, stale_expectation and true_bug to cases with route_metrics().

    Further columns: mixed_contamination, hallucination_detected, candidate_list_correctness, metadata_used, abstain_correct,
    numeric_accuracy, expected_fact_count, active_order_override, official_web_attempted, answer_correctness, judge_modes (array)."""
    status, tags = F.coalesce("answer_status", F.lit("")), items("tags")
    held_back = status.isin("abstained", "clarify")
    low = lambda name, bar: F.coalesce(F.col(name) < bar, F.lit(False))
    clarify, abstain, web = is_set("must_clarify"), is_set("must_abstain"), is_set("must_use_official_web")
    on_file = is_set("must_use_structured_current_info")
    confused = (on_file | web) & either("route_mode", MATTER_ROUTES)
    holds = {
        "contamination": is_set("mixed_contamination") | is_set("hallucination_detected") & (F.size(items("expected_keys")) > 0),
        "missing clarify": clarify & (status != "clarify"),
        "missing abstain": abstain & ~held_back,
        "wrong route": ~is_set("strict_route_match") & ~is_set("equivalent_route_match"),
        "wrong candidate ranking": clarify & is_set("candidate_list_used") & F.coalesce(F.col("candidate_list_correctness") == 0.0, F.lit(False)),
        "weak metadata support": is_set("must_use_metadata") & ~is_set("metadata_used") & ~(abstain & is_set("abstain_correct") & held_back),
        "current-fact-vs-order confusion": confused | F.array_contains(items("judge_modes"), "current-fact-vs-order confusion"),
        "person-vs-trust confusion": F.array_contains(tags, "person_vs_trust") & low("numeric_accuracy", 1.0),
        "settlement/final-order phrasing issue": F.array_join(tags, " ").contains("settlement") & F.lower(F.coalesce("answer_text", F.lit(""))).contains("final order"),
        "numeric fact extraction miss": F.coalesce(F.col("expected_fact_count") > 0, F.lit(False)) & low("numeric_accuracy", 1.0),
        "stale session context leak": is_set("must_use_active_matter") & ~is_set("active_order_override"),
        "weak official-web fallback": web & ~(is_set("official_web_attempted") | either("route_mode", ("current_official_lookup", "historical_official_lookup", "current_news_lookup"))),
        "structured-current-info mismatch": on_file & ~F.coalesce(F.col("route_mode") == "structured_current_info", F.lit(False)),
        "over-abstain": ~abstain & ~clarify & (status == "abstained"),
        "stale expectation": is_set("equivalent_route_match") & ~is_set("strict_route_match"),
    }
    # in the order of BUCKETS, where the wrong answer comes only by itself
    found = F.filter(F.array(*[F.when(holds[b], b) for b in BUCKETS if b in holds]), lambda x: x.isNotNull())
    alone = F.when(low("answer_correctness", 0.99), "wrong answer despite correct route").otherwise("pass")
    out = cases.withColumn("failure_buckets", F.when(F.size(found) > 0, found).otherwise(F.array(alone)))
    first = F.element_at("failure_buckets", 1)
    stale = F.array_contains("failure_buckets", "stale expectation")
    return out.withColumns({"primary_failure_bucket": first, "stale_expectation": stale, "true_bug": ~stale & (first != "pass")})


def candidate_list(cases: DataFrame) -> DataFrame:
    """Adds candidate_list_correctness: the share of the expected keys, or else buckets, among the candidates; without a list, whether none was due."""
    none = F.array().cast("array<string>")
    clean = lambda c: F.filter(F.transform(F.coalesce(F.col(c), none), lambda x: F.trim(x)), lambda x: x != "")
    share = lambda want, got: F.size(F.array_intersect(want, got)) / F.size(F.array_distinct(want))
    keys, buckets = items("expected_keys"), items("expected_buckets")
    found = F.when(F.size(keys) > 0, share(keys, clean("candidate_keys"))).when(F.size(buckets) > 0, share(buckets, clean("candidate_buckets"))).otherwise(1.0)
    return cases.withColumn("candidate_list_correctness", F.when(is_set("candidate_list_used"), found).otherwise(F.when(is_set("must_clarify"), 0.0).otherwise(1.0)))


def reasoning_by_length(answer: Column, issue_class: Column) -> Column:
    """reasoning, summary and open_ended quality of an answer that no judge has seen, by its number of words; null for an empty one."""
    said = F.trim(F.regexp_replace(F.coalesce(answer, F.lit("")), r"\s+", " "))
    words = F.size(F.split(said, " "))
    reasoning = F.when(F.coalesce(issue_class == "gold_fact", F.lit(False)), F.when(words >= 10, 0.8).otherwise(0.6)).otherwise(F.when(words >= 20, 0.7).otherwise(0.45))
    summary_quality = F.when(words.between(8, 180), 1.0).otherwise(0.7)
    return F.when(said != "", F.struct(reasoning.alias("reasoning"), summary_quality.alias("summary"), F.round((2 * reasoning + summary_quality) / 3, 4).alias("open_ended")))


def bug_queue(cases: DataFrame) -> DataFrame:
    """Cases, stale expectations and true bugs by primary bucket."""
    return cases.groupBy("primary_failure_bucket").agg(F.count("*").alias("cases"), F.count_if("stale_expectation").alias("stale_expectations"), F.count_if("true_bug").alias("true_bugs"))


def mean(value: Column, where: Column | None = None) -> Column:
    """The mean of the values that aren't null, to four places; 0 without any."""
    value = value.cast("double")
    return F.coalesce(F.round(F.avg(value if where is None else F.when(where, value)), 4), F.lit(0.0))


def count(where: Column) -> Column:
    return F.count_if(F.coalesce(where, F.lit(False)))


def summary(cases: DataFrame) -> DataFrame:
    """One row of the acceptance figures of a run; zeros for an empty one."""
    query, expected = F.lower(F.coalesce("query", F.lit(""))), F.col("route_expected")
    primary, tags = F.coalesce("primary_failure_bucket", F.lit("")), items("tags")
    ranked = (primary == "wrong candidate ranking") | query.contains("clarif") | F.coalesce(F.col("answer_status") == "clarify", F.lit(False))
    structured = query.rlike("designation|chairman|income|charge") | either("route_expected", CURRENT_ROUTES)
    current = either("route_expected", (*CURRENT_ROUTES, "current_news_lookup"))
    regression = F.coalesce(F.col("issue_class") == "regression", F.lit(False)) | F.array_contains(tags, "wrong_answer_regression")
    confidence, passed = F.col("confidence").cast("double"), F.col("passed").cast("double")
    rows = cases.agg(
        F.count("*").alias("total_cases"),
        count(F.col("passed")).alias("passed_cases"),
        (F.count("*") - count(F.col("passed"))).alias("failed_cases"),
        mean(F.col("strict_route_match")).alias("strict_route_accuracy"),
        mean(F.col("equivalent_route_match")).alias("equivalent_route_accuracy"),
        mean(F.col("faithfulness")).alias("faithfulness_average"),
        mean(F.col("hallucination_rate")).alias("hallucination_rate"),
        count((primary == "contamination") | F.array_contains(items("failure_buckets"), "contamination")).alias("contamination_count"),
        mean(F.col("candidate_list_correctness"), ranked).alias("candidate_list_correctness"),
        mean(F.col("numeric_accuracy"), F.col("expected_fact_count") > 0).alias("numeric_fact_accuracy"),
        mean(F.col("equivalent_route_match"), structured).alias("structured_current_info_accuracy"),
        mean(F.col("equivalent_route_match"), current).alias("current_fact_routing_accuracy"),
        count(regression & is_set("passed")).alias("wrong_answer_regression_pass_count"),
        count(regression).alias("wrong_answer_regression_total"),
        count(F.col("stale_expectation")).alias("stale_expectation_count"),
        count(F.col("true_bug")).alias("true_bug_count"),
        F.coalesce(F.round(F.avg(F.pow(confidence - passed, F.lit(2.0))), 4), F.lit(0.0)).alias("confidence_brier"),
    )
    bins = cases.groupBy(scoring.bin_label(confidence).alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(passed).alias("p"))
    ece = bins.agg(F.coalesce(F.round(F.sum(F.abs(F.col("p") - F.col("c")) * F.col("n")) / F.sum("n"), 4), F.lit(0.0)).alias("confidence_ece"))
    return rows.crossJoin(ece)  # one row each


def by_group(cases: DataFrame, key: str, metrics: dict[str, str]) -> DataFrame:
    """cases and the mean of each column of metrics (column to name) for each value of key; a null key is a group of its own."""
    return cases.groupBy(key).agg(F.count("case_id").alias("cases"), *[F.round(F.avg(F.col(c).cast("double")), 6).alias(name) for c, name in metrics.items()])


#: Column and name of the means by tag, by expected route and by prompt family.
TAG_METRICS = {"passed": "pass_rate", "strict_route_match": "strict_route_accuracy", "equivalent_route_match": "equivalent_route_accuracy", "faithfulness": "faithfulness_average", "numeric_accuracy": "numeric_fact_accuracy"}
ROUTE_METRICS = {"passed": "pass_rate", "strict_route_match": "strict_route_accuracy", "equivalent_route_match": "equivalent_route_accuracy", "hallucination_rate": "hallucination_rate"}
FAMILY_METRICS = {"passed": "pass_rate", "faithfulness": "faithfulness_average", "answer_correctness": "answer_correctness", "reasoning_quality": "reasoning_quality"}


def by_tag(cases: DataFrame) -> DataFrame:
    rows = cases.withColumn("tag", F.explode("tags")).where("tag is not null and tag <> ''")
    return by_group(rows, "tag", TAG_METRICS)


def by_route(cases: DataFrame) -> DataFrame:
    return by_group(cases, "route_expected", ROUTE_METRICS)


def by_family(cases: DataFrame) -> DataFrame:
    return by_group(cases, "prompt_family", FAMILY_METRICS)


def calibration(cases: DataFrame) -> DataFrame:
    """Cases, mean confidence, precision and the share held back for each bin of a tenth."""
    held_back = F.coalesce(F.col("answer_status").isin("abstained", "clarify"), F.lit(False))
    means = {"mean_confidence": F.col("confidence"), "precision": F.col("passed").cast("double"), "abstain_rate": held_back.cast("double")}
    return cases.groupBy(scoring.bin_label(F.col("confidence")).alias("bin")).agg(F.count("*").alias("cases"), *[F.round(F.avg(v), 6).alias(k) for k, v in means.items()])
