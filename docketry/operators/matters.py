"""Stored matters: scopes and locks, joins of chunks to their documents, answers from metadata, session state, checks of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text
from docketry.operators.failures import count, is_set, items, mean
from docketry.operators.relational import sharing


def locked_scope(scope: dict, lock: dict | None) -> dict:
    """The filter of a search under a lock. scope: record_key, bucket_name, document_ids, section_keys, section_types; lock: single, comparison,
    record_keys, document_ids. One locked matter replaces keys and documents; a comparison takes its two first documents, if it has two."""
    if not lock:
        return scope
    pinned = list(dict.fromkeys(lock.get("document_ids") or []))[:2]
    if lock.get("comparison") and not lock.get("single") and len(pinned) == 2:
        return scope | {"record_key": None, "document_ids": pinned, "section_keys": []}
    if lock.get("single") and lock.get("record_keys"):
        return scope | {"record_key": lock["record_keys"][0], "document_ids": [], "section_keys": []}
    return scope


def child_scope(children: DataFrame, documents: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """The children (query_id is added) of each query's document hits and, where a query has section hits, of those sections. documents: query_id, document;
    sections: query_id, section_key; children: document, section_key."""
    rows = children.join(documents.select("query_id", "document").distinct(), "document")
    if sections is None:
        return rows
    keys = sections.select("query_id", "section_key").distinct()
    some = keys.select("query_id").distinct().withColumn("__some", F.lit(True))
    kept = rows.join(some, "query_id", "left").join(keys.withColumn("__in", F.lit(True)), ["query_id", "section_key"], "left")
    return kept.where("__some is null or __in").drop("__some", "__in")


def within_lock(hits: DataFrame, record: str, locked: list[str]) -> DataFrame:
    """The hits on locked records; all without a lock."""
    return hits.where(F.col(record).isin(locked)) if locked else hits


def in_chunk_order(hits: DataFrame, by: str) -> DataFrame:
    """rank by final, lexical and vector score, each the greatest first and null last, then by document and chunk."""
    order = [F.desc_nulls_last(c) for c in ("final", "lexical", "vector")] + [F.col("document"), F.col("chunk")]
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def chain(chunks: DataFrame, versions: DataFrame, documents: DataFrame, version_id: str, document_id: str) -> DataFrame:
    """Chunks with their version's and document's columns; chunks without either go."""
    return chunks.join(versions, version_id).join(documents, document_id)


def missing_facts(versions: DataFrame, metadata: DataFrame, provisions: DataFrame, numbers: DataFrame, version_id: str, every: bool = False) -> DataFrame:
    """Versions that lack metadata, provisions or numeric facts (or all, with ``every``), with a flag for each."""
    out = versions
    for name, rows in (("has_metadata", metadata), ("has_provisions", provisions), ("has_numbers", numbers)):
        out = out.join(rows.select(version_id).distinct().withColumn(name, F.lit(True)), version_id, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    has = [F.col(c) for c in ("has_metadata", "has_provisions", "has_numbers")]
    return out if every else out.where(~(has[0] & has[1] & has[2]))


def dated(versions: DataFrame, metadata: DataFrame, version_id: str) -> DataFrame:
    """Every version with the order date of its metadata, or its own; metadata: version_id, order_date as meta_date."""
    return versions.join(metadata, version_id, "left").withColumn("order_date", F.coalesce("meta_date", "order_date")).drop("meta_date")


def best_metadata(asked: DataFrame, metadata: DataFrame, usable: Column) -> DataFrame:
    """For each query the usable row of its versions with the greatest confidence, ties by version. asked: query_id, version; metadata: version, confidence, …"""
    rank = F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("version"))
    rows = asked.join(metadata.where(usable), "version")
    return rows.groupBy("query_id").agg(F.max_by(F.struct(*metadata.columns), rank).alias("m")).select("query_id", "m.*")


def signatory_answers(asked: DataFrame, metadata: DataFrame) -> DataFrame:
    """query_id, version and a sentence that says who signed; metadata: version, confidence, name, designation, order_date, place."""
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rows = best_metadata(asked, metadata, said("name") | said("designation"))
    who = F.when(said("name") & said("designation"), F.concat(F.lit("The order was signed by "), "name", F.lit(", "), "designation", F.lit(".")))
    who = who.when(said("name"), F.concat(F.lit("The extracted signatory for the order is "), "name", F.lit("."))).otherwise(F.concat(F.lit("The extracted signatory designation for the order is "), "designation", F.lit(".")))
    more = F.concat_ws("; ", F.concat(F.lit("date: "), F.date_format("order_date", "yyyy-MM-dd")), F.when(said("place"), F.concat(F.lit("place: "), "place")))
    return rows.select("query_id", "version", F.when(more == "", who).otherwise(F.concat(F.regexp_replace(who, r"\.+$", ""), F.lit("; "), more, F.lit("."))).alias("answer"))


def date_answers(asked: DataFrame, metadata: DataFrame) -> DataFrame:
    rows = best_metadata(asked, metadata, F.col("order_date").isNotNull())
    return rows.select("query_id", "version", F.concat(F.lit("The order date recorded for this matter is "), F.date_format("order_date", "yyyy-MM-dd"), F.lit(".")).alias("answer"))


def filter_people(people: DataFrame, department: Column | None = None, group: Column | None = None, title: Column | None = None) -> DataFrame:
    """People of a department (by name, alias or office) and of a group, or where the query names no group with that title."""
    key = lambda c: text.lookup_key(F.coalesce(c, F.lit("")))
    out = people
    if department is not None:
        asked = key(department)
        named = F.exists(F.coalesce("department_aliases", F.array().cast("array<string>")), lambda a: key(a) == asked)
        out = out.where((asked != "") & (named | (key(F.col("department_name")) == asked) | (key(F.col("office_name")) == asked)))
    if group is not None:
        wanted = F.col("designation_group") == group
        out = out.where(F.when(group.isNotNull(), wanted).otherwise((key(title) != "") & (key(F.col("designation")) == key(title))) if title is not None else wanted)
    return out


def staff_lookup(asked: DataFrame, raw: DataFrame, people: DataFrame) -> DataFrame:
    """query_id and person_id of who has a staff number, by the person's own number or by a merged raw row with it. asked: query_id, staff_no;
    raw: staff_no, row_key; people: person_id, staff_no, row_keys (array)."""
    number = lambda c: F.nullif(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]", ""), F.lit(""))
    q = asked.select("query_id", number("staff_no").alias("__key"))
    rows = raw.select("row_key", number("staff_no").alias("__key")).where("__key is not null").distinct()
    merged = people.select("person_id", F.explode("row_keys").alias("row_key")).join(rows, "row_key").select("person_id", "__key")
    # the numbers of each person, by whichever way: pairs are made from them once
    numbers = people.select("person_id", number("staff_no").alias("__key")).unionByName(merged)
    return sharing(q, numbers, "query_id", "person_id")


def session_state(context: DataFrame, order: str = "turn") -> DataFrame:
    """For each session what its last grounded turn was about: documents, records and titles of the cited chunks, each once in order, the first title, and the chunk ids.

    context: session_id, turn, place, chunk_id, document_id, record_key, title, cited. Turns without a citation leave the state as it was."""
    grounded = context.groupBy("session_id", order).agg(F.max(F.col("cited").cast("int")).alias("any")).where("any = 1").groupBy("session_id").agg(F.max(order).alias(order))
    rows = context.join(grounded, ["session_id", order])
    listed = lambda c, where: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("place", F.col(c).alias("v"))))), lambda x: x["v"]))
    cited = F.col("cited")
    out = rows.groupBy("session_id", order).agg(*[listed(c, cited).alias(n) for c, n in (("document_id", "document_ids"), ("record_key", "record_keys"), ("title", "titles"), ("chunk_id", "cited_chunk_ids"))], listed("chunk_id", F.lit(True)).alias("chunk_ids"))
    return out.withColumn("primary_title", F.get("titles", F.lit(0)))


def best_over_variants(hits: DataFrame, k: int) -> DataFrame:
    """query_id, unit and score: the best score of each unit over the variants of a query, the k best units, ties by unit."""
    rows = hits.groupBy("query_id", "unit").agg(F.max("score").alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "unit"))).where(F.col("rank") <= k)


def case_errors(cases: DataFrame) -> DataFrame:
    """Adds errors: what is wrong with a case. Columns: case_id, query, flags, route_expected, allowed_routes, issue_class, expected_keys, facts (array of type, number, said)."""
    name = F.coalesce(F.col("case_id").cast("string"), F.lit(""))
    said = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    error = lambda test, what: F.when(test, F.concat(name, F.lit(f": {what}")))
    routes = items("allowed_routes")
    red = is_set("must_clarify") & (F.size(items("expected_keys")) > 0) & F.coalesce(F.col("issue_class") == "redteam", F.lit(False))
    first = [
        F.when(~said(name), F.lit("case_id is required")), error(~said(F.col("query")), "query is required"), error(is_set("must_abstain") & is_set("must_clarify"), "cannot require both abstain and clarify"),
        error(is_set("must_use_official_web") & is_set("must_not_use_web"), "cannot require and forbid web usage"),
        error(said(F.col("route_expected")) & (F.size(routes) > 0) & ~F.array_contains(routes, F.coalesce("route_expected", F.lit(""))), "route_expected must be one of the allowed routes"),
    ]
    each = F.flatten(F.transform("facts", lambda f: F.array_compact(F.array(F.when(~said(f["type"]), "fact without a type"), F.when(f["number"].isNull() & ~said(f["said"]), "fact without a value")))))
    facts = F.when(F.col("facts").isNotNull() & ~red, F.transform(each, lambda w: F.concat(name, F.lit(": "), w))).otherwise(F.array().cast("array<string>"))
    return cases.withColumn("errors", F.concat(F.array_compact(F.array(*first)), facts))


def prompt_family(cases: DataFrame) -> DataFrame:
    """Adds prompt_family: the first rule that holds. Columns: answer_status, route_mode, metadata_used, asks_explanation, court_style, tags, expected_buckets."""
    settled = F.lower(F.concat_ws(" ", F.array_join(items("tags"), " "), F.array_join(items("expected_buckets"), " "))).contains("settlement")
    family = F.when(F.col("answer_status") == "clarify", "clarify").when(F.col("route_mode") == "structured_current_info", "structured current-info")
    family = family.when(is_set("metadata_used") & is_set("asks_explanation"), "explain provision").when(is_set("metadata_used"), "metadata-first fact")
    family = family.when(F.col("route_mode").isin("current_official_lookup", "historical_official_lookup", "current_news_lookup"), "current fact")
    family = family.when(is_set("court_style"), "SAT/court summary").when(settled, "settlement-shaped answer").otherwise("brief summary")
    return cases.withColumn("prompt_family", family)


def control_summary(results: DataFrame) -> DataFrame:
    """One row of the control pack's figures; a share without cases is 1. Columns: passed, answer_status, route_expected, route_mode, equivalent_route,
    expected_key, case_kind, single_matter_respected, request_failed, web_used, candidate_list_used."""
    share = lambda test, of: F.coalesce(F.round(F.avg(F.when(of, test.cast("double"))), 4), F.lit(1.0))
    status, routed = F.coalesce("answer_status", F.lit("")), F.coalesce("route_expected", F.lit("")) != ""
    same = F.coalesce(F.col("route_mode") == F.col("route_expected"), F.lit(False))
    strict = (F.coalesce("expected_key", F.lit("")) != "") & F.coalesce(F.col("case_kind").isin("eval_query", "wrong_answer_regression"), F.lit(False))
    respected = is_set("single_matter_respected")
    return results.agg(
        F.count("*").alias("total_cases"), count(F.col("passed")).alias("passed_cases"), count(status.isin("answered", "cautious")).alias("answered_count"), count(status == "clarify").alias("clarify_count"), count(status == "abstained").alias("abstain_count"),
        share(same, routed).alias("route_accuracy"), share(same | is_set("equivalent_route"), routed).alias("route_accuracy_equivalent"), share(respected, strict).alias("single_matter_accuracy"),
        share(F.col("route_mode") == "structured_current_info", F.coalesce(F.col("route_expected") == "structured_current_info", F.lit(False))).alias("structured_current_info_accuracy"),
        count(~respected).alias("mixed_record_failures"), count(is_set("request_failed")).alias("request_failures"), count(is_set("web_used")).alias("web_uses"), count(is_set("candidate_list_used")).alias("candidate_lists"), mean(F.col("passed")).alias("pass_rate"),
    )


def triage_counts(results: DataFrame) -> DataFrame:
    """Failed and stale results by triage bucket."""
    rows = results.where(~is_set("passed") | is_set("stale_expectation"))
    return rows.groupBy(F.coalesce(F.nullif("triage_bucket", F.lit("")), F.lit("unclassified")).alias("triage_bucket")).agg(F.count("*").alias("n"))


def annotated(cases: DataFrame, index: DataFrame, dump: DataFrame) -> DataFrame:
    """Cases with what the document index has on their first expected key and what a failure dump has on their query. cases: query, expected_keys;
    index: record_key, …; dump: query, …; the index has a key once, and of a query's dumped rows the first by bucket counts."""
    key = F.get(items("expected_keys"), F.lit(0))
    first = dump.groupBy(F.lower(F.trim("query")).alias("__q")).agg(F.min("bucket").alias("dumped_bucket"))
    rows = cases.withColumns({"record_key": key, "__q": F.lower(F.trim("query"))})
    return rows.join(index, "record_key", "left").join(first, "__q", "left").drop("__q")


def current_rows(documents: DataFrame, versions: DataFrame, nodes: DataFrame, document_id: str, version_id: str) -> DataFrame:
    """Every document with its current version (current_id) and that version's node, where there are any."""
    return documents.join(versions, F.col("current_id") == versions[version_id], "left").join(nodes.withColumnRenamed(version_id, "__v"), F.col("__v") == F.col(version_id), "left").drop("__v")


def alias_rows(titles: DataFrame) -> DataFrame:
    """entity, its variants and the keys and titles of the records that name it, sorted. titles: record_key, title, entities (array), variants (array)."""
    rows = titles.select("record_key", "title", "variants", F.explode("entities").alias("entity")).where("trim(entity) <> ''")
    sets = rows.groupBy("entity").agg(F.array_sort(F.collect_set("record_key")).alias("record_keys"), F.array_sort(F.collect_set("title")).alias("titles"))
    variants = rows.select("entity", F.explode_outer("variants").alias("v")).where("v is not null").groupBy("entity").agg(F.array_sort(F.collect_set("v")).alias("variants"))
    return sets.join(variants, "entity", "left").withColumn("variants", F.coalesce("variants", F.array().cast("array<string>")))


def same_city(offices: DataFrame, city: Column) -> DataFrame:
    asked = text.lookup_key(F.coalesce(city, F.lit("")))
    return offices.where((asked != "") & (text.lookup_key(F.coalesce("city", F.lit(""))) == asked))


def memory_scope(states: DataFrame, versions: DataFrame) -> DataFrame:
    """session_id and version: what a session's state names, or else the current versions of its records and documents. states: session_id,
    version_ids, record_keys, document_ids (arrays); versions: version, record_key, document_id, current."""
    key = lambda kind, c: F.concat(F.lit(kind), F.coalesce(c.cast("string"), F.lit("")) if kind == "v" else c.cast("string"))
    keys = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<long>")), lambda x: key(kind, x))
    wanted = F.when(F.size("version_ids") > 0, keys("v", F.col("version_ids"))).otherwise(F.concat(keys("r", F.col("record_keys")), keys("d", F.col("document_ids"))))
    named = states.select(F.explode("version_ids").alias("version")).distinct().select("version", key("v", F.col("version")).alias("__key"))
    now = versions.where("current").select("version", F.explode(F.array(key("r", F.col("record_key")), key("d", F.col("document_id")))).alias("__key"))
    return sharing(states.select("session_id", F.explode(wanted).alias("__key")), named.unionByName(now), "session_id", "version")
