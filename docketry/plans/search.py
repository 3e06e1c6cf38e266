"""Queries of search, entity resolution, routing and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import scoring, text
from docketry.operators import entities, evaluation, routing, search, signals, vectors
from docketry.plans.catalog import query
from docketry.session import table

QUESTION = "the order of those that were in this"


def questions(spark, d):
    """The question with the first stored vector as its embedding: one row."""
    vec = table(spark, d, "embeddings").where("vec_id = 0").select(F.lit(1).alias("query_id"), F.lit(QUESTION).alias("query"), F.col("embedding").alias("q"))
    return vec


def texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("unit"), "text")


def units(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("unit"), "embedding")


#: For each of the question's words the last place up to here; what begins at the earliest of them is a cover if none before begins there.
_LAST = ", ".join(f"coalesce(max(case when term = '{w}' then pos end) over u, 0)" for w in QUESTION.split())
_LEX = f"""with said as (select doc_id as unit, string_split(trim(regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' ') as ws from documents),
w as (select unit, unnest(ws) as term, generate_subscripts(ws, 1) as pos from said),
asked as (select distinct unnest(string_split('{QUESTION}', ' ')) as term),
hit as (select unit, term, pos, row_number() over (partition by unit order by pos) as n from w where term in (select term from asked)),
ends as (select unit, pos, n, least({_LAST}) as b from hit window u as (partition by unit order by pos)),
fresh as (select *, max(b) over (partition by unit order by pos rows between unbounded preceding and 1 preceding) as before from ends),
dense as (select f.unit, sum(1.0::double / (1 + f.pos - f.b + 1 - (f.n - h.n + 1))) as density from fresh f join hit h on h.unit = f.unit and h.pos = f.b where f.b > 0 and (before is null or f.b > before) group by f.unit),
dw as (select distinct unit, term from w where term <> ''), dg as (select distinct unit, substr('  ' || term || ' ', i, 3) as g from dw, lateral (select unnest(range(1, length(term) + 2)) as i)),
qg as (select distinct substr('  ' || term || ' ', i, 3) as g from asked, lateral (select unnest(range(1, length(term) + 2)) as i)),
own as (select unit, count(*) as n, count(*) filter (where g in (select g from qg)) as common from dg group by unit),
alike as (select unit, common / (n + (select count(*) from qg) - common) as similarity from own where common > 0),
lex as (select coalesce(s.unit, a.unit) as unit, round(0.8::double * coalesce(density, 0) + 0.2::double * coalesce(similarity, 0), 6) as score from dense s full join alike a on s.unit = a.unit where density is not null or similarity >= 0.05),
lr as (select *, row_number() over (order by score desc, unit) as rank from lex)"""
_VEC = """q as (select embedding as q from embeddings where vec_id = 0),
vec as (select vec_id as unit, round(list_cosine_similarity(embedding::double[], q::double[]), 6) as score from embeddings, q where embedding is not null),
vr as (select *, row_number() over (order by score desc, unit) as rank from vec)"""


@query(_LEX + " select 1 as query_id, unit, score, rank from lr where rank <= 30")
def lexical_search(spark, d):
    return search.lexical(questions(spark, d), texts(spark, d), {"text": 1.0}, ["text"], 30)


def phrased(spark, d):
    """A query of each benchmark item: its second and third word as a phrase with its fourth; or its first without its last; or its fifth joined to its sixth."""
    w = text.tokens(F.col("text"))
    made = F.concat(F.lit('"'), F.concat_ws(" ", F.get("w", F.lit(1)), F.get("w", F.lit(2))), F.lit('" '), F.coalesce(F.get("w", F.lit(3)), F.lit("")), F.lit(" or "), F.coalesce(F.get("w", F.lit(0)), F.lit("")), F.lit(" -"), F.coalesce(F.element_at("w", -1), F.lit("")), F.lit(" OR "), F.concat_ws("-", F.get("w", F.lit(4)), F.get("w", F.lit(5))))
    return table(spark, d, "benchmark").where("text is not null").withColumn("w", w).where("size(w) > 5").select(F.col("item_id").alias("query_id"), made.alias("query"))


@query()
def phrase_search(spark, d):
    """The best documents for a query of each benchmark item, with phrases, alternatives and words that must not be there."""
    return search.lexical(phrased(spark, d), texts(spark, d), {"text": 1.0}, ["text"], 10)


@query("with " + _VEC + " select 1 as query_id, unit, score, rank from vr where rank <= 25")
def vector_topk(spark, d):
    return search.vector(questions(spark, d), units(spark, d), 25)


#: Inverted lists of chunk vectors, and the share of true neighbours that the lists a query probes are to hold.
LISTS, RECALL = 100, 0.95


def vector_queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 100 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query()
def vector_lists(spark, d):
    """The 25 nearest of all vectors for each one whose id is divisible by 100, from the lists that it probes."""
    middle, probes = vectors.fitted(units(spark, d), LISTS, 25, RECALL)
    return search.vector_lists(vector_queries(spark, d), vectors.inverted_lists(units(spark, d), middle), middle, 25, probes)


@query(_LEX + ", " + _VEC + """, b as (select coalesce(l.unit, v.unit) as unit, l.rank as lexical_rank, v.rank as vector_rank,
round(coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.15 / (60 + v.rank), 0), 9) as score from (select * from lr where rank <= 30) l full join (select * from vr where rank <= 30) v on l.unit = v.unit),
r as (select *, row_number() over (order by score desc, unit) as rank from b) select 1 as query_id, unit, lexical_rank, vector_rank, cast(score as double) as score, rank from r where rank <= 10""")
def hybrid_search(spark, d):
    return search.hybrid(questions(spark, d), texts(spark, d), {"text": 1.0}, ["text"], units(spark, d), 10)


TYPES = list(scoring.SECTION_PRIORS)


def hierarchy(spark, d):
    """Documents, their lines as sections and the lines' sentences as chunks, each with a stored vector."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    with_vector = lambda rows, key: rows.withColumn("v", key % 500).join(vectors, "v", "left").drop("v")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("unit"), F.concat_ws(" ", "source", "lang").alias("title"), F.col("text").alias("body"), F.when(F.col("lang") == "de", "settlement").otherwise("orders").alias("bucket"), F.col("source").alias("record"))
    parts = docs.select(F.col("unit").alias("document"), "title", F.posexplode(F.split("body", "\n")).alias("n", "body")).where("trim(body) <> ''")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("n") % len(TYPES) + 1).cast("int"))
    parts = parts.select((F.col("document") * 10000 + F.col("n")).alias("unit"), "document", F.concat(F.lit("s"), F.col("n") % 3).alias("section_key"), kind.alias("section"), F.lit("part of").alias("title"), F.lit("").alias("heading"), "body")
    said = parts.select(F.col("unit").alias("part"), "document", "section_key", "section", "title", "heading", F.posexplode(text.sentences(F.col("body"))).alias("k", "body"))
    said = said.select((F.col("part") * 1000 + F.col("k")).alias("unit"), "document", "section_key", "section", "title", "heading", "body")
    return with_vector(docs, F.col("unit")), with_vector(parts, F.col("unit")), with_vector(said, F.col("unit"))


def asked(spark, d):
    return questions(spark, d).withColumns({"intent": F.lit("substantive"), "focused": F.lit(False), "terms": F.array().cast("array<string>")})


@query()
def hierarchical_search(spark, d):
    """The best chunks of the best sections of the best documents, each with its parents' score carried on."""
    return search.levels(asked(spark, d), *hierarchy(spark, d), (5, 8, 10))[2]


_TITLE = "regexp_replace(regexp_replace(replace(lower({c}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), '^ +| +$', '', 'g')"
_TRI = "list_distinct(flatten(list_transform(list_filter(string_split({t}, ' '), lambda x: x <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _sim(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


@query(f"with g as (select p_partkey, {_TRI.format(t=_TITLE.format(c='p_name'))} as a, {_TRI.format(t=repr('blue bolt'))} as b from part) select p_partkey, round({_sim('a', 'b')}, 6) as similarity from g")
def trigram_similarity(spark, d):
    b = text.trigrams(F.lit("blue bolt"))
    return table(spark, d, "part").select("p_partkey", F.round(text.similarity(text.trigrams(F.col("p_name")), b), 6).alias("similarity"))


@query(f"""with t as (select p_partkey as unit, {_TITLE.format(c='p_name')} as title, {_TRI.format(t=_TITLE.format(c='p_name'))} as a, {_TRI.format(t=repr('red widget'))} as b from part),
s as (select unit, title = 'red widget' as eq, contains(title, 'red widget') as holds, {_sim('a', 'b')} as sim from t),
h as (select unit, round(greatest(case when eq then 0.99 else 0 end, case when holds then 0.95 else 0 end, sim), 6) as score from s where eq or holds or sim >= 0.35),
r as (select *, row_number() over (order by score desc, unit) as rank from h) select unit, cast(score as double) as score, rank from r where rank <= 50""")
def exact_lookup(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("unit"), F.lit("").alias("key"), F.col("p_name").alias("title"))
    return search.exact_lookup(rows, "Red Widget", 50)


def picked(values, at):
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def hits(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("unit"), F.col("source").alias("record"), F.when(F.col("lang") == "de", "settlement").otherwise("orders").alias("bucket"), picked(TYPES, F.col("doc_id")).alias("section"), (1.0 / (60 + F.col("n_chars") % 100)).alias("score"))


_HITS = """h as (select doc_id as unit, source as record, case when lang = 'de' then 'settlement' else 'orders' end as bucket, n_chars,
['operative_order', 'directions', 'findings', 'issues', 'reply_or_submissions', 'background', 'facts', 'show_cause_notice', 'other', 'table_block', 'annexure', 'header'][doc_id % 12 + 1] as section from documents),
p as (select *, case section when 'operative_order' then 1.35 when 'directions' then 1.30 when 'findings' then 1.25 when 'issues' then 1.15 when 'reply_or_submissions' then 1.05 when 'background' then 1.00 when 'facts' then 1.00
  when 'show_cause_notice' then 0.98 when 'other' then 0.92 when 'table_block' then 0.90 when 'annexure' then 0.88 when 'header' then 0.70 end::double as prior,
 case section when 'operative_order' then 1.20 when 'directions' then 1.18 when 'findings' then 1.15 when 'issues' then 1.08 when 'reply_or_submissions' then 1.03 when 'background' then 0.98 when 'facts' then 0.98
  when 'show_cause_notice' then 0.96 when 'other' then 0.92 when 'table_block' then 0.92 when 'annexure' then 0.90 when 'header' then 0.75 end::double as substantive,
 case when bucket = 'settlement' then 1.12 else 1.0 end::double * case when record = 'src1' then 1.45 else 0.62 end::double as others from h)"""


@query(f"with {_HITS} select unit, section, round(greatest(1.0::double / (60 + n_chars % 100) * prior * substantive * others, 0), 9) as final from p")
def priors_rerank(spark, d):
    return search.rerank(hits(spark, d), F.lit("substantive"), ["src1"]).select("unit", "section", "final")


@query("""with h as (select doc_id as unit, doc_id // 12 % 50 as document, n_chars % 3 as lexical, n_chars % 2 as vector, doc_id // 12 % 3 <> 1 as outcome, round(1.0::double / (20 + n_chars % 13), 9) as s0,
['operative_order', 'header', 'findings', 'issues', 'table_block', 'header', 'facts', 'header', null, 'header', 'annexure', 'header'][doc_id % 12 + 1] as section from documents),
a as (select *, max(case when section in ('operative_order', 'findings', 'directions') then s0 end) over (partition by document, outcome) as strong from h),
b as (select *, round(case when outcome and section = 'header' and strong > 0 and s0 > strong and s0 <= 1.25 * strong then strong * 0.995 else s0 end, 9) as s1 from a),
c as (select *, case when section = 'header' then 'h' when section in ('operative_order', 'findings', 'issues', 'facts') then 's' else 'o' end as kind from b),
e as (select *, row_number() over (partition by document, outcome, kind order by s1 desc, lexical desc, vector desc, unit) as k, max(case when kind = 'h' then s1 end) over (partition by document, outcome) as top from c)
select unit, document, section, outcome, round(case when kind = 's' and k = 1 and outcome and s1 > 0 and s1 < top and s1 >= 0.93 * top then s1 + least(top - s1 + greatest(0.01 * s1, 0.000001), 0.08 * top)
 when kind = 'h' then s1 * (1 - least(0.30, 0.12 * (k - 1))) else s1 end, 9) as final from e""")
def header_diversity(spark, d):
    """Groups of hits with headers near, above and far above their strong sections; a third of them are for questions that aren't substantive."""
    n = F.col("doc_id")
    kinds = ["operative_order", "header", "findings", "issues", "table_block", "header", "facts", "header", None, "header", "annexure", "header"]
    rows = table(spark, d, "documents").select(n.alias("unit"), (F.floor(n / 12) % 50).alias("document"), (F.col("n_chars") % 3).alias("lexical"), (F.col("n_chars") % 2).alias("vector"), (F.floor(n / 12) % 3 != 1).alias("outcome"), F.round(1.0 / (20 + F.col("n_chars") % 13), 9).alias("final"), picked(kinds, n).alias("section"))
    rows = rows.withColumn("intent", F.when(F.col("outcome"), "substantive").otherwise("party_or_title"))
    by = ("document", "outcome")
    return search.diversify(search.suppress_headers(rows, by), by).select("unit", "document", "section", "outcome", "final")


@query("""with k as (select conv_id, turn, lower(text) as low, ' ' || trim(regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) || ' ' as s from conversations)
select conv_id, turn, case when (regexp_matches(s, ' meaning of ') or regexp_matches(s, '^ (what is|explain) ')) and regexp_matches(s, ' (settle|settlement|settled) ') then 'generic'
 when regexp_matches(s, ' (dismissed|allowed|upheld|quashed|penalty|penalties|imposed|restrained|debarred|directed|direct|refund|settle|settled|settlement|violated|findings|held|order passed|final order|interim order) ') then 'substantive'
 when regexp_matches(s, ' (filed by|vs|versus|v|in the matter of|petitioner|respondent|appeal no|petition no|writ no|case no|suit no|application no|complaint no|order no) ') then 'party_or_title' when regexp_matches(s, ' appeal ') then 'substantive'
 when regexp_matches(s, ' (act|regulation|regulations|rule|rules|section|sast|pfutp|icdr|lodr|insider trading|takeover|adjudication) ') then 'regulation' else 'generic' end as intent,
case when regexp_matches(low, '^\\s*(hi|hello|hey|thanks)\\b') then 'greeting' when regexp_matches(low, '\\bhow many (orders|documents)\\b') then 'corpus_stats' when regexp_matches(low, '\\b(chairman|director|office|phone|email|address)\\b') then 'directory'
 when regexp_matches(low, '\\b(latest|today|news)\\b') then 'current_news' when regexp_matches(low, '\\b(order|matter) (of|in)\\b') then 'exact_lookup' else 'hierarchical_search' end as route from k""")
def intent_classifier(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", signals.intent(F.col("text")).alias("intent"), routing.route(F.col("text")).alias("route"))


@query("""select n_regionkey, arg_max(n_name, (length(n_name), -n_nationkey)) as n_name, list_sort(list(distinct n_name)) as aliases, count(*) as merged_rows from nation group by n_regionkey""")
def canonical_offices(spark, d):
    rows = table(spark, d, "nation").withColumn("priority", F.lit(1))
    return entities.canonical(rows, "n_regionkey", ["n_name"], "priority", "n_nationkey", "n_name")


@query("""with a as (select c_nationkey as k, count(*) as l from customer group by 1), b as (select s_nationkey as k, count(*) as r from supplier group by 1)
select coalesce(a.k, b.k) as k, coalesce(l, 0) as left_n, coalesce(r, 0) as right_n, coalesce(l, 0) = coalesce(r, 0) as agrees from a full join b on a.k = b.k""")
def office_parity(spark, d):
    return entities.parity(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), "k")


def cases(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return rows.select("doc_id", F.nullif("lang", F.lit("es")).alias("route"), F.array(F.col("source"), F.lit(""), F.lit(None).cast("string")).alias("tags"), F.col("quality").alias("passed"), F.col("toxic").alias("abstained"), (F.col("n_chars") % 101 / 100).alias("confidence"))


_CASES = "c as (select doc_id, nullif(lang, 'es') as route, source, quality as passed, toxic as abstained, (n_chars % 101) / 100.0::double as confidence from labels join documents using (doc_id))"
_METRICS = "count(*) as cases, round(avg(passed), 6) as pass_rate, round(avg(confidence), 6) as mean_confidence, round(avg(abstained), 6) as abstain_rate"
_BIN = "format('{:.1f}', floor(confidence * 10 + 1e-9) / 10) || '-' || format('{:.1f}', least(floor(confidence * 10 + 1e-9) / 10 + 0.1, 1.0))"


@query(f"with {_CASES} select route, {_METRICS} from c group by route")
def route_metrics(spark, d):
    return evaluation.group_metrics(cases(spark, d), "route")


@query(f"with {_CASES} select source as tag, {_METRICS} from c group by source")
def tag_metrics(spark, d):
    return evaluation.tag_metrics(cases(spark, d), "tags")


@query(f"""with {_CASES} select passed, count(*) filter (where abstained = 0) as "0", count(*) filter (where abstained = 1) as "1" from c group by passed""")
def confusion_matrix(spark, d):
    return evaluation.confusion(cases(spark, d), "passed", "abstained", [0, 1])


@query(f"with {_CASES} select {_BIN} as bin, count(*) as cases, round(avg(confidence), 6) as mean_confidence, round(avg(passed), 6) as precision from c group by 1")
def calibration_bins(spark, d):
    return evaluation.calibration(cases(spark, d))


@query(f"with {_CASES}, b as (select {_BIN} as bin, count(*) as n, avg(confidence) as cf, avg(passed) as p from c group by 1) select round(sum(abs(p - cf) * n) / sum(n), 6) as ece, (select round(avg((confidence - passed) ** 2), 6) from c) as brier from b")
def calibration_errors(spark, d):
    return evaluation.calibration_errors(cases(spark, d))


@query(f"""with {_CASES}, a as (select route, {_METRICS} from c where doc_id % 2 = 0 group by route), b as (select route, {_METRICS} from c where doc_id % 2 = 1 and route is distinct from 'fr' group by route)
select coalesce(a.route, b.route) as route, coalesce(a.cases, 0)::double as base_cases, coalesce(b.cases, 0)::double as head_cases, round(coalesce(b.cases, 0)::double - coalesce(a.cases, 0)::double, 6) as delta_cases,
coalesce(a.pass_rate, 0) as base_pass_rate, coalesce(b.pass_rate, 0) as head_pass_rate, round(coalesce(b.pass_rate, 0) - coalesce(a.pass_rate, 0), 6) as delta_pass_rate
from a full join b on a.route is not distinct from b.route""")
def run_compare(spark, d):
    rows = cases(spark, d)
    base = evaluation.group_metrics(rows.where("doc_id % 2 = 0"), "route")
    head = evaluation.group_metrics(rows.where("doc_id % 2 = 1 and not (route <=> 'fr')"), "route")
    return evaluation.compare_runs(base, head, "route", ["cases", "pass_rate"])


@query(f"""with {_CASES}, r as (select 'contamination_count' as metric, '<=' as op, 0.0::double as threshold, round(sum(abstained)::double, 6) as observed from c union all select 'regression_pass_rate', '>=', 1.0, round(avg(passed)::double, 6) from c
union all select 'structured_accuracy', '>=', 0.9, 0.95 union all select 'numeric_accuracy', '>=', 0.9, round(avg(confidence)::double, 6) from c union all select 'equivalent_route_accuracy', '>=', 0.85, 0.85
union all select 'candidate_list_correctness', '>=', 0.95, round(avg(1 - abstained)::double, 6) from c union all select 'request_failures', '<=', 0.0, 0.0 union all select 'true_bugs', '<=', 0.0, count(*) filter (where passed = 0)::double from c)
select metric, op, threshold, observed, case when op = '<=' then observed <= threshold else observed >= threshold end as passed from r""")
def release_gate(spark, d):
    r = lambda c: F.round(c.cast("double"), 6)
    summary = cases(spark, d).agg(r(F.sum("abstained")).alias("contamination_count"), r(F.avg("passed")).alias("regression_pass_rate"), F.lit(0.95).alias("structured_accuracy"), r(F.avg("confidence")).alias("numeric_accuracy"), F.lit(0.85).alias("equivalent_route_accuracy"), r(F.avg(1 - F.col("abstained"))).alias("candidate_list_correctness"), F.lit(0.0).alias("request_failures"), r(F.count_if(F.col("passed") == 0)).alias("true_bugs"))
    return evaluation.release_gate(summary)


@query("""with x as (select l_orderkey as case_id, l_linenumber as rank, l_suppkey % 5 as record, l_partkey as chunk from lineitem), e as (select distinct o_orderkey as case_id, o_custkey % 5 as record from orders),
h as (select x.*, case when e.record is null then 0 else 1 end as hit from x left join e on x.case_id = e.case_id and x.record = e.record),
p as (select case_id, max(n) / sum(n) as purity from (select case_id, record, count(*) as n from h group by all) group by case_id)
select h.case_id, round(avg(hit), 6) as precision, round(count(distinct case when hit = 1 then record end)::double, 6) as recall, round(sum(hit / rank) / sum(1.0 / rank), 6)::double as relevance, round(any_value(p.purity), 6) as purity, round(1 - count(distinct chunk) / count(*), 6) as duplicate_ratio
from h join p using (case_id) group by h.case_id""")
def retrieval_metrics(spark, d):
    contexts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("rank"), (F.col("l_suppkey") % 5).alias("record"), F.col("l_partkey").alias("chunk"))
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 5).alias("record"))
    return evaluation.retrieval(contexts, expected)


@query("""with s as (select doc_id, n_chars, count(*) over (partition by sha256(text)) > 1 as dup, source from documents)
select source, cast(sum((n_chars > 4000)::int) * 4 + sum(dup::int) * 4 + sum((n_chars < 200)::int) as bigint) as severity from s group by source""")
def audit_severity(spark, d):
    from pyspark.sql import Window

    docs = table(spark, d, "documents").withColumn("sha", F.sha2("text", 256)).withColumn("dup", F.count("*").over(Window.partitionBy("sha")) > 1)
    return docs.groupBy("source").agg(evaluation.severity({"oversized": F.col("n_chars") > 4000, "duplicate": F.col("dup"), "tiny": F.col("n_chars") < 200}).alias("severity"))


@query("""with x as (select doc_id, (n_chars % 97) / 1000.0::double as top, (n_chars % 83) / 1200.0::double as second, doc_id % 2 as sub, (doc_id % 3) / 2.0::double as agr from documents),
y as (select doc_id, least(greatest(0.35 * least(greatest(top / 0.08, 0), 1) + 0.15 * least(greatest((top - second) / 0.02, 0), 1) + 0.20 * sub + 0.15 * agr + 0.05, 0), 1) as c from x)
select doc_id, round(c, 6) as confidence, case when c < 0.75 * 0.35::double then 'abstain' when c < 0.35::double then 'hedge' else 'answer' end as status from y""")
def retrieval_confidence(spark, d):
    n = F.col("n_chars")
    c = scoring.confidence(n % 97 / 1000, n % 83 / 1200, F.col("doc_id") % 2, F.col("doc_id") % 3 / 2, F.lit(0), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.round(c, 6).alias("confidence"), scoring.answer_status(c).alias("status"))
