"""Queries of answers, directories, web pages and chunk cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import text
from docketry.operators import answers, blocks, catalogue, directory, relational, search, segmentation
from docketry.plans.catalog import query
from docketry.session import table
from docketry.sources import html


@query("""with v as (select user_id, event_type, sum(cast(value as decimal(18,4))) as votes from events where event_type is not null group by all)
select user_id, event_type as winner, cast(votes as double) as votes from (select *, row_number() over (partition by user_id order by votes desc, event_type) as rn from v) where rn = 1""")
def weighted_vote(spark, d):
    return answers.weighted_vote(table(spark, d, "events"), "user_id", "event_type", "value")


@query("""with a as (select conv_id, turn, lower(coalesce(text, '')) as t from conversations),
s as (select *, 0.62::double - (case when contains(t, 'may') or contains(t, 'might') or contains(t, 'depends') or contains(t, 'uncertain') then 0.10::double else 0 end
+ case when contains(t, 'i do not know') or contains(t, 'not sure') or contains(t, 'insufficient') then 0.22::double else 0 end
+ case when len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) < 12 then 0.05::double else 0 end) as c from a)
select conv_id, turn, round(greatest(0, least(1, c)), 4) as confidence from s""")
def direct_confidence(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", answers.direct_confidence(F.col("text")).alias("confidence"))


_PAGE_DOMAIN = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^(www\\.|m\\.)', '')"
_PAGE_TONGUE = "regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1)"


def web_sources(spark, d):
    """Pages as the sources of one answer for each language of their urls."""
    pages, host = table(spark, d, "pages"), text.domain(F.col("url"))
    return pages.select(F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)/", 1).alias("question"), "url", host.alias("domain"), host.endswith(".org").alias("is_official"))


@query(f"""with s as (select {_PAGE_TONGUE} as question, url, {_PAGE_DOMAIN} as domain from pages),
g as (select question, count(distinct nullif(trim(url), '')) as u, count(*) filter (where domain like '%.org' and (domain = 'example.org' or domain like '%.example.org')) as m from s group by question),
c as (select question, case when m = 0 then 0.0::double else round(least(1, 0.78::double + least(greatest(u - 1, 0), 2) * 0.05::double + least(greatest(m - 1, 0), 1) * 0.04::double), 4) end as confidence from g)
select question, confidence, confidence < 0.72 as should_abstain, confidence >= 0.72 and confidence < 0.83 as should_hedge from c""")
def web_confidence(spark, d):
    return answers.web_confidence(web_sources(spark, d), "question", True, ["example.org"], ["example.com"])


@query("""with c as (select user_id, event_id, value / 250 as score, event_type = 'purchase' as exact from events),
r as (select *, row_number() over (partition by user_id order by score desc, event_id) as rn from c),
t as (select user_id, max(event_id) filter (where rn = 1) as first, max(score) filter (where rn = 1) as top, max(score) filter (where rn = 2) as second,
bool_or(exact) filter (where rn = 1) as e1, coalesce(bool_or(exact) filter (where rn = 2), false) as e2 from r where rn <= 2 group by user_id),
s as (select *, second is null or top >= 0.92 or (top >= 0.76 and top - second >= 0.12) or (e1 and not e2 and top >= 0.72 and top - second >= 0.05) as sure from t)
select user_id, case when top >= 0.45 and sure then first end as selected, top >= 0.45 and not sure as clarify from s""")
def candidate_decision(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("value") / 250).alias("score"), (F.col("event_type") == "purchase").alias("exact"))
    return answers.decide(rows, "user_id", "event_id", "score", "exact")


@query("""with g as (select user_id, count(distinct event_type) as r, count(distinct event_type) filter (where value > 150) as c, coalesce(bool_or(value > 150 and event_type = 'purchase'), false) as s, bool_or(value > 5) as strict from events group by user_id)
select user_id, r > 1 as mixed_retrieval, c > 1 as mixed_citations, strict and (r > 1 or c > 1) as fired,
array_to_string(list_filter([case when strict then 'strict_single_matter' end, case when r > 1 then 'mixed_retrieval' end, case when c > 1 then 'mixed_citations' end, case when strict and not s and c > 0 then 'missing_substantive_citation' end], lambda x: x is not null), ',') as reasons from g""")
def mixed_guard(spark, d):
    cited = F.col("value") > 150
    return answers.mixed_guard(table(spark, d, "events"), "user_id", "event_type", cited, F.col("event_type") == "purchase", F.col("value") > 5)


@query("""select l_orderkey, l_returnflag, l_partkey from (select *, row_number() over (partition by l_orderkey order by case l_returnflag when 'R' then 1 else 2 end, l_linenumber, l_partkey) as rn from lineitem where l_returnflag in ('R', 'N')) where rn = 1""")
def fact_by_priority(spark, d):
    return answers.fact_by_priority(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", ["R", "N"])


@query("select source, lang, count(*) as cases, min(doc_id) as first_case from documents join labels using (doc_id) where quality = 0 group by source, lang")
def bug_clusters(spark, d):
    bad = table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id")
    return answers.bug_clusters(bad, "source", "lang", "doc_id")


@query("select doc_id, lang, source from documents where lang = 'en' and source <> 'src1'")
def tag_filter(spark, d):
    docs = table(spark, d, "documents").withColumn("tags", F.array("lang", "source"))
    return answers.with_tags(docs, "tags", ("en", " "), ("src1",)).select("doc_id", "lang", "source")


@query("""with p as (select event_type, event_id, value > 60 as changed, row_number() over (partition by event_type order by event_id) as n from events),
r as (select *, n - coalesce(max(case when changed then n end) over (partition by event_type order by n rows unbounded preceding), 0) as run from p)
select event_type, coalesce(min(event_id) filter (where n >= 10 and run >= 3), max(event_id)) as last_page, count(*) filter (where n >= 10 and run >= 3) > 0 as stopped from r group by event_type""")
def crawl_end(spark, d):
    pages = table(spark, d, "events").select("event_type", "event_id", (F.col("value") > 60).alias("changed"))
    return answers.crawl_end(pages, "event_type", "event_id", "changed")


@query("""with a as (select l_orderkey as k, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as got from lineitem where l_returnflag <> 'R' group by l_orderkey)
select o_orderkey, case when got is null then 'missing' when abs(got - o_totalprice) <= 50000 then 'matched' else 'mismatched' end as status from orders left join a on k = o_orderkey""")
def numeric_check(spark, d):
    expected = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    items = table(spark, d, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    actual = items.agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("v"))
    return answers.numeric_check(expected, actual, "o_orderkey", "v", 50000.0)


@query("""with w as (select distinct l_orderkey as k, l_suppkey as s from lineitem where l_returnflag = 'N'), g as (select distinct l_orderkey as k, l_suppkey as s from lineitem where l_discount > 0.05),
x as (select k, count(*) as extra from (select * from g except select * from w) group by k),
c as (select o_orderkey, case when o_orderkey not in (select k from w) then 0 when o_orderkey not in (select k from g) then 1 else coalesce(extra, 0) end as claims, case o_orderstatus when 'F' then 0.9 when 'O' then 0.7 else 0.5 end::double as f from orders left join x on k = o_orderkey)
select o_orderkey, cast(claims as bigint) as unsupported_claims, round(greatest(0, least(1, 1 - f + case when claims > 0 then 0.15::double else 0 end)), 4) as hallucination_rate from c""")
def grounding_rates(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_returnflag", "l_discount")
    cases = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 0.9).when(F.col("o_orderstatus") == "O", 0.7).otherwise(0.5).alias("f"))
    return answers.grounding(cases, items.where("l_returnflag = 'N'"), items.where("l_discount > 0.05"), "o_orderkey", "l_suppkey", "f")


@query("""with p as (select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey),
risk as (select distinct case when a = 3 then b else a end as n from p where a = 3 or b = 3)
select s_suppkey, round(s_acctbal / 10000, 6) * case when s_nationkey in (select n from risk) then 0.08::double else 1 end as score from supplier""")
def confusion_penalty(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    pairs = nation.alias("x").join(nation.alias("y"), "n_regionkey").where("x.n_nationkey < y.n_nationkey").select(F.col("x.n_nationkey").alias("a"), F.col("y.n_nationkey").alias("b"))
    hits = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.round(F.col("s_acctbal") / 10000, 6).alias("score"))
    return search.confused(hits, pairs, [3], record="s_nationkey").select("s_suppkey", "score")


@query("select s_suppkey, n_nationkey from supplier, nation where s_suppkey = n_nationkey or s_nationkey in (n_nationkey, n_regionkey)")
def same_or_overlap(spark, d):
    left = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("no"), F.array("s_nationkey").alias("keys"))
    right = table(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").cast("long").alias("no"), F.array("n_nationkey", "n_regionkey").alias("keys"))
    return answers.same_or_overlap(left, right, "s_suppkey", "n_nationkey", "no", "keys")


@query("""with k as (select n_nationkey as office, replace(lower(n_name), '_', ' ') as term, 110 as eq, 0 as ins from nation union all select n_nationkey, lower(r_name), 30, 30 from nation join region on n_regionkey = r_regionkey
union all select n_nationkey, replace(lower(n_name), '_', ' ') || ' office', 105, 70 from nation),
h as (select n_nationkey as hint_id, replace(lower(n_name), '_', ' ') || ' office ' || lower(r_name) as h from nation join region on n_regionkey = r_regionkey)
select hint_id, office, cast(sum(case when term = h then eq when contains(h, term) then ins end) as bigint) as score from h, k where contains(h, term) group by hint_id, office having sum(case when term = h then eq else ins end) >= 60""")
def office_scores(spark, d):
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    offices = nation.withColumn("aliases", F.array(F.concat("n_name", F.lit(" office"))))
    keys = directory.office_keys(offices, "n_nationkey", "n_name", region="r_name", aliases="aliases")
    hints = nation.select(F.col("n_nationkey").alias("hint_id"), F.concat_ws(" ", "n_name", F.lit("office"), "r_name").alias("hint"))
    return directory.office_scores(hints, keys, "hint_id", "hint")


@query("""with q as (select distinct unnest([p_name, string_split(p_name, ' ')[1], p_brand]) as query, from part),
s as (select query, trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')) as q from q),
n as (select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as nm, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) as al from part),
w as (select p_partkey, unnest(string_split(nm, ' ')) as t from n union select p_partkey, unnest(string_split(al, ' ')) from n),
h as (select query, 1 as stage, p_partkey from s join n on q = nm union all select query, 2, p_partkey from s join n on q = al and al <> nm union all select query, 3, p_partkey from s join w on q = t),
g as (select query, stage, count(*) as n, min(p_partkey) as one from h group by all),
f as (select * from g join s using (query) where not (stage = 3 and n = 1 and length(q) < 4)),
b as (select * from f qualify row_number() over (partition by query order by stage) = 1)
select s.query, case when stage is null then 'no_match' when n > 1 then 'clarify' when stage = 1 then 'exact' else 'high' end as status,
case stage when 1 then 'exact_name' when 2 then 'exact_alias' when 3 then 'single_token' else 'no_match' end as stage, coalesce(n, 0) as n_found, case when n = 1 then one end as found from s left join b on s.query = b.query""")
def staged_match(spark, d):
    part = table(spark, d, "part").withColumn("aliases", F.array("p_brand"))
    asked = part.select(F.explode(F.array("p_name", F.split("p_name", " ")[0], "p_brand")).alias("query")).distinct().withColumn("q", F.col("query"))
    return directory.staged_match(asked, part, "query", "q", "p_partkey", "p_name", "aliases")


_TITLES = "(select n_nationkey, replace(n_name, '_', ' ') as n, r_name as r from nation join region on n_regionkey = r_regionkey)"


def titled(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", F.translate("n_name", "_", " ").alias("n"), F.col("r_name").alias("r"))


@query(f"select n_nationkey, unnest(list_distinct([lower(n) || ' ltd', lower(r), lower(n) || ' ltd vs ' || lower(r), lower(r) || ' vs ' || lower(n) || ' ltd', lower(n) || ' limited', lower(n) || ' limited vs ' || lower(r), lower(r) || ' vs ' || lower(n) || ' limited'])) as variant from {_TITLES}")
def alias_variants(spark, d):
    title = F.concat(F.lit("M/s "), F.col("n"), F.lit(" Ltd. vs. "), F.col("r"))
    return titled(spark, d).select("n_nationkey", F.explode(directory.alias_variants(title)).alias("variant"))


@query(f"select n_nationkey, n as first, r as second, upper(array_to_string(list_transform(string_split(lower(n), ' '), lambda w: w[1]), '')) as acronym from {_TITLES}")
def title_entities(spark, d):
    found = directory.title_entities(F.concat(F.lit("Order in respect of "), F.col("n"), F.lit(" in the matter of "), F.col("r"), F.lit(".")))
    return titled(spark, d).select("n_nationkey", found[0].alias("first"), found[1].alias("second"), directory.acronym(F.col("n")).alias("acronym"))


@query("""select page_id, case when regexp_matches(lower(p), '\\.(pdf|doc|docx|xls|xlsx|zip)$') then 'direct_file' else 'detail' end as kind,
nullif(regexp_extract(url, '[?&]id=([^&#]+)', 1), '') as external_id from (select page_id, url, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') as p from pages)""")
def link_kinds(spark, d):
    return table(spark, d, "pages").select("page_id", html.link_kind(F.col("url")).alias("kind"), html.external_id(F.col("url")).alias("external_id"))


@query("""select page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), '') as title_tag,
case when page_id % 3 = 1 then cast(page_id % 17 as varchar) else '1' end as next_value, case when page_id % 5 = 1 then cast(page_id % 23 as integer) end as total_pages, page_id % 4 = 1 as has_next from pages""")
def page_paging(spark, d):
    n, pages = F.col("page_id"), table(spark, d, "pages")
    hidden = lambda name, by: F.concat(F.lit(f'<input type="hidden" name="{name}" class="p" value="'), (n % by).cast("string"), F.lit('">'))
    more = F.concat(F.when(n % 3 == 1, hidden("nextValue", 17)).otherwise(""), F.when(n % 5 == 1, hidden("totalpage", 23)).otherwise(""), F.when(n % 4 == 1, "<a href='#' title='Next'>&gt;</a>").otherwise("<a title='Previous'>&lt;</a>"))
    pages = pages.withColumn("html", F.concat(F.coalesce("html", F.lit("")), more))
    tag = F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]*>", " ")
    return html.paging(pages).join(pages.select("page_id", text.whitespace_or_null(tag).alias("title_tag")), "page_id")


@query()
def page_details(spark, d):
    return html.details(table(spark, d, "pages"))


@query("""select domain, url from (select *, row_number() over (partition by domain order by url) as rn from (select canonical, domain, min(url) as url from
(select url, """ + _PAGE_DOMAIN + """ as domain, case when len(kept) = 0 then path else path || '?' || array_to_string(kept, '&') end as canonical from
(select url, rtrim(regexp_replace(bare, '\\?.*$', ''), '/') as path, list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref)=')) as kept
from (select url, regexp_replace(url, '#.*$', '') as bare from pages))) group by canonical, domain)) where rn = 1""")
def best_sources(spark, d):
    pages = table(spark, d, "pages").withColumn("title", F.lit("page"))
    return answers.ranked_sources(pages, "url", "title", ["example.org", "example.com"], True).select("domain", "url")


@query("select doc_id, lang, source from documents where lang = 'en' or doc_id in (select doc_id from labels where quality = 1)")
def union_scope(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return catalogue.in_either(docs, "doc_id", docs.where("lang = 'en'"), table(spark, d, "labels").where("quality = 1"))


@query("select c_custkey, coalesce(n, 0) as n_orders from customer left join (select o_custkey, count(*) as n from orders group by o_custkey) on o_custkey = c_custkey")
def processed_counts(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return catalogue.with_counts(table(spark, d, "customer"), orders, "c_custkey", "n_orders").select("c_custkey", "n_orders")


@query("select l_orderkey, string_agg(cast(l_partkey as varchar), ',' order by l_linenumber, l_partkey) as parts from lineitem group by l_orderkey")
def parts_in_order(spark, d):
    return catalogue.in_order(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "parts")


@query("select doc_id, toxic, row_number() over (partition by source order by toxic desc nulls last, doc_id) as place from documents left join labels using (doc_id)")
def facts_nulls_last(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return catalogue.numbered(rows, "source", F.desc_nulls_last("toxic"), F.col("doc_id")).select("doc_id", "toxic", "place")


@query("""select item_id, 'case:' || coalesce(nullif(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 72), ''), 'case') || ':' || substr(sha1(text), 1, 10) as case_id from benchmark""")
def case_ids(spark, d):
    return table(spark, d, "benchmark").select("item_id", catalogue.case_id(F.col("text")).alias("case_id"))


@query("""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as line_no from documents),
t as (select doc_id, line_no, trim(regexp_replace(raw, '[ \\t]+', ' ', 'g'), ' ') as line from l),
k as (select doc_id, lower(line) as l, min(line_no) as line_no, arg_min(line, line_no) as line from t where length(line) >= 20 and not (upper(line) = line and len(string_split(line, ' ')) <= 10) group by doc_id, lower(line))
select doc_id, cast(line_no as integer) as line_no, line from (select *, row_number() over (partition by doc_id order by line_no) as rn from k) where rn <= 3""")
def opening_lines(spark, d):
    return segmentation.opening_lines(table(spark, d, "documents"), "doc_id", "text")


@query()
def tidy_chunks(spark, d):
    return segmentation.tidy_chunks(table(spark, d, "documents"))


@query("select * from (select user_id, event_id, ts from events qualify row_number() over (order by ts desc, event_id desc) <= 20)")
def recent_top(spark, d):
    return catalogue.latest(table(spark, d, "events").select("user_id", "event_id", "ts"), 20, "ts", "event_id")


@query("select c_nationkey, count(*) as cases, min(c_acctbal) as least, max(c_acctbal) as most, greatest(100 - count(*), 0) as missing from customer group by c_nationkey")
def bucket_ranges(spark, d):
    return catalogue.value_ranges(table(spark, d, "customer"), "c_nationkey", "c_acctbal", 100)


@query("select user_id, last(value order by event_id) filter (where event_type = 'click') as last_click, last(value order by event_id) filter (where event_type = 'view') as last_view from events group by user_id")
def last_contacts(spark, d):
    return catalogue.last_of_kinds(table(spark, d, "events"), "user_id", "event_type", "event_id", "value", ["click", "view"])


@query("select source, doc_id, n_chars from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as rn from documents) where rn <= 2")
def best_per_document(spark, d):
    return relational.first_per(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 2).select("source", "doc_id", "n_chars")


@query("""with o as (select user_id, min(case when event_type = 'error' then 'broken' end) as e from events group by user_id)
select c_custkey, case when user_id is null then 'pending' when e is null then 'done' else 'failed' end as status, e as error from customer left join o on user_id = c_custkey""")
def advance_status(spark, d):
    outcomes = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.when(F.col("event_type") == "error", "broken").alias("error"))
    rows = table(spark, d, "customer").select("c_custkey", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"))
    return relational.advance(rows, outcomes, "c_custkey")


@query("select doc_id, coalesce(case when quality = 1 then 'good' end, lang) as lang, source from documents left join labels using (doc_id)")
def seed_patch(spark, d):
    patches = table(spark, d, "labels").select("doc_id", F.lit("good").alias("lang"), F.when(F.col("quality") == 1, "checked").otherwise("stale").alias("reason"))
    return relational.patch(table(spark, d, "documents").select("doc_id", "lang", "source"), patches, "doc_id", ["lang"], ["checked"])


@query("""with a as (select distinct p_partkey, unnest(string_split(p_name, ' ')) as w from part), b as (select distinct p_type, unnest(string_split(lower(p_type), ' ')) as w from part union select distinct p_name, unnest(string_split(p_name, ' ')) from part),
s as (select p_partkey, p_type as target, count(*) as score from a join b using (w) group by all)
select p_partkey, target, score from s qualify row_number() over (partition by p_partkey order by score desc, target) = 1""")
def best_targets(spark, d):
    part = table(spark, d, "part")
    targets = part.select(F.col("p_type").alias("target"), F.split(F.lower("p_type"), " ").alias("words")).unionByName(part.select(F.col("p_name").alias("target"), F.split("p_name", " ").alias("words"))).distinct()
    return relational.best_target(part.select("p_partkey", F.split("p_name", " ").alias("words")), targets, "p_partkey", "target", "words")


@query("select event_id, abs(cast(regexp_extract(props, '(\\d+)', 1) as double) - value) <= 1.0 as stated from events")
def stated_values(spark, d):
    from docketry.operators import facts

    return table(spark, d, "events").select("event_id", facts.states_value(F.col("props"), F.col("value")).alias("stated"))


def document_pages(spark, d):
    """Pages of documents: the documents of a source and language in the order of their ids are the pages of one document, and every seventh begins with a heading."""
    n = F.col("doc_id")
    head = F.when(n % 7 == 0, "ORDER PASSED IN THE MATTER").when(n % 7 == 1, "2. Findings on the Issues").when(n % 7 == 2, "Issue II: Whether notices were served").when(n % 7 == 3, "a | b | c").otherwise("")
    key = F.concat_ws("-", "source", "lang", F.floor(n / 40).cast("string"))
    return table(spark, d, "documents").select(key.alias("doc"), (n % 40 + 1).cast("int").alias("page"), F.concat(head, F.lit("\n\n"), F.regexp_replace("text", r"\n", "\n\n")).alias("body"))


@query()
def document_blocks(spark, d):
    return blocks.document_blocks(document_pages(spark, d))


@query()
def typed_chunks(spark, d):
    return blocks.typed_chunks(document_pages(spark, d))
