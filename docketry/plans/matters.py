"""Queries of stored matters over orders, lines and events, with SQL that writes the rules out."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import matters, numbers
from docketry.plans.catalog import query
from docketry.plans.evaluations import _CASES, _FAILED, judged, run_cases
from docketry.plans.people import _STAFF, staff
from docketry.session import table


@query("""with q as (select 1 as query_id, n_nationkey as document from nation where n_nationkey < 5 union all select 2, n_nationkey from nation where n_nationkey % 2 = 0), s as (select 2 as query_id, 'BUILDING' as section_key union all select 2, 'MACHINERY')
select query_id, c_custkey as unit from customer join q on c_nationkey = document where query_id = 1 or c_mktsegment in (select section_key from s)""")
def child_scopes(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("document"))
    docs = n.where("document < 5").withColumn("query_id", F.lit(1)).unionByName(n.where("document % 2 = 0").withColumn("query_id", F.lit(2)))
    keys = spark.createDataFrame([(2, "BUILDING"), (2, "MACHINERY"), (2, "BUILDING")], "query_id int, section_key string")
    units = table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("document"), F.col("c_mktsegment").alias("section_key"))
    return matters.child_scope(units, docs, keys).select("query_id", "unit")


@query("select doc_id, source from documents where source in ('src1', 'src3')")
def locked_hits(spark, d):
    return matters.within_lock(table(spark, d, "documents").select("doc_id", "source"), "source", ["src1", "src3"])


@query("""select l_orderkey, l_partkey, l_linenumber, row_number() over (partition by l_orderkey order by l_quantity desc nulls last, nullif(l_discount, 0) desc nulls last, l_tax desc nulls last, l_suppkey, l_linenumber) as rank from lineitem""")
def chunk_order(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").alias("final"), F.nullif("l_discount", F.lit(0.0)).alias("lexical"), F.col("l_tax").alias("vector"), F.col("l_suppkey").alias("document"), F.col("l_linenumber").alias("chunk"))
    return matters.in_chunk_order(rows, "l_orderkey").select("l_orderkey", "l_partkey", "l_linenumber", "rank")


@query("select l_orderkey, l_linenumber, o_custkey, c_name from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey")
def chunk_documents(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version"), "l_linenumber")
    versions = table(spark, d, "orders").select(F.col("o_orderkey").alias("version"), F.col("o_custkey").alias("document"))
    documents = table(spark, d, "customer").select(F.col("c_custkey").alias("document"), "c_name")
    return matters.chain(lines, versions, documents, "version", "document").select(F.col("version").alias("l_orderkey"), "l_linenumber", F.col("document").alias("o_custkey"), "c_name")


@query("""with m as (select distinct o_custkey as v from orders where o_orderstatus = 'F'), p as (select distinct o_custkey as v from orders where o_orderstatus = 'O'), n as (select distinct o_custkey as v from orders where o_totalprice > 200000)
select c_custkey as v, m.v is not null as has_metadata, p.v is not null as has_provisions, n.v is not null as has_numbers from customer left join m on c_custkey = m.v left join p on c_custkey = p.v left join n on c_custkey = n.v where m.v is null or p.v is null or n.v is null""")
def missing_facts(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "v")
    sides = [orders.where(c) for c in ("o_orderstatus = 'F'", "o_orderstatus = 'O'", "o_totalprice > 200000")]
    return matters.missing_facts(table(spark, d, "customer").select(F.col("c_custkey").alias("v")), *sides, "v")


_META = """m as (select o_orderkey as version, (o_custkey % 7) / 10.0 as confidence, case when o_orderkey % 5 <> 0 then 'Name ' || o_custkey % 11 end as name, case when o_orderkey % 3 <> 0 then 'Officer' else '' end as designation,
 case when o_orderkey % 4 <> 0 then o_orderdate end as order_date, case when o_orderkey % 6 = 0 then 'Delhi' end as place, o_custkey % 20 as query_id from orders)"""


def metadata(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        k.alias("version"), (c % 7 / 10).alias("confidence"), F.when(k % 5 != 0, F.concat(F.lit("Name "), c % 11)).alias("name"), F.when(k % 3 != 0, "Officer").otherwise("").alias("designation"),
        F.when(k % 4 != 0, F.col("o_orderdate")).alias("order_date"), F.when(k % 6 == 0, "Delhi").alias("place"))


def asked_versions(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("query_id"), F.col("o_orderkey").alias("version"))


@query(f"""with {_META}, u as (select *, row_number() over (partition by query_id order by confidence desc, version) as rn from m where name is not null or designation <> ''),
s as (select *, case when name is not null and designation <> '' then 'The order was signed by ' || name || ', ' || designation when name is not null then 'The extracted signatory for the order is ' || name else 'The extracted signatory designation for the order is ' || designation end as who from u where rn = 1)
select query_id, version, who || case when order_date is not null then '; date: ' || strftime(order_date, '%Y-%m-%d') else '' end || case when place is not null then '; place: ' || place else '' end || '.' as answer from s""")
def signatory_answers(spark, d):
    return matters.signatory_answers(asked_versions(spark, d), metadata(spark, d))


@query(f"""with {_META}, u as (select *, row_number() over (partition by query_id order by confidence desc, version) as rn from m where order_date is not null)
select query_id, version, 'The order date recorded for this matter is ' || strftime(order_date, '%Y-%m-%d') || '.' as answer from u where rn = 1""")
def date_answers(spark, d):
    return matters.date_answers(asked_versions(spark, d), metadata(spark, d))


@query("""select l_orderkey, coalesce(case when o_orderkey % 3 <> 0 then o_orderdate end, l_shipdate) as order_date from (select l_orderkey, min(l_shipdate) as l_shipdate from lineitem group by 1) left join orders on l_orderkey = o_orderkey""")
def dated_versions(spark, d):
    versions = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("order_date"))
    meta = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("meta_date"))
    return matters.dated(versions, meta, "l_orderkey").select("l_orderkey", "order_date")


@query(f"with {_STAFF} select c_custkey from g where (lower(department_name) = 'legal' or lower(replace(office_name, '_', ' ')) = 'legal' or c_custkey % 4 = 0) and designation_group = 'assistant_manager'")
def people_filtered(spark, d):
    rows = staff(spark, d).withColumn("department_aliases", F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("Law"), F.lit("LEGAL"))))
    return matters.filter_people(rows, F.lit(" legal "), F.lit("assistant_manager")).select("c_custkey")


@query("""with p as (select s_suppkey as person_id, 'E-' || s_suppkey as staff_no from supplier), a as (select c_custkey as query_id, 'e ' || c_custkey % 40 as staff_no from customer where c_custkey % 50 = 0 or c_custkey < 30),
q as (select query_id, regexp_replace(staff_no, '[^a-z0-9]', '', 'g') as no from a), own as (select query_id, person_id from q join p on no = regexp_replace(lower(staff_no), '[^a-z0-9]', '', 'g')),
r as (select n_nationkey as k, 'e' || n_nationkey % 13 as no from nation), m as (select query_id, person_id from q join r using (no) join p on person_id % 25 = k) select distinct query_id, person_id from (select * from own union all select * from m)""")
def staff_lookup(spark, d):
    s, n, c = F.col("s_suppkey"), F.col("n_nationkey"), F.col("c_custkey")
    persons = table(spark, d, "supplier").select(s.alias("person_id"), F.concat(F.lit("E-"), s).alias("staff_no"), F.array(F.concat(F.lit("r"), s % 25), F.lit("x")).alias("row_keys"))
    raw = table(spark, d, "nation").select(F.concat(F.lit("r"), n).alias("row_key"), F.concat(F.lit("E"), n % 13).alias("staff_no"))
    asked = table(spark, d, "customer").where((c % 50 == 0) | (c < 30)).select(c.alias("query_id"), F.concat(F.lit("e "), c % 40).alias("staff_no"))
    return matters.staff_lookup(asked, raw, persons)


@query("""with c as (select o_custkey as session_id, o_orderkey // 100 as turn, l_linenumber + o_orderkey % 100 * 10 as place, o_orderkey * 10 + l_linenumber as chunk_id, l_suppkey as document_id, l_partkey % 9 as record_key, l_quantity > 40 as cited from lineitem join orders on l_orderkey = o_orderkey),
g as (select session_id, max(turn) as turn from c where cited group by 1), x as (select c.* from c join g using (session_id, turn)),
d as (select session_id, turn, string_agg(document_id, ',' order by p, document_id) as documents from (select session_id, turn, document_id, min(place) as p from x where cited group by all) group by all),
r as (select session_id, turn, string_agg(record_key, ',' order by p, record_key) as records, 'Record ' || arg_min(record_key, (p, record_key)) as primary_title from (select session_id, turn, record_key, min(place) as p from x where cited group by all) group by all),
e as (select session_id, turn, string_agg(chunk_id, ',' order by p) as cited_chunks from (select session_id, turn, chunk_id, min(place) as p from x where cited group by all) group by all),
k as (select session_id, turn, string_agg(chunk_id, ',' order by p) as chunks from (select session_id, turn, chunk_id, min(place) as p from x group by all) group by all)
select session_id, turn, documents, records, chunks, cited_chunks, primary_title from d join r using (session_id, turn) join k using (session_id, turn) join e using (session_id, turn)""")
def session_states(spark, d):
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    rows = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("session_id"), F.floor(F.col("o_orderkey") / 100).alias("turn"), (F.col("l_linenumber") + F.col("o_orderkey") % 100 * 10).alias("place"), (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"),
        F.col("l_suppkey").alias("document_id"), (F.col("l_partkey") % 9).alias("record_key"), F.concat(F.lit("Record "), F.col("l_partkey") % 9).alias("title"), (F.col("l_quantity") > 40).alias("cited"))
    state = matters.session_state(rows)
    return state.select("session_id", "turn", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(n) for c, n in (("document_ids", "documents"), ("record_keys", "records"), ("chunk_ids", "chunks"), ("cited_chunk_ids", "cited_chunks"))], "primary_title")


@query("""with h as (select l_suppkey % 4 as query_id, l_partkey as unit, max(l_discount) as score from lineitem group by all), r as (select *, row_number() over (partition by query_id order by score desc, unit) as rank from h) select query_id, unit, score, rank from r where rank <= 10""")
def best_of_variants(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 4).alias("query_id"), F.col("l_partkey").alias("unit"), F.col("l_discount").alias("score"))
    return matters.best_over_variants(rows, 10)


@query(f"""with {_CASES}, x as (select *, case when case_id % 13 = 0 then '' else 'c' || case_id end as name, coalesce(allowed_routes, []) as ar, coalesce(expected_keys, []) as ek, case when case_id % 4 = 0 then 'redteam' else issue_class end as class from c)
select case_id, array_to_string(list_filter([case when name = '' then 'case_id is required' end, case when query is null then name || ': query is required' end, case when must_abstain is true and must_clarify is true then name || ': cannot require both abstain and clarify' end,
 case when must_use_official_web is true and must_not_use_web is true then name || ': cannot require and forbid web usage' end, case when route_expected is not null and len(ar) > 0 and not list_contains(ar, route_expected) then name || ': route_expected must be one of the allowed routes' end,
 case when case_id % 3 = 0 and not (must_clarify is true and len(ek) > 0 and class is not distinct from 'redteam') then name || ': fact without a type' end, case when case_id % 3 = 0 and not (must_clarify is true and len(ek) > 0 and class is not distinct from 'redteam') then name || ': fact without a value' end], lambda e: e is not null), '; ') as errors from x""")
def case_errors(spark, d):
    rows = run_cases(spark, d).withColumn("n", F.col("case_id"))
    fact = lambda kind, number, said: F.struct(F.lit(kind).alias("type"), F.lit(number).cast("double").alias("number"), F.lit(said).cast("string").alias("said"))
    rows = rows.withColumns({"case_id": F.when(F.col("n") % 13 == 0, "").otherwise(F.concat(F.lit("c"), "n")), "issue_class": F.when(F.col("n") % 4 == 0, "redteam").otherwise(F.col("issue_class")), "facts": F.when(F.col("n") % 3 == 0, F.array(fact("amount", 1.0, None), fact(" ", None, ""), fact("x", None, "said")))})
    return matters.case_errors(rows).select(F.col("n").alias("case_id"), F.array_join("errors", "; ").alias("errors"))


@query(f"""with {_CASES} select case_id, case when answer_status = 'clarify' then 'clarify' when route_mode = 'structured_current_info' then 'structured current-info' when metadata_used is true and abstain_correct is true then 'explain provision' when metadata_used is true then 'metadata-first fact'
 when route_mode in ('current_official_lookup', 'historical_official_lookup', 'current_news_lookup') then 'current fact' when planner_used is true then 'SAT/court summary' when list_contains(tags, 'settlement_amount') or case_id % 7 = 0 then 'settlement-shaped answer' else 'brief summary' end as prompt_family from c""")
def prompt_families(spark, d):
    rows = run_cases(spark, d).withColumns({"asks_explanation": F.col("abstain_correct"), "court_style": F.col("planner_used"), "expected_buckets": F.when(F.col("case_id") % 7 == 0, F.array(F.lit("Settlement-Orders")))})
    return matters.prompt_family(rows).select("case_id", "prompt_family")


@query(f"""with {_CASES}, x as (select *, route_mode = route_expected as same, case when case_id % 2 = 0 then 'k' end as expected_key, case case_id % 3 when 0 then 'eval_query' when 1 then 'other' else 'wrong_answer_regression' end as case_kind from c)
select count(*) as total_cases, count(*) filter (where passed) as passed_cases, count(*) filter (where answer_status = 'answered') as answered_count, count(*) filter (where answer_status = 'clarify') as clarify_count, count(*) filter (where answer_status = 'abstained') as abstain_count,
 round(avg(case when same then 1.0 else 0.0 end) filter (where route_expected is not null), 4) as route_accuracy, round(avg(case when same or structured_info is true then 1.0 else 0.0 end) filter (where route_expected is not null), 4) as route_accuracy_equivalent,
 round(avg(case when strict_single is true then 1.0 else 0.0 end) filter (where expected_key is not null and case_kind <> 'other'), 4) as single_matter_accuracy, round(avg(case when same then 1.0 else 0.0 end) filter (where route_expected = 'structured_current_info'), 4) as structured_current_info_accuracy,
 count(*) filter (where strict_single is not true) as mixed_record_failures, count(*) filter (where current_news) as request_failures, count(*) filter (where general_web_attempted) as web_uses, count(*) filter (where candidate_list_used) as candidate_lists, round(avg(cast(passed as int)), 4) as pass_rate from x""")
def control_summary(spark, d):
    n = F.col("case_id")
    rows = run_cases(spark, d).withColumns({"equivalent_route": F.col("structured_info"), "expected_key": F.when(n % 2 == 0, "k"), "case_kind": F.when(n % 3 == 0, "eval_query").when(n % 3 == 1, "other").otherwise("wrong_answer_regression"), "single_matter_respected": F.col("strict_single"), "request_failed": F.col("current_news"), "web_used": F.col("general_web_attempted")})
    return matters.control_summary(rows)


@query(f"with {_FAILED} select case when case_id % 9 = 0 then 'unclassified' else primary_failure_bucket end as triage_bucket, count(*) as n from z where passed is not true or stale_expectation group by 1")
def triage_counts(spark, d):
    rows = judged(spark, d).withColumn("triage_bucket", F.when(F.col("case_id") % 9 != 0, F.col("primary_failure_bucket")).when(F.col("case_id") % 2 == 0, ""))
    return matters.triage_counts(rows)


_DAYS = "strftime(o_orderdate, '%B ') || cast(strftime(o_orderdate, '%d') as int) || strftime(o_orderdate, ', %Y')"


def priced_pages(spark, d):
    """Pages and chunks that state an order's numbers in the forms that matters use."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "MMMM d, yyyy")
    n = lambda by: (F.floor(F.col("o_totalprice") / by)).cast("string")
    head = F.concat(F.lit("Post listing on "), day, F.lit(" at the price of Rs."), n(100), F.lit("/share the scrip  was\nactive. It increased by "), (k % 50).cast("string"), F.lit(".5% during the period "), day, F.lit(" to March 3, 2021 and closed at Rs. "), n(10), F.lit(". "))
    more = F.concat(F.lit("The highest price of Rs."), n(1), F.when(k % 2 == 0, F.concat(F.lit(", which is "), k % 300, F.lit("% of the listing price,"))).otherwise(""), F.lit(" on "), day, F.lit(". A low price of Rs. "), n(1000), F.when(k % 3 == 0, F.concat(F.lit(" on "), day)).otherwise(""), F.lit(" was seen.\nNo. Name PAN\n"), k % 9, F.lit(" Person "), k % 7, F.lit(" - abcde1234f rest\nABCDE1234F alone"))
    rows = table(spark, d, "orders").select(k.alias("doc"), F.concat(F.lit("Final order in the matter of Co "), k % 5, F.lit(" (X) ")).alias("title"), F.lit(1).alias("page"), F.concat(head, more).alias("body"))
    chunk = F.concat(F.lit("The settlement amount is Rs. "), n(1), F.lit(" in all. A penalty of "), k % 90, F.lit(" lakh and fees of INR "), n(10), F.lit(" were paid. Its shareholding was "), n(1), F.lit(" shares or "), k % 100, F.lit("%."))
    chunks = table(spark, d, "orders").select(k.alias("doc"), F.concat(F.lit("Co "), k % 5).alias("title"), F.lit(2).alias("page_start"), F.lit(3).alias("page_end"), chunk.alias("body"))
    moves = table(spark, d, "orders").where(k % 2 == 1).select(k.alias("doc"), F.lit("S").alias("subject"), F.lit("P1").alias("label"), F.when(k % 3 == 0, "a").alias("from_text"), F.lit("b").alias("to_text"), (k % 100 / 2).alias("start_price"), (k % 10).cast("double").alias("end_price"), F.when(k % 5 == 0, 7.25).alias("high_price"), F.lit(None).cast("double").alias("low_price"), F.lit(-1.5).alias("change"), F.lit(4).alias("page_start"), F.lit(4).alias("page_end"))
    return rows, chunks, moves


@query(f"""with o as (select o_orderkey as doc, {_DAYS} as day, cast(floor(o_totalprice) as bigint) as a, cast(floor(o_totalprice / 10) as bigint) as b, cast(floor(o_totalprice / 100) as bigint) as c, cast(floor(o_totalprice / 1000) as bigint) as e, 'Co ' || o_orderkey % 5 as s from orders),
f as (select doc, 'listing_price' as fact_type, s as subject, 'Rs.' || c || '/share' as value_text, c::double as value, 'INR/share' as unit, 'listed on ' || day as context, 1 as page_start, 1 as page_end from o
union all select doc, 'percentage_change', s, doc % 50 || '.5%', doc % 50 + 0.5, 'percent', day || ' to March 3, 2021', 1, 1 from o
union all select doc, 'closing_price', s, 'Rs.' || b, b, 'INR', 'on March 3, 2021', 1, 1 from o
union all select doc, 'highest_price', s, 'Rs.' || a, a, 'INR', 'on ' || day, 1, 1 from o
union all select doc, 'percentage_change_from_listing', s, doc % 300 || '%', doc % 300, 'percent', 'highest price on ' || day, 1, 1 from o where doc % 2 = 0
union all select doc, 'lowest_price', s, 'Rs.' || e, e, 'INR', case when doc % 3 = 0 then 'on ' || day end, 1, 1 from o
union all select doc, 'pan', 'Person ' || doc % 7, 'ABCDE1234F', null, 'PAN', null, 1, 1 from o
union all select doc, 'settlement_amount', s, 'Rs. ' || a, a, 'INR', 'The settlement amount is Rs. ' || a || ' in all', 2, 3 from o
union all select doc, 'penalty_amount', s, doc % 90 || ' lakh', doc % 90 * 100000.0, 'INR_lakh', 'A penalty of ' || doc % 90 || ' lakh and fees of INR ' || b || ' were paid', 2, 3 from o
union all select doc, 'penalty_amount', s, 'INR ' || b, b, 'INR', 'A penalty of ' || doc % 90 || ' lakh and fees of INR ' || b || ' were paid', 2, 3 from o
union all select doc, 'fee_amount', s, doc % 90 || ' lakh', doc % 90 * 100000.0, 'INR_lakh', 'A penalty of ' || doc % 90 || ' lakh and fees of INR ' || b || ' were paid', 2, 3 from o
union all select doc, 'fee_amount', s, 'INR ' || b, b, 'INR', 'A penalty of ' || doc % 90 || ' lakh and fees of INR ' || b || ' were paid', 2, 3 from o
union all select doc, 'share_count', s, a || ' shares', a, 'shares', 'Its shareholding was ' || a || ' shares or ' || doc % 100 || '%', 2, 3 from o
union all select doc, 'holding_percentage', s, doc % 100 || '%', doc % 100, 'percent', 'Its shareholding was ' || a || ' shares or ' || doc % 100 || '%', 2, 3 from o
union all select doc, 'period_start_price', 'S', 'Rs.' || regexp_replace(cast(doc % 100 / 2 as varchar), '\\.0$', ''), doc % 100 / 2, 'INR', 'P1' || case when doc % 3 = 0 then ' | a to b' else '' end, 4, 4 from o where doc % 2 = 1
union all select doc, 'period_high_price', 'S', 'Rs.7.25', 7.25, 'INR', 'P1' || case when doc % 3 = 0 then ' | a to b' else '' end, 4, 4 from o where doc % 2 = 1 and doc % 5 = 0
union all select doc, 'period_end_price', 'S', 'Rs.' || doc % 10, doc % 10, 'INR', 'P1' || case when doc % 3 = 0 then ' | a to b' else '' end, 4, 4 from o where doc % 2 = 1
union all select doc, 'period_pct_change', 'S', '-1.5%', -1.5, 'percent', 'P1' || case when doc % 3 = 0 then ' | a to b' else '' end, 4, 4 from o where doc % 2 = 1)
select * from f""")
def numeric_facts(spark, d):
    return numbers.numeric_facts(*priced_pages(spark, d))


@query("""with f as (select o_orderkey as place, o_custkey % 30 as query_id, o_custkey % 4 as record, case when o_custkey % 4 <> 3 or o_orderkey % 6 < 2 then ['listing_price', 'closing_price', 'percentage_change', 'highest_price', 'percentage_change_from_listing', 'pan'][o_orderkey % 6 + 1] end as fact_type,
 case when o_orderkey % 11 = 0 then null else 'v' || o_orderkey % 100 end as value_text, case when o_orderkey % 7 = 0 then null when o_orderkey % 3 = 0 then 'on May 1' else 'May' end as context from orders),
s as (select query_id, record, sum(case when fact_type in ('listing_price', 'closing_price', 'percentage_change', 'highest_price') then 2 else 1 end) as p from f group by all), b as (select query_id, record from (select *, row_number() over (partition by query_id order by p desc, record) as rn from s) where rn = 1),
x as (select query_id, record, fact_type, arg_min(coalesce(value_text, 'the cited figure'), place) as said, arg_min(coalesce(context, ''), place) as context from f join b using (query_id, record) group by all),
p as (select query_id, record, max(said) filter (where fact_type = 'listing_price') as l, max(context) filter (where fact_type = 'listing_price') as lc, max(said) filter (where fact_type = 'closing_price') as c, max(context) filter (where fact_type = 'closing_price') as cc,
 max(said) filter (where fact_type = 'percentage_change') as d, max(said) filter (where fact_type = 'highest_price') as h, max(context) filter (where fact_type = 'highest_price') as hc, max(said) filter (where fact_type = 'percentage_change_from_listing') as k from x group by all),
t as (select *, case when lc <> '' then ' ' || lc else '' end as lt, case when hc <> '' then ' ' || hc else '' end as ht, case when cc = '' then '' when starts_with(cc, 'on ') then ' ' || cc else ' for ' || cc end as ct, case when k is not null then ', which was ' || k || ' of the listing price' else '' end as kt from p)
select query_id, record, case when l is not null and d is not null then 'The share price increased by ' || d || case when c is not null then ', from ' || l || lt || ' to ' || c || ct else '' end || '.' || case when h is not null then ' It also reached a high of ' || h || ht || kt || '.' else '' end end as increase,
 case when h is not null then 'The highest price recorded in this matter was ' || h || ht || kt || '.' end as highest, case when l is not null then 'The listing price recorded in this matter was ' || l || lt || '.' end as listing from t""")
def price_answers(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kinds = F.array(*map(F.lit, ("listing_price", "closing_price", "percentage_change", "highest_price", "percentage_change_from_listing", "pan")))
    rows = table(spark, d, "orders").select(
        k.alias("at"), (c % 30).alias("query_id"), (c % 4).alias("record"), F.when((c % 4 != 3) | (k % 6 < 2), F.element_at(kinds, (k % 6 + 1).cast("int"))).alias("fact_type"), F.when(k % 11 != 0, F.concat(F.lit("v"), k % 100)).alias("value_text"),
        F.lit(None).cast("double").alias("value"), F.when(k % 7 == 0, None).when(k % 3 == 0, "on May 1").otherwise("May").alias("context"))
    return numbers.price_answers(rows)


@query("""with m as (select s_nationkey as query_id, s_suppkey % 3 as record, 'Period ' || s_suppkey as label, case when s_suppkey % 2 = 0 then 'a' end as f, s_suppkey % 40 / 2 as s, s_suppkey % 5 as h, s_suppkey % 7 - 3 as c, s_suppkey as k from supplier),
b as (select query_id, record from (select *, row_number() over (partition by query_id order by n desc, record) as rn from (select query_id, record, count(*) as n from m group by all)) where rn = 1),
t as (select m.*, label || case when f is not null then ' (a to b)' else '' end || ' : start Rs.' || regexp_replace(cast(s as varchar), '\\.0$', '') || case when k % 3 = 0 then ', high Rs.' || h else '' end || ', end Rs.8.25, ' || case when c > 0 then '+' else '' end || c || '%' as line from m join b using (query_id, record))
select query_id, record, string_agg(line, ' ' order by k) as answer from t group by all""")
def period_answers(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("query_id"), (k % 3).alias("record"), F.concat(F.lit("Period "), k).alias("label"), F.when(k % 2 == 0, "a").alias("from_text"), F.lit("b").alias("to_text"), (k % 40 / 2).alias("start_price"),
        F.when(k % 3 == 0, (k % 5).cast("double")).alias("high_price"), F.lit(None).cast("double").alias("low_price"), F.lit(8.25).alias("end_price"), (k % 7 - 3).cast("double").alias("change"))
    return numbers.period_answers(rows)


@query(f"""with {_CASES}, x as (select case_id, lower(trim(query)) as q, coalesce(expected_keys, [])[1] as record_key from c), i as (select 'a' as record_key, 'Alpha' as title), d as (select * from (values ('income of y', 'numeric'), ('tell me more', 'follow up')) t(q, dumped_bucket))
select case_id, record_key, title, dumped_bucket from x left join i using (record_key) left join d using (q)""")
def annotated_cases(spark, d):
    index = spark.createDataFrame([("a", "Alpha")], "record_key string, title string")
    dump = spark.createDataFrame([("Income of Y", "wrong route"), (" income of y ", "numeric"), ("Tell me more", "follow up")], "query string, bucket string")
    return matters.annotated(run_cases(spark, d), index, dump).select("case_id", "record_key", "title", "dumped_bucket")


@query("""select c_custkey, v.o_orderkey as version, n.l_linenumber as node from customer left join orders v on c_custkey * 4 = v.o_orderkey left join (select l_orderkey, max(l_linenumber) as l_linenumber from lineitem group by 1) n on n.l_orderkey = v.o_orderkey""")
def current_versions(spark, d):
    documents = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 4).alias("current_id"))
    versions = table(spark, d, "orders").select(F.col("o_orderkey").alias("version"))
    nodes = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("version")).agg(F.max("l_linenumber").alias("node"))
    return matters.current_rows(documents, versions, nodes, "c_custkey", "version").select("c_custkey", "version", "node")


@query("""with t as (select p_partkey as k, p_name as title, unnest([p_brand, p_type]) as entity, p_size from part)
select entity, string_agg(distinct k, ',' order by k) as keys, count(distinct title) as titles, coalesce(string_agg(distinct p_size, ',' order by p_size) filter (where p_size % 3 = 0), '') as variants from t group by entity""")
def entity_aliases(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("record_key"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("entities"), F.when(F.col("p_size") % 3 == 0, F.array("p_size")).alias("variants"))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return matters.alias_rows(rows).select("entity", join("record_keys").alias("keys"), F.size("titles").cast("long").alias("titles"), join("variants").alias("variants"))


@query("select n_nationkey from nation where n_name = 'NATION_7'")
def offices_of_city(spark, d):
    return matters.same_city(table(spark, d, "nation").withColumn("city", F.col("n_name")), F.lit(" Nation 7. ")).select("n_nationkey")


@query("""with v as (select o_orderkey as version, o_custkey % 50 as record_key, o_custkey as document_id from orders where o_orderstatus = 'F'), s as (select s_suppkey as session_id, s_suppkey % 3 as k from supplier)
select session_id, session_id * 10 as version from s where k = 0 union select session_id, version from s join v on record_key = session_id % 50 where k = 1 union select session_id, version from s join v on document_id = session_id where k = 2""")
def memory_scopes(spark, d):
    s = F.col("s_suppkey")
    states = table(spark, d, "supplier").select(s.alias("session_id"), F.when(s % 3 == 0, F.array(s * 10)).alias("version_ids"), F.when(s % 3 < 2, F.array(s % 50)).alias("record_keys"), F.when(s % 3 != 1, F.array(s)).alias("document_ids"))
    versions = table(spark, d, "orders").select(F.col("o_orderkey").alias("version"), (F.col("o_custkey") % 50).alias("record_key"), F.col("o_custkey").alias("document_id"), (F.col("o_orderstatus") == "F").alias("current"))
    return matters.memory_scope(states, versions)
