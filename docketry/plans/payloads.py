"""Queries of embedding texts, query expansion and small functions, with SQL that writes every value out."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import scoring, text
from docketry.operators import facts, failures, payloads, search
from docketry.plans.catalog import query
from docketry.session import table

TITLES = ["Order in RTI matter", "Settlement Order of X", "ADJUDICATION ORDER", "Appeal by Y", "Final Order", "Ex-Parte Interim Order", "Confirmatory order", "exemption order", "Enquiry Order", "Revocation Order", "Other paper", ""]


def picked(values: list, key: str, step: int = 1):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.floor(F.col(key) / step) % len(values) + 1).cast("int"))


@query("""with d as (select doc_id, ['Order in RTI matter', 'Settlement Order of X', 'ADJUDICATION ORDER', 'Appeal by Y', 'Final Order', 'Ex-Parte Interim Order', 'Confirmatory order', 'exemption order', 'Enquiry Order', 'Revocation Order', 'Other paper', ''][doc_id % 12 + 1] as title,
 ['orders-of-court', 'appellate-authority', ''][doc_id // 12 % 3 + 1] as bucket, case doc_id // 36 % 3 when 0 then 'Final Order Facts' when 1 then 'Facts' else '' end as heads from documents),
s as (select *, lower(title || ' ' || bucket || ' ' || heads) as t from d)
select doc_id, case when contains(t, 'rti') or contains(t, 'appellate authority') then 'rti appeal order' when contains(t, 'settlement order') then 'settlement order' when contains(t, 'adjudication order') then 'adjudication order' when contains(t, 'appeal') then 'appeal order'
 when contains(t, 'final order') then 'final order' when contains(t, 'interim order') then 'interim order' when contains(t, 'confirmatory order') then 'confirmatory order' when contains(t, 'exemption order') then 'exemption order' when contains(t, 'enquiry order') then 'enquiry order'
 when contains(t, 'revocation order') then 'revocation order' when bucket <> '' then replace(bucket, '-', ' ') end as procedural_type from s""")
def procedural_types(spark, d):
    heads = F.element_at(F.array(F.array(F.lit("Final Order"), F.lit("Facts")), F.array(F.lit("Facts")), F.array().cast("array<string>")), (F.floor(F.col("doc_id") / 36) % 3 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", payloads.procedural_type(picked(TITLES, "doc_id"), picked(["orders-of-court", "appellate-authority", ""], "doc_id", 12), heads).alias("procedural_type"))


@query("""with h as (select source, doc_id, trim(regexp_replace(coalesce(nullif(['Order', 'order', 'Facts  of it', '', null][doc_id % 5 + 1], ''), lang), '[ \\t]+', ' ', 'g')) as heading from documents),
g as (select source, lower(heading) as low, arg_min(heading, doc_id) as heading, min(doc_id) as place from h where heading <> '' group by all),
r as (select *, row_number() over (partition by source order by place, low) as rn from g) select source, string_agg(heading, '; ' order by rn) as headings from r where rn <= 3 group by source""")
def major_headings(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", picked(["Order", "order", "Facts  of it", "", None], "doc_id").alias("section_title"), F.col("lang").alias("heading_path"), F.lit("other").alias("section_type"))
    return payloads.major_headings(rows, "source", "doc_id", 3).select("source", F.array_join("headings", "; ").alias("headings"))


@query("""select conv_id, turn, 'Section type: ' || role || case when turn % 2 = 0 then chr(10) || 'Section title: Part ' || turn else '' end || case when turn % 3 = 0 then '' else chr(10) || 'Heading path: A > B' end
|| chr(10) || chr(10) || regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') as payload from conversations""")
def chunk_payloads(spark, d):
    title = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Part "), F.col("turn")))
    path = F.when(F.col("turn") % 3 == 0, title).otherwise("A > B")
    return table(spark, d, "conversations").select("conv_id", "turn", payloads.chunk_text(F.col("role"), title, path, F.col("text")).alias("payload"))


@query("""with c as (select conv_id, list(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') order by turn, role, text) as bodies, min(turn) as a, max(turn) as b from conversations group by conv_id)
select conv_id, regexp_replace('Document title: Talk ' || conv_id || chr(10) || 'Bucket: talks' || chr(10) || 'Record key: k' || conv_id || chr(10) || 'Section key: s' || chr(10) || 'Section type: facts' || case when conv_id % 2 = 0 then chr(10) || 'Section title: T' else '' end
 || chr(10) || 'Page range: ' || a || '-' || b || chr(10) || 'Section text:' || chr(10) || array_to_string(list_filter(bodies, lambda x: x <> ''), chr(10) || chr(10)), '\\s+$', '') as payload from c""")
def section_payloads(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))).alias("bodies"), F.min("turn").alias("a"), F.max("turn").alias("b"))
    title = F.when(F.col("conv_id") % 2 == 0, "T")
    return rows.select("conv_id", payloads.section_text(F.concat(F.lit("Talk "), "conv_id"), F.lit("talks"), F.concat(F.lit("k"), "conv_id"), F.lit("s"), F.lit("facts"), title, F.lit(""), F.col("a"), F.col("b"), F.col("bodies")).alias("payload"))


@query("""select o_orderkey, 'Document title: Final Order ' || o_orderkey || chr(10) || 'Bucket: ' || lower(o_orderpriority) || chr(10) || 'Record key: r' || o_orderkey || case when o_orderkey % 4 <> 0 then chr(10) || 'Order date: ' || strftime(o_orderdate, '%Y-%m-%d') else '' end
 || case when o_orderkey % 3 = 0 then chr(10) || 'External record id: x' || o_orderkey else '' end || chr(10) || 'Procedural type: final order' || case when o_orderkey % 2 = 0 then chr(10) || 'Major headings: Facts; Order' else '' end
 || case when o_orderkey % 5 = 0 then chr(10) || 'Opening lines:' || chr(10) || '- It was heard today.' || chr(10) || '- It was held.' else '' end as payload from orders""")
def document_payloads(spark, d):
    key = F.col("o_orderkey")
    lines = lambda *x: F.array(*map(F.lit, x))
    made = payloads.document_text(F.concat(F.lit("Final Order "), key), F.lower("o_orderpriority"), F.concat(F.lit("r"), key), F.when(key % 4 != 0, F.col("o_orderdate")), F.when(key % 3 == 0, F.concat(F.lit("x"), key)), F.when(key % 2 == 0, lines("Facts", "Order")), F.when(key % 5 == 0, lines("It was heard today.", "It was held.")))
    return table(spark, d, "orders").select("o_orderkey", made.alias("payload"))


@query("""select conv_id, turn, array_to_string(list_reverse(list_reverse(regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7f]', '*', 'g'), '[0-9A-Za-z_]+|[^\\sA-Za-z0-9_]'))[1:5]), '') as tail from conversations""")
def last_tokens(spark, d):
    tail = payloads.last_tokens(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7f]", "*"), 5)
    return table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(tail, r"\s+", "").alias("tail"))


QUESTIONS = ["  Who are the WTMs and EDs? ", "assistantmanager list", "PFUTP and PIT in SAT", "the ed of the enforcement wing", "chairman's scn", "ED order", "plain words", "", None]


@query("""select c_custkey, ['who are the wtms and eds? | who are the whole time member and eds? | who are the whole time member and executive director?', 'assistant manager list', 'pfutp and pit in sat', 'the ed of the enforcement wing | the executive director of the enforcement wing',
 'chairman''s scn | chairperson''s scn', 'ed order | executive director order', 'plain words', '', ''][c_custkey % 9 + 1] as current,
 ['who are the wtms and eds? | who are the whole time member and eds? | who are the whole time member and executive director?', 'assistant manager list',
 'pfutp and pit in sat | pfutp regulations and pit in sat | pfutp regulations and pit regulations in sat | pfutp regulations and pit regulations in securities appellate tribunal', 'the ed of the enforcement wing | the enforcement department of the enforcement wing',
 'chairman''s scn | chairperson''s scn | chairperson''s show cause notice', 'ed order | executive director order', 'plain words', '', ''][c_custkey % 9 + 1] as legal from customer""")
def query_expansion(spark, d):
    asked = picked(QUESTIONS, "c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.array_join(payloads.expanded(asked, ("current_people", "current_offices")), " | ").alias("current"), F.array_join(payloads.expanded(asked, ("order_legal",)), " | ").alias("legal"))


@query("""select s_suppkey, ['whole_time_member', 'general_manager', null, null, 'assistant_manager', 'staff', 'deputy_general_manager', null, 'chairperson', 'board_member', null][s_suppkey % 11 + 1] as asked_group from supplier""")
def asked_groups(spark, d):
    said = ["WTM", "GMs", "Managers in Delhi", "boss", "AM list", "staff", "DGM", "", "chairmans", "Board Members", None]
    return table(spark, d, "supplier").select("s_suppkey", payloads.asked_group(picked(said, "s_suppkey")).alias("asked_group"))


@query("""select doc_id, case doc_id % 4 when 0 then 'x' || doc_id when 1 then substr(sha256(cast(doc_id as varchar)), 1, 16) when 2 then substr(sha256('external:'), 1, 16) else substr(sha256('k' || doc_id), 1, 16) end as record_id from documents""")
def record_ids(spark, d):
    n = F.col("doc_id")
    key = F.when(n % 4 == 0, F.concat(F.lit("external:x"), n)).when(n % 4 == 1, F.concat(F.lit("derived:"), F.sha2(n.cast("string"), 256))).when(n % 4 == 2, "external:").otherwise(F.concat(F.lit("k"), n))
    return table(spark, d, "documents").select("doc_id", text.record_id(key).alias("record_id"))


@query("""select page_id, [2021, 2019, 2020, 0, 1999][page_id % 5 + 1] as year, [3, 8, 0, 0, 0][page_id % 5 + 1] as month, [9, 0, 0, 0, 0][page_id % 5 + 1] as day from pages""")
def url_dates(spark, d):
    tail = picked(["/2021-03-09", "/AUG-2019/x", "/x2020y/", "/320201/", "?y=1999"], "page_id")
    made = text.url_date(F.concat(F.lit("https://a.example.org"), tail))
    return table(spark, d, "pages").select("page_id", made.alias("m")).select("page_id", "m.year", "m.month", "m.day")


@query("""select event_id, ['a; b; 5', '', '', '{"k": 1}', 'not json', '[broken', 'x'][event_id % 7 + 1] as found from events""")
def json_lists(spark, d):
    said = ['["a", null, "b", "", 5]', "", None, '{"k": 1}', "not json", "[broken", '["x"]']
    return table(spark, d, "events").select("event_id", F.array_join(text.json_items(picked(said, "event_id")), "; ").alias("found"))


@query("""select doc_id, ['0', '1', '2', '3', '4', '5', '6', '7', '8', '9', '10', '11', '11', '2'][doc_id % 14 + 1]::int as priority from documents""")
def comparison_order(spark, d):
    names = ["operative_order", "directions", "findings", "facts", "background", "issues", "reply_or_submissions", "table_block", "annexure", "other", "header", "show_cause_notice", None, " Findings "]
    return table(spark, d, "documents").select("doc_id", scoring.comparison_priority(picked(names, "doc_id")).cast("int").alias("priority"))


@query("""with e as (select event_id, event_id % 3 = 0 as used, event_id % 2 = 0 as clarify, event_id // 6 % 3 as w, event_id // 18 % 3 as g from events)
select event_id, case when not used then case when clarify then 0.0 else 1.0 end when w = 0 then [1.0, 0.5, 0.0][g + 1] when w = 1 then [0.5, 0.0, 0.0][g + 1] else 1.0 end::double as correctness from e""")
def candidate_correctness(spark, d):
    n = F.col("event_id")
    arrays = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    w, g = F.floor(n / 6) % 3, F.floor(n / 18) % 3
    rows = table(spark, d, "events").select(
        "event_id", (n % 3 == 0).alias("candidate_list_used"), (n % 2 == 0).alias("must_clarify"), F.when(w == 0, arrays("a", "b")).alias("expected_keys"), F.when(w == 1, arrays("p", "q")).alias("expected_buckets"),
        F.when(g == 0, arrays(" a", "b ", "")).when(g == 1, arrays("b", "z")).alias("candidate_keys"), F.when(g == 0, arrays("q")).alias("candidate_buckets"))
    return failures.candidate_list(rows).select("event_id", F.col("candidate_list_correctness").alias("correctness"))


@query("""with w as (select conv_id, turn, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) as n, turn % 2 = 0 as gold from conversations),
r as (select *, case when gold then case when n >= 10 then 0.8 else 0.6 end else case when n >= 20 then 0.7 else 0.45 end end::double as reasoning, case when n between 8 and 180 then 1.0 else 0.7 end::double as summary from w)
select conv_id, turn, case when n > 0 then reasoning end as reasoning, case when n > 0 then summary end as summary, case when n > 0 then round((2 * reasoning + summary) / 3, 4) end as open_ended from r""")
def reasoning_quality(spark, d):
    made = failures.reasoning_by_length(F.col("text"), F.when(F.col("turn") % 2 == 0, "gold_fact").otherwise("open_ended"))
    return table(spark, d, "conversations").select("conv_id", "turn", made.alias("m")).select("conv_id", "turn", "m.reasoning", "m.summary", "m.open_ended")


@query("""select l_partkey % 7 as statute, string_agg(distinct cast(l_linenumber as varchar), ', ' order by cast(l_linenumber as varchar)) as refs from lineitem group by 1""")
def provisions_by_statute(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 7).alias("statute"), F.col("l_linenumber").cast("string").alias("reference"), F.col("l_linenumber").alias("at"))
    return facts.by_statute(rows).select("statute", F.array_join("references", ", ").alias("refs"))


_FULL = """h as (select doc_id as unit, doc_id % 3 as k, ['Settlement of Foo Bar', 'Foo and others', 'In re Baz', ''][doc_id % 4 + 1] as name, case when doc_id % 5 = 0 then 'settlement-orders' else 'orders' end as bucket, source as record, doc_id % 2 = 0 as focused,
 ['operative_order', 'directions', 'findings', 'issues', 'reply_or_submissions', 'background', 'facts', 'show_cause_notice', 'other', 'table_block', 'annexure', 'header', 'unknown'][doc_id % 13 + 1] as section,
 ['substantive', 'party_or_title', 'regulation', 'generic'][doc_id // 13 % 4 + 1] as intent, 1.0::double / (60 + n_chars % 100) as score, lower(text) as body, n_chars,
 ['it is so.', 'the settlement amount was remitted by them and received', 'settlement order in respect of x'][doc_id // 4 % 3 + 1] as said, doc_id // 12 % 2 = 0 as long from documents),
f as (select *, case when not focused then 1.0 when name = '' then 1.0 when name = 'Settlement of Foo Bar' then 1.18 when name = 'Foo and others' then 1.06 else 0.96 end as align,
 case when focused and bucket = 'settlement-orders' then 1.12 else 1.0 end as in_bucket, case when record = 'src1' then 1.45 else 0.62 end as lock, case when record in ('src2', 'src3') then 0.08 else 1.0 end as confusion,
 case section when 'operative_order' then 1.35 when 'directions' then 1.30 when 'findings' then 1.25 when 'issues' then 1.15 when 'reply_or_submissions' then 1.05 when 'show_cause_notice' then 0.98 when 'other' then 0.92 when 'table_block' then 0.90 when 'annexure' then 0.88 when 'header' then 0.70 else 1.0 end as prior,
 case intent || ':' || section when 'substantive:operative_order' then 1.20 when 'substantive:directions' then 1.18 when 'substantive:findings' then 1.15 when 'substantive:issues' then 1.08 when 'substantive:reply_or_submissions' then 1.03 when 'substantive:background' then 0.98
  when 'substantive:facts' then 0.98 when 'substantive:show_cause_notice' then 0.96 when 'substantive:other' then 0.92 when 'substantive:table_block' then 0.92 when 'substantive:annexure' then 0.90 when 'substantive:header' then 0.75
  when 'party_or_title:operative_order' then 0.94 when 'party_or_title:directions' then 0.94 when 'party_or_title:findings' then 0.95 when 'party_or_title:issues' then 0.96 when 'party_or_title:reply_or_submissions' then 0.98 when 'party_or_title:show_cause_notice' then 0.98
  when 'party_or_title:other' then 1.05 when 'party_or_title:table_block' then 0.95 when 'party_or_title:annexure' then 0.94 when 'party_or_title:header' then 2.00
  when 'regulation:directions' then 0.98 when 'regulation:findings' then 1.06 when 'regulation:issues' then 1.10 when 'regulation:reply_or_submissions' then 1.02 when 'regulation:background' then 1.04 when 'regulation:facts' then 1.04 when 'regulation:show_cause_notice' then 1.01
  when 'regulation:table_block' then 0.92 when 'regulation:annexure' then 0.95 when 'regulation:header' then 0.94 else 1.0 end as by_intent,
 case when not focused then 1.0 when said like 'settlement order%' and not long and section in ('header', 'operative_order') then 0.72 when said like 'the settlement amount%' and long then 1.10 else 1.0 end as content from h)"""


@query(f"with {_FULL} select unit, section, intent, round(greatest(score * align * in_bucket * lock * confusion * prior * by_intent * content, 0), 9) as final from f")
def rerank_full(spark, d):
    n = F.col("doc_id")
    said = picked(["It is so.", "The settlement amount was remitted by them and received", "Settlement Order in respect of X"], "doc_id", 4)
    body = F.when(F.floor(n / 12) % 2 == 0, F.concat(F.repeat(F.lit("word "), 30), said)).otherwise(said)
    sections = ["operative_order", "directions", "findings", "issues", "reply_or_submissions", "background", "facts", "show_cause_notice", "other", "table_block", "annexure", "header", "unknown"]
    rows = table(spark, d, "documents").select(
        n.alias("unit"), picked(["Settlement of Foo Bar", "Foo and others", "In re Baz", ""], "doc_id").alias("name"), F.when(n % 5 == 0, "settlement-orders").otherwise("orders").alias("bucket"), F.col("source").alias("record"), (n % 2 == 0).alias("focused"),
        F.array(F.lit("foo"), F.lit("bar")).alias("terms"), picked(sections, "doc_id").alias("section"), picked(["substantive", "party_or_title", "regulation", "generic"], "doc_id", 13).alias("intent"), (1.0 / (60 + F.col("n_chars") % 100)).alias("score"), body.alias("body"), F.lit("").alias("title"), F.lit("").alias("heading"))
    pairs = spark.createDataFrame([("src1", "src2"), ("src3", "src1"), ("src0", "src4")], "a string, b string")
    return search.adjusted(rows, True, ["src1"], pairs).select("unit", "section", "intent", "final")
