"""Queries of the catalogue: aggregates, windows, set operations, upserts, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import text
from docketry.operators import catalogue, facts, relational, segmentation
from docketry.session import table
from docketry.sources import manifest
from docketry.streaming import events as streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def lines(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query("select count(*) as n_rows, cast(sum(n_chars) as bigint) as total_chars, round(avg(n_chars), 6) as avg_chars, round(quantile_cont(n_chars, 0.5), 6) as median_chars, min(n_chars) as min_chars, max(n_chars) as max_chars from documents")
def corpus_aggregates(spark, d):
    return relational.describe(table(spark, d, "documents"), "n_chars", "chars")


@query("""with p as (select source, doc_id, unnest(string_split(text, chr(10))) as line from documents),
a as (select source, count(*) as n_docs, cast(sum(n_chars) as bigint) as n_chars from documents group by source),
b as (select source, count(*) as n_parts, count(distinct doc_id) as docs_with_parts from p group by source)
select source, n_docs, n_chars, coalesce(n_parts, 0) as n_parts, coalesce(docs_with_parts, 0) as docs_with_parts from a left join b using (source)""")
def bucket_aggregates(spark, d):
    return relational.two_grain(table(spark, d, "documents"), lines(spark, d), "source", "doc_id")


@query("select source, doc_id, n_chars from (select *, row_number() over (partition by source order by n_chars, doc_id) as rn from documents) where rn <= 3")
def stratified_sample(spark, d):
    return relational.first_per(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars"), F.col("doc_id")], 3)


@query("select event_type, event_id, user_id from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as rn from events) where rn = 1")
def latest_per_source(spark, d):
    return relational.first_per(table(spark, d, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_type", "event_id", "user_id")


@query("select conv_id, arg_min(text, turn) as first_text, arg_max(text, turn) as last_text, count(*) as n_rows from conversations group by conv_id")
def session_summary(spark, d):
    return relational.first_last(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("select conv_id, row_number() over (partition by conv_id order by turn) as turn_no, role, length(text) as n_chars from conversations")
def session_turns(spark, d):
    return catalogue.numbered(table(spark, d, "conversations"), "conv_id", "turn", name="turn_no").select("conv_id", "turn_no", "role", F.length("text").alias("n_chars"))


@query("""with c as (select *, case when lag(event_type) over w = event_type then 0 else 1 end as ch from events window w as (partition by user_id order by event_id)),
g as (select *, sum(ch) over (partition by user_id order by event_id rows unbounded preceding) as island from c)
select user_id, cast(island as bigint) as island, event_type, min(event_id) as first_id, max(event_id) as last_id, count(*) as n from g group by user_id, island, event_type""")
def section_islands(spark, d):
    rows = relational.islands(table(spark, d, "events"), "user_id", "event_id", "event_type")
    return rows.groupBy("user_id", "island", "event_type").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("n"))


@query("""select event_id, coalesce(b = a and b <> event_type, false) as is_jump from
(select *, lag(event_type) over w as b, lead(event_type) over w as a from events window w as (partition by user_id order by event_id))""")
def section_jump_flags(spark, d):
    return relational.jumps(table(spark, d, "events"), "user_id", ["event_id"], "event_type").select("event_id", "is_jump")


@query("""with c as (select event_id, user_id, ['findings', 'other', 'findings', 'facts', 'table_block', 'header'][event_id * 7 % 6 + 1] as t, event_id // 40 as a, event_id // 40 + event_id % 2 as b, event_id % 200 as n from events),
x as (select *, lag(t) over w as p, lead(t) over w as q, greatest(lag(b) over w, b, lead(b) over w) - least(lag(a) over w, a, lead(a) over w) as span, lag(b) over w is not null and lead(b) over w is not null as inner_ from c window w as (partition by user_id // 20 order by event_id))
select event_id, coalesce(inner_ and p = q and p not in ('other', 'table_block') and t <> p and span <= 1 and (t in ('other', 'header') or n < 120), false) as is_jump from x""")
def weak_section_jumps(spark, d):
    kinds = F.array(*map(F.lit, ("findings", "other", "findings", "facts", "table_block", "header")))
    e = F.col("event_id")
    chunks = table(spark, d, "events").select("event_id", F.floor(F.col("user_id") / 20).alias("document"), F.element_at(kinds, (e * 7 % 6 + 1).cast("int")).alias("section_type"), F.floor(e / 40).alias("page_start"), (F.floor(e / 40) + e % 2).alias("page_end"), (e % 200).alias("token_count"))
    return relational.section_jumps(chunks, "document", "event_id").select("event_id", "is_jump")


@query("""with g as (select source, text, count(*) as n from documents group by all) select source, cast(sum(n - 1) as bigint) as duplicate_events, cast(sum(case when n > 1 then n else 0 end) as bigint) as flagged from g group by source""")
def duplicate_events(spark, d):
    rows = table(spark, d, "documents").select("source", F.sha2("text", 256).alias("sha"))
    return relational.duplicate_events(rows, "source", "sha")


@query("select doc_id, count(*) over (partition by sha256(text)) as copies, count(*) over (partition by sha256(text)) > 1 as is_duplicate from documents")
def duplicate_text_flags(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return relational.duplicate_flags(rows, ["sha"]).select("doc_id", "copies", "is_duplicate")


@query("select source, round(1 - count(distinct sha256(text)) / count(*), 6) as redundancy, round(1 - count(distinct n_chars) / count(*), 6) as duplicate_ratio from documents group by source")
def redundancy_ratios(spark, d):
    return catalogue.repeated_shares(table(spark, d, "documents"), "source", {"redundancy": F.sha2("text", 256), "duplicate_ratio": F.col("n_chars")})


@query("""select count(*) as docs, count(*) filter (where o_orderstatus = 'F') as finished, count(distinct o_custkey) as customers,
count(distinct o_custkey) filter (where o_totalprice > 100000) as big_customers, (select count(distinct l_orderkey) from lineitem where l_returnflag = 'R' and l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')) as returned_orders from orders""")
def backfill_coverage(spark, d):
    found = catalogue.coverage(table(spark, d, "orders"), F.col("o_orderstatus") == "F", "o_custkey", F.col("o_totalprice") > 100000, table(spark, d, "lineitem").where("l_returnflag = 'R'"), "o_orderkey", "l_orderkey")
    return found.toDF("docs", "finished", "customers", "big_customers", "returned_orders")


@query("select src, count(*) as n from (select 'customer' as src from customer union all select 'supplier' from supplier union all select 'part' from part union all select 'nation' from nation) group by src")
def union_source_counts(spark, d):
    return catalogue.source_counts({n: table(spark, d, n) for n in ("customer", "supplier", "part", "nation")})


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def antijoin_targets(spark, d):
    return relational.without(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("select doc_id, source, not (source = 'src1' and doc_id not in (select doc_id from labels)) as is_active from documents")
def tombstone_missing(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.lit(True).alias("is_active"))
    return relational.tombstone(docs, table(spark, d, "labels"), "doc_id", F.col("source") == "src1")


@query("""with r as (select doc_id, source || '-' || (doc_id % 50) as record_key, sha256(text) as sha, n_chars >= 300 as has_file from documents),
k as (select distinct record_key from r where doc_id % 3 = 0), v as (select distinct record_key, sha from r where doc_id % 3 = 0)
select r.doc_id, r.record_key, case when not has_file then 'skip_missing' when k.record_key is null then 'new_document' when v.sha is not null then 'reuse_version' else 'new_version' end as action
from r left join k using (record_key) left join v on r.record_key = v.record_key and r.sha = v.sha""")
def version_plan(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("-"), (F.col("doc_id") % 50).cast("string")).alias("record_key"), F.sha2("text", 256).alias("sha"), (F.col("n_chars") >= 300).alias("has_file"))
    known = rows.where("doc_id % 3 = 0")
    return relational.plan_versions(rows, known, known).select("doc_id", "record_key", "action")


@query("""with a as (select custkey, max(total) as total, min(status) as status from (select o_custkey as custkey, o_totalprice as total, o_orderstatus as status from orders where o_orderkey % 2 = 0) group by custkey),
b as (select custkey, max(total) as total, case when min(status) = 'P' then null else min(status) end as status from (select o_custkey as custkey, o_totalprice as total, o_orderstatus as status from orders where o_orderkey % 2 = 1) group by custkey)
select coalesce(a.custkey, b.custkey) as custkey, coalesce(b.total, a.total) as total, coalesce(b.status, a.status) as status from a full join b on a.custkey = b.custkey""")
def upsert_metadata(spark, d):
    orders = table(spark, d, "orders")
    side = lambda k: orders.where(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_custkey").alias("custkey")).agg(F.max("o_totalprice").alias("total"), F.min("o_orderstatus").alias("status"))
    return relational.upsert_latest(side(0), side(1).withColumn("status", F.nullif("status", F.lit("P"))), ["custkey"])


@query("select o_custkey, min(o_orderkey) as first_seen, max(o_orderkey) as last_seen from orders group by o_custkey")
def merge_seen(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("first_seen"), F.col("o_orderkey").alias("last_seen"))
    return relational.merge_seen(rows.where("last_seen % 2 = 0"), rows.where("last_seen % 2 = 1"), "o_custkey")


@query("""with n as (select *, c_custkey % 100 as k from customer where c_custkey % 2 = 0), o as (select *, c_custkey % 100 as k from customer where c_custkey % 2 = 1 or c_custkey % 7 = 0)
select c_custkey, k from o where k not in (select k from n) union all select c_custkey, k from n""")
def replace_by_key(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 100).alias("k"))
    return relational.replace_by_key(rows.where("c_custkey % 2 = 1 or c_custkey % 7 = 0"), rows.where("c_custkey % 2 = 0"), "k")


@query("select source, min(doc_id) as position, arg_max(n_chars, doc_id) as n_chars, arg_max(lang, doc_id) as lang from documents group by source")
def dedupe_keep_last(spark, d):
    return relational.keep_last_at_first(table(spark, d, "documents").select("source", F.col("doc_id").alias("position"), "n_chars", "lang"), "source", "position")


@query("""with f as (select n_regionkey, n_name, min(n_nationkey) as p from nation group by all) select n_regionkey, list(n_name order by p) as departments from f group by n_regionkey""")
def org_structure(spark, d):
    return relational.ordered_distinct(table(spark, d, "nation"), "n_regionkey", "n_nationkey", "n_name", "departments")


@query("""with c as (select o_custkey, o_orderpriority as v, count(*) as n from orders group by all),
t as (select o_custkey, max(n) as top, sum(n) as total from c group by o_custkey)
select o_custkey, min(v) as dominant, round(top / total, 6) as share, case when top = total then 1.0 when top / total >= 0.67 then 0.65 else 0.35 end as agreement
from c join t using (o_custkey) where n = top group by o_custkey, top, total""")
def dominant_record(spark, d):
    return relational.dominant(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("select event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as session_id from events")
def session_chain(spark, d):
    rows = table(spark, d, "events").withColumn("explicit", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return relational.fill_forward(rows, "user_id", "event_id", "explicit", "session_id").select("event_id", "session_id")


@query("""with recursive r as (select conv_id, turn, length(text) as c, row_number() over (partition by conv_id order by turn) as rn from conversations),
f as (select conv_id, rn, turn, 1 as n, c as used, true as taken from r where rn = 1 union all
select r.conv_id, r.rn, r.turn, f.n + case when f.n < 8 and f.used + r.c <= 900 then 1 else 0 end, f.used + case when f.n < 8 and f.used + r.c <= 900 then r.c else 0 end, f.n < 8 and f.used + r.c <= 900
from f join r on r.conv_id = f.conv_id and r.rn = f.rn + 1)
select conv_id, n as place, turn from f where taken""")
def context_budget(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("c"))
    return relational.budgeted(rows, "conv_id", "turn", "c", 8, 900).select("conv_id", "place", "turn")


@query("""select source, count(*) as n_docs, count(*) filter (where n_chars > 1000) as local_docs, greatest(count(*) - count(*) filter (where n_chars > 1000), 0) as missing, min(doc_id) as first_id, max(doc_id) as last_id from documents group by source""")
def corpus_snapshot(spark, d):
    return catalogue.local_share(table(spark, d, "documents"), "source", F.col("n_chars") > 1000, "doc_id")


@query("select doc_id, source, lang from documents where source in ('src1', 'src2') and lang = 'en' and n_chars > 500")
def filtered_documents(spark, d):
    return relational.scope(table(spark, d, "documents"), ids={"source": ["src2", "src1", "src1"], "doc_id": []}, equal={"lang": "en", "source": None}).where("n_chars > 500").select("doc_id", "source", "lang")


@query("""select doc_id, trim(regexp_replace(text, '[ \\t\\f\\v]+', ' ', 'g')) as cleaned,
round(case when length(regexp_replace(text, '[^A-Za-z]', '', 'g')) = 0 then 0 else length(regexp_replace(text, '[^A-Z]', '', 'g')) / length(regexp_replace(text, '[^A-Za-z]', '', 'g')) end, 6) as caps,
regexp_replace(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), '-+$', '') as slug,
substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 200) as preview from documents""")
def text_functions(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.inline_whitespace(F.col("text")).alias("cleaned"), F.round(text.uppercase_ratio(F.col("text")), 6).alias("caps"), text.slug(F.col("text"), 48).alias("slug"), text.preview(F.col("text")).alias("preview"))


@query("select doc_id, 'derived:' || sha256(source || chr(31) || lang || chr(31) || doc_id) as record_key from documents where doc_id % 5 <> 0 union all select doc_id, 'external:' || doc_id from documents where doc_id % 5 = 0")
def record_key_hash(spark, d):
    external = F.when(F.col("doc_id") % 5 == 0, F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", text.record_key(F.col("source"), external, F.col("lang"), F.col("doc_id")).alias("record_key"))


@query("""with u as (select page_id, regexp_replace(url, '#.*$', '') as bare from pages),
q as (select page_id, rtrim(regexp_replace(bare, '\\?.*$', ''), '/') as path, list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref)=')) as kept from u)
select q.page_id, case when len(kept) = 0 then path else path || '?' || array_to_string(kept, '&') end as canonical,
regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^(www\\.|m\\.)', '') as domain from q join pages using (page_id)""")
def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical"), text.domain(F.col("url")).alias("domain"))


@query("""with h as (select page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?href="([^"]*)"[^>]*>.*?</a>', 1)) as href from pages) select page_id, href, count(*) as n from h group by all""")
def anchor_links(spark, d):
    return manifest.anchors(table(spark, d, "pages")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("select page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) as title from pages")
def page_titles(spark, d):
    return manifest.titles(table(spark, d, "pages"))


@query("""with w as (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from documents),
k as (select doc_id, w, unnest(range(0, greatest(1, cast(ceil((len(w) - 20) / 80.0) as bigint)))) as win from w where len(w) > 0)
select doc_id, cast(win as bigint) as "window", len(w[win * 80 + 1 : win * 80 + 100]) as n_words, array_to_string(w[win * 80 + 1 : win * 80 + 100], ' ') as body from k""")
def token_windows(spark, d):
    return segmentation.token_windows(table(spark, d, "documents"), "doc_id", "text", 100, 20)


@query("""with l as (select doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.;])\\s+([A-Z])', '\\1' || chr(10) || '\\2', 'g'), '\\n+')) as s from documents)
select doc_id, count(*) as n_sentences, sum(length(trim(s)))::bigint as n_chars from l where trim(s) <> '' group by doc_id""")
def sentence_split(spark, d):
    rows = segmentation.sentences(table(spark, d, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"))


@query("""with a as (select o_orderkey as id, 'Rs. ' || cast(cast(floor(o_totalprice) as bigint) as varchar) || case when o_orderkey % 3 = 0 then ' lakh' when o_orderkey % 3 = 1 then ' crore' else '' end as t from orders)
select id, t as amount_text, round(cast(regexp_extract(t, '([0-9]+)', 1) as double) * case when t like '%crore' then 1e7 when t like '%lakh' then 1e5 else 1 end, 4) as amount, case when t like '%crore' then 'crore' when t like '%lakh' then 'lakh' else 'unit' end as unit from a""")
def amount_extraction(spark, d):
    unit = F.when(F.col("o_orderkey") % 3 == 0, " lakh").when(F.col("o_orderkey") % 3 == 1, " crore").otherwise("")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0).alias("place"), F.concat(F.lit("A penalty of Rs. "), F.floor("o_totalprice").cast("string"), unit, F.lit(" was paid.")).alias("sentence"))
    return facts.amounts(rows, "id").select("id", "amount_text", "amount", "unit")


@query("""with s as (select *, ['Section', 'Regulation', 'Rule', 'Schedule'][l_linenumber % 4 + 1] as kind,
case l_partkey % 4 when 0 then 'SEBI Act, 1992' when 1 then 'Settlement Regulations' when 2 then 'Carriage By ' || l_returnflag || ' Act, 1992' else 'Sample Rules, 2001' end as statute from lineitem)
select kind, statute, cast(l_linenumber as varchar) as reference, l_orderkey from s union select kind, statute, l_suppkey % 50 + 60 || 'A', l_orderkey from s""")
def legal_provisions(spark, d):
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    kind = F.element_at(F.array(*map(F.lit, ("section", "Regulation", "rules", "Schedule"))), n % 4 + 1)
    statute = F.when(k % 4 == 0, "SEBI Act").when(k % 4 == 1, "settlement regulations, 2018").when(k % 4 == 2, F.concat(F.lit("Carriage by "), "l_returnflag", F.lit(" Act, 1992"))).otherwise("Sample Rules, 2001")
    said = F.concat(F.lit("Under "), kind, F.lit(" "), n.cast("string"), F.lit(" and "), (F.col("l_suppkey") % 50 + 60).cast("string"), F.lit("A of the "), statute, F.lit(" it was held."))
    return facts.provisions(table(spark, d, "lineitem").select("l_orderkey", said.alias("body")), "l_orderkey", "body").select("kind", "statute", "reference", "l_orderkey")


@query("select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark, d):
    return streams.windowed(table(spark, d, "events"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as s from events),
k as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as session_start, count(*) as n from k group by user_id, k""")
def event_sessions(spark, d):
    return streams.sessions(table(spark, d, "events"))


@query("""with p as (select c_custkey, c_nationkey, c_acctbal from customer), f as (select c_custkey, c_nationkey, case when c_custkey % 4 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal from customer)
select f.c_custkey, f.c_acctbal from f join p using (c_custkey) where f.c_acctbal is distinct from p.c_acctbal""")
def change_detection(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    new = old.withColumn("c_acctbal", F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return streams.changed(old, new, "c_custkey").select("c_custkey", "c_acctbal")


@query()
def document_chunks(spark, d):
    return segmentation.chunks(table(spark, d, "documents"))


@query("""with j as (select source, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') as s from documents),
l as (select source, count(*) as n_rows, sum(('0x' || substr(s, 1, 15))::hugeint) % 1152921504606846976 as a, sum(('0x' || substr(s, 16, 15))::hugeint) % 1152921504606846976 as b, sum(('0x' || substr(s, 31, 15))::hugeint) % 1152921504606846976 as c, sum(('0x' || substr(s, 46, 15))::hugeint) % 1152921504606846976 as e from j group by source)
select source, n_rows, substr(sha1(n_rows || format('{:015x}{:015x}{:015x}{:015x}', a::bigint, b::bigint, c::bigint, e::bigint)), 1, 12) as version from l""")
def dataset_versions(spark, d):
    """A version for each source, which a row more, less or other changes."""
    return catalogue.dataset_version(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), ["source"])
