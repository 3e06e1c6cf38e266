"""Queries of answers that stand in sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import stated
from docketry.plans.catalog import lines, query
from docketry.plans.search import picked
from docketry.session import table

ENDINGS = ["", ". The interim direction is hereby confirmed and Confirmed again. I hereby confirm the directions issued to all noticees", ". As an interim measure the noticee is debarred from the market", ". The order against the noticee shall stand revoked with immediate effect", ". A penalty is imposed on each of the noticees in this matter", ". This warning is issued to the company and its directors", ". And the penalty stands as imposed on them before"]


def planted(spark, d):
    """The lines of all documents as chunks, with sections by number, each seventh with words of a direction."""
    n = F.col("line_no")
    rows = lines(spark, d).select(F.col("doc_id").alias("document"), n.alias("chunk"), picked(["facts", "directions", "findings", "operative_order", None, "issues"], n + F.col("doc_id")).alias("section"), F.floor(n / 3).cast("int").alias("page"), F.concat("line", picked(ENDINGS, n * 3 + F.col("doc_id"))).alias("body"))
    return rows


_SAID = "' ' || trim(regexp_replace(replace(lower({c}), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) || ' '"
_ACTIONS = " (hereby confirm|modified|revoked|remain in force|remains in force|warning|cease to apply|refund|repayment|debarred|restrained|penalty|penalties|do hereby issue the following directions) "


def _score(base: str) -> str:
    return f"""round(case trim(coalesce(section, 'other')) {base} else 0.6 end::double + case when regexp_matches(s, ' (confirm|confirms|confirmed) ') then 2.4 else 0 end::double + case when regexp_matches(s, ' revoked ') then 2.4 else 0 end::double
 + case when regexp_matches(s, ' (remain in force|remains in force) ') then 2.0 else 0 end::double + case when regexp_matches(s, ' warning ') then 1.6 else 0 end::double + case when regexp_matches(s, ' cease to apply ') then 1.6 else 0 end::double
 + case when regexp_matches(s, ' (refund|repayment|debarred|restrained|penalty|penalties|do hereby issue the following directions) ') then 1.8 else 0 end::double, 6)"""


_PLANTED = """l as (select doc_id as document, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents),
p as (select document, n as chunk, ['facts', 'directions', 'findings', 'operative_order', null, 'issues'][(n + document) % 6 + 1] as section, cast(n // 3 as integer) as page,
 line || ['', '. The interim direction is hereby confirmed and Confirmed again. I hereby confirm the directions issued to all noticees', '. As an interim measure the noticee is debarred from the market', '. The order against the noticee shall stand revoked with immediate effect',
  '. A penalty is imposed on each of the noticees in this matter', '. This warning is issued to the company and its directors', '. And the penalty stands as imposed on them before'][(n * 3 + document) % 7 + 1] as body from l),
r as (select *, """ + _SAID.format(c="body") + f""" as s from p), k as (select *, max(page) over (partition by document) as last from r where section in ('directions', 'operative_order') or regexp_matches(s, '{_ACTIONS}'))"""


@query(f"""with {_PLANTED} select document, chunk, page, {_score("when 'operative_order' then 4.0 when 'directions' then 3.8 when 'findings' then 1.8 when 'issues' then 1.2")} as score from k where page >= last - 1""")
def direction_chunks(spark, d):
    return stated.direction_chunks(planted(spark, d)).select("document", "chunk", "page", "score")


@query()
def direction_sentences(spark, d):
    """The three best sentences of what each document finally directs."""
    return stated.direction_sentences(planted(spark, d))


@query(r"""with b as (select doc_id as query_id, ['Thand', 'in the', 'of', ''][doc_id % 4 + 1] as subject, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as chunk from documents),
c as (select query_id, lower(subject) as subject, chunk, line || ['', ' He held 500 shares.', ' The proposed holding is 4.5%.', ' A holding'][chunk % 4 + 1] as body from b),
m as (select *, lower(body) as low from c where regexp_matches(' ' || trim(regexp_replace(replace(lower(body), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) || ' ', ' (share|shares|hold|holding|holdings|own|owns|owned|ownership) ') or regexp_matches(body, '\d\s*%')),
s as (select query_id, chunk, 1 + case when subject <> '' and contains(low, subject) then 6 when subject = 'in the' and contains(low, 'in') and contains(low, 'the') then 3 when subject = 'in the' and (contains(low, 'in') or contains(low, 'the')) then 1 else 0 end
 + case when contains(low, '%') or contains(low, 'shares') then 1 else 0 end + case when contains(low, 'proposed') then 1 else 0 end as score from m),
r as (select *, row_number() over (partition by query_id order by score desc, chunk) as rank from s) select * from r where rank <= 3""")
def holding_chunks(spark, d):
    """For each document's subject the three lines that speak of a holding of it."""
    endings = ["", " He held 500 shares.", " The proposed holding is 4.5%.", " A holding"]
    rows = lines(spark, d).select(F.col("doc_id").alias("query_id"), picked(["Thand", "in the", "of", ""], F.col("doc_id")).alias("subject"), F.col("line_no").alias("chunk"), F.concat("line", picked(endings, F.col("line_no"))).alias("body"))
    return stated.relevant_chunks(rows, "holding").select("query_id", "chunk", "score", "rank")


@query()
def holding_tuples(spark, d):
    """Holdings that are planted in the lines of all documents, with owners from customers' and suppliers' numbers."""
    n, k = F.col("line_no"), F.col("doc_id")
    name = lambda c: F.concat(F.lit("Person "), F.chr(65 + c % 26), F.lit("x Holdings"))
    planted_ = F.concat(F.lit(" and so "), name(n), F.lit(" held "), (n * 7 + 1).cast("string"), F.lit(",000 shares ("), (n % 90).cast("string"), F.lit(".5%) while "), name(k), F.lit(" proposed to acquire "), (k % 40).cast("string"), F.lit("%."))
    return stated.holding_tuples(lines(spark, d).select(k.alias("doc"), n.alias("place"), F.concat("line", F.when(n % 2 == 0, planted_).otherwise("")).alias("sentence"))).select("doc", "place", "owner", "shares", "percentage", "proposed")
