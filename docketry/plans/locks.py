"""Queries of matters that questions are locked to, and of signals of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import locks, routing, signals
from docketry.plans.catalog import query
from docketry.session import table


def matters(spark, d):
    """The index: a title for each part, in the forms that matters have."""
    k, name = F.col("p_partkey"), F.concat_ws(" ", "p_name", F.replace("p_brand", F.lit("#"), F.lit(" ")))
    title = F.when(k % 4 == 0, F.concat(F.lit("In the matter of "), name)).when(k % 4 == 1, name).when(k % 4 == 2, F.concat(F.lit("Settlement order in the matter of "), name, F.lit(" Limited"))).otherwise(F.concat(name, F.lit(" vs Alpha, corrigendum")))
    return table(spark, d, "part").select(k.alias("record"), title.alias("title"), F.lower("p_type").alias("bucket"), F.when(k % 5 == 0, "exemption").alias("kind"), F.array(F.concat(F.col("p_name"), F.lit(" Ltd."))).alias("entities"))


def aliases(spark, d):
    return table(spark, d, "part").groupBy(F.concat_ws(" ", "p_name", "p_type").alias("alias")).agg(F.collect_set("p_partkey").alias("records"))


def asked(spark, d):
    """A question about every hundredth part, in several forms, and the benchmark's items."""
    k, name = F.col("p_partkey"), F.concat_ws(" ", "p_name", F.replace("p_brand", F.lit("#"), F.lit(" ")))
    forms = [("Tell me more about the ", ""), ("What was the settlement amount in ", " settlement order"), ("", " in the matter of appeal no 7"), ("Compare ", " with others")]
    said = F.lit(None)
    for i, (before, after) in enumerate(forms):
        said = F.when(F.floor(k / 100) % len(forms) == i, F.concat(F.lit(before), name, F.lit(after))).otherwise(said)
    parts = table(spark, d, "part").where("p_partkey % 100 = 0").select(k.alias("query_id"), said.alias("query"), F.array(F.concat_ws(" ", "p_name", "p_type")).alias("variants"), (k % 300 == 0).alias("court"))
    items = table(spark, d, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("query_id"), F.col("text").alias("query"))
    return parts.unionByName(items, allowMissingColumns=True)


@query()
def matter_locks(spark, d):
    """The matter that each question is locked to among the titles of all parts."""
    pairs = table(spark, d, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 4).alias("b"))
    return locks.matter_locks(asked(spark, d), matters(spark, d), aliases(spark, d), pairs)


#: The key of a question between blanks, and the phrases of each signal.
_SAID = "(' ' || trim(regexp_replace(replace(lower(coalesce(text, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) || ' ')"


def turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"), (F.col("turn") > 0).alias("session_scope"))


@query(rf"""with k as (select conv_id, turn, {_SAID} as s from conversations)
select conv_id, turn, regexp_matches(s, ' (filed by|in the matter of|vs|versus|v|appeal no|petition no|writ no|case no|suit no|application no|complaint no|order no) ') as title,
regexp_matches(s, ' (this case|this matter|this appeal|this order|that case|that matter|the order|these sections|these regulations|these provisions) ') as deictic,
regexp_matches(s, ' (this case|this matter|this appeal|this order|that case|that matter|that appeal|that order|the order|these sections|these regulations|these provisions|these violations|finally|it|they|them|therein) ') or regexp_matches(s, '^ (what|was|were|did|and|so) ') as follow_up,
regexp_matches(s, ' (detail|details|explain|tell me more|summary|summarise|summarize) ') as detail,
trim(s) in ('hi', 'hello', 'hey', 'good morning', 'good afternoon', 'good evening', 'thanks', 'thank you', 'thx', 'bye', 'goodbye', 'what can you do', 'how can you help', 'help') as smalltalk,
regexp_matches(s, ' (dismissed|allowed|upheld|quashed|penalty|penalties|refund|restrained|debarred|directed|direction|directions|operative|finding|findings|settle|settlement|settled|violated|violations|holding) ') as outcome,
regexp_matches(s, ' (who|which) ') and regexp_matches(s, ' (signed|signatory) ') as signatory, regexp_matches(s, ' (section|sections|regulation|regulations|provision|provisions|violation|violations) ') as provisions,
regexp_matches(s, ' (amount|rs|inr|crore|lakh) ') as amount, regexp_matches(s, ' (share|shares|percentage|holding|holdings|shareholding|own|owns|owned|ownership) ') as holding,
regexp_matches(s, ' (vs|versus|v|sat|appeal|w p|wp|writ petition|court|judgment|tribunal) ') as court, regexp_matches(s, ' (latest|recent|current|today|now|as of|what is new|what s new) ') as live,
regexp_matches(s, ' (difference between|meaning of) ') or regexp_matches(s, '^ (what is|who is|explain|tell me about) ') as explanatory, regexp_matches(s, ' (compare|comparison|contrast|difference|differences|distinguish) ') as comparison,
regexp_matches(s, '^ (who is|who was) ') as person, regexp_matches(s, ' (19|20)[0-9][0-9] ') as year from k""")
def question_signals(spark, d):
    found = signals.found(F.col("query"))
    names = ("title", "deictic", "follow_up", "detail", "smalltalk", "outcome", "signatory", "provisions", "amount", "holding", "court", "live", "explanatory", "comparison", "person", "year")
    return turns(spark, d).select("conv_id", "turn", *(found[n].alias(n) for n in names))


_INTENT = f"""k as (select *, {_SAID} as s from {{}}), i as (select *, case when (regexp_matches(s, ' meaning of ') or regexp_matches(s, '^ (what is|explain) ')) and regexp_matches(s, ' (settle|settlement|settled) ') then 'generic'
 when regexp_matches(s, ' (dismissed|allowed|upheld|quashed|penalty|penalties|imposed|restrained|debarred|directed|direct|refund|settle|settled|settlement|violated|findings|held|order passed|final order|interim order) ') then 'substantive'
 when regexp_matches(s, ' (filed by|vs|versus|v|in the matter of|petitioner|respondent|appeal no|petition no|writ no|case no|suit no|application no|complaint no|order no) ') then 'party_or_title' when regexp_matches(s, ' appeal ') then 'substantive'
 when regexp_matches(s, ' (act|regulation|regulations|rule|rules|section|sast|pfutp|icdr|lodr|insider trading|takeover|adjudication) ') then 'regulation' else 'generic' end as intent from k)"""


@query("with " + _INTENT.format("(select conv_id, turn, text || case turn % 5 when 1 then ' was the penalty upheld' when 2 then ' under section 7' when 3 then ' petitioner' else '' end as text from conversations)") + " select conv_id, turn, intent from i")
def question_intents(spark, d):
    """The texts of all turns, each as it is or with one of three endings."""
    ending = F.when(F.col("turn") % 5 == 1, " was the penalty upheld").when(F.col("turn") % 5 == 2, " under section 7").when(F.col("turn") % 5 == 3, " petitioner").otherwise("")
    return turns(spark, d).select("conv_id", "turn", signals.intent(F.concat("query", ending)).alias("intent"))


@query()
def question_plans(spark, d):
    """Plan, reason, mode and label of every turn, from its own words and whether it follows others."""
    return routing.planned(signals.flags(turns(spark, d))).select("conv_id", "turn", "plan", "reason", "mode", "label")
