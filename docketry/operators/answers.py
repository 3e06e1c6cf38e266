"""Decisions about answers: votes, confidence, candidates, guards, facts, clusters of failures, crawls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import scoring, text


def weighted_vote(rows: DataFrame, key: str, candidate: str, weight: str) -> DataFrame:
    """The candidate of each key with the largest sum of weights; of ties the least. Null candidates don't vote."""
    votes = rows.where(F.col(candidate).isNotNull()).groupBy(key, candidate).agg(F.sum(F.col(weight).cast("decimal(18,4)")).alias("votes"))
    best = votes.groupBy(key).agg(F.min_by(F.struct(candidate, "votes"), F.struct(-F.col("votes"), candidate)).alias("b"))
    return best.select(key, F.col(f"b.{candidate}").alias("winner"), F.col("b.votes").cast("double").alias("votes"))


#: Words of hedged answers and of answers that give up.
HEDGES, DOUBTS = ("may", "might", "depends", "uncertain"), ("i do not know", "not sure", "insufficient")


def _any_of(c: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in phrases])


def direct_confidence(answer: Column) -> Column:
    """Confidence in an explanatory answer without sources: less for hedges, doubts and fewer than twelve words."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    n_words = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    loss = F.when(_any_of(low, HEDGES), 0.10).otherwise(0.0) + F.when(_any_of(low, DOUBTS), 0.22).otherwise(0.0) + F.when(n_words < 12, 0.05).otherwise(0.0)
    return F.round(scoring.clamp(F.lit(0.62) - loss), 4)


def web_confidence(sources: DataFrame, key: str, official: bool, preferred: list[str], authoritative: list[str]) -> DataFrame:
    """sources: key, url, domain, is_official. Confidence, should_abstain and should_hedge of each key's answer."""
    told = sources.groupBy(key).agg(
        F.countDistinct(F.nullif(F.trim("url"), F.lit(""))).alias("urls"),
        F.count_if(F.col("is_official") & text.domain_allowed(F.col("domain"), preferred)).alias("matches"),
        F.count_if(text.domain_allowed(F.col("domain"), authoritative)).alias("trusted"),
    )
    more = lambda c, least, most: F.least(F.greatest(F.col(c) - least, F.lit(0)), F.lit(most))
    if official:
        score, abstain, hedge = F.lit(0.78) + more("urls", 1, 2) * 0.05 + more("matches", 1, 1) * 0.04, 0.72, 0.83
        if preferred:
            score = F.when(F.col("matches") == 0, F.lit(0.0)).otherwise(score)
    else:
        score, abstain, hedge = F.lit(0.56) + more("urls", 1, 2) * 0.06 + more("trusted", 0, 2) * 0.04, 0.58, 0.68
    out = told.select(key, F.round(scoring.clamp(score), 4).alias("confidence"))
    return out.withColumns({"should_abstain": F.col("confidence") < abstain, "should_hedge": (F.col("confidence") >= abstain) & (F.col("confidence") < hedge)})


def decide(candidates: DataFrame, key: str, candidate: str, score: str, exact: str, court: Column | None = None, bucket_rank: str | None = None) -> DataFrame:
    """One row a key: selected (a clearly dominant candidate) or clarify; neither where the best scores below 0.45.

    Only the two best rows of a key take part, so a window with a limit of two is all that is shuffled."""
    best = candidates.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), candidate))).where("__rn <= 2")
    at = lambda c, n: F.max(F.when(F.col("__rn") == n, F.col(c)))
    rank = bucket_rank or "__rank"
    best = best if bucket_rank else best.withColumn(rank, F.lit(0))
    asked = (court if court is not None else F.lit(False)).alias("court")
    rows = best.withColumn("__court", asked).groupBy(key).agg(
        at(candidate, 1).alias("first"), at(score, 1).alias("top"), at(score, 2).alias("second"),
        at(exact, 1).alias("e1"), F.coalesce(at(exact, 2), F.lit(False)).alias("e2"), at(rank, 1).alias("r1"), at(rank, 2).alias("r2"), F.max("__court").alias("court"),
    )
    top, gap, sat = F.col("top"), F.col("top") - F.col("second"), F.col("court")
    sure = F.col("second").isNull() | (top >= 0.92) | ((top >= 0.76) & (gap >= 0.12)) | (F.col("e1") & ~F.col("e2") & (top >= 0.72) & (gap >= 0.05))
    sure = sure | (sat & (F.col("r1") < F.col("r2")) & (top >= 0.68) & (gap >= 0.02)) | (sat & (F.col("r1") == F.col("r2")) & (top >= 0.72) & (gap >= 0.08))
    return rows.select(key, F.when((top >= 0.45) & sure, F.col("first")).alias("selected"), ((top >= 0.45) & ~sure).alias("clarify"))


def mixed_guard(items: DataFrame, key: str, record: str, cited: Column, substantive: Column, strict: Column) -> DataFrame:
    """Whether a question about one matter kept to one record, in what was retrieved and in what was cited."""
    seen = items.groupBy(key).agg(
        F.countDistinct(record).alias("n_retrieved"), F.countDistinct(F.when(cited, F.col(record))).alias("n_cited"),
        F.coalesce(F.bool_or(cited & substantive), F.lit(False)).alias("substantive"), F.bool_or(strict).alias("strict"),
    )
    mixed_r, mixed_c = F.col("n_retrieved") > 1, F.col("n_cited") > 1
    codes = [("strict_single_matter", F.col("strict")), ("mixed_retrieval", mixed_r), ("mixed_citations", mixed_c), ("missing_substantive_citation", F.col("strict") & ~F.col("substantive") & (F.col("n_cited") > 0))]
    reasons = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in codes])), ",")
    return seen.select(key, mixed_r.alias("mixed_retrieval"), mixed_c.alias("mixed_citations"), (F.col("strict") & (mixed_r | mixed_c)).alias("fired"), reasons.alias("reasons"))


def fact_by_priority(facts: DataFrame, key: str, kind: str, order: str, value: str, priority: list[str]) -> DataFrame:
    """Each key's first fact by the priority of its kind, then by stored order, ties by value; kinds that aren't listed don't count."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col(kind))
    return facts.where(F.col(kind).isin(priority)).groupBy(key).agg(F.min_by(F.struct(kind, value), F.struct(place, order, value)).alias("b")).select(key, f"b.{kind}", f"b.{value}")


def bug_clusters(bugs: DataFrame, cluster: str, bucket: str, case: str) -> DataFrame:
    """Cases of each cluster by bucket with the first of them; rows, not lists, so that a large cluster stays spread."""
    return bugs.groupBy(cluster, bucket).agg(F.count("*").alias("cases"), F.min(case).alias("first_case"))


def with_tags(cases: DataFrame, tags: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Cases with all tags of include and none of exclude; null tags are no tags."""
    have = F.coalesce(F.col(tags), F.array().cast("array<string>"))
    wanted, unwanted = [t.strip() for t in include if t.strip()], [t.strip() for t in exclude if t.strip()]
    if wanted:
        cases = cases.where(F.forall(F.array(*map(F.lit, wanted)), lambda t: F.array_contains(have, t)))
    if unwanted:
        cases = cases.where(~F.arrays_overlap(have, F.array(*map(F.lit, unwanted))))
    return cases


def crawl_end(pages: DataFrame, category: str, page: str, changed: str, least: int = 10, quiet: int = 3) -> DataFrame:
    """The page at which an update stops: from the least-th on the first that ends a run of quiet unchanged ones, else the last."""
    w = Window.partitionBy(category).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    rows = pages.withColumn("__n", F.row_number().over(Window.partitionBy(category).orderBy(page)))
    rows = rows.withColumn("__run", F.col("__n") - F.coalesce(F.max(F.when(F.col(changed), F.col("__n"))).over(w), F.lit(0)))
    stop = F.min(F.when((F.col("__n") >= least) & (F.col("__run") >= quiet), F.col(page)))
    return rows.groupBy(category).agg(F.coalesce(stop, F.max(page)).alias("last_page"), stop.isNotNull().alias("stopped"))


def numeric_check(expected: DataFrame, actual: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """matched, missing or mismatched for each expected fact."""
    rows = expected.select(key, F.col(value).alias("__want")).join(actual.select(key, F.col(value).alias("__got")), key, "left")
    status = F.when(F.col("__got").isNull(), "missing").when(F.abs(F.col("__got") - F.col("__want")) <= tolerance, "matched").otherwise("mismatched")
    return rows.select(key, status.alias("status"))


def grounding(cases: DataFrame, expected: DataFrame, actual: DataFrame, key: str, record: str, faithfulness: str) -> DataFrame:
    """Unsupported claims (records beyond the expected ones, or none at all), and the hallucination rate that follows."""
    want, got = expected.select(key, record).distinct(), actual.select(key, record).distinct()
    extra = got.join(want, [key, record], "left_anti").groupBy(key).agg(F.count("*").alias("extra"))
    out = cases.join(want.groupBy(key).agg(F.lit(1).alias("has_want")), key, "left").join(got.groupBy(key).agg(F.lit(1).alias("has_got")), key, "left").join(extra, key, "left")
    claims = F.when(F.col("has_want").isNull(), 0).when(F.col("has_got").isNull(), 1).otherwise(F.coalesce("extra", F.lit(0)))
    rate = F.round(scoring.clamp(1 - F.col(faithfulness) + F.when(claims > 0, 0.15).otherwise(0.0)), 4)
    return out.select(key, claims.cast("long").alias("unsupported_claims"), rate.alias("hallucination_rate"))


def same_or_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, number: str, keys: str) -> DataFrame:
    """Pairs whose numbers are equal or whose key arrays share a value: two joins on equality instead of a nested loop."""
    by_number = left.select(left_id, number).join(right.select(right_id, number), number).select(left_id, right_id)
    spread = lambda df, i: df.select(i, F.explode(F.array_distinct(keys)).alias("__k")).where("__k is not null")
    by_key = spread(left, left_id).join(spread(right, right_id), "__k").select(left_id, right_id)
    return by_number.unionByName(by_key).distinct()


def ranked_sources(sources: DataFrame, url: str, title: str, allowed: list[str], unique_per_domain: bool = False) -> DataFrame:
    """One row for each canonical url, the best titled; rank by domain, title and url; one for each domain if asked."""
    rows = sources.withColumns({"canonical": text.canonical_url(F.col(url)), "domain": text.domain(F.col(url))}).where("canonical <> ''")
    name = F.lower(F.trim(F.coalesce(F.col(title), F.lit(""))))
    rows = rows.withColumn("untitled", F.when((name == "") | (name == F.col("domain")), 1).otherwise(0))
    keep = F.min_by(F.struct(F.col(url).alias("url"), F.col(title).alias("title"), "domain", "untitled"), F.struct("untitled", F.col(url)))
    rows = rows.groupBy("canonical").agg(keep.alias("k")).select("canonical", "k.*")
    place = reduce(lambda c, x: c.when(text.domain_allowed(F.col("domain"), [x[1]]), F.lit(x[0])), list(enumerate(allowed)), F.when(F.lit(False), 0)).otherwise(F.when(F.col("domain").rlike(r"\.(gov|nic)\.in$"), 1000).when(F.col("domain").rlike(r"\.(gov|edu)$"), 1001).otherwise(1002))
    order = ["place", "untitled", F.lower(F.coalesce("title", F.lit(""))), "url"]
    rows = rows.withColumn("place", place)
    if unique_per_domain:
        rows = rows.withColumn("__rn", F.row_number().over(Window.partitionBy("domain").orderBy(*order))).where("__rn = 1").drop("__rn")
    return rows


#: Words for places in a list of candidates.
ORDINALS = ("first", "second", "third", "fourth", "fifth")


def choose(reply: Column, titles: Column) -> Column:
    """The place (from 1) that a reply picks of a list of titles: an ordinal, a number in the list, or the one title that holds the reply."""
    said = text.lookup_key(F.coalesce(reply, F.lit("")))
    place = F.when(F.lit(False), 0)
    for i, word in enumerate(ORDINALS, 1):
        place = place.when(said.rlike(rf"\b{word}\b"), F.lit(i))
    place = place.otherwise(F.regexp_extract(said, r"^(?:(?:option|number|no|candidate) )?(\d{1,2})$", 1).try_cast("int"))
    held = F.filter(F.transform(titles, lambda t, i: F.struct((i + 1).alias("i"), text.lookup_key(t).alias("t"))), lambda x: (said != "") & x["t"].contains(said))
    named = F.when(F.size(held) == 1, held[0]["i"])
    return F.when((place >= 1) & (place <= F.size(titles)), place).otherwise(named)
