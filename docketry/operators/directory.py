"""Offices, people and names: aliases, scores, staged resolution, entities of titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import text

#: Points for a key that equals the hint, and for one inside it.
POINTS = {"key": (120, 0), "name": (110, 0), "city": (170, 75), "alias": (105, 70), "region": (30, 30)}


def office_keys(offices: DataFrame, office: str, name: str, key: str | None = None, city: str | None = None, region: str | None = None, aliases: str | None = None) -> DataFrame:
    """office, term, equal and inside: what a hint earns that is the term, or that holds it."""
    parts = []
    for kind, col in (("key", key), ("name", name), ("city", city), ("region", region)):
        if col is not None:
            parts.append(offices.select(F.col(office).alias("office"), text.lookup_key(F.col(col)).alias("term"), F.lit(POINTS[kind][0]).alias("equal"), F.lit(POINTS[kind][1]).alias("inside")))
    if aliases is not None:
        rows = offices.select(F.col(office).alias("office"), F.explode(aliases).alias("a"))
        parts.append(rows.select("office", text.lookup_key(F.col("a")).alias("term"), F.lit(POINTS["alias"][0]).alias("equal"), F.lit(POINTS["alias"][1]).alias("inside")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("term <> ''")


def office_scores(hints: DataFrame, keys: DataFrame, hint_id: str, hint: str, least: int = 60) -> DataFrame:
    """hint_id, office and score of at least the threshold. The substrings of a hint that are as long as some key are looked up, so the
    join is one on equality, and a hint gives rows in proportion to its length."""
    # one number for each length that keys have
    lengths = F.array(*[F.lit(r["n"]) for r in keys.select(F.length("term").alias("n")).distinct().collect()]).cast("array<int>")
    h = hints.select(hint_id, text.lookup_key(F.col(hint)).alias("__hint")).where("__hint <> ''")
    subs = h.withColumn("__long", F.explode(F.filter(lengths, lambda n: n <= F.length("__hint")))).withColumn("__from", F.explode(F.sequence(F.lit(1), F.length("__hint") - F.col("__long") + 1)))
    subs = subs.select(hint_id, "__hint", F.substring(F.col("__hint"), F.col("__from"), F.col("__long")).alias("term")).distinct()
    points = F.when(F.col("term") == F.col("__hint"), F.col("equal")).otherwise(F.col("inside"))
    return subs.join(keys, "term").groupBy(hint_id, "office").agg(F.sum(points).cast("long").alias("score")).where(F.col("score") >= least)


def staged_match(queries: DataFrame, people: DataFrame, query_id: str, query: str, person_id: str, name: str, aliases: str | None = None, most: int = 5) -> DataFrame:
    """The first stage that finds someone decides: the whole name, an alias, one token of a name or alias.

    One person found is exact (by name) or high; more are clarify with the first few ids; none is no_match, which
    a fuzzy search may follow. A single token of fewer than four letters never answers by itself."""
    q = queries.select(query_id, text.lookup_key(F.col(query)).alias("q")).where("q <> ''")
    names = people.select(person_id, text.lookup_key(F.col(name)).alias("q"))
    also = people.select(person_id, F.explode(aliases).alias("a")).select(person_id, text.lookup_key(F.col("a")).alias("q")) if aliases else names.limit(0)
    also = also.join(names.withColumnRenamed("q", "__name"), person_id).where("q <> __name").select(person_id, "q").distinct()
    words = names.unionByName(also).select(person_id, F.explode(F.split("q", " ")).alias("q")).distinct()
    stages = [(1, names.distinct()), (2, also), (3, words)]
    hits = None
    for n, found in stages:
        rows = q.join(found.where("q <> ''"), "q").select(query_id, F.lit(n).alias("stage"), "q", person_id)
        hits = rows if hits is None else hits.unionByName(rows)
    told = hits.groupBy(query_id, "stage", "q").agg(F.count("*").alias("n"), F.min(person_id).alias("one"))
    told = told.where(~((F.col("stage") == 3) & (F.col("n") == 1) & (F.length("q") < 4)))
    best = told.groupBy(query_id).agg(F.min_by(F.struct("stage", "n", "one"), "stage").alias("b")).select(query_id, "b.*")
    out = queries.select(query_id).join(best, query_id, "left")
    stage = F.when(F.col("stage") == 1, "exact_name").when(F.col("stage") == 2, "exact_alias").when(F.col("stage") == 3, "single_token").otherwise("no_match")
    status = F.when(F.col("stage").isNull(), "no_match").when(F.col("n") > 1, "clarify").when(F.col("stage") == 1, "exact").otherwise("high")
    return out.select(query_id, status.alias("status"), stage.alias("stage"), F.coalesce("n", F.lit(0)).cast("long").alias("n_found"), F.when(F.col("n") == 1, F.col("one")).alias("found"))


def alias_key(c: Column) -> Column:
    """Lower case without M/s, & as and, everything but letters and digits as one blank."""
    low = F.regexp_replace(F.lower(c), r"\bm\s*/?\s*s\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, "&", " and "), "[^a-z0-9]+", " "))


def alias_variants(c: Column) -> Column:
    """The key, both sides of a versus and their swap, and the short and long forms of company endings; each once, in order."""
    key = alias_key(c)
    sides = F.split(key, r" (?:vs|versus|v) ", 2)
    left, right = F.trim(sides[0]), F.trim(F.get(sides, F.lit(1)))
    pair = F.when(F.size(sides) == 2, F.array(key, left, right, F.concat(left, F.lit(" vs "), right), F.concat(right, F.lit(" vs "), left))).otherwise(F.array(key))
    short = lambda x: F.regexp_replace(F.regexp_replace(x, r"\blimited\b", "ltd"), r"\bprivate\b", "pvt")
    long = lambda x: F.regexp_replace(F.regexp_replace(x, r"\bltd\b", "limited"), r"\bpvt\b", "private")
    every = F.array_distinct(F.concat(pair, F.transform(pair, short), F.transform(pair, long)))
    return F.filter(every, lambda x: x.isNotNull() & (x != ""))


def title_entities(title: Column) -> Column:
    """Who a title is about: both sides of a versus, else the filer, else respondent and matter, else the title."""
    clean = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    versus = F.split(clean, r"(?i)\s(?:vs\.?|versus|v\.)\s", 2)
    part = lambda p, g=1: F.trim(F.regexp_replace(F.regexp_extract(clean, p, g), r"[ ,.;:-]+$", ""))
    filed, matter, respect = r"(?i)\bfiled by\s+(.+)$", r"(?i)\bin the matter of\s+(.+)$", r"(?i)\bin respect of\s+(.+)$"
    both = r"(?i)\bin respect of\s+(.+?)\s+in the matter of\s+(.+)$"
    found = F.when(F.size(versus) == 2, F.transform(versus, lambda v: F.trim(F.regexp_replace(v, r"[ ,.;:-]+$", ""))))
    found = found.when(clean.rlike(filed), F.array(part(filed))).when(clean.rlike(both), F.array(part(both), part(both, 2)))
    found = found.when(clean.rlike(matter), F.array(part(matter))).when(clean.rlike(respect), F.array(part(respect))).otherwise(F.array(clean))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def acronym(c: Column) -> Column:
    """First letters of the words of a name, upper case; null for fewer than two words."""
    words = text.tokens(c)
    return F.when(F.size(words) > 1, F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")))


def office_label(name: Column, city: Column, kind: Column, known: dict[str, tuple[str, ...]]) -> Column:
    """The label of a known alias in the name, else city and kind, else the city, else the name."""
    n, out = text.lookup_key(F.coalesce(name, F.lit(""))), F.when(F.lit(False), F.lit(""))
    for label, variants in known.items():
        for v in variants:
            out = out.when(n.contains(v), F.lit(label))
    has_city = F.coalesce(F.trim(city), F.lit("")) != ""
    out = out.when(has_city & kind.isNotNull(), text.lookup_key(F.concat_ws(" ", city, kind))).when(has_city, text.lookup_key(city))
    return out.otherwise(n)
