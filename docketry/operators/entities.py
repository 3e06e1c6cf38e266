"""Entity resolution: fuzzy scores, designation groups, office matching, canonical records."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions import text

#: Titles before names that don't count.
HONORIFICS = ("mr", "mrs", "ms", "m/s", "dr", "shri", "smt")
#: Fixed values of the name score: for a name inside the other, for names with one last word, and for all others.
PARTIAL = {"base": 0.79, "compact": 0.12, "last": 0.05, "most": 0.97}
NAMES = {"base": 0.58, "first": 0.22, "shared": 0.16, "compact": 0.08, "least_first": 0.72, "most": 0.96}
FUZZY = {"whole": 0.42, "compact": 0.33, "shared": 0.25, "last": 0.05, "short": 0.08, "most": 0.95}
#: Scores from which a match counts, is worth asking about, is trusted, and how far the next one has to be.
LEAST, MEDIUM, CONFIDENT, GAP = 0.72, 0.82, 0.84, 0.05
_HONORIFIC = re.compile(r"\b(?:" + "|".join(HONORIFICS) + r")\b")
_FOUND = T.StructType([T.StructField(n, T.DoubleType()) for n in ("score", "shared", "first", "last")] + [T.StructField("how", T.StringType()), T.StructField("words", T.DoubleType())])


@lru_cache(100_000)
def normalize_fuzzy(value: str | None) -> str:
    """ASCII, lower case, without honorifics, & as and, letters and digits."""
    plain = unicodedata.normalize("NFKD", value or "").encode("ascii", "ignore").decode().lower()
    return " ".join(re.sub("[^a-z0-9]+", " ", _HONORIFIC.sub(" ", plain).replace("&", " and ")).split())


def fuzzy_match(query: str | None, candidate: str | None) -> dict:
    """score from 0 to 1, how (exact, partial, name_tokens, fuzzy or none), the share of common words, the likeness of first and last words, and the query's words."""
    q, c = normalize_fuzzy(query), normalize_fuzzy(candidate)
    if not q or not c:
        return {"score": 0.0, "shared": 0.0, "first": 0.0, "last": 0.0, "how": "none", "words": len(q.split())}
    a, b = q.split(), c.split()
    like = lambda x, y: SequenceMatcher(None, x, y).ratio()
    out = {"shared": len({*a} & {*b}) / max(len({*a}), len({*b})), "first": like(a[0], b[0]), "last": like(a[-1], b[-1]), "words": len(a)}
    compact, same_last = like(q.replace(" ", ""), c.replace(" ", "")), a[-1] == b[-1]
    if q == c:
        return out | {"score": 1.0, "how": "exact"}
    if (q in c or c in q) and (len(q) >= 5 or len(a) > 1):
        score, limit, how = PARTIAL["base"] + PARTIAL["compact"] * compact + PARTIAL["last"] * same_last, PARTIAL["most"], "partial"
    elif len(a) > 1 and same_last and out["first"] >= NAMES["least_first"]:
        score, limit, how = NAMES["base"] + NAMES["first"] * out["first"] + NAMES["shared"] * out["shared"] + NAMES["compact"] * compact, NAMES["most"], "name_tokens"
    else:
        score = FUZZY["whole"] * like(q, c) + FUZZY["compact"] * compact + FUZZY["shared"] * out["shared"] + FUZZY["last"] * same_last
        score, limit, how = score - FUZZY["short"] * (len(a) == 1 and len(q) < 4), FUZZY["most"], "fuzzy"
    return out | {"score": min(score, limit), "how": how}


def fuzzy_score(query: str | None, candidate: str | None) -> tuple[float, str]:
    found = fuzzy_match(query, candidate)
    return found["score"], found["how"]


@lru_cache(100_000)
def letter_counts(name: str) -> dict[str, int]:
    """How often a name has each letter, without blanks."""
    return Counter(name.replace(" ", ""))


def fuzzy_most(query: str | None, candidate: str | None) -> float:
    """No less than the score of fuzzy_match(), from letters and words alone, wherever they stand."""
    q, c = normalize_fuzzy(query), normalize_fuzzy(candidate)
    if not q or not c or q in c or c in q:
        return 1.0
    a, b = q.split(), c.split()
    x, y = letter_counts(q), letter_counts(c)
    both, blanks = sum(min(n, y[k]) for k, n in x.items() if k in y), min(len(a), len(b)) - 1
    shared, whole, compact = len({*a} & {*b}) / max(len({*a}), len({*b})), 2 * (both + blanks) / (len(q) + len(c)), 2 * both / (len(q) - len(a) + 1 + len(c) - len(b) + 1)
    out = FUZZY["whole"] * whole + FUZZY["compact"] * compact + FUZZY["shared"] * shared + FUZZY["last"]
    return max(out, NAMES["base"] + NAMES["first"] + NAMES["shared"] * shared + NAMES["compact"] * compact) if len(a) > 1 and a[-1] == b[-1] else out


def fuzzy(query: Column, candidate: Column, least: float = 0.0) -> Column:
    """fuzzy_match(), null where it can't reach ``least`` (rounded to four places)."""

    @F.pandas_udf(_FOUND)
    def scored(query: pd.Series, candidate: pd.Series) -> pd.DataFrame:
        found = [fuzzy_match(q, c) if fuzzy_most(q, c) >= least - 1e-4 else dict.fromkeys(_FOUND.names) for q, c in zip(query, candidate, strict=True)]
        return pd.DataFrame(found, columns=_FOUND.names)

    return scored(query, candidate)


@F.pandas_udf(T.ArrayType(T.StringType()))
def folded_trigrams(value: pd.Series) -> pd.Series:
    """Distinct trigrams of the folded words, with two blanks before and one after each."""
    return value.map(lambda v: sorted({f"  {w} "[i : i + 3] for w in normalize_fuzzy(v).split() for i in range(len(w) + 1)}))


def fuzzy_candidates(queries: DataFrame, values: DataFrame, least: float = LEAST, tasks: int | None = None) -> DataFrame:
    """queries: query_id, query; values: value_id, value. The pairs that score ``least`` (rounded to four places) with score, how, shared, first, last, words.

    Only pairs that share a folded trigram are scored. No other pair reaches 0.52: without a common trigram no three letters in a row
    and no word are common, so at most two letters of three are matched, and 0.75 of 0.67 is 0.5. Each name is scored once a query,
    however many values have it. tasks: how many to deal the pairs to, where few bytes would else be scored in one."""
    names = values.select("value").distinct()
    q = queries.select("query_id", F.explode(folded_trigrams("query")).alias("gram"))
    pairs = q.join(names.select("value", F.explode(folded_trigrams("value")).alias("gram")), "gram").select("query_id", "value").distinct()
    pairs = pairs.join(queries.select("query_id", "query"), "query_id")
    scored = (pairs.repartition(tasks) if tasks else pairs).withColumn("m", fuzzy(F.col("query"), F.col("value"), least)).where(F.col("m.score") >= least)
    cols = [F.round(f"m.{c}", 4).alias(c) for c in ("score", "shared", "first", "last")]
    return scored.select("query_id", "value", *cols, F.col("m.how").alias("how"), F.col("m.words").cast("int").alias("words")).join(values.select("value_id", "value"), "value")


def match_band(how: Column, words: Column, score: Column, second: Column, shared: Column, first: Column, last: Column, confident: float = CONFIDENT, medium: float = MEDIUM, gap: float = GAP) -> Column:
    """high, medium or low for the best match of a query; second: the next score or null."""
    clear = second.isNull() | (second <= F.round(score - gap, 6))
    one = F.when((score >= max(confident + 0.08, 0.92)) & clear, "high").when((score >= medium) & clear, "medium").otherwise("low")
    high = (score >= confident) & (first >= 0.86) & (shared >= 0.5) & clear
    likely = clear & ((score >= medium) & (last >= 0.995) & (first >= 0.45) | (score >= confident + 0.04) & (shared >= 0.5))
    return F.when(how == "exact", "high").when(words == 1, one).when(high, "high").when(likely, "medium").otherwise("low")


def ranked_matches(found: DataFrame) -> DataFrame:
    """The pairs of fuzzy_candidates() in each query's order (score, then value, then value_id), with rank, and on the first one band and ambiguous."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "value", "value_id")
    second = F.lead("score").over(order)
    rows = found.withColumns({"rank": F.row_number().over(order), "second": second})
    band = match_band(*(F.col(c) for c in ("how", "words", "score", "second", "shared", "first", "last")))
    rows = rows.withColumn("band", F.when(F.col("rank") == 1, band))
    close = F.coalesce((F.col("score") < CONFIDENT) & (F.col("second") >= F.round(F.col("score") - GAP, 6)), F.lit(False))
    return rows.withColumn("ambiguous", F.when(F.col("rank") == 1, (F.col("band") == "medium") | close)).drop("second", "words")


#: Short forms and what they stand for; a form stands for the whole title that holds it as words.
DESIGNATIONS = {
    "whole time member": ("wtm", "whole time member"), "executive director": ("ed", "executive director"), "assistant manager": ("am", "assistant manager"),
    "deputy general manager": ("dgm", "deputy general manager"), "chief general manager": ("cgm", "chief general manager"), "regional director": ("rd", "regional director"),
}
#: The groups with their labels, in the order of the labels' table.
GROUP_LABELS = {
    "chairperson": "Chairperson", "whole_time_member": "Whole-Time Member", "board_member": "Board Member", "executive_director": "Executive Director",
    "chief_general_manager": "Chief General Manager", "general_manager": "General Manager", "deputy_general_manager": "Deputy General Manager",
    "assistant_general_manager": "Assistant General Manager", "manager": "Manager", "assistant_manager": "Assistant Manager", "regional_director": "Regional Director",
    "office_contact": "Office Contact", "staff": "Staff", "other": "Other",
}


def designation(title: Column) -> Column:
    """A title in lower case, short forms written out; empty for a null one."""
    return text.bound(F.struct(_low(title).alias("low"), _key(_low(title)).alias("key")), lambda x: _written_out(x["low"], x["key"]))


def _low(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+", " "))


def _key(low: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.replace(low, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")), F.lit(" "))


def _written_out(low: Column, key: Column) -> Column:
    out = F.replace(low, F.lit("-"), F.lit(" "))
    for name, forms in reversed(DESIGNATIONS.items()):
        out = F.when(key.rlike(" (" + "|".join(forms) + ") "), F.lit(name)).otherwise(out)
    return out


def _code(c: Column | None) -> Column:
    return F.lit("") if c is None else F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[- ]", "_")


def designation_group(title: Column, role_group: Column | None = None, board_category: Column | None = None, board_role: Column | None = None) -> Column:
    """The group of a person: by board category and role group first, then by the title's words, then by what is left."""
    board = F.lit("") if board_role is None else F.trim(F.coalesce(board_role, F.lit("")))
    parts = F.struct(designation(title).alias("named"), _code(role_group).alias("role"), _code(board_category).alias("category"), board.alias("board"))
    # bound once: the rules would work out each part for every comparison
    return text.bound(parts, lambda x: _group(x["named"], x["role"], x["category"], x["board"]))


def with_group(rows: DataFrame, name: str, title: str, role_group: str, board_category: str, board_role: str) -> DataFrame:
    """rows with designation_group() in a column of this name. Each step is a projection of its own, so that generated code stays small and compiles."""
    steps = rows.withColumn("__low", _low(F.col(title))).withColumn("__key", _key(F.col("__low")))
    steps = steps.withColumns({"__named": _written_out(F.col("__low"), F.col("__key")), "__role": _code(F.col(role_group)), "__category": _code(F.col(board_category)), "__board": F.trim(F.coalesce(board_role, F.lit("")))})
    return steps.withColumn(name, _group(*(F.col(c) for c in ("__named", "__role", "__category", "__board")))).drop("__low", "__key", "__named", "__role", "__category", "__board")


def _group(named: Column, role: Column, category: Column, board: Column) -> Column:
    begins = lambda name: (named == name) | named.startswith(name + " ")
    out = F.when((category == "chairperson") | (role == "chairperson"), "chairperson").when((category == "whole_time_member") | (role == "wtm"), "whole_time_member")
    out = out.when(category.isin("part_time_member", "government_nominee", "rbi_nominee"), "board_member")
    for group in ("regional_director", "executive_director"):
        out = out.when((role == group) | named.contains(group.replace("_", " ")), group)
    for group in ("chief_general_manager", "deputy_general_manager", "assistant_general_manager"):
        out = out.when(named.contains(group.replace("_", " ")), group)
    for group in ("assistant_manager", "manager", "general_manager"):
        out = out.when(begins(group.replace("_", " ")), group)
    out = out.when(role == "office_contact", "office_contact").when(role.isin("staff", "department_head", "chief_vigilance_officer") | (named != ""), "staff")
    return out.when(board != "", "board_member").otherwise("other")


def people_counts(people: DataFrame, offices: DataFrame) -> dict[str, DataFrame]:
    """people: designation_group, office_name, department_name; offices: canonical_office_id, office_name, city, region. The four count tables:
    by group with label, by office (offices without people too), by department, and of three roles (those without people too)."""
    labels = F.create_map(*[F.lit(x) for kv in GROUP_LABELS.items() for x in kv])
    groups = people.groupBy("designation_group").agg(F.count("*").alias("people_count")).withColumn("designation_label", F.coalesce(F.try_element_at(labels, F.col("designation_group")), F.initcap(F.replace("designation_group", F.lit("_"), F.lit(" ")))))
    at = people.where(F.coalesce("office_name", F.lit("")) != "").groupBy("office_name").agg(F.count("*").alias("n"))
    by_office = offices.join(at, "office_name", "left").select("canonical_office_id", "office_name", "city", "region", F.coalesce("n", F.lit(0)).alias("people_count"), F.lit(1).alias("office_count"))
    departments = people.where(F.coalesce("department_name", F.lit("")) != "").groupBy("department_name").agg(F.count("*").alias("people_count"))
    group = F.col("designation_group")
    roles = {"whole_time_member": ("Whole-Time Members", group == "whole_time_member"), "executive_director": ("Executive Directors", group == "executive_director"), "board_member": ("Board Members", group.isin("chairperson", "whole_time_member", "board_member"))}
    counted = people.agg(*[F.count_if(test).alias(k) for k, (_, test) in roles.items()])
    by_role = counted.select(F.explode(F.array(*[F.struct(F.lit(k).alias("role_key"), F.lit(label).alias("role_label"), F.col(k).alias("people_count")) for k, (label, _) in roles.items()])).alias("r")).select("r.*")
    return {"designation": groups, "office": by_office, "department": departments, "role": by_role}


def best_field(rows: DataFrame, key: str, field: str, priority: str, tie: str) -> DataFrame:
    """For each key the value with the highest priority, then the longest, then the first by tie."""
    rank = F.struct(F.col(priority), F.length(field), -F.col(tie))
    return rows.where(F.col(field).isNotNull()).groupBy(key).agg(F.max_by(field, rank).alias(field))


def canonical(rows: DataFrame, key: str, fields: list[str], priority: str, tie: str, alias: str) -> DataFrame:
    """One record a key: the best value of each field, sorted aliases and the number of rows merged."""
    picks = [F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(F.col(priority), F.length(f), -F.col(tie)))).alias(f) for f in fields]
    return rows.groupBy(key).agg(*picks, F.array_sort(F.collect_set(alias)).alias("aliases"), F.count("*").alias("merged_rows"))


def parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts of each key on both sides, and whether they agree."""
    a, b = left.groupBy(key).agg(F.count("*").alias("left_n")), right.groupBy(key).agg(F.count("*").alias("right_n"))
    out = a.join(b, key, "full_outer").na.fill(0, ["left_n", "right_n"])
    return out.withColumn("agrees", F.col("left_n") == F.col("right_n"))
