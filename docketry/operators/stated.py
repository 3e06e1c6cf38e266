"""Answers that stand in sentences: chunks that speak of a subject, what an order finally directs, and who holds how much."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docketry.functions import text
from docketry.operators.signals import has, said

#: What makes a chunk relevant to a kind of fact.
FACT_WORDS = {
    "holding": ("share", "shares", "hold", "holding", "holdings", "own", "owns", "owned", "ownership"), "pan": ("pan",), "amount": ("amount", "rs", "inr", "crore", "lakh"),
    "party": ("party", "parties", "noticee", "noticees", "appellant", "appellants", "respondent", "respondents"),
}
#: What a subject counts, as a phrase, by its first two words, or by any; and the chunks that are kept.
PHRASE, PAIR, WORD, KEPT = 6, 3, 1, 3


def fact_kind(query: Column) -> Column:
    """The kind of fact that a question asks for first, or null: holdings (a percentage too), account numbers, amounts, parties."""
    key = said(query)
    out = F.when(has(key, FACT_WORDS["holding"]) | query.rlike(r"\d\s*%"), "holding")
    for kind in ("pan", "amount", "party"):
        out = out.when(has(key, FACT_WORDS[kind]), kind)
    return out


def relevant_chunks(rows: DataFrame, kind: str, k: int = KEPT) -> DataFrame:
    """rows: query_id, subject, chunk, body, of the chunks in each question's scope. Those that speak of the kind of fact, the k best with score and rank, ties by chunk."""
    low, subject = F.lower(F.coalesce("body", F.lit(""))), text.lookup_key(F.coalesce("subject", F.lit("")))
    words = F.filter(F.split(subject, " "), lambda w: w != "")
    first = F.slice(words, 1, 2)
    about = F.when((subject != "") & low.contains(subject), PHRASE).when((F.size(words) > 0) & F.forall(first, lambda w: low.contains(w)), PAIR).when(F.exists(words, lambda w: low.contains(w)), WORD).otherwise(0)
    speaks = has(said(F.col("body")), FACT_WORDS[kind]) | (F.lit(kind == "holding") & F.coalesce(F.col("body").rlike(r"\d\s*%"), F.lit(False)))
    score = 1 + about + (low.contains("%") | low.contains("shares")).cast("int") + low.contains("proposed").cast("int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk")
    return rows.where(speaks).withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# What a chunk or sentence counts by its section, and by the words of a direction that it has.
CHUNK_BASE = {"operative_order": 4.0, "directions": 3.8, "findings": 1.8, "issues": 1.2}
SENTENCE_BASE = {"operative_order": 4.0, "directions": 3.8, "findings": 1.6, "issues": 1.0}
OTHER = 0.6
CUES = (
    ("confirms", 2.4, ("confirm", "confirms", "confirmed")), ("revokes", 2.4, ("revoked",)), ("remains", 2.0, ("remain in force", "remains in force")), ("warns", 1.6, ("warning",)), ("ceases", 1.6, ("cease to apply",)),
    ("directs", 1.8, ("refund", "repayment", "debarred", "restrained", "penalty", "penalties", "do hereby issue the following directions")),
)
ACTIONS = ("hereby confirm", "modified", "revoked", "remain in force", "remains in force", "warning", "cease to apply", "refund", "repayment", "debarred", "restrained", "penalty", "penalties", "do hereby issue the following directions")
PASSED_OVER = (
    "as an interim measure", "detailed investigation in the matter is in progress", "detailed investigation shall be carried out", "based on the outcome of the detailed investigation", "this order shall take effect immediately", "copy of this order shall be served",
    "investigating authority to confirm the facts",
)
#: How a sentence that can't stand alone begins or ends, and its least length.
BEGINNINGS, ENDINGS, LEAST = ("and", "or", "but", "which", "that"), ("and", "or", "but", "which", "that", "to", "of", "as per"), 25


def _base(section: Column, table: dict[str, float]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.trim(F.coalesce(section, F.lit("other")))), F.lit(OTHER))


def direction_score(section: Column, key: Column, table: dict[str, float] = SENTENCE_BASE) -> Column:
    """The section's weight and that of each kind of cue. key: see signals.said()."""
    out = _base(section, table)
    for _, weight, words in CUES:
        out = out + F.when(has(key, words), weight).otherwise(0.0)
    return F.round(out, 6)


def direction_chunks(chunks: DataFrame) -> DataFrame:
    """chunks: document, chunk, section, page, body. Those of operative sections or with an action, on the last two pages of these, with score."""
    key = said(F.col("body"))
    rows = chunks.where(F.coalesce(F.trim("section").isin("directions", "operative_order"), F.lit(False)) | has(key, ACTIONS)).withColumn("page", F.coalesce("page", F.lit(0)))
    last = F.max("page").over(Window.partitionBy("document"))
    return rows.withColumn("__last", last).where(F.col("page") >= F.col("__last") - 1).drop("__last").withColumn("score", direction_score(F.col("section"), said(F.col("body")), CHUNK_BASE))


def direction_sentences(chunks: DataFrame, k: int = 3) -> DataFrame:
    """document, chunk, sentence, kind, score, rank: the k best sentences of direction_chunks() of each document, each sentence once.

    Later pages count a thousandth each. Sentences that interim orders and service clauses consist of are passed over, and fragments."""
    parts = direction_chunks(chunks).select("document", "chunk", "section", "page", F.explode(text.sentences(F.regexp_replace("body", r"(?<=[a-z])\.\s+(?=[a-z])", " "))).alias("sentence"))
    rows = parts.withColumn("sentence", F.concat(F.btrim(F.regexp_replace("sentence", r"\s+", " "), F.lit(" .;")), F.lit("."))).withColumn("__key", said(F.col("sentence")))
    key = F.col("__key")
    whole = (F.length("sentence") >= LEAST) & ~F.col("sentence").rlike("^[a-z]") & ~key.rlike(f"^ (?:{'|'.join(BEGINNINGS)}) ") & ~key.rlike(f" (?:{'|'.join(ENDINGS)}) $")
    rows = rows.where(whole & ~has(key, PASSED_OVER) & has(key, ACTIONS)).withColumn("score", F.round(direction_score(F.col("section"), key) + F.col("page") / 1000, 6))
    kind = F.lit("other")
    for name, _, words in reversed(CUES):
        kind = F.when(has(key, words), name).otherwise(kind)
    rows = rows.withColumn("kind", kind).groupBy("document", F.lower("sentence").alias("__low")).agg(F.max_by(F.struct("chunk", "sentence", "kind", "score"), F.struct("score", -F.col("chunk"))).alias("s")).select("document", "s.*")
    order = Window.partitionBy("document").orderBy(F.desc("score"), F.length("sentence"), "sentence")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: An owner: two or more words with capitals, a title before them or a legal form after them counting in; and what is said of a holding.
_OWNER = re.compile(r"(?:(?:Mr|Mrs|Ms|Dr|Shri|Smt)\.?\s+)?[A-Z][A-Za-z&'-]*(?:\s+(?:(?:Ltd|Pvt)\.|(?:of\s+)?[A-Z][A-Za-z&'-]*))+")
_SHARES, _PERCENT = re.compile(r"(?i)\b(\d+(?:,\d+)*)\s+(?:equity\s+)?shares?\b"), re.compile(r"(\d+(?:\.\d+)?)\s*(?:%|per\s*cent)")
_PROPOSED = re.compile(r"(?i)\b(?:proposed|proposes|post[- ]acquisition|will hold|would hold)\b")
HOLDINGS = "doc string, place int, owner string, shares string, percentage double, proposed boolean, sentence string"


def owners_of(numbers: list[int], owners: list[tuple[int, int]]) -> list[int | None]:
    """For each position of a number the owner (begin, end; ascending, apart) that it belongs to: the nearest one before it, else the nearest one after it."""
    begins = [b for b, _ in owners]
    out = []
    for at in numbers:
        k = bisect_left(begins, at)
        out.append(k - 1 if k else 0 if owners else None)
    return out


def holdings_in(sentence: str) -> list[tuple[str, str | None, float | None, bool]]:
    """owner, shares, percentage and whether it is proposed: numbers that have one owner are one holding, the first of each kind."""
    spans = [(m.start(), m.end()) for m in _OWNER.finditer(sentence)]
    found: dict[int, dict] = {}
    mentions = [(m.start(), "shares", m[1].replace(",", "")) for m in _SHARES.finditer(sentence)] + [(m.start(), "percentage", float(m[1])) for m in _PERCENT.finditer(sentence)]
    mentions.sort(key=lambda m: m[0])
    for (_, kind, value), k in zip(mentions, owners_of([m[0] for m in mentions], spans), strict=True):
        if k is not None:
            found.setdefault(k, {}).setdefault(kind, value)
    out = []
    for k, held in sorted(found.items()):
        upto = spans[k + 1][0] if k + 1 < len(spans) else len(sentence)
        before = spans[k - 1][1] if k else 0
        out.append((sentence[slice(*spans[k])], held.get("shares"), held.get("percentage"), bool(_PROPOSED.search(sentence[before:upto]))))
    return out


def holding_tuples(rows: DataFrame) -> DataFrame:
    """Every holding that a sentence states. rows: doc, place, sentence. Each number goes to its nearest admissible owner in one pass over both."""
    arrow = to_arrow_schema(T.StructType.fromDDL(HOLDINGS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d, p, *h, s) for d, p, s in zip(*(batch[c].to_pylist() for c in ("doc", "place", "sentence")), strict=True) for h in holdings_in(s)]
            cols = zip(*out, strict=True) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    numbers = F.col("sentence").rlike(r"\d") & F.col("sentence").rlike(r"(?i)shares?\b|%|per\s*cent")
    return rows.where(numbers).select(F.col("doc").cast("string").alias("doc"), F.col("place").cast("int").alias("place"), "sentence").mapInArrow(run, HOLDINGS)
