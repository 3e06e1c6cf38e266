"""Fusion of lexical and vector search, three levels of search, and rule-based reranking, over a table of queries.

Queries are a small table; what finds units is in lexical.py and vectors.py. Texts and embeddings are not carried through the joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from docketry.functions import scoring, text
from docketry.operators import lexical as full_text
from docketry.operators import vectors

#: The hits of a query are ranked in this many parts first, so that they don't meet in one task before they are few.
PARTS = 32


def ranked(hits: DataFrame, k: int | None = None, order: tuple[str, ...] = ("-score", "unit"), by: str = "query_id") -> DataFrame:
    """rank by these columns, those with - from the greatest; the k best of each query."""
    keys = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order]
    if k is not None:
        part = F.pmod(F.xxhash64("unit"), F.lit(PARTS))
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(by, part).orderBy(*keys))).where(F.col("rank") <= k).drop("rank")
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*keys)))
    return out if k is None else out.where(F.col("rank") <= k)


def _best(hits: DataFrame, k: int) -> DataFrame:
    """A unit counts once, by its best row."""
    return ranked(hits.groupBy("query_id", "unit").agg(F.max("score").alias("score")), k)


def lexical(queries: DataFrame, units: DataFrame, weighted: dict[str, float], alike: list[str], k: int, share: float = 0.2, scope: DataFrame | None = None, held: list[Row] | None = None) -> DataFrame:
    """query_id, unit, score, rank: the k best a query by cover density and similarity, ties by unit (see lexical.search).

    share: 0.2 for documents and sections, 0.15 for chunks. scope: query_id, unit; only these are searched."""
    return _best(full_text.search(queries, units, weighted, alike, k, share, scope, held), k)


def vector(queries: DataFrame, units: DataFrame, k: int, scope: DataFrame | None = None, held: list[Row] | None = None) -> DataFrame:
    """query_id, unit, score, rank: the k best a query by exact cosine, ties by unit (see vectors.search)."""
    return _best(vectors.search(queries, units, k, scope, held), k)


def vector_lists(queries: DataFrame, index: DataFrame, middle, k: int, probes: int) -> DataFrame:
    """The same from the inverted lists that each query probes (see vectors.inverted_lists)."""
    return _best(vectors.approximate(queries, index, middle, k, probes), k)


def fuse(lexical_hits: DataFrame, vector_hits: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion; a unit that one side lacks gets nothing from it."""
    a = lexical_hits.select("query_id", "unit", F.col("rank").alias("lexical_rank"))
    b = vector_hits.select("query_id", "unit", F.col("rank").alias("vector_rank"))
    both = a.join(b, ["query_id", "unit"], "full_outer")
    return ranked(both.withColumn("score", F.round(scoring.fused(F.col("lexical_rank"), F.col("vector_rank")), 9)), k)


def exact_lookup(titles: DataFrame, query: str, k: int) -> DataFrame:
    """titles: unit, key, title. The greatest of six signals; admitted are equal, containing and similar ones."""
    q = text.lookup_key(F.lit(query))
    grams = text.trigrams(F.lit(query))
    title, key = text.lookup_key(F.col("title")), F.lower("key")
    sim, key_sim = text.similarity(text.trigrams(F.col("title")), grams), text.similarity(text.trigrams(F.col("key")), grams)
    equal, holds = title == q, title.contains(q) & (q != "")
    score = F.greatest(F.when(key == q, 1.0).otherwise(0.0), F.when(equal, 0.99).otherwise(0.0), F.when(holds, 0.95).otherwise(0.0), sim, key_sim)
    hits = titles.where((key == q) | equal | holds | (sim >= 0.35) | (key_sim >= 0.75)).select(F.lit(1).alias("query_id"), "unit", F.round(score, 6).alias("score"))
    return ranked(hits, k).drop("query_id")


def rerank(hits: DataFrame, intent: Column, locked: list | None = None) -> DataFrame:
    """hits: score (base), section, bucket, record. Multiplies section prior, intent, bucket and lock factors; never below 0."""
    bucket = F.when(F.col("bucket").contains("settlement"), scoring.SETTLEMENT).otherwise(1.0)
    final = F.col("score") * scoring.section_prior(F.col("section")) * scoring.intent_factor(intent, F.col("section")) * bucket * scoring.lock_factor(F.col("record"), locked or [])
    return hits.withColumn("final", F.round(F.greatest(final, F.lit(0.0)), 9))


def confusable_with(pairs: DataFrame, locked: list, strict: bool = True) -> DataFrame | None:
    """record: those that pairs (a, b, in either direction) list with the one record that a strict lock names; None without such a lock."""
    if not strict or not locked:
        return None
    first = F.lit(locked[0])
    return pairs.where(F.col("a") == first).select(F.col("b").alias("record")).unionByName(pairs.where(F.col("b") == first).select(F.col("a").alias("record"))).where("record is not null").distinct()


def confused(hits: DataFrame, pairs: DataFrame, locked: list, strict: bool = True, record: str = "record", score: str = "score") -> DataFrame:
    """Scores of records that are easily taken for the locked one are multiplied by 0.08."""
    partners = confusable_with(pairs, locked, strict)
    if partners is None:
        return hits
    partners = partners.select(F.col("record").alias(record), F.lit(scoring.CONFUSION).alias("__confused"))
    return hits.join(partners, record, "left").withColumn(score, F.col(score) * F.coalesce("__confused", F.lit(1.0))).drop("__confused").select(hits.columns)


def adjusted(hits: DataFrame, chunk: bool | None, locked: list | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Adds final, the score times four factors for documents (chunk is None), seven for sections and chunks; never below 0.

    hits: score, name (of the document), bucket, record, intent, focused, terms; for sections and chunks also section, title, heading, body.
    locked: the records of a strict lock on one matter. pairs: a, b, records that are easily taken for each other."""
    focused = F.coalesce("focused", F.lit(False))
    factor = scoring.alignment_factor(F.col("name"), focused, F.col("terms")) * F.when(focused & F.coalesce(F.col("bucket").contains("settlement"), F.lit(False)), scoring.SETTLEMENT).otherwise(1.0)
    factor = factor * scoring.lock_factor(F.col("record"), locked or [])
    if chunk is not None:
        factor = factor * scoring.section_prior(F.col("section")) * scoring.intent_factor(F.col("intent"), F.col("section"))
        factor = factor * scoring.content_factor(F.col("body"), F.concat_ws(" ", "title", "heading"), F.col("section"), focused, chunk)
    rows = hits.withColumn("final", F.greatest(F.col("score") * factor, F.lit(0.0)))
    if pairs is not None:
        rows = confused(rows, pairs, locked or [], score="final")
    return rows.withColumn("final", F.round("final", 9))


def suppress_headers(hits: DataFrame, by: tuple[str, ...] = ("document",)) -> DataFrame:
    """For substantive questions: a header up to a quarter above the best operative, findings or directions hit of its document is set just below that.

    hits: section, intent, final."""
    best = F.max(F.when(F.col("section").isin(*scoring.STRONG), F.col("final"))).over(Window.partitionBy(*by))
    above = (F.col("section") == "header") & (F.col("intent") == "substantive") & (best > 0) & (F.col("final") > best) & (F.col("final") <= scoring.HEADER_ABOVE * best)
    return hits.withColumn("final", F.round(F.when(above, best * scoring.HEADER_BELOW).otherwise(F.col("final")), 9))


#: How hits are ordered: by score, then by what lexical and vector search gave, then by document and unit.
ORDER = ("-final", "-lexical", "-vector", "document", "unit")


def diversify(hits: DataFrame, by: tuple[str, ...] = ("document",)) -> DataFrame:
    """The k-th further header of a document loses 0.12 k of its score, 0.30 at most. For substantive questions the best substantive hit, if it has
    at least 0.93 of a higher header, is lifted above it by 1 %, by 8 % of the header's score at most.

    hits: section, intent, final, lexical, vector, document, unit; headers and substantive hits count in ORDER."""
    section = F.coalesce(F.trim("section"), F.lit(""))
    kind = F.when(section == "header", "header").when(~section.isin("", *scoring.WEAK), "substantive").otherwise("other")
    keys = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in ORDER]
    rows = hits.withColumn("__kind", kind).withColumn("__k", F.row_number().over(Window.partitionBy(*by, "__kind").orderBy(*keys)))
    header = F.max(F.when(F.col("__kind") == "header", F.col("final"))).over(Window.partitionBy(*by))
    final = F.col("final")
    lifted = (F.col("__kind") == "substantive") & (F.col("__k") == 1) & (F.col("intent") == "substantive") & (final > 0) & (final < header) & (final >= scoring.COMPETITIVE * header)
    bonus = F.least(header - final + F.greatest(0.01 * final, F.lit(1e-6)), 0.08 * header)
    penalty = final * F.least(F.lit(0.30), 0.12 * (F.col("__k") - 1))
    changed = F.when(lifted, final + bonus).when(F.col("__kind") == "header", final - penalty).otherwise(final)
    return rows.withColumn("final", F.round(F.greatest(changed, F.lit(0.0)), 9)).drop("__kind", "__k")


def hybrid(queries: DataFrame, texts: DataFrame, weighted: dict[str, float], alike: list[str], units: DataFrame, k: int) -> DataFrame:
    """Three times k from either side, fused and cut to k. texts: unit and text columns; units: unit, embedding."""
    return fuse(lexical(queries, texts, weighted, alike, 3 * k), vector(queries, units, 3 * k), k)


def _level(queries: DataFrame, held: list[Row], units: DataFrame, weighted: dict[str, float], alike: list[str], k: int, share: float, parents: DataFrame | None) -> DataFrame:
    """query_id, unit, score, lexical, vector: three times k from either side, fused with the parent's score. parents: query_id, unit, parent; no other unit is scored."""
    scope = None if parents is None else parents.select("query_id", "unit")
    a = lexical(queries, units, weighted, alike, 3 * k, share, scope, held)
    b = vector(queries, units, 3 * k, scope, held)
    both = a.select("query_id", "unit", F.col("rank").alias("a"), F.col("score").alias("lexical")).join(b.select("query_id", "unit", F.col("rank").alias("b"), F.col("score").alias("vector")), ["query_id", "unit"], "full_outer")
    both = both.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("lexical", "vector")})
    above = None
    if parents is not None:
        both, above = both.join(parents, ["query_id", "unit"]), F.col("parent")
    return both.select("query_id", "unit", scoring.fused(F.col("a"), F.col("b"), above).alias("score"), "lexical", "vector")


def levels(queries: DataFrame, documents: DataFrame, sections: DataFrame, chunks: DataFrame, k: tuple[int, int, int], locked: list | None = None, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The k best documents, sections and chunks of each query: query_id, unit, document, final, rank.

    queries: query_id, query, q, intent, focused (on settlement), terms (names asked for). documents: unit, title, body, embedding, bucket,
    record. sections and chunks: unit, document, section_key, section, title, heading, body, embedding. Sections are those of the documents
    found; chunks those of the documents and section keys found, if any section is. A section carries its document's score, a chunk the
    greater one of its section and document. Ties go by lexical and vector score, document and unit. The first two levels are a few rows a query
    and are worked out once, here."""
    held = queries.select("query_id", "query", "q").collect()
    asked = queries.select("query_id", "intent", "focused", "terms")
    about = documents.select(F.col("unit").alias("document"), F.col("title").alias("name"), "bucket", "record")

    def judged(hits: DataFrame, units: DataFrame, chunk: bool | None) -> DataFrame:
        return adjusted(hits.join(units, "unit").join(about, "document").join(asked, "query_id"), chunk, locked, pairs)

    def best(rows: DataFrame, n: int) -> DataFrame:
        return ranked(rows, n, ORDER).select("query_id", "unit", "document", *(["section_key"] if "section_key" in rows.columns else []), "final", "rank")

    def few(rows: DataFrame) -> DataFrame:
        """At most k rows a query, as a table of their own: what comes below doesn't work them out again."""
        return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)

    by = ("query_id", "document")
    docs = few(best(judged(_level(queries, held, documents, {"title": 1.0, "body": 0.4}, ["title", "body"], k[0], 0.2, None), documents.select("unit", F.col("unit").alias("document")), None), k[0]))
    of_docs = docs.select("query_id", "document", F.col("final").alias("above"))
    # the documents found are named to the scans: what is made from other documents isn't made at all
    some = [r["document"] for r in docs.select("document").distinct().collect()]
    sections, chunks, about = (rows.where(F.col("document").isin(some)) for rows in (sections, chunks, about))
    parents = sections.select("unit", "document").join(of_docs, "document").select("query_id", "unit", F.col("above").alias("parent"))
    kept = ["unit", "document", "section_key", "section", "title", "heading", "body"]
    found = judged(_level(queries, held, sections, {"title": 1.0, "heading": 0.4, "body": 0.2}, ["title", "body"], k[1], 0.2, parents), sections.select(*kept), False)
    secs = few(best(suppress_headers(found, by), k[1]))
    of_secs = secs.groupBy("query_id", "document", "section_key").agg(F.max("final").alias("own"))
    keys = secs.groupBy("query_id").agg(F.collect_set("section_key").alias("keys"))
    scope = chunks.select("unit", "document", "section_key").join(of_docs, "document").join(keys, "query_id", "left").where(F.col("keys").isNull() | F.array_contains("keys", F.col("section_key")))
    parents = scope.join(of_secs, ["query_id", "document", "section_key"], "left").select("query_id", "unit", F.greatest("above", F.coalesce("own", F.lit(0.0))).alias("parent"))
    found = judged(_level(queries, held, chunks, {"title": 1.0, "body": 0.4}, ["body"], k[2], 0.15, parents), chunks.select(*kept), True)
    return docs, secs, best(diversify(suppress_headers(found, by), by), k[2])
