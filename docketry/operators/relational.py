"""Aggregates, windows, set operations and upserts of the catalogue. All take and return DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scope(df: DataFrame, *, ids: dict[str, list] | None = None, equal: dict | None = None) -> DataFrame:
    """Conjunction of equalities and IN lists; empty lists and nulls don't filter. Predicates reach the scan."""
    for name, values in (ids or {}).items():
        if values:
            df = df.where(F.col(name).isin(sorted(set(values))))
    for name, value in (equal or {}).items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def describe(df: DataFrame, value: str, prefix: str) -> DataFrame:
    """One row: count, sum, mean, exact median, least and greatest."""
    v = F.col(value)
    median = F.percentile(v, F.lit(0.5))
    return df.agg(F.count("*").alias("n_rows"), F.sum(v).alias(f"total_{prefix}"), F.round(F.avg(v), 6).alias(f"avg_{prefix}"), F.round(median, 6).alias(f"median_{prefix}"), F.min(v).alias(f"min_{prefix}"), F.max(v).alias(f"max_{prefix}"))


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key. The order must end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def two_grain(docs: DataFrame, parts: DataFrame, key: str, doc_id: str) -> DataFrame:
    """Aggregates of documents and of their parts, joined on the key after each is grouped, so that nothing fans out."""
    a = docs.groupBy(key).agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    b = parts.groupBy(key).agg(F.count("*").alias("n_parts"), F.countDistinct(doc_id).alias("docs_with_parts"))
    return a.join(b, key, "left").withColumns({"n_parts": F.coalesce("n_parts", F.lit(0)), "docs_with_parts": F.coalesce("docs_with_parts", F.lit(0))})


def islands(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Numbers runs of equal values within a key, from 1."""
    w = Window.partitionBy(key).orderBy(order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__c", changed).withColumn("island", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def jumps(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Flags rows that differ from two equal neighbours."""
    w = Window.partitionBy(key).orderBy(*order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn("is_jump", F.coalesce((before == after) & (before != F.col(value)), F.lit(False)))


def section_jumps(chunks: DataFrame, document: str, order: str) -> DataFrame:
    """Adds is_jump: a chunk between two of one type (not other or table_block) that differs from them, on at most two pages, and is
    weak: of the type other or header, or under 120 tokens. chunks: section_type, page_start, page_end, token_count."""
    w = Window.partitionBy(document).orderBy(order)
    kind = F.col("section_type")
    three = lambda c, pick: pick(F.lag(c).over(w), F.col(c), F.lead(c).over(w))
    between = (F.lag(kind).over(w) == F.lead(kind).over(w)) & ~F.lag(kind).over(w).isin("other", "table_block") & (F.lag(kind).over(w) != kind)
    near = three("page_end", F.greatest) - three("page_start", F.least) <= 1
    weak = kind.isin("other", "header") | (F.col("token_count") < 120)
    return chunks.withColumn("is_jump", F.coalesce(between & near & weak, F.lit(False)))


def duplicate_events(chunks: DataFrame, document: str, sha: str) -> DataFrame:
    """document, duplicate_events (chunks beyond the first of each text) and flagged (all chunks whose text the document has again)."""
    groups = chunks.groupBy(document, sha).agg(F.count("*").alias("n"))
    return groups.groupBy(document).agg(F.sum(F.col("n") - 1).alias("duplicate_events"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("flagged"))


def duplicate_flags(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn("copies", F.count("*").over(w)).withColumn("is_duplicate", F.col("copies") > 1)


def without(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    return df.join(other.select(on).distinct(), on, "left_anti")


def tombstone(existing: DataFrame, incoming: DataFrame, key: str, scope_cond: Column) -> DataFrame:
    """is_active becomes false for rows of the scope whose key isn't in the incoming set; an empty set ends them all."""
    seen = incoming.select(F.col(key).alias("__k")).distinct().withColumn("__in", F.lit(True))
    out = existing.join(seen, F.col(key) == F.col("__k"), "left")
    return out.withColumn("is_active", F.col("is_active") & (~scope_cond | F.coalesce("__in", F.lit(False)))).drop("__k", "__in")


def replace_by_key(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Delete and insert: all old rows of the incoming keys go."""
    return without(existing, incoming, key).unionByName(incoming)


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows win; columns that are null there keep their old value."""
    values = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, *[F.col(c).alias(f"__{c}") for c in values])
    return old.join(incoming, keys, "full_outer").select(*keys, *[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in values])


def merge_seen(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """first_seen is the least, last_seen the greatest of both sides."""
    both = existing.select(key, "first_seen", "last_seen").unionByName(incoming.select(key, "first_seen", "last_seen"))
    return both.groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def plan_versions(rows: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """action for each row (record_key, sha, has_file): skip_missing, reuse_version, new_document or new_version."""
    known = documents.select("record_key").distinct().withColumn("__doc", F.lit(True))
    had = versions.select("record_key", "sha").distinct().withColumn("__ver", F.lit(True))
    out = rows.join(known, "record_key", "left").join(had, ["record_key", "sha"], "left")
    action = F.when(~F.col("has_file"), "skip_missing").when(F.col("__doc").isNull(), "new_document").when(F.col("__ver").isNotNull(), "reuse_version").otherwise("new_version")
    return out.withColumn("action", action).drop("__doc", "__ver")


def keep_last_at_first(df: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key, at the position of the first."""
    last = F.max_by(F.struct(*[F.col(c) for c in df.columns if c not in (key, position)]), F.col(position)).alias("r")
    return df.groupBy(key).agg(F.min(position).alias(position), last).select(key, position, "r.*")


def first_last(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """First and last value and the count of each key, in one aggregation instead of three lateral joins."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(f"first_{value}"), F.max_by(value, order).alias(f"last_{value}"), F.count("*").alias("n_rows"))


def ordered_distinct(df: DataFrame, key: str, position: str, value: str, out: str) -> DataFrame:
    """For each key its values once, in the order of first sight; nulls are dropped."""
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.min(position).alias("__p"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", F.col(value).alias("v")))), lambda x: x["v"]).alias(out))


def dominant(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's most frequent value (the least of ties), its share, and the band of agreement."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    out = counts.groupBy(key).agg(F.max_by(F.col(value), F.struct("n", F.lit(0))).alias("__any"), F.max("n").alias("top"), F.sum("n").alias("total"))
    best = counts.join(out, key).where(F.col("n") == F.col("top")).groupBy(key).agg(F.min(value).alias("dominant"), F.first("top").alias("top"), F.first("total").alias("total"))
    share = F.col("top") / F.col("total")
    return best.select(key, "dominant", F.round(share, 6).alias("share"), F.when(share == 1, 1.0).when(share >= 0.67, 0.65).otherwise(0.35).alias("agreement"))


def fill_forward(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def budgeted(df: DataFrame, key: str, order: str, cost: str, most_rows: int, most_cost: int) -> DataFrame:
    """Greedy pick in order: a row over the budget is passed over and the next ones still count; the first row always stays.

    A fold over the ordered rows of a key; rows passed over take nothing, which a running sum can't say."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("picked"))

    def step(acc: Column, row: Column) -> Column:
        fits = (acc["n"] == 0) | ((acc["n"] < most_rows) & (acc["used"] + row["c"] <= most_cost))
        taken = F.struct((acc["n"] + 1).alias("n"), (acc["used"] + row["c"]).alias("used"), F.concat(acc["picked"], F.array(row["o"])).alias("picked"))
        return F.when(fits, taken).otherwise(acc)

    rows = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(cost).cast("long").alias("c"))))
    folded = df.groupBy(key).agg(F.aggregate(rows, state, step).alias("s"))
    return folded.select(key, F.posexplode("s.picked").alias("place", order)).withColumn("place", F.col("place") + 1)


def advance(rows: DataFrame, outcomes: DataFrame, key: str, status: str = "status", error: str = "error") -> DataFrame:
    """Statuses after a batch: pending rows with an outcome are done, or failed where it has an error; the others stay as they are.

    outcomes: key and error; a key that fails once has failed. Bad rows don't stop a batch."""
    told = outcomes.groupBy(key).agg(F.min(error).alias("__error"), F.lit(1).alias("__seen"))
    rows = rows.join(told, key, "left")
    moved = F.col("__seen").isNotNull() & F.coalesce(F.col(status), F.lit("pending")).isin("pending", "processing")
    after = F.when(moved, F.when(F.col("__error").isNull(), "done").otherwise("failed")).otherwise(F.coalesce(F.col(status), F.lit("pending")))
    return rows.withColumns({status: after, error: F.when(moved, F.col("__error")).otherwise(F.col(error))}).drop("__error", "__seen")


def patch(seed: DataFrame, patches: DataFrame, key: str, columns: list[str], reasons: list[str]) -> DataFrame:
    """seed with the values of patches whose reason is allowed; null values of a patch change nothing, of several patches the last reason's counts."""
    allowed = patches.where(F.col("reason").isin(reasons)).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("reason", *columns)).alias("__p"))
    out = seed.join(allowed, key, "left")
    return out.withColumns({c: F.coalesce(F.col(f"__p.{c}"), F.col(c)) for c in columns}).drop("__p")


#: Parts that the right side of a common key is dealt into, so that its pairs are made by many tasks.
DEALT = 32


def sharing(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """left_id and right_id of the rows that have a key in common, each pair once. left, right: their id and __key.

    Each side carries all keys of its ids, and a pair is made at the least key that both have: no pair is shuffled to find it again.
    The right side of a key is dealt into DEALT parts, which the left one (better the smaller) goes to all of."""
    spark = left.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keyed = lambda df, i, own: df.select(i, "__key").where("__key is not null").groupBy(i).agg(F.collect_set("__key").alias(own)).select(i, own, F.explode(own).alias("__key"))
    a = keyed(left, left_id, "__a").withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    b = keyed(right, right_id, "__b").withColumn("__part", F.pmod(F.xxhash64(right_id), F.lit(DEALT)).cast("int"))
    # few bytes make many pairs: the number of partitions is given, or they would be put together by their bytes
    deal = lambda df: df.repartition(parts, "__key", "__part")
    first = F.when((F.size("__a") == 1) | (F.size("__b") == 1), F.lit(True)).otherwise(F.col("__key") == F.array_min(F.array_intersect("__a", "__b")))
    return deal(b).join(deal(a), ["__key", "__part"]).where(first).select(left_id, right_id)


def best_target(links: DataFrame, targets: DataFrame, link: str, target: str, words: str) -> DataFrame:
    """Each link's target with the most shared words, ties by target; links that share none have no row. A join on words, not of all pairs.

    Links with the same words are looked up once, and targets with the same words count by the least of them."""
    sets = lambda df, i: df.select(i, F.explode(F.array_distinct(words)).alias("__w")).groupBy(i).agg(F.array_sort(F.collect_list("__w")).alias("__words"))
    own = sets(links, link)
    asked = own.select("__words").distinct()
    named = sets(targets, target).groupBy(F.col("__words").alias("__of")).agg(F.min(F.struct(target))[target].alias(target))
    score = asked.select("__words", F.explode("__words").alias("__w")).join(named.select(target, F.explode("__of").alias("__w")), "__w").groupBy("__words", target).agg(F.count("*").alias("score"))
    best = score.groupBy("__words").agg(F.min_by(F.struct(target, "score"), F.struct(-F.col("score"), F.col(target))).alias("b"))
    return own.join(best, "__words").select(link, f"b.{target}", "b.score")
