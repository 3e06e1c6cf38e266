"""Interaction audit of document filters by a packed bitmap index.

A pass over the texts gives each document its part, the filters that it fails and a digest of its text; whether a text
is a copy comes from the smallest id of its digest. Each partition then holds its documents as bitmaps, a bit a document:
one a filter, one a label, one a part. What a set of filters leaves is the part's bitmap AND NOT theirs; what the next
filter removes of it is counted by AND and popcount, for each of the prefix sets (32 of five filters) instead of
each order of the filters. Counts of partitions are summed; the 120 orders are read from the sums.

Defined results: a null text is empty and fails A, not B (0 words of 0) and not C; a null part is the empty string; documents
with one id and one text aren't copies of each other, nor is a document without an id a copy or one that others copy; a
document is good or toxic if any of its rows in labels says so; documents without an id have no labels; repeated rows count
each; an empty table gives no rows; columns other than the three (or two of labels) are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import lookup, map_arrow, materialise, tasks_for

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
LEAST_WORDS = 200
#: Documents whose bits are held at once, and parts whose bitmaps are.
BLOCK, PARTS = 1 << 18, 64
#: The rows of a digest or an id are dealt into this many parts at least, one for each ROWS_A_PART rows.
DEALT, ROWS_A_PART = 64, 1_000_000


def text_failures(data: bytes, n_chars: int) -> int:
    """Bits of the filters that a text fails by itself, A the lowest."""
    words = data.split()  # by the blanks 0x20 and 0x09 to 0x0D
    capitals = len(data) - len(data.translate(None, CAPITALS))
    fails = len(words) < LEAST_WORDS, 2 * len(set(words)) < len(words), 100 * capitals > 3 * n_chars, len(data.translate(None, SIGNS)) < len(data)
    return sum(bool(f) << k for k, f in enumerate(fails))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, fails (bits of the filters in order) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fails, digests = [], []
            for text in batch["text"].to_pylist():
                data = text.encode("utf-8", "surrogatepass")
                fails.append(text_failures(data, len(text)))
                digests.append(hashlib.sha256(data).digest())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["part"], pa.array(fails, type=pa.int32()), pa.array(digests, type=pa.binary())], names=["id", "part", "fails", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = materialise(map_arrow(rows, run, "id long, part string, fails int, digest binary", text="text"), "failures")
    # only texts that repeat need to be looked up: of the others no id is greater than the smallest
    copied = rows.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("digest", "least")
    found = lookup(rows, ["digest"], copied, ["id"], max(DEALT, tasks_for(rows.count(), ROWS_A_PART)), "left")
    copy = F.when(F.col("id") > F.col("least"), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    return found.select("id", "part", F.col("fails").bitwiseOR(copy).alias("fails"))


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """rows with marks: 1 for a good document, 2 for a toxic one, 3 for one that is both."""
    says = lambda c: F.max((F.col(c) == 1).cast("int"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.coalesce(says(good_col), F.lit(0)) + 2 * F.coalesce(says(toxic_col), F.lit(0))).alias("marks"))
    with_id = rows.where("id is not null").join(marks.where("marks > 0"), "id", "left").select("part", "fails", F.coalesce("marks", F.lit(0)).alias("marks"))
    return with_id.unionByName(rows.where("id is null").select("part", "fails", F.lit(0).alias("marks")))


def _words(bits: np.ndarray) -> np.ndarray:
    """Packed bits in 64-bit words; the last axis is the documents."""
    packed = np.packbits(bits, axis=-1)
    short = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (bits.ndim - 1) + [(0, short)])).view(np.uint64)


def _ones(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)


class BitmapIndex:
    """Bitmaps of some documents: fails (filters), marks (good, toxic) and parts, each [k, words]."""

    def __init__(self, part: np.ndarray, fails: np.ndarray, marks: np.ndarray, parts: int):
        self.fails = _words((fails >> np.arange(len(FILTERS))[:, None] & 1).astype(bool))
        self.marks = _words((marks >> np.arange(2)[:, None] & 1).astype(bool))
        self.parts = _words(part == np.arange(parts)[:, None])

    def left(self, removed: int) -> np.ndarray:
        """The bitmap of each part AND NOT the filters in the set ``removed``."""
        kept = self.parts
        for k in range(len(FILTERS)):
            if removed >> k & 1:
                kept = kept & ~self.fails[k]
        return kept

    def counts(self) -> np.ndarray:
        """[part, prefix set, filter or none (last), count]: documents left that fail the filter (all that are left for none), good ones, toxic ones."""
        out = np.zeros((len(self.parts), SUBSETS, len(FILTERS) + 1, 3), dtype=np.int64)
        for removed in range(SUBSETS):
            kept = self.left(removed)
            for k in range(len(FILTERS) + 1):
                if k == len(FILTERS) or not removed >> k & 1:
                    hit = kept if k == len(FILTERS) else kept & self.fails[k]
                    out[:, removed, k, 0] = _ones(hit)
                    for m in range(2):
                        out[:, removed, k, 1 + m] = _ones(hit & self.marks[m])
        return out


def prefix_counts(rows: DataFrame) -> DataFrame:
    """part, removed (prefix set), filter (its place, the last one for none), n, good, toxic over all documents of rows (part, fails, marks)."""
    cells = [(s, k) for s in range(SUBSETS) for k in range(len(FILTERS) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        chunk: list[pa.RecordBatch] = []
        size = 0

        def batch_of(items: dict[str, np.ndarray]) -> pa.RecordBatch:
            table = np.concatenate([c.reshape(-1, 3) for c in items.values()])
            removed, place = np.array(cells * len(items), dtype=np.int32).T
            names = pa.array([name for name in items for _ in cells], type=pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(removed), pa.array(place), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], names=["part", "removed", "filter", "n", "good", "toxic"])

        def count() -> Iterator[pa.RecordBatch]:
            nonlocal held, chunk, size
            if not size:
                return
            table = pa.Table.from_batches(chunk).combine_chunks()
            names = table["part"].combine_chunks().dictionary_encode()
            code = names.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            code, fails, marks = code[order], table["fails"].to_numpy()[order], table["marks"].to_numpy()[order]
            names = names.dictionary.to_pylist()
            for first in range(0, len(names), PARTS):
                a, b = np.searchsorted(code, [first, first + PARTS])
                found = BitmapIndex(code[a:b] - first, fails[a:b], marks[a:b], min(PARTS, len(names) - first)).counts()
                for name, counts in zip(names[first : first + PARTS], found, strict=True):
                    held[name] = held[name] + counts if name in held else counts
                if len(held) >= 16 * PARTS:
                    yield batch_of(held)
                    held = {}
            chunk, size = [], 0

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                chunk.append(batch.slice(at, BLOCK))
                size += chunk[-1].num_rows
                if size >= BLOCK:
                    yield from count()
        yield from count()
        if held:
            yield batch_of(held)

    found = map_arrow(rows.select("part", "fails", "marks"), run, "part string, removed int, filter int, n long, good long, toxic long")
    return found.groupBy("part", "removed", "filter").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = prefix_counts(labelled(failures(docs, id_col, text_col, part_col), labels, id_col))
    width = len(FILTERS) + 1
    # 192 cells a part, in the order of their places
    parts = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct((F.col("removed") * width + F.col("filter")).alias("at"), "n", "good", "toxic"))).alias("cells"))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    place_at = lambda step: F.instr(F.lit(FILTERS), F.substr("filter_order", step, F.lit(1))) - 1
    earlier = F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda s, i: F.when(i < F.col("step"), s + F.call_function("shiftleft", F.lit(1), place_at(i))).otherwise(s))
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumns({"before": earlier, "filter": place_at(F.col("step"))})

    def cell(removed: Column, place: Column) -> Column:
        return F.get("cells", removed * width + place)

    before, place = F.col("before"), F.col("filter")
    here, fails = cell(before, place), cell(F.lit(0), place)["n"]
    others = F.lit(SUBSETS - 1) - F.call_function("shiftleft", F.lit(1), place)
    # the orders in which exactly this set of filters comes before
    weights = F.array(*(F.lit(factorial(s.bit_count()) * factorial(max(0, len(FILTERS) - 1 - s.bit_count()))).cast("long") for s in range(SUBSETS)))
    shapley = F.aggregate(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), F.lit(0).cast("long"), lambda total, s: total + F.get(weights, s) * cell(s, place)["n"])
    return steps.select(
        "part", "filter_order", "step", (cell(before, F.lit(len(FILTERS)))["n"] - here["n"]).alias("kept"), here["n"].alias("removed"), (fails - here["n"]).alias("redundant"),
        cell(others, place)["n"].alias("unique_fails"), here["good"].alias("good_lost"), here["toxic"].alias("toxic_lost"), shapley.alias("shapley"),
    )


ORACLE_SQL = r"""
with least as (select coalesce(text, '') as t, min(doc_id) as first from documents group by 1),
said as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by doc_id),
words as (select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
flags as (
  select coalesce(lang, '') as part, len(w) < 200 as "A", 100 * list_unique(w) < 50 * len(w) as "B",
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) as "C", regexp_matches(t, '[#$%&*|]') as "D", coalesce(doc_id > first, false) as "E",
         coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from words join least using (t) left join said using (doc_id)),
kinds as (
  select part, case when "A" then 1 else 0 end + case when "B" then 2 else 0 end + case when "C" then 4 else 0 end + case when "D" then 8 else 0 end + case when "E" then 16 else 0 end as fails,
         count(*) as n, sum(good) as good, sum(toxic) as toxic
  from flags group by all),
letters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as l(letter, bit)),
perms as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a, letters b, letters c, letters d, letters e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps as (select filter_order, cast(step as integer) as step, bits[step] as bit, cast(coalesce(list_sum(bits[1:step - 1]), 0) as integer) as before from perms, range(1, 6) as r(step)),
found as (
  select part, filter_order, step, bit,
         sum(case when fails & (before | bit) = 0 then n else 0 end) as kept,
         sum(case when fails & before = 0 and fails & bit > 0 then n else 0 end) as removed,
         sum(case when fails & before > 0 and fails & bit > 0 then n else 0 end) as redundant,
         sum(case when fails = bit then n else 0 end) as unique_fails,
         sum(case when fails & before = 0 and fails & bit > 0 then good else 0 end) as good_lost,
         sum(case when fails & before = 0 and fails & bit > 0 then toxic else 0 end) as toxic_lost
  from kinds, steps group by part, filter_order, step, bit)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
       cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from found
"""
