"""Chat formatting by cumulative-snapshot collapse. DataFrame functions only.

A log that writes a conversation again after each turn holds every prefix of it. Each turn
has the rolling hash of its conversation up to there: two running sums of hashes of (place, role,
text). Anti-joins drop the conversations whose whole hash is a shorter prefix of another, and
the copies of one; the rest are rendered.

Turns are dealt by conversation once, and the hashes and the rendering read that same exchange; a rendered conversation is
one value, so one task has to hold it anyway, while sorting and running sums spill. Only places and hashes travel further.

Defined results: null roles and texts are empty; turns are ordered by (turn, role, text), null
turns first, and rows that repeat a whole turn count once; of equal conversations the one with
the smallest conv_id stays; rows without a conv_id are dropped; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SUMS = ("a0", "a1", "b0", "b1")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), last (whether the conversation ends there), role, text and the prefix hash up to there."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null").repartition("conv_id")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = F.lag(F.struct("turn", "role", "text")).over(order)
    rows = rows.withColumn("again", before.eqNullSafe(F.struct("turn", "role", "text"))).where(~F.col("again"))
    rows = rows.withColumn("place", F.row_number().over(order).cast("long"))
    one = F.xxhash64("place", "role", "text")
    two = F.xxhash64(F.lit("second"), "text", "role", "place")
    rows = rows.withColumns({"a0": one.bitwiseAND(F.lit(0xFFFFFFFF)), "a1": F.shiftrightunsigned(one, 32), "b0": two.bitwiseAND(F.lit(0xFFFFFFFF)), "b1": F.shiftrightunsigned(two, 32)})
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("conv_id", "place", F.lead("place").over(order).isNull().alias("last"), "role", "text", *[F.sum(c).over(running).alias(c) for c in _SUMS])


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that no longer one begins with."""
    steps = prefixes(turns)
    unique = steps.where("last").groupBy("place", *_SUMS).agg(F.min("conv_id").alias("conv_id"))
    shorter = steps.where(~F.col("last")).select("place", *_SUMS).distinct()
    return unique.join(shorter, ["place", *_SUMS], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and chat, the rendered text, of each maximal conversation."""
    kept = maximal(turns)
    parts = prefixes(turns).select("conv_id", "place", rendered(F.col("role"), F.col("text")).alias("part")).join(kept, "conv_id")
    whole = parts.groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("p"))
    return whole.select("conv_id", "n_turns", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("chat"))


ORACLE_SQL = """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place
  from (select distinct conv_id, turn, role, text from conversations where conv_id is not null)),
c as (
  select conv_id, count(*) as n_turns, list(struct_pack(r := role, x := text) order by place) as turns,
         string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by place) as chat
  from t group by conv_id),
p as (
  select distinct c.turns[1:k] as head from c, range(1, c.n_turns) as r(k))
select min(conv_id) as conv_id, n_turns, chat from c
where turns not in (select head from p) group by turns, n_turns, chat
"""
