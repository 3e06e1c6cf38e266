"""Best-fit packing of documents into training sequences.

The configuration linear program has a variable for each way (pattern) to fill a sequence
and a covering row for each piece length. It is solved over the length histogram, which has
at most ``capacity`` entries however many documents there are: multiplicative weights price
the lengths, a knapsack dynamic program bounds what a pattern is worth at these prices, and patterns are read off its table
as long as they are worth nearly that; then the lengths are priced anew, until every row is covered. The counts of the patterns
that are full enough are rounded down, and best fit completes what rounding leaves over; how full is enough is what gives the
fewest sequences, the most patterns where several do. Pieces then find their place from their rank among the pieces of their length.

Defined results: a null text is empty and still has its end token; pieces of one length take their places in the order of their
partition and place in it; repeated rows are packed each for itself; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import logging
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import map_arrow, materialise, text_or_empty
from docketry.llm.tokens import byte_tokenizer

log = logging.getLogger(__name__)
CAPACITY, END_ID = 2048, 0
#: How strongly a covered length loses weight, and what a pattern may lack of the best one's value before lengths are priced anew.
ETA, SLACK = 0.5, 0.002
#: Gaps that a pattern may have to count as full enough.
GAPS = (None, 64, 16, 8, 4, 2, 1, 0)
#: A length's first weight is its share of a sequence to this power: long pieces fit in fewer places and are priced above their length.
START = 0.3

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece; rank is its place among the pieces of its length in partition ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, seen = byte_tokenizer(tokenizer_path), np.zeros(capacity + 1, dtype=np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch["id"].to_pylist(), tokenizer.encode(batch["text"].to_pylist()), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                end = len(ids) % capacity or capacity
                cuts = [0, *range(end, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, int(seen[b - a])))
                    seen[b - a] += 1
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")), run, PIECES, text="text")


def knapsack(size: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """For each capacity the greatest value of pieces that fill at most it; sizes ascend and may be taken any number of times."""
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        n = upto[c]
        best[c] = max(best[c - 1], (best[c - size[:n]] + value[:n]).max()) if n else best[c - 1]
    return best


def read_off(best: np.ndarray, size: np.ndarray, value: np.ndarray, most: np.ndarray) -> tuple[list[int], list[int], float]:
    """A pattern from the knapsack's table: places of its sizes, how many of each, at most ``most``, and its value."""
    rows, times, worth = [], [], 0.0
    c, end, may = len(best) - 1, len(size), np.ones(len(size), dtype=bool)
    while True:
        end = int(np.searchsorted(size[:end], c, side="right"))
        if not end:
            return rows, times, worth
        gain = np.where(may[:end], best[c - size[:end]] + value[:end], -1.0)
        k = int(gain.argmax())
        if gain[k] < 0:
            return rows, times, worth
        n = 1
        # the same piece again as long as nothing is better
        while n < most[k] and (n + 1) * size[k] <= c and best[c - n * size[k]] - (best[c - (n + 1) * size[k]] + value[k]) <= 1e-12:
            n += 1
        may[k] = False
        rows.append(k)
        times.append(n)
        worth += n * value[k]
        c -= n * int(size[k])


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], float]]:
    """Patterns with their fractional counts that cover every row, by multiplicative weights; each step covers one row at least."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[n] for n in lengths.tolist()], dtype=float)
    weight, covered = (lengths / capacity) ** START, np.zeros(len(lengths))
    found: dict[tuple, float] = {}
    while (left := np.flatnonzero(covered < 1)).size:
        size, most = lengths[left], need[left].astype(np.int64)
        value = size * weight[left] / capacity
        best = knapsack(size, value, capacity)
        bar, first = 0.0, True
        while True:
            rows, times, worth = read_off(best, size, value, most)
            if first:
                bar, first = worth * (1 - SLACK), False
            if not rows or worth < bar:
                break
            at, n = left[rows], np.array(times, dtype=float)
            step = float((need[at] * (1 - covered[at]) / n).min())
            covered[at] += step * n / need[at]
            covered[at[need[at] * (1 - covered[at]) < 1e-9]] = 1
            weight[at] *= np.exp(-ETA * step * n / need[at])
            key = tuple(sorted(zip(lengths[at].tolist(), times, strict=True), reverse=True))
            found[key] = found.get(key, 0) + step
            value[rows] = size[rows] * weight[at] / capacity
            done = np.flatnonzero(covered[left] == 1)
            if len(done):
                open_ = covered[left] < 1
                left, size, value, most = left[open_], size[open_], value[open_], most[open_]
            if not len(left):
                break
        weight /= weight.max()
    return [(dict(k), x) for k, x in found.items()]


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns with whole counts, by taking the largest piece that fits again and again; what rounding leaves over is packed like this."""
    left, out = {n: c for n, c in histogram.items() if c}, []
    sizes = sorted(left)
    while sizes:
        pattern, gap = {}, capacity
        i = len(sizes) - 1
        while i >= 0:
            n = sizes[i]
            if k := min(gap // n, left[n]):
                pattern[n] = k
                gap -= n * k
            i = min(i, bisect_right(sizes, gap)) - 1
        times = min(left[n] // k for n, k in pattern.items())
        out.append((pattern, times))
        for n, k in pattern.items():
            left[n] -= k * times
        sizes = [n for n in sizes if left[n]]
    return out


def rounded(patterns: list[tuple[dict[int, int], float]], histogram: dict[int, int], capacity: int, gap: int | None) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Whole counts of the patterns with at most this gap, and the pieces that they leave over."""
    left, out = dict(histogram), []
    for pattern, x in sorted(patterns, key=lambda p: -p[1]):
        if gap is not None and capacity - sum(n * k for n, k in pattern.items()) > gap:
            continue
        if times := min(int(x + 1e-6), *(left[n] // k for n, k in pattern.items())):
            out.append((pattern, times))
            for n, k in pattern.items():
                left[n] -= k * times
    return out, {n: c for n, c in left.items() if c}


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns with whole counts that hold every piece of the histogram exactly once."""
    left = {int(n): int(c) for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError(f"piece lengths must be from 1 to {capacity}")
    patterns, best, fewest, whole = solve(left, capacity), [], None, 0
    for gap in GAPS:
        out, rest = rounded(patterns, left, capacity, gap)
        solved = sum(times for _, times in out)
        out = out + best_fit(rest, capacity)
        total = sum(times for _, times in out)
        if fewest is None or total < fewest:
            best, fewest, whole = out, total, solved
    log.info("%d sequences, %d of them by the program's patterns", fewest or 0, whole)
    return best


def bound(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs: by volume, once for every k with the pieces over capacity - k taken as alone in
    theirs, those over half as in different ones, and those under k left out; and by the dual of the program at the first prices."""
    if not histogram:
        return 0
    size = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[n] for n in size.tolist()], dtype=np.int64)
    counts, volume = np.zeros(capacity + 2, dtype=np.int64), np.zeros(capacity + 2, dtype=np.int64)
    counts[size], volume[size] = need, need * size
    counts, volume = counts.cumsum(), volume.cumsum()  # of the pieces up to each length
    least = 0
    for k in range(capacity // 2 + 1):
        alone, half = counts[capacity] - counts[capacity - k], counts[capacity - k] - counts[capacity // 2]
        room = half * capacity - (volume[capacity - k] - volume[capacity // 2])
        rest = volume[capacity // 2] - (volume[k - 1] if k else 0)
        least = max(least, int(alone + half + max(0, -(-(rest - room) // capacity))))
    value = (size / capacity) ** (1 + START)
    return max(least, int(np.ceil((need * value).sum() / knapsack(size, value, capacity)[-1] - 1e-6)))


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length and pattern: the first rank that goes there, the first sequence, pieces a sequence, the offset."""
    rows, seen, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for n, k in sorted(pattern.items(), reverse=True):
            rows.append((n, seen.get(n, 0), sequence, k, offset))
            seen[n] = seen.get(n, 0) + k * times
            offset += n * k
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T.copy(), strict=True))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    pieces = materialise(cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(histogram, capacity))
    span = int(max(histogram.values(), default=0)) + 1
    if span * (capacity + 1) >= 2**63:
        raise ValueError("too many pieces for 64-bit ranks")
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = table["length"] * span + table["rank"] if len(table["length"]) else np.zeros(0, dtype=np.int64)
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy() + batch["before"].to_numpy()
            at = np.searchsorted(edge, length * span + rank, side="right") - 1
            within = rank - table["rank"][at]
            each = table["each"][at]
            sequence = table["sequence"][at] + within // each
            offset = table["offset"][at] + within % each * length
            cols = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_arrow(pieces.join(before, ["part", "length"]), place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
