"""Vector search: exact, and by inverted lists around centroids with exact scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from docketry.operators.lexical import Best, as_batch, blocks, hits_schema, in_scope, only

#: Vectors that centroids are fitted on at most, and the rounds of fitting.
MOST_FITTED, ROUNDS = 20_000, 10
#: Vectors that a task scores at once.
SLICE = 1024


def matrix(column: pa.Array, d: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column without nulls and of length d (or of the first row's), as one array, and their places. Read from the flat values."""
    start, there = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    size = np.diff(start)
    d = d if d is not None else int(size[there][0]) if there.any() else 0
    at = np.flatnonzero(there & (size == d))
    flat = column.values.to_numpy(zero_copy_only=False)
    return np.asarray(flat[start[:-1][at, None] + np.arange(d)], dtype=float).reshape(len(at), d), at


def cosines(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """[row, query], six digits; nan where a vector is all zeros."""
    lengths = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(queries, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.round(rows @ queries.T / lengths, 6) + 0.0


def search(queries: DataFrame, units: DataFrame, k: int, scope: DataFrame | None = None, held: list[Row] | None = None) -> DataFrame:
    """query_id, unit, score: of each task's units the k best of each query by exact cosine; null where a vector is all zeros, which come last.

    queries: query_id, q (array) (held: their rows, where they are known). units: unit, embedding; null embeddings and those of another length than q are left out."""
    schema = hits_schema(queries.schema["query_id"], units)
    rows = in_scope(units.where("embedding is not null").select("unit", F.col("embedding").cast("array<double>").alias("embedding")), scope)
    out = None
    for part in blocks(queries.select("query_id", "q").collect() if held is None else held):
        hits = rows.mapInArrow(_task([q["query_id"] for q in part], np.array([q["q"] for q in part], dtype=float).reshape(len(part), -1), k, scope is not None, schema), schema)
        out = hits if out is None else out.unionByName(hits)
    return out


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE))


#: Orders vectors without a direction after all others.
_LAST = -2.0


def _task(names: list, q: np.ndarray, k: int, scoped: bool, schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, place = Best(len(names), k), {n: i for i, n in enumerate(names)}
        for batch in batches:
            for part in slices(batch) if names else ():
                rows, at = matrix(part["embedding"], q.shape[1])
                score = np.nan_to_num(cosines(rows, q), nan=_LAST)
                unit = part["unit"].to_pylist()
                # only rows that come near some query's k best are looked at one by one
                bar = best.bar if scoped or len(score) <= k else np.maximum(best.bar, np.partition(score, len(score) - k, axis=0)[len(score) - k])
                for i in np.flatnonzero((score >= bar).any(axis=1)).tolist():
                    own = np.where(score[i] >= bar, score[i], np.nan)
                    if scoped:
                        some = only(part["__asked"][at[i]].as_py(), place)
                        own = np.full(len(names), np.nan)
                        own[some] = score[i, some]
                    best.add(unit[at[i]], own)
        yield as_batch([(n, u, None if s == _LAST else s) for n, u, s in best.rows(names)], schema)

    return run


def sampled(units: DataFrame, most: int = MOST_FITTED) -> np.ndarray:
    """About ``most`` of the distinct vectors, twice as many at most, with length 1. They are picked by their hash: the same ones whatever the partitions."""
    good = units.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(F.col("embedding").cast("array<double>").alias("v"))
    count = good.count()
    part = good if count <= most else good.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(1_000_000 * most / count))
    found = [r["v"] for r in part.distinct().limit(2 * most).collect()]
    if not found:
        return np.zeros((0, 1))
    d = len(found[0])
    x = np.array([v for v in found if len(v) == d and None not in v], dtype=float).reshape(-1, d)
    x = x[np.lexsort(x.T)] if x.size else x
    size = np.linalg.norm(x, axis=1)
    return x[size > 0] / size[size > 0, None]


def centroids(x: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """[list, dimension]: directions by spherical k-means."""
    rng = np.random.default_rng(seed)
    middle = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ middle.T).argmax(axis=1) if len(middle) else np.zeros(0, dtype=int)
        for c in range(len(middle)):
            if (mine := x[own == c].sum(axis=0)).any():
                middle[c] = mine / np.linalg.norm(mine)
    return middle


def probes_for(x: np.ndarray, middle: np.ndarray, k: int, recall: float, most: int = 200) -> int:
    """How many lists a query probes so that these hold the share ``recall`` of its k nearest, on up to ``most`` of the sampled vectors."""
    if not len(middle):
        return 0
    asked = x[np.linspace(0, len(x) - 1, min(most, len(x))).astype(int)]
    own = (x @ middle.T).argmax(axis=1)
    nearest = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(asked @ middle.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, own[nearest], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def fitted(units: DataFrame, lists: int, k: int, recall: float = 0.95) -> tuple[np.ndarray, int]:
    """Centroids of the lists, and how many a query probes; both from a bounded sample (see sampled). Every unit has a list (see inverted_lists)."""
    x = sampled(units)
    middle = centroids(x, lists)
    return middle, probes_for(x, middle, k, recall)


def inverted_lists(units: DataFrame, middle: np.ndarray) -> DataFrame:
    """Every unit with a vector, with its list: the centroid that it is nearest to. Write it partitioned by list, and a search reads only the lists that it probes."""
    d = middle.shape[1]

    @F.arrow_udf("int")
    def nearest(column: pa.Array) -> pa.Array:
        rows, at = matrix(column, d)
        out = np.full(len(column), -1, dtype=np.int32)
        if len(at) and len(middle):
            out[at] = (rows @ middle.T).argmax(axis=1)
        return pa.array(out)

    return units.where("embedding is not null").select("unit", "embedding", nearest(F.col("embedding").cast("array<double>")).alias("list"))


def probed(queries: np.ndarray, middle: np.ndarray, probes: int) -> np.ndarray:
    """[list, query]: whether the list's centroid is among the nearest to the query."""
    near = np.argsort(-(queries @ middle.T), axis=1, kind="stable")[:, :probes]
    out = np.zeros((len(middle), len(queries)), dtype=bool)
    out[near, np.arange(len(queries))[:, None]] = True
    return out


def approximate(queries: DataFrame, index: DataFrame, middle: np.ndarray, k: int, probes: int) -> DataFrame:
    """Like search(), over the units of the lists that each query probes. Vectors of zeros are in list 0, those of another length than the centroids in none.

    Which queries probe a list goes to the tasks once, not with each unit of the list."""
    schema = hits_schema(queries.schema["query_id"], index)
    rows = index.select("unit", F.col("embedding").cast("array<double>").alias("embedding"), "list")
    out = None
    for part in blocks(queries.select("query_id", "q").collect()):
        q = np.array([r["q"] for r in part], dtype=float).reshape(len(part), middle.shape[1])
        hits = rows.mapInArrow(_lists_task([r["query_id"] for r in part], q, probed(q, middle, probes), k, schema), schema)
        out = hits if out is None else out.unionByName(hits)
    return out


def _lists_task(names: list, q: np.ndarray, asked: np.ndarray, k: int, schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(names), k)
        for batch in batches:
            for part in slices(batch) if names else ():
                rows, at = matrix(part["embedding"], q.shape[1])
                unit, own = part["unit"].to_pylist(), part["list"].to_numpy(zero_copy_only=False)[at]
                for c in np.unique(own[own >= 0]).tolist():
                    mine, some = np.flatnonzero(own == c), np.flatnonzero(asked[c])
                    if len(some):
                        best.add_some([unit[i] for i in at[mine]], some, np.nan_to_num(cosines(rows[mine], q[some]), nan=_LAST))
        yield as_batch([(n, u, None if s == _LAST else s) for n, u, s in best.rows(names)], schema)

    return run
