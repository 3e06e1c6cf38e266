"""Whitening of embeddings by matrix-free block Lanczos.

Vectors become integers (256ths, rounded down). The fit list holds each integer vector once; its covariance is never
formed: a pass over the list multiplies the centred vectors with a block of directions and back (XᵀXv), in tasks, and what
reaches the driver is a number for each dimension and direction. The block Lanczos process keeps all its directions and
orthogonalises each new block against them twice. Where a block breaks down (the directions span an invariant subspace), random
directions that are orthogonal to all others take the place of the lost ones. It ends when the residuals of the wanted
components are at rounding level, or all dimensions are spanned. The trace comes from the deviations of the vectors.

Defined results: rows whose vector is null, holds a null or non-finite entry or one whose 256ths are beyond a long, or has
another length than most vectors (the longer of two that are as common) are dropped; of empty vectors there are no components and no rows;
with fewer dimensions than components there are as many components as dimensions; a component without variance (fewer
distinct vectors than components, or constant entries) has a null ``whitened`` and isn't counted in ``identity_error``;
a deviation beyond a long is null; equal eigenvalues have any orthonormal components of their space; repeated rows have
a result each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import map_arrow, materialise

SCALE, COMPONENTS, BLOCK = 256, 4, 16
#: Residuals of the components against the largest eigenvalue.
TOLERANCE = 1e-14
#: A direction whose part outside of the others is below this share of it is lost to rounding.
LOST = 1e-10
#: What counts as no variance against the trace.
NOTHING = 1e-12
#: Vectors that are centred at once.
ROWS = 1 << 13
MAX_LONG = 2**63 - 1


def encoded(x: np.ndarray) -> list[bytes]:
    """A key of each row of whole numbers: equal rows, equal keys. The first byte is the width of the entries."""
    least, most = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(x)
    width = np.select([(least >= -(2**15)) & (most < 2**15), (least >= -(2**31)) & (most < 2**31)], [2, 4], 8)
    for w in (2, 4, 8):
        at = np.flatnonzero(width == w)
        raw, size = x[at].astype(f"<i{w}").tobytes(), x.shape[1] * w
        for k, row in enumerate(at.tolist()):
            out[row] = bytes([w]) + raw[k * size : (k + 1) * size]
    return out


def decoded(keys: list[bytes], d: int) -> np.ndarray:
    x = np.zeros((len(keys), d), dtype=np.int64)
    width = np.fromiter((k[0] for k in keys), dtype=np.int64, count=len(keys))
    for w in (2, 4, 8):
        at = np.flatnonzero(width == w)
        if len(at):
            x[at] = np.frombuffer(b"".join([keys[i][1:] for i in at.tolist()]), dtype=f"<i{w}").reshape(len(at), d)
    return x


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, size, key (see encoded) of the rows whose vector has finite entries alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["vector"]
            values = lists.values.fill_null(np.nan).to_numpy(zero_copy_only=False) * scale
            start = lists.offsets.to_numpy()
            size, start = np.diff(start), start[:-1]
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            rows, sizes, keys = [], [], []
            for d in np.unique(size[there]).tolist():
                at = np.flatnonzero(there & (size == d))
                x = np.floor(values[start[at, None] + np.arange(d)])
                # nan fails the comparison
                whole = (np.abs(x) < 2.0**63).all(axis=1)
                rows += at[whole].tolist()
                sizes += [d] * int(whole.sum())
                keys += encoded(x[whole].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(rows, type=pa.int64())), pa.array(sizes, type=pa.int32()), pa.array(keys, type=pa.binary())], names=["id", "size", "key"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return map_arrow(rows, run, "id long, size int, key binary")


def blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The vectors of batches with a key, some ROWS at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, decoded(part["key"].to_pylist(), d)


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Sums over the rows, in whole numbers of any size."""
    if x.size and int(np.abs(x).max()) < 2**62 // len(x):
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0) if len(x) else np.zeros(x.shape[1], dtype=object)


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """The sum over the dimensions of (n x - total)^2 for each row, exactly."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, total), default=0)
    y = n * (x if most < 2**63 else x.astype(object)) - np.array(total, dtype=np.int64 if most < 2**63 else object)
    if most * most * x.shape[1] >= 2**63:
        y = y.astype(object)
    return [int(v) for v in (y * y).sum(axis=1)]


@dataclass
class Fit:
    """n distinct vectors with their sums; components as columns, their eigenvalues and the trace; identity_error of what they whiten."""

    n: int
    total: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """A column for each component, nan for those without variance."""
        found = centred(x, self.n, self.total) @ self.components
        found[:, self.flat()] = np.nan
        found[:, ~self.flat()] /= np.sqrt(self.values[~self.flat()])
        return found

    def flat(self) -> np.ndarray:
        return ~(self.values > NOTHING * self.trace)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    mean = np.array([s / n for s in total])
    return x.astype(float) - mean


def summed(fit: DataFrame, d: int, task, width: int) -> np.ndarray:
    """[d, width]: task(blocks of vectors) gives such a matrix for its partition; they are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = task(x for _, x in blocks(batches, d))
        row, col = np.indices(part.shape)
        yield pa.RecordBatch.from_arrays([pa.array(row.ravel().astype("int32")), pa.array(col.ravel().astype("int32")), pa.array(part.ravel())], names=["row", "col", "v"])

    out = None
    for r in map_arrow(fit.select("key"), run, "row int, col int, v double").groupBy("row", "col").agg(F.sum("v").alias("v")).collect():
        out = np.zeros((r["row"] + 1, width)) if out is None else out
        if r["row"] >= len(out):
            out = np.pad(out, [(0, r["row"] + 1 - len(out)), (0, 0)])
        out[r["row"], r["col"]] = r["v"]
    return np.zeros((d, width)) if out is None else out


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=object)
        for _, x in blocks(batches, d):
            n += len(x)
            total = total + exact_sum(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), type=pa.int32()), pa.array([str(n), *map(str, total)])], names=["row", "v"])

    found = map_arrow(fit.select("key"), run, "row int, v string").groupBy("row").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    by = {r["row"]: int(r["v"]) for r in found}
    return by.get(-1, 0), [by.get(k, 0) for k in range(d)]


def orthonormal(block: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of a block outside of the basis, as orthonormal columns q, with r such that block = basis part + q r; lost directions are left out of q."""
    size = np.linalg.norm(block, axis=0)
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    columns: list[np.ndarray] = []
    r = np.zeros((0, block.shape[1]))
    for k in range(block.shape[1]):
        q = np.array(columns).T.reshape(len(block), len(columns))
        v, along = block[:, k], np.zeros(len(columns))
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
            part = q.T @ v
            v, along = v - q @ part, along + part
        length = np.linalg.norm(v)
        r[:, k] = along
        if length > LOST * size[k]:
            columns.append(v / length)
            r = np.vstack([r, np.zeros(block.shape[1])])
            r[-1, k] = length
    return np.array(columns).T.reshape(len(block), len(columns)), r


def lanczos(multiply, d: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``wanted`` eigenvalues and their vectors (columns) of a symmetric matrix that is known by multiply(V) alone."""
    rng = np.random.default_rng(seed)
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    fresh = rng.standard_normal((d, min(block, d)))
    while True:
        new, _ = orthonormal(fresh, basis)
        short = min(block, d - basis.shape[1]) - new.shape[1]
        restart = short > 0
        while short > 0:  # a breakdown
            more, _ = orthonormal(rng.standard_normal((d, short)), np.hstack([basis, new]))
            new, short = np.hstack([new, more]), short - more.shape[1]
        image = multiply(new)
        basis, images = np.hstack([basis, new]), np.hstack([images, image])
        small = basis.T @ images
        values, inner = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(values)[::-1][:wanted]
        values, vectors = values[best], basis @ inner[:, best]
        if basis.shape[1] == d:
            break
        residual = np.linalg.norm(images @ inner[:, best] - vectors * values, axis=0)
        # after a restart the new directions have yet to show what they lead to
        if len(best) == wanted and not restart and (residual <= tolerance * max(abs(values[0]), np.finfo(float).tiny)).all():
            break
        fresh = image
    q, _ = np.linalg.qr(vectors)
    return values, q * np.sign((q * vectors).sum(axis=0))


def fit_on(distinct: DataFrame, d: int, components: int = COMPONENTS, block: int = BLOCK) -> Fit:
    """distinct: a column key, each vector once."""
    n, total = sums(distinct, d)
    if not n:
        return Fit(0, total, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0)

    def multiply(v: np.ndarray) -> np.ndarray:
        def task(parts: Iterator[np.ndarray]) -> np.ndarray:
            out = np.zeros(v.shape)
            for x in parts:
                y = centred(x, n, total)
                out += y.T @ (y @ v)
            return out

        return summed(distinct, d, task, v.shape[1]) / n

    # a task's sum is exact, and so is the trace but for the rounding of the tasks' sums
    trace = float(summed(distinct, d, lambda parts: np.array([[float(sum(sum(deviations(x, n, total)) for x in parts))]]), 1)[0, 0] / float(n) ** 3)
    values, vectors = lanczos(multiply, d, min(components, d), min(block, d))
    found = Fit(n, total, vectors, np.maximum(values, 0), trace, 0.0)
    some = np.flatnonzero(~found.flat())
    if len(some):

        def moments(parts: Iterator[np.ndarray]) -> np.ndarray:
            out = np.zeros((len(some), len(some) + 1))
            for x in parts:
                w = found.whitened(x)[:, some]
                out += np.hstack([w.T @ w, w.sum(axis=0)[:, None]])
            return out

        seen = summed(distinct, d, moments, len(some) + 1) / n
        mean = seen[:, -1]
        found.identity_error = float(np.abs(seen[:, :-1] - np.outer(mean, mean) - np.eye(len(some))).max())
    return found


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each vector and component."""
    rows = materialise(integers(vectors, id_col, vector_col), "vectors")
    common = rows.groupBy("size").agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("size")).first()
    d = common["size"] if common else 0
    rows = rows.where(F.col("size") == d)
    found = fit_on(materialise(rows.select("key").distinct(), "fit"), d, components, block)
    count = found.components.shape[1] if found.n else 0
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
    explained = found.values / found.trace if found.trace else np.zeros(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, d):
            if not count:
                continue
            white = found.whitened(x).ravel()
            deviation = [v if v <= MAX_LONG else None for v in deviations(x, found.n, found.total)]
            k = len(x)
            cols = [
                part["id"].take(pa.array(np.repeat(np.arange(k), count))), pa.array(np.tile(np.arange(1, count + 1), k).astype("int32")), pa.array(np.full(k * count, found.n)),
                pa.array([v for v in deviation for _ in range(count)], type=pa.int64()), pa.array(white, mask=np.isnan(white)), pa.array(np.tile(explained, k)), pa.array(np.full(k * count, found.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return map_arrow(rows, run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
