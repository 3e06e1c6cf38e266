"""Similarity join of documents by the Jaccard similarity of their word n-grams.

Texts with one n-gram set are one node with its multiplicity. MinHash values, 16 bits each,
are the candidate filter: BANDS bands of four values put nodes into buckets, and nodes that
share a bucket are compared value by value; a pair goes as soon as the posterior probability
that its similarity reaches the threshold, given the matches so far, falls below TOLERANCE.
What remains is verified on the whole n-gram sets.

Pairs are made inside the tasks and never become rows of a shuffle: a bucket sends out the
link count of each node and one edge to its component. Buckets with the same members are
compared once; in the others a pair belongs to the first band that it shares, so that each is
verified once. Only the MinHash values of a bucket's nodes travel at first; the n-gram sets follow
for the nodes that have a partner left. Buckets of over BLOCK nodes are compared block by block, in as many tasks as
there are pairs of blocks. How many blocks a bucket has follows from the bytes of its sets: a node is copied MAX_BLOCKS times at most
until these come to MAX_BLOCKS times MOST_BYTES, and no task holds more than two blocks of MOST_BYTES, which it goes through tile by tile. With the defaults a pair at the threshold shares no band with a
probability of 5e-8.

Defined results: words are what stands between white space, in lower case; a text of fewer than
n words has one n-gram of all its words; texts without words (null ones too) are in no bucket, have
no links and are classes of their own; an n-gram is named by 64 mixed bits of its words' hashes, and verification compares
these names. A node is named by the smallest id of its texts with that text's hash, so that different texts with one id, or
with none, are different nodes; a class has the smallest id that it holds, and a null one where it holds null ids alone (ids
are below 2^63 - 1); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import discard, map_arrow, materialise, text_or_empty, unused
from docketry.llm.components import components
from docketry.llm.segments import mix, words

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
HASHES, STEP = BANDS * ROWS, 16
TOLERANCE = 1e-8
#: Nodes of a block, and bytes of their n-gram sets, until a bucket has MAX_BLOCKS blocks; beyond, a block grows to MOST_BYTES, and then their number goes on.
BLOCK, BLOCK_BYTES, MAX_BLOCKS, MOST_BYTES = 256, 1 << 20, 64, 64 << 20
#: Nodes on each side whose pairs are made at once, and pairs that are verified at once.
TILE, PAIRS = 256, 1 << 20
#: Stands for a null id: it comes after every other one.
NO_ID = 2**63 - 1
_rng = np.random.default_rng(20)
_A = (_rng.integers(1, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingles(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    """For each text the ascending hashes of its word n-grams, each once."""
    w = words(texts, marks_apart=False)
    names, doc = w.names(), w.doc
    count = np.bincount(doc, minlength=len(texts))
    total, step = np.zeros(len(names), dtype=np.uint64), np.uint64(0x9E3779B97F4A7C15)
    first = np.cumsum(count) - count
    left = (first + count)[doc] - np.arange(len(names))
    for i in range(n):
        shifted = np.zeros(len(names), dtype=np.uint64)
        if i < len(names):
            shifted[: len(names) - i] = names[i:]
        total = np.where(left > i, total * step + shifted, total)
    total = mix(total)
    out = []
    for a, k in zip(first.tolist(), count.tolist(), strict=True):
        out.append(np.unique(total[a : a + max(min(k, 1), k - n + 1)]))
    return out


def signature(grams: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 16 bits."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(low, (_A[:, None] * x[None, i : i + 4096] + _B[:, None]).min(axis=1), out=low)
    low = low * np.uint32(0x9E3779B1)
    return (low >> np.uint32(16)).astype("<u2")


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """After each STEP of values: the matches from which P(similarity >= threshold) >= tolerance, under a uniform prior.

    The similarity given m matches of n is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def named(docs: DataFrame, id_col: str, text_col: str, rep: str = "rep", tie: str = "tie") -> DataFrame:
    """docs with the name of each row: its id, NO_ID for a null one, and its text's hash."""
    return docs.withColumns({rep: F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)), tie: F.xxhash64(F.coalesce(docs[text_col], F.lit("")))})


def sketch(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, rep and tie (see named), n_shingles, key (a digest of the set) and sig (a band each); key and sig are null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            keys, sigs, sizes = [], [], []
            for grams in shingles(batch["text"].to_pylist(), n):
                sizes.append(len(grams))
                keys.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                sigs.append(signature(grams).view("<i8") if len(grams) else None)
            cols = [batch["doc_id"], batch["rep"], batch["tie"], pa.array(sizes, type=pa.int64()), pa.array(keys, type=pa.binary()), pa.array(sigs, type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "rep", "tie", "n_shingles", "key", "sig"])

    rows = named(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), "doc_id", "text")
    return map_arrow(rows, run, "doc_id long, rep long, tie long, n_shingles long, key binary, sig array<long>", text="text")


class Compare:
    """The verified pairs of one bucket, or of two blocks of it."""

    def __init__(self, threshold: float, tolerance: float):
        self.ratio = Fraction(str(threshold))
        self.least = least_matches(threshold, tolerance)

    def candidates(self, sig: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, band: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places from left and right, tile by tile, whose first shared band is this one and that sizes and MinHash values allow."""
        for x in range(0, len(left), TILE):
            for y in range(x if left is right else 0, len(right), TILE):
                one = left[x : x + TILE]
                a, b = self._tile(sig, size, one, one if left is right and x == y else right[y : y + TILE], band)
                if len(a):
                    yield a, b

    def pairs(self, sig: np.ndarray, grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, band: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The verified pairs, about PAIRS candidates at a time."""
        size, held, n = np.array([len(g) for g in grams]), [], 0
        for a, b in self.candidates(sig, size, left, right, band):
            held.append((a, b))
            n += len(a)
            if n >= PAIRS:
                yield self.verify(grams, *map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if held:
            yield self.verify(grams, *map(np.concatenate, zip(*held, strict=True)))

    def _tile(self, sig: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
        if left is right:
            i, j = np.triu_indices(len(left), 1)
        else:
            i, j = (x.ravel() for x in np.indices((len(left), len(right))))
        a, b = left[i], right[j]
        num, den = self.ratio.numerator, self.ratio.denominator
        ok = np.minimum(size[a], size[b]) * den >= np.maximum(size[a], size[b]) * num
        a, b = a[ok], b[ok]
        for t in range(band):
            ok = sig[a, t] != sig[b, t]
            a, b = a[ok], b[ok]
        values = sig.view("<u2")
        same = np.zeros(len(a), dtype=np.int64)
        for k, least in enumerate(self.least):
            part = slice(k * STEP, (k + 1) * STEP)
            same += np.concatenate([(values[a[x : x + 50_000], part] == values[b[x : x + 50_000], part]).sum(axis=1) for x in range(0, len(a), 50_000)]) if len(a) else 0
            ok = same >= least
            a, b, same = a[ok], b[ok], same[ok]
        return a, b

    def verify(self, grams: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that reach the threshold, with the size of what they share."""
        if not len(a):
            return a, b, a
        used = np.unique(np.concatenate([a, b]))
        distinct, codes = np.unique(np.concatenate([grams[i] for i in used.tolist()]), return_inverse=True)
        size = np.zeros(len(grams), dtype=np.int64)
        size[used] = [len(grams[i]) for i in used.tolist()]
        start = np.zeros(len(grams), dtype=np.int64)
        start[used] = np.cumsum(size[used]) - size[used]
        mark = np.zeros(len(distinct), dtype=bool)
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        shared = np.zeros(len(a), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(a, prepend=-1, append=-1))
        for x, y in zip(cuts, cuts[1:], strict=False):
            own = codes[start[a[x]] : start[a[x]] + size[a[x]]]
            mark[own] = True
            for z in range(x, y, 256):
                others = b[z : min(y, z + 256)]
                ends = np.cumsum(size[others])
                take = np.arange(int(ends[-1])) + np.repeat(start[others] - (ends - size[others]), size[others])
                shared[z : z + len(others)] = np.add.reduceat(mark[codes[take]].astype(np.int64), ends - size[others])
            mark[own] = False
        ok = shared * self.ratio.denominator >= (size[a] + size[b] - shared) * self.ratio.numerator
        return a[ok], b[ok], shared[ok]


class _Roots:
    """The smallest node of each node's component, over pairs that come batch by batch; nodes are numbered in their order."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                next_ = self.root[self.root]
                if (next_ == self.root).all():
                    break
                self.root = next_


_PLACE = ("band", "key", "i", "j", "own", "rep", "tie", "copies")


def _dealt(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition(*_PLACE[:4]).sortWithinPartitions(*_PLACE[:7]).select(*_PLACE, *more)


def _groups(batches: Iterator[pa.RecordBatch], more: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Each bucket or pair of blocks with its nodes, each once, where there are at least two."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in (*_PLACE, *more)), strict=True):
            if row[:4] != at:
                if len(held) > 1:
                    yield at, held
                at, held = row[:4], []
            if not held or held[-1][5:7] != row[5:7]:
                held.append(row)
    if len(held) > 1:
        yield at, held


def _sides(at: tuple, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left = np.flatnonzero(own == at[2])
    return (left, left) if at[2] == at[3] else (left, np.flatnonzero(own == at[3]))


class Join:
    """One similarity join: nodes, then verified links or pairs, classes and memberships."""

    def __init__(self, docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, max_blocks: int = MAX_BLOCKS, id_col: str = "doc_id", text_col: str = "text"):
        self.docs, self.n, self.threshold, self.tolerance, self.block, self.max_blocks = docs, n, threshold, tolerance, block, max_blocks
        self.id_col, self.text_col = id_col, text_col
        self.sketches = materialise(sketch(docs, n, id_col, text_col), "sketches")
        nodes = self.sketches.where("key is not null").groupBy("key").agg(F.min(F.struct("rep", "tie")).alias("name"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size"))
        self.nodes = materialise(nodes.select("key", "name.rep", "name.tie", "copies", "sig", "size"), "nodes")

    def _blocks(self) -> DataFrame:
        """Rows dealt by (band, key, i, j): nodes with their sets, a bucket or a pair of its blocks in one task."""
        members = self.nodes.select("rep", "tie", "copies", "size", F.posexplode("sig").alias("band", "key"))
        one = F.xxhash64("rep", "tie")
        buckets = members.groupBy("band", "key").agg(F.count("*").alias("c"), F.sum(8 * F.col("size") + 2 * HASHES).alias("bytes"), F.bit_xor(one).alias("x"), F.min(one).alias("lo"), F.max(one).alias("hi")).where("c > 1")
        unique = buckets.groupBy("c", "bytes", "x", "lo", "hi").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key", "c", "bytes")
        wanted = F.greatest(F.ceil(F.col("c") / self.block), F.ceil(F.col("bytes") / BLOCK_BYTES))
        blocks = F.greatest(F.least(wanted, F.lit(self.max_blocks)), F.ceil(F.col("bytes") / MOST_BYTES)).cast("int")
        members = members.drop("size").join(unique, ["band", "key"]).join(self.nodes.select("rep", "tie", "sig", "size"), ["rep", "tie"])
        placed = members.withColumn("own", F.pmod(one, blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        placed = placed.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "tie", "copies", "sig", "size")
        self.likely = likely = self._likely(_dealt(placed, "sig", "size"))
        names = likely.select("rep", "tie").distinct()
        texts = self.docs.select(F.col(self.id_col).alias("id"), text_or_empty(self.text_col).alias("text"))
        # shuffled and sorted at every size: a plan that changes to it only on large tables can't be measured on small ones
        texts = named(texts, "id", "text").select("rep", "tie", "text").join(names.hint("merge"), ["rep", "tie"], "left_semi")
        n = self.n

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = shingles(batch["text"].to_pylist(), n)
                sig = [signature(g).view("<i8") for g in found]
                yield pa.RecordBatch.from_arrays([batch["rep"], batch["tie"], pa.array(sig, type=pa.list_(pa.int64())), pa.array([g.tobytes() for g in found], type=pa.binary())], names=["rep", "tie", "sig", "grams"])

        payload = map_arrow(texts, sets, "rep long, tie long, sig array<long>, grams binary", text="text")
        # a node once a bucket, with the pairs of blocks that it is in: one for each block of the bucket at most
        once = likely.groupBy("band", "key", "rep", "tie", "copies").agg(F.collect_list(F.struct("i", "j", "own")).alias("blocks"))
        placed = once.join(payload, ["rep", "tie"]).withColumn("block", F.explode("blocks")).select("band", "key", "block.i", "block.j", "block.own", "rep", "tie", "copies", "sig", "grams")
        return _dealt(placed, "sig", "grams")

    def _likely(self, dealt: DataFrame) -> DataFrame:
        """Members of a bucket that have a partner left after the comparison of MinHash values: only their sets travel."""
        threshold, tolerance = self.threshold, self.tolerance

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            compare = Compare(threshold, tolerance)
            for at, rows in _groups(batches, ("sig", "size")):
                own, sig = np.array([r[4] for r in rows]), np.array([r[8] for r in rows], dtype="<i8")
                size, some = np.array([r[9] for r in rows]), np.zeros(len(rows), dtype=bool)
                for a, b in compare.candidates(sig, size, *_sides(at, own), at[0]):
                    some[a] = some[b] = True
                if some.any():
                    cols = list(zip(*[rows[k][:8] for k in np.flatnonzero(some).tolist()], strict=True))
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=list(_PLACE))

        return materialise(map_arrow(dealt, run, "band int, key long, i int, j int, own int, rep long, tie long, copies long"), "likely")

    def _compare(self, emit, schema: str) -> DataFrame:
        """emit(rep, tie, copies, size, batches of verified pairs) gives the record batches of a bucket or pair of blocks."""
        threshold, tolerance = self.threshold, self.tolerance

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            compare = Compare(threshold, tolerance)
            for at, rows in _groups(batches, ("sig", "grams")):
                own, sig = np.array([r[4] for r in rows]), np.array([r[8] for r in rows], dtype="<i8")
                grams = [np.frombuffer(r[9], dtype="<u8") for r in rows]
                rep, tie, copies = (np.array([r[k] for r in rows]) for k in (5, 6, 7))
                yield from emit(rep, tie, copies, np.array([len(g) for g in grams]), compare.pairs(sig, grams, *_sides(at, own), at[0]))

        return map_arrow(self._blocks(), run, schema)

    def pairs(self) -> DataFrame:
        """a, b (two nodes by their smallest ids, a <= b) and their similarity, each pair of nodes once."""

        def emit(rep, tie, copies, size, batches):
            for a, b, shared in batches:
                x, y = np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, mask=c == NO_ID) for c in (x, y)), pa.array(shared / (size[a] + size[b] - shared))], names=["a", "b", "similarity"])

        return self._compare(emit, "a long, b long, similarity double")

    def links(self) -> DataFrame:
        """rep, tie, links (documents that the node links to through one bucket) and root (a node of its component)."""

        def emit(rep, tie, copies, size, batches):
            n = len(rep)
            order = np.lexsort((tie, rep))
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.arange(n)
            roots, count = _Roots(n), np.zeros(n)
            for a, b, _ in batches:
                count += np.bincount(a, weights=copies[b], minlength=n) + np.bincount(b, weights=copies[a], minlength=n)
                roots.add(rank[a], rank[b])
            some = np.flatnonzero(count)
            root = order[roots.root[rank[some]]]
            cols = [rep[some], tie[some], count[some].astype(np.int64), rep[root], tie[root]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["rep", "tie", "links", "root_rep", "root_tie"])

        links = materialise(self._compare(emit, "rep long, tie long, links long, root_rep long, root_tie long"), "links")
        discard(self.docs.sparkSession, self.likely)
        return links

    def placed(self) -> DataFrame:
        """The nodes (key, rep, tie, copies) with links, the documents of other nodes that reach the threshold, and root, the first name of the class."""
        links = self.links()
        found = components(links.select(F.struct("rep", "tie").alias("u"), F.struct(F.col("root_rep").alias("rep"), F.col("root_tie").alias("tie")).alias("v")))
        found = found.select("node.rep", "node.tie", "root")
        nodes = self.nodes.select("key", "rep", "tie", "copies").join(links.groupBy("rep", "tie").agg(F.sum("links").alias("links")), ["rep", "tie"], "left").join(found, ["rep", "tie"], "left")
        return nodes.select("key", "rep", "tie", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", F.struct("rep", "tie")).alias("root"))

    def classes(self) -> DataFrame:
        """doc_id, class_id (the smallest id that links lead to), n_links (other documents that reach the threshold, copies among them) and n_shingles."""
        nodes = self.placed().select("key", F.nullif(F.col("root.rep"), F.lit(NO_ID)).alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"))
        rows = self.sketches.select("doc_id", "n_shingles", "key").join(nodes, "key", "left")
        alone = F.col("key").isNull()
        return rows.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), "n_shingles")

    def staying(self) -> DataFrame:
        """rep, tie of the rows that stay, one of each class, and alone: whether the text has no words and each of its rows stays."""
        firsts = self.placed().where("root.rep = rep and root.tie = tie").select("rep", "tie", F.lit(False).alias("alone"))
        return firsts.unionByName(self.sketches.where("key is null").select("rep", "tie", F.lit(True).alias("alone")).distinct())


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each class stays, the one with the smallest id (null ids last), with all its columns; rows without words all stay."""
    rep, tie, alone, place = (unused(docs, x) for x in ("rep", "tie", "alone", "place"))
    stay = Join(docs, **options).staying().toDF(rep, tie, alone)
    rows = named(docs, options.get("id_col", "doc_id"), options.get("text_col", "text"), rep, tie).join(stay, [rep, tie])
    # rows that repeat an id and its text
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(rep, tie).orderBy(rep))).where(F.col(alone) | (F.col(place) == 1))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
