"""Exact duplicates by Patricia-trie owners.

Texts are dealt by length class and bits of a content hash; a compressed radix trie holds the full byte
strings of each deal, and its terminal nodes store the owner (the largest or smallest id)
and the count. Each input partition first builds tries of its own, so a text travels once a
partition however many copies it has; where they hold over TRIE_BYTES, the largest subtree is handed on and cut off. After the
shuffle each deal comes in the order of its texts: a subtree is whole as soon as a text beyond it comes, is handed on with its
owners and cut off, and what is left in memory is one path.

Defined results: a null text equals an empty one; among equal texts the row with the largest
(or smallest) id stays, and null ids stay only where no copy has one (ids are above -2^63); rows that repeat both id
and text count each in group_size, and share the id that stays, but ``drop_copies`` keeps one of them; an empty table gives no rows;
other columns are ignored by ``owners`` and ``resolve`` and kept by ``drop_copies``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import lookup, map_arrow, text_or_empty, unused

#: Bytes of text that a partition's tries hold before a subtree is handed on.
TRIE_BYTES = 48 << 20
#: Bits of the content hash that deal the texts of a length class.
BITS = 12
#: The rows of a text are dealt into this many parts to be given their owner.
PARTS = 256
_PARTIAL = "size_class int, bits int, text binary, owner long, n long"
_NO_ID = -(2**63)


class PatriciaTrie:
    """Byte strings to [owner, count]; a node is [label, children by first byte, terminal or None]."""

    def __init__(self, largest: bool = True):
        self.root: list = [b"", {}, None]
        self.largest = largest

    def better(self, a: int | None, b: int | None) -> int | None:
        if a is None or b is None:
            return b if a is None else a
        return max(a, b) if self.largest else min(a, b)

    def insert(self, key: bytes, owner: int | None, n: int = 1) -> bool:
        """True if the key is new."""
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, [owner, n]]
                return True
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = shared(label, key, at)
            child[0] = label[same:]
            fork = [label[:same], {label[same]: child}, None]
            node[1][label[0]] = fork
            node, at = fork, at + same
        if node[2] is None:
            node[2] = [owner, n]
            return True
        node[2] = [self.better(node[2][0], owner), node[2][1] + n]
        return False

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        yield from below(self.root, b"")

    def hand_on(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Cuts off the largest subtree under the first fork and gives what it holds."""
        node, prefix = self.root, b""
        while node[2] is None and len(node[1]) == 1:
            (node,) = node[1].values()
            prefix += node[0]
        if not node[1]:
            yield from self.items()
            self.root = [b"", {}, None]
            return
        first = max(node[1], key=lambda k: held(node[1][k]))
        yield from below(node[1].pop(first), prefix)
        # a node without an end or a fork is no node of its own
        if node[2] is None and len(node[1]) == 1 and node is not self.root:
            (child,) = node[1].values()
            node[:] = [node[0] + child[0], child[1], child[2]]

    def pass_by(self, key: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        """Cuts off every subtree that comes before key in byte order, and gives what it holds; the path to key stays."""
        node, at, prefix = self.root, 0, b""
        while at < len(key):
            if node[2] is not None:
                yield prefix, *node[2]
                node[2] = None
            for first in [k for k in node[1] if k < key[at]]:
                yield from below(node[1].pop(first), prefix)
            child = node[1].get(key[at])
            if child is None:
                return
            if not key.startswith(child[0], at):
                same = shared(child[0], key, at)
                if at + same < len(key) and child[0][same] < key[at + same]:
                    yield from below(node[1].pop(key[at]), prefix)
                return
            node, at, prefix = child, at + len(child[0]), prefix + child[0]

    def forks(self) -> int:
        """Nodes with at least two ways on."""
        stack, out = [self.root], 0
        while stack:
            node = stack.pop()
            out += len(node[1]) > 1
            stack += node[1].values()
        return out


def below(node: list, prefix: bytes) -> Iterator[tuple[bytes, int | None, int]]:
    """The keys under a node whose parent ends at prefix, in byte order."""
    stack = [(node, prefix)]
    while stack:
        node, prefix = stack.pop()
        prefix += node[0]
        if node[2] is not None:
            yield prefix, *node[2]
        stack += [(node[1][k], prefix) for k in sorted(node[1], reverse=True)]


def held(node: list) -> int:
    """Bytes of the labels under a node."""
    stack, out = [node], 0
    while stack:
        node = stack.pop()
        out += len(node[0]) + 200
        stack += node[1].values()
    return out


def shared(label: bytes, key: bytes, at: int) -> int:
    """How many bytes of label the key has from at, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key.startswith(label[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, trie_bytes: int = TRIE_BYTES, bits: int = BITS) -> DataFrame:
    """text_sha256, keep_id and group_size for each distinct text."""
    partial = pa.schema([("size_class", pa.int32()), ("bits", pa.int32()), ("text", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])
    final = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def handed(deal: tuple, items: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for text, owner, n in items:
            rows.append((*deal, text, owner, n))
            size += len(text)
            if size > 4 << 20:
                yield _batch(rows, partial)
                rows, size = [], 0
        if rows:
            yield _batch(rows, partial)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[tuple, PatriciaTrie] = {}
        sizes: dict[tuple, int] = {}
        total = 0
        for batch in batches:
            for kind, low, doc, text in zip(*(batch[c].to_pylist() for c in ("size_class", "bits", "id", "text")), strict=True):
                deal = kind, low
                if deal not in tries:
                    tries[deal], sizes[deal] = PatriciaTrie(largest), 0
                if tries[deal].insert(text, doc):
                    sizes[deal] += len(text) + 200
                    total += len(text) + 200
            while total > trie_bytes:
                deal = max(sizes, key=sizes.__getitem__)
                yield from handed(deal, tries[deal].hand_on())
                left = held(tries[deal].root)
                total -= sizes[deal] - left
                sizes[deal] = left
                if not tries[deal].root[1]:
                    total -= left
                    del tries[deal], sizes[deal]
        rows: list[tuple] = []
        size = 0
        for deal, trie in tries.items():
            for item in trie.items():
                rows.append((*deal, *item))
                size += len(item[0])
                if size > 4 << 20:
                    yield _batch(rows, partial)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, partial)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, trie = None, PatriciaTrie(largest)
        done = lambda items: [(hashlib.sha256(t).hexdigest(), owner, n) for t, owner, n in items]
        for batch in batches:
            rows: list[tuple] = []
            for kind, low, text, owner, n in zip(*(batch[c].to_pylist() for c in partial.names), strict=True):
                if (kind, low) != deal:
                    rows += done(trie.items())
                    deal, trie = (kind, low), PatriciaTrie(largest)
                else:
                    rows += done(trie.pass_by(text))
                trie.insert(text, owner, n)
            yield _batch(rows, final)
        yield _batch(done(trie.items()), final)

    text = F.encode(text_or_empty(text_col), "UTF-8")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    size_class = F.floor(F.log2(F.octet_length("text") + 1)).cast("int")
    rows = rows.select("id", "text", size_class.alias("size_class"), F.pmod(F.xxhash64("text"), F.lit(1 << bits)).cast("int").alias("bits"))
    dealt = map_arrow(rows, local, _PARTIAL).repartition("size_class", "bits").sortWithinPartitions("size_class", "bits", "text")
    return map_arrow(dealt, merge, "text_sha256 string, keep_id long, group_size long")


def resolve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text_or_empty(text_col), 256).alias("text_sha256"))
    # a text without an owner here is held by one row; the rows of a common text are dealt into parts
    shared = owners(docs, id_col, text_col, largest).where("group_size > 1")
    found = lookup(rows, ["text_sha256"], shared, ["doc_id"], PARTS, "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """One row of each text stays, with all its columns."""
    sha, own, place = (unused(docs, x) for x in ("sha", "own", "place"))
    keep = owners(docs, id_col, text_col, largest).select(F.col("text_sha256").alias(sha), F.coalesce("keep_id", F.lit(_NO_ID)).alias(own))
    rows = docs.withColumns({sha: F.sha2(F.coalesce(docs[text_col], F.lit("")), 256), own: F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID))}).join(keep, [sha, own], "left_semi")
    # rows that repeat an id and its text
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(sha, own).orderBy(sha))).where(F.col(place) == 1)
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
