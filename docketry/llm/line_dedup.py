"""Line dedup by range-partitioned hashes.

A pass over the texts gives each document's keys (lines without outer blanks, in lower case) as 128-bit hashes with their
places, one row a key and document. These rows are dealt by ranges of (hash, document) and sorted by hash, document
(from the last) and first place, so that a task reads a hash's documents as a stream: the first one is where the key
stays, the next ones lose it once there are ``min_docs`` documents. What waits for that is one document's places, whatever the
number of documents. A hash so common that its documents fill several ranges is first or last in each of these: such
rows are handed on with the count of their range, and decided by the sum of these counts. What comes back a document
is a bitmap of the lines that stay, packed and compressed; texts are read only by who wants the text itself.

Defined results: a null or empty text is one empty line; keys of fewer than ``min_chars`` characters always stay; a document
is an id, so that rows with one id count once, and all of them keep what the id keeps; a null id is a document before all
others; rows that repeat id and text have one bitmap; an empty table gives no rows; other columns are ignored by ``bitmaps``
and ``digests`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import lookup, map_arrow, materialise, tasks_for, unused

MIN_CHARS, MIN_DOCS = 20, 3
#: Stands for a null id.
NO_ID = -(2**63)
#: The rows of a hash that fills ranges are dealt into this many parts at least, one for each ROWS_A_PART rows.
DEALT, ROWS_A_PART = 64, 1_000_000

_PLACES = "doc long, tie long, n_lines int, places binary"
_SCHEMA = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("n_lines", pa.int32()), ("places", pa.binary())])


def keys_of(data: bytes, min_chars: int = MIN_CHARS) -> tuple[int, dict[bytes, list[int]]]:
    """How many lines a text has, and the places of each key that is long enough."""
    lines, found = data.lower().split(b"\n"), {}  # of bytes: A to Z alone
    for place, line in enumerate(lines):
        key = line.strip()  # of bytes: 0x20 and 0x09 to 0x0D
        n = len(key)
        if n >= min_chars and (n >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            found.setdefault(key, []).append(place)
    return len(lines), found


def named(docs: DataFrame, id_col: str, text_col: str, doc: str = "doc", tie: str = "tie") -> DataFrame:
    """docs with the name of each row: its id, NO_ID for a null one, and its text's hash."""
    return docs.withColumns({doc: F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)), tie: F.xxhash64(F.coalesce(docs[text_col], F.lit("")))})


def hashed(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """h, g (the halves of a key's hash), doc, tie, n_lines and the key's places in that document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, tie, text in zip(*(batch[c].to_pylist() for c in ("doc", "tie", "text")), strict=True):
                n, found = keys_of(text.encode("utf-8", "surrogatepass"), min_chars)
                for key, places in found.items():
                    h, g = np.frombuffer(xxhash.xxh3_128_digest(key), dtype=">i8").tolist()
                    rows.append((h, g, doc, tie, n, np.array(places, dtype="<u4").tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * len(_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)

    rows = named(docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")), "id", "text").select("doc", "tie", "text")
    return map_arrow(rows, run, f"h long, g long, {_PLACES}", text="text")


#: What a task says: drop these places; so many documents has a hash here (n besides the first and the last one); decide on these places.
DROP, COUNT, OPEN = range(3)
_VERDICTS = pa.schema([("kind", pa.int8()), ("h", pa.int64()), ("g", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("n_lines", pa.int32()), ("places", pa.binary()), ("last", pa.int64()), ("n", pa.int64())])
#: Rows that wait for more documents of their hash; beyond, they are handed on.
MOST_WAITING = 1 << 12


class Stream:
    """Verdicts on rows that come by hash, then by document from the last to the first."""

    def __init__(self, min_docs: int = MIN_DOCS):
        self.min_docs, self.out = min_docs, []
        self.key, self.first, self.last, self.n = None, None, None, 0
        #: whether other ranges may hold rows of this hash, which come before its first one
        self.edge, self.counted = True, True
        self.waiting: list[tuple] = []

    def hand_on(self) -> None:
        self.counted = True
        self.out += [(OPEN, *row, None, None) for row in self.waiting]
        self.waiting = []

    def end(self, edge: bool = True) -> None:
        """No more rows of the hash; edge: other ranges may go on with it."""
        if self.key is None:
            return
        if edge or self.counted:
            self.hand_on()
            self.out.append((COUNT, *self.key, self.first, None, None, None, self.last, self.n - 1 - (self.last != self.first)))
        self.waiting = []

    def add(self, row: tuple) -> None:
        """row: h, g, doc, tie, n_lines, places."""
        key, doc = row[:2], row[2]
        if key != self.key:
            if self.key is not None:
                self.end(edge=False)
                self.edge = self.counted = False
            self.key, self.first, self.last, self.n = key, doc, None, 0
        if doc != self.last:
            self.last = doc
            self.n += 1
        if self.n == 1:
            if self.edge:
                self.out.append((OPEN, *row, None, None))
        elif self.n >= self.min_docs:
            self.out += [(DROP, *early, None, None) for early in self.waiting]
            self.waiting = []
            self.out.append((DROP, *row, None, None))
        else:
            self.waiting.append(row)
            if len(self.waiting) > MOST_WAITING:
                self.hand_on()


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, tie, n_lines, places: the lines that go, in a row for each key."""
    lines = materialise(hashed(docs, id_col, text_col, min_chars), "lines")
    order = F.col("h"), F.col("g"), F.desc("doc"), F.col("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(min_docs)

        def said() -> pa.RecordBatch:
            cols = list(zip(*stream.out, strict=True)) or [()] * len(_VERDICTS)
            stream.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _VERDICTS, strict=True)], schema=_VERDICTS)

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in _SCHEMA.names), strict=True):
                stream.add(row)
            yield said()
        stream.end()
        yield said()

    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order, "places")
    verdicts = materialise(map_arrow(dealt, run, f"kind byte, h long, g long, {_PLACES}, last long, n long"), "verdicts")
    counts = verdicts.where(F.col("kind") == COUNT)
    # the first and the last document of a range can be those of its neighbours too
    ends = counts.select("h", "g", F.explode(F.array("doc", "last")).alias("doc")).distinct().groupBy("h", "g").agg(F.count("*").alias("ends"), F.max("doc").alias("owner"))
    totals = counts.groupBy("h", "g").agg(F.sum("n").alias("n")).join(ends, ["h", "g"]).where(F.col("n") + F.col("ends") >= min_docs).select("h", "g", "owner")
    open_ = verdicts.where(F.col("kind") == OPEN)
    found = lookup(open_.select("h", "g", "doc", "tie", "n_lines", "places"), ["h", "g"], totals, ["doc", "tie"], max(DEALT, tasks_for(open_.count(), ROWS_A_PART)))
    sure = verdicts.where(F.col("kind") == DROP)
    return sure.select("doc", "tie", "n_lines", "places").unionByName(found.where("doc < owner").select("doc", "tie", "n_lines", "places"))


def pack(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep).tobytes())


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), dtype=np.uint8), count=n).astype(bool)


def bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, tie (see named), n_lines, n_dropped and keep (see pack) of each document that loses lines."""
    rows = dropped(docs, id_col, text_col, min_chars, min_docs)
    schema = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("n_lines", pa.int32()), ("n_dropped", pa.int64()), ("keep", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keep, out = None, np.zeros(0, dtype=bool), []

        def done() -> None:
            if at is not None:
                out.append((*at, int((~keep).sum()), pack(keep)))

        def taken() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            for *name, places in zip(*(batch[c].to_pylist() for c in ("doc", "tie", "n_lines", "places")), strict=True):
                if name != at:
                    done()
                    at, keep = name, np.ones(name[2], dtype=bool)
                keep[np.frombuffer(places, dtype="<u4")] = False
            yield taken()
        done()
        yield taken()

    dealt = rows.repartition("doc", "tie").sortWithinPartitions("doc", "tie")
    return map_arrow(dealt, run, "doc long, tie long, n_lines int, n_dropped long, keep binary")


def kept_text(text: str, keep: bytes | None) -> tuple[str, int]:
    """What stays of a text, and how many lines it had."""
    lines = text.split("\n")
    return (text if keep is None else "\n".join(line for line, stays in zip(lines, unpack(keep, len(lines)).tolist(), strict=True) if stays)), len(lines)


def _with_bitmaps(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> tuple[DataFrame, str]:
    """The rows of docs with their bitmap, null where all lines stay, in a column of this name."""
    doc, tie, keep = (unused(docs, x) for x in ("doc", "tie", "keep"))
    found = bitmaps(docs, id_col, text_col, min_chars, min_docs).select("doc", "tie", "keep").toDF(doc, tie, keep)
    return named(docs, id_col, text_col, doc, tie).join(found, [doc, tie], "left").select(*(F.col(f"`{c}`") for c in docs.columns), keep), keep


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256, of the lines that stay joined by line ends."""
    rows, keep = _with_bitmaps(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")), "doc_id", "text", min_chars, min_docs)
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, gone, sums = [], [], []
            for text, bits in zip(batch["text"].to_pylist(), batch[keep].to_pylist(), strict=True):
                kept, n = kept_text(text, bits)
                lines.append(n)
                gone.append(0 if bits is None else int((~unpack(bits, n)).sum()))
                sums.append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, type=f.type) for c, f in zip((lines, gone, sums), list(schema)[1:], strict=True))], schema=schema)

    return map_arrow(rows, run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", text="text")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the lines that go taken out of their texts; a null text stays null."""
    rows, keep = _with_bitmaps(docs, id_col, text_col, min_chars, min_docs)

    @F.arrow_udf("string")
    def without(texts: pa.Array, bits: pa.Array) -> pa.Array:
        return pa.array([t if t is None else kept_text(t, b)[0] for t, b in zip(texts.to_pylist(), bits.to_pylist(), strict=True)], type=pa.string())

    return rows.select(*(without(F.col(f"`{c}`"), F.col(keep)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


ORACLE_SQL = r"""
with d as (select row_number() over () as r, coalesce(doc_id, -9223372036854775808) as doc, doc_id, coalesce(text, '') as t from documents),
pieces as (select r, doc, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as place from d),
keys as (select *, regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as k from pieces),
often as (select k, max(doc) as owner from keys where length(k) >= 20 group by k having count(distinct doc) >= 3),
judged as (select r, place, line, coalesce(doc < owner, false) as gone from keys left join often using (k)),
texts as (select r, count(*) as n_lines, sum(case when gone then 1 else 0 end) as n_dropped, string_agg(line, chr(10) order by place) filter (where not gone) as kept from judged group by r)
select doc_id, n_lines, cast(n_dropped as bigint) as n_dropped, sha256(coalesce(kept, '')) as kept_sha256 from d join texts using (r)
"""
