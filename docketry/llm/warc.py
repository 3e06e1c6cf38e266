"""WARC archives with a two-level capture index.

Each task writes the records of its pages to archives, a gzip member a record; their names have the task's attempt in them, and
the captures name the archives of the attempt that was committed. The index
has a line for each capture, sorted by reversed-host URL key and page: range parts of it hold
compressed blocks of BLOCK lines and a sparse directory with the first key of each block, and
a list of the parts' first keys stands over them. A lookup searches that list, then the
directory, then one block, each by halving, and then reads one range of an archive.

Of records with equal payloads of at least MIN_SHARED bytes, the one with the smallest page id
is the response and the others revisit it; smaller ones are all responses.

Defined results: a null html is empty, a null url is the empty key; white space and control
characters in a url are percent-encoded in the record; pages with a null id are responses of their
own; rows that repeat a page id are all captured, and those with the payload of the response are
written as responses too; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import fresh_dir, gone_at_exit, lookup, map_arrow, materialise, open_store, publish, tasks_for

MIN_SHARED, BLOCK = 100, 256
#: Archives are closed at this size; a part of the index is for so many bytes of them, in MOST_PARTS parts at most.
ARCHIVE_BYTES, PART_BYTES, MOST_PARTS = 256 << 20, 4 << 20, 20_000
#: The pages of one payload are dealt into so many parts.
PARTS = 1024
DATE = "2000-01-01T00:00:00Z"
_CAPTURES = "url_key string, page_id long, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """Reversed host, then the rest: http://a.example.com/x?y -> com,example,a)/x?y."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return ")" + (url or "")
    rest = parts.path + ("?" + parts.query if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + rest


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the headers of its payload but not the payload."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe='%/:=&?~#+!$,;@()*[]' + chr(39))}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {len(payload)}", f"Page-ID: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"Refers-To-Page: {refers_to}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; raises ValueError where the record isn't whole."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or len(rest) != size + 4:
        raise ValueError("not a whole WARC record")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def classify(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    large = rows.where(F.col("n") >= min_shared)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    refers = F.when(F.col("first") < F.col("page_id"), F.col("first"))
    found = lookup(large, ["digest"], first, ["page_id", "url"], PARTS, "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    # small payloads stay where they are
    return found.unionByName(rows.where(F.col("n") < min_shared).select("page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("refers_to")))


def write_archives(classified: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; returns a row for each capture (url_key, page_id, archive, offset, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex[:12]
        pages = (row for b in batches for row in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True))
        ahead = next(pages, None)
        while ahead is not None:
            name, made = f"{part:06d}-{number:04d}-{attempt}.warc.gz", []

            def fill(out, name=name, made=made):
                nonlocal ahead
                at = 0
                while ahead is not None and at < ARCHIVE_BYTES:
                    packed = _gzip(record(*ahead))
                    out.write(packed)
                    made.append((url_key(ahead[1]), ahead[0], name, at, len(packed)))
                    at += len(packed)
                    ahead = next(pages, None)

            publish(folder, name, fill)
            number += 1
            cols = list(zip(*made, strict=True))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=["url_key", "page_id", "archive", "offset", "length"])

    return materialise(map_arrow(classified, run, _CAPTURES), "captures")


def _order(key: str, page: int | None) -> tuple[str, int]:
    return key, -1 if page is None else page


def write_index(captures: DataFrame, folder: str, block: int = BLOCK, part_bytes: int = PART_BYTES) -> list[tuple[str, int, str]]:
    """Writes the sorted parts; returns (first key, first page, part), in order: the level over the directories."""
    parts = min(MOST_PARTS, tasks_for(captures.agg(F.sum("length")).first()[0], part_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, top = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.idx", []

        def fill(out):
            at, lines = 0, []
            directory = []

            def flush():
                nonlocal at, lines
                if lines:
                    packed = zlib.compress("\n".join(map(json.dumps, lines)).encode(), 6)
                    directory.append([lines[0][0], _order(*lines[0][:2])[1], at, len(packed)])
                    out.write(packed)
                    at, lines = at + len(packed), []

            for b in batches:
                for row in zip(*(b[c].to_pylist() for c in ("url_key", "page_id", "archive", "offset", "length")), strict=True):
                    lines.append(row)
                    if len(lines) == block:
                        flush()
            flush()
            packed = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(packed + len(packed).to_bytes(8, "little"))
            top.extend(directory[:1])

        first = next(batches, None)
        if first is None:
            return
        rest = batches

        def again():
            yield first
            yield from rest

        batches = again()
        publish(folder, name, fill)
        if top:
            yield pa.RecordBatch.from_arrays([pa.array([top[0][0]]), pa.array([top[0][1]], type=pa.int64()), pa.array([name])], names=["k", "p", "part"])

    order = [F.col("url_key"), F.coalesce("page_id", F.lit(-1))]
    dealt = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order, "archive", "offset")
    # a row a part: the driver holds as many as there are partitions
    return sorted((r["k"], r["p"], r["part"]) for r in map_arrow(dealt, run, "k string, p long, part string").collect())


class IndexPart:
    """One sorted part: the directory is read at once, blocks as they are asked for."""

    def __init__(self, folder: str, part: str):
        store, root = open_store(folder)
        self.file = store.open_input_file(f"{root}/{part}")
        size = self.file.size()
        tail = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.directory = json.loads(zlib.decompress(self.file.read_at(tail, size - 8 - tail)))
        self.firsts = [(k, p) for k, p, _, _ in self.directory]
        self.held: tuple[int, list] = (-1, [])

    def block(self, i: int) -> list:
        if self.held[0] != i:
            _, _, at, n = self.directory[i]
            self.held = (i, [json.loads(x) for x in zlib.decompress(self.file.read_at(n, at)).split(b"\n")])
        return self.held[1]

    def lookup(self, key: str, page: int | None) -> list[list]:
        """The lines of a capture, most often one; captures that repeat a page may run over several blocks."""
        want = _order(key, page)
        i = bisect_right(self.firsts, want) - 1
        while i > 0 and self.firsts[i] == want:
            i -= 1
        out = []
        for j in range(max(i, 0), len(self.directory)):
            if j > i and self.firsts[j] > want:
                break
            lines = self.block(j)
            keys = [_order(x[0], x[1]) for x in lines]
            k = bisect_right(keys, want)
            while k and keys[k - 1] == want:
                k -= 1
                out.append(lines[k])
        return out


def read_back(pages: DataFrame, archives: str, index: str, top: list[tuple[str, int, str]]) -> DataFrame:
    """Looks up each distinct (url, page_id) of pages in the index and reads its records from the archives; as many tasks as the index has parts."""
    firsts, parts = [(k, p) for k, p, _ in top], [x for _, _, x in top]

    @F.arrow_udf("struct<key string, part int>")
    def find(url: pa.Array, page: pa.Array) -> pa.Array:
        keys = [url_key(u) for u in url.to_pylist()]
        at = [max(0, bisect_right(firsts, _order(k, p)) - 1) for k, p in zip(keys, page.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(keys, type=pa.string()), pa.array(at, type=pa.int32())], names=["key", "part"])

    asked = pages.select("url", F.col("page_id").cast("long").alias("page_id")).withColumn("at", find("url", "page_id"))
    asked = asked.select("page_id", F.col("at.key").alias("key"), F.col("at.part").alias("part")).groupBy("part", "key", "page_id").agg(F.count("*").alias("n"))
    dealt = asked.repartition(max(1, len(parts)), "part").sortWithinPartitions("part", "key", "page_id")
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(archives)
        part, opened, files = None, -1, {}
        for batch in batches:
            out = []
            for k, key, page in zip(*(batch[c].to_pylist() for c in ("part", "key", "page_id")), strict=True):
                if k != opened:
                    part, opened = IndexPart(index, parts[k]), k
                lines = part.lookup(key, page)
                # captures of one page and key may have been split between parts only at an equal order
                if not lines:
                    raise LookupError(f"no capture of {key} {page}")
                for _, _, archive, at, n in lines:
                    if archive not in files:
                        if len(files) > 64:
                            files.pop(next(iter(files))).close()
                        files[archive] = store.open_input_file(f"{root}/{archive}")
                    fields, payload = parse(zlib.decompress(files[archive].read_at(n, at), 31))
                    digest, size, refers = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["Payload-Length"]), fields.get("Refers-To-Page")
                    if refers is None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"the record of page {page} is damaged")
                    out.append((int(fields["Page-ID"]) if fields["Page-ID"] else None, size, digest, fields["WARC-Type"], None if refers is None else int(refers)))
            cols = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return map_arrow(dealt, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives all pages under folder (a new shared one that goes with the driver), then reads every record back through the index."""
    own = folder is None
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    captures = write_archives(classify(pages), f"{folder}/archives")
    top = write_index(captures, f"{folder}/index")
    if own:
        gone_at_exit(pages.sparkSession, folder)
    return read_back(pages, f"{folder}/archives", f"{folder}/index", top)
