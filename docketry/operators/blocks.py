"""Documents of pages to typed blocks, and blocks to chunks under the constraints of their types.

The pages of a document come to one task in their order and are read as a stream: what is carried from page to page is the path of
headings, what the chunks wait for is at most a chunk. So a document may have any number of pages."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docketry.operators.segmentation import MOST, OVERLAP, SECTIONS, TARGET, count_tokens, heading_level, split_units

# Words of tables, two of which make a block one; types that stay whole; types that hold no substance.
TABLE_WORDS = ("isin", "pan", "settlement application number", "name of the applicant", "date of allotment", "outstanding amount", "sr.no", "sr no", "no. of")
WHOLE, BARE = ("directions", "operative_order"), ("header", "other", "table_block", "annexure")
#: A caption has fewer tokens and ends by this page.
CAPTION_TOKENS, CAPTION_PAGE = 120, 2
#: Words that a heading with a section's name has at most, and the share of them that begins with a capital at least.
HEADING_WORDS, HEADING_SHARE = 18, 0.5
_ISSUE, _LABEL = re.compile(r"(?i)^issue\s+[ivxlcm\d]+\b"), re.compile(r"(?i)^(?:\d+(?:\.\d+)*[.)]?|\([a-z\d]+\)|issue\s+[ivxlcm\d]+)\s")
_KINDS = [(name, re.compile(pattern)) for name, pattern in SECTIONS]
BLOCKS = "doc string, block int, page int, kind string, section string, title string, path array<string>, level int, body string, tokens int"
CHUNKS = "doc string, chunk int, page_start int, page_end int, section string, title string, path array<string>, first_block int, last_block int, repeated int, body string, tokens int"


@dataclass
class Block:
    block: int
    page: int
    kind: str
    section: str
    title: str | None
    path: tuple[str, ...]
    level: int | None
    body: str
    tokens: int


def section_of(heading: str) -> str:
    low = heading.lower()
    return next((name for name, pattern in _KINDS if pattern.search(low)), "other")


def heading(body: str) -> tuple[str, int] | None:
    """Title and level, if a paragraph is a heading: numbered, lettered, in capitals, an issue, or a short line in title case that names a section."""
    line = body.strip().strip(":").strip()
    if "\n" in line or not line:
        return None
    if _ISSUE.match(line) and len(line) <= 160:
        return line, 2
    if (level := heading_level(line)) is not None:
        return line, level
    words = [w for w in (w.strip("(),.;:-") for w in line.split()) if w and not w.isdigit()]
    named = 0 < len(words) <= HEADING_WORDS and line[-1] != "." and section_of(line) != "other"
    return (line, 1) if named and sum(w[0].isupper() or len(w) <= 3 for w in words) >= HEADING_SHARE * len(words) and words[0][0].isupper() else None


def is_table(body: str) -> bool:
    low = body.lower()
    return "|" in body or sum(w in low for w in TABLE_WORDS) >= 2 or sum(len(re.split(r"\s{2,}", line.strip())) >= 3 for line in body.split("\n")) >= 2


class Structure:
    """The blocks of one document, page by page."""

    def __init__(self) -> None:
        self.path: tuple[str, ...] = ()
        self.title: str | None = None
        self.section, self.next = "header", 0

    def _block(self, page: int, kind: str, body: str, level: int | None = None) -> Block:
        self.next += 1
        return Block(self.next - 1, page, kind, "table_block" if kind == "table" else self.section, self.title, self.path, level, body, count_tokens(body))

    def page(self, number: int, body: str) -> Iterator[Block]:
        """Paragraphs stand between empty lines; tables that follow each other are one block; a heading's path goes on with the next page."""
        table: list[str] = []
        for part in (p.strip() for p in re.split(r"\n[ \t]*\n", body)):
            if not part:
                continue
            found = heading(part)
            if found is None and is_table(part):
                table.append(part)
                continue
            if table:
                yield self._block(number, "table", "\n".join(table))
                table = []
            if found is None:
                yield self._block(number, "paragraph", part)
                continue
            title, level = found
            # a numbered heading under one without a number is its part
            if level == 1 and self.path and _LABEL.match(title) and not _LABEL.match(self.path[-1]):
                level = 2
            self.path, self.title, self.section = (*self.path[: level - 1], title), title, section_of(title)
            yield self._block(number, "heading", title, level)
        if table:
            yield self._block(number, "table", "\n".join(table))


@dataclass
class Chunk:
    blocks: list[Block]
    #: how many of the first blocks were in the chunk before
    repeated: int = 0

    @property
    def tokens(self) -> int:
        return sum(b.tokens for b in self.blocks)


@dataclass
class Packer:
    """Blocks of a document to chunks: sections are kept apart, operative ones whole if they fit, tables alone, and others are packed up to a target."""

    target: int = TARGET
    most: int = MOST
    overlap: int = OVERLAP
    section: list[Block] = field(default_factory=list)
    kinds: set = field(default_factory=set)
    #: whether the section is too large to be kept whole, so that its blocks are packed as they come
    open: bool = False
    current: Chunk = field(default_factory=lambda: Chunk([]))
    first: Block | None = None

    def add(self, block: Block) -> Iterator[Chunk]:
        if self.first is not None and self._begins(block):
            yield from self.end()
        if self.first is None:
            self.first = block
        self.kinds.add(block.kind)
        for piece in self._pieces(block):
            if not self.open:
                self.section.append(piece)
                self.open = sum(b.tokens for b in self.section) > self.most or self.first.section not in WHOLE
                ready, self.section = (self.section, []) if self.open else ([], self.section)
            else:
                ready = [piece]
            for b in ready:
                yield from self._pack(b)

    def end(self) -> Iterator[Chunk]:
        """The section is over."""
        if self.section:
            yield Chunk(self.section)
        if len(self.current.blocks) > self.current.repeated:
            yield self.current
        self.section, self.current, self.open, self.first, self.kinds = [], Chunk([]), False, None, set()

    def _begins(self, block: Block) -> bool:
        """A heading begins a section if it is of the first level, follows the captions or is of another type; headings that follow each other stay together."""
        if block.kind != "heading" or self.kinds == {"heading"}:
            return False
        return self.first.section == "header" or (block.level or 9) <= 1 or block.section not in (self.first.section, "table_block")

    def _pieces(self, block: Block) -> list[Block]:
        if block.tokens <= self.most:
            return [block]
        out: list[list[str]] = [[]]
        size = 0
        for unit in split_units(block.body, self.most):
            n = count_tokens(unit)
            if out[-1] and size + n > self.target:
                out.append([])
                size = 0
            out[-1].append(unit)
            size += n
        return [replace(block, body=(body := " ".join(units)), tokens=count_tokens(body)) for units in out if units]

    def _pack(self, block: Block) -> Iterator[Chunk]:
        held = self.current
        if block.kind == "table":
            if len(held.blocks) > held.repeated:
                yield held
            yield Chunk([block])
            self.current = Chunk([])
        elif not held.blocks or held.tokens + block.tokens <= self.target or len(held.blocks) == 1 and held.tokens + block.tokens <= self.most:
            held.blocks.append(block)
        else:
            if len(held.blocks) > held.repeated:
                yield held
            tail: list[Block] = []
            while self.overlap and held.blocks and sum(b.tokens for b in tail) < self.overlap:
                tail.insert(0, held.blocks[-1])
                held = Chunk(held.blocks[:-1])
            while tail and sum(b.tokens for b in tail) + block.tokens > self.most:
                tail.pop(0)
            self.current = Chunk([*tail, block], len(tail))


def with_captions(chunks: Iterable[Chunk]) -> Iterator[Chunk]:
    """The captions that a document begins with, on its first two pages, are one chunk."""
    lead: Chunk | None = None
    leading = True
    for c in chunks:
        pages = c.blocks[0].page, c.blocks[-1].page
        caption = c.blocks[0].section in BARE and c.tokens < CAPTION_TOKENS and pages[1] <= CAPTION_PAGE
        if leading and caption and (lead is None or pages[0] <= lead.blocks[-1].page + 1):
            lead = Chunk([*lead.blocks, *c.blocks[c.repeated :]]) if lead else c
            continue
        leading = False
        if lead is not None:
            yield lead
            lead = None
        yield c
    if lead is not None:
        yield lead


def _streamed(pages: DataFrame, per_document, schema: str) -> DataFrame:
    """per_document(pages of one document as (number, text)) gives the rows of a document without its name."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    key = F.coalesce(F.col("doc").cast("string"), F.lit(""))
    rows = pages.select(F.col("doc").cast("string").alias("doc"), key.alias("__key"), F.coalesce(F.col("page").cast("int"), F.lit(0)).alias("page"), F.coalesce("body", F.lit("")).alias("body"))
    dealt = rows.repartition("__key").sortWithinPartitions("__key", F.col("doc").isNotNull(), "page", F.xxhash64("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # pages become Python's one by one: a batch has thousands
        stream = ((batch["doc"][i].as_py(), batch["page"][i].as_py(), batch["body"][i].as_py()) for batch in batches for i in range(batch.num_rows))
        ahead = next(stream, None)
        held: list[tuple] = []
        size = 0
        while ahead is not None:
            doc = ahead[0]

            def own(doc=doc) -> Iterator[tuple[int, str]]:
                nonlocal ahead
                while ahead is not None and ahead[0] == doc:
                    page = ahead[1:]
                    ahead = next(stream, None)
                    yield page

            for row in per_document(own()):
                held.append((doc, *row))
                size += len(row[-2])
                if len(held) >= 4096 or size > 4 << 20:
                    yield _batch(held, arrow)
                    held, size = [], 0
        yield _batch(held, arrow)

    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _blocks(pages: Iterable[tuple[int, str]]) -> Iterator[Block]:
    structure = Structure()
    for number, body in pages:
        yield from structure.page(number, body)


def document_blocks(pages: DataFrame) -> DataFrame:
    """The blocks of each document in their order. pages: doc, page, body; null pages are 0, null bodies empty, and repeated pages are read one after the other."""
    return _streamed(pages, lambda own: ((b.block, b.page, b.kind, b.section, b.title, list(b.path), b.level, b.body, b.tokens) for b in _blocks(own)), BLOCKS)


def pack(blocks: Iterable[Block], target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> Iterator[Chunk]:
    packer = Packer(target, most, overlap)

    def packed() -> Iterator[Chunk]:
        for b in blocks:
            yield from packer.add(b)
        yield from packer.end()

    yield from with_captions(packed())


def typed_chunks(pages: DataFrame, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """The chunks of each document in their order; repeated: how many of its first blocks were in the chunk before."""

    def rows(own: Iterable[tuple[int, str]]) -> Iterator[tuple]:
        for k, c in enumerate(pack(_blocks(own), target, most, overlap)):
            own_blocks = c.blocks[c.repeated :]
            yield k, c.blocks[0].page, c.blocks[-1].page, own_blocks[0].section, own_blocks[0].title, list(own_blocks[0].path), own_blocks[0].block, own_blocks[-1].block, c.repeated, "\n\n".join(b.body for b in c.blocks), c.tokens

    return _streamed(pages, rows, CHUNKS)
