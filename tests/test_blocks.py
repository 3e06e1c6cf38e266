"""Blocks and typed chunks of pages, held against what must be true of every document and against cases by hand."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.operators import blocks, segmentation
from docketry.plans import answers

PAGES = [
    (1, "SECURITIES BOARD\n\nIN RESPECT OF ALPHA LIMITED\n\nSome text before."),
    (2, "BACKGROUND\n\nA first paragraph.\n\nName  PAN  Shares\nA  B  12\nC  D  14\n\nx | y\n\nAfter the table."),
    (3, "goes on here.\n\n1. Findings of Fact\n\nFound so.\n\n(A) Details of it\n\nIssue II - Whether it was\n\nYes.\n\nDirections\n\nPay Rs. 5."),
]


def test_blocks_by_hand():
    got = [(b.page, b.kind, b.section, b.level, len(b.path)) for b in blocks._blocks(PAGES)]
    assert got == [
        (1, "heading", "other", 1, 1), (1, "heading", "other", 1, 1), (1, "paragraph", "other", None, 1), (2, "heading", "background", 1, 1), (2, "paragraph", "background", None, 1), (2, "table", "table_block", None, 1), (2, "paragraph", "background", None, 1),
        (3, "paragraph", "background", None, 1), (3, "heading", "findings", 2, 2), (3, "paragraph", "findings", None, 2), (3, "heading", "other", 2, 2), (3, "heading", "issues", 2, 2), (3, "paragraph", "issues", None, 2), (3, "heading", "directions", 1, 1), (3, "paragraph", "directions", None, 1),
    ]
    found = list(blocks._blocks(PAGES))
    assert found[5].body.count("\n") == 3 and found[8].path == ("BACKGROUND", "1. Findings of Fact") and [b.block for b in found] == list(range(15))


@pytest.mark.parametrize(("line", "want"), [("Findings of the Board", ("Findings of the Board", 1)), ("findings of the board", None), ("The order was passed on this and that day by them and by others who were there.", None), ("Issue IV:", ("Issue IV", 2)), ("a\nb", None), ("", None), ("x" * 500, None), ("2.1 Alpha", ("2.1 Alpha", 2))])
def test_headings(line, want):
    assert blocks.heading(line) == want


def block(k, kind, section, tokens, page=1, level=None):
    return blocks.Block(k, page, kind, section, None, (), level, "w " * tokens, tokens)


def test_operative_sections_stay_whole_and_tables_alone():
    rows = [block(0, "heading", "directions", 2, level=1), block(1, "paragraph", "directions", 40, 2), block(2, "paragraph", "directions", 40, 3), block(3, "heading", "facts", 2, level=1), block(4, "paragraph", "facts", 40, 3), block(5, "table", "table_block", 30, 3), block(6, "paragraph", "facts", 40, 3), block(7, "paragraph", "facts", 40, 3)]
    got = [[b.block for b in c.blocks] for c in blocks.pack(rows, 50, 100, 0)]
    assert got == [[0, 1, 2], [3, 4], [5], [6, 7]]
    # beyond the limit it is packed like others
    assert [[b.block for b in c.blocks] for c in blocks.pack(rows[:3], 45, 60, 0)] == [[0, 1], [2]]
    over = [[b.block for b in c.blocks] for c in blocks.pack(rows[3:5] + rows[6:], 85, 100, 20)]
    assert over == [[3, 4, 6], [6, 7]]


def test_captions_are_joined_across_two_pages():
    rows = [block(0, "paragraph", "header", 10, 1), block(1, "table", "table_block", 5, 1), block(2, "paragraph", "header", 10, 2), block(3, "heading", "facts", 2, 2, 1), block(4, "paragraph", "facts", 9, 2), block(5, "table", "table_block", 9, 2)]
    assert [[b.block for b in c.blocks] for c in blocks.pack(rows, 50, 100, 0)] == [[0, 1, 2], [3, 4], [5]]
    rows[2] = block(2, "paragraph", "header", 10, 3)
    assert [[b.block for b in c.blocks] for c in blocks.pack(rows, 50, 100, 0)][0] == [0, 1]


SECTION_NAMES = st.sampled_from(["header", "other", "facts", "directions", "findings"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["heading", "paragraph", "paragraph", "table"]), SECTION_NAMES, st.integers(1, 60), st.integers(0, 1), st.integers(1, 3)), max_size=25), st.integers(0, 20))
def test_every_block_is_placed_once_within_the_limits(rows, overlap):
    page, made = 1, []
    for k, (kind, section, tokens, step, level) in enumerate(rows):
        page += step
        made.append(block(k, kind, "table_block" if kind == "table" else section, tokens, page, level if kind == "heading" else None))
    chunks = list(blocks.pack(made, 40, 50, overlap))
    own = [b for c in chunks for b in c.blocks[c.repeated :]]
    assert [b.block for b in own] == sorted(b.block for b in own) and {b.block for b in own} == set(range(len(rows)))
    assert " ".join(b.body for b in own).split() == " ".join(b.body for b in made).split()
    for c in chunks[1:]:
        assert c.tokens <= 50
        # a table is alone but in a section that is kept whole
        assert len(c.blocks) == 1 or c.blocks[0].section in blocks.WHOLE or all(b.kind != "table" for b in c.blocks)


def test_pages_are_read_in_their_order(spark):
    rows = [("a", n, t) for n, t in PAGES] + [("b", 1, None), (None, 2, "DIRECTIONS\n\nPay."), (None, None, "first of those without a name"), ("c", 5, "word " * 50_000), ("c", 5, "word " * 50_000)]
    pages = spark.createDataFrame([(*r, 7) for r in rows[::-1]], "doc string, page int, body string, block int").repartition(3)
    got = blocks.document_blocks(pages).collect()
    own = [(r.page, r.kind, r.section) for r in sorted((r for r in got if r.doc == "a"), key=lambda r: r.block)]
    assert own == [(b.page, b.kind, b.section) for b in blocks._blocks(PAGES)] and sum(r.tokens for r in got if r.doc == "c") == 100_000
    assert [r.section for r in sorted((r for r in got if r.doc is None), key=lambda r: r.block)] == ["header", "directions", "directions"] and not any(r.doc == "b" for r in got)
    chunks = blocks.typed_chunks(pages).collect()
    assert {r.doc for r in chunks} == {"a", "c", None} and max(r.tokens for r in chunks) <= blocks.MOST
    assert blocks.typed_chunks(pages.limit(0)).collect() == [] == blocks.document_blocks(pages.limit(0)).collect()


def test_all_pages_of_the_table(spark):
    pages = answers.document_pages(spark, "/root/testdata/sf0.001")
    want = {}
    for r in sorted(pages.collect(), key=lambda r: (r.doc, r.page)):
        want.setdefault(r.doc, []).append((r.page, r.body))
    got = {}
    for r in answers.typed_chunks(spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r.doc, {})[r.chunk] = (r.page_start, r.page_end, r.tokens, r.first_block, r.last_block)
    plain = {d: {k: (c.blocks[0].page, c.blocks[-1].page, c.tokens, c.blocks[c.repeated].block, c.blocks[-1].block) for k, c in enumerate(blocks.pack(blocks._blocks(p)))} for d, p in want.items()}
    assert got == {d: c for d, c in plain.items() if c}


def test_lines_that_go_on_take_time_in_proportion():
    began = time.time()
    out = segmentation.normalized("begin\n" + "and on\n" * 1_000_000)
    assert len(out) == 5 + 7 * 1_000_000 and time.time() - began < 30
    assert segmentation.normalized("Some long word hyphen-\nated and\nmore\n\nPage 3 of 4\nNEXT") == "Some long word hyphenated and more\n\nNEXT"
