"""Text to blocks, chunks, windows and sections."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import text

TARGET, MOST, OVERLAP = 800, 1000, 120
#: Section types by the first pattern that a heading has.
SECTIONS = (
    ("operative_order", r"\border\b"), ("directions", r"\bdirections?\b"), ("findings", r"\bfindings?\b|\bconsideration\b"), ("issues", r"\bissues?\b"),
    ("reply_or_submissions", r"\brepl(y|ies)\b|\bsubmissions?\b"), ("show_cause_notice", r"\bshow cause\b"), ("background", r"\bbackground\b"), ("facts", r"\bfacts\b"), ("annexure", r"\bannexures?\b"),
)
_NUMBERED, _LETTERED = re.compile(r"^\(?\d+(\.\d+)*[.)]?\s+\S"), re.compile(r"^\(?[A-Z][.)]\s+\S")
LONGEST_HEADING = 160
_FOOTER = re.compile(r"^\s*page\s+\d+(\s+of\s+\d+)?\s*$", re.IGNORECASE)


def count_tokens(value: str) -> int:
    """Words and marks: the pluggable default of the token count."""
    return len(re.findall(r"\w+|[^\w\s]", value))


def heading_level(line: str, caps: float = 0.6) -> int | None:
    """1 for headings in capitals, by depth for numbered ones, 2 for lettered ones; None for other lines."""
    line = line.strip()
    if not line or len(line) > LONGEST_HEADING or line[-1] in ".;,":
        return None
    if _NUMBERED.match(line) and len(line.split()) <= 14:
        return line.split()[0].strip("().").count(".") + 1
    if _LETTERED.match(line) and len(line.split()) <= 14:
        return 2
    letters = [c for c in line if c.isalpha()]
    return 1 if len(letters) >= 3 and sum(c.isupper() for c in letters) / len(letters) >= caps else None


def normalized(value: str) -> str:
    """Without zero-width characters and page footers; hyphenated line ends are joined, and lines that go on in lower case are merged."""
    lines: list[list[str]] = []  # the pieces of each line: what goes on and on is joined once
    size = 0
    for raw in re.sub(r"\r\n?", "\n", re.sub("[​-‍﻿]", "", value or "")).split("\n"):
        line = re.sub(r"[ \t\f\v]+", " ", raw).strip()
        if _FOOTER.match(line):
            continue
        goes_on = bool(lines and line and line[0].islower() and lines[-1][-1])
        if goes_on and lines[-1][-1].endswith("-"):
            lines[-1][-1] = lines[-1][-1][:-1]
            lines[-1].append(line)
        elif goes_on and (size > LONGEST_HEADING or heading_level("".join(lines[-1])) is None):
            lines[-1] += [" ", line]
            size += 1
        else:
            lines.append([line])
            size = 0
        size += len(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join("".join(pieces) for pieces in lines)).strip()


def section_type(c: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(SECTIONS):
        out = F.when(F.lower(c).rlike(pattern), name).otherwise(out)
    return out


def is_table_like(c: Column) -> Column:
    lines = F.split(c, "\n")
    cells = F.filter(lines, lambda x: F.size(F.split(F.trim(x), r"\s{2,}")) >= 3)
    return c.contains("|") | (F.size(cells) >= 2)


def split_units(body: str, most: int) -> list[str]:
    """Sentences, and runs of words where a sentence is over the limit."""
    out = []
    for s in re.split(r"(?<=[.;])\s+|\n+", body):
        words = s.split()
        if count_tokens(s) <= most:
            out += [s] if s.strip() else []
        else:
            step = max(1, most // 2)
            out += [" ".join(words[i : i + step]) for i in range(0, len(words), step)]
    return out


def chunk_text(body: str, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> list[dict]:
    """Blocks under headings, packed greedily up to target; trailing units of at least overlap tokens are carried over within a section."""
    path: list[str] = []
    sections: list[tuple[str | None, list[str]]] = []
    for line in normalized(body).split("\n"):
        level = heading_level(line)
        if level is not None:
            path = [*path[: level - 1], line.strip()]
            sections.append((" > ".join(path), []))
        elif line.strip():
            if not sections:
                sections.append((None, []))
            sections[-1][1].append(line)
    chunks = []
    for title, lines in sections:
        held: list[tuple[str, int]] = []
        fresh = False
        for unit in split_units("\n".join(lines), most):
            n = count_tokens(unit)
            size = sum(k for _, k in held)
            if held and fresh and (size + n > most or size >= target):
                chunks.append((title, held))
                tail: list[tuple[str, int]] = []
                while overlap and held and sum(k for _, k in tail) < overlap:
                    tail.insert(0, held[-1])
                    held = held[:-1]
                held = tail if sum(k for _, k in tail) + n <= most else []
            held = [*held, (unit, n)]
            fresh = True
        if held and fresh:
            chunks.append((title, held))
        elif title and not lines:
            chunks.append((title, [(title, count_tokens(title))]))
    return [{"chunk_index": i, "heading": title, "chunk_text": " ".join(u for u, _ in units), "token_count": sum(n for _, n in units)} for i, (title, units) in enumerate(chunks)]


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """Ordered chunks of each document; a document is one row, so no group has to be gathered."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"doc_id": d, **c} for d, t in zip(frame["doc_id"], frame["t"], strict=True) for c in chunk_text(t, target, most, overlap)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "heading", "chunk_text", "token_count"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(run, "doc_id long, chunk_index int, heading string, chunk_text string, token_count int")


def token_windows(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` words, each beginning size - overlap after the one before; the last may be shorter."""
    words = F.filter(F.split(F.col(text_col), r"\s+"), lambda w: w != "")
    rows = docs.select(id_col, words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - overlap) / (size - overlap)).cast("int") - 1)
    rows = rows.select(id_col, "w", F.explode(F.sequence(F.lit(0), last)).alias("window"))
    part = F.slice("w", F.col("window") * (size - overlap) + 1, F.lit(size))
    return rows.select(id_col, "window", F.size(part).alias("n_words"), F.array_join(part, " ").alias("body"))


def sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, F.posexplode(text.sentences(F.col(text_col))).alias("place", "sentence"))


def sections(chunked: DataFrame, doc: str, order: str, kind: str, body: str) -> DataFrame:
    """Consecutive chunks of one kind as a section: key, extent and the ordered text."""
    from docketry.operators.relational import islands

    rows = islands(chunked, doc, order, kind)
    grouped = rows.groupBy(doc, "island").agg(F.first(kind).alias(kind), F.min(order).alias("first"), F.max(order).alias("last"), F.array_sort(F.collect_list(F.struct(order, body))).alias("parts"))
    key = F.format_string("section-%04d-%s", F.col("island").cast("int"), text.slug(F.coalesce(F.col(kind), F.lit("none")), 48))
    return grouped.select(doc, key.alias("section_key"), kind, "first", "last", F.array_join(F.transform("parts", lambda p: p[body]), "\n").alias("section_text"))


#: Tokens under which a chunk is small, and what a merge may exceed the most by.
SMALL, SMALL_IN_SHORT, TOLERANCE = 80, 120, 40
FOOTER = re.compile(r"(?i)^\W*(page\s+\d+(\s+of\s+\d+)?|\d+|end of document|place\s*:.{0,60}|date\s*:.{0,40})\W*$")


def _joined(a: dict, b: dict, heading: str | None) -> dict:
    body = f"{a['chunk_text']} {b['chunk_text']}"
    return {"heading": heading, "chunk_text": body, "token_count": count_tokens(body)}


def _fits(a: dict, b: dict, most: int) -> bool:
    return a["token_count"] + b["token_count"] <= most + min(a["token_count"], b["token_count"], TOLERANCE)


def tidy(chunked: list[dict], most: int = MOST, short: bool = False) -> list[dict]:
    """Chunks of one document after the cleaning passes, in this order:

    a chunk that is only its heading goes into the next one; trailing footers go into the chunk before them, or away
    where they don't fit; small chunks go into the neighbour under the same heading, else the smaller one, if the sum
    fits; short documents of more than six chunks do that once more with a higher bound."""
    work: list[dict] = []
    held: dict | None = None
    for c in chunked:
        c = {k: c[k] for k in ("heading", "chunk_text", "token_count")}
        if held is not None:
            if _fits(held, c, most):
                c = _joined(held, c, c["heading"])
            else:
                work.append(held)
        last = (c["heading"] or "").split(" > ")[-1]
        held = c if last and squeeze(c["chunk_text"]) == squeeze(last) else None
        if held is None:
            work.append(c)
    if held is not None:
        work.append(held)
    while len(work) > 1 and FOOTER.match(work[-1]["chunk_text"]):
        tail = work.pop()
        if _fits(work[-1], tail, most):
            work[-1] = _joined(work[-1], tail, work[-1]["heading"])
    for bound in (SMALL, SMALL_IN_SHORT) if short and len(work) > 6 else (SMALL,):
        i = 0
        while i < len(work):
            near = [j for j in (i - 1, i + 1) if 0 <= j < len(work) and _fits(work[i], work[j], most)] if work[i]["token_count"] < bound else []
            if near:
                j = min(near, key=lambda j: (work[j]["heading"] != work[i]["heading"], work[j]["token_count"], j))
                a, b = min(i, j), max(i, j)
                work[a : b + 1] = [_joined(work[a], work[b], work[j]["heading"])]
                i = a
            else:
                i += 1
    return [{"chunk_index": i, **c} for i, c in enumerate(work)]


def squeeze(value: str) -> str:
    return " ".join(value.split()).lower()


def tidy_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """Ordered chunks of each document after the cleaning passes; a document of at most 3 pages of 3000 characters is short."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"doc_id": d, **c} for d, t in zip(frame["doc_id"], frame["t"], strict=True) for c in tidy(chunk_text(t, target, most, overlap), most, len(t) <= 9000)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "heading", "chunk_text", "token_count"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(run, "doc_id long, chunk_index int, heading string, chunk_text string, token_count int")


def opening_lines(docs: DataFrame, id_col: str, text_col: str, most: int = 3) -> DataFrame:
    """The first lines of each document that have 20 characters, aren't a heading in capitals of at most ten words and are new.

    A fold over the lines where the document lies: nothing is shuffled."""
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x, i: F.struct(i.alias("line_no"), F.trim(F.regexp_replace(x, r"[ \t]+", " ")).alias("line")))
    shout = lambda x: (F.upper(x) == x) & (F.size(F.split(x, " ")) <= 10)
    fit = F.filter(lines, lambda x: (F.length(x["line"]) >= 20) & ~shout(x["line"]))
    new = lambda held, x: (F.size(held) < most) & ~F.exists(held, lambda h: F.lower(h["line"]) == F.lower(x["line"]))
    first = F.aggregate(fit, F.array().cast("array<struct<line_no:int,line:string>>"), lambda held, x: F.when(new(held, x), F.concat(held, F.array(x))).otherwise(held))
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(first))
