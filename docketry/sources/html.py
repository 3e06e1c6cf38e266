"""Web pages as rows: table cells, listings with their paging, details. A page is one row; parsing runs on Arrow-backed batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import text

#: Endings of files, and query parameters that name a record.
FILE_ENDINGS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip")
RECORD_PARAMETERS = ("id", "newsid", "recordid", "entryid")


def squeeze(value: str) -> str:
    return " ".join(value.split())


class Tables(HTMLParser):
    """Rows of cells of every table, with the heading before the table and the first link of each row."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[dict] = []
        self.count, self.heading, self.inside, self.held = 0, None, None, []

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag == "table":
            self.open.append({"table": self.count, "n": 0, "row": None, "cell": None, "heading": self.heading})
            self.count += 1
        elif tag in ("h1", "h2", "h3", "h4", "caption"):
            self.inside, self.held = tag, []
        elif self.open:
            t = self.open[-1]
            if tag == "tr":
                self.close_row()
                t["row"] = {"cells": [], "header": True, "href": None, "link_title": None}
            elif tag in ("td", "th") and t["row"] is not None:
                self.close_cell()
                t["cell"] = []
                t["row"]["header"] &= tag == "th"
            elif tag == "a" and t["row"] is not None and t["row"]["href"] is None:
                t["row"]["href"], t["row"]["link_title"] = at.get("href"), at.get("title")
            elif tag == "br" and t["cell"] is not None:
                t["cell"].append(" ")

    def handle_data(self, data):
        if self.inside:
            self.held.append(data)
        elif self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"].append(data + " ")

    def handle_endtag(self, tag):
        if tag == self.inside:
            said = squeeze("".join(self.held)) or None
            if tag == "caption" and self.open:
                self.open[-1]["heading"] = said
            else:
                self.heading = said
            self.inside = None
        elif self.open and tag in ("td", "th"):
            self.close_cell()
        elif self.open and tag == "tr":
            self.close_row()
        elif self.open and tag == "table":
            self.close_row()
            self.open.pop()

    def close_cell(self):
        t = self.open[-1] if self.open else None
        if t and t["row"] is not None and t["cell"] is not None:
            t["row"]["cells"].append(squeeze("".join(t["cell"])))
            t["cell"] = None

    def close_row(self):
        t = self.open[-1] if self.open else None
        if t and t["row"] is not None:
            self.close_cell()
            row, t["row"] = t["row"], None
            if row["cells"]:
                self.rows.append({"table_no": t["table"], "row_no": t["n"], "heading": t["heading"], "is_header": row["header"], "cells": row["cells"], "href": row["href"], "link_title": row["link_title"]})
                t["n"] += 1

    def close(self):
        super().close()
        while self.open:
            self.close_row()
            self.open.pop()


def _rows_of(html: str | None) -> list[dict]:
    parser = Tables()
    parser.feed(html or "")
    parser.close()
    return parser.rows


def tables(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """page, table_no, row_no, heading, is_header, cells and the first link of each table row; open rows end with their table."""
    kind = dict(pages.dtypes)[page]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [page, "table_no", "row_no", "heading", "is_header", "cells", "href", "link_title"]
        for frame in frames:
            yield pd.DataFrame([{page: p, **r} for p, h in zip(frame[page], frame[html], strict=True) for r in _rows_of(h)], columns=cols)

    schema = f"{page} {kind}, table_no int, row_no int, heading string, is_header boolean, cells array<string>, href string, link_title string"
    return pages.select(page, html).mapInPandas(run, schema)


def records(table_rows: DataFrame, page: str, names: dict[str, list[str]]) -> DataFrame:
    """Data rows as columns: names gives for each column the header texts that mean it; the first row of a table names its columns."""
    head = table_rows.where("row_no = 0").select(page, "table_no", F.transform("cells", lambda c: text.lookup_key(c)).alias("__head"))
    rows = table_rows.where("row_no > 0 and not is_header").join(head, [page, "table_no"])
    cols = []
    for name, said in names.items():
        place = F.coalesce(*[F.nullif(F.array_position("__head", s), F.lit(0)) for s in said])
        cols.append(F.nullif(F.trim(F.get("cells", (place - 1).cast("int"))), F.lit("")).alias(name))
    return rows.select(page, "table_no", "row_no", "heading", *cols)


def people(table_rows: DataFrame, page: str) -> DataFrame:
    """Staff rows with names, emails and phones in one form; rows without a name go, equal rows are one."""
    names = {"name": ["name", "staff name", "name of officer"], "designation": ["designation"], "department": ["department", "dept"], "email": ["email", "email id", "e mail"], "phone": ["phone", "telephone", "tel no"], "staff_no": ["staff no", "staff number"]}
    rows = records(table_rows, page, names).withColumnRenamed("heading", "office")
    rows = rows.withColumns({"name": text.person_name(F.col("name")), "email": text.email(F.col("email")), "phone": text.phone(F.col("phone"))}).where("name is not null and name <> ''")
    cols = ["office", *names]
    return rows.withColumn("row_sha256", F.sha2(F.to_json(F.struct(*sorted(cols))), 256)).dropDuplicates([page, "row_sha256"])


def path_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")


def link_kind(url: Column) -> Column:
    """direct_file by the ending of the path, else detail; unknown without a url."""
    low = F.lower(path_of(url))
    ends = F.lit(False)
    for e in FILE_ENDINGS:
        ends = ends | low.endswith(e)
    return F.when(url.isNull(), "unknown").when(ends, "direct_file").otherwise("detail")


def external_id(url: Column) -> Column:
    """The digits at the end of a page's name, else the first record parameter that has a value."""
    found = [F.nullif(F.regexp_extract(path_of(url), r"(?i)_(\d+)\.html?$", 1), F.lit(""))]
    found += [F.nullif(F.regexp_extract(url, rf"[?&]{p}=([^&#]+)", 1), F.lit("")) for p in RECORD_PARAMETERS]
    return F.coalesce(*found)


def listing(pages: DataFrame, page: str = "page_id", html: str = "html", base: str = "url", separator: str = "#@#") -> DataFrame:
    """Title, day, link, its kind and external id of each listed row; what follows the separator in a response isn't read."""
    head = pages.withColumn(html, F.substring_index(F.coalesce(html, F.lit("")), separator, 1))
    rows = tables(head, page, html).where("not is_header and href is not null").join(pages.select(page, F.col(base).alias("__base")), page)
    site = F.regexp_extract("__base", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_extract("__base", r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    href = F.trim("href")
    link = F.when(href.rlike(r"^(?i)https?://"), href).when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string")).when(href.startswith("//"), F.concat(F.regexp_extract("__base", r"^([A-Za-z]+:)", 1), href))
    link = link.when(href.startswith("/"), F.concat(site, href)).otherwise(F.concat(F.when(folder == "", F.concat(site, F.lit("/"))).otherwise(folder), href))
    rows = rows.withColumn("link", link)
    days = F.filter(F.transform("cells", lambda c: text.any_date(c, ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "dd-MM-yyyy", "dd/MM/yyyy"))), lambda x: x.isNotNull())
    longest = F.array_max(F.transform("cells", lambda c: F.struct(F.length(c).alias("n"), c.alias("c"))))["c"]
    title = text.whitespace_or_null(F.coalesce("link_title", longest))
    return rows.select(page, "table_no", "row_no", title.alias("title"), F.get(days, F.lit(0)).alias("day"), "link", link_kind(F.col("link")).alias("link_kind"), external_id(F.col("link")).alias("external_id")).where("title is not null")


def paging(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """next_value (a hidden input, 1 without it), total_pages (another, null without it) and has_next."""
    hidden = lambda name: F.nullif(F.regexp_extract(html, rf"""(?i)<input[^>]+name=['"]{name}['"][^>]+value=['"]?([^'">\s]+)""", 1), F.lit(""))
    return pages.select(page, F.coalesce(hidden("nextValue"), F.lit("1")).alias("next_value"), hidden("totalpage").try_cast("int").alias("total_pages"), F.coalesce(F.col(html).rlike("""(?i)title=['"]Next['"]"""), F.lit(False)).alias("has_next"))


def details(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """title (first heading, else the title tag), the first date in the text and the first linked file of each page."""
    bare = lambda p: text.whitespace_or_null(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), p, 1), "<[^>]*>", " "))
    title = F.coalesce(bare(r"(?is)<h1\b[^>]*>(.*?)</h1>"), bare(r"(?is)<title\b[^>]*>(.*?)</title>"))
    hrefs = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)(?:href|src)=['"]([^'"]+)['"]"""), F.lit(1))
    files = F.filter(hrefs, lambda h: h.rlike(r"(?i)\.(pdf|docx?|xlsx?|zip)($|[?#])"))
    day = F.regexp_extract(F.coalesce(html, F.lit("")), r"\b([A-Z][a-z]{2,8} \d{1,2}, \d{4})\b", 1)
    return pages.select(page, title.alias("title"), text.any_date(day, ("MMM d, yyyy", "MMMM d, yyyy")).alias("day"), F.get(files, F.lit(0)).alias("file"))


#: Elements that hold headings of their own, and elements without an end tag.
CONTAINERS, VOID = ("article", "body", "div", "li", "section", "td"), ("area", "base", "br", "col", "hr", "img", "input", "link", "meta", "source", "wbr")


class Cards(HTMLParser):
    """Containers with headings of at least two levels right inside of them, each with the heading that it stands under.

    A stack holds the open containers. The end of a container ends all that are open in it; an end tag without a start is passed over; what is
    open at the end of the page ends there."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, dict[str, str]]] = [("page", {})]
        self.heading: tuple[str, list[str]] | None = None
        self.cards: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if re.fullmatch("h[1-6]", tag):
            self._end_heading()
            self.heading = tag, []
        elif tag in CONTAINERS:
            self._end_heading()
            self.open.append((tag, {}))
        elif self.heading and tag in VOID:
            self.heading[1].append(" ")

    def handle_data(self, data):
        if self.heading:
            self.heading[1].append(data)

    def handle_endtag(self, tag):
        if self.heading and tag == self.heading[0]:
            self._end_heading()
        elif tag in CONTAINERS and any(t == tag for t, _ in self.open):
            self._end_heading()
            while self._end_container() != tag:
                pass

    def _end_heading(self) -> None:
        if self.heading:
            level, parts = self.heading
            said = " ".join("".join(parts).split())
            if said:
                self.open[-1][1].setdefault(level, said)
            self.heading = None

    def _end_container(self) -> str:
        tag, own = self.open.pop()
        if len(own) > 1:
            above = next((held[max(held)] for _, held in reversed(self.open) if held), None)
            self.cards.append({"card_no": len(self.cards), "under": above, "headings": own})
        return tag

    def close(self):
        super().close()
        self._end_heading()
        while self.open:
            self._end_container()


def cards(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """page, card_no, under (the heading above, or null) and headings (level to text) of each card."""
    kind = dict(pages.dtypes)[page]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, h in zip(frame[page], frame[html], strict=True):
                parser = Cards()
                parser.feed(h or "")
                parser.close()
                rows += [{page: p, **c} for c in parser.cards]
            yield pd.DataFrame(rows, columns=[page, "card_no", "under", "headings"])

    return pages.select(page, html).mapInPandas(run, f"{page} {kind}, card_no int, under string, headings map<string,string>")


def leader(heading: Column) -> tuple[Column, Column]:
    """Name and role of a heading that is a name, a comma and a role; without a comma a name alone."""
    parts = F.split(F.coalesce(heading, F.lit("")), ",", 2)
    return text.person_name(text.whitespace_or_null(parts[0])), text.whitespace_or_null(F.get(parts, F.lit(1)))


def org_rows(table_rows: DataFrame, page: str) -> DataFrame:
    """The organisation chart as people.source_rows() takes it: the rows of tables() under the heading of their leader, with department, director (a name,
    with a role after a comma) and contact (phone and email). Equal rows of a page are one."""
    cell = lambda k: text.whitespace_or_null(F.get("cells", F.lit(k)))
    name, role = leader(F.col("heading"))
    director, designation = leader(cell(1))
    rows = table_rows.where("not is_header").select(page, name.alias("leader_name"), role.alias("leader_role"), cell(0).alias("department"), director.alias("director_name"), designation.alias("director_role"), cell(2).alias("__contact"))
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("__contact", F.lit("")), r"\s*[\[(]\s*at\s*[\])]\s*", "@"), r"\s*[\[(]\s*dot\s*[\])]\s*", ".")
    mail, phone = F.regexp_extract(plain, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)", 1), F.regexp_extract(F.regexp_replace(plain, r"\S*@\S*", " "), r"(\+?\d[\d -]{5,}\d)", 1)
    rows = rows.withColumns({"director_email": F.nullif(F.lower(mail), F.lit("")), "director_phone": text.phone(phone)}).drop("__contact").where("department is not null")
    return rows.withColumn("row_key", F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)).dropDuplicates([page, "row_key"])


def chart_people(card_rows: DataFrame, page: str) -> DataFrame:
    """People of an organisation chart: cards with a name (h3) and a role (h4), and an email (h5) if there is one; equal ones of a page are one."""
    at = lambda k: text.whitespace_or_null(F.try_element_at("headings", F.lit(k)))
    rows = card_rows.select(page, text.person_name(at("h3")).alias("name"), at("h4").alias("designation"), text.email(at("h5")).alias("email"), "under").where("name is not null and designation is not null")
    return rows.dropDuplicates([page, "name", "designation", "email"])
