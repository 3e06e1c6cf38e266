"""Texts for the embedding of documents, sections and chunks, and the expansion of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text
from docketry.operators.entities import designation

MAX_HEADINGS = 8
#: Kinds of proceedings by the first phrase in title, bucket and headings.
PROCEEDINGS = (
    ("rti appeal order", ("rti", "appellate authority")), ("settlement order", ("settlement order",)), ("adjudication order", ("adjudication order",)), ("appeal order", ("appeal",)), ("final order", ("final order",)),
    ("interim order", ("interim order", "ex-parte interim order")), ("confirmatory order", ("confirmatory order",)), ("exemption order", ("exemption order",)), ("enquiry order", ("enquiry order",)), ("revocation order", ("revocation order",)),
)


def procedural_type(title: Column, bucket: Column, headings: Column) -> Column:
    """The first kind whose phrase occurs, else the bucket's words, null without a bucket. headings: an array."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    said = F.concat_ws(" ", low(title), low(bucket), low(F.array_join(F.coalesce(headings, F.array().cast("array<string>")), " ")))

    def kind_of(said: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for kind, phrases in PROCEEDINGS:
            for phrase in phrases:
                out = out.when(said.contains(phrase), kind)
        return out

    return F.coalesce(text.bound(said, kind_of), F.nullif(F.replace(low(bucket), F.lit("-"), F.lit(" ")), F.lit("")))


def major_headings(sections: DataFrame, document: str, order: str, most: int = MAX_HEADINGS) -> DataFrame:
    """document and headings: the first ``most`` headings of its sections that differ in more than case. sections: section_title, heading_path, section_type."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    said = text.inline_whitespace(F.coalesce(filled("section_title"), filled("heading_path"), filled("section_type")))
    rows = sections.select(document, F.col(order).alias("at"), said.alias("heading")).where("heading <> ''")
    once = rows.groupBy(document, F.lower("heading").alias("low")).agg(F.min_by("heading", "at").alias("heading"), F.min("at").alias("at"))
    kept = once.withColumn("rn", F.row_number().over(Window.partitionBy(document).orderBy("at", "low"))).where(F.col("rn") <= most)
    return kept.groupBy(document).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "heading"))), lambda x: x["heading"]).alias("headings"))


def line(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))


def document_text(title: Column, bucket: Column, key: Column, order_date: Column, external_id: Column, headings: Column, opening: Column) -> Column:
    """One line a field, without those that are missing; headings and opening lines are arrays."""
    none = F.array().cast("array<string>")
    headings, opening = F.coalesce(headings, none), F.coalesce(opening, none)
    first = [F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit(""))) for label, c in (("Document title", title), ("Bucket", bucket), ("Record key", key))]
    more = [line("Order date", F.date_format(order_date, "yyyy-MM-dd")), line("External record id", external_id), line("Procedural type", procedural_type(title, bucket, headings)), line("Major headings", F.array_join(headings, "; "))]
    begun = F.when(F.size(opening) > 0, F.concat(F.lit("Opening lines:\n- "), F.array_join(opening, "\n- ")))
    return F.trim(F.concat_ws("\n", *first, *more, begun))


def section_text(title: Column, bucket: Column, key: Column, section_key: Column, section_type: Column, section_title: Column, heading_path: Column, page_start: Column, page_end: Column, bodies: Column) -> Column:
    """The section's place, then its chunks' texts (an array) with an empty line between."""
    first = [F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit(""))) for label, c in (("Document title", title), ("Bucket", bucket), ("Record key", key), ("Section key", section_key), ("Section type", section_type))]
    pages = F.concat(F.lit("Page range: "), page_start.cast("string"), F.lit("-"), page_end.cast("string"))
    body = F.array_join(F.filter(F.transform(bodies, trimmed), lambda b: b != ""), "\n\n")
    return trimmed(F.concat_ws("\n", *first, line("Section title", section_title), line("Heading path", heading_path), pages, F.lit("Section text:"), body))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s++|\s++$", "")


def chunk_text(section_type: Column, section_title: Column, heading_path: Column, body: Column) -> Column:
    path = F.when(heading_path.eqNullSafe(section_title), F.lit(None)).otherwise(heading_path)
    return trimmed(F.concat_ws("\n", F.concat(F.lit("Section type: "), F.coalesce(section_type, F.lit(""))), line("Section title", section_title), line("Heading path", path), F.lit(""), trimmed(F.coalesce(body, F.lit("")))))


def last_tokens(c: Column, n: int) -> Column:
    """The text of the last n words and marks, read from the end."""
    back = F.regexp_extract(F.reverse(c), rf"^\s*+((?:(?:\w++|[^\w\s])\s*+){{0,{n}}}+)", 1)
    return trimmed(F.reverse(back))


#: Terms that are written as one word.
GLUED = {"assistantmanagers": "assistant managers", "assistantmanager": "assistant manager", "wholetimemembers": "whole time members", "wholetimemember": "whole time member", "boardmembers": "board members", "boardmember": "board member"}
#: Context, what a short form stands for, and its forms; applied in this order.
SHORT_FORMS = (
    ("current_people", "whole time member", ("wtm", "wtms", "whole-time member", "whole-time members")), ("current_people", "executive director", ("ed", "eds", "executive directors")), ("current_people", "assistant manager", ("am", "ams", "assistant managers")),
    ("current_people", "deputy general manager", ("dgm", "dgm s", "dgms")), ("current_people", "chief general manager", ("cgm", "cgms")), ("current_people", "regional director", ("rd", "rds")), ("current_people", "chairperson", ("chairman",)),
    ("current_offices", "regional office", ("ro", "ros")), ("current_offices", "local office", ("lo", "los")), ("current_offices", "northern regional office", ("nro",)), ("current_offices", "southern regional office", ("sro",)),
    ("current_offices", "eastern regional office", ("ero",)), ("current_offices", "western regional office", ("wro",)),
    ("order_lookup", "whole time member", ("wtm", "wtms", "whole-time member", "whole-time members")), ("order_lookup", "chairperson", ("chairman",)), ("order_legal", "pfutp regulations", ("pfutp",)), ("order_legal", "pit regulations", ("pit",)),
    ("order_legal", "icdr regulations", ("icdr",)), ("order_legal", "investment advisers regulations", ("ia",)), ("order_legal", "research analysts regulations", ("ra",)), ("order_legal", "reit regulations", ("reit",)),
    ("order_lookup", "non banking financial company", ("nbfc",)), ("order_lookup", "draft red herring prospectus", ("drhp",)), ("order_lookup", "offer for sale", ("ofs",)), ("order_lookup", "show cause notice", ("scn",)),
    ("order_lookup", "adjudicating officer", ("ao",)), ("order_lookup", "securities appellate tribunal", ("sat",)),
)
DEPARTMENT_CUES = r"\b(department|enforcement|investigation|inspection)\b"


def expanded(query: Column, contexts: tuple[str, ...]) -> Column:
    """An array: the query in lower case, and as it stands after each rule that changes it, each once. Orders are asked about with
    every rule of order_lookup, and there ed is the enforcement department beside a department's word, else a director."""
    current = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    for glued, apart in GLUED.items():
        current = F.replace(current, F.lit(glued), F.lit(apart))
    current = F.regexp_replace(current, r"\s+", " ")
    orders = bool({"order_lookup", "order_legal"} & set(contexts))
    rules = [(full, forms) for context, full, forms in SHORT_FORMS if context in contexts or orders and context == "order_lookup"]
    # a fold whose last element is what the next rule sees: the plan stays flat
    fold = lambda steps, rule: F.concat(steps, F.array(F.regexp_replace(F.element_at(steps, -1), rule["form"], rule["full"])))
    form = lambda forms: r"\b(" + "|".join(sorted(forms, key=len, reverse=True)) + r")\b"
    table = [F.struct(F.lit(form(forms)).alias("form"), F.lit(full).alias("full")) for full, forms in rules]
    if orders:
        beside = current.rlike(DEPARTMENT_CUES)
        table.append(F.struct(F.when(beside, form(("ed",))).otherwise(form(("ed", "eds"))).alias("form"), F.when(beside, "enforcement department").otherwise("executive director").alias("full")))
    steps = F.aggregate(F.array(*table), F.array(current), fold) if table else F.array(current)
    return F.when(current == "", F.array().cast("array<string>")).otherwise(F.array_distinct(steps))


#: What a group is called in a query.
GROUP_ALIASES = {
    "chairperson": ("chairperson", "chairman"), "whole_time_member": ("whole time member", "whole-time member", "wtm"), "board_member": ("board member",), "executive_director": ("executive director", "ed"),
    "chief_general_manager": ("chief general manager", "cgm"), "general_manager": ("general manager", "gm"), "deputy_general_manager": ("deputy general manager", "dgm"), "assistant_general_manager": ("assistant general manager", "agm"),
    "manager": ("manager",), "assistant_manager": ("assistant manager", "am"), "regional_director": ("regional director", "rd"), "office_contact": ("office contact",), "staff": ("staff",),
}


def asked_group(value: Column) -> Column:
    """The designation group that a query names, in singular or plural, at its beginning; null for others."""

    def named_group(named: Column) -> Column:
        single = F.when(named.endswith("s") & ~named.endswith("ss"), F.regexp_replace(named, "s$", "")).otherwise(named)
        return text.bound(single, found)

    def found(single: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for group, names in GROUP_ALIASES.items():
            for name in names:
                out = out.when((single == name) | single.startswith(name + " "), group)
        return out

    return text.bound(F.trim(designation(value)), named_group)
