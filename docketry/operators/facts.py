"""Facts from sentences: amounts, percentages, provisions, signatories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import text

#: Statutes known by other names.
STATUTES = {
    "SEBI Act, 1992": ("sebi act", "securities and exchange board of india act"),
    "PFUTP Regulations": ("pfutp", "pfutp regulations", "fraudulent and unfair trade practices regulations"),
    "PIT Regulations": ("pit", "pit regulations", "insider trading regulations"),
    "ICDR Regulations": ("icdr", "icdr regulations", "issue of capital and disclosure requirements regulations"),
    "SAST Regulations": ("sast", "sast regulations", "substantial acquisition of shares and takeovers regulations"),
    "Investment Advisers Regulations": ("ia", "ia regulations", "investment advisers regulations"),
    "Research Analysts Regulations": ("ra", "ra regulations", "research analysts regulations"),
    "REIT Regulations": ("reit", "reit regulations", "real estate investment trusts regulations"),
    "Settlement Regulations": ("settlement regulations", "sebi settlement regulations"),
}
_KIND = r"(?:sections?|regulations?|rules?|schedules?)"
#: A number with letters, dots and brackets, a bracketed part, a Roman number or a letter; and what may stand between two.
_REF = r"(?:[0-9][0-9A-Za-z().-]*|(?:\([0-9A-Za-z]{1,5}\))+|(?:[IVXLC]+|[A-Z])(?:\([0-9A-Za-z]{1,5}\))*(?![0-9A-Za-z]))"
_WORD = r"(?:(?:and|or|to|read\s+with|r/w|as\s+well\s+as|along\s+with)\s++)?"
_BETWEEN = rf"(?:\s*+(?:[,;/&]\s*+)+|\s++){_WORD}(?:{_KIND}\s++)?"
_ALIAS = "|".join(a.replace(" ", r"\s+") for a in sorted((a for names in STATUTES.values() for a in names), key=len, reverse=True))
_STATUTE = rf"(?:(?:{_ALIAS})\b(?!\s+(?:Act|Regulations|Rules)\b)|[A-Za-z][A-Za-z()&' -]{{0,160}}?\b(?:Act|Regulations|Rules)\b)(?:,?\s+[0-9]{{4}}\b)?"
PROVISION = rf"(?i)\b({_KIND}\s+{_REF}(?:{_BETWEEN}{_REF}){{0,40}}\s+of\s+(?:the\s+)?{_STATUTE})"


def row_sha(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def amounts(sentences: DataFrame, doc: str) -> DataFrame:
    """A row for each amount of each sentence, once a document and place."""
    rows = sentences.select(doc, "place", F.posexplode(text.amounts(F.col("sentence"))).alias("k", "amount_text"))
    return rows.select(doc, "place", "k", "amount_text", F.round(text.amount_value(F.col("amount_text")), 4).alias("amount"), text.amount_unit(F.col("amount_text")).alias("unit"))


def percentages(sentences: DataFrame, doc: str) -> DataFrame:
    found = F.regexp_extract_all("sentence", F.lit(r"(\d+(?:\.\d+)?)\s*(?:%|per\s*cent)"), F.lit(1))
    return sentences.select(doc, "place", F.posexplode(found).alias("k", "v")).withColumn("v", F.col("v").cast("double"))


def statute_name(c: Column) -> Column:
    """The known name of a statute given by another, else the words with capitals."""
    words = F.trim(F.regexp_replace(c, r"\s+", " "))
    key = F.lower(F.regexp_replace(words, r",?\s+[0-9]{4}$", ""))
    known = F.create_map(*[F.lit(x) for name, aliases in STATUTES.items() for a in aliases for x in (a, name)])
    return F.coalesce(F.try_element_at(known, key), F.initcap(words))


def provisions(units: DataFrame, doc: str, body: str) -> DataFrame:
    """A row for each reference: kind, number, statute and a hash of the row; repeated ones once.

    All references of a list have the kind of its first word."""
    hits = units.select(doc, F.explode(F.regexp_extract_all(F.col(body), F.lit(PROVISION), F.lit(1))).alias("hit"))
    # No reference holds the word of: the first one ends the list.
    sides = F.split("hit", r"(?i)\s+of\s+(?:the\s+)?", 2)
    kind = F.initcap(F.regexp_extract("hit", "(?i)^(section|regulation|rule|schedule)", 1))
    refs = F.regexp_replace(sides[0], rf"(?i)^{_KIND}\s+", "")
    found = F.regexp_extract_all(refs, F.lit(rf"(?i)(?:^|\G(?<!^){_BETWEEN})({_REF})"), F.lit(1))
    rows = hits.select(doc, kind.alias("kind"), statute_name(sides[1]).alias("statute"), F.explode(found).alias("reference"))
    # the columns themselves are compared: hashes would be most of what is shuffled
    return rows.distinct().withColumn("row_sha", row_sha(F.col(doc), F.col("kind"), F.col("reference"), F.col("statute")))


def signatories(pages: DataFrame, doc: str, page: str, body: str) -> DataFrame:
    """From the last four pages: the last line with a designation, and the line before it as the name."""
    from pyspark.sql import Window

    tail = pages.withColumn("__r", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc(page)))).where("__r <= 4")
    lines = tail.select(doc, page, F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    before = F.lag("line").over(Window.partitionBy(doc, page).orderBy("line_no"))
    hits = lines.withColumn("name", F.trim(before)).where(F.col("line").rlike("(?i)(whole time member|chairman|general manager|adjudicating officer|executive director)"))
    return hits.groupBy(doc).agg(F.max_by(F.struct(F.col("name"), F.trim("line").alias("designation")), F.struct(page, "line_no")).alias("s")).select(doc, "s.*")


#: How far a stated number may be from the expected one.
TOLERANCES = {"price": 0.01, "percentage": 0.05, "share_count": 0.5, "amount": 1.0}
_DAY = r"\d{1,2}[./-]\d{1,2}[./-]\d{4}"
_ANCHOR = rf"(?<!\d)(\d{{1,2}})[.)]?\s+({_DAY})\s*(?:to|-|–)\s*({_DAY})"


def numbers(c: Column) -> Column:
    """Every number of a text as a double; commas between digits don't count."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<=\d),(?=\d)", ""), F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))
    return F.transform(found, lambda x: x.cast("double"))


def states_value(c: Column, value: Column, kind: str = "amount") -> Column:
    """Whether a text states the value within the tolerance of its kind; null values are never stated."""
    return F.coalesce(F.exists(numbers(c), lambda x: F.abs(x - value) <= TOLERANCES[kind]), F.lit(False))


def price_rows(pages: DataFrame, doc: str, page: str, body: str) -> DataFrame:
    """One row for each numbered period of a price table: dates, first, last, high, low, the last percentage and what is said after it.

    A row of the table runs from its number and dates to those of the next one; equal rows of a document are one."""
    flat = F.regexp_replace(F.coalesce(F.col(body), F.lit("")), r"\s+", " ")
    rows = pages.select(doc, page, F.explode(F.regexp_extract_all(flat, F.lit(rf"({_ANCHOR}.*?(?=(?<!\d)\d{{1,2}}[.)]?\s+{_DAY}\s*(?:to|-|–)|$))"), F.lit(1))).alias("row_text"))
    part = lambda i: F.regexp_extract("row_text", _ANCHOR, i)
    day = lambda i: text.any_date(F.regexp_replace(part(i), r"[./]", "-"), ("d-M-yyyy",))
    rest = F.regexp_replace("row_text", "^.*?" + _ANCHOR, "")
    shares = F.regexp_extract_all(rest, F.lit(r"(-?\d+(?:\.\d+)?)\s*%"), F.lit(1))
    prices = numbers(F.regexp_replace(rest, r"-?\d+(?:\.\d+)?\s*%.*$", ""))
    out = rows.withColumns({"period_no": part(1).cast("int"), "from_day": day(2), "to_day": day(3), "first_price": F.get(prices, F.lit(0)), "last_price": F.get(prices, F.lit(1)), "high": F.array_max(prices), "low": F.array_min(prices)})
    out = out.withColumns({"percentage": F.try_element_at(shares, F.lit(-1)).cast("double"), "rationale": text.whitespace_or_null(F.regexp_replace(rest, r"^.*%", ""))})
    return out.withColumn("row_sha256", row_sha(F.col("row_text"))).dropDuplicates([doc, "row_sha256"])


def place_label(c: Column) -> Column:
    return text.whitespace_or_null(F.regexp_extract(c, r"(?im)^\s*place\s*:\s*([A-Za-z .]{2,40})", 1))


def date_label(c: Column) -> Column:
    said = F.trim(F.regexp_extract(c, r"(?im)^\s*dated?\s*:\s*([A-Za-z0-9 ,./-]{6,24})", 1))
    return text.any_date(F.regexp_replace(said, r"[.]", "-"), ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy"))


def by_statute(provisions: DataFrame) -> DataFrame:
    """statute and its references, each once, in the order of their first place. provisions: statute, reference, at."""
    first = provisions.groupBy("statute", "reference").agg(F.min("at").alias("at"))
    return first.groupBy("statute").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "reference"))), lambda x: x["reference"]).alias("references"))
