"""Column functions on strings: cleaning, tokens, trigrams, keys, urls, amounts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is worked out once however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def newlines(c: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def inline_whitespace(c: Column) -> Column:
    """Runs of blanks and tabs become one blank, line ends stay; trimmed. Single blanks are no match: a long text is copied once."""
    return F.trim(F.regexp_replace(c, r"[\t\f\x0B][ \t\f\x0B]*+| [ \t\f\x0B]++", " "))


def whitespace_or_null(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def uppercase_ratio(c: Column) -> Column:
    """Upper-case letters among letters a to z of either case; 0 without letters."""
    letters = F.length(F.regexp_replace(c, "[^A-Za-z]++", ""))
    return F.when(letters == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(c, "[^A-Z]++", "")) / letters)


def lookup_key(c: Column) -> Column:
    """Lower case, & as and, everything but letters a to z and digits as one blank."""
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def slug(c: Column, most: int) -> Column:
    """At most ``most`` characters of letters and digits, with - for what is between. As each run of them gives a character and a -,
    the first ``most`` runs of the text, wherever they are, hold all of the slug."""
    runs = F.regexp_extract(F.lower(c), f"^[^a-z0-9]*+((?:[a-z0-9]++[^a-z0-9]*+){{0,{most}}}+)", 1)
    cut = F.substring(F.regexp_replace(runs, "[^a-z0-9]++", "-"), 1, most)
    return F.regexp_replace(cut, "-$", "")


def heading_path(parts: Column) -> Column:
    return F.nullif(F.array_join(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""), " > "), F.lit(""))


def split_heading_path(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, " > "), lambda p: F.trim(p)), lambda p: p != "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+"), lambda t: t != "")


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words, each with two blanks before and one after."""
    padded = F.transform(F.array_distinct(tokens(c)), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams among all trigrams; arguments are arrays of trigrams."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.greatest(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def coverage(query: Column, title: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(query, title)) / F.nullif(F.size(query), F.lit(0)), F.lit(0.0))


def record_key(bucket: Column, external_id: Column, *parts: Column) -> Column:
    """external:<id>, or derived:<sha256 of the parts>."""
    joined = F.concat_ws(chr(31), bucket, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.when(F.coalesce(external_id, F.lit("")) != "", F.concat(F.lit("external:"), external_id)).otherwise(F.concat(F.lit("derived:"), F.sha2(joined, 256)))


def email(c: Column) -> Column:
    """[at] and [dot] written out; null if there is no @."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s*[\[(]\s*at\s*[\])]\s*", "@"), r"\s*[\[(]\s*dot\s*[\])]\s*", ".")
    return F.when(out.contains("@"), out)


def phone(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"[^0-9+]", ""), F.lit(""))


def domain(url: Column) -> Column:
    """The host without user, port, www. and m."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^(www\.|m\.)", "")


#: Query parameters that only track.
TRACKING = r"(utm_[a-z]+|gclid|fbclid|ref)"


def canonical_url(url: Column) -> Column:
    """Without fragment, tracking parameters and last slash."""
    bare = F.regexp_replace(url, "#.*$", "")
    path, query = F.regexp_replace(bare, r"\?.*$", ""), F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^" + TRACKING + "=")), "&")
    path = F.regexp_replace(path, "/+$", "")
    return F.when(kept == "", path).otherwise(F.concat(path, F.lit("?"), kept))


def domain_allowed(host: Column, allowed: list[str]) -> Column:
    out = F.lit(False)
    for a in allowed:
        out = out | (host == a) | host.endswith("." + a)
    return out


def sentences(c: Column) -> Column:
    """Cut at line ends, and after a full stop or semicolon and blanks before a capital; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"\n+|(?<=[.;])\s+(?=[A-Z])"), lambda s: F.trim(s)), lambda s: s != "")


#: A currency and a number, or a bare number of crore or lakh.
AMOUNT = r"(?i)((?:\b(?:rs\.?|inr|eur|usd)|[\u20b9$])\s*\d[\d,]*(?:\.\d+)?(?:\s*(?:crore|lakh|million)|/-)?|\b\d[\d,]*(?:\.\d+)?\s*(?:crore|lakh)\b)"


def amounts(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(AMOUNT), F.lit(1))


def amount_value(c: Column) -> Column:
    """The first number, times the factor of crore, lakh or million."""
    low = F.lower(c)
    factor = F.when(low.contains("crore"), 1e7).when(low.contains("lakh"), 1e5).when(low.contains("million"), 1e6).otherwise(1.0)
    return F.expr("1.0D") * F.regexp_replace(F.regexp_extract(c, r"(\d[\d,]*(?:\.\d+)?)", 1), ",", "").cast("double") * factor


def amount_unit(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.contains("crore"), "crore").when(low.contains("lakh"), "lakh").when(low.contains("million"), "million").otherwise("unit")


def citations(c: Column) -> Column:
    """Numbers in [n] marks, each once, in order."""
    return F.transform(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), F.lit(1))), lambda x: x.cast("int"))


def strip_citations(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*\[\d+\]", ""), r" +", " "))


def preview(c: Column, most: int = 200) -> Column:
    """The first ``most`` characters, white space as single blanks; they are among the first ``most`` words."""
    words = F.regexp_extract(c, rf"^\s*+((?:\S++\s*+){{0,{most}}}+)", 1)
    return F.substring(F.trim(F.regexp_replace(words, r"\s++", " ")), 1, most)


def person_name(c: Column) -> Column:
    """Names all in capitals get title case."""
    return F.when((c == F.upper(c)) & c.rlike("[A-Z]"), F.initcap(F.lower(c))).otherwise(c)


def any_date(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMMM yyyy")) -> Column:
    return F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in formats])


#: Characters of an id that is derived from a hash.
ID_LENGTH = 16


def record_id(key: Column) -> Column:
    """What follows external:, the first 16 characters of what follows derived:, else of the key's SHA-256."""
    parts = F.split(key, ":", 2)
    value = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    return F.when((parts[0] == "external") & (value != ""), value).when((parts[0] == "derived") & (value != ""), F.substring(value, 1, ID_LENGTH)).otherwise(F.substring(F.sha2(key, 256), 1, ID_LENGTH))


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def url_date(url: Column) -> Column:
    """year, month, day from a url's path (/2020-01-31/ or /jan-2020/), or a year anywhere; 0 for what is missing."""
    low = F.lower(F.coalesce(url, F.lit("")))
    iso, month, year = r"/(\d{4})-(\d{2})-(\d{2})(?:/|$)", "/(" + "|".join(_MONTHS) + r")-(\d{4})/", r"(?<!\d)(20\d{2}|19\d{2})(?!\d)"
    got = lambda p, g: F.regexp_extract(low, p, g)
    numbers = F.array(*map(F.lit, _MONTHS))
    made = lambda y, m, d: F.struct(y.cast("int").alias("year"), m.cast("int").alias("month"), d.cast("int").alias("day"))
    zero = F.lit(0)
    return F.when(low.rlike(iso), made(got(iso, 1), got(iso, 2), got(iso, 3))).when(low.rlike(month), made(got(month, 2), F.array_position(numbers, got(month, 1)), zero)).when(low.rlike(year), made(got(year, 1), zero, zero)).otherwise(made(zero, zero, zero))


def json_items(c: Column) -> Column:
    """The items of a JSON array as texts, without null and empty ones; other texts as one item, none for empty ones."""
    found = F.from_json(c, "array<string>")
    one = F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(c))
    return F.when(F.trim(c).startswith("[") & found.isNotNull(), F.filter(found, lambda x: x.isNotNull() & (x != ""))).otherwise(one)
