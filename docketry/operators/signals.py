"""What a question's own words say: signals, intents, and from these the flags that plans are made from.

A signal is a set of phrases, looked up in the question's key between blanks; some need a phrase of a second set too, or stand at the
beginning, or are the whole question. All are Column functions of one pass."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import text

Phrases = tuple[str, ...]


@dataclass(frozen=True)
class Signal:
    """any: one of these; with: and one of these; first: or one of these at the beginning; whole: or the question is one of these."""

    any: Phrases = ()
    also: Phrases = ()
    first: Phrases = ()
    whole: Phrases = ()

    def holds(self, said: Column) -> Column:
        """said: the key with a blank at either end."""
        out = F.lit(False)
        if self.any:
            out = has(said, self.any) & (has(said, self.also) if self.also else F.lit(True))
        if self.first:
            out = out | said.rlike(f"^ (?:{'|'.join(self.first)}) ")
        return out | said.isin(*(f" {w} " for w in self.whole)) if self.whole else out


def has(said: Column, phrases: Iterable[str]) -> Column:
    return said.rlike(f" (?:{'|'.join(phrases)}) ")


# Words and phrases of questions.
PAPERS = ("appeal no", "petition no", "writ no", "case no", "suit no", "application no", "complaint no", "order no")
DEICTIC = ("this case", "this matter", "this appeal", "this order", "that case", "that matter", "the order", "these sections", "these regulations", "these provisions")
LAW = ("section", "sections", "regulation", "regulations", "provision", "provisions")
ROLES = tuple(f"{r} of" for r in ("ceo", "cfo", "coo", "cto", "md", "managing director", "chairman", "chairperson", "owner", "promoter"))
SIGNALS = {
    "title": Signal(("filed by", "in the matter of", "vs", "versus", "v", *PAPERS)),
    "deictic": Signal(DEICTIC),
    "follow_up": Signal((*DEICTIC, "that appeal", "that order", "these violations", "finally", "it", "they", "them", "therein"), first=("what", "was", "were", "did", "and", "so")),
    "detail": Signal(("detail", "details", "explain", "tell me more", "summary", "summarise", "summarize")),
    "smalltalk": Signal(whole=("hi", "hello", "hey", "good morning", "good afternoon", "good evening", "thanks", "thank you", "thx", "bye", "goodbye", "what can you do", "how can you help", "help")),
    "corpus": Signal(("date range", "from which dates", "from what dates", "how many", "count", "local pdf", "local pdfs", "pdf availability", "bucket", "buckets")),
    "outcome": Signal(("dismissed", "allowed", "upheld", "quashed", "penalty", "penalties", "refund", "restrained", "debarred", "directed", "direction", "directions", "operative", "finding", "findings", "settle", "settlement", "settled", "violated", "violations", "holding")),
    "settlement": Signal(("settlement", "settled", "terms of settlement", "term of settlement")),
    "signatory": Signal(("who", "which"), ("signed", "signatory")),
    "authority": Signal(("signed the order", "quasi judicial authority", "qasi judicial authority")),
    "date": Signal(tuple(f"when was {d} {m} {p}" for d in ("this", "the") for m in ("order", "case", "matter") for p in ("passed", "issued")) + ("order passed",)),
    "provisions": Signal((*LAW, "violation", "violations")),
    "explains": Signal(("explain",), LAW),
    "meaning": Signal(("what they mean", "explain them")),
    "pan": Signal(("pan",)),
    "amount": Signal(("amount", "rs", "inr", "crore", "lakh")),
    "holding": Signal(("share", "shares", "percentage", "holding", "holdings", "shareholding", "own", "owns", "owned", "ownership")),
    "parties": Signal(("party", "parties", "noticee", "noticees", "appellant", "appellants", "respondent", "respondents")),
    "observed": Signal(("da", "designated authority", "enquiry report", "enquiry officer"), ("observe", "observed", "find", "finding", "conclude", "concluded")),
    "observations": Signal(("what did",), ("observe", "find", "conclude", "hold")),
    "prices": Signal((
        "share price increase", "price increased by", "percentage increase", "percent increase", "price before and after", "before and after the increase", "price movement", "price movements", "each patch", "each period", "patch wise", "period wise",
        "listing price", "listed at", "highest price", "peak price", "lowest price", "low price", "ipo proceeds", "proceeds were raised")),
    "court": Signal(("vs", "versus", "v", "sat", "appeal", "w p", "wp", "writ petition", "court", "judgment", "tribunal")),
    "live": Signal(("latest", "recent", "current", "today", "now", "as of", "what is new", "what s new")),
    "news": Signal(tuple(f"{w} news" for w in ("latest", "recent", "current")) + ("news about",)),
    "bulletin": Signal(("latest", "recent", "current"), ("circular", "update", "press release", "public development")),
    "role": Signal(ROLES),
    "in_order": Signal(("according to the order", "according to order", "as per the order", "as per order", "in the order of", "in the matter of", "in order", "from order", "in the order", "from the order", "in this case", "in this order")),
    "historical": Signal(tuple(f"{w} {p}" for w in ("previous", "former", "immediate past") for p in ("chairman", "chairperson", "board member", "board members")), first=("who was",)),
    "explanatory": Signal(("difference between", "meaning of"), first=("what is", "who is", "explain", "tell me about")),
    "summary": Signal(("brief summary", "summarise", "summarize", "summary of")),
    "comparison": Signal(("compare", "comparison", "contrast", "difference", "differences", "distinguish")),
    "reference": Signal(("appeal", "petition", "writ", "case", "suit", "matter", "order no", "filed by", "in the matter of", "petitioner", "respondent")),
    "person": Signal(first=("who is", "who was")),
    "directory": Signal(("board member", "board members", "whole time member", "whole time members", "wtm", "wtms", "executive director", "executive directors", "regional director", "chairman", "chairperson", "office", "designation", "organisation structure", "org chart", "staff")),
}
#: Terms of the intents.
EXPLAINED = Signal(("meaning of",), first=("what is", "explain"))
SUBSTANTIVE = Signal(("dismissed", "allowed", "upheld", "quashed", "penalty", "penalties", "imposed", "restrained", "debarred", "directed", "direct", "refund", "settle", "settled", "settlement", "violated", "findings", "held", "order passed", "final order", "interim order"))
SETTLING = Signal(("settle", "settlement", "settled"))
NAMING = Signal(("filed by", "vs", "versus", "v", "in the matter of", "petitioner", "respondent", *PAPERS))
APPEAL = Signal(("appeal",))
TOPICS = Signal(("act", "regulation", "regulations", "rule", "rules", "section", "sast", "pfutp", "icdr", "lodr", "insider trading", "takeover", "adjudication"))


def said(query: Column) -> Column:
    return F.concat(F.lit(" "), text.lookup_key(F.coalesce(query, F.lit(""))), F.lit(" "))


def found(query: Column) -> dict[str, Column]:
    """Each signal of SIGNALS, and year (1900 to 2099)."""
    key = said(query)
    return {name: s.holds(key) for name, s in SIGNALS.items()} | {"year": key.rlike(" (?:19|20)[0-9]{2} ")}


def intent(query: Column, names: Column | None = None) -> Column:
    """substantive, party_or_title, regulation or generic. An explanation of settlements is generic where the question has no names (array) of its own."""
    key = said(query)
    bare = F.lit(True) if names is None else F.size(F.coalesce(names, F.array().cast("array<string>"))) == 0
    out = F.when(EXPLAINED.holds(key) & SETTLING.holds(key) & bare, "generic").when(SUBSTANTIVE.holds(key) | SETTLING.holds(key), "substantive")
    return out.when(NAMING.holds(key), "party_or_title").when(APPEAL.holds(key), "substantive").when(TOPICS.holds(key), "regulation").otherwise("generic")


def settlement_focused(query: Column, names: Column | None = None) -> Column:
    return (intent(query, names) == "substantive") & SETTLING.holds(said(query))


#: The flags of routing.planned() that are made here; the rest are the caller's.
GIVEN = {"session_scope": "boolean", "named_order": "boolean", "strict_scope": "boolean", "has_variants": "boolean", "ambiguous": "boolean"}


def flags(questions: DataFrame) -> DataFrame:
    """questions (query; of GIVEN what is known, see locks.matter_locks: named_order, strict_scope) with the flags of routing.SIGNALS."""
    rows = questions.withColumns({c: F.coalesce(F.col(c), F.lit(False)) if c in questions.columns else F.lit(False) for c in GIVEN})
    rows = rows.withColumns({f"__{name}": c for name, c in found(F.col("query")).items()})
    s = lambda name: F.col(f"__{name}")
    session, named = F.col("session_scope"), F.col("named_order")
    about = s("title") | s("reference") | s("year") | named
    scoped = about | session
    defines = s("explanatory") & ~(about | s("deictic"))
    asked = (
        s("signatory") | s("authority") | s("date") | s("provisions") & ~defines | s("pan") | s("amount") & scoped | s("holding") & scoped | s("parties") & scoped | s("observed") | s("observations") | s("prices") & scoped
    )
    settles = s("settlement") & ~EXPLAINED.holds(said(F.col("query"))) & (about | s("outcome"))
    role = s("role") & ~s("in_order") & ~s("title")
    corpus = s("corpus") & ~named & ~s("title") & ~s("prices")
    directory = s("directory") & ~(s("news") | s("historical") | corpus | s("court") | role | about)
    likely = (s("follow_up") | asked | s("outcome")) & session & ~defines
    active = session & (asked | s("deictic") & s("detail")) & ~named
    matter = (about | s("outcome") & session | likely | settles) & ~(s("smalltalk") | corpus | role)
    explains = s("explanatory") & ~(s("smalltalk") | corpus | directory | s("title") | s("reference") | likely | settles | role)
    out = {
        "empty": said(F.col("query")) == "  ", "smalltalk": s("smalltalk"), "current_news": s("news") | s("bulletin"), "corpus_metadata": corpus, "active_override": active, "metadata_asked": asked, "structured_info": directory,
        "historical_official": s("historical") & ~s("title"), "current_official": F.lit(False), "company_role": role, "explanatory": explains, "matter_specific": matter, "other_person": s("person") & ~directory & ~about, "live": s("live"),
        "comparison": s("comparison"), "title_or_party": s("title"), "court_style": s("court"), "likely_follow_up": likely, "asks_provision": s("explains") | s("meaning"), "outcome": s("outcome"), "settlement": settles,
    }
    return rows.withColumns(out).drop(*(f"__{name}" for name in [*SIGNALS, "year"]))
