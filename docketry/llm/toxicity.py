"""Toxicity of deobfuscated text by a noisy-channel decoder.

A character trigram model is counted over all documents. Spans that look obfuscated (letters
mixed with digits and signs, single letters set apart, letters repeated three times and more) are found by one
pass of arrays over a batch of texts and
become character lattices: a sign may stand for letters it resembles or for nothing, a
separator for nothing, a repeated letter for nothing or itself. A Viterbi search with back-pointers takes the likeliest letters under channel
and character model, and a hashed word n-gram model scores the restored text. As features,
words lose repeated letters, so that a word and its stretched form agree. Time grows with the length of
a text, whether it has blanks or not.

Defined results: of equally likely readings the one found first stays, letters in the order of LOOKS and nothing last; a null text is empty and is scored by the bias alone; labels other than 0 and 1 and
unknown ids are ignored, of several labels of an id the largest counts, of several texts the one with the smallest hash is learnt from; without two kinds of labels
every score is 0; repeated rows are scored each for itself; an empty table gives no rows; labels,
lang, source and doc_id are no features, and other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm import linear
from docketry.llm.common import bounded, map_arrow, text_or_empty
from docketry.llm.segments import BLANK, LETTER, NUMBER, joined, mix, words

THRESHOLD = 0.3
#: The letters that digits and signs stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "§": "s", "µ": "u", "ø": "o",
}
SEPARATORS = ".-_*~'·/ "
#: Natural logarithms of the channel: a sign for a letter, a sign for nothing, a separator for nothing, a repeated letter for nothing or itself.
SWAP, DROP, APART, SHRINK, STAY = -1.0, -16.0, -0.1, -0.2, -2.0
MAX_KEPT = 200_000
_SIGNS = re.escape("".join(LOOKS))
_ALNUM, _LETTER, _MARK = r"[^\W_]", r"[^\W\d_]", rf"[{_SIGNS}.\-_*~·/]"
#: None of these goes back over what it has passed. Single characters set apart by one separator each:
_SPACED = re.compile(rf"(?<!{_ALNUM})(?:{_ALNUM}|[{_SIGNS}])(?:[ .\-_*~·/](?:{_ALNUM}|[{_SIGNS}])){{2,}}(?!{_ALNUM})")
#: What stands between white space, has a letter, and a mark with a letter or digit after it.
_MIXED = re.compile(rf"(?<!\S)(?=(?:[\d_]|[^\w\s])*+{_LETTER})(?=(?:(?!{_MARK})\S)*+{_MARK}(?:[^\w\s]|_)*+{_ALNUM})\S++")
#: A run of letters and digits with a letter three times in a row.
_STRETCHED = re.compile(rf"(?<!{_ALNUM})(?={_ALNUM}*?({_LETTER})\1\1){_ALNUM}++")
_EDGE = ".,;:?%&#*|\"'()[]{}<>-_~"
_tables: list[np.ndarray] = []


def marks() -> np.ndarray:
    """For each code point: 1 for a sign that may stand for a letter, 2 for another mark inside of words, else 0."""
    if not _tables:
        table = np.zeros(0x110000, dtype=np.uint8)
        table[[ord(c) for c in ".-_*~·/"]] = 2
        table[[ord(c) for c in LOOKS]] = 1
        _tables.append(table)
    return _tables[0]


def suspicious(cp: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the pieces worth decoding: words with marks or stretched letters and single characters, as far as one blank each parts them."""
    white = kind >= BLANK
    start = np.ones(len(cp), dtype=bool)
    start[1:] = white[1:] != white[:-1]
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], len(cp))
    letter = kind == LETTER
    alnum = letter | (kind == NUMBER)
    look = marks()[cp]
    at = np.arange(len(cp))
    mixed = np.minimum.reduceat(np.where(look > 0, at, len(cp)), begin) < np.maximum.reduceat(np.where(alnum, at, -1), begin)
    mixed &= np.logical_or.reduceat(letter, begin)
    same = letter[2:] & (cp[2:] == cp[1:-1]) & (cp[1:-1] == cp[:-2])
    mixed[np.searchsorted(begin, np.flatnonzero(same) + 2, side="right") - 1] = True
    single = (end - begin == 1) & (alnum | (look == 1))[begin]
    some = (mixed | single) & ~white[begin]
    runs = np.flatnonzero(some)
    if not len(runs):
        return runs, runs
    # runs of white space and of other characters alternate: the next word is two runs on
    gap = np.ones(len(runs), dtype=bool)
    between = np.minimum(runs[:-1] + 1, len(begin) - 1)
    gap[1:] = (np.diff(runs) != 2) | (end[between] - begin[between] != 1) | (cp[begin[between]] != 0x20)
    first = np.flatnonzero(gap)
    count = np.diff(first, append=len(runs))
    worth = np.logical_or.reduceat(mixed[runs], first) | (count >= 3)
    return begin[runs[first[worth]]], end[runs[(first + count - 1)[worth]]]


def letter_codes(text: str) -> np.ndarray:
    """0 for what is no letter, 1 to 26 for a to z; accents are dropped."""
    low = text.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKD", low).encode("ascii", "replace").decode()
    raw = np.frombuffer(low.encode(), dtype=np.uint8)
    return np.where((raw >= 97) & (raw <= 122), raw - 96, 0)


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """27 x 27 x 27 counts over every character of every document; each task hands on one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, dtype=np.int64)
        for batch in batches:
            code = letter_codes(" " + "  ".join(batch["text"].to_pylist()) + " ").astype(np.int64)
            # a run of gaps counts once
            code = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]
            code = np.concatenate([[0], code])
            total += np.bincount(code[:-2] * 729 + code[1:-1] * 27 + code[2:], minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, type=pa.int32()), pa.array(total[at])], names=["gram", "n"])

    out = np.zeros(27**3)
    # at most 27^3 sums
    for r in map_arrow(docs.select(text_or_empty("text").alias("text")), run, "gram int, n long", text="text").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out.reshape(27, 27, 27)


class Decoder:
    """restore(text): the text with its suspicious spans decoded."""

    def __init__(self, counts: np.ndarray):
        smooth = counts + 0.5 * (counts.sum(axis=0, keepdims=True) + 1) / (counts.sum() + 27)
        self.log = np.log(smooth / smooth.sum(axis=2, keepdims=True)).tolist()
        self.known: dict[tuple[str, bool], list[tuple[str, int, float]]] = {}
        self.kept: dict[str, str] = {}
        self.pieces: dict[str, str] = {}

    def options(self, c: str, again: bool) -> list[tuple[str, int, float]]:
        """The letters that a character may stand for ('' is nothing) with their codes and channel costs."""
        found: list[tuple[str, float]]
        if c in LOOKS:
            found = [(x, SWAP) for x in LOOKS[c]] + [("", DROP if c.isalnum() else DROP / 4)]
        elif c in SEPARATORS or not c.isalpha():
            found = [("", APART)]
        else:
            found = [(c, STAY), ("", SHRINK)] if again else [(c, 0.0)]
        return [(x, int(letter_codes(x)[0]) if x else 0, cost) for x, cost in found]

    def lattice(self, span: str) -> Iterator[list[tuple[str, int, float]]]:
        before = ""
        for c in span:
            key = (c, c == before)
            if key not in self.known:
                self.known[key] = self.options(*key)
            before = c
            yield self.known[key]

    def decode(self, span: str) -> str:
        """Viterbi over the lattice; states are the last two letters, and each points back to the letters before."""
        log = self.log
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in self.lattice(span.lower()):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, back) in states.items():
                row = log[a][b]
                for letter, c, cost in options:
                    if letter:
                        to, got, link = (b, c), score + cost + row[c], (back, letter)
                    else:
                        to, got, link = (a, b), score + cost, back
                    if to not in after or got > after[to][0]:
                        after[to] = (got, link)
            states = after
        back, out = max(((score + log[a][b][0], k, back) for k, ((a, b), (score, back)) in enumerate(states.items())), key=lambda x: (x[0], -x[1]))[2], []
        while back is not None:
            back, letter = back
            out.append(letter)
        return "".join(reversed(out))

    def span(self, span: str) -> str:
        got = self.kept.get(span)
        if got is None:
            bounded(self.kept, MAX_KEPT)
            at = len(span) - len(span.lstrip(_EDGE))
            end = max(at, len(span.rstrip(_EDGE)))
            while end - at > 1 and span[end - 1] in "$!+|" and (span[end - 1] == span[end - 2] or span[end - 1] == "!"):
                end -= 1
                while end > at and span[end - 1] in _EDGE:
                    end -= 1
            core = span[at:end]
            mixed = any(c.isalpha() for c in core) and (any(c in LOOKS or c in SEPARATORS for c in core) or _STRETCHED.search(core))
            got = span[:at] + self.decode(core) + " " + span[end:] if mixed else span
            self.kept[span] = got
        return got

    def piece(self, text: str) -> str:
        take = lambda m: self.span(m[0])
        return _STRETCHED.sub(take, _MIXED.sub(take, _SPACED.sub(self.apart, text)))

    def restore_all(self, texts: list[str]) -> list[str]:
        """The texts with their suspicious pieces decoded."""
        if not texts:
            return []
        one, cp, kind = joined(texts)
        begin, end = suspicious(cp, kind)
        out, grown, last = [], [0], 0
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            text = one[b:e]
            got = self.pieces.get(text)
            if got is None:
                bounded(self.pieces, MAX_KEPT)
                got = self.pieces[text] = self.piece(text)
            out += (one[last:b], got)
            grown.append(grown[-1] + len(got) - len(text))
            last = e
        new = "".join([*out, one[last:]])
        # each text ends where it did, moved by what the pieces before have grown
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
        moved = (ends + np.array(grown)[np.searchsorted(begin, ends, side="left")]).tolist()
        return [new[a : b - 1] for a, b in zip([0, *moved[:-1]], moved, strict=True)]

    def restore(self, text: str) -> str:
        return self.restore_all([text])[0]

    def apart(self, m: re.Match) -> str:
        """A word of letters set apart; as a word of one letter may stand beside it, also without its first and its last."""
        got = self.span(m[0]).strip()
        return f"{got} {got[1:]} {got[:-1]} {got[1:-1]}" if " " not in got else got


class Restored:
    """Features of restored texts: words, pairs and beginnings of words, without repeated letters."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.decoder: Decoder | None = None

    def __getstate__(self) -> dict:
        return {"counts": self.counts, "decoder": None}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.decoder = self.decoder or Decoder(self.counts)
        w = words(self.decoder.restore_all(texts), squeeze=True)
        one = w.names()
        same_doc = w.doc[1:] == w.doc[:-1]
        two = mix(one[:-1][same_doc] * np.uint64(0x9E3779B97F4A7C15) + one[1:][same_doc])
        names, docs = [mix(one), two], [w.doc, w.doc[1:][same_doc]]
        for n in (4, 5, 6):
            long = w.size > n
            names.append(mix(w.names(n)[long] + np.uint64(n)))
            docs.append(w.doc[long])
        return linear.gather(np.concatenate(docs), np.concatenate(names))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, max_train: int = linear.MAX_TRAIN) -> tuple[linear.Model | None, Restored]:
    features = Restored(count_trigrams(docs))
    return linear.fit(docs, labels, "toxic", features, ~held_out(F.col("doc_id")), max_train), features


def score(docs: DataFrame, labels: DataFrame, max_train: int = linear.MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    model, features = fit(docs, labels, max_train)
    scored = linear.score(docs, model, features, 0.0)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_train: int = linear.MAX_TRAIN) -> DataFrame:
    """The rows of docs that are predicted 0, with all their columns."""
    model, features = fit(docs, labels, max_train)
    return linear.keep(docs, model, features, lambda s: s < THRESHOLD)
