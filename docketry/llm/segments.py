"""Words of whole batches of texts as arrays: classes of code points, runs, and 64-bit hashes."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np

#: Stands between the texts of a batch; where it is, is known by place, so a text may hold it too.
SEPARATOR = "\x1c"
OTHER, LETTER, NUMBER, BLANK, SPACE, END = range(6)
#: The White_Space characters of Unicode besides U+0020.
SPACES = "\t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_STEP = 0x9E3779B97F4A7C15
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _classes:
        of = {"L": LETTER, "N": NUMBER}
        lut = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
        lut[[ord(c) for c in SPACES]] = SPACE
        lut[0x20] = BLANK
        _classes.append(lut)
    return _classes[0]


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _STEP, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def joined(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one, each followed by SEPARATOR; its code points, and their classes with END after each text."""
    one = SEPARATOR.join(texts) + SEPARATOR
    cp = np.frombuffer(one.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = classes()[cp]
    kind[np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) - 1] = END
    return one, cp, kind


def hashes(cp: np.ndarray, begin: np.ndarray, size: np.ndarray, upto: int | None = None) -> np.ndarray:
    """A hash of each run of code points, or of its first ``upto`` ones: the sum of the mixed hashes of (place, code point)."""
    place = np.arange(len(cp), dtype=np.int64) - np.repeat(begin, size)
    value = mix(cp * np.uint64(0xD6E8FEB86659FD93) + powers(int(size.max(initial=1)))[place])
    if upto is not None:
        value[place >= upto] = 0
    total = np.add.reduceat(value, begin) if len(begin) else np.zeros(0, dtype=np.uint64)
    return mix(total) + (size if upto is None else np.minimum(size, upto)).astype(np.uint64)


@dataclass
class Words:
    """cp: code points; begin, size: the words; doc: the text of each word, ascending; n: how many texts."""

    cp: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    n: int

    def names(self, upto: int | None = None) -> np.ndarray:
        begin, size, keep = self._whole
        return hashes(self.cp, begin, size, upto)[keep]

    _whole: tuple = ()


def words(texts: list[str], marks_apart: bool = True, squeeze: bool = False) -> Words:
    """Lower-cased words. marks_apart: runs of letters, of numbers and of marks are words, else what stands between white space.
    squeeze: a letter that repeats the one before it is left out."""
    _, cp, kind = joined([t.lower().replace(SEPARATOR, " ") for t in texts])
    if squeeze:
        keep = np.ones(len(cp), dtype=bool)
        keep[1:] = (cp[1:] != cp[:-1]) | (kind[1:] != LETTER)
        cp, kind = cp[keep], kind[keep]
    kind = np.where(kind == SPACE, BLANK, kind)
    if not marks_apart:
        kind = np.where(kind < BLANK, LETTER, kind)
    start = np.ones(len(cp), dtype=bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == END)
    begin = np.flatnonzero(start)
    size = np.diff(begin, append=len(cp))
    first = kind[begin]
    doc = np.cumsum(first == END) - (first == END)
    keep = first < BLANK
    out = Words(cp, begin[keep], size[keep], doc[keep], len(texts))
    out._whole = (begin, size, keep)
    return out
