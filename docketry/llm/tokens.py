"""The ids that the tokenizers library gives, at corpus speed.

A batch of texts becomes one array of code points. Their classes (letter, number, white
space, other) mark where pretokens begin. A hash of 64 bits groups equal pretokens, every
member of a group is compared with its first one character by character, and those that differ are
taken by themselves. Each distinct pretoken is merged once a worker by RankArray; the bounded cache is
keyed by the pretokens themselves. Texts are split at special tokens. Tests hold all of this
against the library.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from docketry.llm.common import env_single_thread
from docketry.llm.rank_array import RankArray
from docketry.llm.segments import BLANK, END, LETTER, NUMBER, SPACE, hashes, joined

#: Distinct pretokens that a worker keeps, about 250 bytes each.
MAX_KEPT = 700_000
#: Code points that are taken at once.
BATCH_CHARS = 2_000_000
#: Contractions that both pretokenizers split off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


class Tokenizer:
    """encode(texts): for each text the array of its ids."""

    def __init__(self, path: str, keeps_space: bool):
        env_single_thread()
        from tokenizers import Tokenizer as Library

        self.specials = {t.content: i for i, t in Library.from_file(path).get_added_tokens_decoder().items()}
        #: Cuts a text at special tokens; they stand at the odd places of what it gives.
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.ranks = RankArray(path)
        self.keeps_space = keeps_space
        self.known: dict[str, bytes] = {}

    def normalised(self, text: str) -> str:
        if self.keeps_space or text.isascii():
            return text if self.keeps_space else text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()

    def starts(self, cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where pretokens begin. With keeps_space a run of white space before a text goes on is cut before its last
        character, and a last blank belongs to what follows; else each number stands alone."""
        begin = np.ones(len(cp), dtype=bool)
        begin[1:] = kind[1:] != kind[:-1]
        end = np.flatnonzero(kind == END)
        begin[end[end + 1 < len(cp)] + 1] = True
        if self.keeps_space:
            white = (kind == BLANK) | (kind == SPACE)
            begin[1:][white[1:] & white[:-1]] = False
            last = np.flatnonzero(white[:-1] & ~white[1:])
            last = last[kind[last + 1] != END]
            begin[last] = True
            begin[last[kind[last] == BLANK] + 1] = False
        else:
            begin[kind == NUMBER] = True
        mark = np.flatnonzero(cp == 0x27)
        if len(mark):
            free = np.array([LETTER, NUMBER, SPACE, END] + [BLANK] * (not self.keeps_space))
            mark = mark[(mark == 0) | np.isin(kind[mark - 1], free)]
            padded = np.concatenate([cp, np.zeros(3, dtype=cp.dtype)])
            for c in CONTRACTIONS:
                here = mark[np.all([padded[mark + 1 + i] == ord(x) for i, x in enumerate(c[1:])], axis=0)]
                begin[here + 1] = False
                begin[here + len(c)] = True
                mark = np.setdiff1d(mark, here)
        return np.flatnonzero(begin)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts, whole = [], []
        for i, text in enumerate(texts):
            if any(t in text for t in self.specials):
                parts += self.cut.split(text)
                whole += [i] * (len(parts) - len(whole))
            else:
                parts.append(text)
                whole.append(i)
        if len(parts) == len(texts):
            return self._plain(parts)
        ids = self._plain(["" if k and i == whole[k - 1] and t in self.specials else t for k, (t, i) in enumerate(zip(parts, whole, strict=True))])
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for k, (text, i, own) in enumerate(zip(parts, whole, ids, strict=True)):
            special = k and i == whole[k - 1] and text in self.specials
            out[i].append(np.array([self.specials[text]], dtype="<u4") if special else own)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts without special tokens."""
        out: list[np.ndarray] = []
        first = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= BATCH_CHARS:
                out += self._group(texts[first : i + 1])
                first, size = i + 1, 0
        return out + self._group(texts[first:])

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        one, cp, kind = joined(list(map(self.normalised, texts)))
        begin = self.starts(cp, kind)
        size = np.diff(begin, append=len(cp))
        first = kind[begin]
        is_end = first == END
        void = is_end if self.keeps_space else is_end | (first == BLANK) | (first == SPACE)
        words, inverse = distinct(one, cp, begin, size, ~void)
        found = list(map(self.known.get, words))
        found[0] = b""
        need = [i for i, x in enumerate(found) if x is None]
        if need:
            ids = self.ranks.encode([words[i].encode() for i in need])
            for i, x in zip(need, ids, strict=True):
                found[i] = x
            if len(self.known) + len(need) > MAX_KEPT:
                self.known.clear()
            self.known.update((words[i], x) for i, x in zip(need, ids, strict=True) if len(x) <= 256)
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        offsets = np.cumsum(counts) - counts
        n = counts[inverse]
        ends = np.cumsum(n)
        total = int(ends[-1])
        take = np.arange(total) + np.repeat(offsets[inverse] - (ends - n), n)
        ids = flat[take]
        cut = ends[is_end]
        return np.split(ids, cut[:-1])


def distinct(one: str, cp: np.ndarray, begin: np.ndarray, size: np.ndarray, real: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The different runs that are real, after an empty one for those that aren't, and the place of each run among them.

    Runs are grouped by hash and then compared with the first of their group; those that differ are grouped by their text."""
    name = hashes(cp, begin, size)
    name[~real] = 0
    _, at, inverse = np.unique(name[real], return_index=True, return_inverse=True)
    at = np.flatnonzero(real)[at]
    words = ["", *[one[b:e] for b, e in zip(begin[at].tolist(), (begin[at] + size[at]).tolist(), strict=True)]]
    out = np.zeros(len(begin), dtype=np.int64)
    out[real] = inverse + 1
    model = np.arange(len(begin))
    model[real] = at[inverse]
    other = size[model] != size
    model[other] = np.flatnonzero(other)
    unlike = cp != cp[np.arange(len(cp)) + np.repeat(begin[model] - begin, size)]
    if unlike.any():
        other |= np.logical_or.reduceat(unlike, begin)
    if other.any():
        more: dict[str, int] = {}
        for i in np.flatnonzero(other).tolist():
            out[i] = more.setdefault(one[begin[i] : begin[i] + size[i]], len(words) + len(more))
        words += more
    return words, out


_made: dict[tuple, Tokenizer] = {}


def byte_tokenizer(path: str) -> Tokenizer:
    """byte_bpe files: a pretoken may begin with one space, and white space is kept."""
    if ("byte", path) not in _made:
        _made["byte", path] = Tokenizer(path, True)
    return _made["byte", path]


def word_tokenizer(path: str) -> Tokenizer:
    """word_bpe files: NFC, lower case, white space dropped, words end with a mark."""
    if ("word", path) not in _made:
        _made["word", path] = Tokenizer(path, False)
    return _made["word", path]
