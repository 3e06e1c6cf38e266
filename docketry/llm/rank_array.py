"""Byte-pair merges by a contiguous rank array, for many short words at once.

A word is a row of parts beside a row of the ranks of its adjacent pairs. Each round scans
the ranks for the leftmost minimum, deletes the boundary there and refreshes the ranks of
the two pairs that touch the new part. Words of one length share a matrix, and as every
word that is still merging loses one boundary a round, the matrix stays rectangular. Words
of over LONG bytes would make the scan quadratic and use a heap over linked parts instead.
"""

from __future__ import annotations

import heapq
import json

import numpy as np

LONG = 96
ROWS = 8192
_NONE = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class RankArray:
    """encode(words): for each word of bytes its ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.vocab_size = max(vocab.values()) + 1
        self.base = np.array([vocab[c] for c in alphabet], dtype=np.uint32)
        self.last = np.array([vocab[c + end] for c in alphabet], dtype=np.uint32)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.uint32)
        keys = np.array([(vocab[a] << 16) | vocab[b] for a, b in merges], dtype=np.uint32)
        self.ranks = {int(k): r for r, k in reversed(list(enumerate(keys.tolist())))}
        self._table(keys)
        #: The bytes that each id stands for; special tokens are not among them.
        self.bytes = {i: bytes(back[c] for c in t.removesuffix(end)) for t, i in vocab.items() if all(c in back for c in t)}

    def _table(self, keys: np.ndarray) -> None:
        """An open-addressed table of pair to rank; steps is the longest probe."""
        self.bits = max(16, int(len(keys) * 16).bit_length())
        size = 1 << self.bits
        self.slots = np.zeros(size + 64, dtype=np.uint32)
        self.slot_rank = np.full(size + 64, _NONE, dtype=np.int32)
        self.steps = 0
        for r, k in enumerate(keys.tolist()):
            at = ((k * 2654435769) & 0xFFFFFFFF) >> (32 - self.bits)
            n = 0
            while self.slot_rank[at + n] != _NONE:
                n += 1
            self.slots[at + n], self.slot_rank[at + n] = k, r
            self.steps = max(self.steps, n)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << np.uint32(16)) | right
        at = ((key * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)
        out = self.slot_rank[at]
        wrong = np.flatnonzero((self.slots[at] != key) & (out != _NONE))
        for step in range(1, self.steps + 2):
            if not len(wrong):
                break
            to = at[wrong] + step
            found = self.slot_rank[to]
            out[wrong] = found
            wrong = wrong[(self.slots[to] != key[wrong]) & (found != _NONE)]
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, cuts):
            if not len(group) or not (n := int(lengths[group[0]])):
                continue
            if n > LONG:
                for i in group.tolist():
                    out[i] = self.merge_long(words[i])
                continue
            for at in range(0, len(group), ROWS):
                self._rows(words, group[at : at + ROWS].tolist(), n, out)
        return out

    def _rows(self, words: list[bytes], ids: list[int], n: int, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join([words[i] for i in ids]), dtype=np.uint8).reshape(-1, n)
        parts = self.base[raw]
        parts[:, -1] = self.last[raw[:, -1]]
        rows = np.array(ids)
        ranks = self.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(ids), n - 1)
        while True:
            width = parts.shape[1]
            if width > 1:
                low = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), low]
                done = best == _NONE
            else:
                done = np.ones(len(rows), dtype=bool)
            if done.any():
                packed, step = np.ascontiguousarray(parts[done], dtype="<u4").tobytes(), 4 * width
                for k, i in enumerate(rows[done].tolist()):
                    out[i] = packed[k * step : k * step + step]
                going = ~done
                if not going.any():
                    return
                parts, ranks, rows, low, best = parts[going], ranks[going], rows[going], low[going], best[going]
            line = np.arange(len(rows))
            parts[line, low] = self.made[best]
            keep = np.ones(parts.shape, dtype=bool)
            keep[line, low + 1] = False
            parts = parts[keep].reshape(len(rows), width - 1)
            keep = np.ones(ranks.shape, dtype=bool)
            keep[line, low] = False
            ranks = ranks[keep].reshape(len(rows), width - 2)
            at = np.flatnonzero(low > 0)
            ranks[at, low[at] - 1] = self.rank(parts[at, low[at] - 1], parts[at, low[at]])
            at = np.flatnonzero(low < width - 2)
            ranks[at, low[at]] = self.rank(parts[at, low[at]], parts[at, low[at] + 1])

    def merge_long(self, word: bytes) -> bytes:
        parts = [int(self.base[b]) for b in word[:-1]] + [int(self.last[word[-1]])]
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        of = lambda i: self.ranks.get((parts[i] << 16) | parts[after[i]]) if after[i] >= 0 else None
        heap = [(r, i) for i in range(n - 1) if (r := of(i)) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            r, i = heapq.heappop(heap)
            if gone[i] or of(i) != r:
                continue
            j = after[i]
            parts[i], gone[j], after[i] = int(self.made[r]), 1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (k := of(i)) is not None:
                    heapq.heappush(heap, (k, i))
            if before[i] >= 0 and (k := of(before[i])) is not None:
                heapq.heappush(heap, (k, before[i]))
        return np.array([p for i, p in enumerate(parts) if not gone[i]], dtype="<u4").tobytes()
