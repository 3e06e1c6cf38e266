"""Full-text search: a grammar of queries, cover density over positions, and trigram similarity, in one pass over the units.

Queries are parsed once and go to the tasks in blocks; a task reads its units where they lie and hands on the k best units of each
query, so that no postings are shuffled and a corpus is read once for a block of queries."""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Queries that go to the tasks at once.
QUERY_BLOCK = 1024
#: The similarity from which a unit that doesn't match the query is found.
ADMITTED = 0.05
#: Words whose trigrams a task keeps.
_KEPT_WORDS = 200_000

_WORD = re.compile("[a-z0-9]+")
_PIECE = re.compile(r'(-?)(?:"([^"]*)"|(\S+))')
Atom = tuple[str, ...]


def words(text: str | None) -> list[str]:
    """The same words as functions.text.tokens()."""
    return _WORD.findall((text or "").lower().replace("&", " and "))


def trigrams(word: str) -> list[str]:
    padded = f"  {word} "
    return [padded[i : i + 3] for i in range(len(word) + 1)]


@dataclass(frozen=True)
class Group:
    """Atoms (a word, or words next to each other) that a unit must and must not have."""

    wanted: tuple[Atom, ...]
    unwanted: tuple[Atom, ...] = ()


def parse(query: str | None) -> list[Group]:
    """Words must all be there; "words in quotes" or joined by signs next to each other; or between alternatives; - before what must not
    be there. An alternative of unwanted words alone finds nothing."""
    groups: list[tuple[list, list]] = [([], [])]
    for minus, quoted, piece in _PIECE.findall(query or ""):
        if not minus and piece.lower() == "or":
            groups.append(([], []))
        elif atom := tuple(words(quoted or piece)):
            groups[-1][bool(minus)].append(atom)
    return [Group(tuple(dict.fromkeys(a)), tuple(dict.fromkeys(b))) for a, b in groups if a]


def occurrences(atom: Atom, places: dict[str, list[int]]) -> list[tuple[int, int]]:
    """First and last position of each place where the atom stands."""
    starts = places.get(atom[0], [])
    if len(atom) == 1:
        return [(p, p) for p in starts]
    rest = [set(places.get(w, ())) for w in atom[1:]]
    return [(p, p + len(rest)) for p in starts if all(p + i in s for i, s in enumerate(rest, 1))]


def cover_density(groups: Iterable[Group], places: dict[str, list[int]], weight_of) -> float | None:
    """None if no group matches; else the sum over covers, the intervals that hold a matching group and no smaller one that does.

    A cover counts the harmonic mean of the weights of the query's words in it, over one and the number of its other words.
    The sweep goes through the atoms by their ends: what covers end there starts at the earliest of the latest starts of a group's atoms."""
    matching, found = [], {}
    for group in groups:
        for atom in (*group.wanted, *group.unwanted):
            if atom not in found:
                found[atom] = occurrences(atom, places)
        if all(found[a] for a in group.wanted) and not any(found[a] for a in group.unwanted):
            matching.append(group)
    if not matching:
        return None
    atoms = {a for g in matching for a in g.wanted}
    if len(atoms) == 1 and len(word := next(iter(atoms))) == 1:
        # one word: each place of it is a cover
        return float(sum(map(weight_of, places[word[0]])))
    at = sorted({p for a in atoms for w in a for p in places[w]})
    inverse = [0.0]
    for p in at:
        inverse.append(inverse[-1] + 1 / weight_of(p))
    ends: dict[int, list[tuple[Atom, int]]] = {}
    for atom in atoms:
        for start, end in found[atom]:
            ends.setdefault(end, []).append((atom, start))
    latest: dict[Atom, int] = {}
    total, before = 0.0, -1
    for end in sorted(ends):
        latest.update(ends[end])
        begin = max((min(latest[a] for a in g.wanted) for g in matching if all(a in latest for a in g.wanted)), default=-1)
        if begin > before:
            before = begin
            i, j = bisect_left(at, begin), bisect_right(at, end)
            total += (j - i) / (inverse[j] - inverse[i]) / (1 + end - begin + 1 - (j - i))
    return total


@dataclass
class Block:
    """Parsed queries, with what a unit's words and trigrams lead to."""

    names: list
    groups: list[list[Group]]
    by_word: dict[str, list[int]] = field(default_factory=dict)
    vocabulary: set[str] = field(default_factory=set)
    #: for each group of a query the words and the neighbours in phrases that a unit must have, and the words that it must not have
    needed: list[list[tuple[frozenset[str], frozenset[tuple[str, str]], frozenset[str]]]] = field(default_factory=list)
    #: neighbours in the phrases of all queries
    neighbours: set[tuple[str, str]] = field(default_factory=set)
    #: trigrams by their place, and of which queries each is one
    grams: dict[str, int] = field(default_factory=dict)
    of_gram: list[list[int]] = field(default_factory=list)
    asked: np.ndarray | None = None
    _table: np.ndarray | None = None

    @classmethod
    def of(cls, queries: list[Row]) -> Block:
        out = cls([q["query_id"] for q in queries], [parse(q["query"]) for q in queries])
        sizes = []
        for k, (query, groups) in enumerate(zip(queries, out.groups, strict=True)):
            out.needed.append([(frozenset(w for a in g.wanted for w in a), frozenset(p for a in g.wanted for p in pairwise(a)), frozenset(a[0] for a in g.unwanted if len(a) == 1)) for g in groups])
            out.neighbours.update(p for _, pairs, _ in out.needed[-1] for p in pairs)
            for g in groups:
                out.vocabulary.update(w for atom in (*g.wanted, *g.unwanted) for w in atom)
                # every unit that matches the group has this word
                out.by_word.setdefault(max(g.wanted[0], key=len), []).append(k)
            own = {t for w in set(words(query["query"])) for t in trigrams(w)}
            sizes.append(len(own))
            for t in own:
                if t not in out.grams:
                    out.grams[t] = len(out.grams)
                    out.of_gram.append([])
                out.of_gram[out.grams[t]].append(k)
        out.asked = np.array(sizes)
        return out

    def similarity(self, grams: set[str]) -> np.ndarray:
        """Shared trigrams among all of each query and a field with these."""
        if self._table is None:  # made in the task
            self._table = np.zeros((len(self.grams), len(self.names)), dtype=np.uint8)
            for t, queries in enumerate(self.of_gram):
                self._table[t, queries] = 1
        at = [self.grams[t] for t in grams if t in self.grams]
        both = self._table[at].sum(axis=0, dtype=np.int32)
        return both / np.maximum(len(grams) + self.asked - both, 1)

    @staticmethod
    def alone(groups: list[Group]) -> str | None:
        """The word that is all that the groups want, if it is one and no phrase is unwanted: its places are the covers."""
        first = groups[0].wanted[0]
        same = len(first) == 1 and all(g.wanted == (first,) and all(len(a) == 1 for a in g.unwanted) for g in groups)
        return first[0] if same else None

    def scores(self, texts: dict[str, list[str]], weighted: dict[str, float], alike: list[str], share: float, grams_of) -> np.ndarray:
        """The score of a unit for each query, nan where it isn't found."""
        places: dict[str, list[int]] = {}
        starts, weights, offset = [], [], 0
        beside: set[tuple[str, str]] = set()
        for name, weight in weighted.items():
            if self.neighbours:
                beside |= self.neighbours.intersection(pairwise(texts[name]))
            starts.append(offset)
            weights.append(weight)
            for w in self.vocabulary.intersection(texts[name]):
                places.setdefault(w, [])
            for p, w in enumerate(texts[name], offset):
                if w in places:
                    places[w].append(p)
            offset += len(texts[name]) + 1  # no phrase goes on in the next field
        weight_of = lambda p: weights[bisect_right(starts, p) - 1]
        similar = np.zeros(len(self.names))
        for name in alike:
            np.maximum(similar, self.similarity(grams_of(texts[name])), out=similar)
        density = np.full(len(self.names), np.nan)
        single: dict[str, float] = {}
        have = set(places)
        for k in {k for w in have & self.by_word.keys() for k in self.by_word[w]}:
            live = [g for g, (ws, pairs, none) in zip(self.groups[k], self.needed[k], strict=True) if ws <= have and pairs <= beside and have.isdisjoint(none)]
            if not live:
                continue
            alone = self.alone(live)
            if alone is None:
                found = cover_density(live, places, weight_of)
            elif (found := single.get(alone)) is None:
                found = single[alone] = float(sum(map(weight_of, places[alone])))
            if found is not None:
                density[k] = found
        score = np.round((1 - share) * np.nan_to_num(density) + share * similar, 6)
        return np.where(np.isnan(density) & (similar < ADMITTED), np.nan, score)


class Best:
    """The k best distinct units of each query, by score, then unit."""

    def __init__(self, queries: int, k: int):
        self.k, self.bar = k, np.full(queries, -np.inf)
        self.held: list[dict] = [{} for _ in range(queries)]

    def add(self, unit, scores: np.ndarray) -> None:
        """scores: nan for what isn't found."""
        for q in np.flatnonzero(scores >= self.bar).tolist():
            held = self.held[q]
            held[unit] = max(held.get(unit, -np.inf), float(scores[q]))
            if len(held) >= 2 * self.k + 64:
                self.held[q] = dict(self.best(q))
                self.bar[q] = min(self.held[q].values())

    def add_some(self, units: list, queries: np.ndarray, scores: np.ndarray) -> None:
        """scores: [unit, query] for some of the queries."""
        bar, n = self.bar[queries], len(scores)
        if n > self.k:
            bar = np.maximum(bar, np.partition(scores, n - self.k, axis=0)[n - self.k])
        for i, j in np.argwhere(scores >= bar).tolist():
            q, s = int(queries[j]), float(scores[i, j])
            if s < self.bar[q]:
                continue
            held = self.held[q]
            held[units[i]] = max(held.get(units[i], -np.inf), s)
            if len(held) >= 2 * self.k + 64:
                self.held[q] = dict(self.best(q))
                self.bar[q] = min(self.held[q].values())

    def best(self, q: int) -> list[tuple]:
        return [(u, -s) for s, u in heapq.nsmallest(self.k, ((-s, u) for u, s in self.held[q].items()))]

    def rows(self, names: list) -> list[tuple]:
        return [(name, u, s) for q, name in enumerate(names) for u, s in self.best(q)]


def in_scope(units: DataFrame, scope: DataFrame | None) -> DataFrame:
    """The units that a query may find; with scope (query_id, unit) those in it alone, with the queries in a column __asked."""
    if scope is None:
        return units
    return units.join(scope.groupBy("unit").agg(F.collect_set("query_id").alias("__asked")), "unit")


def only(asked: list | None, place: dict) -> np.ndarray | slice:
    return slice(None) if asked is None else np.array([place[a] for a in asked if a in place], dtype=int)


def hits_schema(queries_id: T.StructField, units: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("query_id", queries_id.dataType), units.schema["unit"], T.StructField("score", T.DoubleType())])


def as_batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=f.type) for c, f in enumerate(arrow)], schema=arrow)


def blocks(queries: list[Row]) -> list[list[Row]]:
    return [queries[i : i + QUERY_BLOCK] for i in range(0, len(queries), QUERY_BLOCK)] or [[]]


def search(queries: DataFrame, units: DataFrame, weighted: dict[str, float], alike: list[str], k: int, share: float = 0.2, scope: DataFrame | None = None, held: list[Row] | None = None) -> DataFrame:
    """query_id, unit, score: of each task's units the k best of each query; a unit is found if it matches, or by a similarity of 0.05.

    queries: query_id, query (held: their rows, where they are known). units: unit and text columns. weighted: the weight of words in each
    column, in their order. alike: the columns whose greatest similarity counts. The score is cover density and similarity, weighted 1 - share and share."""
    schema = hits_schema(queries.schema["query_id"], units)
    columns = list(dict.fromkeys([*weighted, *alike]))
    rows = in_scope(units.select("unit", *columns), scope)
    out = None
    for part in blocks(queries.select("query_id", "query").collect() if held is None else held):
        hits = rows.mapInArrow(_task(Block.of(part), columns, weighted, alike, k, share, scope is not None, schema), schema)
        out = hits if out is None else out.unionByName(hits)
    return out


def _task(block: Block, columns: list[str], weighted: dict[str, float], alike: list[str], k: int, share: float, scoped: bool, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, place = Best(len(block.names), k), {n: i for i, n in enumerate(block.names)}
        known: dict[str, list[str]] = {}

        def grams_of(said: list[str]) -> set[str]:
            own = set(said)
            if len(known) > _KEPT_WORDS:
                known.clear()
            for w in own:
                if w not in known:
                    known[w] = trigrams(w)
            return set().union(*map(known.__getitem__, own))

        for batch in batches:
            asked = batch["__asked"] if scoped else None
            for i in range(batch.num_rows if block.names else 0):
                texts = {c: words(batch[c][i].as_py()) for c in columns}
                scores = block.scores(texts, weighted, alike, share, grams_of)
                if scoped:
                    own = np.full(len(scores), np.nan)
                    some = only(asked[i].as_py(), place)
                    own[some] = scores[some]
                    scores = own
                best.add(batch["unit"][i].as_py(), scores)
        yield as_batch(best.rows(block.names), schema)

    return run
