"""Lexical search by covers and trigrams, against brute force in Python."""

import itertools
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.operators import lexical, search
from docketry.plans import registry
from docketry.plans import search as plans

SF = "/root/testdata/sf0.001"


def words(t):
    return [w for w in re.split("[^a-z0-9]+", (t or "").lower().replace("&", " and ")) if w]


def grams(t):
    return {f"  {w} "[i : i + 3] for w in words(t) for i in range(len(w) + 1)}


def holds(atom, said, i, j):
    """Whether the words from i to j hold the atom."""
    return any(tuple(said[p : p + len(atom)]) == atom for p in range(i, j - len(atom) + 2))


def density(groups, said, weights):
    """All intervals that hold a group of the unit and no smaller one that does, by trying each; None without a match."""
    n = len(said)
    own = [g for g in groups if all(holds(a, said, 0, n - 1) for a in g[0]) and not any(holds(a, said, 0, n - 1) for a in g[1])]
    if not own:
        return None
    good = {(i, j) for i in range(n) for j in range(i, n) if any(all(holds(a, said, i, j) for a in g[0]) for g in own)}
    asked = {w for g in own for a in g[0] for w in a}
    total = 0
    for i, j in good:
        if not any((x, y) in good for x in range(i, j + 1) for y in range(x, j + 1) if (x, y) != (i, j)):
            at = [weights[p] for p in range(i, j + 1) if said[p] in asked]
            total += len(at) / sum(1 / w for w in at) / (1 + (j - i + 1 - len(at)))
    return total


def brute(query, groups, rows, share=0.2):
    """rows: unit, text; the score of each unit that is found."""
    out = {}
    for unit, t in rows:
        said, asked, own = words(t), grams(query), grams(t)
        dense = density(groups, said, [1.0] * len(said))
        alike = len(asked & own) / len(asked | own) if asked | own else 0
        if dense is not None or alike >= 0.05:
            out[unit] = round((1 - share) * (dense or 0) + share * alike, 6)
    return out


def close(got, want):
    return got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def all_of(query):
    return [([(w,) for w in words(query)], [])] if words(query) else []


@pytest.mark.parametrize(("query", "groups"), [
    ("Penalty imposed", [(["penalty", "imposed"], [])]), ('"show cause" notice', [(["show cause", "notice"], [])]), ("a or b c OR d", [(["a"], []), (["b", "c"], []), (["d"], [])]),
    ("order -interim -\"ex parte\"", [(["order"], ["interim", "ex parte"])]), ("insider-trading R&D", [(["insider trading", "r and d"], [])]), ("or or", []), ("-only", []), (None, []), ('"unclosed words', [(["unclosed", "words"], [])]), ('"" x x', [(["x"], [])]),
])
def test_grammar(query, groups):
    assert [([" ".join(a) for a in g.wanted], [" ".join(a) for a in g.unwanted]) for g in lexical.parse(query)] == groups


SIGNS = st.sampled_from(["a", "b", "c", "d", "x", "y"])
ATOMS = st.lists(st.lists(SIGNS, min_size=1, max_size=2).map(tuple), min_size=1, max_size=3, unique=True)


@settings(max_examples=400, deadline=None)
@given(st.lists(SIGNS, max_size=12), st.lists(SIGNS, max_size=6), st.lists(st.tuples(ATOMS, st.lists(SIGNS.map(lambda w: (w,)), max_size=1)), min_size=1, max_size=3))
def test_covers(first, second, groups):
    places = {}
    for p, w in enumerate(first):
        places.setdefault(w, []).append(p)
    for p, w in enumerate(second, len(first) + 1):
        places.setdefault(w, []).append(p)
    said = [*first, "|", *second]
    weights = [1.0] * (len(first) + 1) + [0.4] * len(second)
    got = lexical.cover_density([lexical.Group(tuple(a), tuple(b)) for a, b in groups], places, lambda p: weights[p])
    want = density(groups, said, weights)
    assert (got is None) == (want is None) and (got is None or abs(got - want) < 1e-9)


def test_covers_by_hand():
    near, far = "penalty was imposed".split(), "penalty a b c d e imposed".split()
    score = lambda said: lexical.cover_density(lexical.parse("penalty imposed"), {w: [i for i, x in enumerate(said) if x == w] for w in said}, lambda p: 0.4)
    assert score(near) == pytest.approx(0.4 / 2) and score(far) == pytest.approx(0.4 / 6)
    # covers overlap: penalty imposed, imposed penalty
    assert score("penalty imposed penalty".split()) == pytest.approx(0.8)


def test_misspelt_and_joined_words_are_found(spark):
    rows = [(1, "penalty imposed"), (2, "penalti imposd"), (3, "insidertrading"), (4, "zebra"), (5, None), (6, ""), (7, "imposed and then again a penalty"), (7, "imposed and then again a penalty")]
    units = spark.createDataFrame(rows, "unit long, body string").repartition(3)
    asked = ((1, "penalty imposed"), (2, "insider trading"), (3, ""), (4, '"penalty imposed" or again -imposed'))
    queries = spark.createDataFrame(asked, "query_id int, query string")
    groups = {1: all_of(asked[0][1]), 2: all_of(asked[1][1]), 3: [], 4: [([("penalty", "imposed")], []), ([("again",)], [("imposed",)])]}
    for share in (0.2, 0.15):
        got = search.lexical(queries, units, {"body": 1.0}, ["body"], 10, share).collect()
        for q, query in asked:
            assert close({r.unit: r.score for r in got if r.query_id == q}, brute(query, groups[q], rows, share))
            assert sorted(r["rank"] for r in got if r.query_id == q) == list(range(1, 1 + len([r for r in got if r.query_id == q])))
    assert search.lexical(queries.limit(0), units, {"body": 1.0}, ["body"], 10).collect() == [] == search.lexical(queries, units.limit(0), {"body": 1.0}, ["body"], 10).collect()


def test_fields_have_weights_and_a_scope(spark):
    units = spark.createDataFrame([(1, "alpha", "beta"), (2, "beta", "alpha"), (3, None, "alpha beta"), (4, "x", "zzz")], "unit long, title string, body string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, '"alpha beta"')], "query_id int, query string")
    found = search.lexical(queries, units, {"title": 1.0, "body": 0.4}, [], 5).collect()
    mean = 2 / (1 + 1 / 0.4) / 2  # a position between the fields
    assert {(r.query_id, r.unit): r.score for r in found} == {(1, 1): round(0.8 * mean, 6), (1, 2): round(0.8 * mean, 6), (1, 3): 0.32, (2, 3): 0.32}
    scope = spark.createDataFrame([(1, 2), (2, 3), (2, 1)], "query_id int, unit long")
    assert {(r.query_id, r.unit) for r in search.lexical(queries, units, {"title": 1.0, "body": 0.4}, ["body"], 5, scope=scope).collect()} == {(1, 2), (2, 3), (2, 1)}


def test_lexical_search_over_every_document(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    places = lambda t: {w: [i for i, x in enumerate(words(t)) if x == w] for w in set(words(t)) & set(words(plans.QUESTION))}
    scores = {}
    for unit, t in rows:
        found, own, asked = places(t), grams(t), grams(plans.QUESTION)
        dense = None
        if found.keys() == set(words(plans.QUESTION)):
            at, dense = sorted(itertools.chain(*found.values())), 0
            spans = {(max(q for q in [min(max([p for p in ps if p <= e], default=-1) for ps in found.values())]), e) for e in at}
            spans = {(b, e) for b, e in spans if b >= 0 and not any(x >= b and y < e or x > b and y <= e for x, y in spans)}
            for b, e in spans:
                n = sum(b <= p <= e for p in at)
                dense += 1 / (1 + e - b + 1 - n)
        alike = len(asked & own) / len(asked | own)
        if dense is not None or alike >= 0.05:
            scores[unit] = round(0.8 * (dense or 0) + 0.2 * alike, 6)
    got = {r.unit: r.score for r in registry.QUERIES["lexical_search"](spark, SF).collect()}
    best = sorted(scores, key=lambda u: (-scores[u], u))[:30]
    assert close(got, {u: scores[u] for u in best})


def test_phrase_search_over_every_document(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    got = {}
    for r in registry.QUERIES["phrase_search"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r.unit] = r.score
    said = {d: words(t) for d, t in rows}
    own = {d: grams(t) for d, t in rows}
    assert len(got) == len(items)
    for item, t in items[::7]:
        w = words(t)
        groups = [([(w[1], w[2]), (w[3],)], []), ([(w[0],)], [(w[-1],)]), ([(w[4], w[5])], [])]
        asked = grams(" ".join([w[1], w[2], w[3], "or", w[0], w[-1], "or", w[4], w[5]]))
        scores = {}
        for d, x in said.items():
            alike = len(asked & own[d]) / len(asked | own[d]) if asked | own[d] else 0
            # only the words of the query matter for matches and covers: others are kept as places
            names = {a for g in groups for atom in (*g[0], *g[1]) for a in atom}
            dense = density_of_places(groups, x, names)
            if dense is not None or alike >= 0.05:
                scores[d] = round(0.8 * (dense or 0) + 0.2 * alike, 6)
        best = sorted(scores, key=lambda u: (-scores[u], u))[:10]
        assert close(got[item], {u: scores[u] for u in best}), item


def density_of_places(groups, said, names):
    """density() for long texts: only intervals between places of the query's words are tried."""
    at = [i for i, w in enumerate(said) if w in names]
    n = len(said)
    spots = {a: [p for p in at if tuple(said[p : p + len(a)]) == a] for g in groups for a in (*g[0], *g[1])}
    own = [g for g in groups if all(spots[a] for a in g[0]) and not any(spots[a] for a in g[1])]
    if not own:
        return None
    asked = {w for g in own for a in g[0] for w in a}
    at = [p for p in at if said[p] in asked]
    covers = set()
    for e in at:
        best = -1
        for g in own:
            starts = [max((p for p in spots[a] if p + len(a) - 1 <= e), default=-1) for a in g[0]]
            best = max(best, min(starts))
        if best >= 0:
            covers.add((best, e))
    covers = {(b, e) for b, e in covers if not any((x, y) != (b, e) and x >= b and y <= e for x, y in covers)}
    return sum(1 / (1 + e - b + 1 - sum(b <= p <= e for p in at)) for b, e in covers) if n else None
