"""The registered search of three levels against brute force in Python over a whole table."""

import math

import duckdb
import numpy as np

from docketry.operators import search, vectors
from docketry.plans import search as plans
from tests.test_similar_words import grams, words

SF = "/root/testdata/sf0.001"
PRIOR = {"operative_order": 1.35, "directions": 1.30, "findings": 1.25, "issues": 1.15, "reply_or_submissions": 1.05, "background": 1.00, "facts": 1.00, "show_cause_notice": 0.98, "other": 0.92, "table_block": 0.90, "annexure": 0.88, "header": 0.70}
SUBSTANTIVE = {"operative_order": 1.20, "directions": 1.18, "findings": 1.15, "issues": 1.08, "reply_or_submissions": 1.03, "background": 0.98, "facts": 0.98, "show_cause_notice": 0.96, "other": 0.92, "table_block": 0.92, "annexure": 0.90, "header": 0.75}


STRONG, NONE = {"operative_order", "findings", "directions"}, {"header", "other", "table_block", "annexure"}


def ranks(scores, k):
    return {u: i + 1 for i, u in enumerate(sorted(scores, key=lambda u: (-scores[u], u))[:k])}


def level(units, weights, alike, k, share, question, vector, parents=None):
    """units: {unit: row}. The fused scores, lexical and vector scores of the units that either side has among its 3k best within the parents' scope."""
    wanted, own = words(question), grams(question)
    lexical, cosine = {}, {}
    for u, r in units.items():
        if parents is not None and u not in parents:
            continue
        said, weight = [], []
        for field, w in weights.items():
            said += [*words(r[field]), "|"]
            weight += [w] * (len(words(r[field])) + 1)
        dense = None
        if set(wanted) <= set(said):
            at = [p for p, w in enumerate(said) if w in wanted]
            ends = {e: min(max((p for p in at if p <= e and said[p] == w), default=-1) for w in wanted) for e in at}
            covers = [(b, e) for e, b in ends.items() if b >= 0 and not any(y < e and x >= b for y, x in ends.items())]
            dense = sum(len(own_) / sum(1 / weight[p] for p in own_) / (1 + e - b + 1 - len(own_)) for b, e in covers for own_ in [[p for p in at if b <= p <= e]])
        similar = max((len(own & grams(r[f])) / len(own | grams(r[f])) for f in alike), default=0)
        if dense is not None or similar >= 0.05:
            lexical[u] = round((1 - share) * (dense or 0) + share * similar, 6)
        if r["embedding"] is not None:
            e = np.array(r["embedding"], dtype=float)
            cosine[u] = round(float(e @ vector / np.linalg.norm(e) / np.linalg.norm(vector)), 6)
    a, b = ranks(lexical, 3 * k), ranks(cosine, 3 * k)
    fused = {}
    for u in {*a, *b}:
        score = (1 / (60 + a[u]) if u in a else 0) + (1.15 / (60 + b[u]) if u in b else 0) + (0.15 * max(parents[u], 0) if parents else 0)
        fused[u] = score, lexical[u] if u in a else 0, cosine[u] if u in b else 0
    return fused


def order(hit, found, units):
    """W14: by score, lexical and vector score, document and unit."""
    return -hit[1], -found[hit[0]][1], -found[hit[0]][2], units[hit[0]].get("document", hit[0]), hit[0]


def by_document(final, units):
    out = {}
    for u, s in final.items():
        out.setdefault(units[u]["document"], {})[u] = s
    return out


def suppressed(final, units):
    """Headers up to a quarter above the best operative, findings or directions hit of their document go just below it."""
    out = dict(final)
    for hits in by_document(final, units).values():
        best = max((s for u, s in hits.items() if units[u]["section"] in STRONG), default=0)
        for u, s in hits.items():
            if units[u]["section"] == "header" and best > 0 and best < s <= 1.25 * best:
                out[u] = round(best * 0.995, 9)
    return out


def diversified(final, found, units):
    out = dict(final)
    for hits in by_document(final, units).values():
        ordered = [u for u, _ in sorted(hits.items(), key=lambda h: order(h, found, units))]
        headers = [u for u in ordered if units[u]["section"] == "header"]
        good = [u for u in ordered if units[u]["section"] not in NONE]
        if headers and good:
            h, s = hits[headers[0]], hits[good[0]]
            if 0 < s < h and s >= 0.93 * h:
                out[good[0]] = round(s + min(h - s + max(0.01 * s, 1e-6), 0.08 * h), 9)
        for k, u in enumerate(headers):
            out[u] = round(hits[u] * (1 - min(0.30, 0.12 * k)), 9)
    return out


def test_hierarchical_search_over_every_document(spark):
    docs, parts, said = ({r["unit"]: r.asDict() for r in df.collect()} for df in plans.hierarchy(spark, SF))
    assert len(docs) == duckdb.sql(f"select count(*) from '{SF}/documents.parquet'").fetchall()[0][0]
    vector = np.array(plans.questions(spark, SF).first()["q"], dtype=float)
    base = lambda r: PRIOR[r["section"]] * SUBSTANTIVE[r["section"]]

    def best(final, found, units, k):
        return {u: final[u] for u, _ in sorted(final.items(), key=lambda h: order(h, found, units))[:k]}

    one = level(docs, {"title": 1.0, "body": 0.4}, ["title", "body"], 5, 0.2, plans.QUESTION, vector)
    one = best({u: round(s[0], 9) for u, s in one.items()}, one, docs, 5)
    scope = {u: one[r["document"]] for u, r in parts.items() if r["document"] in one}
    two = level(parts, {"title": 1.0, "heading": 0.4, "body": 0.2}, ["title", "body"], 8, 0.2, plans.QUESTION, vector, scope)
    two = best(suppressed({u: round(s[0] * base(parts[u]), 9) for u, s in two.items()}, parts), two, parts, 8)
    of_section: dict = {}
    for u, s in two.items():
        key = parts[u]["document"], parts[u]["section_key"]
        of_section[key] = max(of_section.get(key, 0), s)
    keys = {parts[u]["section_key"] for u in two}
    scope = {u: max(one[r["document"]], of_section.get((r["document"], r["section_key"]), 0)) for u, r in said.items() if r["document"] in one and (not keys or r["section_key"] in keys)}
    three = level(said, {"title": 1.0, "body": 0.4}, ["body"], 10, 0.15, plans.QUESTION, vector, scope)
    three = best(diversified(suppressed({u: round(s[0] * base(said[u]), 9) for u, s in three.items()}, said), three, said), three, said, 10)
    got = {r.unit: r.final for r in plans.hierarchical_search(spark, SF).collect()}
    assert len(got) == 10 and got.keys() == three.keys() and all(abs(got[u] - three[u]) < 1e-6 for u in got)


HITS = "document long, unit long, section string, intent string, final double, lexical double, vector double"


def finals(spark, rows, *steps):
    df = spark.createDataFrame([(*r, *[0.0] * (7 - len(r))) for r in rows], HITS)
    for step in steps:
        df = step(df)
    return {r.unit: r.final for r in df.collect()}


def test_headers_against_strong_sections(spark):
    """Only strong sections count, only for substantive questions, and only headers up to a quarter above."""
    s, t = "substantive", "party_or_title"
    rows = [(1, 1, "header", s, 1.0), (1, 2, "table_block", s, 0.9), (1, 3, "findings", s, 0.5), (2, 4, "header", s, 1.0), (2, 5, "directions", s, 0.8), (2, 6, "operative_order", s, 0.7), (3, 7, "header", t, 1.0), (3, 8, "findings", t, 0.9), (4, 9, "header", s, 0.9), (4, 10, "findings", s, 0.9), (5, 11, "header", s, 1.0), (5, 12, "findings", s, 0.0), (6, 13, "header", s, 1.0), (6, 14, "issues", s, 0.99)]
    got = finals(spark, rows, search.suppress_headers)
    assert got == {r[1]: r[4] for r in rows} | {4: 0.796}


def test_lifted_and_repeated_hits(spark):
    s, t = "substantive", "party_or_title"
    rows = [
        (1, 1, "header", s, 1.0), (1, 2, "issues", s, 0.95), (1, 3, "facts", s, 0.95), (1, 4, "header", s, 0.8), (1, 5, "header", s, 0.7), (1, 6, "header", s, 0.6), (1, 7, "header", s, 0.5),
        (2, 8, "header", t, 1.0), (2, 9, "issues", t, 0.95), (2, 10, "header", t, 0.9), (3, 11, "header", s, 1.0), (3, 12, "issues", s, 0.92), (3, 13, None, s, 0.99), (4, 14, "header", s, 1.0), (4, 15, "facts", s, 0.93), (5, 16, "header", s, 0.5), (5, 17, "facts", s, 0.6),
        (6, 18, "header", s, 1.0), (6, 19, "facts", s, 0.95, 0.1), (6, 20, "issues", s, 0.95, 0.2),
    ]
    got = finals(spark, rows, search.diversify)
    want = {r[1]: r[4] for r in rows} | {2: 1.0095, 4: 0.8 * 0.88, 5: 0.7 * 0.76, 6: 0.6 * 0.70, 7: 0.5 * 0.70, 10: 0.9 * 0.88, 15: 0.93 + 0.0793, 20: 1.0095}
    assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-9 for u in want), {u: (got[u], want[u]) for u in want if abs(got[u] - want[u]) > 1e-9}


def test_the_lift_has_a_cap(spark):
    # a gap of 0.07 and 1 % is just below the cap of 8 %; with the numbers of another scale too
    got = finals(spark, [(1, 1, "header", "substantive", 100.0), (1, 2, "findings", "substantive", 93.0)], search.diversify)
    assert abs(got[2] - (93 + min(7 + 0.93, 8))) < 1e-9


def test_confusable_records(spark):
    hits = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), (None, 1.0)], "record string, score double")
    pairs = spark.createDataFrame([("a", "b"), ("c", "a"), ("b", "c"), (None, "a"), ("a", "b")], "a string, b string")
    scores = lambda df: {r.record: r.score for r in df.collect()}
    assert scores(search.confused(hits, pairs, ["a"])) == {"a": 1.0, "b": 0.08, "c": 0.08, None: 1.0}
    assert scores(search.confused(hits, pairs, ["b", "a"])) == {"a": 0.08, "b": 1.0, "c": 0.08, None: 1.0}
    assert scores(search.confused(hits, pairs, ["a"], strict=False)) == scores(search.confused(hits, pairs, [])) == dict.fromkeys(["a", "b", "c", None], 1.0)


def test_lists_hold_every_vector_and_find_most_neighbours(spark):
    units = plans.units(spark, "/root/testdata/sf0.1")
    middle, probes = vectors.fitted(units, plans.LISTS, 25, plans.RECALL)
    lists = vectors.inverted_lists(units, middle)
    assert lists.count() == units.count() and lists.where("list < 0").count() == 0 and 0 < probes <= len(middle)
    asked = plans.vector_queries(spark, "/root/testdata/sf0.1")
    exact = {(r.query_id, r.unit): r.score for r in search.vector(asked, units, 25).collect()}
    near = {(r.query_id, r.unit): r.score for r in search.vector_lists(asked, lists, middle, 25, probes).collect()}
    assert len(exact) == len(near) == 25 * asked.count()
    assert len(exact.keys() & near.keys()) >= 0.9 * len(exact) and all(near[p] == exact[p] for p in exact.keys() & near.keys())


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [1.0, 2.0, 3.0]), (6, []), (4, [1.0, 1.0])]
    units = spark.createDataFrame(rows, "unit long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "query_id int, q array<double>")
    got = {(r.query_id, r.unit): r.score for r in search.vector(asked, units, 5).collect()}
    assert got == {(1, 1): 1.0, (1, 4): 0.707107, (1, 2): None, (2, 4): 0.707107, (2, 1): 0.0, (2, 2): None}
    middle, probes = vectors.fitted(units.where("unit in (1, 2, 4)"), 10, 2)
    assert len(middle) == 2 and {r.unit: r.list >= 0 for r in vectors.inverted_lists(units, middle).collect()} == {1: True, 2: True, 4: True, 5: False, 6: False}
    assert vectors.fitted(units.limit(0), 10, 2)[1] == 0
