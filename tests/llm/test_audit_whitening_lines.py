"""The filter audit, whitening and line dedup against plain versions, and their odd rows."""

import hashlib
import itertools
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import filter_audit, line_dedup, whitening

CLASHING = "id part fails digest least most marks removed filter n good toxic cells step before h g doc tie places keep __keep __doc kind owner last size key vector row v".split()
BLANKS = " \t\n\x0b\x0c\r"


def with_clashing(spark, rows, schema):
    more = [c for c in CLASHING if f"{c} " not in schema]
    return spark.createDataFrame([(*r, *[None if k % 2 else 7] * len(more)) for k, r in enumerate(rows)], schema + ", " + ", ".join(f"`{c}` long" for c in more))


# filter audit


def plain_audit(rows, labels):
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    good, toxic = ({d for d, *marks in labels if d is not None and marks[k] == 1} for k in range(2))
    docs = defaultdict(list)
    for doc, text, part in rows:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": doc is not None and doc > first[t]}
        docs[part or ""].append(({f for f in fails if fails[f]}, doc in good, doc in toxic))
    out = set()
    for part, items in docs.items():
        shapley, steps = defaultdict(int), []
        for order in itertools.permutations("ABCDE"):
            left = items
            for k, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                earlier = sum(f in x[0] for x in items) - len(gone)
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                steps.append((part, "".join(order), k, f, len(left), len(gone), earlier, sum(x[0] == {f} for x in items), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out |= {(*s[:3], *s[4:], shapley[s[3]]) for s in steps}
    return out


TEXTS = [None, "", "word " * 250, " ".join(f"w{k}" for k in range(220)), "A B C", "a # b", " ".join(f"w{k}" for k in range(199)) + " x", "é" * 300_000, "\x0b\x0c", "x " * 200 + "$"]
AUDITED = [(k, TEXTS[k % len(TEXTS)], [None, "en", "", "x"][k % 4]) for k in range(45)] + [(3, TEXTS[3], "en"), (3, TEXTS[3], "en"), (None, TEXTS[4], "en"), (None, TEXTS[4], None), (None, "only without an id", "en")]
LABELS = [(1, 1, 0), (2, 0, 1), (3, None, 1), (3, 1, None), (4, 1, 1), (4, 0, 0), (None, 1, 1), (7, None, None)]


def test_audit_of_odd_rows(spark):
    docs = with_clashing(spark, AUDITED, "doc_id long, text string, lang string")
    labels = with_clashing(spark, LABELS, "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(docs, labels).collect()
    got = {tuple(r[c] for c in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}
    assert got == plain_audit(AUDITED, LABELS) and len(rows) == 3 * 600
    assert filter_audit.audit(docs.limit(0), labels).collect() == []
    assert len(filter_audit.audit(docs, labels.limit(0)).collect()) == 1800


@pytest.mark.parametrize(("block", "parts"), [(7, 2), (64, 64), (1 << 18, 3)])
def test_counts_do_not_depend_on_blocks_or_parts(spark, monkeypatch, block, parts):
    rng = np.random.default_rng(4)
    rows = [(f"p{k % 11}", int(f), int(m)) for k, (f, m) in enumerate(zip(rng.integers(0, 32, 500), rng.integers(0, 4, 500), strict=True))]
    monkeypatch.setattr(filter_audit, "BLOCK", block)
    monkeypatch.setattr(filter_audit, "PARTS", parts)
    got = {(r["part"], r["removed"], r["filter"]): (r["n"], r["good"], r["toxic"]) for r in filter_audit.prefix_counts(spark.createDataFrame(rows, "part string, fails int, marks int")).collect()}
    assert len(got) == 11 * 32 * 6
    for (part, removed, k), counts in got.items():
        hit = [m for p, f, m in rows if p == part and not f & removed and (k == 5 or f >> k & 1 and not removed >> k & 1)]
        assert counts == (len(hit), sum(m & 1 for m in hit), sum(m >> 1 for m in hit))


# whitening


def plain_whitening(vectors):
    x = np.array([[math.floor(256 * c) for c in v] for v in vectors], dtype=float)
    fit = np.unique(x, axis=0)
    mean = fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / len(fit)
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    dev = [sum((len(fit) * int(a) - int(s)) ** 2 for a, s in zip(row, fit.sum(axis=0), strict=True)) for row in x]
    return len(fit), values, (x - mean) @ basis[:, :4] / np.sqrt(np.maximum(values[:4], 1e-300)), values[:4] / np.trace(cov), dev


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_whitening_equals_the_dense_one(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    given_ = {r.vec_id: r.embedding for r in table.collect()}
    n, _, white, explained, dev = plain_whitening(list(given_.values()))
    at = {i: k for k, i in enumerate(given_)}
    got = np.zeros_like(white)
    rows = whitening.whiten(table).collect()
    assert len(rows) == 4 * len(given_)
    for r in rows:
        assert r.n == n and r.deviation == dev[at[r.vec_id]] and abs(r.explained - explained[r.component - 1]) < 1e-10 and 0 <= r.identity_error < 1e-8
        got[at[r.vec_id], r.component - 1] = r.whitened
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-8


def test_vectors_that_are_dropped_or_flat(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25, 0.0]), (2, [0.5, 0.25, 0.0]), (3, [-0.5, 0.1, 0.0]), (4, [0.1, -0.7, 0.0]), (5, None), (6, [0.1, None, 0.2]), (7, [nan, 0.0, 0.0]), (8, [0.0, inf, 0.0]), (9, [1.0, 2.0]), (None, [-0.0, 0.3, 0.0]), (10, []), (11, [1e300, 0.0, 0.0])]
    vectors = with_clashing(spark, rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(vectors).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((i, c) for i in ("1", "2", "3", "4", "None") for c in (1, 2, 3))
    assert {r.n for r in got} == {4} and all((r.whitened is None) == (r.component == 3) for r in got) and got[0].identity_error < 1e-9
    n, _, white, explained, dev = plain_whitening([v for i, v in rows if i in (1, 2, 3, 4, None)])
    assert {r.vec_id: r.deviation for r in got} == dict(zip((1, 2, 3, 4, None), dev, strict=True))
    same = [r.whitened for r in got if r.vec_id in (1, 2) and r.component == 1]
    assert same[0] == same[1]
    for part in (vectors.limit(0), vectors.where("vec_id = 5"), vectors.where("vec_id = 10")):
        assert whitening.whiten(part).collect() == []
    alone = whitening.whiten(vectors.where("vec_id in (1, 2)")).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone} == {(1, 0, None, 0.0, 0.0)} and len(alone) == 6


def test_exact_beyond_a_long():
    x = np.array([[2**40, -(2**41)], [5, 7]], dtype=np.int64)
    assert whitening.deviations(x, 1000, [3, 4]) == [sum((1000 * int(a) - s) ** 2 for a, s in zip(row, (3, 4), strict=True)) for row in x]
    assert whitening.exact_sum(np.full((4, 1), 2**62, dtype=np.int64)).tolist() == [2**64]
    assert whitening.decoded(whitening.encoded(np.array([[1, -2], [2**20, 3], [-(2**40), 0]])), 2).tolist() == [[1, -2], [2**20, 3], [-(2**40), 0]]


@pytest.mark.parametrize(("d", "block", "rank"), [(60, 16, 60), (200, 8, 5), (40, 4, 2), (30, 3, 30), (5, 16, 5), (300, 8, 300)])
def test_lanczos(d, block, rank):
    """Low ranks break down; equal eigenvalues (every second pair) need restarts of small blocks."""
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = np.zeros(d)
    values[:rank] = np.sort(np.repeat(np.geomspace(100, 1, rank), 1 + d % 2)[:rank])[::-1]
    a = (q * values) @ q.T
    seen = []

    def multiply(v):
        seen.append(v.shape[1])
        return a @ v

    found, vectors = whitening.lanczos(multiply, d, 4, block)
    k = len(found)
    assert k == min(4, d) and np.allclose(found, values[:k], atol=1e-10) and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    assert np.linalg.norm(a @ vectors - vectors * found) < 1e-9 and sum(seen) <= d
    if rank < d // 2 or d == 300:
        assert sum(seen) < d


# line dedup


def plain_lines(rows, min_chars=20, min_docs=3):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANKS))
    docs = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                docs[key(line)].add(-(2**63) if doc is None else doc)
    out = []
    for doc, text in rows:
        lines, own = (text or "").split("\n"), -(2**63) if doc is None else doc
        stay = [x for x in lines if not (len(docs.get(key(x), ())) >= min_docs and own < max(docs[key(x)]))]
        out.append((doc, len(lines), len(lines) - len(stay), text, "\n".join(stay)))
    return out


def digests_of(found):
    return sorted(((doc, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for doc, n, gone, _, kept in found), key=str)


def found_lines(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=str)


COMMON = "  This Line is in nearly all of the documents \r"
ODD_LINES = [
    (1, None), (2, ""), (3, COMMON), (4, COMMON.lower() + "\n\n" + COMMON), (5, "\n".join([COMMON] * 3 + ["own line of the fifth document"])), (6, "É" * 20), (7, "é" * 20 + "\n" + "É" * 20), (8, "É" * 20 + "\nshort"),
    (9, "nineteen characters"), (10, "nineteen characters"), (11, "nineteen characters"), (12, "twenty characters ok"), (13, "\x0btwenty characters ok\x0c"), (14, "Twenty Characters OK\nx"), (14, "Twenty Characters OK\nx"), (14, "twenty characters ok\ny"),
    (None, COMMON), (None, "only null ids hold this line"), (None, "only null ids hold this line\n"), (15, "in two documents alone, this"), (16, "in two documents alone, this"), (16, "in two documents alone, this\n "), (17, ("a very long text with one line " * 20000 + "\n" + COMMON) * 3), (18, "\n" * 3000 + COMMON),
]


def test_lines_of_odd_rows(spark):
    docs = with_clashing(spark, ODD_LINES, "doc_id long, text string")
    assert found_lines(line_dedup.digests(docs)) == digests_of(plain_lines(ODD_LINES))
    assert found_lines(line_dedup.digests(docs, min_chars=1, min_docs=2)) == digests_of(plain_lines(ODD_LINES, 1, 2))
    assert line_dedup.digests(docs.limit(0)).collect() == [] and line_dedup.bitmaps(docs.limit(0)).collect() == []
    kept = line_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    want = sorted(((doc, None if text is None else stays) for doc, _, _, text, stays in plain_lines(ODD_LINES)), key=str)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == want


def test_a_line_over_many_ranges(spark):
    """One line in all documents, more ranges than lines: hashes fill ranges, and documents with one id stand at their ends."""
    line = "the line that all the documents share"
    rows = [(k // 2, f"{line}\nline of {k % 5} that some documents share" + "\n" * (k % 2)) for k in range(600)] + [(None, line)] * 40 + [(None, f"{line}\n{k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert found_lines(line_dedup.digests(docs)) == digests_of(plain_lines(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 4), st.integers(0, 3)), max_size=40), st.lists(st.integers(0, 40), max_size=6), st.integers(1, 4), st.integers(0, 3))
def test_verdicts_of_ranges(rows, cuts, min_docs, waiting):
    """Wherever ranges are cut, verdicts and counts together say what a single range would."""
    rows = sorted({(h, 0, doc, tie, 1, b"") for h, doc, tie in rows}, key=lambda r: (r[0], -r[2], r[3]))
    docs = defaultdict(set)
    for r in rows:
        docs[r[0]].add(r[2])
    want = {(r[0], r[2], r[3]) for r in rows if len(docs[r[0]]) >= min_docs and r[2] < max(docs[r[0]])}
    drop, open_, ends, inner, owner = set(), set(), defaultdict(set), defaultdict(int), {}
    places = sorted({0, len(rows), *(c for c in cuts if c <= len(rows))})
    before, line_dedup.MOST_WAITING = line_dedup.MOST_WAITING, waiting
    for a, b in zip(places, places[1:], strict=False):
        stream = line_dedup.Stream(min_docs)
        for r in rows[a:b]:
            stream.add(r)
        stream.end()
        for kind, h, _, doc, tie, _, _, last, n in stream.out:
            if kind == line_dedup.COUNT:
                ends[h] |= {doc, last}
                inner[h] += n
                owner[h] = max(doc, owner.get(h, doc))
            else:
                (drop if kind == line_dedup.DROP else open_).add((h, doc, tie))
    line_dedup.MOST_WAITING = before
    drop |= {(h, doc, tie) for h, doc, tie in open_ if inner[h] + len(ends[h]) >= min_docs and doc < owner[h]}
    assert drop == want


@given(st.lists(st.booleans(), min_size=1, max_size=200))
def test_bitmaps_come_back(keep):
    assert line_dedup.unpack(line_dedup.pack(np.array(keep)), len(keep)).tolist() == keep
