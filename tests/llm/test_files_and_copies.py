import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import chat, exact_dedup, fingerprints, warc


@given(st.lists(st.tuples(st.binary(max_size=6), st.one_of(st.none(), st.integers(0, 50))), max_size=40), st.booleans())
def test_trie_against_dict(rows, largest):
    trie, want = exact_dedup.PatriciaTrie(largest), {}
    for key, owner in rows:
        assert trie.insert(key, owner) == (key not in want)
        want.setdefault(key, []).append(owner)
    pick = lambda v: (max if largest else min)([x for x in v if x is not None], default=None)
    assert {k: (o, n) for k, o, n in trie.items()} == {k: (pick(v), len(v)) for k, v in want.items()}


@given(st.lists(st.tuples(st.binary(max_size=5), st.integers(0, 50)), max_size=40), st.integers(0, 39))
def test_subtrees_are_handed_on_whole(rows, cut):
    """Some texts, a subtree handed on, the rest: together every text with its best owner and its count."""
    trie, got, want = exact_dedup.PatriciaTrie(), {}, {}

    def took(items):
        for key, owner, n in items:
            best, count = got.get(key, (None, 0))
            got[key] = (trie.better(best, owner), count + n)

    for k, (key, owner) in enumerate(rows):
        trie.insert(key, owner)
        best, count = want.get(key, (None, 0))
        want[key] = (trie.better(best, owner), count + 1)
        if k == cut:
            before = len(list(trie.items()))
            handed = list(trie.hand_on())
            assert handed and len(list(trie.items())) + len(handed) == before
            took(handed)
    took(trie.items())
    assert got == want


@given(st.lists(st.tuples(st.binary(max_size=5), st.integers(0, 50)), max_size=40))
def test_sorted_texts_leave_one_path(rows):
    trie, got, want = exact_dedup.PatriciaTrie(), [], {}
    for key, owner in sorted(rows):
        got += trie.pass_by(key)
        trie.insert(key, owner)
        assert trie.forks() <= len(key)
        want.setdefault(key, []).append(owner)
    got += trie.items()
    assert got == [(k, max(v), len(v)) for k, v in sorted(want.items())]


def test_a_trie_forks_and_hands_on_its_largest_subtree():
    trie = exact_dedup.PatriciaTrie()
    for k, key in enumerate((b"the cat sat", b"the cat ran", b"the dog", b"the cat", b"the cat sat down" + b"x" * 500)):
        trie.insert(key, k)
    assert trie.forks() == 2
    assert [k for k, _, _ in trie.hand_on()] == [b"the cat", b"the cat ran", b"the cat sat", b"the cat sat down" + b"x" * 500]
    assert list(trie.items()) == [(b"the dog", 2, 1)] and trie.forks() == 0


@pytest.mark.parametrize(("trie_bytes", "bits"), [(1 << 20, 12), (10, 0), (700, 1)])
def test_exact_dedup(spark, trie_bytes, bits):
    rows = [(1, "a"), (2, None), (3, ""), (7, "a"), (5, "a "), (7, "a"), (None, "z"), (9, "x" * 200_000), (10, "x" * 200_000), (None, "a")]
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, keep_id string, n int").repartition(3)
    got = sorted(map(tuple, exact_dedup.resolve(docs).collect()), key=str)
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    owners = {tuple(r) for r in exact_dedup.owners(docs, trie_bytes=trie_bytes, bits=bits).collect()}
    assert owners == {(w[4], w[1], w[2]) for w in want}
    stay = exact_dedup.drop_copies(docs)
    assert stay.columns == docs.columns and sorted(r["doc_id"] or 0 for r in stay.collect()) == [0, 3, 5, 7, 10]
    assert exact_dedup.resolve(docs.limit(0)).count() == 0


def test_fingerprints(spark):
    texts = {1: "abc", 2: None, 4: "The quick brown fox jumps. " * 40, 5: "", 7: "é" * 9 + "tail", 8: "Completely other words stand in this text here! " * 30, 9: "ab"}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, bucket int")
    got = {r["doc_id"]: r for r in fingerprints.compare(docs).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        marks = [fingerprints.fingerprint(x) for x in (text, new, following)]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), hashlib.sha256(new.encode()).hexdigest(), marks[0], marks[1])
        assert (r["near_edited"], r["near_next"]) == (fingerprints.likeness(marks[0], marks[1]), fingerprints.likeness(marks[0], marks[2]))
    assert len(got) == len(texts)
    assert fingerprints.compare(docs.limit(0)).count() == 0
    (one,) = fingerprints.compare(docs.where("doc_id = 4")).collect()
    assert one["near_next"] == 1.0


@given(st.text(max_size=300), st.text(max_size=300))
def test_likeness_is_bounded_and_symmetric(a, b):
    x, y = fingerprints.fingerprint(a), fingerprints.fingerprint(b)
    assert 0 <= fingerprints.likeness(x, y) == fingerprints.likeness(y, x) <= 1
    assert fingerprints.likeness(x, x) == 1


def test_half_edited_texts_are_nearer_than_other_texts():
    a, b = ("some words about rivers and boats on water " * 20, "quite other things are told in that second piece of prose " * 20)
    x, y, z = map(fingerprints.fingerprint, (a, fingerprints.edited(a, b), b))
    assert fingerprints.likeness(x, y) > fingerprints.likeness(x, z)


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 5, None, None), (5, 0, "user", "hi"), (5, 1, "assistant", "no"),
             (5, 1, "assistant", "no"), (None, 0, "user", "x"), (6, None, "user", "hi"), (6, 0, "user", "hi"), (7, 0, "user", "h"), (7, 1, "i", "")]
    turns += [(8, i, "user", f"t{i}") for i in range(1200)] + [(9, i, "user", f"t{i}") for i in range(700)]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, place string")
    got = {r["conv_id"]: (r["n_turns"], r["chat"]) for r in chat.render(df).collect()}
    one = lambda r, t: f"<|{r}|>\n{t}<|end|>\n"
    assert got == {2: (2, one("user", "hi") + one("assistant", "yo")), 4: (1, one("", "")), 5: (2, one("user", "hi") + one("assistant", "no")), 6: (2, one("user", "hi") * 2), 7: (2, one("user", "h") + one("i", "")),
                   8: (1200, "".join(one("user", f"t{i}") for i in range(1200)))}
    assert chat.render(df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    big, other = "<p>" + "word " * 50, "<i>" + "é" * 60
    rows = [(1, "http://a.example.com/x", big), (2, "http://b.example.com/", big), (3, "http://a.example.com/x", "small"), (4, "https://c.org:8080/p q\n?z", "small"), (5, None, None), (0, "::bad[url", other), (9, "http://a.example.com/x", other), (9, "http://a.example.com/x", other), (None, "http://n.org", big)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(map(tuple, warc.round_trip(pages, f"file://{tmp_path}").collect()), key=str)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min(x[0] for x in rows if x[2] == html and x[0] is not None) if len(data) >= 100 else i
        again = i is not None and first < i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_index_spans_blocks(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i % 11}", f"text {i}") for i in range(300)] + [(5, "http://h5.org/5", "text 5")] * 9, "page_id long, url string, html string")
    captures = warc.write_archives(warc.classify(pages), f"{tmp_path}/a")
    top = warc.write_index(captures, f"{tmp_path}/i", block=4)
    assert warc.read_back(pages, f"{tmp_path}/a", f"{tmp_path}/i", top).count() == 309
    assert warc.IndexPart(f"{tmp_path}/i", top[0][2]).lookup("zzz", 1) == []
    top = warc.write_index(captures, f"{tmp_path}/j", block=4, part_bytes=9000)
    assert len(top) > 3 and warc.read_back(pages, f"{tmp_path}/a", f"{tmp_path}/j", top).count() == 309


def plain_digest(text):
    """The digest by its description: hashed byte triplets, quartile edges of the sorted counts, the step of the length."""
    data = text.encode()
    counts = [0] * 256
    if len(data) < 3:
        for x in data:
            counts[x] += 1
    for k in range(len(data) - 2):
        counts[(int.from_bytes(data[k : k + 3], "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 24] += 1
    edges = [sorted(counts)[k] for k in (63, 127, 191)]
    marks = [sum(c > e for e in edges) for c in counts]
    return min(255, round(8 * math.log2(1 + len(data)))), marks


@settings(deadline=None)
@given(st.text(max_size=400), st.text(max_size=400))
def test_fingerprint_against_its_description(a, b):
    found = []
    for text in (a, b):
        step, marks = plain_digest(text)
        digest = fingerprints.fingerprint(text)
        assert int(digest[:2], 16) == step and [int(digest[2 + k // 4 * 2 : 4 + k // 4 * 2], 16) >> k % 4 * 2 & 3 for k in range(256)] == marks
        found.append((step, marks))
    (p, x), (q, y) = found
    cost = sum({0: 0, 1: 1, 2: 2, 3: 6}[abs(i - j)] for i, j in zip(x, y, strict=True)) + max(0, abs(p - q) - 1)
    assert fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b)) == 1 - min(cost, fingerprints.BOUND) / fingerprints.BOUND


def test_url_key():
    assert warc.url_key("http://A.Example.com/x?y#z") == "com,example,a)/x?y"
    assert warc.url_key(None) == ")"
