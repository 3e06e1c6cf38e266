import itertools
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import components, linear, ngram_join, quality, toxicity

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize(("module", "label", "base", "left", "threshold", "least"), [(quality, "quality", 3, 1, 0.5, 0.95), (toxicity, "toxic", 4, 2, 0.3, 0.9)])
def test_held_out_accuracy(spark, module, label, base, left, threshold, least):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rows = module.score(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    hits = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % base == left) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= threshold)
        if r["held_out"] and r["doc_id"] in truth:
            hits.append(truth[r["doc_id"]] == r["predicted"])
    assert len(hits) > 60 and np.mean(hits) >= least


@pytest.mark.parametrize(("module", "label", "base", "left"), [(quality, "quality", 3, 1), (toxicity, "toxic", 4, 2)])
def test_scores_learn_nothing_from_held_out_rows(spark, module, label, base, left):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    turned = labels.selectExpr("doc_id", f"case when crc32(string(doc_id)) % {base} = {left} then 1 - {label} else {label} end as {label}")
    assert sorted(map(tuple, module.score(docs, labels).collect())) == sorted(map(tuple, module.score(docs, turned).collect()))


def plain_leader(examples, width, epochs, alpha=linear.ALPHA, beta=linear.BETA, l1=linear.L1, l2=linear.L2):
    """Follow-the-regularised-leader by its definition: each weight minimises the sum of past gradients, proximal terms and penalties."""
    order, g_sum, shifts, n = np.random.default_rng(0), np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)

    def weight(k):
        pull = g_sum[k] - shifts[k]
        bias = k == width
        if not bias and abs(pull) <= l1:
            return 0.0
        return -(pull - (0 if bias else np.sign(pull) * l1)) / ((beta + np.sqrt(n[k])) / alpha + (0 if bias else l2))

    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            label, at, value = examples[i]
            row = [*zip(at.tolist(), value.tolist(), strict=True), (width, 1.0)]
            w = {k: weight(k) for k, _ in row}
            p = 1 / (1 + np.exp(-sum(w[k] * x for k, x in row)))
            for k, x in row:
                g = (p - label) * x
                shifts[k] += (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / alpha * w[k]
                g_sum[k] += g
                n[k] += g * g
    return np.array([weight(k) for k in range(width + 1)])


def test_training_against_a_plain_leader():
    rng = np.random.default_rng(5)
    examples = [(int(rng.integers(2)), np.unique(rng.integers(0, 32, 6)), None) for _ in range(60)]
    examples = [(y, np.append(at, 40 + y), np.append(rng.uniform(0.5, 2, len(at)), 1.5)) for y, at, _ in examples]
    model, want = linear.train(examples, bits=6, epochs=2), plain_leader(examples, 64, 2)
    assert np.allclose(model.weights, want[:64], atol=1e-5) and abs(model.bias - want[64]) < 1e-9 and (want[:64] != 0).any()


@pytest.mark.parametrize(("module", "keeps", "label", "default"), [(quality, quality.keep_good, "quality", 1.0), (toxicity, toxicity.drop_toxic, "toxic", 0.0)])
def test_edges_of_the_classifiers(spark, module, keeps, label, default):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (2, "", 7), (None, "words", 7), (5, "long " * 30000, 7)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 5), (9, 1)], f"doc_id long, {label} int")
    rows = module.score(docs, labels).collect()
    assert len(rows) == 5 and all(r["score"] == default for r in rows)
    kept = keeps(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 5
    assert module.score(docs.limit(0), labels).count() == 0
    both = spark.createDataFrame([(1, 0), (2, 1), (5, 1), (5, 0)] + [(i, i % 2) for i in range(10, 40)], f"doc_id long, {label} int")
    more = docs.unionByName(spark.createDataFrame([(i, "bad bad thing" if i % 2 else "fine day", 7) for i in range(10, 40)], docs.schema))
    assert module.score(more, both).count() == 35


def test_one_text_of_a_repeated_id_is_learnt_from(spark):
    rows = [(i, "bad bad thing" if i % 2 else "fine day") for i in range(40)] + [(1, f"other text {k}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    one, two = ({(r.doc_id, r.text): 0 for r in docs.collect()} for _ in range(2))
    for part, found in ((1, one), (7, two)):
        scored = quality.score(docs.repartition(part), labels).collect()
        assert len(scored) == 70
        found.update({("scores", k): x for k, x in enumerate(sorted((r.doc_id, round(r.score, 9)) for r in scored))})
    assert one == two


def test_training_separates_and_is_bounded(spark):
    rng = np.random.default_rng(1)
    examples = [(i % 2, np.unique(np.append(rng.integers(10, 1000, 20), i % 2)), np.ones(0)) for i in range(400)]
    model = linear.train([(y, at, np.ones(len(at))) for y, at, _ in examples], bits=10)
    assert model.weights[1] > 0.5 > -0.5 > model.weights[0] and np.mean(model.weights[10:] != 0) < 0.2


def brute(texts, n=5):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + n]) for i in range(max(min(1, len(w)), len(w) - n + 1))})
    return out


def brute_classes(rows, threshold=0.8):
    sets = brute([t for _, t in rows])
    up = list(range(len(rows)))
    links = [0] * len(rows)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) < threshold * max(len(sets[i]), len(sets[j])) - 1e-9:
                continue
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-12:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    low: dict = {}
    for i, (doc, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), doc), doc)
    return sorted((doc, low[top(i)], links[i], len(sets[i])) for i, (doc, _) in enumerate(rows))


def near(rng, words, changes):
    words = list(words)
    for k in rng.integers(0, len(words), changes):
        words[k] = f"x{rng.integers(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("block", "most", "tile"), [(1024, 64, 256), (7, 64, 3), (7, 2, 5)])
def test_ngram_join_against_brute_force(spark, monkeypatch, block, most, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "PAIRS", 4 * tile)
    rng = np.random.default_rng(3)
    rows, doc = [], 0
    for size in (1, 2, 5, 60):
        base = [f"w{rng.integers(500)}" for _ in range(int(rng.integers(60, 200)))]
        for _ in range(size):
            rows.append((doc := doc + 1, near(rng, base, int(rng.integers(0, 5)))))
    rows += [(doc + 1, "a b"), (doc + 2, "A  b"), (doc + 3, ""), (doc + 4, None), (doc + 5, "only four words here"), (doc + 6, " ".join(rows[-1][1].split())), (doc + 7, rows[0][1].upper())]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, rep int, key string").repartition(3)
    join = ngram_join.Join(docs, block=block, max_blocks=most)
    want = brute_classes(rows)
    assert sorted(map(tuple, join.classes().collect())) == want
    sets = dict(zip([i for i, _ in rows], brute([t for _, t in rows]), strict=True))
    pairs = join.pairs().collect()
    assert len(pairs) == len({(r["a"], r["b"]) for r in pairs})
    for r in pairs:
        x, y = sets[r["a"]], sets[r["b"]]
        assert r["a"] < r["b"] and abs(r["similarity"] - len(x & y) / len(x | y)) < 1e-12
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _, _ in want})
    assert ngram_join.Join(docs.limit(0)).classes().count() == 0


def test_tiles_are_used_in_the_tasks():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 40)
    grams = [np.unique(np.append(rng.integers(0, 2**62, 3), base)).astype("<u8") for _ in range(60)]
    sig = np.array([ngram_join.signature(g).view("<i8") for g in grams])
    left, right = np.arange(35), np.arange(35, 60)
    want = {(i, j) for i in range(60) for j in range(min(i, 35))}
    compare = ngram_join.Compare(0.8, 1e-8)
    before, ngram_join.TILE = ngram_join.TILE, 8
    try:
        got = [(max(x), min(x)) for sides in ((left, left), (left, right)) for a, b, _ in compare.pairs(sig, grams, *sides, 0) for x in zip(a.tolist(), b.tolist(), strict=True)]
    finally:
        ngram_join.TILE = before
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_ngram_join_finds_every_pair_of_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, ngram_join.Join(docs).classes().collect())) == brute_classes(rows)


def test_ngram_join_with_repeated_and_null_ids(spark):
    one, two = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(5, one), (5, two), (5, two), (7, one + " end"), (None, two + " end"), (None, two + " end"), (3, two + " End"), (None, "quite alone here"), (None, None), (None, None), (2, ""), (2, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, `__rep` int")
    got = sorted(map(tuple, ngram_join.Join(docs).classes().select("doc_id", "class_id", "n_links").collect()), key=str)
    assert got == sorted([(5, 5, 1), (7, 5, 1), *[(5, 3, 4)] * 2, *[(None, 3, 4)] * 2, (3, 3, 4), (None, None, 0), *[(None, None, 0)] * 2, *[(2, 2, 0)] * 2], key=str)
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    # of each class its first row, and the rows without words
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, one), (3, two + " End"), (None, "quite alone here"), (None, None), (None, None), (2, ""), (2, "")], key=str)


def test_posterior_bound():
    for n, least in zip(range(16, 129, 16), ngram_join.least_matches(0.8, 1e-4), strict=True):
        grid = (np.arange(20000) + 0.5) / 20000
        for m in (least - 1, least):
            if m < 0:
                continue
            like = grid**m * (1 - grid) ** (n - m)
            assert (like[grid >= 0.8].sum() / like.sum() >= 1e-4) == (m >= least)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_components(spark, edges):
    up = {x: x for e in edges for x in e}
    for _ in range(len(up)):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: r for x, r in up.items() if x != r}


def test_components_of_a_star_and_a_path(spark, monkeypatch):
    monkeypatch.setattr(components, "PARTS", 5)
    edges = [(500, i) for i in range(600) if i != 500] + [(i, i + 1) for i in range(1000, 1300)]
    pairs = spark.createDataFrame(edges, "a long, b long").selectExpr("struct(a as x, -a as y) as u", "struct(b as x, -b as y) as v")
    got = {r["node"]["x"]: r["root"]["x"] for r in components.components(pairs).collect()}
    assert got == {i: 0 for i in range(1, 600)} | {i: 1000 for i in range(1001, 1301)}


def decoder_of(text):
    code = toxicity.letter_codes(" " + text).astype(int)
    return toxicity.Decoder(np.bincount(code[:-2] * 729 + code[1:-1] * 27 + code[2:], minlength=27**3).reshape(27, 27, 27).astype(float))


def test_viterbi_against_all_paths():
    decoder = decoder_of("you loser and idiot , a stupid worthless moron , disgusting scum , pathetic clown " * 20)
    for span in ("1d10t", "$tuuup!d", "l0.s3r", "m-0-r0n", "é1e1", "aaaa", "c|0wn+", "5cu(m"):
        best = -np.inf
        for path in itertools.product(*decoder.lattice(span)):
            a = b = 0
            score = 0.0
            for letter, c, cost in path:
                score += cost
                if letter:
                    score += decoder.log[a][b][c]
                    a, b = b, c
            score += decoder.log[a][b][0]
            if score > best + 1e-9:
                best, want = score, "".join(letter for letter, _, _ in path)
        assert decoder.decode(span) == want


def test_decoding_takes_time_in_proportion():
    decoder = decoder_of("some words of a text " * 50)
    million = 10**6
    plain = ["".join(chr(97 + i % 26) for i in range(million)), "".join(chr(0x4E00 + i % 2000) for i in range(million)), "a" + "." * million, "a" + "!" * million]
    began = time.process_time()
    assert decoder.restore_all(plain) == plain
    for text in ("".join(chr(0x4E00 + i % 2000) + "7" * (i % 50 == 0) for i in range(million)), "QkFTRTY0+/9" * 90_000, "ab1." * 250_000, "a " * (million // 2), "b" * million, "1.1." * 200_000 + "x"):
        assert decoder.restore(text)
    assert time.process_time() - began < 60


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab1!$. -éB\n\x1c中", max_size=40), max_size=6))
def test_batches_are_decoded_like_single_texts(texts):
    decoder = decoder_of("abba baab " * 20)
    assert decoder.restore_all(texts) == [decoder.restore(t) for t in texts]


def test_words_without_blanks_beside_are_found_like_by_patterns():
    decoder = decoder_of("you loser and idiot , a stupid worthless moron " * 20)
    for text in ("1d10t", "x 1d10t y", "a\ti d i o t\nb", "stuuupid 1d10t", "no marks here.", "i d", "end. a b c d", "e.g. m0r0n, and", "(w0rthless)"):
        assert decoder.restore(text).split() == decoder.piece(text).split()


def test_deobfuscation():
    text = "you loser and idiot , a stupid worthless moron , disgusting scum , pathetic clown , trash " * 50
    decoder = decoder_of(text)
    for seen, meant in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("l0s3r", "loser"), ("stuuuupid", "stupid"), ("p@thetic!", "pathetic"), ("d.i.s.g.u.s.t.i.n.g", "disgusting"), ("m-o-r-o-n", "moron"), ("$cum", "scum"), ("tr4$h", "trash")):
        assert meant in decoder.restore(f"a {seen} b").split(), seen
    assert decoder.restore("plain words, as they are.") == "plain words, as they are."
    assert decoder.restore("") == ""
