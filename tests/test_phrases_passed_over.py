"""Queries whose phrases a unit lacks, or whose unwanted words it has, are passed over before their covers are looked for."""

import random

import numpy as np
import pytest
from pyspark.sql import Row

from docketry.operators import lexical

QUERIES = ['"a b" c', "a-b-c", 'a or "b c" -d', "a -b", 'a -"b c"', "a or a -c", "-a", '"a a"', "b or c", '"a b" or "c d" -e', "a b or c -a", '"c d" -"d c"']


def test_scores_are_those_of_every_group():
    rng, block = random.Random(4), lexical.Block.of([Row(query_id=k, query=q) for k, q in enumerate(QUERIES)])
    for _ in range(400):
        texts = {c: [rng.choice("abcdef") for _ in range(rng.randrange(9))] for c in ("title", "body")}
        got = block.scores(texts, {"title": 2.5, "body": 1.0}, [], 0.0, None)
        starts = {"title": 0, "body": len(texts["title"]) + 1}
        places = {}
        for c, start in starts.items():
            for p, w in enumerate(texts[c], start):
                places.setdefault(w, []).append(p)
        weight = lambda p: 2.5 if p < starts["body"] else 1.0
        want = [lexical.cover_density(lexical.parse(q), places, weight) for q in QUERIES]
        assert np.array_equal(got, [np.nan if w is None else round(w, 6) for w in want], equal_nan=True), (texts, got, want)


@pytest.mark.parametrize("said", ["c a c b", "b a d c", "d c d"])
def test_covers_are_not_looked_for_without_a_phrase(said, monkeypatch):
    monkeypatch.setattr(lexical, "cover_density", lambda *_: pytest.fail("looked at"))
    block = lexical.Block.of([Row(query_id=1, query='"a b" c'), Row(query_id=2, query='"c d" -"x y" -d'), Row(query_id=3, query="b -a")])
    assert np.isnan(block.scores({"body": said.split()}, {"body": 1.0}, [], 0.0, None)).all()
