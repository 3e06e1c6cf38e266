"""The target with most shared words, against a plain version."""

import re

from docketry.operators import relational


def test_best_target(spark):
    links = [(n, ["a", "b", "a", None][: n % 5]) for n in range(40)] + [(40, ["c", "d"]), (40, ["d"]), (41, None), (42, ["zz"]), (None, ["b"])]
    targets = [("t1", ["b", "a"]), ("t0", ["a", "b"]), ("t2", ["a"]), ("t2", ["c", "a"]), ("t3", ["d", "d"]), ("t4", None), ("t5", ["c", "d", "e"]), ("t6", ["d", "c"])]
    score = {}
    for link, own in links:
        for target, words in targets:
            if n := len({w for w in own or () if w is not None} & set(words or ())):
                score[link, target] = score.get((link, target), 0) + n
    want = {link: min((-n, target) for (x, target), n in score.items() if x == link) for link in {x for x, _ in score}}
    a, b = spark.createDataFrame(links, "link long, words array<string>"), spark.createDataFrame(targets, "target string, words array<string>")
    found = relational.best_target(a, b, "link", "target", "words")
    rows = found.collect()
    assert len(rows) == len(want) and {r.link: (-r.score, r.target) for r in rows} == want
    # scores are counted for words, not for links
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[__words#\d+, target#", plan) and not re.search(r"Aggregate \[link#\d+L?, target#", plan)
