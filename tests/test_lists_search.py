"""Search of inverted lists: the queries of a list go to the tasks once, not with every unit."""

import numpy as np

from docketry.operators import search, vectors


def test_all_lists_find_what_the_exact_search_finds(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)] if i % 50 else None) for i in range(3 * vectors.SLICE)]
    units = spark.createDataFrame(rows, "unit long, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(i, v) for i, v in rows if i % 40 == 1], "query_id long, q array<float>")
    middle, probes = vectors.fitted(units, 8, 25)
    lists = vectors.inverted_lists(units, middle)
    found = vectors.approximate(asked, lists, middle, 25, len(middle))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "__asked" not in plan
    exact = {(r.query_id, r.unit): r.score for r in search.vector(asked, units, 25).collect()}
    assert {(r.query_id, r.unit): r.score for r in search.vector_lists(asked, lists, middle, 25, len(middle)).collect()} == exact
    assert len(exact) == 25 * asked.count()
    wanted = vectors.probed(np.array([r.q for r in asked.collect()], dtype=float), middle, probes)
    assert wanted.shape == (len(middle), asked.count()) and (wanted.sum(axis=0) == probes).all()
