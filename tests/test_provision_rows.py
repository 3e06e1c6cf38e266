"""References of provisions, each once, by their columns."""

from docketry.operators import facts


def test_rows_are_told_apart_by_their_columns(spark):
    body = "Under section 3 and 7A of the SEBI Act it was held. Under section 3 of the SEBI Act."
    units = spark.createDataFrame([(None, body), ("", body), ("a", body), ("a", body), ("b", None)], "id string, body string")
    found = facts.provisions(units, "id", "body")
    rows = found.collect()
    assert sorted((str(r.id), r.kind, r.statute, r.reference) for r in rows) == sorted((i, "Section", "SEBI Act, 1992", n) for i in ("None", "", "a") for n in ("3", "7A"))
    assert len({r.row_sha for r in rows}) == 4 and all(len(r.row_sha) == 64 for r in rows)
    dealt = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line]
    assert dealt and not any("row_sha" in line for line in dealt)
