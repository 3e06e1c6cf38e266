"""The stream of session states against the batch operator, in several micro-batches and with a restart half-way."""

from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.operators import matters
from docketry.streaming import states


def context(n, salt):
    return [(k % 7, k // 21, k * 5 % 11, k + 100 * salt, k % 4, f"r{k % 3}", f"Title {k % 5}", (k + salt) % 4 == 0) for k in range(salt * 40, salt * 40 + n)]


def plain(rows):
    names = ("document_ids", "record_keys", "titles", "cited_chunk_ids", "chunk_ids")
    return {r.session_id: (r.turn, *[[str(v) for v in r[c]] for c in names], r.primary_title) for r in rows}


def test_the_stream_ends_where_the_batch_does(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", states.STORE)
    latest, folder, seen = {}, str(tmp_path / "in"), []

    def keep(df, batch):
        rows = df.collect()
        seen.append((batch, len(rows)))
        latest.update(plain(rows))

    def run():
        stream = spark.readStream.schema(states.CONTEXT).option("maxFilesPerTrigger", 1).parquet(folder)
        query = states.session_states(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    try:
        rows = []
        for salt in range(2):
            rows += context(40, salt)
            spark.createDataFrame(context(40, salt), states.CONTEXT).coalesce(1).write.mode("append").parquet(folder)
        run()
        first = len(seen)
        rows += [*context(40, 2), (3, 99, 1, 1, 1, "r", "Last", True), (3, 98, 1, 2, 2, "q", "Late", True), (4, 0, 1, 9, 9, "q", "Old", True), (8, 5, 1, 1, None, None, None, False), (9, 1, 2, 1, 7, None, None, True)]
        spark.createDataFrame(rows[80:], states.CONTEXT).coalesce(1).write.mode("append").parquet(folder)
        run()
        assert first >= 1 and len(seen) > first
        assert latest == plain(matters.session_state(spark.createDataFrame(rows, states.CONTEXT)).collect())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


ROWS = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 5), st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.sampled_from("ab")), st.one_of(st.none(), st.sampled_from("xy")), st.booleans()), max_size=20)


@settings(deadline=None)
@given(ROWS, st.lists(st.integers(0, 20), max_size=3))
def test_folding_in_parts_is_folding_at_once(rows, cuts):
    held = []
    for a, b in zip([0, *sorted(cuts)], [*sorted(cuts), len(rows)], strict=True):
        held, state = states.folded(held + rows[a:b])
    assert state == states.folded(rows)[1]


def test_rows_without_a_turn():
    assert states.folded([(None, 1, 1, 1, "a", "t", True)]) == ([(None, 1, 1, 1, "a", "t", True)], None)
