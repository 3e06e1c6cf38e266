"""State of sessions as a stream: what each session's last grounded turn was about, folded micro-batch by micro-batch.

Run it with the RocksDB state store (spark.sql.streaming.stateStore.providerClass). The result after any number of micro-batches, with restarts
between them, is that of operators.matters.session_state() over all rows so far."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ID, _TEXT = T.LongType(), T.StringType()
CONTEXT = T.StructType([*(T.StructField(c, _ID) for c in ("session_id", "turn", "place", "chunk_id", "document_id")), T.StructField("record_key", _TEXT), T.StructField("title", _TEXT), T.StructField("cited", T.BooleanType())])
_LISTS = (("document_ids", _ID), ("record_keys", _TEXT), ("titles", _TEXT), ("cited_chunk_ids", _ID), ("chunk_ids", _ID))
STATE = T.StructType([T.StructField("session_id", _ID), T.StructField("turn", _ID), *(T.StructField(c, T.ArrayType(t)) for c, t in _LISTS), T.StructField("primary_title", _TEXT)])
_HELD = T.StructType(CONTEXT.fields[1:])


def folded(rows: list[tuple]) -> tuple[list[tuple], tuple | None]:
    """The rows that may still count (of the last grounded turn and later ones), and the state, None before any turn is grounded.

    rows: turn, place, chunk_id, document_id, record_key, title, cited, in any order."""
    grounded = max((r[0] for r in rows if r[6] and r[0] is not None), default=None)
    if grounded is None:
        return rows, None
    own = sorted((r for r in rows if r[0] == grounded), key=lambda r: tuple((v is not None, v) for v in r))
    listed = lambda k, some: list(dict.fromkeys(r[k] for r in some))
    cited = [r for r in own if r[6]]
    titles = listed(5, cited)
    state = grounded, listed(3, cited), listed(4, cited), titles, listed(2, cited), listed(2, own), titles[0] if titles else None
    return [r for r in rows if r[0] is not None and r[0] >= grounded], state


class SessionFold(StatefulProcessor):
    """Keeps a session's rows from its last grounded turn on; emits its state when it has changed. Idle sessions are forgotten after ``idle_ms``, if given."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", _HELD, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        held, state = folded(before + [tuple(r[c] for c in _HELD.names) for r in rows])
        self.rows.put(held)
        if state is not None and state != folded(before)[1]:
            yield Row(**dict(zip(STATE.names, (key[0], *state), strict=True)))

    def close(self) -> None:
        pass


def session_states(context: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A stream of CONTEXT's columns to a stream of changed states, one a session and micro-batch at most."""
    rows = context.select(*CONTEXT.names).where("session_id is not null")
    return rows.groupBy("session_id").transformWithState(SessionFold(idle_ms), STATE, "Update", "ProcessingTime" if idle_ms else "None")
