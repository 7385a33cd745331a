"""The chunk broker with state that lasts, waits, and ends: sessions over a stream, as ``sessions.broker_positions`` has them in a table."""

from __future__ import annotations

import bisect
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import NumericType

#: What the state needs of a session, to be set before a query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Waiting steps in a row of the state, at most.
ROW_STEPS = 10_000


class Broker(StatefulProcessor):
    """A shard of sessions: how many steps each has placed, the steps that wait, and when it was last heard of.

    Calls to the store grow with the shards that a micro-batch touches, not with
    its sessions. Waiting steps are a list that is added to as they come, a row a
    session; it and the counters are written anew only when the watermark lets some
    of them go. A shard has one timer, for the first session that needs it.
    """

    def __init__(self, horizon: int, idle_ms: int, names: tuple[str, str], kind: str):
        self.horizon, self.idle_ms, self.names, self.kind = horizon, idle_ms, names, kind

    def init(self, handle) -> None:
        self.handle = handle
        self.placed = handle.getListState("placed", f"session {self.kind}, n bigint, last_ms bigint")
        self.waiting = handle.getListState("waiting", f"session {self.kind}, ms array<bigint>, t array<bigint>")

    def sessions(self, rows: pd.DataFrame) -> list:
        return [None if x is None or x is pd.NaT or x != x else x for x in rows[self.names[0]].tolist()]

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Sessions' counters out of a table with ``n``: they go on in mid-chunk. They aren't idle before they have begun."""
        if len(initialState):
            self.placed.appendList([(s, int(n) % self.horizon, None) for s, n in zip(self.sessions(initialState), initialState["n"].tolist(), strict=True)])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for part in rows:
            new: dict = {}
            for s, ms, t in zip(self.sessions(part), part["event_ms"].tolist(), part[self.names[1]].tolist(), strict=True):
                new.setdefault(s, []).append((ms, t))
            if new:  # else a shard of the initial state alone
                self.waiting.appendList([row for s, held in new.items() for row in as_rows(s, held)])
                first.append(min(ms for held in new.values() for ms, _ in held))
        if first:
            at, known = due(min(first), timerValues), list(self.handle.listTimers())
            if not any(x <= at for x in known):
                for x in known:
                    self.handle.deleteTimer(x)
                self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Places what the watermark has passed; forgets sessions that have nothing and have been idle."""
        mark = timerValues.getCurrentWatermarkInMs()
        placed = {s: (n, last_ms) for s, n, last_ms in self.placed.get()}
        waiting: dict = {}
        for s, times, steps in self.waiting.get():
            waiting.setdefault(s, []).extend(zip(times, steps, strict=True))
        known, out = len(placed), ([], [], [])
        for s, held in waiting.items():
            held.sort()
            ready = bisect.bisect_left(held, (mark,))  # a step within the watermark's own millisecond may yet be followed by an earlier one
            if ready:
                n, last_ms = placed.get(s, (0, None))
                out[0].extend([s] * ready)
                out[1].extend(t for _, t in held[:ready])
                out[2].extend((n + i) % self.horizon for i in range(ready))
                last = held[ready - 1][0]
                placed[s] = (n + ready) % self.horizon, last if last_ms is None else max(last, last_ms)
                del held[:ready]
        rest = {s: held for s, held in waiting.items() if held}
        idle = {s: last_ms + self.idle_ms for s, (_, last_ms) in placed.items() if s not in rest and last_ms is not None}
        over = [s for s, ms in idle.items() if ms <= mark]
        for s in over:
            del placed[s], idle[s]
        if out[0]:
            written(self.waiting, [row for s, held in rest.items() for row in as_rows(s, held)])
            session, t = self.names
            yield pd.DataFrame({session: pd.Series(out[0], dtype=object), t: out[1], "position": out[2], "infers": [x == 0 for x in out[2]]})
        if out[0] or over:
            written(self.placed, [(s, *x) for s, x in placed.items()])
        following = [held[0][0] for held in rest.values()] + list(idle.values())
        if following:
            self.handle.registerTimer(due(min(following), timerValues))

    def close(self) -> None:
        pass


def due(ms: int, timerValues) -> int:
    """Once the watermark has passed ``ms``; a timer of the past would never run."""
    return max(ms, timerValues.getCurrentWatermarkInMs()) + 1


def as_rows(session, held: list[tuple[int, int]]) -> list[tuple]:
    """Waiting steps as rows of the state, of bounded size."""
    parts = (held[i : i + ROW_STEPS] for i in range(0, len(held), ROW_STEPS))
    return [(session, [ms for ms, _ in x], [t for _, t in x]) for x in parts]


def written(state, rows: list[tuple]) -> None:
    state.put(rows) if rows else state.clear()


def session_broker(stream: DataFrame, horizon: int, *, session: str = "session", t: str = "t", ts: str = "ts", late: str = "10 minutes", idle_ms: int = 3_600_000, initial: DataFrame | None = None, shards: int = 4096) -> DataFrame:
    """``session, t, position, infers``: each step's place in the chunk that its session acts on.

    Steps may be ``late`` (by event time ``ts``, not null): one waits in state until
    the watermark has passed it, so positions are those of the batch form; later
    ones are dropped. A session without steps for ``idle_ms`` of event time is
    forgotten and begins a new chunk. ``initial``: a table ``session, n`` of steps
    that sessions have made before the query first starts. The state is kept
    through restarts. Sessions are dealt to ``shards`` by a hash, a task holds one
    at a time; a checkpoint keeps their number. The session must use the store in
    ``STATE_STORE``.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's worker doesn't see files sent to executors
    kind = stream.schema[session].dataType
    held, shard = "string" if isinstance(kind, NumericType) else kind.simpleString(), f"{session}_shard"  # pandas has no whole numbers with nulls

    def dealt(df: DataFrame, *columns: Column | str) -> GroupedData:
        named = F.col(session).cast(kind).cast(held).alias(session)
        return df.select(F.pmod(F.xxhash64(named), F.lit(shards)).cast("int").alias(shard), named, *columns).groupBy(shard)

    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    steps = dealt(timed, F.col(t).cast("long").alias(t), ts, F.unix_millis(ts).alias("event_ms"))  # names with a leading underscore don't reach the operator
    begun = dealt(initial, F.col("n").cast("long").alias("n")) if initial is not None else None
    out = steps.transformWithStateInPandas(Broker(horizon, idle_ms, (session, t), held), f"{session} {held}, {t} bigint, position bigint, infers boolean", "Append", "EventTime", begun)
    return out.withColumn(session, F.col(session).cast(kind))
