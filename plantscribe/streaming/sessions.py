"""Keyed streams with state and timers: chat sessions with their newest messages, and repeated questions held back.

State is kept for each key by ``transformWithStateInPandas``, in RocksDB, with event time and a watermark: rows that come later than LATENESS are
dropped, timers fire as the watermark passes them. A key's state is bounded: a session's figures and its last BUFFER messages, or one time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .jobs import replayable
from .telemetry import LATENESS

#: Seconds that a session lives after its last turn, messages that it keeps, seconds that a repeat is held back.
LIFETIME, BUFFER, HOLD = 3600, 20, 300
SECOND = 1_000_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


def _timer(time: int, seconds: int) -> int:
    """The first millisecond that is no earlier than so many seconds after a time in microseconds."""
    return -(-(time + SECOND * seconds) // 1000)


def _in_order(rows: Iterator[pd.DataFrame], mark: int) -> list[tuple[int, int]]:
    """``(microseconds, id)`` of the rows that aren't late, oldest first."""
    found = [(int(t), int(k)) for part in rows for t, k in zip(part["us"], part["id"], strict=True)]
    return sorted(x for x in found if x[0] >= 1000 * mark)


def _frame(rows: list[dict]) -> pd.DataFrame:
    """Texts as plain objects, which Arrow takes as they are."""
    found = pd.DataFrame(rows)
    return found.astype({c: object for c in found.columns if not pd.api.types.is_numeric_dtype(found[c])})


class Sessions(StatefulProcessor):
    """A session lives LIFETIME seconds beyond its last turn; each turn renews its timer. Open sessions are told as they change, and once when they end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.figures = handle.getValueState("figures", "start long, last long, n long")
        self.messages = handle.getListState("messages", "id long")

    def told(self, key: tuple, start: int, last: int, n: int, kept: list[int], state: str) -> dict:
        return {"session": key[0], "session_start": start, "expires": last + SECOND * LIFETIME, "n": n, "messages": kept, "state": state}

    def drop_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list[dict] = []
        now = self.figures.get() if self.figures.exists() else None
        start, last, n = now if now else (0, 0, 0)
        kept = [int(m[0]) for m in self.messages.get()] if n else []
        for t, k in _in_order(rows, timerValues.getCurrentWatermarkInMs()):
            if n and t >= last + SECOND * LIFETIME:
                out.append(self.told(key, start, last, n, kept, "ended"))
                n, kept = 0, []
            start, last, n = (min(start, t) if n else t), max(last if n else t, t), n + 1
            kept = [*kept, k][-BUFFER:]
        if n:
            self.figures.update((start, last, n))
            self.messages.put([(m,) for m in kept])
            self.drop_timers()
            self.handle.registerTimer(_timer(last, LIFETIME))
            out.append(self.told(key, start, last, n, kept, "open"))
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.figures.exists():
            start, last, n = self.figures.get()
            kept = [int(m[0]) for m in self.messages.get()]
            self.figures.clear()
            self.messages.clear()
            yield _frame([self.told(key, start, last, n, kept, "ended")])

    def close(self) -> None:
        pass


class Holder(StatefulProcessor):
    """The first question of a key passes; those within HOLD seconds of it don't, and don't lengthen the time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, out = (self.passed.get()[0] if self.passed.exists() else None), []
        for t, k in _in_order(rows, timerValues.getCurrentWatermarkInMs()):
            if last is None or t >= last + SECOND * HOLD:
                last = t
                out.append({"request": key[0], "us": t, "id": k})
        if out:
            self.passed.update((last,))
            self.handle.registerTimer(_timer(last, HOLD))
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.passed.exists() and _timer(self.passed.get()[0], HOLD) <= expiredTimerInfo.getExpiryTimeInMs():
            self.passed.clear()
        return iter(())

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, key: str, time: str, order: str, processor: StatefulProcessor, schema: str, name: str, root: str, late: str) -> StreamingQuery:
    spark: SparkSession = stream.sparkSession
    own = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    own = own.select(F.col(key).alias("key"), "_time", F.unix_micros("_time").alias("us"), F.col(order).cast("long").alias("id"))
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # read as the query starts
    try:
        found = own.groupBy("key").transformWithStateInPandas(processor, schema, "Update", "EventTime")
        return replayable(found, name, root, lambda rows, n: rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={n}"), "update")
    finally:
        spark.conf.set(STORE, before)


def chat_sessions(turns: DataFrame, root: str, session: str = "session", time: str = "ts", order: str = "id", late: str = LATENESS) -> StreamingQuery:
    """``session, session_start, expires, n, messages, state`` as sessions change; times in microseconds. Of a session the row of the newest batch holds."""
    kind = turns.schema[session].dataType.simpleString()
    schema = f"session {kind}, session_start long, expires long, n long, messages array<long>, state string"
    return _stateful(turns, session, time, order, Sessions(), schema, "sessions", root, late)


def without_repeats(questions: DataFrame, root: str, request: str = "request", time: str = "ts", order: str = "id", late: str = LATENESS) -> StreamingQuery:
    """``request, us, id`` of the questions that are worth an answer: the first of each key, and the first after HOLD seconds."""
    kind = questions.schema[request].dataType.simpleString()
    return _stateful(questions, request, time, order, Holder(), f"request {kind}, us long, id long", "passed", root, late)
