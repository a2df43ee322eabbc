"""Streams with state of their own: sessions that end when nothing touches them, calls whose cost is known late.

State lies in RocksDB and ends by timers, so it holds what is open, not what has been; a query that starts again from
its checkpoint goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that these operators need, for the session.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_EXPIRED = T.StructType([T.StructField("session", T.StringType()), T.StructField("last_seen", T.LongType())])
_BOOKED = T.StructType([T.StructField("call", T.LongType()), T.StructField("at", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("requests", T.IntegerType())])


def prepare(spark: SparkSession) -> None:
    for k, v in STORE.items():
        spark.conf.set(k, v)


class _Timed(StatefulProcessor):
    """One timer for each key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def wake(self, at: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class _Idle(_Timed):
    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("stopped", T.BooleanType())])

    def __init__(self, most: int):
        self.most = most

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, stopped = self.state.get() if self.state.exists() else (-1, False)
        for r in rows:
            # of equal times running counts: what is in doubt isn't ended
            if r["ms"] > at or (r["ms"] == at and r["status"] != "stopped"):
                at, stopped = r["ms"], r["status"] == "stopped"
        self.state.update((at, stopped))
        self.wake(at + self.most + 1 if stopped else None)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        at, stopped = self.state.get()
        if stopped:
            self.state.clear()
            yield Row(session=key[0], last_seen=at)


class _Bookings(_Timed):
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("at", "tokens", "ended", "used")])

    def __init__(self, window: int, open_for: int):
        self.window, self.open_for = window, open_for

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, tokens, ended, used = self.state.get() if self.state.exists() else (None,) * 4
        for r in rows:
            if r["tokens"] is not None:
                at, tokens = r["ms"], r["tokens"]
            else:
                ended, used = r["ms"], r["used"]
        if at is None or ended is None:
            self.state.update((at, tokens, ended, used))
            self.wake((ended if at is None else at) + self.open_for)
            return
        self.state.clear()
        self.wake(None)
        late = ended - at > self.window
        yield Row(call=key[0], at=ended if late else at, tokens=used, requests=0 if late else 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        at, tokens, ended, used = self.state.get()
        self.state.clear()
        yield Row(call=key[0], at=ended, tokens=used, requests=0) if at is None else Row(call=key[0], at=at, tokens=tokens, requests=1)


def _timed(stream: DataFrame, late: str) -> DataFrame:
    return stream.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))


def expired(stream: DataFrame, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """session and last_seen of sessions that stopped and that nothing has touched for more than so many seconds.

    stream: session, status, ts.  The last status counts; a session that is touched again begins anew, also after it
    was reported.  Time is the events' own, so state ends with the watermark.
    """
    out = _timed(stream, late).groupBy("session").transformWithState(_Idle(seconds * 1000), _EXPIRED, "Append", "EventTime")
    return out.select("session", F.timestamp_millis("last_seen").alias("last_seen"))


def bookings(stream: DataFrame, window: int = 60, open_for: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """call, ts, tokens and requests of each call once its cost is known.

    stream: call, ts and either tokens (a reservation) or used (a completion, ts is its end), in any order.  A call that
    ends within window seconds is booked at its begin with what it used; one that ends later at its end and without a
    request, as its reservation has left the window.  A reservation without a completion is booked as reserved after
    open_for seconds; a completion whose reservation is unknown by then at its end without a request.
    """
    rows = _timed(stream.select("call", "ts", "tokens", "used"), late)
    out = rows.groupBy("call").transformWithState(_Bookings(window * 1000, open_for * 1000), _BOOKED, "Append", "EventTime")
    return out.select("call", F.timestamp_millis("at").alias("ts"), "tokens", "requests")
