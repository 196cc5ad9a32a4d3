"""Keyed state with timers for streams of messages, on ``transformWithState``.

Times inside the state are microseconds of event time. A conversation that has been idle, by the watermark, is dropped from the state,
so the state is that of the conversations which are at work; a message that comes later opens the conversation anew."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Ids of messages in one entry of the state.
IDS = 1000


def use_rocksdb(spark: SparkSession) -> None:
    """State with several variables and timers needs this store; it is a setting of the session, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def microseconds(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1_000_000)


class Idle(StatefulProcessor):
    """The clock of a conversation: one timer, ``idle`` after its newest message."""

    def __init__(self, idle: int | None):
        self.idle = idle

    def start_clock(self, handle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "timer long")

    def wind(self, newest: int) -> None:
        """Move the timer to ``idle`` after the newest message, if that is later."""
        if self.idle is None:
            return
        at, was = (newest + self.idle) // 1000 + 1, self.clock.get()
        if was is not None:
            if was[0] >= at:
                return
            self.handle.deleteTimer(was[0])
        self.handle.registerTimer(at)
        self.clock.update((at,))

    def close(self) -> None:
        pass


class Newest(Idle):
    """The newest n messages of a conversation, one map entry each: a new message writes itself and removes the oldest.

    A message that is delivered again is either among them, and known by its id, or older than all of them."""

    def __init__(self, n: int, conv: str, idle: int | None):
        super().__init__(idle)
        self.n, self.conv = n, conv

    def init(self, handle) -> None:
        self.start_clock(handle)
        self.held = handle.getMapState("held", "turn long, id string", "role string, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {tuple(k): tuple(v) for k, v in self.held.iterator()}
        ids, new, newest = {k[1] for k in held}, {}, None
        for pdf in rows:
            for turn, id, role, text, at in zip(pdf["turn"].tolist(), pdf["id"], pdf["role"], pdf["text"], pdf["at"].tolist(), strict=True):
                newest = at if newest is None else max(newest, at)
                if id not in ids and not pd.isna(turn):
                    ids.add(id)
                    new[int(turn), id] = role, text
        self.wind(newest)
        both = held | new
        kept = sorted(both)[-self.n :]
        changed = [k for k in kept if k in new]
        for k in changed:
            self.held.updateValue(k, both[k])
        for k in set(held).difference(kept):
            self.held.removeKey(k)
        if changed:  # else nothing has changed
            yield pd.DataFrame({self.conv: [key[0]], "turns": [[k[0] for k in kept]], "roles": [[both[k][0] for k in kept]], "texts": [[both[k][1] for k in kept]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.clock.clear()
        yield from ()


class Listed(StatefulProcessor):
    """First and last time and number of the messages of a conversation while it is at work. Its timer follows from the last time.

    Ids of messages are kept until the watermark has passed them: what comes later is late, and dropped before it gets here. They are
    kept in runs of up to ``IDS``, in order of time, under the newest time of each: every call to the state is a message between processes,
    so one for each id would take most of the time. A run leaves the state when all of it has passed."""

    def __init__(self, conv: str, idle: int):
        self.conv, self.idle, self.most = conv, idle, IDS

    def init(self, handle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "opened long, first long, last long, messages long")
        self.seen = handle.getMapState("seen", "newest long, first string", "ids array<string>")

    def row(self, key, about: tuple, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({self.conv: [key[0]], "opened": [about[0]], "first": [about[1]], "last": [about[2]], "messages": [about[3]], "closed": [closed]})

    def keep(self, was: tuple | None, about: tuple) -> None:
        """What is known now, and the timer: ``idle`` after the last time."""
        self.about.update(about)
        if was is None or was[2] != about[2]:
            timer = lambda last: (last + self.idle) // 1000 + 1
            if was is not None:
                self.handle.deleteTimer(timer(was[2]))
            self.handle.registerTimer(timer(about[2]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for first, last, messages in zip(initialState["first"].tolist(), initialState["last"].tolist(), initialState["messages"].tolist(), strict=True):
            self.keep(self.about.get(), (first, first, last, messages))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        was, new = self.about.get(), {}
        held = [(tuple(k), v[0]) for k, v in self.seen.iterator()] if was is not None else []
        seen = {id for _, ids in held for id in ids}
        for pdf in rows:
            for id, at in zip(pdf["id"], pdf["at"].tolist(), strict=True):
                if at >= mark and id not in seen and id not in new:
                    new[id] = at
        for run, _ in held:
            if run[0] < mark:
                self.seen.removeKey(run)
        if not new:
            return
        ids = sorted(new, key=new.get)
        for a in range(0, len(ids), self.most):
            run = ids[a : a + self.most]
            self.seen.updateValue((new[run[-1]], run[0]), (run,))
        first, last = min(new.values()), max(new.values())
        about = (was[0], min(was[1], first), max(was[2], last), was[3] + len(new)) if was else (first, first, last, len(new))
        self.keep(was, about)
        yield self.row(key, about, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.about.exists():
            yield self.row(key, tuple(self.about.get()), True)
        self.about.clear()
        self.seen.clear()

    def close(self) -> None:
        pass


def newest_messages(messages: DataFrame, n: int, conv: str, at: str, id: str | None, ts: str | None, idle: str | None, late: str) -> DataFrame:
    """See ``conversations.rolling_context``."""
    use_rocksdb(messages.sparkSession)
    known = F.col(id).cast("string") if id else F.concat_ws(":", F.col(at).cast("string"), F.xxhash64("role", "text").cast("string"))
    timed = messages.withWatermark(ts, late) if ts else messages
    rows = timed.select(conv, *([ts] if ts else []), F.col(at).cast("long").alias("turn"), F.coalesce(known, F.lit("")).alias("id"), "role", "text", (F.unix_micros(F.col(ts).cast("timestamp")) if ts else F.lit(0).cast("long")).alias("at"))
    schema = T.StructType([messages.schema[conv], *T.StructType.fromDDL("turns array<bigint>, roles array<string>, texts array<string>")])
    return rows.groupBy(conv).transformWithStateInPandas(Newest(n, conv, microseconds(idle) if ts and idle else None), schema, "Update", "EventTime" if ts else "None")


def listed(messages: DataFrame, conv: str, ts: str, id: str, late: str, idle: str, stored: DataFrame | None) -> DataFrame:
    """See ``conversations.live_conversations``."""
    use_rocksdb(messages.sparkSession)
    rows = messages.withWatermark(ts, late).select(conv, ts, F.col(id).cast("string").alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    schema = T.StructType([messages.schema[conv], *T.StructType.fromDDL("opened bigint, first bigint, last bigint, messages bigint, closed boolean")])
    start = None
    if stored is not None:
        start = stored.select(conv, *(F.unix_micros(F.col(c).cast("timestamp")).alias(n) for c, n in (("created_at", "first"), ("last_at", "last"))), F.col("messages").cast("long").alias("messages")).groupBy(conv)
    found = rows.groupBy(conv).transformWithStateInPandas(Listed(conv, microseconds(idle)), schema, "Update", "EventTime", start)
    times = (F.timestamp_micros(c).alias(n) for c, n in (("opened", "opened_at"), ("first", "created_at"), ("last", "last_at")))
    return found.select(conv, *times, "messages", "closed")
