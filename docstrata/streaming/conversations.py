"""Streams of messages: conversation list, rolling context, busy sessions. With availableNow they equal their batch twins;
sessions do so with ``flushed``, as those that the watermark has not passed are still open when such a query ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.operators import chat
from docstrata.streaming import stateful


def live_conversations(messages: DataFrame, conv: str = "conv_id", ts: str = "ts", id: str = "message_id", late: str = "1 hour", idle: str = "7 days", stored: DataFrame | None = None) -> DataFrame:
    """(conv, opened_at, created_at, last_at, messages, closed), for update mode: a row for each change of a conversation.

    A message that is delivered twice counts once. A conversation without messages for ``idle``, by the watermark, is closed: it is written once
    more, leaves the state, and opens anew (``opened_at``) with a later message. The query may start with ``stored`` conversations (conv, created_at,
    last_at, messages), which go on from there. ``current_list`` folds what is written into one row for each conversation."""
    return stateful.listed(messages, conv, ts, id, late, idle, stored)


def current_list(written: DataFrame, conv: str = "conv_id", stored: DataFrame | None = None) -> DataFrame:
    """(conv, created_at, last_at, messages) from the rows that ``live_conversations`` has written, in any order, and the stored
    conversations that the query started with. Counts only grow while a conversation is open, so the largest is the newest."""
    each = written.groupBy(conv, "opened_at").agg(F.min("created_at").alias("created_at"), F.max("last_at").alias("last_at"), F.max("messages").alias("messages"))
    if stored is not None:  # those that have not changed since
        rows = stored.select(conv, F.col("created_at").alias("opened_at"), "created_at", "last_at", F.col("messages").cast("long").alias("messages"))
        each = each.unionByName(rows).groupBy(conv, "opened_at").agg(F.min("created_at").alias("created_at"), F.max("last_at").alias("last_at"), F.max("messages").alias("messages"))
    return each.groupBy(conv).agg(F.min("created_at").alias("created_at"), F.max("last_at").alias("last_at"), F.sum("messages").alias("messages"))


def rolling_context(messages: DataFrame, n: int = 6, conv: str = "conv_id", at: str = "turn", id: str | None = None, ts: str | None = None, idle: str | None = "7 days", late: str = "1 hour") -> DataFrame:
    """(conv_id, turns, roles, texts): the newest n messages of a conversation after every batch that changes them, oldest first,
    ordered by ``at`` and then by id, whatever the order of arrival; for update mode.

    A message that is delivered again changes nothing; ``id`` names it, or else its place, role and text do. The state is n messages for each
    conversation, written one by one as they change. With event times ``ts`` a conversation ends after ``idle``, by the watermark; without,
    none ends. Messages without a place take no part."""
    return stateful.newest_messages(messages, n, conv, at, id, ts, idle, late)


def live_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = chat.IDLE, late: str = "1 hour") -> DataFrame:
    """``busy_sessions`` as a stream, for append mode: a session is emitted when the watermark has passed its end."""
    return chat.busy_sessions(events.withWatermark(ts, late), key, ts, gap)


def flushed(written: DataFrame, events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = chat.IDLE) -> DataFrame:
    """What ``live_sessions`` has written of a finite input, and the sessions that were open when the input ended. Sessions of
    a key are written in order of time, so that the open ones are those of the events after the last that was written."""
    last = written.groupBy(F.col(key).alias("_key")).agg(F.max("end").alias("_end"))
    rest = events.join(last, F.col(key).eqNullSafe(F.col("_key")), "left").where(F.col("_end").isNull() | (F.col(ts) >= F.col("_end")))
    return written.unionByName(chat.busy_sessions(rest.drop("_key", "_end"), key, ts, gap))
