from __future__ import annotations

import datetime as dt
import json
import time

from pyspark.sql import functions as F

from docstrata.operators import chat
from docstrata.streaming import conversations as live
from docstrata.streaming import stateful

MESSAGES = "conv_id long, turn long, role string, text string"


def prompt(spark, texts, system="", template="deepseek"):
    df = spark.createDataFrame([(texts, system)], "texts array<string>, system string")
    return df.select(chat.prompt(F.col("texts"), F.col("system"), template).alias("p")).first().p


def test_prompts(spark):
    end = "<｜end▁of▁sentence｜>"
    texts = ["Hello!", "Hi! This is Tony.", "Who are you?", "I am a helpful assistant.", "How are you?", None]
    assert prompt(spark, texts) == f"User: Hello!\n\nAssistant: Hi! This is Tony.{end}User: Who are you?\n\nAssistant: I am a helpful assistant.{end}User: How are you?\n\nAssistant:"
    assert prompt(spark, ["a"], "S") == "S\n\nUser: a\n\n"
    assert prompt(spark, ["a", "b", "c", None], "", "llama-2") == "[INST] a [/INST] b </s><s>[INST] c [/INST]"
    assert prompt(spark, ["a"], "S", "llama-2") == "[INST] <<SYS>>\nS\n<</SYS>>\n\na "
    assert prompt(spark, ["a", "b"], "", "plain") == "ab" and prompt(spark, ["a", "b"], "", "alignment") == "<image>\nb"


def test_message_forms(spark):
    df = spark.createDataFrame([(["a", "b", "c", None],)], "t array<string>")
    r = df.select(chat.message_array(F.col("t"), F.lit("S")).alias("m"), chat.pairs(F.col("t")).alias("p"), chat.current_round(F.lit(" q ")).alias("c")).first()
    assert [(m.role, m.content) for m in r.m] == [("system", "S"), ("user", "a"), ("assistant", "b"), ("user", "c")]
    assert [(p.user, p.assistant) for p in r.p] == [("a", "b"), ("c", None)] and r.c == "User: q\n\nAssistant:"


def test_settings(spark):
    df = spark.createDataFrame([('{"temperature": 0.1, "max_tokens": 7}',), (None,)], "s string")
    a, b = (r.s for r in df.select(chat.settings(F.col("s")).alias("s")).collect())
    assert (a.temperature, a.maxTokens, a.topK) == (0.1, 7, 5) and b.contextLength == 6 and b.systemPrompt.startswith("You're")


def test_requests_hold_the_message_once(spark):
    m = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(9)], MESSAGES)
    sent = {r.turn: json.loads(r.request) for r in chat.requests(chat.turn_contexts(m, 3)).collect()}
    assert [x["content"] for x in sent[8]["messages"]] == ["t5", "t6", "t7", "t8"] and [x["content"] for x in sent[0]["messages"]] == ["t0"]
    assert [x["content"] for x in json.loads(chat.requests(chat.turn_contexts(m, 0)).orderBy("turn").first().request)["messages"]] == ["t0"]


def test_updates(spark):
    convs = spark.createDataFrame([(1, "a"), (2, "b")], "conv_id long, title string")
    m = spark.createDataFrame([(1, 0, "user", "x"), (2, 0, "user", "y")], MESSAGES)
    out, status = chat.renamed(convs, spark.createDataFrame([(1, "new"), (3, "z"), (2, " ")], "conv_id long, title string"))
    assert {r.conv_id: r.title for r in out.collect()} == {1: "new", 2: "b"}
    assert {r.conv_id: r.status for r in status.collect()} == {1: "renamed", 2: "title missing", 3: "not found"}
    left, kept, status = chat.deleted(convs, m, spark.createDataFrame([(1,), (9,)], "conv_id long"))
    assert [r.conv_id for r in left.collect()] == [2] and [r.conv_id for r in kept.collect()] == [2]
    assert {r.conv_id: r.status for r in status.collect()} == {1: "deleted", 9: "not found"}


def test_rejects(spark):
    good, bad = chat.accepted(spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "user", " "), (1, 2, "user", None)], MESSAGES))
    assert good.count() == 1 and {r.reason for r in bad.collect()} == {"No message provided"}
    images = spark.createDataFrame([(None, "m"), (b"x", None), (b"x", "m"), (b"xxx", "m")], "image_bytes binary, message string")
    assert [r.status for r in chat.admitted_images(images, 2).collect()] == ["Image file is required", "Message prompt is required", "ok", "Image file too large (max 10MB)"]


def test_streams_equal_batch(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}-{t}") for c in range(5) for t in range(9)]
    for n, part in enumerate((rows[::2], rows[1::2])):
        spark.createDataFrame(part, MESSAGES).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    source = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = {}

    def keep(batch, _):
        got.update({r.conv_id: r.texts for r in batch.collect()})

    live.rolling_context(source, 4).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    batch = chat.last_messages(spark.createDataFrame(rows, MESSAGES), 4)
    assert got == {r.conv_id: [m.content for m in r.context] for r in batch.collect()}


def play(spark, tmp_path, batches, schema, make):
    """Rows that a stream writes, a list for each batch of its input; and the rows of state after each."""
    for n, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
        time.sleep(0.01)  # files are read in the order of their times
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = []
    q = make(source).writeStream.foreachBatch(lambda b, _: out.append(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return out, [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress]


T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


TIMED = "conv_id long, turn int, role string, text string, message_id string, ts timestamp"


def test_context_survives_redelivery_and_expires(spark, tmp_path):
    message = lambda c, t, h: (c, t, "user", f"{c}-{t}", f"m{c}.{t}", at(h))
    batches = [[message(1, t, t / 10) for t in range(5)], [message(1, 4, 0.4), message(1, 0, 0.0)], [message(1, 5, 0.5), message(1, 4, 0.4)], [message(2, 0, 50)], [message(2, 1, 50.1)], [message(1, 9, 50.2)], [message(1, 9, 50.2)]]
    out, _ = play(spark, tmp_path, batches, TIMED, lambda s: live.rolling_context(s, 3, id="message_id", ts="ts", idle="5 hours", late="1 hour"))
    found = [[(r.conv_id, r.texts) for r in b] for b in out]
    assert [b for b in found if b] == [[(1, ["1-2", "1-3", "1-4"])], [(1, ["1-3", "1-4", "1-5"])], [(2, ["2-0"])], [(2, ["2-0", "2-1"])], [(1, ["1-9"])]]


def test_conversations_close_and_open_again(spark, tmp_path):
    """Totals equal the batch operator's, whatever was closed meanwhile; the state only holds what is at work."""
    schema = "conv_id long, message_id string, ts timestamp"
    row = lambda c, i, h: (c, f"{c}.{i}", at(h))
    batches = [[row(day, i, 24 * day + i) for i in range(3)] + [row(day, 0, 24 * day)] for day in range(12)]
    batches[9].append(row(0, 7, 24 * 9))  # opens a closed conversation again
    batches[10].append(row(0, 7, 24 * 9))  # delivered again
    batches[11].append(row(5, 99, 0))  # late
    stored = spark.createDataFrame([(0, at(-5), at(-1), 4), (77, at(-9), at(-8), 2)], "conv_id long, created_at timestamp, last_at timestamp, messages long")
    out, state = play(spark, tmp_path, batches, schema, lambda s: live.live_conversations(s, late="1 hour", idle="20 hours", stored=stored))
    written = spark.createDataFrame([r for b in out for r in b])
    rows = spark.createDataFrame([r for b in batches for r in b][:-1], schema).dropDuplicates(["message_id"])
    wanted = {r.conv_id: (r.created_at, r.last_at, r.messages) for r in chat.conversation_list(rows).collect()} | {77: (at(-9), at(-8), 2)}
    wanted[0] = (at(-5), wanted[0][1], wanted[0][2] + 4)
    assert {r.conv_id: (r.created_at, r.last_at, r.messages) for r in live.current_list(written, stored=stored).collect()} == wanted
    assert written.where("closed and conv_id = 0").count() >= 1 and written.where("conv_id = 0").select("opened_at").distinct().count() == 2
    assert max(state[4:]) <= max(state[:4]) + 6  # it doesn't grow with the conversations


def test_ids_are_kept_in_runs(spark, tmp_path, monkeypatch):
    """The state has an entry for each run of ids, not for each id; a redelivery is known in every run, and runs leave when the watermark has passed them."""
    monkeypatch.setattr(stateful, "IDS", 10)
    row = lambda i: (1, f"m{i}", at(i / 100))
    batches = [[row(i) for i in range(95)], [row(i) for i in range(0, 95, 3)] + [row(95)], [row(500)], [row(501)], [row(501), row(500)]]
    out, state = play(spark, tmp_path, batches, "conv_id long, message_id string, ts timestamp", lambda s: live.live_conversations(s, late="1 hour", idle="20 hours"))
    assert [r.messages for b in out for r in b] == [95, 96, 97, 98]
    assert max(state) <= 14 and state[-1] < state[0]  # ten runs, an eleventh, and what is known of the conversation


def test_sessions_and_late_events(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = [(1, start + dt.timedelta(seconds=s)) for s in (0, 600, 1201, 5000)] + [(2, start), (2, start + dt.timedelta(days=3))]
    events = spark.createDataFrame(at, "user_id long, ts timestamp")
    batch = sorted((r.user_id, r.requests) for r in chat.busy_sessions(events).collect())
    assert batch == [(1, 1), (1, 1), (1, 2), (2, 1), (2, 1)]
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = []
    live.live_sessions(source).writeStream.foreachBatch(lambda b, _: out.extend((r.user_id, r.requests) for r in b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == [(1, 1), (1, 1), (1, 2), (2, 1)]  # the last is still open


def test_flushed_sessions_equal_batch(spark):
    """Open sessions, of a busy key, a key never written and a null key, are neither lost nor doubled."""
    start = dt.datetime(2024, 1, 1)
    at = [(k, start + dt.timedelta(seconds=s)) for k in (1, None) for s in (0, 600, 1201, 90_000, 90_500, 91_000)] + [(2, start + dt.timedelta(seconds=91_000))]
    events = spark.createDataFrame(at, "user_id long, ts timestamp")
    every = chat.busy_sessions(events)
    written = every.where(F.col("end") < F.lit(start + dt.timedelta(seconds=87_400)))
    assert written.count() == 4 and every.count() == 7
    assert sorted(map(repr, live.flushed(written, events).collect())) == sorted(map(repr, every.collect()))
