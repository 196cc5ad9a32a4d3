"""Conversations: lists, contexts, prompts, updates. Messages are rows (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions import text as X

#: Default settings, and the pieces of the chat templates.
SETTINGS = {"temperature": ("double", 0.5), "maxTokens": ("int", 2000), "topP": ("double", 1.0), "topK": ("int", 5), "contextLength": ("int", 6), "systemPrompt": ("string", "You're a helpful assistant.")}
TEMPLATES = {
    "deepseek": {"style": "deepseek", "system": "{system_message}", "roles": ("User", "Assistant"), "seps": ("\n\n", "<｜end▁of▁sentence｜>")},
    "llama-2": {"style": "llama2", "system": "[INST] <<SYS>>\n{system_message}\n<</SYS>>\n\n", "roles": ("[INST]", "[/INST]"), "seps": (" ", " </s><s>")},
    "plain": {"style": "plain", "system": "", "roles": ("", ""), "seps": ("", "")},
    "alignment": {"style": "alignment", "system": "", "roles": ("", ""), "seps": ("", "")},
}
IMAGE = "<image>\n"
IDLE = "600 seconds"


def settings(raw: Column) -> Column:
    """A struct of all settings from a JSON object, in camel or snake case, with defaults for what is missing."""

    def value(name: str, kind: str, default) -> Column:
        snake = "".join(f"_{c.lower()}" if c.isupper() else c for c in name)
        return F.coalesce(F.get_json_object(raw, f"$.{name}").try_cast(kind), F.get_json_object(raw, f"$.{snake}").try_cast(kind), F.lit(default)).alias(name)

    return F.struct(*(value(n, k, d) for n, (k, d) in SETTINGS.items()))


def accepted(messages: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(messages with a text, rejected ones with ``reason``)."""
    blank = X.is_blank(F.col(text))
    return messages.where(~blank), messages.where(blank).withColumn("reason", F.lit("No message provided"))


def admitted_images(images: DataFrame, most: int = 10 * 1024 * 1024) -> DataFrame:
    """``images(image_bytes, message)`` with a status: ok, or why it is refused."""
    status = F.when(F.col("image_bytes").isNull(), "Image file is required").when(F.col("message").isNull(), "Message prompt is required").when(F.length("image_bytes") > most, "Image file too large (max 10MB)").otherwise("ok")
    return images.withColumn("status", status)


def last_messages(messages: DataFrame, n: int = 6, at: str = "turn") -> DataFrame:
    """The newest n messages of each conversation, oldest first, as (conv_id, context array)."""
    newest = messages.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(at)))).where(F.col("_n") <= n)
    return newest.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(at, "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("context"))


def turn_contexts(messages: DataFrame, n: int = 6, at: str = "turn") -> DataFrame:
    """For every user message, the n messages before it, oldest first, and the message itself once."""
    w = Window.partitionBy("conv_id").orderBy(at).rowsBetween(-n, -1) if n else None
    history = F.collect_list(F.struct("role", F.col("text").alias("content"))).over(w) if n else F.array().cast("array<struct<role:string,content:string>>")
    return messages.withColumn("history", history).where("role = 'user'").select("conv_id", at, "history", F.col("text").alias("message"))


def requests(contexts: DataFrame, raw_settings: str | None = None) -> DataFrame:
    """``turn_contexts``'s rows with the request to a language model as JSON."""
    s = settings(F.col(raw_settings) if raw_settings else F.lit("{}"))
    sent = F.concat("history", F.array(F.struct(F.lit("user").alias("role"), F.col("message").alias("content"))))
    body = F.struct(sent.alias("messages"), F.struct(s["systemPrompt"].alias("system_prompt"), s["maxTokens"].alias("max_tokens"), s["temperature"].alias("temperature"), s["topP"].alias("top_p"), s["topK"].alias("top_k")).alias("settings"))
    return contexts.withColumn("request", F.to_json(body))


def ordered(messages: DataFrame, at: str = "turn") -> DataFrame:
    """(conv_id, system, texts): the system prompt ("" for none) and the other messages' texts in order."""
    rows = F.array_sort(F.collect_list(F.struct(at, "role", "text")))
    said = lambda keep: F.transform(F.filter("m", lambda m: keep(m["role"] == "system")), lambda m: m["text"])
    return messages.groupBy("conv_id").agg(rows.alias("m")).select("conv_id", F.array_join(said(lambda x: x), "\n").alias("system"), said(lambda x: ~x).alias("texts"))


def prompt(texts: Column, system: Column, template: str = "deepseek") -> Column:
    """The prompt of a conversation: texts alternate between the two roles; null or "" asks for an answer."""
    t = TEMPLATES[template]
    (user, bot), (sep, sep2) = t["roles"], t["seps"]
    role = lambda i: F.when(i % 2 == 0, F.lit(user)).otherwise(F.lit(bot))
    after = lambda i: F.when(i % 2 == 0, F.lit(sep)).otherwise(F.lit(sep2))
    shown = F.replace(F.lit(t["system"]), F.lit("{system_message}"), system)
    said = lambda m: F.coalesce(F.length(m) > 0, F.lit(False))
    if t["style"] == "deepseek":
        head = F.when(shown == "", "").otherwise(F.concat(shown, F.lit(sep)))
        one = lambda m, i: F.when(said(m), F.concat(role(i), F.lit(": "), m, after(i))).otherwise(F.concat(role(i), F.lit(":")))
    elif t["style"] == "llama2":
        head = F.when(system == "", "[INST] ").otherwise(shown)
        one = lambda m, i: F.when(said(m) & (i == 0), F.concat(m, F.lit(" "))).when(said(m), F.concat(role(i), F.lit(" "), m, after(i))).otherwise(role(i))
    else:
        head = F.lit("")
        alone = t["style"] == "alignment"
        one = lambda m, i: F.when(~said(m), F.lit("")).when((i % 2 == 0) & F.lit(alone), F.concat(F.lit(IMAGE), after(i))).otherwise(F.concat(m, after(i)))
    return F.concat(head, F.array_join(F.transform(texts, one), ""))


def current_round(text: Column, template: str = "deepseek") -> Column:
    """The prompt for one new message alone."""
    t = TEMPLATES[template]
    if t["style"] == "plain":
        return F.lit(IMAGE)
    if t["style"] != "deepseek":
        raise ValueError(f"no prompt of the current round for {template}")
    return F.concat(F.lit(f"{t['roles'][0]}: "), X.strip(text), F.lit(f"{t['seps'][0]}{t['roles'][1]}:"))


def message_array(texts: Column, system: Column) -> Column:
    """array<struct<role, content>>: the system prompt first, then user and assistant in turn; null answers left out."""
    one = F.transform(texts, lambda m, i: F.struct(F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), m.alias("content")))
    kept = F.filter(one, lambda m: (m["role"] == "user") | m["content"].isNotNull())
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), kept)


def pairs(texts: Column) -> Column:
    """array<struct<user, assistant>>: each user text and the answer after it, null for an open turn."""
    n = F.size(texts)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.get(texts, i).alias("user"), F.get(texts, i + 1).alias("assistant")))


def conversation_list(messages: DataFrame, conv: str = "conv_id", ts: str = "ts", text: str | None = None) -> DataFrame:
    """(conv, created_at, last_at, messages[, title]): first and last message times of each conversation."""
    title = [X.clean_title(F.min_by(text, ts)).alias("title")] if text else []
    return messages.groupBy(conv).agg(F.min(ts).alias("created_at"), F.max(ts).alias("last_at"), F.count("*").alias("messages"), *title)


def newest_first(conversations: DataFrame, last: str = "last_at", conv: str = "conv_id") -> DataFrame:
    return conversations.orderBy(F.desc_nulls_last(last), conv)


def oldest_first(messages: DataFrame, conv_id=None, at: str = "turn") -> DataFrame:
    """The messages of one conversation, or of all, in order."""
    return (messages if conv_id is None else messages.where(F.col("conv_id") == conv_id)).orderBy("conv_id", at)


def grouped_by_date(conversations: DataFrame, today: Column, last: str = "last_at") -> DataFrame:
    """``conversations`` with the group of a list and the group's place in it."""
    group = X.date_group(F.col(last), today)
    place = F.array_position(F.array(*map(F.lit, X.DATE_GROUPS)), F.col("date_group")).cast("int")
    return conversations.withColumn("date_group", group).withColumn("group_order", place)


def deleted(conversations: DataFrame, messages: DataFrame, ids: DataFrame, conv: str = "conv_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations left, messages left, status of each id): a conversation goes with its messages."""
    gone = ids.select(conv).distinct()
    known = conversations.select(conv).distinct().withColumn("_there", F.lit(True))
    status = gone.join(known, conv, "left").select(conv, F.when(F.col("_there"), "deleted").otherwise("not found").alias("status"))
    hit = gone.join(known, conv, "left_semi")
    return conversations.join(hit, conv, "left_anti"), messages.join(hit, conv, "left_anti"), status


def renamed(conversations: DataFrame, updates: DataFrame, conv: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(conversations with new titles, status of each update); blank titles are rejected, of several the largest counts."""
    good = updates.where(~X.is_blank(F.col("title"))).groupBy(conv).agg(F.max("title").alias("_new"))
    out = conversations.join(good, conv, "left").withColumn("title", F.coalesce("_new", "title")).drop("_new")
    known = conversations.select(conv).distinct().withColumn("_there", F.lit(True))
    status = updates.join(known, conv, "left").select(conv, F.when(X.is_blank(F.col("title")), "title missing").when(F.col("_there"), "renamed").otherwise("not found").alias("status"))
    return out, status


def busy_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = IDLE) -> DataFrame:
    """(key, start, end, requests): bursts of requests that are no more than ``gap`` apart; batch or stream."""
    s = F.session_window(ts, gap)
    return events.groupBy(key, s.alias("s")).agg(F.count("*").alias("requests")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "requests")
