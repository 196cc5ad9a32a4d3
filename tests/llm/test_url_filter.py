"""URL filters against a loop over captures and entries."""

from __future__ import annotations

import datetime as dt
import random

from compare import DATA, compare
from pyspark.sql import functions as F

from docstrata.llm import url_filter as U

DAY = dt.date(2024, 1, 1)
CAPTURES = "page_id long, url string, day date"
ENTRIES = "list string, effect string, kind string, key string, day date, action string"


def brute(captures, entries):
    state = {}
    for name, effect, kind, key, day, action in sorted({e for e in entries if None not in e}):
        state.setdefault((name, effect, kind, key), []).append((day, action))
    out = []
    for page, url, day in captures:
        lists = set()
        if url and day:
            host = url.split("://", 1)[1].split("/")[0].split("#")[0].split("?")[0].split("@")[-1].lower() if "://" in url else None
            if host is not None:
                host = host[: host.index("]") + 1] if host.startswith("[") else host.split(":")[0].rstrip(".")
            address = host is not None and set(host) <= {*"0123456789."} or (host or "").startswith("[")
            for (name, effect, kind, key), changes in state.items():
                hit = url.split("#")[0] == key if kind == "url" else host is not None and (host == key or kind == "domain" and not address and host.endswith("." + key))
                now = None
                for d, action in sorted(changes):
                    now = action if d <= day else now
                if hit and now == "add":
                    lists.add((name, effect))
        effects = {e for _, e in lists}
        out.append((page, ",".join(sorted({n for n, _ in lists})), "block" in effects and "allow" not in effects))
    return sorted(out, key=repr)


def test_against_loop(spark):
    rng = random.Random(3)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.org", "HOT.net"]
    captures = [(i, f"http://{rng.choice(hosts)}/p{rng.randint(0, 3)}{rng.choice(('', '#top'))}", DAY + dt.timedelta(rng.randint(0, 30))) for i in range(400)]
    captures += [(900, None, DAY), (901, "http://x.org/", None), (902, "no url", DAY), (903, "http://u@x.org:80?q", DAY), (0, captures[0][1], captures[0][2])]
    captures += [(910 + i, u, DAY + dt.timedelta(15)) for i, u in enumerate(("http://[2001:db8::1]:80/x", "http://A.Example.com./p", "http://10.0.0.1/", "https://u:p@10.0.0.1:8/", "http:///none"))]
    keys = {"host": ["a.example.com", "hot.net", "x.org"], "domain": ["example.com", "x.org", "net"], "url": ["http://x.org/p1", "http://HOT.net/p2"]}
    entries = []
    for _ in range(120):
        kind = rng.choice(list(keys))
        name = rng.choice(("one", "two", "ok"))
        entries.append((name, "allow" if name == "ok" else "block", kind, rng.choice(keys[kind]), DAY + dt.timedelta(rng.randint(0, 30)), rng.choice(("add", "remove"))))
    entries = [e for e in entries if e[3] != "net"] + [("one", "block", "host", None, DAY, "add"), ("one", "block", "host", "x.org", None, "add"), entries[0] if entries[0][3] != "net" else entries[1]]
    entries += [("one", "block", "host", "[2001:db8::1]", DAY, "add"), ("two", "block", "host", "10.0.0.1", DAY, "add"), ("one", "block", "domain", "0.1", DAY, "add")]
    clashes = {c: F.lit(f"my {c}") for c in ("key", "kind", "opened", "row", "host", "_host", "at", "all", "by_host", "lists", "blocked")}
    found = U.decide(spark.createDataFrame(captures, CAPTURES).withColumns(clashes), spark.createDataFrame(entries, ENTRIES))
    assert found.columns == ["page_id", "url", "day", *(c for c in clashes if c not in ("lists", "blocked")), "lists", "blocked"]
    assert all(r[c] == f"my {c}" for r in found.take(5) for c in clashes if c not in ("lists", "blocked"))
    assert sorted(((r.page_id, r.lists, r.blocked) for r in found.collect()), key=repr) == brute(captures, entries)


def test_intervals(spark):
    day = lambda n: DAY + dt.timedelta(n)
    steps = [(1, "remove"), (2, "add"), (3, "add"), (5, "remove"), (5, "add"), (8, "add"), (8, "add"), (9, "remove")]
    found = U.intervals(spark.createDataFrame([("l", "block", "host", "h", day(n), a) for n, a in steps], ENTRIES))
    assert sorted((r.opened, r.closed) for r in found.collect()) == [(day(2), day(5)), (day(8), day(9))]


def test_empty(spark):
    none, entries = spark.createDataFrame([], CAPTURES), spark.createDataFrame([], ENTRIES)
    assert U.decide(none, entries).collect() == []
    one = U.decide(spark.createDataFrame([(1, "http://a.b/", DAY)], CAPTURES), entries).first()
    assert (one.lists, one.blocked) == ("", False)


def test_query(spark):
    assert compare(spark, "op8_url_filter", U.op8_url_filter, U.OP8_SQL, str(DATA / "sf0.01")) == ""


def test_a_key_that_switches_often(spark):
    """As many intervals as days cost a row each, whatever the number of hosts; columns named like the results, in any case, are replaced."""
    days = 400
    entries = spark.range(days * 2).select(F.lit("a").alias("list"), F.lit("block").alias("effect"), F.lit("domain").alias("kind"), F.lit("x.org").alias("key"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.when(F.col("id") % 2 == 0, "add").otherwise("remove").alias("action"))
    captures = spark.range(days * 2).select("id", F.concat(F.lit("http://h"), (F.col("id") % 7).cast("string"), F.lit(".x.org/")).alias("url"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.lit(1).alias("Lists"), F.lit(2).alias("BLOCKED"))
    found = U.decide(captures, entries)
    assert found.columns == ["id", "url", "day", "lists", "blocked"] and found.select("lists").count() == days * 2
    assert all(r.blocked == (r.id % 2 == 0) for r in found.collect())
    asked = captures.select(F.lit("domain").alias("kind"), F.lit("x.org").alias("key"), F.col("day").alias("at"))
    assert U.as_of(asked.union(asked), U.intervals(entries)).count() == days
