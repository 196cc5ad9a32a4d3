"""URL filters whose lists change: a temporal list join.

Dated list entries (add or remove of a host, a domain or a URL) become validity intervals, disjoint for each list and
key. Every capture meets the intervals that were open when it was fetched, by an as-of join: the days that a key is asked about and
the starts of its intervals are sorted together, and each day carries the interval that started last. A key costs a row for each day, list and
interval, however many hosts or captures ask; the answers go to the distinct (host, day) pairs and from there to the
captures. An ``allow`` list that matches overrides all ``block`` lists.

Cases: an entry takes effect on its day; several of one day apply in the order add, remove; a remove without an add, and
an add of what is there, change nothing; a capture with a null or unreadable URL or a null day matches nothing and is not
blocked; captures that repeat are decided each; host names are compared in lower case and without a dot at their end, an address
in brackets or of digits has no domains above it, URLs are compared as they are without their fragment; columns of the
captures named ``lists`` or ``blocked``, in any case, are replaced, all others stay, whatever their names. Empty lists block nothing, an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null without one."""
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(host != "", host)


def plain_url(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, effect, kind, key, opened, closed) from entries(list, effect, kind, key, day, action); closed may be null."""
    known = entries.where("key is not null and day is not null and action in ('add', 'remove')").distinct()
    in_order = Window.partitionBy("list", "effect", "kind", "key").orderBy("day", "action")
    changes = known.withColumn("was", F.lag("action").over(in_order)).where("action <> coalesce(was, 'remove')")
    opened = changes.withColumn("closed", F.lead("day").over(in_order)).where("action = 'add'")
    return opened.select("list", "effect", "kind", "key", F.col("day").alias("opened"), "closed").where("closed is null or closed > opened")


def suffixes(host: Column) -> Column:
    """The domains that a host belongs to, itself included, the bare top level excluded."""
    parts = F.split(host, r"\.")
    address = host.rlike(r"^(?:\[.*\]|[0-9.]+)$")
    return F.when(address, F.array(host)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0))), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), ".")))


def as_of(asked: DataFrame, open_: DataFrame) -> DataFrame:
    """(kind, key, at, list, effect): the lists that were open for each distinct (kind, key, at) of ``asked``."""
    by = ["list", "effect", "kind", "key"]
    days = asked.select("kind", "key", "at").distinct().join(open_.select(*by).distinct(), ["kind", "key"])
    starts = open_.select(*by, F.col("opened").alias("at"), F.struct("opened", "closed").alias("started"), F.lit(False).alias("ask"))
    both = days.select(*by, "at", F.lit(None).cast(starts.schema["started"].dataType).alias("started"), F.lit(True).alias("ask")).unionByName(starts)
    newest = F.last("started", ignorenulls=True).over(Window.partitionBy(*by).orderBy("at", "ask"))
    found = both.select(*by, "at", "ask", newest.alias("newest")).where(F.col("ask") & F.col("newest").isNotNull() & (F.col("newest.closed").isNull() | (F.col("at") < F.col("newest.closed"))))
    return found.select("kind", "key", "at", "list", "effect")


def decide(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """``captures`` with ``lists`` (names of the matching lists, sorted, comma-joined) and ``blocked``."""
    open_ = intervals(entries)
    asked = captures.select(F.struct(*captures.columns).alias("row"), host_of(F.col(url)).alias("host"), plain_url(F.col(url)).alias("plain"), F.col(day).alias("at"))
    pairs = asked.where("host is not null and at is not null").select("host", "at").distinct()
    keys = F.concat(F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("key"))), F.transform(suffixes(F.col("host")), lambda s: F.struct(F.lit("domain").alias("kind"), s.alias("key"))))
    probes = pairs.select("host", "at", F.explode(keys).alias("p")).select("host", "at", "p.*")
    urls = asked.where("plain is not null and at is not null").select("at", F.lit("url").alias("kind"), F.col("plain").alias("key")).distinct()
    active = as_of(probes.select("kind", "key", "at").unionByName(urls), open_)

    def matched(found: DataFrame, by: list[str], lists: str) -> DataFrame:
        return found.groupBy(*by).agg(F.collect_set(F.struct("list", "effect")).alias(lists))  # at most the number of lists

    hosts = matched(probes.join(active, ["kind", "key", "at"]), ["host", "at"], "by_host")
    by_url = matched(active.where("kind = 'url'").withColumnRenamed("key", "plain"), ["plain", "at"], "by_url")
    both = asked.join(hosts, ["host", "at"], "left").join(by_url, ["plain", "at"], "left")
    none = F.array().cast("array<struct<list:string,effect:string>>")
    found = both.withColumn("all", F.array_union(F.coalesce("by_host", none), F.coalesce("by_url", none)))

    def has(effect: str) -> Column:
        return F.exists("all", lambda x: x["effect"] == effect)

    kept = [F.col("row").getField(c).alias(c) for c in captures.columns if c.lower() not in ("lists", "blocked")]
    return found.select(*kept, F.array_join(F.array_sort(F.array_distinct(F.transform("all", lambda x: x["list"]))), ",").alias("lists"), (has("block") & ~has("allow")).alias("blocked"))


def number(of: Column) -> Column:
    """A number below 2^24 that depends on a string alone."""
    return F.conv(F.substring(F.md5(of), 1, 6), 16, 10).cast("long")


def dated_lists(pages: DataFrame) -> DataFrame:
    """Lists about the hosts and URLs of the pages themselves, with their dates, for a table that has neither."""
    hosts = pages.select(host_of(F.col("url")).alias("key")).where("key is not null").distinct().withColumn("h", number(F.col("key")))
    domains = hosts.select(F.element_at(suffixes(F.col("key")), -1).alias("key")).distinct().withColumn("h", number(F.col("key")))
    urls = pages.where("url is not null").select(plain_url(F.col("url")).alias("key")).distinct().withColumn("h", number(F.col("key"))).where("h % 13 = 0")

    def dated(keys: DataFrame, name: str, effect: str, kind: str, steps: dict[int, str]) -> DataFrame:
        events = F.array(*(F.struct(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("h") % 200 + after).cast("int")).alias("day"), F.lit(action).alias("action")) for after, action in steps.items()))
        return keys.select(F.lit(name).alias("list"), F.lit(effect).alias("effect"), F.lit(kind).alias("kind"), "key", F.explode(events).alias("e")).select("list", "effect", "kind", "key", "e.*")

    spam = dated(hosts.where("h % 5 < 2"), "spam", "block", "host", {0: "add", 60: "remove", 120: "add"})
    adult = dated(domains.where("h % 3 = 0"), "adult", "block", "domain", {30: "add"})
    trusted = dated(hosts.where("h % 4 = 1"), "trusted", "allow", "host", {10: "add", 150: "remove"})
    return spam.unionByName(adult).unionByName(trusted).unionByName(dated(urls, "takedown", "block", "url", {5: "add"}))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day that its id gives, against the lists as they were on that day."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    return decide(captures, dated_lists(pages))


OP8_SQL = r"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS day,
  nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)', 1)), '.'), '') AS host, string_split(url, '#')[1] AS plain FROM pages),
n AS (SELECT DISTINCT host AS key, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS h FROM p WHERE host IS NOT NULL),
x AS (SELECT DISTINCT CASE WHEN len(w) < 2 OR regexp_full_match(key, '\[.*\]|[0-9.]+') THEN key ELSE w[-2] || '.' || w[-1] END AS key FROM (SELECT key, string_split(key, '.') AS w FROM n)),
d AS (SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) AS h FROM x),
u AS (SELECT DISTINCT plain AS key, CAST('0x' || substr(md5(plain), 1, 6) AS BIGINT) AS h FROM p WHERE url IS NOT NULL),
i AS (
  SELECT 'spam' AS list, 'block' AS effect, 'host' AS kind, key, h % 200 AS a, h % 200 + 60 AS b FROM n WHERE h % 5 < 2
  UNION ALL SELECT 'spam', 'block', 'host', key, h % 200 + 120, 100000 FROM n WHERE h % 5 < 2
  UNION ALL SELECT 'adult', 'block', 'domain', key, h % 200 + 30, 100000 FROM d WHERE h % 3 = 0
  UNION ALL SELECT 'trusted', 'allow', 'host', key, h % 200 + 10, h % 200 + 150 FROM n WHERE h % 4 = 1
  UNION ALL SELECT 'takedown', 'block', 'url', key, h % 200 + 5, 100000 FROM u WHERE h % 13 = 0),
m AS (SELECT p.page_id, p.url, p.day, i.list, i.effect FROM p JOIN i
  ON (i.kind = 'host' AND i.key = p.host OR i.kind = 'domain' AND (i.key = p.host OR ends_with(p.host, '.' || i.key)) OR i.kind = 'url' AND i.key = p.plain)
  AND p.day - DATE '2024-01-01' >= i.a AND p.day - DATE '2024-01-01' < i.b)
SELECT p.page_id, p.url, p.day, coalesce(string_agg(DISTINCT m.list, ',' ORDER BY m.list), '') AS lists,
  coalesce(bool_or(m.effect = 'block'), false) AND NOT coalesce(bool_or(m.effect = 'allow'), false) AS blocked
FROM p LEFT JOIN m USING (page_id) GROUP BY p.page_id, p.url, p.day
"""
