from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docstrata.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(("n", "shown"), [(0, "0 Bytes"), (1, "1 Bytes"), (1023, "1023 Bytes"), (1024, "1 KB"), (1536, "1.5 KB"), (1126, "1.1 KB"), (1048576, "1 MB"), (5 * 1024**3, "5 GB"), (3000 * 1024**3, "3000 GB"), (102400, "100 KB")])
def test_human_size(spark, n, shown):
    assert one(spark, X.human_size(lit(n).cast("long"))) == shown


@pytest.mark.parametrize(("style", "level"), [("Heading 1", 1), ("Heading 3", 3), ("Heading", None), ("Heading x", None), ("Normal", None), ("Title 1", None), (None, None)])
def test_heading_level(spark, style, level):
    assert one(spark, X.heading_level(lit(style).cast("string"))) == level


@pytest.mark.parametrize("text", ["  a b  ", "\xa0x ", "\x1cy\x1f\n", "", "　", "z"])
def test_strip_is_pythons(spark, text):
    assert one(spark, X.strip(lit(text))) == text.strip()


@pytest.mark.parametrize(("text", "title"), [("hELLO World\nsecond", "Hello world"), ("", ""), ("x", "X"), ("éTÉ", "Été")])
def test_clean_title(spark, text, title):
    assert one(spark, X.clean_title(lit(text))) == title


def test_paths(spark):
    assert one(spark, X.stem(lit("a/b.c/d.e.json"))) == "d.e"
    assert one(spark, X.stem(lit(".hidden"))) == ".hidden"
    assert one(spark, X.swap_suffix(lit("x.json"), ".json", "_embedded.json")) == "x_embedded.json"


def test_captions_and_blanks(spark):
    assert one(spark, X.starts_caption(lit("  NOTE 1"))) and one(spark, X.starts_caption(lit("Figure 2")))
    assert not one(spark, X.starts_caption(lit("A figure"))) and not one(spark, X.starts_caption(lit(None).cast("string")))
    assert one(spark, X.is_blank(lit("\xa0\n"))) and one(spark, X.is_blank(lit(None).cast("string"))) and not one(spark, X.is_blank(lit("a")))


def test_markdown(spark):
    text = "# T\n**b** *i* `c` [l](u)\n- x\n```a<b>\n'q'``` ```open"
    html = one(spark, X.markdown_html(lit(text), lit("assistant")))
    assert html == "<h1>T</h1><br><strong>b</strong> <em>i</em> <code>c</code> <a href=\"u\">l</a><br><li>x</li><br><pre><code>a&lt;b&gt;<br>&#039;q&#039;</code></pre> ```open"
    assert one(spark, X.markdown_html(lit("**x**\ny"), lit("user"))) == "**x**<br>y"


def test_fill_does_not_scan_values(spark):
    assert one(spark, X.fill("a {x} b {y}", x=lit("{y}"), y=lit("z"))) == "a {y} b z"


@pytest.mark.parametrize(("at", "group"), [("2024-01-30 00:00:00", "Today"), ("2024-01-29 23:59:59", "Yesterday"), ("2024-01-29 00:00:00", "Yesterday"), ("2024-01-28 10:00:00", "Last 7 Days"), ("2024-01-23 00:00:00", "Last 7 Days"), ("2024-01-22 23:59:59", "Older")])
def test_date_groups(spark, at, group):
    assert one(spark, X.date_group(lit(at).cast("timestamp"), lit("2024-01-30").cast("date"))) == group


def test_iso_time(spark):
    assert one(spark, X.iso_time(lit(dt.datetime(2024, 1, 2, 3, 4, 5)))) == "2024-01-02T03:04:05"
    assert one(spark, X.iso_time(lit(dt.datetime(2024, 1, 2, 3, 4, 5, 60)))) == "2024-01-02T03:04:05.000060"


def test_images(spark):
    assert one(spark, X.mime_type(lit(".JPG"))) == "image/jpeg" and one(spark, X.mime_type(lit("svg"))) is None
    assert [one(spark, X.image_route(lit(e))) for e in ("png", "emf", "svg")] == ["keep", "convert", "convert"]
    assert tuple(one(spark, X.fitted(lit(3000), lit(1001)))) == (1024, 341) and tuple(one(spark, X.fitted(lit(10), lit(20)))) == (10, 20)
    assert tuple(one(spark, X.fitted(lit(500), lit(2048)))) == (250, 1024)


def test_tokens(spark):
    assert one(spark, X.token_count(lit("  a b\nc "))) == 3 and one(spark, X.token_count(lit(None).cast("string"))) == 0
    assert one(spark, X.first_tokens(lit(" a  b c"), 2)) == "a b"
    assert one(spark, X.truncated(lit("abcdef"), 3)) == "abc..." and one(spark, X.truncated(lit("abc"), 3)) == "abc"
