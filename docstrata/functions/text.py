"""Text columns: cleaning, naming, formatting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = "\xa0"
#: White space as Python's str.strip sees it, for Java's regular expressions.
WHITE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

#: Image types by extension; "convert" marks vector formats.
MIME_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "bmp": "image/bmp", "gif": "image/gif",
    "tiff": "image/tiff", "webp": "image/webp", "wmf": "image/x-wmf", "emf": "image/x-emf",
}
#: Units of 1024, the entities of escaped HTML in their order, and names of date groups in theirs.
UNITS = ("Bytes", "KB", "MB", "GB")
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"))
DATE_GROUPS = ("Today", "Yesterday", "Last 7 Days", "Older")

#: Templates with {named} slots; all are parameters of ``fill``.
SCOPE_PROMPT = "Describe in one paragraph the scope of a technical document that would answer this question:\n\n{question}\n"
TITLE_PROMPT = "Give a short plain-text title for a conversation that starts with this message:\n{message}\n"
FIGURE_PROMPT = 'Describe the figure "{figure_name}". The text before it reads:\n"{last_paragraph}"\n'


def clean_nbsp(text: Column) -> Column:
    """No-break spaces become blanks."""
    return F.translate(text, NBSP, " ")


def strip(text: Column) -> Column:
    """Without white space at both ends, all Unicode white space included."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def is_truthy(value: Column) -> Column:
    """A string that is there and not empty."""
    return F.coalesce(F.length(value) > 0, F.lit(False))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def swap_suffix(path: Column, old: str, new: str) -> Column:
    return F.regexp_replace(path, re.escape(old) + "$", new)


def heading_level(style: Column) -> Column:
    """2 for "Heading 2"; null for other styles and for headings without a readable number."""
    return F.when(F.startswith(style, F.lit("Heading")), F.get(F.split(F.trim(style), r"\s+"), F.lit(1)).try_cast("int"))


def starts_caption(text: Column) -> Column:
    """Whether a paragraph is a caption: starts with "fig" or "note" in any case."""
    low = F.lower(F.substring(F.regexp_replace(text, f"^{WHITE}+", ""), 1, 4))
    return F.coalesce(F.startswith(low, F.lit("fig")) | F.startswith(low, F.lit("note")), F.lit(False))


def capitalize(text: Column) -> Column:
    """First character upper, all others lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))


def clean_title(text: Column) -> Column:
    """First line only, capitalized."""
    return capitalize(F.substring_index(text, "\n", 1))


def truncated(text: Column, n: int, mark: str = "...") -> Column:
    """At most n characters, and the mark where something was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def fill(template: str, **slots: Column) -> Column:
    """The template with each {slot} replaced by a column; values are not scanned again for slots."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(slots[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def escape_html(text: Column) -> Column:
    for raw, entity in ENTITIES:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def markdown_html(text: Column, role: Column) -> Column:
    """Light Markdown as HTML for the assistant's messages; line breaks for all. Only fenced code is escaped."""
    parts = F.split(text, "```", -1)
    n = F.size(parts)
    # an odd part between two fences is code; a last fence without a partner stays as it is
    fenced = F.transform(parts, lambda p, i: F.when((i % 2 == 1) & (i < n - 1), F.concat(F.lit("<pre><code>"), escape_html(p), F.lit("</code></pre>"))).when((i % 2 == 1) & (i == n - 1), F.concat(F.lit("```"), p)).otherwise(p))
    html = F.array_join(fenced, "")
    for pattern, out in (
        (r"`([^`]+)`", "<code>$1</code>"), (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), (r"\*([^*]+)\*", "<em>$1</em>"), (r"(?m)^### (.*$)", "<h3>$1</h3>"),
        (r"(?m)^## (.*$)", "<h2>$1</h2>"), (r"(?m)^# (.*$)", "<h1>$1</h1>"), (r"(?m)^- (.*$)", "<li>$1</li>"), (r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>'),
    ):
        html = F.regexp_replace(html, pattern, out)
    return F.replace(F.when(role == "assistant", html).otherwise(text), F.lit("\n"), F.lit("<br>"))


def human_size(n: Column) -> Column:
    """1536 -> "1.5 KB": two decimals at most, without trailing zeros; GB is the largest unit."""
    unit = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    value = F.format_string("%.2f", n.cast("double") / F.pow(F.lit(1024.0), unit))
    plain = F.regexp_replace(value, r"\.?0+$", "")
    return F.when(n == 0, F.lit("0 Bytes")).otherwise(F.concat(plain, F.lit(" "), F.element_at(F.array(*map(F.lit, UNITS)), unit + 1)))


def date_group(at: Column, today: Column) -> Column:
    """Which group of a conversation list a time falls into, against the start of ``today`` (a date)."""
    day = at.cast("timestamp_ntz")
    since = lambda n: day >= F.date_sub(today, n).cast("timestamp_ntz")
    return F.when(since(0), DATE_GROUPS[0]).when(since(1), DATE_GROUPS[1]).when(since(7), DATE_GROUPS[2]).otherwise(DATE_GROUPS[3])


def iso_time(at: Column) -> Column:
    """ISO 8601 with microseconds, which are left out where they are zero."""
    return F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def mime_type(extension: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in MIME_TYPES.items() for x in pair))
    return F.try_element_at(known, plain_extension(extension))


def plain_extension(extension: Column) -> Column:
    return F.regexp_replace(F.lower(extension), r"^\.+", "")


def image_route(extension: Column) -> Column:
    """"keep" for raster images that a browser shows, "convert" for vector formats and unknown ones."""
    mime = mime_type(extension)
    return F.when(mime.isNull() | F.startswith(mime, F.lit("image/x-")), "convert").otherwise("keep")


def fitted(width: Column, height: Column, most: int = 1024) -> Column:
    """struct(width, height) scaled down so that the longer side is ``most``; smaller images stay."""
    longer = F.greatest(width, height)
    side = lambda x: F.when(longer > most, F.when(x == longer, F.lit(most)).otherwise(F.floor(x * (F.lit(float(most)) / longer)))).otherwise(x).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.coalesce(F.size(tokens(text)), F.lit(0))


def first_tokens(text: Column, n: int) -> Column:
    """The first n words, joined by blanks."""
    return F.array_join(F.slice(tokens(text), 1, n), " ")
