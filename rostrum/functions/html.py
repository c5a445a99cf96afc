"""Columns of HTML pages, taken apart with regular expressions that run inside the engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import col, group, strip_ws

ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
ANCHOR = r'(?i)<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>'
BLOCK = r"(?s)<(?:h[1-6]|p|li)[^>]*>.*?</(?:h[1-6]|p|li)>"


def collapse(c: Column) -> Column:
    return strip_ws(F.regexp_replace(c, r"\s+", " "))


def html_text(c) -> Column:
    """Plain text: no scripts, styles and comments, tags as spaces, entities decoded, white space collapsed."""
    out = F.regexp_replace(col(c), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, text in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(text))
    return collapse(out)


def inner_text(c) -> Column:
    return collapse(F.regexp_replace(c, r"<[^>]*>", " "))


def page_title(html, date=None) -> Column:
    """The <title> of an oral question (with its date), else the first h3, the <title>, or Untitled Document."""
    title = F.nullif(inner_text(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    h3 = F.nullif(inner_text(F.regexp_extract(col(html), r"(?is)<h3[^>]*>(.*?)</h3>", 1)), F.lit(""))
    oral = F.coalesce(title.contains("Oral Question"), F.lit(False))
    out = F.coalesce(F.when(oral, title), h3, title, F.lit("Untitled Document"))
    return out if date is None else F.when(oral & col(date).isNotNull(), F.concat_ws(" - ", out, col(date).cast("string"))).otherwise(out)


def body_html(html, keep) -> Column:
    """The body's markup without its first h3 where keep is true, plain text otherwise."""
    inner = F.coalesce(group(html, r"(?is)<body[^>]*>(.*)</body>"), col(html))
    return F.when(keep, strip_ws(F.regexp_replace(inner, r"(?is)^(.*?)<h3[^>]*>.*?</h3>", "$1"))).otherwise(html_text(html))


def html_clean(c) -> Column:
    """div as p, line breaks as newlines, no empty paragraphs, no attributes but those of images."""
    out = F.regexp_replace(col(c), r"(?i)<div[^>]*>", "<p>")
    out = F.regexp_replace(out, r"(?i)</div>", "</p>")
    out = F.regexp_replace(out, r"(?i)<br ?/?>", "\n")
    out = F.regexp_replace(out, r"(?i)<(a|abbr|article|b|body|div|em|footer|h[1-6]|head|header|html|i|li|meta|nav|ol|p|script|section|span|strong|style|table|td|th|title|tr|u|ul) [^>]*>", "<$1>")
    return F.regexp_replace(out, r"(?i)<p>\s*</p>", "")


def anchors(html) -> Column:
    """array<struct<href, label>> of a page's links, in order."""
    href, label = (F.regexp_extract_all(col(html), F.lit(ANCHOR), F.lit(k)) for k in (1, 2))
    return F.arrays_zip(href.alias("href"), label.alias("label"))


def absolute(href, base) -> Column:
    """A link's address, against that of its page."""
    root = F.regexp_extract(col(base), r"^(https?://[^/]+)", 1)
    return F.when(col(href).startswith("http"), col(href)).when(col(href).startswith("/"), F.concat(root, col(href))).otherwise(F.concat(root, F.lit("/"), col(href)))


def file_name(url) -> Column:
    return F.element_at(F.split(col(url), "/"), -1)


def is_transcript_link(name, label, parent) -> Column:
    """Whether a link leads to a transcript by its file's name, its label or the text around it, and isn't on the skipped list."""
    wanted = col(name).contains("DAY-") | col(name).rlike(P.LINK_NAME) | F.coalesce(col(parent).contains("Sitting Day"), F.lit(False)) | col(label).rlike(P.LINK_TEXT)
    skipped = F.lower(col(name)).rlike("|".join(P.LINK_SKIPPED))
    return wanted & ~skipped


def link_date_label(name, label, parent) -> Column:
    """A link's date as it is written: after the colon of the text around it, its label, or by its file's name."""
    around = F.when(F.coalesce(col(parent).contains("Sitting Day") & col(parent).contains(":"), F.lit(False)), strip_ws(F.replace(F.regexp_extract(col(parent), r"(?s)^[^:]*:(.*)$", 1), col(label), F.lit(""))))
    by_name = F.when(col(name).rlike(P.LINK_DATE), F.concat_ws(" ", *(F.regexp_extract(col(name), P.LINK_DATE, k) for k in (1, 2, 3, 4))))
    own = F.coalesce(F.nullif(around, F.lit("")), F.nullif(strip_ws(label), F.lit("")))
    return F.coalesce(F.when(own != col(name), own), by_name, own, col(name))


def is_formatted(html) -> Column:
    found = F.lit(False)
    for mark in P.FORMATTED:
        found = found | col(html).contains(mark)
    return found


def blocks(html) -> Column:
    """array<struct<tag, style, text>> of a page's headings, paragraphs and list items, in order."""
    return F.transform(
        F.regexp_extract_all(col(html), F.lit(BLOCK), F.lit(0)),
        lambda b: F.struct(F.regexp_extract(b, r"^<(\w+)", 1).alias("tag"), F.regexp_extract(b, r'^<[^>]*style="([^"]*)"', 1).alias("style"), inner_text(b).alias("text")),
    )


def is_styled_heading(tag, style, text) -> Column:
    """Centred, or h2, or an h3 far to the right; otherwise an h2 or h3 in title case that is neither a number nor a person."""
    indent = F.coalesce(group(style, r"padding-left:\s*(\d+(?:\.\d+)?)(?:pt|px)").try_cast("double"), F.lit(0.0))
    styled = col(style).contains(P.CENTRED) | (col(tag) == "h2") | ((indent >= 110) & (col(tag) == "h3"))
    digits = F.regexp_replace(col(text), r"[^0-9]", "") != ""
    titled = col(tag).isin("h2", "h3") & (F.initcap(col(text)) == col(text)) & ~digits & ~col(text).rlike(P.TITLED_PERSON)
    return col(tag).isin("p", "h2", "h3") & (styled | titled)


def question_title(html) -> Column:
    """First line of the first h3, p or span that has text."""
    found = [F.nullif(strip_ws(F.split(F.regexp_replace(F.regexp_extract(col(html), rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), r"<[^>]*>", ""), "\n")[0]), F.lit("")) for tag in ("h3", "p", "span")]
    return F.coalesce(*found)


def names_year(*columns, years: tuple[str, ...]) -> Column:
    """Whether one of the years stands in any of a link's columns (address, file name, text), not as part of a longer number."""
    pattern = "(^|[^0-9])(" + "|".join(years) + ")([^0-9]|$)"
    found = [F.coalesce((F.col(c) if isinstance(c, str) else c).rlike(pattern), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, found)
