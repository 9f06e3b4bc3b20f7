"""HTML functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinflow.functions.base import col, let

BODY_CHARS = 5000
SNIFF_CHARS = 10_240


def title(html: Column | str) -> Column:
    """The title of a page, in lower case, on one line."""
    return F.trim(F.regexp_extract(F.lower(col(html)), "<title[^>]*>(.*?)</title>", 1))


def whole_text(html: Column | str) -> Column:
    """A page's text: the body without scripts, styles and tags, in lower case."""
    lower = F.lower(col(html))
    inner = F.regexp_extract(lower, "(?s)<body[^>]*>(.*?)</body>", 1)
    text = F.when(inner != "", inner).otherwise(lower)
    text = F.regexp_replace(text, "(?s)<script[^>]*>.*?</script>", "")
    text = F.regexp_replace(text, "(?s)<style[^>]*>.*?</style>", "")
    return F.regexp_replace(text, "<[^>]+>", " ")


def body_text(html: Column | str) -> Column:
    """The start of a page's text, in which keywords are looked for."""
    return F.substring(whole_text(html), 1, BODY_CHARS)


def has_keywords(html: Column | str, keywords: Column) -> Column:
    return let(F.concat(title(html), F.lit(" "), body_text(html)), lambda text: F.exists(keywords, lambda k: F.contains(text, k)))


def links(html: Column | str) -> Column:
    """All href values, in order."""
    return F.regexp_extract_all(col(html), F.lit("href=[\"'](.*?)[\"']"), F.lit(1))


def looks_like_html(html: Column | str) -> Column:
    return F.lower(F.substring(col(html), 1, SNIFF_CHARS)).rlike(r"<html|<!doctype|<\?xml")
