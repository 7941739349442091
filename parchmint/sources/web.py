"""Parts of HTML pages that patterns can tell, as Column expressions; sources.files reads whole pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def article(html: Column) -> Column:
    return F.regexp_extract(html, "(?s)<article>(.*)</article>", 1)


def plain(html: Column) -> Column:
    """Text of a page without markup: scripts and styles go with their content, other tags leave a blank."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " "), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f]+", " "))
