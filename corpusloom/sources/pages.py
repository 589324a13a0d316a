"""Web pages as the stand-in for scanned documents: titles, links, headers and captions by patterns over the markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(c: Column) -> Column:
    """Without tags."""
    return F.regexp_replace(c, "<[^>]+>", "")


def scanned(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """`pages` with host, title, headers (texts of the navigation's links), links and caption (the first h1)."""
    h = F.col(html)
    nav = F.regexp_extract(h, "(?s)<nav>(.*?)</nav>", 1)
    headers = F.transform(F.regexp_extract_all(nav, F.lit("(?s)<a [^>]*>(.*?)</a>"), F.lit(1)), plain)
    return pages.select(
        "*", F.regexp_extract(url, "^[a-z]+://([^/:?#]+)", 1).alias("host"), F.regexp_extract(h, "(?s)<title>(.*?)</title>", 1).alias("title"), headers.alias("headers"),
        F.regexp_extract_all(h, F.lit('<a [^>]*href="([^"]*)"'), F.lit(1)).alias("links"), F.trim(plain(F.regexp_extract(h, "(?s)<h1[^>]*>(.*?)</h1>", 1))).alias("caption"))


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, block_no, text): paragraphs and list items, blank ones dropped."""
    found = F.regexp_extract_all(F.col(html), F.lit("(?s)<(?:p|li)[^>]*>(.*?)(?=<p|<li|</p>|</li>|</article>)"), F.lit(1))
    return pages.select(key, F.posexplode(F.transform(found, plain)).alias("block_no", "text")).where(F.trim("text") != "")
