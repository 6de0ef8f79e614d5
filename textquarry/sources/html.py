"""Rows out of HTML columns: titles, links, tables, search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def title(c) -> Column:
    return F.trim(F.regexp_extract(T.text_of(c), "<title>([^<]*)</title>", 1))


def host(c) -> Column:
    return F.lower(F.regexp_extract(T.text_of(c), "^[a-z]+://([^/?#:]*)", 1))


def rows(pages: DataFrame, id_col: str, html_col: str, pattern: str) -> DataFrame:
    """(id, pos from 1, item without tags) of each match's first group."""
    found = pages.select(id_col, F.posexplode(F.regexp_extract_all(T.text_of(html_col), F.lit(pattern), F.lit(1))).alias("pos", "raw"))
    return found.select(id_col, (F.col("pos") + 1).alias("pos"), F.trim(T.strip_tags("raw")).alias("item"))


def gazette_entries(pages: DataFrame, base_url: str, since: str) -> DataFrame:
    """(page_id, act_name, title, notified, description, url) of table rows of three cells or more whose second has a date not before `since`."""
    cut = pages.select("page_id", "act_name", F.posexplode(F.regexp_extract_all("html", F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "row"))
    cells = cut.withColumn("cells", F.transform(F.regexp_extract_all("row", F.lit("(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda x: F.regexp_replace(F.trim(T.strip_tags(x)), r"\s+", " ")))
    dated = cells.where(F.size("cells") >= 3).withColumn("raw", F.nullif(F.regexp_extract(F.try_element_at("cells", F.lit(2)), r"(\d{1,2}[/-]\d{1,2}[/-]\d{4})", 1), F.lit("")))
    notified = F.coalesce(F.to_date(F.try_to_timestamp("raw", F.lit("d-M-y"))), F.to_date(F.try_to_timestamp("raw", F.lit("d/M/y"))))
    href = F.regexp_extract("row", '(?is)<a[^>]+href="([^"]*)"', 1)
    url = F.when(F.startswith(href, F.lit("/")), F.concat(F.lit(base_url), href)).when(F.startswith(href, F.lit("http")), href).otherwise(base_url)
    found = dated.withColumn("notified", notified).where(F.col("notified") >= F.lit(since).cast("date"))
    return found.select("page_id", "act_name", F.try_element_at("cells", F.lit(1)).alias("title"), "notified", F.try_element_at("cells", F.lit(3)).alias("description"), url.alias("url"))


def search_hits(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, doc, title, excerpt) of the results of a case-law search page."""
    pattern = r'(?is)<div class="result">\s*<div class="result_title"><a[^>]+href="/doc/(\d+)/"[^>]*>(.*?)</a>.*?<div class="result_excerpt">(.*?)</div>'
    groups = [F.regexp_extract_all(html_col, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    hits = pages.select(id_col, F.explode(F.arrays_zip(groups[0].alias("doc"), groups[1].alias("title"), groups[2].alias("excerpt"))).alias("x"))
    return hits.select(id_col, "x.doc", F.trim(T.strip_tags("x.title")).alias("title"), F.trim(T.strip_tags("x.excerpt")).alias("excerpt"))
