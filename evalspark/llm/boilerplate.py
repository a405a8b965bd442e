"""Line deduplication relative to the site.

Pages are grouped by host. A line's ratio is the share of the host's pages that contain it; lines
above MAX_RATIO on a host with at least MIN_PAGES pages are boilerplate there and are dropped from
all of that host's pages, wherever in the page they stand. Elsewhere the same line is kept. A ratio of just MAX_RATIO keeps
the line, as does a line of a single page, which says nothing of the site.

Counting is a distinct per page, then a grouped count with map-side combine, so a host with a third
of all pages is spread over its lines. Lines are compared by a digest of their text without blanks at the
ends; empty lines are no lines. A NULL or odd url has the host "". A NULL html has no lines.
Rows that repeat a page_id are pages of their own. An empty table gives no rows; extra columns of
pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import written

MAX_RATIO, MIN_PAGES = 0.3, 5
#: Whatever begins or ends a block of an HTML page also ends a line of it.
LINE_BREAK = r"(?i)\n|<br[^>]*>|</?(?:p|div|li|ul|ol|h[1-6]|tr|table|article|nav|title|section|header|footer|head|body|html)(?:\s[^>]*)?>"
DROPPED = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines(html: Column) -> Column:
    """The lines of a page, in order: tags removed, trimmed, without empty ones."""
    broken = F.split(F.regexp_replace(F.coalesce(html, F.lit("")), DROPPED, ""), LINE_BREAK)
    plain = F.transform(broken, lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
    return F.filter(plain, lambda x: x != "")


def line_key(line: Column) -> Column:
    """Lines are counted and compared by a 16-byte digest, which is all of them that is shuffled."""
    return F.unhex(F.md5(F.encode(line, "UTF-8")))


def drop_boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, host_pages, n_lines, n_dropped, text of every page: its lines that stay, joined by line feeds."""
    cut = pages.select("page_id", host(F.col("url")).alias("host"), lines(F.col("html")).alias("lines"))
    cut = written(cut, "line-pages")
    totals = cut.groupBy("host").agg(F.count("*").alias("host_pages"))
    each = cut.select("host", F.explode(F.array_distinct(F.transform("lines", line_key))).alias("line"))
    often = each.groupBy("host", "line").agg(F.count("*").alias("_pages")).where(F.col("_pages") >= 2)
    bad = often.join(totals.where(F.col("host_pages") >= min_pages), "host").where(F.col("_pages") > F.lit(max_ratio) * F.col("host_pages")).select("host", "line")
    # Each host has fewer than 1 / max_ratio times its lines a page above the ratio: a short list per host.
    lists = bad.groupBy("host").agg(F.collect_list("line").alias("_bad"))
    # Written first, so that its size decides whether the pages need a shuffle.
    hosts = written(totals.join(lists, "host", "left"), "line-hosts")
    rows = cut.join(hosts, "host")
    is_bad = lambda x: F.coalesce(F.array_contains("_bad", line_key(x)), F.lit(False))
    stays = F.when(F.col("_bad").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~is_bad(x)))
    rows = rows.withColumn("_stays", stays)
    kept = F.array_join("_stays", "\n")
    n_kept = F.size("_stays")
    return rows.select(
        "page_id",
        "host",
        "host_pages",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - n_kept).cast("long").alias("n_dropped"),
        kept.alias("text"),
    )
