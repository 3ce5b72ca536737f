"""Line deduplication by site-relative frequency.

A line that a large share of a host's pages contain is boilerplate of that host
and is dropped there, however long it is and however rare elsewhere.  Counting is
one aggregation by (host, line) with partial sums; only lines that can reach the
ratio meet the host totals.  A host has at most (mean lines per page / ratio)
boilerplate lines, so its list joins to its pages as one short array, and a hot
host's pages can be split over tasks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .common import table

#: a line on one page alone proves nothing
RATIO, LEAST_PAGES = 0.1, 2
#: fixed values: what separates the lines of a web page; what is opened and never closed goes on to the end
BREAKS = r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)|</?[a-z!?][^>]*(?:>|\z)|\n"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: str) -> Column:
    """Lower-cased host of an absolute URL, null for anything else."""
    return F.lower(F.nullif(F.regexp_extract(url, HOST, 1), F.lit("")))


def html_lines(html: str) -> Column:
    """Texts between tags and line breaks, trimmed, without empty ones; scripts, styles and comments are no text."""
    return F.filter(F.transform(F.split(F.coalesce(html, F.lit("")), BREAKS), lambda x: F.trim(x)), lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float, least_pages: int) -> DataFrame:
    """(host, lines): lines of `pages` (host, lines) on more than `ratio` of a host's pages and on `least_pages` at least."""
    sited = pages.where("host is not null")
    counts = sited.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(
        F.count("*").alias("n")).where(F.col("n") >= least_pages)
    totals = sited.groupBy("host").agg(F.count("*").alias("total"))
    return counts.join(totals, "host").where(F.col("n") > ratio * F.col("total")).groupBy("host").agg(
        F.collect_set("line").alias("common"))


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, id_col: str = "page_id",
                     host: Column | None = None, lines: Column | None = None) -> DataFrame:
    """(id, host, n_lines, n_dropped, text): each page's remaining lines in order, joined by line breaks.

    A page counts once for a line that it repeats, all its repeats are dropped.
    A line on exactly `ratio` of the pages stays, as does one on fewer than
    `least_pages`; hosts of any size follow the same rule.  Pages without a host
    lose nothing.  A page without text has no lines and an empty text but counts
    in its host's total, as do repeated rows.  A tag, script, style or comment
    that is never closed takes what follows.  Other columns are not read.
    """
    host = host_of("url") if host is None else host
    lines = html_lines("html") if lines is None else lines
    cut = stage(pages.select(id_col, host.alias("host"), lines.alias("lines")), "site-lines")
    common = stage(boilerplate(cut, ratio, least_pages), "site-common")
    kept = F.when(F.col("common").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains("common", x)))
    return cut.join(common, "host", "left").select(
        id_col, "host", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(kept)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("text"))


def op5_sitelines(spark, sf_dir) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "pages"))


SQL = rf"""
WITH cut AS (
  SELECT page_id, lower(nullif(regexp_extract(url, '{HOST}', 1), '')) AS host,
         list_filter(list_transform(regexp_split_to_array(coalesce(html, ''), '{BREAKS}'), lambda x: trim(x)),
                     lambda x: x <> '') AS lines
  FROM pages),
line AS (
  SELECT host, line, count(*) AS n
  FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM cut WHERE host IS NOT NULL) GROUP BY host, line),
common AS (
  SELECT host, list(line) AS common
  FROM line JOIN (SELECT host, count(*) AS total FROM cut WHERE host IS NOT NULL GROUP BY host) USING (host)
  WHERE n >= {LEAST_PAGES} AND n > {RATIO} * total GROUP BY host),
kept AS (
  SELECT page_id, host, lines,
         CASE WHEN common IS NULL THEN lines
              ELSE list_filter(lines, lambda x: NOT list_contains(common, x)) END AS kept
  FROM cut LEFT JOIN common USING (host))
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped,
       coalesce(array_to_string(kept, chr(10)), '') AS text
FROM kept
"""

QUERIES = {"op5_sitelines": (op5_sitelines, SQL)}
