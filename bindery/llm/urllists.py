"""URL filters by a temporal list join.

Dated list entries (add, remove) become validity intervals.  A capture is judged
by the entries that were active when it was fetched: its host and parent domains,
and its host with every prefix of its path, are looked up as of that time.
A judgement depends on the URL and the time alone, so equal captures are judged
once and joined back.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table
from .sitelines import HOST, host_of


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to) from dated entries (pattern, action, changed): disjoint, end excluded, open if null.

    Entries that repeat an action change nothing.  What is added and removed at
    the same time is not active from then on.  Entries with a null or an action
    other than add or remove are left out.
    """
    # the last word on a pattern at one time: removal beats addition
    dated = (entries.where("action in ('add', 'remove')").dropna(subset=["pattern", "changed"])
             .groupBy("pattern", "changed").agg(F.max("action").alias("action")))
    by_time = Window.partitionBy("pattern").orderBy("changed")
    turns = dated.withColumn("was", F.lag("action").over(by_time)).where(
        (F.col("action") == "add") & F.coalesce(F.col("was") == "remove", F.lit(True))
        | (F.col("action") == "remove") & (F.col("was") == "add"))
    return (turns.withColumn("valid_to", F.lead("changed").over(by_time)).where("action = 'add'")
            .select("pattern", F.col("changed").alias("valid_from"), "valid_to"))


def url_patterns(url: str) -> Column:
    """The host and its parent domains of two or more labels, and the host with each prefix of the path.

    Patterns are lower case in the host; a path prefix ends at a segment, without query and fragment.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.filter(F.split(F.regexp_extract(url, HOST + r"(?::\d*)?(/[^?#]*)", 2), "/"), lambda x: x != "")
    prefixes = F.transform(path, lambda x, i: F.concat(host, F.lit("/"), F.array_join(F.slice(path, 1, i + 1), "/")))
    return F.when(host.isNotNull(), F.concat(parents, prefixes))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """`captures` with n_active, blocked, pattern and listed_since added.

    n_active counts the patterns of the URL that are listed at the time of the
    capture; pattern is the longest of them, ties by name, and listed_since the
    start of its interval.  Captures without a host or a time match nothing.
    Columns of `captures` with one of these names give way; repeated rows stay.
    """
    captures = captures.drop("n_active", "blocked", "pattern", "listed_since")
    once = captures.select(F.col(url_col).alias("u"), F.col(time_col).alias("t")).dropna().distinct()
    asked = once.select("u", "t", F.explode(url_patterns("u")).alias("pattern"))
    active = asked.join(intervals(entries), "pattern").where("t >= valid_from and (valid_to is null or t < valid_to)")
    longest = F.max(F.struct(F.length("pattern"), "pattern", "valid_from"))
    found = active.groupBy("u", "t").agg(F.count("*").alias("n_active"), longest.alias("best"))
    joined = captures.join(found, (captures[url_col] == found.u) & (captures[time_col] == found.t), "left")
    return joined.select(
        *[captures[c] for c in captures.columns], F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("n_active").isNotNull().alias("blocked"), F.col("best.pattern").alias("pattern"),
        F.col("best.valid_from").alias("listed_since"))


DAY, START = 86_400, 1_704_067_200


def _digit(name: str, at: int) -> str:
    return f"instr('0123456789abcdef', substr(md5({name}), {at}, 1))"


#: list entries of the query, made from the hosts of `pages`: a name's digest says whether and when it is listed
_ENTRIES = f"""
names AS (
  SELECT DISTINCT host AS pattern, 1 AS kind FROM site WHERE host IS NOT NULL
  UNION SELECT DISTINCT regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1), 2 FROM site WHERE host IS NOT NULL
  UNION SELECT DISTINCT concat(host, '/', lang), 3 FROM site WHERE host IS NOT NULL AND lang <> ''),
entry AS (
  SELECT pattern, 'add' AS action, {START} + {DAY} * 20 * {_digit('pattern', 2)} AS changed
  FROM names WHERE pattern <> '' AND {_digit('pattern', 1)} <= 9 - 2 * kind
  UNION ALL
  SELECT pattern, 'remove', {START} + {DAY} * (30 + 20 * {_digit('pattern', 2)} + 10 * {_digit('pattern', 3)})
  FROM names WHERE pattern <> '' AND {_digit('pattern', 1)} <= 9 - 2 * kind
  UNION ALL
  SELECT pattern, 'add', {START} + {DAY} * (60 + 20 * {_digit('pattern', 2)} + 20 * {_digit('pattern', 4)})
  FROM names WHERE pattern <> '' AND {_digit('pattern', 1)} <= 9 - 2 * kind)"""
_SITE = f"""
site AS (
  SELECT DISTINCT lower(nullif(regexp_extract(url, '{HOST}', 1), '')) AS host,
         regexp_extract(url, '{HOST}/([a-z]+)/', 2) AS lang FROM pages)"""
_FETCHED = f"{START} + (page_id * 7919) % 730 * {DAY} + (page_id * 104729) % {DAY}"


def op2_urllists(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    entries = spark.sql(f"WITH {_SITE.replace('FROM pages', 'FROM {pages}')}, {_ENTRIES} SELECT * FROM entry", pages=pages)
    return judge(pages.select("page_id", "url", F.expr(_FETCHED).alias("fetched_at")), entries)


SQL = f"""
WITH {_SITE}, {_ENTRIES},
dated AS (SELECT pattern, changed, max(action) AS action FROM entry GROUP BY pattern, changed),
span AS (
  SELECT pattern, changed AS valid_from, (SELECT min(r.changed) FROM dated r WHERE r.pattern = d.pattern AND r.changed > d.changed
                                     AND r.action = 'remove') AS valid_to
  FROM dated d WHERE action = 'add'
    AND coalesce((SELECT max_by(b.action, b.changed) FROM dated b WHERE b.pattern = d.pattern AND b.changed < d.changed), 'remove') = 'remove'),
capture AS (
  SELECT page_id, url, {_FETCHED} AS fetched_at, lower(nullif(regexp_extract(url, '{HOST}', 1), '')) AS host,
         list_filter(string_split(regexp_extract(url, '{HOST}(?::\\d*)?(/[^?#]*)', 2), '/'), lambda x: x <> '') AS path,
         string_split(lower(regexp_extract(url, '{HOST}', 1)), '.') AS label
  FROM pages),
asked AS (
  SELECT DISTINCT url, fetched_at, array_to_string(label[i:], '.') AS pattern
  FROM (SELECT url, fetched_at, label, unnest(range(1, greatest(2, len(label)))) AS i FROM capture WHERE host IS NOT NULL)
  UNION
  SELECT DISTINCT url, fetched_at, host || '/' || array_to_string(path[1:i], '/')
  FROM (SELECT url, fetched_at, host, path, unnest(range(1, len(path) + 1)) AS i FROM capture WHERE host IS NOT NULL)),
found AS (
  SELECT url, fetched_at, count(*) AS n_active, max((length(pattern), pattern, valid_from)) AS best
  FROM asked JOIN span USING (pattern)
  WHERE fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to) GROUP BY url, fetched_at)
SELECT page_id, url, fetched_at, coalesce(n_active, 0) AS n_active, n_active IS NOT NULL AS blocked,
       best[2] AS pattern, best[3] AS listed_since
FROM capture LEFT JOIN found USING (url, fetched_at)
"""

QUERIES = {"op2_urllists": (op2_urllists, SQL)}
