"""URL filters with dated lists: a temporal list join.

A list is a table of dated events: from a day on, a pattern is on it or off it.
Events become validity intervals, from the day of an ``add`` to the day of the
next event of the same list and pattern (exclusive; open if there is none). A
capture is judged by the entries that were active when it was fetched: an as-of
join, by equality on the pattern and the day inside the interval. Intervals of
one list and pattern never overlap, so a capture meets an entry once at most.

Patterns are a host, which covers its subdomains too (``example.org``), or a
host and leading path segments (``example.org/shop``). A URL has few patterns
that can cover it: the endings of its host, and its host with the beginnings of
its path. They are the join keys, so no capture is compared with a whole list.
Only the distinct keys of a host and day are joined: a host with a third of all
captures is a few rows for each day before anything is shuffled by key.

The longest active pattern decides; of equal ones a blocking list comes first,
then the smaller list name. Without an active pattern a capture is allowed.

Edge cases: a null or unreadable URL and a null day match nothing and are
allowed. Hosts and patterns are compared without case, port, user and
final dot; ``www`` is a label like any other. Repeated
captures give a row each; repeated events count once; of an ``add`` and a
``drop`` on one day the ``drop`` holds. Events with a null list, pattern or day
are no events. Empty tables give empty results or leave every capture allowed.
Other columns of the captures are passed on; the operator's own replace columns
of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OWN = ("host", "n_active", "pattern", "list", "blocked")


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and final dot; null
    if there is none."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The path of a URL without query and fragment, without the first slash."""
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)


def patterns_of(host: Column, path: Column) -> Column:
    """Every pattern that covers a URL: endings of the host, beginnings of the path."""
    labels = F.split(host, r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(
        F.slice(labels, k, F.size(labels)), "."))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    starts = F.when(F.size(segments) > 0, F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.concat(
        host, F.lit("/"), F.array_join(F.slice(segments, 1, k), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.array_distinct(F.transform(F.concat(endings, starts), F.lower)))


def intervals(events: DataFrame) -> DataFrame:
    """``(list, pattern, blocks, since, until)`` from events ``(list, pattern,
    blocks, day, action)``; ``blocks`` says what kind of list it is."""
    days = events.where(F.col("list").isNotNull() & F.col("pattern").isNotNull() & F.col("day").isNotNull()).groupBy(
        "list", F.regexp_replace(F.lower(F.trim("pattern")), r"[./]+$", "").alias("pattern"), "day").agg(
        F.max("blocks").alias("blocks"), F.min((F.col("action") == "add").cast("int")).alias("on"))
    own = Window.partitionBy("list", "pattern").orderBy("day")
    days = days.withColumn("until", F.lead("day").over(own))
    return days.where("on = 1 and pattern != ''").select(
        "list", "pattern", "blocks", F.col("day").alias("since"), "until")


def judge(captures: DataFrame, events: DataFrame, url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """``captures`` with ``host``, ``n_active`` (active entries that cover the
    URL), ``pattern`` and ``list`` of the one that decides, and ``blocked``."""
    names = [c for c in captures.columns if c.lower() not in OWN]
    host, path = host_of(F.col(f"`{url_col}`")), path_of(F.col(f"`{url_col}`"))
    rows = captures.select(*[F.col(f"`{c}`") for c in names], host.alias("host"),
                           F.col(f"`{day_col}`").cast("date").alias("__day"), path.alias("__path"))
    asked = rows.where(F.col("host").isNotNull() & F.col("__day").isNotNull()).select(
        "host", "__day", "__path").distinct()
    keys = asked.withColumn("__key", F.explode(patterns_of(F.col("host"), F.col("__path"))))
    # what each key meets on each day, once
    distinct = keys.select("__key", "__day").distinct()
    entry = intervals(events)
    active = distinct.join(entry, (distinct["__key"] == entry["pattern"]) & (distinct["__day"] >= entry["since"]) & (
        entry["until"].isNull() | (distinct["__day"] < entry["until"])))
    per_key = active.groupBy("__key", "__day").agg(
        F.count("*").alias("n"), F.max("blocks").alias("blocks"),
        F.coalesce(F.min(F.when(F.col("blocks"), F.col("list"))), F.min("list")).alias("list"))
    best = F.max_by(F.struct(F.col("__key").alias("pattern"), "list", "blocks"), F.length("__key"))
    found = keys.join(per_key, ["__key", "__day"]).groupBy("host", "__day", "__path").agg(
        F.sum("n").alias("n_active"), best.alias("best"))
    return rows.join(found, ["host", "__day", "__path"], "left").select(
        *[F.col(f"`{c}`") for c in names], "host", F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
        F.col("best.pattern").alias("pattern"), F.col("best.list").alias("list"),
        F.coalesce(F.col("best.blocks"), F.lit(False)).alias("blocked"))


def derived_events(captures: DataFrame) -> DataFrame:
    """A dated list that follows from the captures themselves, as the given
    tables hold none: hosts are listed and delisted in turn, parents of hosts
    are listed for a while, and the sections of hosts are allowed from a day on."""
    seen = captures.select(host_of(F.col("url")).alias("host"), F.split(path_of(F.col("url")), "/")[0].alias("section"))
    seen = seen.where(F.col("host").isNotNull())
    start = F.lit("2024-01-01").cast("date")

    def events(table: DataFrame, name: str, pattern: Column, blocks: bool, *days: tuple[Column, str]) -> DataFrame:
        each = F.array(*[F.struct(F.date_add(start, d.cast("int")).alias("day"), F.lit(a).alias("action")) for d, a in days])
        return table.select(F.lit(name).alias("list"), pattern.alias("pattern"), F.lit(blocks).alias("blocks"),
                            F.inline(each))

    n = F.col("n")
    hosts = seen.groupBy("host").agg(F.count("*").alias("n"))
    first = (n * 13 + F.length("host")) % 120
    spam = events(hosts.where((n % 2 == 0) | F.col("host").contains("spam")), "spam", F.col("host"), True,
                  (first, "add"), (first + 90, "drop"), (first + 180, "add"))
    parents = seen.where(F.size(F.split("host", r"\.")) > 3).groupBy(
        F.regexp_replace("host", r"^[^.]+\.", "").alias("host")).agg(F.count("*").alias("n"))
    parent = events(parents, "parents", F.col("host"), True, (n % 200, "add"), (n % 200 + 45, "drop"))
    sections = seen.where(F.col("section") != "").groupBy("host", "section").agg(F.count("*").alias("n"))
    allowed = events(sections.where(n % 3 == 0), "sections", F.concat_ws("/", "host", "section"), False, (n % 300, "add"))
    return spam.unionByName(parent).unionByName(allowed)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 365).cast("int")))
    return judge(captures, derived_events(captures)).drop("url")


ORACLE = r"""
WITH seen AS (
  SELECT page_id, date '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS fetched_on,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1) AS path
  FROM pages),
hosts AS (SELECT host, count(*) AS n FROM seen GROUP BY host),
parents AS (SELECT regexp_replace(host, '^[^.]+\.', '') AS host, count(*) AS n FROM seen
            WHERE len(string_split(host, '.')) > 3 GROUP BY 1),
sections AS (SELECT host, split_part(path, '/', 1) AS section, count(*) AS n FROM seen
             WHERE split_part(path, '/', 1) <> '' GROUP BY 1, 2),
spans AS (
  SELECT 'spam' AS list, host AS pattern, true AS blocks, (n * 13 + length(host)) % 120 AS a,
         (n * 13 + length(host)) % 120 + 90 AS b FROM hosts WHERE n % 2 = 0 OR contains(host, 'spam')
  UNION ALL SELECT 'spam', host, true, (n * 13 + length(host)) % 120 + 180, NULL
    FROM hosts WHERE n % 2 = 0 OR contains(host, 'spam')
  UNION ALL SELECT 'parents', host, true, n % 200, n % 200 + 45 FROM parents
  UNION ALL SELECT 'sections', lower(host || '/' || section), false, n % 300, NULL FROM sections WHERE n % 3 = 0),
active AS (
  SELECT s.page_id, e.list, e.pattern, e.blocks,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(e.pattern) DESC, e.blocks DESC, e.list) AS place,
         count(*) OVER (PARTITION BY s.page_id) AS n
  FROM seen s JOIN spans e
    ON (s.host = e.pattern OR ends_with(s.host, '.' || e.pattern) OR starts_with(s.host || '/' || s.path || '/', e.pattern || '/'))
   AND date_diff('day', date '2024-01-01', s.fetched_on) >= e.a
   AND (e.b IS NULL OR date_diff('day', date '2024-01-01', s.fetched_on) < e.b))
SELECT s.page_id, s.fetched_on, s.host, CAST(coalesce(a.n, 0) AS BIGINT) AS n_active, a.pattern, a.list,
       coalesce(a.blocks, false) AS blocked
FROM seen s LEFT JOIN active a ON a.page_id = s.page_id AND a.place = 1
"""
