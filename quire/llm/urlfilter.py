"""URL filters by a temporal list join.

Dated list entries (add or remove a pattern) become validity intervals, and every capture is evaluated against the
entries that were active when it was fetched: an equality join on the pattern, an interval that holds the fetch date.
A pattern is a host, which stands for its subdomains as well, or a host and leading path segments. Built-in SQL
functions only; the list side is repeated for each salt, so a host with a third of the captures meets it in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SALTS = 8
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[^:]+://[^/?#]*/?([^?#]*)"

#: Dated entries for the synthetic pages, whose hosts are under example.com, .net and .org.
ENTRIES = [
    ("2023-12-01", "spam", "spam-farm.example.org", "add"), ("2024-05-01", "spam", "spam-farm.example.org", "remove"), ("2024-08-15", "spam", "spam-farm.example.org", "add"),
    ("2024-02-10", "pharma", "cheap-pills.example.com", "add"), ("2024-11-20", "pharma", "cheap-pills.example.com", "remove"),
    ("2024-03-01", "mobile", "m.therou.example.com", "add"), ("2024-03-01", "mobile", "m.therou.example.com", "remove"),
    ("2024-01-15", "path", "blog.ththan.example.net/en", "add"), ("2024-09-01", "path", "blog.ththan.example.net/en", "remove"),
    ("2024-06-01", "org", "example.org", "add"), ("2024-07-01", "org", "example.org", "remove"),
    ("2024-04-01", "net", "ththtion.example.net", "add"), ("2024-04-20", "net", "ththtion.example.net", "add"),
]


def entry_table(spark: SparkSession, entries: list[tuple[str, str, str, str]] = ENTRIES) -> DataFrame:
    """entry_date, list, pattern, action of a list of entries, as a table made in the plan."""
    rows = F.array(*[F.struct(F.lit(d).cast("date").alias("entry_date"), F.lit(n).alias("list"), F.lit(p).alias("pattern"), F.lit(a).alias("action")) for d, n, p, a in entries])
    return spark.range(1).select(F.inline(rows))


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, valid_from and valid_to (not included; null while it holds), from dated entries.

    Each entry holds until the next of its list and pattern; only those that add are kept, and of entries of one date
    a removal comes last. Entries with a null are left out; repeated ones change nothing.
    """
    whole = entries.select("entry_date", "list", F.lower(F.trim("pattern")).alias("pattern"), F.lower("action").alias("action")).dropna().distinct()
    w = Window.partitionBy("list", "pattern").orderBy("entry_date", "action")
    return whole.withColumn("valid_to", F.lead("entry_date").over(w)).filter((F.col("action") == "add") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("entry_date")))).select("list", "pattern", F.col("entry_date").alias("valid_from"), "valid_to")


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), r"\.$", "")


def keys(url: Column, depth: int, parts: int) -> Column:
    """The patterns that can match a URL: its domains of up to ``parts`` parts, and the host with up to ``depth`` path segments; no entry has more of either."""
    name = host(url)
    labels, n = F.split(name, r"\."), F.size(F.split(name, r"\."))
    domains = F.transform(F.sequence(F.greatest(n - F.lit(parts - 1), F.lit(1)), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    segments = F.filter(F.slice(F.split(F.regexp_extract(F.lower(url), PATH, 1), "/"), 1, depth), lambda s: s != "") if depth else F.array().cast("array<string>")
    paths = F.when(F.size(segments) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(segments), F.lit(1))), lambda i: F.concat(name, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(name != "", F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", date_col: str = "fetched_on") -> DataFrame:
    """One row for each capture: page_id, host, fetched_on, blocked, n_entries, lists.

    ``n_entries`` counts the intervals that hold, ``lists`` has their lists in order, comma-joined. A null or odd URL
    has host '' and, as one without a date, is not blocked. Captures that are equal in id, URL and date are alike. Hosts
    and paths of any length are judged; the keys of a capture are as many as the longest pattern has parts.
    """
    valid = intervals(entries)
    parts = F.size(F.split(F.substring_index("pattern", "/", 1), r"\."))
    depth, most = (x or least for x, least in zip(valid.agg(F.max(F.size(F.split("pattern", "/")) - 1), F.max(parts)).first(), (0, 1)))
    valid = valid.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = captures.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(date_col).cast("date").alias("fetched_on"))
    asked = rows.distinct().withColumns({"pattern": F.explode(keys(F.coalesce("url", F.lit("")), depth, most)), "salt": F.pmod(F.xxhash64("page_id", "url", "fetched_on"), F.lit(SALTS)).cast("int")})
    active = (F.col("valid_from") <= F.col("fetched_on")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to")))
    found = asked.join(valid, ["pattern", "salt"]).filter(active).groupBy("page_id", "url", "fetched_on").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("names"))
    found = found.select(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("fetched_on").alias("f"), "n", "names")
    joined = rows.join(found, rows.page_id.eqNullSafe(found.p) & rows.url.eqNullSafe(found.u) & rows.fetched_on.eqNullSafe(found.f), "left")
    return joined.select("page_id", host(F.coalesce("url", F.lit(""))).alias("host"), "fetched_on", F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("names", F.lit("")).alias("lists"))


def fetch_date(id_col: str = "page_id") -> Column:
    """Pages have no fetch date: the query spreads them over 2024 by their ids."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col(id_col) * 37, F.lit(366)).cast("int"))


ORACLE = f"""
WITH entries(entry_date, list, pattern, action) AS (VALUES {", ".join(f"(DATE '{d}', '{n}', '{p}', '{a}')" for d, n, p, a in ENTRIES)}
), valid AS (
  SELECT * FROM (SELECT *, lead(entry_date) OVER (PARTITION BY list, pattern ORDER BY entry_date, action) AS valid_to FROM (SELECT DISTINCT * FROM entries))
  WHERE action = 'add' AND (valid_to IS NULL OR valid_to > entry_date)
), rows AS (
  SELECT page_id, lower(url) AS url, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS fetched_on,
    regexp_extract(lower(url), '{HOST}', 1) AS host, '/' || regexp_extract(lower(url), '{PATH}', 1) || '/' AS path FROM pages
), found AS (
  SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS names FROM rows JOIN valid
    ON (('.' || host) LIKE ('%.' || pattern) OR (contains(pattern, '/') AND (host || path) LIKE (pattern || '/%')))
    AND valid_from_ok(entry_date, fetched_on, valid_to) GROUP BY page_id
)
SELECT page_id, host, fetched_on, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_entries, coalesce(names, '') AS lists FROM rows LEFT JOIN found USING (page_id)
""".replace("valid_from_ok(entry_date, fetched_on, valid_to)", "entry_date <= fetched_on AND (valid_to IS NULL OR fetched_on < valid_to)")
