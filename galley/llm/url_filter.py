r"""URL filters by a temporal list join.

Dated list entries (list, domain, since, action) become validity intervals: an `add` holds from its day until
the next entry of the same list and domain. A capture is judged by the entries that hold on the day it
was fetched, for its host and every parent domain; an allow list wins over block lists, then the longest
domain, then the least list name. Only DataFrame functions are used.

A capture meets intervals in an equi-join on the domain with the day as residual condition; the intervals
are dealt out to SALTS copies, as one host may hold a third of all captures, and matches are reduced to
one per capture by a partial aggregation.

Defined results: a null or unreadable URL has the empty host and no match; a null day matches nothing; of
entries for one day a `remove` comes last; an entry without a domain or day never holds, one whose kind is
not `allow` blocks; repeated captures are judged one by one; empty tables give empty results; a host beyond
the length of a domain name has itself and its parents up to that length; other columns of captures are
kept, those with the names of results replaced. Captures are numbered in a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, spare

SALTS = 16
#: Code points in a domain name at most, by the rules of the domain name system. Of a longer host only the parents
#: up to this length are domains.
LONGEST = 253
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)"


def host_of(url: str | Column) -> Column:
    """The lower-cased host without a trailing dot; empty if there is none."""
    col = F.lower(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")))
    return F.regexp_replace(F.regexp_extract(col, HOST, 1), r"\.+$", "")


def parents(host: Column) -> Column:
    """The host and its parent domains of at most LONGEST code points."""

    def suffixes(name: Column) -> Column:
        labels = F.split(name, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    tail = F.substring(host, -LONGEST - 1, LONGEST + 1)  # what stands before its first dot is cut off or too long
    after = F.substring(tail, F.instr(tail, ".") + 1, LONGEST)
    long = F.when(F.contains(tail, F.lit(".")), F.concat(F.array(host), suffixes(after))).otherwise(F.array(host))
    return F.when(F.length(host) <= LONGEST, suffixes(host)).otherwise(long)


def intervals(entries: DataFrame) -> DataFrame:
    """list, domain, since, until (exclusive, null: still holds), allow. entries: list, kind, domain, since, action.
    Domains differ neither by case nor by a dot at the end."""
    w = Window.partitionBy("list", "domain").orderBy("since", F.col("action") == "remove")
    named = entries.filter("domain IS NOT NULL AND since IS NOT NULL").withColumn("domain", F.regexp_replace(F.lower("domain"), r"\.+$", ""))
    spans = named.withColumn("until", F.lead("since").over(w))
    held = spans.filter((F.col("action") == "add") & (F.col("until").isNull() | (F.col("until") > F.col("since"))))
    return held.select("list", "domain", "since", "until", F.col("kind").eqNullSafe("allow").alias("allow"))


def judged(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched") -> DataFrame:
    """captures with host, decision (allow, block or none), by_list, by_domain and since of the entry that decided;
    columns of captures with these names are replaced."""
    rows, row = numbered(captures)
    salt = F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int")
    asked = rows.select(F.col(row).alias("at"), F.col(day).alias("day"), salt.alias("salt"), F.explode(parents(host_of(url))).alias("domain"))
    held = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = asked.join(held, ["domain", "salt"]).filter((F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    order = F.struct((~F.col("allow")).alias("a"), (-F.length("domain")).alias("b"), "list", "domain", "since")
    best = spare(rows, "best")
    found = hits.groupBy("at").agg(F.min(order).alias(best)).withColumnRenamed("at", row)
    b = F.col(best)
    decision = F.when(b.isNull(), "none").when(b.a, "block").otherwise("allow")
    out = rows.join(found, row, "left").withColumns({"host": host_of(url), "decision": decision, "by_list": b.list, "by_domain": b.domain, "since": b.since})
    return out.drop(row, best)


def sample_entries(hosts: DataFrame) -> DataFrame:
    """A dated list made by rule from host names, as the tables here hold none: hosts and parent domains are added
    to list `a` and taken off again, and some subdomains are allowed from some day on, by digits of their MD5."""
    name = F.explode(parents(F.col("host"))).alias("domain")
    names = hosts.select("host").distinct().select(name).distinct().filter(F.col("domain").contains("."))
    part = lambda a: F.conv(F.substring(F.md5("domain"), a, 2), 16, 10).cast("int")
    start = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    rows = F.array(
        F.struct(F.lit("a").alias("list"), F.lit("block").alias("kind"), F.lit("add").alias("action"), start(part(1)).alias("since"), (part(5) < 64).alias("use")),
        F.struct(F.lit("a").alias("list"), F.lit("block").alias("kind"), F.lit("remove").alias("action"), start(part(1) + part(3)).alias("since"), (part(5) < 48).alias("use")),
        F.struct(F.lit("b").alias("list"), F.lit("allow").alias("kind"), F.lit("add").alias("action"), start(part(7)).alias("since"), (part(9) < 32).alias("use")),
    )
    return names.select("domain", F.explode(rows).alias("e")).filter("e.use").select("e.list", "e.kind", "domain", "e.since", "e.action")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day that its id gives, against the sample list of all hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.coalesce("page_id", F.lit(0)) % 366).cast("int"))
    entries = sample_entries(pages.select(host_of("url").alias("host")))
    out = judged(pages.withColumn("fetched", fetched), entries)
    return out.select("page_id", "host", F.col("fetched").cast("string"), "decision", "by_list", "by_domain", F.col("since").cast("string").alias("since"))


OP1_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, DATE '2024-01-01' + CAST(coalesce(page_id, 0) % 366 AS INTEGER) AS fetched,
         regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1), '\.+$', '') AS host
  FROM pages),
s AS (
  SELECT r, fetched, array_to_string(l[i:], '.') AS domain
  FROM (SELECT r, fetched, string_split(host, '.') AS l, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM p)
  WHERE i = 1 OR length(array_to_string(l[i:], '.')) <= 253),
d AS (SELECT DISTINCT domain FROM s WHERE contains(domain, '.')),
m AS (SELECT domain, list_transform([1, 3, 5, 7, 9], lambda i: CAST('0x' || substr(md5(domain), i, 2) AS INTEGER)) AS h FROM d),
e AS (
  SELECT domain, 'a' AS list, 'block' AS kind, 'add' AS action, DATE '2024-01-01' + h[1] AS since FROM m WHERE h[3] < 64
  UNION ALL SELECT domain, 'a', 'block', 'remove', DATE '2024-01-01' + h[1] + h[2] FROM m WHERE h[3] < 48
  UNION ALL SELECT domain, 'b', 'allow', 'add', DATE '2024-01-01' + h[4] FROM m WHERE h[5] < 32),
v AS (
  SELECT *, lead(since) OVER (PARTITION BY list, domain ORDER BY since, action = 'remove') AS until FROM e),
b AS (
  SELECT s.r, v.list, v.domain, v.since, v.kind,
         row_number() OVER (PARTITION BY s.r ORDER BY v.kind = 'block', -length(v.domain), v.list, v.domain, v.since) AS k
  FROM s JOIN v ON s.domain = v.domain AND v.action = 'add' AND (v.until IS NULL OR v.until > v.since)
   AND v.since <= s.fetched AND (v.until IS NULL OR s.fetched < v.until))
SELECT page_id, host, CAST(fetched AS VARCHAR) AS fetched, coalesce(b.kind, 'none') AS decision, b.list AS by_list,
       b.domain AS by_domain, CAST(CAST(b.since AS DATE) AS VARCHAR) AS since
FROM p LEFT JOIN b ON p.r = b.r AND b.k = 1
"""
