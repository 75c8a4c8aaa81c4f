r"""Line dedup with a log-template tree.

Each line of a text goes down a tree of fixed depth: by its number of tokens, then by its first LEADING
tokens. Tokens with a digit or an @ are variable fields, `<*>`, from the start. In a leaf, a position with
more than CHILDREN different tokens is a variable field too; if at least FIXED of a line's tokens stay,
its template is the line with `<*>` for the fields, else the line is its own template. Lines whose template
occurs in LEAST_DOCS documents or more are dropped everywhere. Only DataFrame functions are used.

What moves: digests of lines. Texts of lines move only for leaves with more than CHILDREN different lines,
and once when dropped lines meet their documents. Leaves and templates are counted by partial
aggregation; joins have written tables on both sides, so Spark can split a template that many lines share.

Defined results: null texts stay null and have no lines; blank lines stay; equal lines of one document count
once; repeated rows are documents of their own; an empty table gives an empty result; texts and lines of any
length are read whole; other columns stay, but n_lines and n_dropped are replaced. Rows are numbered in a written
table that all steps read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, numbered, spare, written

LEADING, CHILDREN, FIXED, LEAST_DOCS = 3, 8, 0.6, 3
#: Up to so many leaves (16 bytes each) with variable positions are broadcast to find their lines, else joined.
FEW_LEAVES = 200_000
SPACE = r"[\x20\x09-\x0D]"
TOKEN = r"[^\x20\x09-\x0D]"
FIELD = "<*>"


def evened(line: Column) -> Column:
    """The line without white space at its ends and one space within; most lines are so already."""
    odd = reduce(or_, (F.contains(line, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")), F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")))
    even = F.regexp_replace(F.regexp_replace(line, F.lit(f"{SPACE}+"), F.lit(" ")), F.lit("^ | $"), F.lit(""))
    return F.when(odd, even).otherwise(line)


def masked(even: Column) -> Column:
    """The tokens of an even line, variable ones replaced; most lines have none."""
    fields = F.regexp_replace(even, F.lit(r"(?<![^ ])[^ 0-9@]*+[0-9@][^ ]*"), F.lit(FIELD))
    return F.when(even.rlike("[0-9@]"), fields).otherwise(even)


def digest(c: Column) -> Column:
    """Never null: else the joins on it would filter by it first, and all that it is made from would be made twice."""
    return F.coalesce(F.unhex(F.md5(c.cast("binary"))), F.lit(b""))


def lines(docs: DataFrame, row: str) -> DataFrame:
    """row_id, at (the line's place), masked, leaf, whole of each line with a token. row: the column with row numbers."""
    numbers = docs.select(F.col(row).alias("row_id"), "text")
    each = numbers.select("row_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    even = each.filter(F.col("line").rlike(TOKEN)).select("row_id", "at", evened(F.col("line")).alias("even"))
    rows = even.select("row_id", "at", masked(F.col("even")).alias("masked"))
    spaces = F.length("masked") - F.length(F.replace(F.col("masked"), F.lit(" "), F.lit("")))
    head = F.substring_index("masked", " ", LEADING)
    return rows.select("row_id", "at", "masked", digest(F.concat_ws(" ", spaces, head)).alias("leaf"), digest(F.col("masked")).alias("whole"))


def branches(docs: DataFrame, row: str, thin: DataFrame) -> DataFrame:
    """leaf, whole, template for the different lines of leaves with variable positions."""
    wide = thin.groupBy("leaf", "whole").agg(F.count("*").alias("n")).groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > CHILDREN)
    wide = written(wide.select("leaf"), "wide")
    few = wide.count() <= FEW_LEAVES
    found = lines(docs, row).join(F.broadcast(wide) if few else wide.hint("merge"), "leaf", "left_semi").groupBy("leaf", "whole").agg(F.min("masked").alias("masked"))
    rows = written(found, "branches")
    tokens = rows.select("leaf", F.posexplode(F.split("masked", " ")).alias("i", "token"))
    kinds = tokens.groupBy("leaf", "i", "token").agg(F.count("*").alias("n")).groupBy("leaf", "i").agg(F.count("*").alias("n"))
    open_at = kinds.filter(F.col("n") > CHILDREN).groupBy("leaf").agg(F.sort_array(F.collect_list("i")).alias("fields"))
    with_fields = rows.join(written(open_at, "fields"), "leaf").withColumn("t", F.split("masked", " "))
    bounds = F.concat(F.array(F.lit(-1)), F.col("fields"), F.array(F.size("t")))
    with_bounds = with_fields.withColumn("b", bounds)
    parts = F.transform(F.sequence(F.lit(0), F.size("fields")), lambda k: F.array_join(F.slice("t", F.get("b", k) + 2, F.get("b", k + 1) - F.get("b", k) - 1), " "))
    fixed = F.size("t") - F.size("fields") - F.size(F.filter("t", lambda x: x == FIELD)) + F.size(F.filter("fields", lambda i: F.get("t", i) == FIELD))
    template = F.concat_ws(" ", F.concat_ws(",", "fields"), F.array_join(parts, f" {FIELD} "))
    return with_bounds.filter(fixed >= FIXED * F.size("t")).select("leaf", "whole", digest(F.concat_ws(" ", F.hex("leaf"), template)).alias("template"))


def dropped_lines(docs: DataFrame, row: str) -> DataFrame:
    """row_id, n_lines, dropped (places of the lines to drop, ascending) of rows with a line."""
    thin = written(lines(docs, row).drop("masked"), "lines")
    own = written(branches(docs, row, thin), "templates")
    named = thin.join(own, ["leaf", "whole"], "left").select("row_id", "at", F.coalesce("template", "whole").alias("template"))
    named = written(named, "named")
    by_doc = named.groupBy("template", "row_id").agg(F.count("*").alias("n"))
    often = written(by_doc.groupBy("template").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCS).select("template"), "often")
    found = named.join(often.withColumn("hit", F.lit(True)), "template", "left")
    return found.groupBy("row_id").agg(F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.when(F.col("hit"), F.col("at")))).alias("dropped"))


def without(text: Column, dropped: Column) -> Column:
    """The text without the lines at these places."""
    rows = F.split(text, "\n")
    b = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(rows)))
    kept = F.transform(F.sequence(F.lit(0), F.size(dropped)), lambda k: F.slice(rows, F.get(b, k) + 2, F.get(b, k + 1) - F.get(b, k) - 1))
    return F.when(F.size(dropped) > 0, F.array_join(F.flatten(kept), "\n")).otherwise(text)


def drop_lines(docs: DataFrame) -> DataFrame:
    """docs with recurring lines taken out of text, and n_lines and n_dropped, which replace columns of these names."""
    rows, row = numbered(docs)
    dropped, n = spare(rows, "dropped"), spare(rows, "lines")
    found = dropped_lines(rows, row).withColumnsRenamed({"row_id": row, "dropped": dropped, "n_lines": n})
    out = rows.join(found, row, "left")
    none = F.coalesce(dropped, F.array().cast("array<int>"))
    text = F.when(F.col("text").isNotNull(), without(F.col("text"), none))
    return out.withColumns({"text": text, "n_lines": F.coalesce(n, F.lit(0)), "n_dropped": F.size(none).cast("long")}).drop(row, dropped, n)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS a FROM d),
t AS (
  SELECT r, a, list_transform(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''),
                              lambda x: CASE WHEN regexp_matches(x, '[0-9@]') THEN '{FIELD}' ELSE x END) AS t
  FROM l),
n AS (SELECT *, len(t) AS c, t[:{LEADING}] AS h FROM t WHERE len(t) > 0),
w AS (SELECT DISTINCT c, h, t FROM n),
p AS (SELECT c, h, i, count(DISTINCT x) AS k FROM (SELECT c, h, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS i FROM w) GROUP BY ALL),
f AS (SELECT c, h, list(i ORDER BY i) AS f FROM p WHERE k > {CHILDREN} GROUP BY ALL),
g AS (
  SELECT w.c, w.h, w.t, list_transform(range(1, w.c + 1), lambda i: CASE WHEN list_contains(f.f, i) THEN '{FIELD}' ELSE w.t[i] END) AS s, f.f
  FROM w JOIN f USING (c, h)),
m AS (
  SELECT n.r, n.a, n.c, n.h, CASE WHEN len(list_filter(g.s, lambda x: x <> '{FIELD}')) >= {FIXED} * g.c THEN g.f END AS f,
         CASE WHEN len(list_filter(g.s, lambda x: x <> '{FIELD}')) >= {FIXED} * g.c THEN g.s ELSE n.t END AS s
  FROM n LEFT JOIN g USING (c, h, t)),
o AS (SELECT s, f FROM m GROUP BY s, f HAVING count(DISTINCT r) >= {LEAST_DOCS}),
k AS (
  SELECT m.r, count(*) AS n, list(m.a) FILTER (o.s IS NOT NULL) AS x
  FROM m LEFT JOIN o ON m.s = o.s AND m.f IS NOT DISTINCT FROM o.f GROUP BY m.r)
SELECT d.doc_id, coalesce(k.n, 0) AS n_lines, coalesce(len(k.x), 0) AS n_dropped,
       sha256(coalesce(array_to_string(list_transform(list_filter(list_zip(string_split(d.text, chr(10)), range(len(string_split(d.text, chr(10))))),
              lambda z: NOT coalesce(list_contains(k.x, z[2]), false)), lambda z: z[1]), chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
