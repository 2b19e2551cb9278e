"""Line removal by site-relative frequency, in DataFrame functions only.

A line's ratio at a host is the number of the host's pages that hold it over all pages of the host. Lines on at least
`min_pages` pages whose ratio exceeds `ratio` are boilerplate of that host and are dropped from its pages. Only hashes
of lines are shuffled, counted before the shuffle; a host has at most (lines a page) / ratio boilerplate lines, which
return to the pages as one table of hashes a host, in `SLOTS` parts so that a line is looked up in one part only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swellframe.llm.common import cut


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _marks(text):
    """Hashes of the distinct lines that aren't blank."""
    return F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x, F.length(x))))


#: Parts of a host's table of boilerplate hashes, and parts in which a host's pages are joined with it.
SLOTS, SALT = 256, 64


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = 0.02, min_pages: int = 3) -> DataFrame:
    """docs (host, text) -> (host, drop array<array<long>>, n), the hashes of each host's boilerplate lines in SLOTS
    parts by their remainder, and how many there are; hosts without any are left out. A null host is a host of its
    own. An empty table gives an empty result."""
    pages = docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages"))
    seen = docs.select(F.col(host).alias("host"), F.explode(_marks(F.col("text"))).alias("mark"))
    counts = seen.groupBy("host", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    over = counts.join(pages.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > ratio * F.col("pages"))
    parts = over.groupBy("host", F.pmod("mark", F.lit(SLOTS)).alias("slot")).agg(F.sort_array(F.collect_list("mark")).alias("marks"))
    held = parts.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("slot", "marks"))).alias("m"), F.sum(F.size("marks")).alias("n"))
    none = F.array().cast("array<bigint>")
    return held.select("host", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long")), lambda k: F.coalesce(F.try_element_at("m", k), none)).alias("drop"), "n")


def drop_lines(docs: DataFrame, host: str = "source", ratio: float = 0.02, min_pages: int = 3, most: int = 200_000) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, text (the lines that stay, joined by newlines).

    Null texts count as one blank line and stay empty; blank lines are never boilerplate; repeated rows count as
    pages of their own; lines on equally many pages fare alike; null ids and texts of any length make no difference.
    Other columns are ignored. An empty table gives an empty result. The hosts' tables are broadcast while they hold
    at most `most` lines (8 bytes each); beyond that every host's pages, in SALT parts, are joined with copies of its
    table in a shuffle."""
    drops = cut(boilerplate(docs, host, ratio, min_pages).withColumnRenamed("host", "h"), "boilerplate")
    size = drops.agg(F.sum("n").alias("n")).first().n or 0
    rows = docs.select("doc_id", F.col(host).alias("host"), _lines(F.col("text")).alias("lines"))
    same = F.col("host").eqNullSafe(F.col("h"))
    if size <= most:
        drops = F.broadcast(drops)
    else:
        drops = drops.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("lines"), F.lit(SALT)))
        same = same & (F.col("salt") == F.col("s"))
    rows = rows.join(drops, same, "left")

    def kept(x):
        mark = F.xxhash64(x, F.length(x))
        return ~F.array_contains(F.element_at("drop", (F.pmod(mark, F.lit(SLOTS)) + 1).cast("int")), mark)

    left = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", kept))
    return rows.select("doc_id", "lines", left.alias("left")).select("doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"), F.array_join("left", "\n").alias("text"))


ORACLE = r"""
WITH l AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT r, doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM l),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
b AS (SELECT c.source, c.line FROM (SELECT source, line, count(DISTINCT r) AS n FROM x WHERE trim(line, ' ') <> '' GROUP BY source, line) c
      JOIN pages p ON c.source IS NOT DISTINCT FROM p.source WHERE n >= 3 AND n > 0.02 * pages)
SELECT x.doc_id, count(*) AS n_lines, count(b.line) AS n_dropped, coalesce(string_agg(x.line, chr(10) ORDER BY x.i) FILTER (WHERE b.line IS NULL), '') AS text
FROM x LEFT JOIN b ON x.source IS NOT DISTINCT FROM b.source AND x.line = b.line GROUP BY x.r, x.doc_id
"""
