"""Benchmark decontamination with a hash set of normalised test n-grams, in DataFrame functions only.

A-Z are lowered; words are runs of a-z, 0-9 and non-ASCII characters. Every window of `size` words of an item, or the
whole of a shorter item, is a gram. While the grams number at most `most`, they go into the plan as a literal hash set:
each row scans its own word positions, first by a window's first word, then by its first and last word, and the windows
left are looked up with their whole text, so a hit is verified by the words themselves and no text is shuffled. For a
larger benchmark, hashes of windows whose first word begins a gram are joined with hashes of the grams, and the few
that meet are verified by their words.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swellframe.llm.common import cut
from swellframe.tables import bounded

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OTHER_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
WORD_CASED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Normalised words of a text; null has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def benchmark_grams(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """benchmark (item_id, text) -> distinct (item_id, len, gram)."""
    words = benchmark.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.lit(size), F.size("w"))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    return words.select("item_id", n.alias("len"), F.explode(grams).alias("gram")).distinct()


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in sorted(values))


NO_HITS = "cast(array() as array<struct<pos: int, len: int>>)"


def _in_row(grams: list[tuple[int, str]]) -> tuple[Column, Column]:
    """The positions in column `w` that can begin a gram, to be named `cand`, and the hits among them: (pos from 1, len)."""
    found = []
    starts = _quoted({g.split(" ", 1)[0] for _, g in grams})
    for n in sorted({n for n, _ in grams}):
        own = [g for k, g in grams if k == n]
        first = _quoted({g.split(" ", 1)[0] for g in own})
        ends = _quoted({g.split(" ", 1)[0] + " " + g.rsplit(" ", 1)[-1] for g in own})
        found.append(f"transform(filter(cand, i -> i + {n - 1} <= size(w) AND w[i - 1] IN ({first}) AND concat(w[i - 1], ' ', w[i + {n - 2}]) IN ({ends}) AND array_join(slice(w, i, {n}), ' ') IN ({_quoted(own)})), i -> named_struct('pos', i, 'len', {n}))")
    cand = f"if(size(w) > 0, filter(sequence(1, size(w)), i -> w[i - 1] IN ({starts})), cast(array() as array<int>))"
    return F.expr(cand), F.expr(f"flatten(array({', '.join(found)}))")


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, most: int = 100_000) -> DataFrame:
    """docs -> `row` (a struct of all columns), `w` (words) and `hits`, an array of (pos, len) of verified occurrences.

    An empty benchmark gives no hits; `hits` of null texts is empty."""
    grams = benchmark_grams(benchmark, size)
    known = [(r.len, r.gram) for r in grams.select("len", "gram").distinct().limit(most + 1).collect()]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    inner = _once(docs.select(row), words_of(F.col("row.text")), "w")
    if not known:
        hits = inner.withColumn("hits", F.expr(NO_HITS))
    elif len(known) <= most:
        cand, at = _in_row(known)
        hits = _once(_once(inner, cand, "cand"), at, "hits")
    else:
        hits = _joined(inner, grams.select("len", "gram").distinct())
    return hits.select("row", "w", "hits")


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a column by way of a generator: unlike a plain column, later filters and lambdas can't take in its
    expression and work it out again for every element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _joined(inner: DataFrame, grams: DataFrame) -> DataFrame:
    """Hits by a join of window hashes with gram hashes, for benchmarks beyond the bound. A text is known by two
    hashes of its words, so that equal texts share their hits and a task that runs again names them alike; window
    rows are 40 bytes each. Hits carry the gram's words and are verified by them."""
    sizes = [r.len for r in grams.select("len").distinct().collect()]  # `size` values at most
    hashed = grams.select("len", "gram", F.xxhash64("gram").alias("h"))
    inner = inner.withColumns({"k1": F.xxhash64("w"), "k2": F.xxhash64(F.lit("w"), "w")})

    def of(n):
        windows_ = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " ")))
        return inner.where(F.size("w") >= n).select("k1", "k2", F.posexplode(windows_).alias("p", "h"), F.lit(n).alias("len"))

    windows = reduce(DataFrame.union, [of(n) for n in sizes])
    met = windows.join(hashed, ["len", "h"]).groupBy("k1", "k2").agg(F.collect_set(F.struct((F.col("p") + 1).alias("pos"), F.col("len"), F.col("gram"))).alias("met"))
    found = inner.join(met, ["k1", "k2"], "left")
    true = F.filter("met", lambda m: F.array_join(F.slice("w", m["pos"], m["len"]), " ") == m["gram"])
    hits = F.transform(true, lambda m: F.struct(m["pos"].alias("pos"), m["len"].alias("len")))
    return found.withColumn("hits", F.coalesce(hits, F.expr(NO_HITS))).drop("k1", "k2", "met")


def hit_positions(hits: str = "hits") -> Column:
    """Distinct word positions, from 1, inside any occurrence."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h.pos, h.pos + h.len - 1))))


def report(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """One row per row of docs (doc_id, text, ...): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and wordless texts have no words and no hits; null item ids and wordless items are left out; repeated rows
    are reported each; ties don't arise; texts of any length are scanned whole. Other columns are ignored. An empty
    table gives an empty result."""
    found = scan(docs.select("doc_id", "text"), benchmark, size)
    grams = F.array_distinct(F.transform("hits", lambda h: F.array_join(F.slice("w", h.pos, h.len), " ")))
    row = found.select("row.doc_id", F.size("w").cast("long").alias("n_words"), F.size(hit_positions()).cast("long").alias("n_hit"), grams.alias("seen"))
    row = cut(row.select("doc_id", "n_words", "n_hit", "seen", *[F.when(F.size("seen") > 0, F.xxhash64(*salt, "seen")).alias(k) for k, salt in (("k1", []), ("k2", [F.lit("items")]))]), "decontam")
    # items are named once for each set of grams, however many rows hold it; clean rows meet nothing
    items = benchmark_grams(benchmark, size).select("gram", F.col("item_id").cast("string").alias("item"))
    sets = row.where("k1 is not null").dropDuplicates(["k1", "k2"]).select("k1", "k2", F.explode("seen").alias("gram"))
    named = sets.join(items, "gram").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    known = bounded(cut(named, "decontam-items"))
    hit = row.where("k1 is not null").join(known, ["k1", "k2"]).select("doc_id", "n_words", "n_hit", "items")
    rows = hit.union(row.where("k1 is null").select("doc_id", "n_words", "n_hit", F.array().cast("array<string>")))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10, most_hit: float = 0.0) -> DataFrame:
    """The rows of docs, all columns kept, whose hit words are at most `most_hit` of their words. Null and wordless texts
    stay, repeated rows fare alike, clashing columns stay as they are; an empty table or benchmark removes nothing."""
    share = F.size(hit_positions()) / F.greatest(F.size("w"), F.lit(1))
    return scan(docs, benchmark, size).where(share <= most_hit).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs with the words inside occurrences, and what stands before each of them, cut from `text`. Null
    texts and texts without a hit stay as they are, and so do all other columns; repeated rows fare alike."""
    at, text = hit_positions(), F.col("row.text")
    pieces = F.regexp_extract_all(text, F.lit(f"{OTHER_CASED}{WORD_CASED}"), F.lit(0))
    left = F.filter(F.transform(pieces, lambda x, i: F.struct(x.alias("x"), F.array_contains(at, i + 1).alias("hit"))), lambda p: ~p.hit)
    joined = F.concat(F.array_join(F.transform(left, lambda p: p.x), ""), F.regexp_extract(text, f"({OTHER_CASED})$", 1))
    rows = scan(docs, benchmark, size).select(F.col("row").withField("text", F.when(F.size("hits") == 0, text).otherwise(joined)).alias("row"))
    return rows.select("row.*")


ORACLE = r"""
WITH bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM bg) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dg.n, item_id FROM dg JOIN bg ON dg.n = bg.n AND dg.gram = bg.gram),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""
