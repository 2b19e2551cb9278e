"""Ranked lexical search by impact-sorted lists and no random accesses (NRA).

A term's impact in a document is what it adds to a score; scores are sums of impacts over a query's terms. Terms are
counted inside the rows, for the words of the queries only, and documents are dealt into shards of about `shard_rows`.
A task inverts its shard into lists of falling impact and answers every query from sequential reads of its lists, side
by side and deeper each round. A document's lower bound is what was read of it; its upper bound adds, for each list in
which it was not met, the impact last read there. Reading stops when no document outside can reach the kth lower
bound, not even by a tie, and the bounds of all that can are equal, so members, ties and scores are settled. A first
round over one shard in `FIRST` gives every query a score that k documents reach; the other shards start from it.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swellframe.llm.common import cut, let_go

#: Signs of terms: digits, letters and everything beyond ASCII, in Java's syntax.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: UTF-8 bytes with A-Z lowered and every sign outside terms as a blank.
_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: Shards for each one of the first round, entries of a list read in the first step, posting entries of a shard.
FIRST, STEP, SHARD_ENTRIES = 16, 64, 4_000_000


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, with repeats; null has none."""
    return (text or b"").translate(_BYTES).split()


def _counter(vocabulary: dict[bytes, int]):
    def run(batches):
        let_go()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, lengths, offsets, terms, counts = [], [], [0], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    words = terms_of(text.as_py())
                    if words:
                        seen = Counter(map(vocabulary.get, words))
                        seen.pop(None, None)
                        ids.append(doc)
                        lengths.append(len(words))
                        terms.extend(seen)
                        counts.extend(seen.values())
                        offsets.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impacts of terms of weights w that stand tf times in documents of n terms, all 64-bit integers."""
    n, tf = n.astype(np.int64), tf.astype(np.int64)
    if int(n.max(initial=0)) * n_docs * 25 < 2**63:
        share = 25 * n * n_docs // n_terms
    else:
        share = np.array([25 * int(x) * n_docs // n_terms for x in n], np.int64)
    return w * (1_000_000_000 * tf // (1000 * tf + 12 * (75 + share)))


def invert(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each term's (documents, impacts) by falling impact, without those of impact 0."""
    order = np.lexsort((-impact, term))
    order = order[impact[order] > 0]
    bounds = np.searchsorted(term[order], np.arange(n_terms + 1))
    doc, impact = doc[order].astype(np.int32), impact[order]
    return [(doc[a:b], impact[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def settled(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores): all documents whose score is `floor` or more and at least the kth highest, ties too."""
    lists = [x for x in lists if len(x[0])]
    lower, met = np.zeros(n_docs, np.int64), np.zeros((n_docs, len(lists)), bool)
    longest, at, step = max((len(d) for d, _ in lists), default=0), 0, STEP
    while True:
        last = np.zeros(len(lists), np.int64)  # no entry that is still unread has more
        for j, (docs, impact) in enumerate(lists):
            if at < len(docs):
                part = docs[at : at + step]
                lower[part] += impact[at : at + step]
                met[part, j] = True
                if at + step < len(docs):
                    last[j] = impact[at + step - 1]
        at, step = at + step, step * 2
        least = max(floor, int(np.partition(lower, n_docs - k)[n_docs - k]) if n_docs > k else 0, 1)
        most = int(last.sum())
        near = np.flatnonzero(lower + most >= least)
        room = ~met[near] @ last
        able = lower[near] + room >= least
        if at >= longest or most < least and not room[able].any():
            near = near[lower[near] >= least]
            return near, lower[near]


def _searcher(weights: np.ndarray, queries: list[tuple[int, np.ndarray, np.ndarray]], floors: dict[int, int], n_docs: int, n_terms: int, k: int):
    def run(shard: pa.Table) -> pa.Table:
        lists = [shard.column(c).combine_chunks() for c in ("terms", "counts")]
        sizes = np.diff(lists[0].offsets.to_numpy())
        term, tf = (x.flatten().to_numpy() for x in lists)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        n = shard.column("n").to_numpy()
        index = invert(term, doc, impacts(weights[term], tf, n[doc], n_docs, n_terms), len(weights))
        ids, out = shard.column("doc_id").combine_chunks(), ([], [], [])
        order = np.argsort(ids.fill_null(2**63 - 1).to_numpy(), kind="stable")
        place = np.argsort(order)
        for item, q, times in queries:
            found, score = settled([(index[t][0], index[t][1] * m) for t, m in zip(q, times, strict=True)], len(sizes), k, floors.get(item, 1))
            best = np.lexsort((place[found], -score))[:k]
            out[0].append(np.full(len(best), item))
            out[1].append(found[best])
            out[2].append(score[best])
        item, found, score = (np.concatenate(x).astype(np.int64) for x in out)
        return pa.table({"item": pa.array(item), "doc_id": ids.take(pa.array(found)), "score": pa.array(score)})

    return run


def _ranked(found: DataFrame, k: int, by: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _search(docs: DataFrame, asked: list, k: int, shard_rows: int) -> DataFrame:
    """asked: (item_id, term, times) of one block of items."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({r.term.encode() for r in asked}))}
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counted = cut(counted.mapInArrow(_counter(vocabulary), "doc_id long, n long, terms array<int>, counts array<int>"), "term-counts")
    stats = counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("entries")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most one a word of the block
        df[r.t] = r["count"]
    weights = np.array([weight(stats.docs, int(x)) for x in df], np.int64)
    by_item: dict[int, dict[int, int]] = {}
    for r in asked:
        by_item.setdefault(r.item_id, {})[vocabulary[r.term.encode()]] = r.times
    queries = [(i, np.array(list(q), np.int64), np.array(list(q.values()), np.int64)) for i, q in sorted(by_item.items())]
    n_shards = max(1, -(-stats.docs // shard_rows), -(-stats.entries // SHARD_ENTRIES))
    # numbers of rows of a written table: the same whenever a task reads them again, and even if rows are alike
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_shards))
    dealt = counted.withColumn("shard", shard).where(F.size("terms") > 0)

    def found(here, floors):
        return here.groupBy("shard").applyInArrow(_searcher(weights, queries, floors, stats.docs, stats.terms, k), "item long, doc_id long, score long")

    first = cut(found(dealt.where(F.col("shard") % FIRST == 0), {}), "lexical-first")
    if n_shards > 1:
        kth = _ranked(first, k, "item").where(F.col("rank") == k).select("item", "score").collect()  # one a query at most
        first = first.union(found(dealt.where(F.col("shard") % FIRST != 0), {r.item: r.score for r in kth}))
    return _ranked(first, k, "item").select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, shard_rows: int = 8_192, block_terms: int = 200_000) -> DataFrame:
    """docs (doc_id, text, ...) and items (item_id, text, ...) -> item_id, rank, doc_id, score: each item's k
    highest-scoring documents with a score above 0, equal scores by ascending id, null ids last.

    Every row of docs is a document, also repeated rows and those of null or repeated ids; null texts and texts
    without terms count for nothing. Items of null ids and without terms find nothing; distinct texts of one item id
    are one item. Texts of any length are read whole; other columns are ignored; an empty table on either side gives an
    empty result. Items are asked in blocks of about `block_terms` terms, which bounds what the tasks are sent; each
    block counts its terms in all documents."""
    texts = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    words = texts.select("item_id", F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term"))
    pairs = cut(words.groupBy("item_id", "term").agg(F.count("*").alias("times")), "query-terms")
    n = max(1, -(-pairs.count() // block_terms))
    block = F.pmod(F.xxhash64("item_id"), F.lit(n))
    return reduce(DataFrame.union, [_search(docs, pairs.where(block == b).collect(), k, shard_rows) for b in range(n)])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY item_id, term),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n_words, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n_words, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n_words, term),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term, s.n),
i AS (SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n_words * s.n) // s.l))) AS impact FROM p JOIN f USING (term), s),
x AS (SELECT item_id, r, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM i JOIN q USING (term) GROUP BY item_id, r, doc_id),
o AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
"""
