"""Exact inner-product top-k by ball trees, branch and bound, one tree per shard.

Rows are dealt by a hash of their id into shards of about `shard_rows`, each packed with its ball tree into one row and
written once. Queries are packed into blocks. A task takes one shard and some blocks of queries, so a shard's data
moves once for every `PARTS` blocks. It works in two rounds: the first looks at one shard in `FIRST`, and its kth scores
are handed to all tasks of the second, which prune with the better of that and what they find themselves. A node's
upper bound is q.centre + |q| * radius; nodes are opened in its descending order until it falls below the kth score.
Scores are integers, so bounds are widened by a relative 1e-9 and equal scores are never pruned.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swellframe.llm.common import cut

LEAF = 96
#: Blocks of queries that a task takes to its shard, and shards for each one of the first round.
PARTS, FIRST = 16, 16


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, v array<long>) of floor(scale * x); rows with a null id, a null or empty vector
    or a component that is null or not finite are left out."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    fine = x.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0))
    fine = fine.where(F.forall("e", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))))
    return fine.select("vec_id", F.transform("e", lambda v: F.floor(v * scale)).alias("v"))


def _matrix(rows) -> np.ndarray:
    width = max(len(r) for r in rows)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, node bounds (start, end, left child or -1), centres and radii. Nodes split at the median
    along the line between two far points."""
    order, nodes, centres, radii = np.arange(len(x)), [], [], []
    stack = [(0, len(x), -1, 0)]
    while stack:
        a, b, parent, side = stack.pop()
        part = x[order[a:b]].astype(float)
        c = part.mean(axis=0)
        far = ((part - c) ** 2).sum(axis=1)
        at = len(nodes)
        nodes.append([a, b, -1, -1])
        centres.append(c)
        radii.append(np.sqrt(far.max()))
        if parent >= 0:
            nodes[parent][2 + side] = at
        if b - a > LEAF and radii[-1] > 0:
            one = part[far.argmax()]
            two = part[((part - one) ** 2).sum(axis=1).argmax()]
            along = np.argsort(part @ (two - one), kind="stable")
            order[a:b] = order[a:b][along]
            mid = (a + b) // 2
            stack += [(a, mid, at, 0), (mid, b, at, 1)]
    return order, np.array(nodes, np.int64), np.array(centres), np.array(radii)


def _pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id", kind="stable")
    x = _matrix(pdf.v.tolist())
    order, nodes, centres, radii = build(x)
    return pd.DataFrame({"shard": [int(pdf.shard.iloc[0])], "dim": [x.shape[1]], "ids": [pdf.vec_id.to_numpy(np.int64)[order].tobytes()], "x": [x[order].tobytes()], "nodes": [nodes.tobytes()], "centres": [centres.tobytes()], "radii": [radii.tobytes()]})


def _pack_queries(pdf: pd.DataFrame) -> pd.DataFrame:
    x = _matrix(pdf.v.tolist())
    return pd.DataFrame({"block": [int(pdf.block.iloc[0])], "qdim": [x.shape[1]], "qids": [pdf.vec_id.to_numpy(np.int64).tobytes()], "q": [x.tobytes()], "floor": [pdf.floor.to_numpy(np.int64).tobytes()]})


def _widen(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] == dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


class _Search:
    """The k best of each query of one block, over the shards seen so far; scores below a query's floor are no use."""

    def __init__(self, row, k: int):
        self.ids = np.frombuffer(row.qids, np.int64)
        self.q = np.frombuffer(row.q, np.int64).reshape(-1, row.qdim)
        self.floor = np.frombuffer(row.floor, np.int64)
        self.k = k
        self.best: list[list[tuple[int, int]]] = [[] for _ in self.ids]  # heaps of (score, -vec_id)

    def add(self, row) -> None:
        ids, x = np.frombuffer(row.ids, np.int64), np.frombuffer(row.x, np.int64).reshape(-1, row.dim)
        nodes, radii = np.frombuffer(row.nodes, np.int64).reshape(-1, 4), np.frombuffer(row.radii, float)
        dim = max(row.dim, self.q.shape[1])
        x, q = _widen(x, dim), _widen(self.q, dim)
        centres = _widen(np.frombuffer(row.centres, float).reshape(-1, row.dim), dim)
        largest = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * dim
        if largest >= 2**63:
            raise ValueError("scores don't fit 64 bits; use a smaller scale")
        xs, qs = (x.astype(float), q.astype(float)) if largest < 2**53 else (x, q)
        bound = qs.astype(float) @ centres.T
        norm = np.linalg.norm(qs.astype(float), axis=1)
        bound += norm[:, None] * radii
        bound += np.abs(bound) * 1e-9 + norm[:, None] * (np.linalg.norm(centres, axis=1) + radii) * 1e-12 + 1e-6
        for i, heap in enumerate(self.best):
            own, ub, floor = self.ids[i], bound[i], int(self.floor[i])
            open_ = [(-ub[0], 0)]
            while open_:
                u, node = heapq.heappop(open_)
                least = max(heap[0][0], floor) if len(heap) == self.k else floor
                if -u < least:
                    break
                a, b, left, right = nodes[node]
                if left >= 0:
                    heapq.heappush(open_, (-ub[left], left))
                    heapq.heappush(open_, (-ub[right], right))
                    continue
                s = xs[a:b] @ qs[i]
                for j in np.flatnonzero(s >= least):
                    if ids[a + j] != own:
                        item = (int(s[j]), -int(ids[a + j]))
                        if len(heap) < self.k:
                            heapq.heappush(heap, item)
                        elif item > heap[0]:
                            heapq.heapreplace(heap, item)

    def rows(self) -> pd.DataFrame:
        out = [(int(q), -n, s) for q, heap in zip(self.ids, self.best, strict=True) for s, n in heap]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def _searcher(k: int):
    def run(key, shard: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")]
        for block in blocks.itertuples(index=False):
            search = _Search(block, k)
            for row in shard.itertuples(index=False):
                search.add(row)
            out.append(search.rows())
        return pd.concat(out)

    return run


_FOUND = "query_id long, vec_id long, score long"


def _pairs_found(shards: DataFrame, queries: DataFrame, numbers: Column, n_blocks: int, k: int) -> DataFrame:
    """shards (packed) and queries (vec_id, v, floor) -> the k best of each query in each of the shards of the numbers."""
    parts = -(-n_blocks // PARTS)
    block = F.pmod(F.xxhash64(F.col("vec_id") + 1), F.lit(n_blocks))
    blocks = queries.withColumn("block", block).groupBy("block").applyInPandas(_pack_queries, "block long, qdim long, qids binary, q binary, floor binary")
    here = shards.where(F.array_contains(numbers, F.col("shard"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    there = blocks.withColumn("part", F.pmod("block", F.lit(parts)).cast("int")).withColumn("shard", F.explode(numbers))
    return here.groupBy("shard", "part").cogroup(there.groupBy("shard", "part")).applyInPandas(_searcher(k), _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, shard_rows: int = 8_192, block_rows: int = 512) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> query_id, rank, vec_id, score: for each row whose id is divisible by
    `every`, the k other rows of highest integer inner product, ties to the smaller vec_id.

    Vectors of different lengths are compared as if padded with zeros; rows that share the query's id are its own.
    Repeated ids among the candidates are ranked each. Rows of null or non-finite vectors take no part; an empty
    table or no query gives an empty result. Scores that could pass 64 bits are an error. Other columns are ignored."""
    x = quantised(vectors, scale)
    n = x.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    n_shards, n_blocks = max(1, -(-n.n // shard_rows)), max(1, -(-n.q // block_rows))
    dealt = x.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)))
    shards = cut(dealt.groupBy("shard").applyInPandas(_pack_shard, "shard long, dim long, ids binary, x binary, nodes binary, centres binary, radii binary"), "shards")
    queries = x.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    lowest = F.lit(-(2**63)).cast("long")
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))
    first = cut(_pairs_found(shards, queries.withColumn("floor", lowest), F.filter(numbers, lambda s: s % FIRST == 0), n_blocks, k), "first")
    if n_shards == 1:
        found = first
    else:
        kth = _ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        known = queries.join(kth, "vec_id", "left").withColumn("floor", F.coalesce("floor", lowest))
        found = first.union(_pairs_found(shards, known, F.filter(numbers, lambda s: s % FIRST != 0), n_blocks, k))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
