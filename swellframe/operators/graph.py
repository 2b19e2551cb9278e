"""Connected components of a link table.

A table of links (node, smaller node) shrinks to one link a node, round after round. Every task first replaces the
links that it holds, in blocks of bounded size, by a forest with the same trees. A round then keeps each node's
smallest neighbour, links its other ones to that, and takes every neighbour's own smallest one in its place, which
halves the trees' depth. No node's neighbours are ever gathered: groups are reduced before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from swellframe.tables import cut, discard

#: Links that a task replaces by a forest at once.
BLOCK = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links -> (node, smallest node of its tree), for all nodes but the smallest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        low, high = np.minimum(p, q), np.maximum(p, q)
        live = low < high
        if not live.any():
            break
        np.minimum.at(label, high[live], low[live])
        while (label != label[label]).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _forests(batches):
    held, size = [], 0

    def out():
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(a, b)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def components(links: DataFrame) -> DataFrame:
    """(a long, b long) links -> (node, comp): comp is the smallest node that links reach.

    Nulls and self links are ignored; no links: no rows. Rounds grow with the logarithm of the longest path. The
    result is read from a table in the shared folder."""
    plain = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    tree = cut(plain.mapInArrow(_forests, "a long, b long"), "tree")
    while True:
        several, deep = Observation(), Observation()
        low = cut(tree.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).observe(several, F.count_if(F.col("low") < F.col("high")).alias("n")), "low")
        more = tree.join(low.where("low < high").select("a", "low"), "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        every = low.select("a", F.col("low").alias("b")).union(more)
        up = low.select(F.col("a").alias("b"), F.col("low").alias("up"))
        jumped = every.join(up, "b", "left").observe(deep, F.count("up").alias("n")).select("a", F.coalesce("up", "b").alias("b"))
        new = cut(jumped.mapInArrow(_forests, "a long, b long"), "tree")
        done = not several.get.get("n") and not deep.get.get("n")
        discard(tree)
        if done:
            discard(new)
            return low.select(F.col("a").alias("node"), F.col("low").alias("comp")).union(low.select("low", "low").distinct())
        discard(low)
        tree = new
