"""Mixing to target weights by iterative proportional fitting (raking).

Topics are clusters of documents: their words' hashed random vectors, weighted by rarity, are summed, and the directions
of these sums are grouped around `TOPICS` centres fitted on all of them. Tokens, words between white space, are
summed by cell of source, language and topic. Raking scales the cells until each marginal has its target share; a
cell's weight is its raked over its present tokens. Documents are then sampled on their own, by a hash of their id.
Their probabilities are raked once more under the cap of 1, so that the expected tokens are the wanted fraction of all
tokens and every marginal has its target share of them. A value with fewer tokens than that is taken whole, the others
of its marginal keep their proportions, and shares() and a warning tell the shortfall.
"""

from __future__ import annotations

import logging

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swellframe.llm.common import cut, discard, lean
from swellframe.llm.quality import BUCKETS, slices, words

MARGINS = ("source", "lang", "topic")
TOPICS, DIRECTIONS = 8, 64
#: One in whole numbers: sums of directions don't depend on how rows are dealt.
UNIT = 1 << 14
_log = logging.getLogger(__name__)
_SIGNS = (np.random.default_rng(4_242).integers(0, 2, (BUCKETS, DIRECTIONS)) * 2 - 1).astype(np.float32)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def token_count(text: str | None) -> int:
    """Words between ASCII white space, one at least."""
    b = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass"), np.uint8)
    blank = _BLANK[b]
    return max(int((blank[:-1] & ~blank[1:]).sum()), 1)


#: Characters of texts worked on at once.
BLOCK = 1 << 16


def word_counts(texts: list[str | None]):
    """(texts' numbers, buckets, counts) of all words, some texts at a time, in order; a longer text's slices are
    counted together."""
    total, at = None, -1
    for first, part, goes_on in slices(texts, BLOCK):
        if total is not None and not goes_on:
            yield np.full(len(u := np.flatnonzero(total)), at), u, total[u]
            total = None
        w = words(part)
        if len(texts[first] or "") > BLOCK:
            n = np.bincount(w.bucket, minlength=BUCKETS)
            total, at = n if total is None else total + n, first
        else:
            key, n = np.unique((w.doc + first) * BUCKETS + w.bucket, return_counts=True)
            yield key // BUCKETS, key % BUCKETS, n
    if total is not None:
        yield np.full(len(u := np.flatnonzero(total)), at), u, total[u]


def directions(texts: list[str | None], rarity: np.ndarray) -> np.ndarray:
    """Unit sums of the texts' word vectors, in whole 2^-14ths; zeros for texts without words."""
    out = np.zeros((len(texts), DIRECTIONS), np.float32)
    for doc, bucket, n in word_counts(texts):
        if len(doc):
            start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            out[doc[start]] = np.add.reduceat((rarity[bucket] * np.log1p(n)).astype(np.float32)[:, None] * _SIGNS[bucket], start, axis=0)
    return np.rint(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9) * UNIT).astype(np.int16)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x.astype(float) @ centres.T).argmax(axis=1)  # exact: all are whole numbers


@dataclass
class TopicModel:
    rarity: np.ndarray  # by bucket
    centres: np.ndarray  # whole numbers, as directions are

    def near(self, x: np.ndarray) -> list[str]:
        """Topic of each row of directions(), "empty" if it is zero; of equally near centres the first."""
        best = _nearest(x, self.centres) if len(self.centres) else np.zeros(len(x), int)
        return [f"topic{k}" if v else "empty" for k, v in zip(best, x.any(axis=1), strict=True)]

    def name(self, texts: list[str | None]) -> list[str]:
        """Topic of each text, "empty" if it has no words."""
        return self.near(directions(texts, self.rarity))


def _rarity(docs: DataFrame) -> np.ndarray:
    """Rarity of every bucket by its frequency in all documents, 1 for a word in each; each task adds up its own first."""

    @lean
    def run(batches):
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(first, 256).to_pylist()
                n += len(texts)
                for _, bucket, _ in word_counts(texts):
                    total += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, total[at]])], names=["bucket", "n"])

    found = docs.where("text is not null").select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS + 1 rows
    counts = np.zeros(BUCKETS + 1)
    counts[found.bucket.to_numpy(int)] = found.n  # the last one counts documents
    return (np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 1).astype(np.float32)


def _draw() -> Column:
    """A number from 0 to 1 by a row's id, or by its text without one."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))))
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), key), 11) / F.lit(float(1 << 53))


def _placed(docs: DataFrame, rarity: np.ndarray) -> DataFrame:
    """docs -> doc_id, source, lang, draw, tokens, x: a row's directions as bytes, null without words."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)
    names = ["doc_id", "source", "lang", "draw", "tokens", "x"]

    @lean
    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = part.column(4).to_pylist()
                x = directions(texts, shared.value)
                rows = [v.tobytes() if some else None for v, some in zip(x, x.any(axis=1), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([token_count(t) for t in texts], pa.int64()), pa.array(rows, pa.binary())], names=names)

    own = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), _draw().alias("draw"), "text")
    return own.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, lang string, draw double, tokens long, x binary")


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(v or bytes(2 * DIRECTIONS) for v in column.to_pylist()), np.int16).reshape(-1, DIRECTIONS)


def _named(placed: DataFrame, model: TopicModel) -> DataFrame:
    """Rows of _placed() with their topic in place of x."""

    @lean
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(model.near(_unpacked(batch.column(5))), pa.string())], names=["doc_id", "source", "lang", "draw", "tokens", "topic"])

    model = TopicModel(np.empty(0), model.centres)
    return placed.mapInArrow(run, f"doc_id {placed.schema['doc_id'].dataType.simpleString()}, source string, lang string, draw double, tokens long, topic string")


def _sums(placed: DataFrame, rows: int, columns: int, of) -> np.ndarray:
    """The sum of of(x), a matrix of whole numbers, over all directions x that are placed."""

    @lean
    def run(batches):
        total = np.zeros((rows, columns), np.int64)
        for batch in batches:
            total += of(_unpacked(batch.column(0)).astype(float)).astype(np.int64)
        k, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(d), pa.array(total[k, d])], names=["k", "d", "s"])

    got = placed.where("x is not null").select("x").mapInArrow(run, "k long, d long, s long").groupBy("k", "d").agg(F.sum("s").alias("s")).toPandas()  # rows x columns
    out = np.zeros((rows, columns))
    out[got.k.to_numpy(int), got.d.to_numpy(int)] = got.s
    return out


def _clusters(placed: DataFrame, topics: int, part) -> tuple[np.ndarray, np.ndarray]:
    """Unit sums, in whole numbers, of the rows in each part(x), zeros for empty ones, and numbers of rows."""
    sums = _sums(placed, topics, DIRECTIONS + 1, lambda x: np.eye(topics)[part(x)].T @ np.c_[x, np.ones(len(x))])
    unit = sums[:, :-1] / np.maximum(np.linalg.norm(sums[:, :-1], axis=1, keepdims=True), 1e-9)
    return np.rint(unit * UNIT), sums[:, -1]


def _fit(docs: DataFrame, topics: int = TOPICS, rounds: int = 30) -> tuple[TopicModel, DataFrame]:
    """The model of fit_topics() and the table of placed rows."""
    rarity = _rarity(docs)
    placed = cut(_placed(docs, rarity), "placed")
    total = _sums(placed, DIRECTIONS + 1, DIRECTIONS + 1, lambda x: (y := np.c_[x, np.ones(len(x))]).T @ y)
    n = total[-1, -1]
    if not n:
        return TopicModel(rarity, np.zeros((0, DIRECTIONS))), placed
    mean = total[-1, :-1] / n
    axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))[1][:, ::-1][:, : max(1, (topics - 1).bit_length())]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)
    bits = 1 << np.arange(axes.shape[1])
    centres, size = _clusters(placed, topics, lambda x: (((x - mean) @ axes > 0) @ bits) % topics)
    centres = centres[size > 0]
    for _ in range(rounds):
        new, size = _clusters(placed, len(centres), lambda x, c=centres: _nearest(x, c))
        new = np.where(size[:, None] > 0, new, centres)
        turned = 1 - (new * centres).sum(axis=1).min() / UNIT**2
        centres = new
        if turned < 1e-4:
            break
    return TopicModel(rarity, centres[np.argsort(-size, kind="stable")]), placed


def fit_topics(docs: DataFrame, topics: int = TOPICS, rounds: int = 30) -> TopicModel:
    """docs (source, lang, text) -> centres fitted on all documents; the largest cluster is topic 0. Rarities are the
    document frequencies of all.

    Directions are written once, 128 bytes a document. The first centres are the sums on either side of the mean along
    the axes of most spread; a round gives each document to its nearest centre and sums again in Spark, until no centre
    turns by a degree any more."""
    model, placed = _fit(docs, topics, rounds)
    discard(placed)
    return model


def tempered(cells: pd.DataFrame, power: float = 0.7) -> dict[str, dict]:
    """Target shares: each marginal's present share to a power, which lifts the small ones."""
    out = {}
    for m in MARGINS:
        share = cells.groupby(m, dropna=False, sort=True).tokens.sum().astype(float) ** power
        out[m] = (share / share.sum()).to_dict()
    return out


def _value(x):
    """A marginal's value as a key; nulls are one value, apart from any text."""
    return None if x is None or x != x else x


def _plans(cells: pd.DataFrame, targets: dict[str, dict]) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each marginal: its name, codes of the cells, values, target shares of the values (they sum to 1)."""
    present = cells.tokens.to_numpy(float)
    plans = []
    for m in MARGINS:
        codes, values = pd.factorize(cells[m], use_na_sentinel=False)
        now = np.bincount(codes, present, len(values))
        named = {_value(k): v for k, v in targets.get(m, {}).items()}
        want = np.array([named.get(_value(v), np.nan) for v in values], float)
        free = np.isnan(want)
        rest = max(0.0, 1 - np.nansum(want))
        want[free] = now[free] / max(now[free].sum(), 1e-300) * rest if free.any() else 0
        if want.sum() > 0:
            plans.append((m, codes, values, want / want.sum()))
    return plans


def rake(cells: pd.DataFrame, targets: dict[str, dict], rounds: int = 200, tolerance: float = 1e-10) -> np.ndarray:
    """Weights of cells (source, lang, topic, tokens): raked over present tokens, with a total as before.

    Values without a target keep what they have of the remaining share; targets without cells are left out and the
    rest is scaled up. Marginals that no weights meet together are met as closely as the last round leaves them."""
    present = cells.tokens.to_numpy(float)
    fitted = present.copy()
    plans = [(codes, share * present.sum()) for _, codes, _, share in _plans(cells, targets)]
    for _ in range(rounds):
        before = fitted.copy()
        for codes, want in plans:
            have = np.bincount(codes, fitted, len(want))
            fitted *= np.divide(want, have, out=np.zeros_like(want), where=have > 0)[codes]
        if np.abs(fitted - before).max(initial=0) <= tolerance * max(present.sum(), 1):
            break
    return np.divide(fitted, present, out=np.zeros_like(fitted), where=present > 0)


def _level(share: np.ndarray, low: np.ndarray, high: np.ndarray, total: float) -> np.ndarray:
    """Amounts in proportion to the shares, but from low to high, that sum to the total."""
    a, b = 0.0, 1.0
    at = lambda s: np.clip(s * share, low, high)
    while at(b).sum() < total and b < 1e30:
        b *= 2
    for _ in range(200):
        mid = (a + b) / 2
        a, b = (mid, b) if at(mid).sum() < total else (a, mid)
    return at(b)


#: How far raking may take a cell from its present tokens, up or down.
FAR = 1e12


def probabilities(cells: pd.DataFrame, targets: dict[str, dict], fraction: float, rounds: int = 2000, tolerance: float = 1e-12) -> np.ndarray:
    """Sampling probabilities of cells, raked under the cap of 1: the expected tokens are the fraction of all (or all
    that values with a target above 0 have), and each marginal has its target shares of them.

    Values that lack the tokens are taken whole first, marginal after marginal; all others keep their proportions.
    Marginals that no probabilities meet together are met as closely as the last round leaves them; the factors of their
    cells would grow and fall without end, so they stay within `FAR`, and the expected tokens are as wanted."""
    present = cells.tokens.to_numpy(float)
    plans = [(codes, share) for _, codes, _, share in _plans(cells, targets)]
    usable = present > 0
    for codes, share in plans:
        usable &= (share > 0)[codes]
    total = min(fraction * present.sum(), present[usable].sum())
    whole = np.zeros(len(present), bool)
    while True:
        free = usable & ~whole
        wants = []
        for codes, share in plans:
            taken = np.bincount(codes, present * whole, len(share))
            have = np.bincount(codes, present * free, len(share))
            want = _level(share, taken, taken + have, total) - taken
            wants.append((codes, want))
            if (more := free & (want >= have * (1 - 1e-9))[codes]).any():
                whole |= more
                break
        else:
            break
    x = u = present * free
    for _ in range(rounds):
        before = x
        for codes, want in wants:
            clipped, factor = np.zeros(len(u), bool), np.zeros(len(want))
            while True:  # sum(min(present, factor * u)) = want, from below
                slope = np.bincount(codes, u * ~clipped, len(want))
                left = want - np.bincount(codes, present * clipped, len(want))
                factor = np.divide(left, slope, out=factor, where=slope > 0)
                now = clipped | free & (factor[codes] * u > present)
                if (now == clipped).all():
                    break
                clipped = now
            u, x = np.clip(factor[codes] * u, free * present / FAR, free * present * FAR), np.minimum(factor[codes] * u, present)
        if np.abs(x - before).max(initial=0) <= tolerance * max(present.sum(), 1):
            break
    return np.where(whole, 1.0, np.divide(x, present, out=np.zeros_like(x), where=present > 0))


def reached(cells: pd.DataFrame, targets: dict[str, dict]) -> pd.DataFrame:
    """cells with a probability -> margin, value, target, share (expected), shortfall: one row per marginal value."""
    expected = (cells.tokens * cells.probability).to_numpy(float)
    rows = []
    for m, codes, values, target in _plans(cells, targets):
        share = np.bincount(codes, expected, len(values)) / max(expected.sum(), 1e-300)
        rows += [(m, None if v is None or v != v else str(v), float(t), float(g), max(0.0, float(t - g))) for v, t, g in zip(values, target, share, strict=True)]
    return pd.DataFrame(rows, columns=["margin", "value", "target", "share", "shortfall"])


def calibrate(tokens: np.ndarray, weights: np.ndarray, wanted: float) -> float:
    """The factor c with sum(tokens * min(1, c * weight)) = wanted, by bisection; all that can be had if that's less."""
    low, high = 0.0, 1.0
    reach = lambda c: float((tokens * np.minimum(1, c * weights)).sum())
    while reach(high) < wanted and high < 1e12:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if reach(mid) < wanted else (low, mid)
    return high


def _marked(docs: DataFrame, topic: Column | None, model: TopicModel | None) -> DataFrame:
    """docs as c0, c1, ... with `topic`, `tokens` and `draw` from 0 to 1 behind them."""
    at = docs.columns.index("text")
    given = F.lit(None).cast("string") if topic is None else topic.cast("string")
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)], given.alias("topic"), _draw().alias("draw"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS and TOPICS x DIRECTIONS numbers

    @lean
    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = part.column(at).to_pylist()
                names = part.column(part.num_columns - 2) if shared.value is None else pa.array(shared.value.name(texts), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], names, pa.array([token_count(t) for t in texts], pa.int64()), part.column(part.num_columns - 1)], names=[*[f"c{k}" for k in range(part.num_columns - 2)], "topic", "tokens", "draw"])

    kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema))
    return plain.mapInArrow(run, f"{kinds}, topic string, tokens long, draw double")


def _model(docs: DataFrame, topic: Column | None) -> tuple[TopicModel | None, DataFrame | None]:
    return (None, None) if topic is not None else _fit(docs)


#: Cells that are broadcast; more are joined in a shuffle.
BROADCAST_CELLS = 100_000


def _cell_sums(docs: DataFrame, topic: Column | None, model: TopicModel | None, placed: DataFrame | None) -> DataFrame:
    """source, lang, topic, tokens of every cell; placed rows have what the texts would give."""
    if placed is not None:
        return _named(placed, model).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))
    own = docs.select(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("text"), topic.alias("given"))
    marked = _marked(own, F.col("given"), None)
    return marked.groupBy(F.col("c1").cast("string").alias("source"), F.col("c2").cast("string").alias("lang"), "topic").agg(F.sum("tokens").alias("tokens"))


def _level_of(margin: DataFrame, total: float) -> float:
    """The s with sum(least(s * share, have)) = total over a table (share, have): many candidates are summed at once."""

    def sums(points):
        row = margin.agg(*[F.sum(F.least(F.col("share") * float(p), F.col("have"))).alias(f"a{k}") for k, p in enumerate(points)]).first()
        return np.array([v or 0.0 for v in row])

    points = np.concatenate([[0.0], total * 2.0 ** np.arange(48)])
    for _ in range(7):
        at = min(int(np.searchsorted(sums(points), total)), len(points) - 1)
        points = np.linspace(points[max(at - 1, 0)], points[at], 33)
    return float(points[-1])


#: Factors at which a capped sum is known; between them it is taken as straight.
_FACTORS = np.array(sorted([2.0**k for k in range(-8, 9)] + [0.8, 0.9, 0.97, 0.99, 0.999, 1.001, 1.01, 1.03, 1.1, 1.25]))


def _capped_steps(batches):
    """Rows (value, ff, want, sums) -> value, ff, fu: the factor at which a value's capped sum is as wanted."""
    for pdf in batches:
        fu = [float(np.interp(w, h, _FACTORS)) if w > 0 else 0.0 for w, h in zip(pdf.want, pdf.sums, strict=True)]
        yield pd.DataFrame({"value": pdf.value, "ff": pdf.ff, "fu": np.array(fu, float)})


def raked_table(cells: DataFrame, targets: dict[str, dict] | None = None, fraction: float = 0.8, rounds: int = 40, power: float = 0.7, tolerance: float = 1e-7) -> DataFrame:
    """cells (source, lang, topic, tokens) -> with weight and probability, as rake() and probabilities() give them but
    over tables: for cells too many for the driver. Every margin's sums are shuffled after they are added up in the
    tasks; each step is written, so that lost executors repeat one step. Rounds end when no factor is off by more than
    the tolerance."""
    now = cut(cells.select(*MARGINS, F.col("tokens").cast("double").alias("tokens"), F.col("tokens").cast("double").alias("f"), F.col("tokens").cast("double").alias("u")), "cells")
    present = now.agg(F.sum("tokens")).first()[0] or 0.0
    margins = {}
    for m in MARGINS:
        have = now.groupBy(F.col(m).alias("value")).agg(F.sum("tokens").alias("have"))
        if targets is None:
            x = have.withColumn("share", F.pow("have", F.lit(power)))
        else:
            rows = [(_value(k), float(v)) for k, v in targets.get(m, {}).items()]
            known = cells.sparkSession.createDataFrame(rows, "named string, given double")
            x = have.join(known, F.col("value").eqNullSafe(F.col("named")), "left")
            free = x.where("given is null").agg(F.sum("have")).first()[0] or 0.0
            met = x.agg(F.sum("given")).first()[0] or 0.0
            x = x.select("value", "have", F.coalesce("given", F.col("have") / max(free, 1e-300) * max(0.0, 1 - met)).alias("share"))
        whole = x.agg(F.sum("share")).first()[0] or 1.0
        margins[m] = cut(x.select("value", "have", (F.col("share") / whole).alias("share")), "margin")
    usable = now
    for m in MARGINS:
        usable = usable.join(margins[m].where("share > 0").select(F.col("value").alias(f"v_{m}")), F.col(m).eqNullSafe(F.col(f"v_{m}")), "left_semi")
    total = min(fraction * present, usable.agg(F.sum("tokens")).first()[0] or 0.0)
    level = {m: _level_of(margins[m], total) for m in MARGINS}
    for _ in range(rounds):
        off = 0.0
        for m in MARGINS:
            capped = F.array(*[F.sum(F.least(F.col("u") * float(c), F.col("tokens"))) for c in _FACTORS])
            sums = now.groupBy(F.col(m).alias("value")).agg(F.sum("f").alias("hf"), capped.alias("sums"))
            want = margins[m].select(F.col("value").alias("v"), (F.col("share") * present).alias("wf"), F.least(F.col("share") * level[m], F.col("have")).alias("want"))
            ff = F.when(F.col("hf") > 0, F.col("wf") / F.col("hf")).otherwise(0.0)
            step = sums.join(want, F.col("value").eqNullSafe(F.col("v"))).select("value", ff.alias("ff"), "want", "sums")
            step = cut(step.mapInPandas(_capped_steps, "value string, ff double, fu double"), "step")
            worst = step.where("ff > 0").agg(F.max(F.greatest(F.abs(F.col("ff") - 1), F.when(F.col("fu") < _FACTORS[-1], F.abs(F.col("fu") - 1)).otherwise(0.0)))).first()[0]
            off = max(off, worst or 0.0)
            u = F.col("u") * F.col("fu")
            moved = now.join(step, F.col(m).eqNullSafe(F.col("value"))).select(*MARGINS, "tokens", (F.col("f") * F.col("ff")).alias("f"), F.when(u > 0, F.least(F.greatest(u, F.col("tokens") / FAR), F.col("tokens") * FAR)).otherwise(0.0).alias("u"))
            new = cut(moved, "cells")
            discard(now, step)
            now = new
        if off <= tolerance:
            break
    discard(*margins.values())
    return now.select(*MARGINS, "tokens", (F.col("f") / F.col("tokens")).alias("weight"), F.least(F.col("u") / F.col("tokens"), F.lit(1.0)).alias("probability"))


def _fitted(docs: DataFrame, topic: Column | None, model: TopicModel | None, placed: DataFrame | None, targets: dict[str, dict] | None, fraction: float, most: int) -> tuple[DataFrame, pd.DataFrame | None]:
    """Cells with weight and probability, and, if the driver raked them, what their margins reach."""
    spark, summed = docs.sparkSession, cut(_cell_sums(docs, topic, model, placed), "cells")
    if summed.count() > most:
        return raked_table(summed, targets, fraction).drop("tokens"), None
    cells = summed.toPandas().sort_values(list(MARGINS), kind="stable", na_position="first").reset_index(drop=True)
    discard(summed)
    schema = "source string, lang string, topic string, weight double, probability double"
    if not len(cells):
        return spark.createDataFrame([], schema), None
    targets = targets or tempered(cells)
    cells = cells.assign(weight=rake(cells, targets), probability=probabilities(cells, targets, fraction))
    told = reached(cells, targets)
    short = told.query("shortfall > 1e-6").sort_values("shortfall", ascending=False)
    if len(short):
        _log.warning("mixing: %d targets can't be met with %.0f %% of the tokens, most: %s", len(short), 100 * fraction, "; ".join(f"{r.margin} {r.value} {r.share:.4f} of {r.target:.4f}" for r in short.head(5).itertuples()))
    rows = [(*(_value(v) for v in key), float(w), float(p)) for key, w, p in zip(cells[list(MARGINS)].itertuples(index=False), cells.weight, cells.probability, strict=True)]
    frame = spark.createDataFrame(rows, schema)
    return F.broadcast(frame) if len(rows) <= BROADCAST_CELLS else frame, told


def cell_weights(docs: DataFrame, topic: Column | None = None, targets: dict[str, dict] | None = None, fraction: float = 0.8, most: int = 200_000) -> DataFrame:
    """docs (doc_id, source, lang, text) -> (source, lang, topic, weight, probability), one row per cell.

    Up to `most` cells are raked on the driver; more are raked over tables, to the same weights within a relative
    1e-6 or so."""
    model, placed = _model(docs, topic)
    frame = _fitted(docs, topic, model, placed, targets, fraction, most)[0]
    if placed is not None:
        discard(placed)
    return frame


def shares(docs: DataFrame, topic: Column | None = None, targets: dict[str, dict] | None = None, fraction: float = 0.8, most: int = 200_000) -> DataFrame:
    """docs -> (margin, value, target, share, shortfall): what each source, language and topic should have and has of
    the expected sample. For more than `most` cells target and shortfall are null."""
    model, placed = _model(docs, topic)
    schema = "margin string, value string, target double, share double, shortfall double"
    frame, told = _fitted(docs, topic, model, placed, targets, fraction, most)
    if told is not None:
        return docs.sparkSession.createDataFrame([tuple(r) for r in told.itertuples(index=False)], schema)
    same = [F.col(f"s_{c}").eqNullSafe(F.col(c)) for c in MARGINS]
    x = _cell_sums(docs, topic, model, placed).withColumnsRenamed({c: f"s_{c}" for c in MARGINS}).join(frame, same).select(*MARGINS, (F.col("tokens") * F.col("probability")).alias("e"))
    one = [x.groupBy(F.col(m).alias("value")).agg(F.sum("e").alias("e")).select(F.lit(m).alias("margin"), "value", F.lit(None).cast("double").alias("target"), (F.col("e") / (x.agg(F.sum("e")).first()[0] or 1.0)).alias("share"), F.lit(None).cast("double").alias("shortfall")) for m in MARGINS]
    return one[0].union(one[1]).union(one[2])


def _cells_named(frame: DataFrame) -> DataFrame:
    return frame.withColumnsRenamed({c: f"cell_{c}" for c in MARGINS})


def _same(source: str, lang: str) -> Column:
    """Whether a row is of a cell of _cells_named()."""
    return F.col(source).eqNullSafe(F.col("cell_source")) & F.col(lang).eqNullSafe(F.col("cell_lang")) & F.col("topic").eqNullSafe(F.col("cell_topic"))


def weighted(docs: DataFrame, topic: Column | None = None, targets: dict[str, dict] | None = None, fraction: float = 0.8, most: int = 200_000) -> DataFrame:
    """docs (doc_id, text, lang, source, ...) -> one row per row: doc_id, topic, tokens, weight, probability, sampled.

    Null sources, languages and topics are values of their own; texts without words, null ones too, have topic "empty"
    and one token; texts of any length are read whole; repeated rows draw alike, and a null id draws by its text. Other
    columns are ignored; an empty table gives an empty result."""
    docs = docs.select("doc_id", "text", "lang", "source", *([topic.alias("given")] if topic is not None else []))
    topic = None if topic is None else F.col("given")
    model, placed = _model(docs, topic)
    frame = _cells_named(_fitted(docs, topic, model, placed, targets, fraction, most)[0])
    rows = _named(placed, model) if placed is not None else _marked(docs, topic, None).withColumnsRenamed({"c0": "doc_id", "c2": "lang", "c3": "source"})
    got = rows.join(frame, _same("source", "lang"), "left")
    return got.select("doc_id", "topic", "tokens", "weight", "probability", (F.col("draw") < F.col("probability")).alias("sampled"))


def mixed(docs: DataFrame, topic: Column | None = None, targets: dict[str, dict] | None = None, fraction: float = 0.8, most: int = 200_000) -> DataFrame:
    """The sampled rows of docs, all columns kept whatever their names; other cases are as in weighted()."""
    model, placed = _model(docs, topic)
    frame = _cells_named(_fitted(docs, topic, model, placed, targets, fraction, most)[0])
    if placed is not None:
        discard(placed)
    source, lang = (f"c{docs.columns.index(c)}" for c in ("source", "lang"))
    got = _marked(docs, topic, model).join(frame, _same(source, lang), "left")
    return got.where(F.col("draw") < F.col("probability")).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
