"""Quality scores from random-indexing word vectors and a two-layer numpy network with calibrated probabilities.

Words are runs of letters, of digits or of other signs, with their case, hashed into `BUCKETS`. Every bucket has a
fixed sparse index vector of +1 and -1; a bucket's word vector is the sum of the index vectors of the words next to it
over all documents, counted in whole numbers by every task and summed by Spark. A document's inputs are pooled from its
words' unit vectors alone, once with equal weights and once with weights that fall with a word's frequency: their mean,
their spread, the mean's length, and the mean and mean square of the products of neighbouring words' vectors, which
tell running text from repeats and shuffled words. A network of one hidden layer is trained on a bounded sample of
labelled rows; a temperature fitted on rows kept from training calibrates its probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swellframe.llm.common import mix

BITS, DIMS, NONZERO, REACH = 15, 32, 2, 2
BUCKETS = 1 << BITS
HIDDEN = 24

_rng = np.random.default_rng(7_919)
_PLACES = _rng.integers(0, DIMS, (BUCKETS, NONZERO))
_SIGNS = _rng.integers(0, 2, (BUCKETS, NONZERO)) * 2 - 1

#: Kinds of bytes: 0 blank, 1 letter (and non-ASCII), 2 digit, 3 other sign.
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
#: Characters worked on at once: while contexts are counted, and while vectors, which should stay in cache, are pooled.
BLOCK, POOL_BLOCK = 1 << 22, 1 << 17


@dataclass
class Words:
    """The words of some texts: bucket and document of each."""

    bucket: np.ndarray
    doc: np.ndarray


def words(texts: list[str | None]) -> Words:
    """Cuts whole texts into words, all at once; a word's hash is a sum over its bytes and their places."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum(sizes + 1)
    kind = _KIND[b]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start = np.concatenate([[0], change])
    stop = np.concatenate([change, [len(b)]])
    real = kind[start] > 0
    start, stop = start[real], stop[real]
    # hash: sum of mixed (byte, place in word, up to 16 and then alike)
    at = np.arange(len(b), dtype=np.int64)
    of = np.zeros(len(b), np.int64)
    of[start] = start
    np.maximum.accumulate(of, out=of)
    place = np.minimum(at - of, 15)
    code = _CODES[place, b]
    code[kind == 0] = 0
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code, dtype=np.uint64)])
    h = mix(total[stop] - total[start])
    return Words((h >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(ends, start, "right"))


_CODES = mix(np.arange(1, 16 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(16, 256)


def slices(texts: list[str | None], block: int):
    """(number of the first text, texts or one slice of a text, whether the text before goes on): at most `block`
    characters at once. Longer texts are cut at white space where there is some."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > block:
            yield first, held, False
            held, size = [], 0
        if len(t) > block:
            at = 0
            while at < len(t):
                end = at + block
                if end < len(t):
                    gap = max(t.rfind(" ", at, end), t.rfind("\n", at, end))
                    end = gap + 1 if gap > at else end
                yield i, [t[at:end]], at > 0
                at = end
            first = i + 1
            continue
        if not held:
            first = i
        held.append(t)
        size += len(t)
    if held:
        yield first, held, False


def word_runs(texts: list[str | None], block: int):
    """(buckets, documents, how many words at the start were in the run before) of slices(): a slice of a long text
    begins with the last REACH words of the slice before."""
    tail = np.empty(0, np.int64)
    for first, part, goes_on in slices(texts, block):
        w = words(part)
        carried = tail if goes_on else tail[:0]
        bucket, doc = np.concatenate([carried, w.bucket]), np.concatenate([np.full(len(carried), first), w.doc + first])
        tail = bucket[-REACH:]
        yield bucket, doc, len(carried)


def _count_contexts(batches):
    table = np.zeros(BUCKETS * DIMS, np.int64)
    seen = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for bucket, doc, old in word_runs(batch.column(0).to_pylist(), BLOCK):
            seen += np.bincount(bucket[old:], minlength=BUCKETS)
            for off in range(1, REACH + 1):
                near = doc[off:] == doc[:-off]
                near[: max(0, old - off)] = False  # pairs of the run before
                a, b = bucket[:-off][near], bucket[off:][near]
                for word, context in ((a, b), (b, a)):
                    for k in range(NONZERO):
                        table += np.bincount(word * DIMS + _PLACES[context, k], _SIGNS[context, k], BUCKETS * DIMS).astype(np.int64)
    table = table.reshape(BUCKETS, DIMS)
    rows = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(seen[rows]), *[pa.array(table[rows, d]) for d in range(DIMS)]], names=["bucket", "n", *[f"d{d}" for d in range(DIMS)]])


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit word vectors and weights by frequency from all documents, tables of BUCKETS rows whatever the input's
    size."""
    dims = [f"d{d}" for d in range(DIMS)]
    parts = docs.select("text").mapInArrow(_count_contexts, "bucket long, n long, " + ", ".join(f"{d} long" for d in dims))
    got = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(d).alias(d) for d in dims]).toPandas()  # at most BUCKETS rows
    table, weight = np.zeros((BUCKETS, DIMS), np.float32), np.ones(BUCKETS, np.float32)
    if len(got):
        v, at = got[dims].to_numpy(float), got.bucket.to_numpy()
        table[at] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        weight[at] = RARE / (RARE + got.n.to_numpy(float) / max(got.n.sum(), 1))
    return table, weight


#: Share of all words at which a word's weight is one half.
RARE = 1e-3
INPUTS = 2 * (2 * DIMS + 3)


def _sums(out: np.ndarray, doc: np.ndarray, values: np.ndarray) -> None:
    """Adds the rows of values, in the order of doc, to out[doc]."""
    if len(doc):
        start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        out[doc[start]] += np.add.reduceat(values, start, axis=0)


def pooled(texts: list[str | None], vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of INPUTS per text; a text without words is all zeros. Sums are carried from slice to slice."""
    n = len(texts)
    total, pairs = np.zeros((n, 2)), np.zeros((n, 2))
    first, second = np.zeros((n, 2 * DIMS)), np.zeros((n, 2 * DIMS))
    near, near2 = np.zeros((n, 2)), np.zeros((n, 2))
    for bucket, doc, old in word_runs(texts, POOL_BLOCK):
        v, w = vectors[bucket], np.stack([np.ones(len(bucket), np.float32), weights[bucket]], axis=1)
        own, rare, at = v[old:], w[old:, 1, None], doc[old:]
        squares = own * own
        _sums(first[:, :DIMS], at, own)
        _sums(first[:, DIMS:], at, own * rare)
        _sums(second[:, :DIMS], at, squares)
        _sums(second[:, DIMS:], at, squares * rare)
        _sums(total, at, w[old:])
        same = doc[1:] == doc[:-1]
        same[: max(0, old - 1)] = False
        at = np.flatnonzero(same) + 1
        dot = np.einsum("ij,ij->i", v[at], v[at - 1])[:, None]
        weight = w[at] * w[at - 1]
        _sums(pairs, doc[at], weight)
        _sums(near, doc[at], weight * dot)
        _sums(near2, doc[at], weight * dot * dot)
    out = []
    for k in range(2):
        many, two = np.maximum(total[:, k, None], 1e-9), np.maximum(pairs[:, k, None], 1e-9)
        mean = first[:, k * DIMS : (k + 1) * DIMS] / many
        spread = np.sqrt(np.maximum(second[:, k * DIMS : (k + 1) * DIMS] / many - mean * mean, 0))
        out += [mean, spread, (mean * mean).sum(axis=1, keepdims=True), near[:, k, None] / two, near2[:, k, None] / two]
    return np.concatenate(out, axis=1).astype(np.float32)


@dataclass
class QualityModel:
    vectors: np.ndarray
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(np.clip((x - self.centre) / self.scale, -6, 6) @ w1 + b1, 0) @ w2 + b2

    def scores(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled(texts, self.vectors, self.weights)) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, steps: int = 1_500, seed: int = 5) -> list[np.ndarray]:
    """Two layers by Adam on the logistic loss with weight decay."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        pick = rng.integers(0, len(x), min(512, len(x)))
        a, z = x[pick], y[pick]
        h = np.maximum(a @ p[0] + p[1], 0)
        err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - z) / len(pick)
        back = np.outer(err, p[2]) * (h > 0)
        for i, g in enumerate((a.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ err + 1e-4 * p[2], err.sum())):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.01 * (1 - t / steps) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return p


def fit_temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least logistic loss."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(-1.5, 2.5, 81))
    loss = [np.logaddexp(0, -(2 * y - 1) * logit / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 16_384) -> QualityModel:
    """docs (doc_id, text) and labels (doc_id, quality 0/1) -> a model.

    Word vectors come from all documents; the network from at most `max_rows` labelled ones, those with the smallest
    hashes of their ids, a fifth of them for the temperature. Of contradicting labels of one id the lower counts. Null
    labels, ids and texts are left out; without labels, or rows, every text scores one half."""
    vectors, weights = word_vectors(docs)
    ids = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, weights))

    def run(batches):
        for part in batches:
            x = pooled(part.column(2).to_pylist(), *shared.value)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "y", "x"])

    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text")  # bounded by max_rows
    got = rows.mapInArrow(run, "doc_id long, y int, x array<float>").toPandas().sort_values("doc_id", kind="stable")
    x, y = np.array(got.x.tolist(), float).reshape(-1, INPUTS), got.y.to_numpy(float)
    if not len(y):
        return QualityModel(vectors, weights, np.zeros(INPUTS), np.ones(INPUTS), [np.zeros((INPUTS, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(())], 1.0)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    model = QualityModel(vectors, weights, centre, scale, [], 1.0)
    kept = pd.util.hash_array(got.doc_id.to_numpy(np.int64)) % 5 == 0
    kept &= len(y) >= 50
    model.layers = fit_network(np.clip((x[~kept] - centre) / scale, -6, 6), y[~kept])
    model.temperature = fit_temperature(model.logits(x[kept]), y[kept])
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, score, one row per row; null texts score as empty ones, repeated rows alike.

    Texts of any length are read whole, in slices; null ids stay; other columns are ignored; an empty table gives an
    empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of BUCKETS x DIMS floats and the network

    def run(batches):
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
