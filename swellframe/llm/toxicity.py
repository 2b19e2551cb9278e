"""Toxicity scores from a weighted lexicon matched by Aho-Corasick over folded text.

Folding lowers the text, takes accents and homoglyphs to plain letters and digit or sign substitutions to the letters
they stand for, and turns everything else into blanks. The lexicon is learned from labelled documents: words and word
beginnings that mark toxic texts, picked greedily until no entry occurs in `min_docs` toxic texts that have fewer than
`COVER` entries, each with its smoothed log odds as weight. Phrases around an entry that clean texts use, with a few fixed ones, are exceptions:
an entry inside one does not count. The weights found in a document, normalised by its length, go through a logistic
curve fitted on the same labelled rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swellframe.llm.common import cut, discard, let_go, same_columns

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("авекмнорстухіјѕԁԛԝαβεικνορτυχωζ", "abekmhopctyxijsdqwabeiknoptuxwz", strict=True))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
#: Harmless phrases that hold words often used as insults.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "idiot proof", "scum line", "pond scum", "moron test")


class _Fold(dict):
    """Code point -> folded text, worked out when first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in INVISIBLE:
            out = ""
        else:
            base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
            base = "".join(SUBSTITUTES.get(x, HOMOGLYPHS.get(x, x)) for x in base)
            out = base if base.isalnum() or not base and unicodedata.combining(c) else " "
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded text between two blanks."""
    return " " + (text or "").translate(_FOLD) + " "


def terms(words: set[str], least: int = 3, most: int = 12) -> set[str]:
    """Words with their ends marked, and their beginnings."""
    out = set()
    for w in words:
        if w:
            out.update(" " + w[:k] for k in range(least, min(most, len(w)) + 1))
            out.add(f" {w} ")
    return out


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "m"])


def automaton(entries) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, v in entries:
        found.add_word(k, v)
    found.make_automaton()
    return found


def _outside(places: list[int], ranges: list[tuple[int, int]]) -> list[int]:
    """The places in none of the ranges (end exclusive), both in order: one pass over both."""
    out, k, reach = [], 0, -1
    for at in places:
        while k < len(ranges) and ranges[k][0] <= at:
            reach = max(reach, ranges[k][1])
            k += 1
        if at >= reach:
            out.append(at)
    return out


#: Entries that a toxic text may ask for.
COVER = 6


@dataclass
class ToxicityModel:
    """Lexicon weights by entry, exception phrases, and the curve's three coefficients."""

    lexicon: dict[str, float]
    exceptions: list[str]
    curve: list[float] = field(default_factory=lambda: [-4.0, 1.0, 1.0])

    def matcher(self):
        """text -> (total weight, words, entries found); built once in a task."""
        entries = [(k, (k, w)) for k, w in self.lexicon.items()]
        phrases = [(f" {p} ", (p, None)) for p in self.exceptions]
        found = automaton(entries + [x for x in phrases if x[0] not in self.lexicon]) if entries or phrases else None

        def match(text):
            folded = fold(text)
            hits, spared = {}, []
            for end, (k, w) in found.iter(folded) if found else ():
                if w is None:
                    spared.append((end - len(k) - 1, end))
                else:
                    start = end - len(k) + 1
                    hits[start] = max(hits.get(start, (0.0, "")), (w, k))
            kept = [hits[at] for at in _outside(sorted(hits), sorted(spared))]
            return sum(w for w, _ in kept), len(folded.split()), sorted({k.strip() for _, k in kept})

        return match

    def scores(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(curve_inputs(weight, words) @ np.array(self.curve), -30, 30)))


def curve_inputs(weight, words) -> np.ndarray:
    weight, words = np.asarray(weight, float), np.asarray(words, float)
    return np.stack([np.ones_like(weight), np.log1p(weight), np.log1p(100 * weight / (words + 50))], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Logistic regression by Newton steps; no rows or one class give the prior alone."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        b += np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge * b), -5, 5)
    if (b[1:] < 0).any():  # more weight must never score lower
        use = np.r_[True, b[1:] > 0]
        b = np.where(use, b, 0.0)
        b[use] = fit_curve(x[:, use], y, ridge)
    return b.tolist()


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 16_384, min_docs: int = 4) -> ToxicityModel:
    """docs (doc_id, text) and labels (doc_id, toxic 0/1) -> a model.

    At most `max_rows` labelled documents are used, those with the smallest hashes of their ids; of rows that repeat an
    id one counts, that of the smallest digest, and so do equal texts. Of contradicting labels of one id or text
    "toxic" counts. Null labels, ids and texts are left out; texts are read whole. Without toxic labels, or rows, the
    lexicon is empty. Only entries that tell toxic from other texts reach the driver, and of those as many stay as
    COVER entries a toxic text ask for.
    """
    ids = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # bounded by max_rows
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.sha2("text", 256).alias("digest"), "text")).alias("r"))
    rows = cut(rows.groupBy("r.digest").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.first("r.text").alias("text")).drop("digest"), "toxic-train")

    def positive(batches):
        let_go()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                found = sorted(terms(set(fold(text.as_py()).split())))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([doc.as_py()] * len(found), pa.int64())], names=["term", "doc"])

    toxic = rows.where("toxic = 1").select("doc_id", "text").mapInArrow(positive, "term string, doc long")
    toxic = cut(toxic, "toxic-terms")
    frequent = cut(toxic.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs), "toxic-frequent")
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)

    def negative(batches):
        let_go()
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(terms(set(fold(text.as_py()).split())))
                if len(seen) > 100_000:
                    yield _counted(seen)
                    seen.clear()
        yield _counted(seen)

    clean = rows.where("toxic = 0").select("text").mapInArrow(negative, "term string, m long").groupBy("term").agg(F.sum("m").alias("m"))
    both = frequent.join(clean, "term", "left").select("term", "n", F.coalesce("m", F.lit(0)).alias("m"))
    odds = F.log((F.col("n") + 0.5) / (pos + 1)) - F.log((F.col("m") + 0.5) / (neg + 1))
    both = both.withColumn("w", odds).where((F.col("w") >= 2.5) & (F.col("m") <= 0.25 * F.col("n")))
    # of a beginning and its one common extension, the extension says more
    longer = both.groupBy(F.expr("substring(term, 1, length(term) - 1)").alias("term")).agg(F.max("n").alias("more"))
    telling = both.join(longer, "term", "left").where("more is null or more < 0.95 * n").select("term", "w")
    found = toxic.join(telling, "term").groupBy("term", "w").agg(F.collect_list("doc").alias("docs")).toPandas()  # telling entries of the sample
    weight = dict(zip(found.term, found.w, strict=True))
    where = {k: set(map(int, d)) for k, d in zip(found.term, found.docs, strict=True)}
    discard(toxic, frequent)
    if not where:
        return ToxicityModel({}, list(EXCEPTIONS), [math.log((pos + 0.5) / (neg + 0.5)) if pos + neg else -4.0, 0.0, 0.0])
    lexicon, covered = {}, Counter()
    while where:
        _, _, best = max((len(d), weight[k], k) for k, d in where.items())
        lexicon[best] = weight[best]
        covered.update(taken := where.pop(best))
        full = {d for d in taken if covered[d] >= COVER}
        where = {k: left for k, d in where.items() if len(left := d - full) >= min_docs and best.strip() not in k}

    model = ToxicityModel(lexicon, list(EXCEPTIONS))
    held = frozenset(lexicon)

    def around(batches):
        """Two-word phrases with an entry, by label."""
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = fold(text.as_py()).split()
                mark = [bool(terms({x}) & held) for x in w]
                out = sorted({f"{w[i]} {w[i + 1]}" for i in range(len(w) - 1) if mark[i] or mark[i + 1]})
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array([label] * len(out), pa.int32())], names=["phrase", "toxic"])

    phrases = rows.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(around, "phrase string, toxic int")
    spared = phrases.groupBy("phrase").agg(F.sum(1 - F.col("toxic")).alias("n"), F.sum("toxic").alias("t")).where((F.col("n") >= min_docs) & (F.col("t") * 20 <= F.col("n")))
    model.exceptions += [r.phrase for r in spared.orderBy(F.desc("n"), "phrase").collect()]  # phrases of the sample

    seen = rows.select(F.col("toxic").cast("long").alias("toxic"), "text").mapInArrow(_matched(model), "toxic long, weight double, words long, found array<string>")
    seen = seen.select("weight", "words", "toxic").toPandas()  # at most max_rows
    model.curve = fit_curve(curve_inputs(seen.weight, seen.words), seen.toxic.to_numpy(float))
    return model


def _matched(model: ToxicityModel):
    def run(batches):
        let_go()
        match = model.matcher()  # the first column is passed through
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                got = [match(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.list_(pa.string()))],
                    names=[part.schema.names[0], "weight", "words", "found"],
                )

    return run


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, score, words, found (the entries met), one row per row.

    Null and empty texts score as texts without any entry; texts of any length are read whole. Null ids stay, other
    columns are ignored, repeated rows score alike; an empty table gives an empty result."""
    a, b, c = model.curve
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_matched(model), "doc_id long, weight double, words long, found array<string>")
    z = F.lit(a) + F.lit(b) * F.log1p("weight") + F.lit(c) * F.log1p(100 * F.col("weight") / (F.col("words") + 50))
    return got.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("score"), "words", "found")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns kept, whose text scores below the threshold. Null and empty texts score as texts
    without any entry, repeated rows fare alike, clashing columns stay as they are; an empty table stays empty."""
    at = docs.columns.index("text")

    def run(batches):
        let_go()
        match = model.matcher()
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                got = [match(t) for t in part.column(at).to_pylist()]
                s = model.scores(np.array([g[0] for g in got]), np.array([g[1] for g in got]))
                yield part.filter(pa.array(s < threshold))

    return same_columns(docs, run)
