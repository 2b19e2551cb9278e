"""MinHash near-duplicate detection with b-bit signatures.

Every document's distinct word shingles give `MINIMA` minima of independent 32-bit permutations. Minima are grouped
five to a band; the first `BANDS` bands deal the documents into buckets, and the low four bits of all minima, packed
15 to a 64-bit word, are the signature from which similarity is estimated by bit counts, corrected for the 1/16 of
unequal minima whose low bits agree. Links are confirmed on the full shingle sets.

Equal sets are one text. A bucket never gives all its pairs. First every member meets two members of its bucket, those
of the smallest and the largest hash, which joins nearly all of a group of copies. Then a bucket whose members are
still in several components is compared across components only, inside the tasks: its largest component and all others
are dealt into blocks of about `BLOCK` members, and a task compares one block with one block of the others. A
component of a third of all documents thus meets each stray member of its buckets once, in many tasks. These tasks tell
which members may be linked to another one of their group; those members get their full sets and meet once more, and
what leaves the tasks is one confirmed link for any two components of a group.

Pairs are confirmed when their estimate is within `MARGIN` of the threshold. Sets of at most `SMALL` shingles go along
with the signature and are compared as they are if the estimate is within `SMALL_MARGIN`, since the permutations are far
from independent on few values (for sets of 4 and 5 shingles the standard error is 0.0297). With unions of 50 to 500 shingles the error is 0.0154 to 0.0157; of
75,000 simulated pairs at 0.8, 9 fell below 0.74 and one below 0.72, and none of 120,000 of any size shared no band
(independent minima: (1 - 0.8^5)^32 = 3e-6). Such a document is lost only if that happens with every partner.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swellframe.llm.common import GOLD, bounded_ids, cut, discard, let_go, mix
from swellframe.operators.graph import components

ROWS, BANDS, MINIMA, BITS = 5, 32, 720, 4
#: Nibbles in a signature word: three bands of five.
PER_WORD = 15
WORDS = MINIMA // PER_WORD
MARGIN, SMALL_MARGIN, SMALL = 0.08, 0.25, 64
#: Members of a block of a bucket that is compared across its components.
BLOCK = 96

_rng = np.random.default_rng(20_111)
_MASKS = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)[:, None]
_MULTS = (_rng.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; A-Z are lowered, words end at ASCII white
    space. Fewer than `size` words make one shingle; no word makes none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), np.uint64)
    for i in range(min(size, len(h))):
        out *= GOLD
        out ^= mix(h[i : i + n] + out)
    return np.unique(out)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation, computed in blocks that stay in cache."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 512):
        block = x[None, i : i + 512] ^ _MASKS
        block *= _MULTS
        np.minimum(out, block.min(axis=1), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    key = _BAND.copy()
    for col in low[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        key = mix(key * GOLD + col)
    return key.view(np.int64)


_SHIFTS = (np.arange(PER_WORD, dtype=np.uint64) * np.uint64(BITS))[None, :]


def packed(low: np.ndarray) -> np.ndarray:
    nibbles = (low & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(WORDS, PER_WORD)
    return (nibbles << _SHIFTS).sum(axis=1, dtype=np.uint64).view(np.int64)


def _digest(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def _signer(size: int):
    def run(batches):
        let_go()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = {"n": [], "digest": [], "bands": [], "sig": [], "few": []}
                for text in part.column(1).to_pylist():
                    h = shingles(text, size)
                    low = minima(h) if len(h) else None
                    rows["n"].append(len(h))
                    rows["digest"].append(_digest(h) if len(h) else None)
                    rows["bands"].append(band_keys(low) if len(h) else None)
                    rows["sig"].append(packed(low).tobytes() if len(h) else None)
                    rows["few"].append(h.tobytes() if 0 < len(h) <= SMALL else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(rows["n"], pa.int64()), pa.array(rows["digest"], pa.binary()), pa.array(rows["bands"], pa.list_(pa.int64())), pa.array(rows["sig"], pa.binary()), pa.array(rows["few"], pa.binary())],
                    names=["doc_id", "n", "digest", "bands", "sig", "few"],
                )

    return run


def _shingler(size: int):
    def run(batches):
        let_go()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t, size) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_digest(h) for h in sets], pa.binary()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["node", "digest", "grams"])

    return run


def signatures(column: pa.Array) -> np.ndarray:
    """A column of packed signatures as a table of WORDS words a row."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of signatures (rows of words), corrected for chance agreement of the low bits."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    unequal = np.bitwise_count(x & np.uint64(0x0111111111111111)).sum(axis=-1, dtype=np.int64)
    chance = 1 / 2**BITS
    return ((1 - unequal / MINIMA) - chance) / (1 - chance)


def likely(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m shingles with signatures a and b may be linked."""
    least = np.where(np.maximum(n, m) <= SMALL, percent / 100 - SMALL_MARGIN, percent / 100 - MARGIN)
    return (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (estimate(a, b) >= least)


def _small_alike(x: frozenset, y: frozenset, percent: int) -> bool:
    both = len(x & y)
    return both * 100 >= (len(x) + len(y) - both) * percent


def _few(data: bytes | None) -> frozenset | None:
    return None if data is None else frozenset(np.frombuffer(data, np.uint64).tolist())


PAIRS = "a long, am binary, b long, bm binary"


def _likely_pairs(percent: int):
    """Rows (a, am, an, asig, afew, b, bm, bn, bsig, bfew) -> PAIRS of those that may be linked."""

    def run(batches):
        let_go()
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keep = likely(part.column(2).to_numpy(), part.column(7).to_numpy(), signatures(part.column(3)), signatures(part.column(8)), percent)
                for k in np.flatnonzero(keep):
                    x, y = _few(part.column(4)[k].as_py()), _few(part.column(9)[k].as_py())
                    keep[k] = x is None or y is None or _small_alike(x, y, percent)
                yield part.select([0, 1, 5, 6]).filter(pa.array(keep))

    return run


#: A member of a group: of group (key, turn, i, j), members of role 1 or 3 meet those of role 2 or 3.
MEMBER = "key long, turn int, i int, j int, role int, node long, comp long, digest binary, n long, sig binary, few binary, bands array<long>"


class _Group:
    """One group of MEMBER rows, and which of its pairs may be linked across components. A pair that shares an earlier
    band is made in that one's bucket."""

    def __init__(self, rows: pa.Table, percent: int):
        self.role, self.comp, self.n = (rows.column(k).to_numpy() for k in (4, 6, 8))
        self.sig = signatures(rows.column(9))
        self.few = [_few(x) for x in rows.column(10).to_pylist()]
        self.bands = rows.column(11).combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        self.band = int(np.flatnonzero(self.bands[0] == rows.column(0)[0].as_py())[0])
        self.right, self.percent = np.flatnonzero(self.role >= 2), percent

    def partners(self, x: int, own: np.ndarray) -> np.ndarray:
        """Members that x may be linked to and whose component, in own, is another."""
        n, bands = self.n, self.bands
        y = self.right[own[self.right] != own[x]]
        if self.role[x] == 3:
            y = y[(self.role[y] == 2) | (y > x)]
        y = y[np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * self.percent]
        y = y[~(bands[y, : self.band] == bands[x, : self.band]).any(axis=1)]
        if not len(y):
            return y
        y = y[likely(n[x], n[y], self.sig[x], self.sig[y], self.percent)]
        if self.few[x] is None:
            return y
        return y[np.array([self.few[k] is None or _small_alike(self.few[x], self.few[k], self.percent) for k in y], bool)]

    def left(self):
        return np.flatnonzero(self.role != 2)


def _by_group(kernel):
    """kernel(rows of one group) -> a batch, for batches sorted by their first four columns."""

    def run(batches):
        let_go()
        held = None
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            names = np.stack([held.column(k).to_numpy() for k in range(4)], axis=1)
            starts = np.concatenate([[0], np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1])
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                yield from kernel(held.slice(s, e - s))
            held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from kernel(held)

    return run


def _hopeful(percent: int):
    """The members that have a partner in their group."""

    def kernel(rows):
        group, keep = _Group(rows, percent), np.zeros(rows.num_rows, bool)
        for x in group.left():
            y = group.partners(x, group.comp)
            keep[y] = True
            keep[x] |= len(y) > 0
        yield from rows.filter(pa.array(keep)).to_batches()

    return _by_group(kernel)


def _joined(percent: int):
    """MEMBER rows with their full sets -> (a, b): components that a confirmed link joins, one link for any two of a
    group."""

    def kernel(rows):
        group, own, out = _Group(rows, percent), None, []
        own = group.comp.copy()
        ends = np.cumsum(rows.column(12).combine_chunks().value_lengths().to_numpy())
        sets = np.split(rows.column(12).combine_chunks().flatten().to_numpy(), ends[:-1])
        for x in group.left():
            for y in group.partners(x, own):
                if own[y] != own[x]:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if both * 100 >= (len(sets[x]) + len(sets[y]) - both) * percent:
                        out.append((group.comp[x], group.comp[y]))
                        own[own == own[y]] = own[x]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return _by_group(kernel)


def _alike(inter: Column, a: Column, b: Column, percent: int) -> Column:
    return inter * 100 >= (a + b - inter) * percent


def full_sets(keys: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The shingle sets (node, digest, grams) of the documents in keys (doc_id); only these are read and cut into
    shingles again. A text is known by its id and digest."""
    wanted = cut(keys.distinct(), "wanted")
    read = texts.join(bounded_ids(wanted), "doc_id", "left_semi").select("doc_id", "text")
    sets = cut(read.mapInArrow(_shingler(size), "node long, digest binary, grams array<long>").dropDuplicates(["node", "digest"]), "sets")
    discard(wanted)
    return sets


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The rows of PAIRS whose full shingle sets have 100 * intersection >= percent * union."""
    sets = full_sets(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), texts, size)
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("digest").alias("am"), F.col("grams").alias("x")), ["a", "am"])
    both = first.join(sets.select(F.col("node").alias("b"), F.col("digest").alias("bm"), F.col("grams").alias("y")), ["b", "bm"])
    inter = F.size(F.array_intersect("x", "y"))
    out = cut(both.where(_alike(inter, F.size("x"), F.size("y"), percent)).select("a", "b"), "confirmed")
    discard(sets)
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents with 100 * |intersection| >= percent * |union| of their word-shingle sets are linked; component_id is
    the smallest doc_id that links reach, and kept marks that document. Null or wordless texts have no shingles and
    are linked with nothing. Repeated rows share a component; rows that share an id but not its text are compared
    each by its own text. Rows with a null doc_id are returned with a null component and kept, and link nothing. Texts
    of any length are read whole. Other columns are ignored. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(texts.mapInArrow(_signer(size), "doc_id long, n long, digest binary, bands array<long>, sig binary, few binary"), "signed")
    usable = signed.where("doc_id is not null and digest is not null")
    # equal sets need no comparison: the smallest id stands for them
    copies = cut(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1").select("digest", "rep"), "copies")
    own = usable.join(copies, "digest", "left").where("rep is null or doc_id = rep")
    nodes = cut(own.select(F.col("doc_id").alias("node"), "digest", "n", "bands", "sig", "few").dropDuplicates(["node", "digest"]), "nodes")

    dealt = nodes.select("node", F.explode("bands").alias("key"))
    order = F.struct(F.xxhash64("node").alias("p"), "node")
    buckets = cut(dealt.groupBy("key").agg(F.min(order).alias("lo"), F.max(order).alias("hi")).where("lo < hi").select("key", F.col("lo.node").alias("lo"), F.col("hi.node").alias("hi")), "buckets")
    full = cut(dealt.join(buckets, "key"), "full")
    met = full.select(F.col("node").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).where("a <> b")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("digest").alias(f"{k}m"), F.col("n").alias(f"{k}n"), F.col("sig").alias(f"{k}sig"), F.col("few").alias(f"{k}few"))
    met = met.join(side("a"), "a").join(side("b"), "b").select(*[f"{k}{c}" for k in "ab" for c in ("", "m", "n", "sig", "few")])
    stars = cut(met.mapInArrow(_likely_pairs(percent), PAIRS), "stars")
    links = confirmed(stars, texts, size, percent)
    comp = components(links)

    placed = cut(full.select("key", "node").join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp")), "placed")
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key")
    sizes = sizes.agg(F.sum("m").alias("m"), F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("k")).where("k > 1")
    open_ = cut(sizes.select("key", F.col("top.comp").alias("top"), F.ceil(F.col("top.m") / BLOCK).alias("nm"), F.ceil((F.col("m") - F.col("top.m")) / BLOCK).alias("nr"), (F.col("m") <= BLOCK).alias("one")), "open")
    inner = placed.join(open_, "key").join(nodes.select("node", "digest", "n", "sig", "few", "bands"), "node")
    names = ["key", "turn", "i", "j"]
    dealt_out = lambda df: df.repartition(*names).sortWithinPartitions(*names)
    rest = inner.select("key", F.explode(_groups()).alias("g"), "node", "comp", "digest", "n", "sig", "few", "bands").select("key", "g.*", "node", "comp", "digest", "n", "sig", "few", "bands")
    hopeful = cut(dealt_out(rest).mapInArrow(_hopeful(percent), MEMBER), "hopeful")
    sets = full_sets(hopeful.select(F.col("node").alias("doc_id")), texts, size)
    joined = components(dealt_out(hopeful.join(sets, ["node", "digest"]).select(*hopeful.columns, "grams")).mapInArrow(_joined(percent), "a long, b long"))
    discard(buckets, full, stars, links, placed, open_, hopeful, sets, nodes)

    out = signed.select("doc_id", "n", "digest").join(copies, "digest", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("node"))
    out = out.join(comp, "node", "left").select("doc_id", "n", F.coalesce("comp", "node").alias("node"))
    out = out.join(joined, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "node").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _groups() -> Column:
    """The groups (turn, i, j, role) in which a member of an open bucket is compared: block i of the largest
    component with block j of the others in turn 0, blocks i <= j of the others in turn 1; role is 1 for i's members,
    2 for j's, 3 for both. Buckets of one block are one group."""
    group = lambda turn, i, j, role: F.struct(F.lit(turn).alias("turn"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(role).cast("int").alias("role") if isinstance(role, int) else role.alias("role"))
    main = F.col("comp") == F.col("top")
    mine = F.pmod(F.xxhash64("node", F.lit(3)), F.when(main, F.col("nm")).otherwise(F.col("nr")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    zero = F.lit(0)
    of_main = F.transform(upto("nr"), lambda j: group(0, mine, j, 1))
    others = F.transform(upto("nr"), lambda k: group(1, F.least(mine, k), F.greatest(mine, k), F.when(mine < k, 1).when(mine > k, 2).otherwise(3)))
    of_rest = F.concat(F.transform(upto("nm"), lambda i: group(0, i, mine, 2)), others)
    return F.when(F.col("one"), F.array(group(0, zero, zero, 3))).when(main, of_main).otherwise(of_rest)


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns kept, without those whose component has a smaller id; of repeated rows that are
    kept all stay, and so do rows with a null id or no words. An id goes with all its rows if one of its texts is a
    near copy of a smaller id's. An empty table gives an empty result; clashing columns stay as they are."""
    name = "gone"
    while name in docs.columns:
        name += "_"
    gone = cut(near_duplicates(docs, size, percent).where("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(bounded_ids(gone), docs["doc_id"] == F.col(name), "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS s, a AS t FROM e UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.t),
c AS (SELECT s AS doc_id, min(t) AS c FROM r GROUP BY s)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
