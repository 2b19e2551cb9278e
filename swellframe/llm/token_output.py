"""Token ids, written as Re-Pair grammars: one shard a row, in ascending doc_id order.

A shard holds some documents' ids. Re-Pair replaces frequent id pairs by nonterminals, never across a document's end,
until no pair of symbols stands in `MIN_COUNT` places any more. Each round replaces many pairs at once, the most
frequent ones first. The rules, the length that each nonterminal expands to and each document's place in the compressed
sequence are stored with it, so a document, or a part of one, is decoded without the rest of its shard.

Layout of a payload (little-endian): b"RPG2"; u32 width, base, rules, symbols, documents; left[rules], right[rules],
u32 length[rules]; symbol[symbols]; u32 symbols of each document; u32 ids of each document. Symbols take `width` bytes,
2 or 4; those below base are ids, others are nonterminals.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swellframe.llm.common import GOLD, kept_in_worker, lean, scratch

END = 2
_END = np.array([END], np.uint32)
#: Places that a pair must have to be replaced, and the most pairs that one round replaces.
MIN_COUNT, PER_ROUND = 24, 8_192
#: Ids in a shard, but for its last document.
SHARD_IDS = 1 << 20
#: Bytes of texts that are encoded together.
TOGETHER = 1 << 20
#: Pieces in a generation of the encoder's cache, and the longest one that is kept.
CACHED, _LONGEST = 600_000, 48
_APART = re.compile(r"(?<=\S) (?=\S)")
_SIGNS, _PLAIN = string.punctuation, frozenset(string.ascii_letters + string.digits)


class Pieces:
    """Pieces of texts, numbered, and their ids one after another."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.ids, self.ends = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)  # ends: 0 first

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """Numbers of pieces, -1 for those that aren't here."""
        return np.fromiter(map(self.at.get, pieces, repeat(-1)), np.int64, len(pieces))

    def spans(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of pieces begin, and how many there are."""
        return self.ends[number], self.ends[number + 1] - self.ends[number]

    def add(self, pieces: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """Distinct pieces that aren't here yet."""
        n = len(self.at)
        self.at.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        ends = self.ends[n] + np.cumsum(size)
        self.ends = _room(self.ends, n + 1 + len(pieces))
        self.ends[n + 1 : n + 1 + len(pieces)] = ends
        self.ids = _room(self.ids, int(self.ends[n]) + len(ids))
        self.ids[self.ends[n] : self.ends[n] + len(ids)] = ids


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])


def _taken(ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of ids one after another."""
    return ids[np.arange(int(size.sum())) + np.repeat(begin - np.cumsum(size) + size, size)]


class Encoder:
    """Whole texts to ids. Texts are encoded in pieces cut before single blanks, and before single line ends with no
    blank beside them, where the vocabulary's byte-level pre-tokenizer always cuts too. Arrow numbers the pieces of the
    texts that come together, and each distinct one is looked up once; pieces met before come from a cache of two
    generations, so that frequent pieces stay and its memory is bounded. The pre-tokenizer also cuts between a letter or
    digit and signs that end a piece, so such a piece is put together from the ids of both."""

    def __init__(self, path: str, kept: int = CACHED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # pieces are cached here instead
        self.kept = kept
        self.cache, self.older = Pieces(), Pieces()
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for x, i in vocabulary.items() if x[0] == "Ġ"]] = True  # ids whose text begins with a blank
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.breaks = np.zeros(len(self.opens), bool)
        self.breaks[vocabulary["Ċ"]] = True  # the line end

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids if text else [], np.uint32)

    def _piece(self, piece: str) -> np.ndarray:
        return self._whole(piece if piece[:1] == "\n" else " " + piece)

    def _pieces(self, texts: list[str | None]) -> tuple[list[str], list[int], np.ndarray, pa.Array]:
        """Each text's start; the numbers of texts that go on behind it, how many pieces each has, and these pieces:
        words without their blank, and words with the line end before. A text with one of the vocabulary's special
        tokens, which end whatever stands before them, is all start."""
        starts, even, odd = [t or "" for t in texts], {}, {}
        for i, text in enumerate(starts):
            if not text or any(x in text for x in self.special):
                continue
            if not any(x in text for x in ("  ", "\n ", " \n", "\n\n\n")) and not text[0].isspace() and not text[-1].isspace() and text.replace("\n", "").isprintable():
                starts[i], _, rest = text.replace("\n", " \n").partition(" ")
                if rest:
                    even[i] = rest
            else:
                starts[i], *rest = _APART.split(text)
                if rest:
                    odd[i] = rest
        cut = pc.split_pattern(pa.array(list(even.values()), pa.large_string()), " ")
        counts = np.array([*cut.value_lengths().to_numpy(), *map(len, odd.values())], np.int64)
        return starts, [*even, *odd], counts, pa.concat_arrays([cut.flatten(), pa.array(list(chain(*odd.values())), pa.large_string())])

    def _alone(self, new: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Encodes pieces -> pieces, ids, numbers of ids: those of one word many at once, told apart by the ids that open
        with a blank or are a line end."""
        parts, apart = [], []
        lines = [x for x in new if x[:1] == "\n"]
        for edge, mark, own in ((self.opens, " ", [x for x in new if x[:1] != "\n"] if lines else new), (self.breaks, "\n", lines)):
            for at in range(0, len(own), 256):
                part = own[at : at + 256]
                if not _words(text := _joined(part, mark), mark, len(part)):
                    apart += [x for x in part if not _words(_joined([x], mark), mark, 1)]
                    part = [x for x in part if _words(_joined([x], mark), mark, 1)]
                    text = _joined(part, mark)
                if part:
                    parts.append((edge, part, text))
        pieces, ids, size = [], [], []
        for (edge, part, _), found in zip(parts, self.tokenizer.encode_batch_fast([text for _, _, text in parts], add_special_tokens=False), strict=True):
            got = np.array(found.ids, np.uint32)
            edges = np.flatnonzero(edge[got])
            if len(edges) == len(part) and edges[0] == 0:
                pieces += part
                ids.append(got)
                size.append(np.diff(edges, append=len(got)))
            else:
                apart += part
        ids += (whole := list(map(self._piece, apart)))
        return pieces + apart, np.concatenate([np.empty(0, np.uint32), *ids]), np.concatenate([*size, np.array(list(map(len, whole)), np.int64)])

    def _carried(self, pieces: list[str]) -> list[str]:
        """Takes pieces over from the older generation -> those that it doesn't have."""
        old = self.older.numbers(pieces)
        if not (old >= 0).any():
            return pieces
        begin, size = self.older.spans(old[old >= 0])
        self.cache.add(list(compress(pieces, old >= 0)), _taken(self.older.ids, begin, size), size)
        return list(compress(pieces, old < 0))

    def _learn(self, new: list[str]) -> None:
        """Takes short pieces that the cache doesn't have into it, and what stands before their signs."""
        new = self._carried(new)
        before = {x: head for x in new if x[-1:] in _SIGNS and (head := x.rstrip(_SIGNS))[-1:] in _PLAIN}
        heads = self._carried([x for x in set(before.values()) if x not in self.cache.at])
        self.cache.add(*self._alone(list({*heads, *(x for x in new if x not in before)})))
        signs = Pieces()
        for x in {x[len(head) :] for x, head in before.items()}:
            signs.add([x], ids := self._whole(x), np.array([len(ids)]))
        first = self.cache.spans(self.cache.numbers(list(before.values())))
        last = signs.spans(signs.numbers([x[len(head) :] for x, head in before.items()]))
        both = np.concatenate([self.cache.ids, signs.ids])
        begin, size = np.stack([first[0], last[0] + len(self.cache.ids)], axis=1), np.stack([first[1], last[1]], axis=1)
        self.cache.add(list(before), _taken(both, begin.ravel(), size.ravel()), size.sum(axis=1))

    def _found(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids; where those of each of some distinct pieces begin in them, and how many there are. Long pieces don't
        come into the cache."""
        number = self.cache.numbers(pieces)
        at = np.flatnonzero(number < 0).tolist()
        far = [i for i in at if len(pieces[i]) > _LONGEST]
        own = list(map(self._piece, map(pieces.__getitem__, far)))
        self._learn([pieces[i] for i in at if len(pieces[i]) <= _LONGEST] if far else list(map(pieces.__getitem__, at)))
        number[at] = self.cache.numbers(list(map(pieces.__getitem__, at)))
        begin, size = self.cache.spans(np.maximum(number, 0))
        if not far:
            return self.cache.ids, begin, size
        size[far] = list(map(len, own))
        begin[far] = len(self.cache.ids) + np.cumsum(size[far]) - size[far]
        return np.concatenate([self.cache.ids, *own]), begin, size

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        starts, owners, counts, pieces = self._pieces(texts)
        behind = [np.empty(0, np.uint32)] * len(texts)
        if owners:
            coded = pieces.dictionary_encode()
            number = coded.indices.to_numpy()
            ids, begin, size = self._found(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            upto = np.cumsum(counts)
            for k in range(0, len(owners), 256):  # ids of some texts at a time
                last = upto[k : k + 256]
                own = number[upto[k] - counts[k] : last[-1]]
                ends = np.cumsum(size[own])[last - (upto[k] - counts[k]) - 1]
                for i, got in zip(owners[k : k + 256], np.split(_taken(ids, begin[own], size[own]), ends[:-1]), strict=True):
                    behind[i] = got
            if len(self.cache.at) > self.kept:
                self.older, self.cache = self.cache, Pieces()
        return [np.concatenate([self._whole(start), own, _END]) for start, own in zip(starts, behind, strict=True)]


def _joined(words: list[str], mark: str) -> str:
    return "".join(words) if mark == "\n" else " " + " ".join(words)


def _words(text: str, mark: str, n: int) -> bool:
    """Whether a joined text holds n single words, each behind its mark."""
    return len(text) < 1000 * n and text.count(mark) == n and mark * 2 not in text and text[-1:] != mark and text.replace(mark, "").isprintable() and (mark == " " or " " not in text)


@lru_cache(1)
def _encoder(path: str, kept: int) -> Encoder:
    """The worker's encoder: it and its pieces serve all tasks that the worker runs."""
    return Encoder(path, kept)


kept_in_worker(_encoder.cache_clear)


def _frequent(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that stand in MIN_COUNT places at least -> places, number of the pair at each, pairs in order, counts. Of
    many pairs, a table of hashes counts those that have a slot for themselves; only pairs that share one are sorted."""
    at, slots, own = np.arange(len(pair)), np.empty(0, np.int64), np.ones(len(pair), bool)
    values, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(pair) > 1 << 16:
        slot = ((pair * GOLD) >> np.uint64(44)).astype(np.int32)
        count = np.bincount(slot, minlength=1 << 20)
        at = np.flatnonzero((count >= MIN_COUNT)[slot])
        slot, pair = slot[at], pair[at]
        held, shared = np.zeros(1 << 20, np.uint64), np.zeros(1 << 20, bool)
        held[slot] = pair
        shared[slot[held[slot] != pair]] = True
        own = shared[slot]
        slots = np.flatnonzero((count >= MIN_COUNT) & ~shared)
        values, counts = held[slots], count[slots]
    more, inverse, n = np.unique(pair[own], return_inverse=True, return_counts=True)
    often = n >= MIN_COUNT
    values, counts = np.concatenate([values, more[often]]), np.concatenate([counts, n[often]])
    order = np.argsort(values)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    if len(slots):
        table = np.full(1 << 20, -1, np.int32)
        table[slots] = rank[: len(slots)]
        which = table[slot]
    else:
        which = np.full(len(pair), -1, np.int32)
    last = np.full(len(more), -1, np.int32)
    last[often] = rank[len(slots) :]
    which[own] = last[inverse]
    kept = which >= 0
    return at[kept], which[kept], values[order], counts[order]


def re_pair(seq: np.ndarray, last: np.ndarray, base: int):
    """seq: symbols; last: whether a symbol ends its document. -> (symbols, last, rules, lengths).

    Each round gives the most frequent pairs nonterminals and replaces them from left to right, until no pair inside a
    document stands in MIN_COUNT places; of overlapping places in a run every second one is taken. Only pairs with a
    nonterminal of the round before, and those that were frequent in it, can be frequent; others aren't counted again."""
    seq, parts, lengths, fresh, often = seq.astype(np.uint32), [], np.ones(base, np.int64), 0, np.zeros(len(seq), bool)
    while len(seq) > 1:
        new = seq >= fresh
        place = np.flatnonzero((new[:-1] | new[1:] | often[:-1]) & ~last[:-1])
        at, which, values, counts = _frequent((seq[place].astype(np.uint64) << np.uint64(32)) | seq[place + 1])
        if not len(at):
            break
        top = np.argsort(-counts, kind="stable")[:PER_ROUND]
        symbol = np.full(len(values), -1, np.int64)
        symbol[top] = np.arange(len(top))
        at, chosen = place[at], symbol[which]
        often = np.zeros(len(seq), bool)
        often[at] = True
        at, chosen = at[chosen >= 0], chosen[chosen >= 0]
        new_run = np.ones(len(at), bool)
        new_run[1:] = np.diff(at) > 1
        first = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        use = (np.arange(len(at)) - first) % 2 == 0
        at, chosen = at[use], chosen[use]
        # overlapping places may leave a pair few; half of all stay, so some pair keeps half of its count
        good = np.bincount(chosen, minlength=len(top)) * 2 >= MIN_COUNT
        fresh = len(lengths)
        at, chosen = at[good[chosen]], (np.cumsum(good) - 1)[chosen[good[chosen]]]
        rules = values[top[good]]
        parts.append(rules)
        a, b = (rules >> np.uint64(32)).astype(np.int64), (rules & np.uint64(0xFFFFFFFF)).astype(np.int64)
        seq[at] = len(lengths) + chosen
        lengths = np.concatenate([lengths, lengths[a] + lengths[b]])
        last[at] = last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last, often = seq[stay], last[stay], often[stay]
    rules = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return seq, last, np.stack([rules >> np.uint64(32), rules & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32), lengths[base:]


def write_shard(docs: list[np.ndarray]) -> bytes:
    """The payload of some documents' ids."""
    sizes = np.array([len(d) for d in docs], np.uint32)
    seq = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    base = int(seq.max(initial=0)) + 1
    last = np.zeros(len(seq), bool)
    last[np.cumsum(sizes, dtype=np.int64) - 1] = True
    seq, last, rules, lengths = re_pair(seq, last, base)
    own = np.diff(np.flatnonzero(last), prepend=-1)
    width = 2 if base + len(rules) <= 65_536 else 4
    plain = lambda x: x.astype(f"<u{width}").tobytes()
    return b"".join([b"RPG2", struct.pack("<5I", width, base, len(rules), len(seq), len(docs)), plain(rules[:, 0]), plain(rules[:, 1]), lengths.astype("<u4").tobytes(), plain(seq), own.astype("<u4").tobytes(), sizes.astype("<u4").tobytes()])


class Shard:
    """A payload, decoded document by document or id range by id range."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"RPG2":
            raise ValueError("not a token shard")
        width, self.base, n_rules, n_symbols, n_docs = struct.unpack_from("<5I", payload, 4)
        at, symbol = 24, f"<u{width}"

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        left, right, lengths = take(symbol, n_rules).tolist(), take(symbol, n_rules).tolist(), take("<u4", n_rules)
        self.symbols = take(symbol, n_symbols).astype(np.int64)
        self.doc_symbols, self.doc_ids = take("<u4", n_docs), take("<u4", n_docs)
        self.lengths = np.concatenate([np.ones(self.base, np.int64), lengths.astype(np.int64)])
        # all expansions one after another; a rule's parts come before it
        self.place = np.concatenate([np.arange(self.base), self.base + np.cumsum(lengths, dtype=np.int64) - lengths])
        self.flat = np.empty(self.base + int(lengths.sum()), np.uint32)
        self.flat[: self.base] = np.arange(self.base)
        size, place, flat = self.lengths.tolist(), self.place.tolist(), self.flat
        for k, (a, b) in enumerate(zip(left, right, strict=True), self.base):
            to = place[k]
            mid = to + size[a]
            flat[to:mid] = flat[place[a] : place[a] + size[a]]
            flat[mid : mid + size[b]] = flat[place[b] : place[b] + size[b]]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.lengths[symbols]
        ends = np.cumsum(n)
        return self.flat[np.arange(int(n.sum())) + np.repeat(self.place[symbols] - ends + n, n)]

    def documents(self) -> list[np.ndarray]:
        return np.split(self._expand(self.symbols), np.cumsum(self.doc_ids, dtype=np.int64)[:-1]) if len(self.doc_ids) else []

    def read(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start:stop of one document; only the symbols that cover them are expanded."""
        first = int(self.doc_symbols[:doc].sum())
        own = self.symbols[first : first + int(self.doc_symbols[doc])]
        ends = np.cumsum(self.lengths[own])
        stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return self._expand(own[a:b])[start - skipped : stop - skipped]


SHARDS = "part int, seq int, ids long, doc_ids array<long>, payload binary"


def _slices(batch: pa.RecordBatch):
    """Runs of rows (id, text) whose texts take TOGETHER bytes at most, or that are one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TOGETHER, "right")))
        yield batch.slice(at, end - at)
        at = end


def _writer(path: str, shard_ids: int, kept: int, stays: bool):
    def run(batches):
        from pyspark import TaskContext

        part, encoder, seq = TaskContext.get().partitionId(), _encoder(path, kept), 0
        names, docs, held = [], [], 0

        def out():
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([write_shard(docs)], pa.binary())], names=["part", "seq", "ids", "doc_ids", "payload"])
            return row

        for batch in batches:
            for piece in _slices(batch):
                for name, ids in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist()), strict=True):
                    names.append(name)
                    docs.append(ids)
                    held += len(ids)
                    if held >= shard_ids:
                        yield out()
                        names, docs, held, seq = [], [], 0, seq + 1
        if docs:
            yield out()

    return run if stays else lean(run)


def write_tokens(docs: DataFrame, to: str, vocabulary: str, shard_ids: int = SHARD_IDS, kept: int = CACHED, stays: bool = True) -> None:
    """docs (doc_id, text, ...) -> shards under the path `to`, a Parquet table of SHARDS.

    Rows are dealt by ranges of doc_id and sorted in them (null ids first, equal ids by text), so (part, seq) is
    ascending doc_id order. Null texts are empty; every document ends with id 2; repeated rows are written each; texts
    of any length are encoded whole; other columns, whatever their names, are ignored. An empty table writes no shard. A worker keeps up to `kept` pieces of texts
    in each of two generations, some 200 bytes each: fewer take less memory and more time. Its encoder serves its later tasks; unless it `stays`, it goes
    with each task, so that only workers that run one have it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_writer(vocabulary, shard_ids, kept, stays), SHARDS).write.option("compression", "zstd").parquet(to)


def _reader(batches):
    for batch in batches:
        for part, seq, names, payload in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3)), strict=True):
            ids = Shard(payload).documents()
            n = np.array([len(d) for d in ids], np.int64)
            k = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * k, pa.int32()), pa.array([seq] * k, pa.int32()), pa.array(names, pa.int64()), pa.array(np.cumsum(n) - n, pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in ids], pa.int64())],
                names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Shards -> one row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. No shards: no
    rows."""
    shards = spark.read.schema(SHARDS).parquet(path)
    ids = shards.select("part", "seq", "ids")
    parts = ids.groupBy("part").agg(F.sum("ids").alias("n"))  # one row for each task that wrote
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    starts = ids.join(before, "part").select("part", "seq", (F.col("base") + F.sum("ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("ids")).alias("before"))
    docs = shards.select("part", "seq", "doc_ids", "payload").mapInArrow(_reader, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def encoded(docs: DataFrame, vocabulary: str, kept: int = CACHED, stays: bool = True) -> DataFrame:
    """Writes docs as shards in the shared folder and reads them back; cases are as in write_tokens()."""
    to = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, to, vocabulary, kept=kept, stays=stays)
    return read_tokens(docs.sparkSession, to)
