"""Each operator against a plain version, and on nulls, empty and long texts, repeats, empty tables, clashing columns."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from swellframe.llm import common, decontam, html_text, line_dedup, mixing, near_dup, pii, quality, token_output, topk, toxicity
from swellframe.operators.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def words(rng, n, pool=400):
    return " ".join("w" + str(rng.randrange(pool)) for _ in range(n))


def docs(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "en" if i % 3 else "de", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def hard(spark):
    """Nulls in every column, empty and blank texts, repeated rows, ties, one long text, clashing extra columns."""
    from pyspark.sql import functions as F

    rng = random.Random(1)
    base = words(rng, 60)
    rows = [(0, base, "en", "s0", 1), (0, base, "en", "s0", 1), (1, base + " tail", None, None, None), (2, None, "en", "s0", 0), (3, "", "en", "s0", 0), (4, " \n\t ", "de", "s1", 1), (None, "no id here at all", None, "s1", 2), (5, words(rng, 20_000, 10**6), "fr", "s1", 9), (6, "one", "en", "s0", 3), (7, "é" * 50 + "\U0001f600 x", "es", "s0", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("w", "row", "hits", "node", "comp", "weight", "topic", "score", "a.b", "gone"):
        df = df.withColumn(c, F.lit("clash"))
    return df


LABELS = "doc_id long, quality int, toxic int"


def test_components(spark):
    got = components(spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (5, 5), (None, 3)], "a long, b long"))
    assert {r.node: r.comp for r in got.collect()} == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def brute_components(texts, size):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    own = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                    own[a] = own[b] = min(own[a], own[b])
    return {i: (len(sets[i]), own[i]) for i in sets}


def test_near_duplicates(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(8):
        base = words(rng, rng.randint(30, 120)).split()
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "new" + str(rng.random())
            texts.append(" ".join(w))
    texts += ["a b c", "A  b\nc", "a b d", "", None, "single"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs(spark, texts), 4).collect()}
    assert got == brute_components(dict(enumerate(texts)), 4)
    kept = near_dup.keep_one(docs(spark, texts), 4)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in got.items() if i == c)


def test_near_duplicates_small(spark):
    """Short texts at the threshold are linked though the estimate for them is far too low."""
    rng = random.Random(17)
    texts = {}
    while len(texts) < 10:
        w = words(rng, 8, 10**9)
        a, b = (near_dup.minima(near_dup.shingles(t, 4)) % 16 for t in (w, w[: w.rindex(" ")]))
        if 1 - (a != b).mean() * 16 / 15 < 0.74:
            texts[len(texts)] = w
            texts[len(texts)] = w[: w.rindex(" ")]
    want = {i: c for i, (_, c) in brute_components(texts, 4).items()}
    assert len(set(want.values())) == 5
    got = near_dup.near_duplicates(docs(spark, list(texts.values())), size=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_signatures():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64) * np.uint64(2))
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    x, y = near_dup.minima(a), near_dup.minima(b)
    true = 800 / (len(a) + 100)
    assert abs((x == y).mean() - true) < 0.06
    nib = lambda s: np.stack([(s.view(np.uint64) >> np.uint64(4 * k)) & np.uint64(15) for k in range(15)], 1)
    same = (nib(near_dup.packed(x)) == nib(near_dup.packed(y))).mean()
    assert abs((same - 1 / 16) / (15 / 16) - true) < 0.06


def test_near_duplicates_hard(spark):
    got = near_dup.near_duplicates(hard(spark)).collect()
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert len(got) == 10 and by[(1, 57)].component_id == 0 and not by[(1, 57)].kept
    assert by[(None, 1)].kept and by[(None, 1)].component_id is None and by[(2, 0)].component_id == 2
    assert near_dup.keep_one(hard(spark)).columns == hard(spark).columns
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    bench = spark.createDataFrame([(1, item), (2, "Two Words"), (3, None), (4, "!!"), (None, "no id")], "item_id long, text string")
    texts = [f"x {item.upper()} y", "x " + " ".join(item.split()[:9]) + " y", "here two-words, end", None, "", f"{item}! {item}"]
    d = docs(spark, texts)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.report(d, bench).collect()}
    assert got == {0: (13, 11, 1, True), 1: (11, 0, 0, False), 2: (4, 2, 1, True), 3: (0, 0, 0, False), 4: (0, 0, 0, False), 5: (22, 22, 1, True)}
    joined = decontam.scan(d, bench, 10, most=0)
    assert {r.row.doc_id: len(r.hits) for r in joined.collect()} == {0: 2, 1: 0, 2: 1, 3: 0, 4: 0, 5: 4}
    assert sorted(r.doc_id for r in decontam.remove_documents(d, bench).collect()) == [1, 3, 4]
    assert {r.doc_id: r.text for r in decontam.remove_spans(d, bench).collect()}[2] == "here, end"
    assert decontam.report(hard(spark), bench).count() == 10
    assert decontam.remove_documents(hard(spark), bench).columns == hard(spark).columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.report(d, none).where("contaminated").count() == 0
    assert decontam.report(docs(spark, []), bench).count() == 0
    sha = {r.doc_id: r.items_sha256 for r in decontam.report(d, bench).collect()}
    assert sha[0] == hashlib.sha256(b"1").hexdigest() and sha[1] == hashlib.sha256(b"").hexdigest()


def test_toxicity(spark):
    rng = random.Random(5)
    bad = ["blorgh", "snazzle", "grimp"]
    rows, labels = [], []
    for i in range(400):
        w = words(rng, rng.randint(10, 200)).split()
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append(" ".join(w))
        labels.append((i, 1, int(i % 5 == 0)))
    lab = spark.createDataFrame(labels, LABELS)
    model = toxicity.train(docs(spark, rows), lab)
    assert {" blorgh ", " snazzle ", " grimp "} <= set(model.lexicon)
    fresh = ["calm text here", "what a Gr1mp", "blоrgh", "", None, "sna​zzle " + words(rng, 3000), "grimpy things"]
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs(spark, fresh), model).collect()}
    assert [got[i] for i in range(5)] == [False, True, True, False, False] and not got[6]
    model.exceptions.append("grimp line")
    assert not toxicity.ToxicityModel(model.lexicon, ["grimp line"]).matcher()("the grimp line")[2]
    assert toxicity.score(hard(spark), model).count() == 10 and toxicity.keep_clean(hard(spark), model).columns == hard(spark).columns
    none = toxicity.train(docs(spark, rows), spark.createDataFrame([(None, None, None)], LABELS))
    assert toxicity.keep_clean(docs(spark, rows), none).count() == 400
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_quality(spark):
    rng = random.Random(6)
    good = [words(rng, rng.randint(20, 150)) + "." for _ in range(150)]
    junk = [" ".join(x + rng.choice(["###", "$$$"]) for x in words(rng, rng.randint(20, 150)).split()) for _ in range(150)]
    rows = [x for p in zip(good, junk, strict=True) for x in p]
    lab = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(200)], LABELS)
    d = docs(spark, rows)
    model = quality.train(d, lab)
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    held = [(got[i] >= 0.7) == (i % 2 == 0) for i in range(200, 300)]
    assert np.mean(held) >= 0.95 and all(0 <= v <= 1 for v in got.values())
    assert quality.score(hard(spark), model).count() == 10 and quality.score(docs(spark, []), model).count() == 0
    blank = quality.train(hard(spark), spark.createDataFrame([], LABELS))
    assert {round(r.score, 6) for r in quality.score(hard(spark), blank).collect()} == {0.5}


def test_quality_words():
    w = quality.words(["ab ab 12 !!", None, "", "AB"])
    assert np.bincount(w.doc, minlength=4).tolist() == [4, 0, 0, 1] and w.bucket[0] == w.bucket[1] != w.bucket[4]


def test_quality_pooled():
    """Pooled inputs against a plain loop over words, whatever the block."""
    rng = np.random.default_rng(3)
    vectors, weights = rng.normal(size=(quality.BUCKETS, quality.DIMS)).astype(np.float32), rng.random(quality.BUCKETS).astype(np.float32)
    texts = [words(random.Random(k), k * 7) for k in range(12)] + ["", None, "!! ab"]
    want = []
    for t in texts:
        b = quality.words([t]).bucket
        row = []
        for w in (np.ones(len(b)), weights[b]):
            v = vectors[b]
            mean = (v * w[:, None]).sum(axis=0) / max(w.sum(), 1e-9)
            spread = np.sqrt(np.maximum((v * v * w[:, None]).sum(axis=0) / max(w.sum(), 1e-9) - mean**2, 0))
            dots, pair = [float(v[i] @ v[i - 1]) for i in range(1, len(b))], [w[i] * w[i - 1] for i in range(1, len(b))]
            many = max(sum(pair), 1e-9)
            row += [*mean, *spread, (mean**2).sum(), sum(p * d for p, d in zip(pair, dots, strict=True)) / many, sum(p * d * d for p, d in zip(pair, dots, strict=True)) / many]
        want.append(row)
    for block in (40, 1 << 17):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(quality, "POOL_BLOCK", block)
            assert np.allclose(quality.pooled(texts, vectors, weights), want, atol=1e-4)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_held_out(spark):
    """Quality and toxicity on labelled rows that weren't learned from."""
    from swellframe.llm import entry
    from swellframe.llm.common import table

    labels = {r.doc_id: (r.quality, r.toxic) for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    for f, k, least in ((entry.op1_quality, 0, 0.95), (entry.op7_toxicity, 1, 0.93)):
        got = [(r.predicted == labels[r.doc_id][k]) for r in f(spark, "/root/testdata/sf0.01").where("held_out").collect() if r.doc_id in labels]
        assert len(got) > 50 and np.mean(got) >= least


def test_toxicity_matcher():
    """Hits of the automaton against a plain search of every place."""
    lexicon, exceptions = {" blor": 2.0, " blorgh ": 3.0, " snaz": 1.5, " a ": 0.5}, ["blorgh fish", "snazzy snazzle"]
    match = toxicity.ToxicityModel(lexicon, exceptions).matcher()
    rng = random.Random(2)
    for _ in range(300):
        text = " ".join(rng.choice(["blorgh", "Bl0rg", "fish", "snazzy", "snazzle", "a", "x..y", "blo"]) for _ in range(rng.randint(0, 9)))
        folded = toxicity.fold(text)
        spared = [(i, i + len(p) + 1) for p in exceptions for i in range(len(folded)) if folded.startswith(f" {p} ", i)]
        hits = {}
        for i in range(len(folded)):
            found = [w for k, w in lexicon.items() if folded.startswith(k, i)]
            if found and not any(a <= i < b for a, b in spared):
                hits[i] = max(found)
        weight, n, _ = match(text)
        assert weight == pytest.approx(sum(hits.values())) and n == len(folded.split())


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    n = lambda x: len(re.sub("[^0-9]", "", x))
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 14 <= n(m[0]) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 10 <= n(m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii(spark):
    rng = random.Random(7)
    parts = ["a@b.c", "@", ".", "x.y+z@q-r.co.uk", "1.2.3.4", "256.1.1.1", "00012.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 555-1234", "+49", " ", "é", "12", "-", 'token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"']
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    assert [pii.base_spans(t) for t in texts] == [plain_spans(t) for t in texts]
    got = {r.doc_id: r for r in pii.find(docs(spark, [*texts, None, ""])).collect()}
    for i, t in enumerate(texts):
        base = plain_spans(t)
        own = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert got[i].base_sha256 == hashlib.sha256(own.encode()).hexdigest() and got[i].n_email == sum(k == "email" for k, _, _ in base)
        assert {x for x in own.split(",") if x} <= set(got[i].spans.split(","))
    assert any("secret" in r.spans for r in got.values()) and got[600].spans == got[601].spans == ""
    assert all(r.n_spans == len([x for x in r.spans.split(",") if x]) and r.n_secret == r.spans.count("secret:") for r in got.values())
    assert sum(r.n_rejected for r in got.values()) > 20 and sum(r.n_added for r in got.values()) > 20  # the labelers part them
    assert pii.find(hard(spark)).count() == 10 and pii.find(docs(spark, [])).count() == 0
    assert pii.redact(docs(spark, ["to a@b.cd now", None])).collect()[0].text == "to <email> now"
    assert pii.base_spans("9" * 200_000 + "a" * 200_000) == []  # linear time


@pytest.mark.parametrize("n", [11, 12, 128, 129, 256, 5000])
def test_long_secrets(n):
    """Secret candidates have no upper length."""
    text = f"api_key = {('a1B2c3D4e5' * n)[:n]} end"
    assert pii.candidates(text, []) == ([("secret", 10, 10 + n)] if n >= 12 else [])


def test_expectation_maximisation():
    patterns = np.array([[1, 1], [1, -1], [-1, 1], [-1, -1]])
    _, rel, chance = pii.expectation_maximisation(patterns, np.array([400.0, 40, 40, 400]))
    assert chance[0] > 0.9 and chance[3] < 0.1 and np.allclose(rel.sum(axis=2), 1)


def test_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(8)
    texts = [words(rng, rng.randint(0, 400), 60) for _ in range(40)] + ["a  b", " lead", "tail ", "a \n b", "a\n\nb c", "<|endoftext|> x", "é ü  　z", None, ""]
    rng.shuffle(texts)
    start, want = 0, {}
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_output.encoded(docs(spark, texts), VOCABULARY).collect()}
    assert got == want
    assert token_output.encoded(hard(spark), VOCABULARY).count() == 10 and token_output.encoded(docs(spark, []), VOCABULARY).count() == 0


@pytest.mark.parametrize("top", [50, 60_000, 200_000])
def test_re_pair(top):
    rng = np.random.default_rng(top)
    phrase = rng.integers(0, top, 12)
    made = [np.concatenate([phrase if rng.random() < 0.5 else rng.integers(0, top, 5) for _ in range(rng.integers(0, 60))] + [np.array([2])]).astype(np.uint32) for _ in range(80)]
    data = token_output.write_shard(made)
    shard = token_output.Shard(data)
    assert all((a == b).all() for a, b in zip(shard.documents(), made, strict=True))
    assert len(shard.symbols) < sum(map(len, made)) / 2
    for i in (0, 7, 79):
        assert (shard.read(i, 3, 20) == made[i][3:20]).all() and (shard.read(i) == made[i]).all()
    # nothing is left to replace
    ends = np.cumsum(shard.doc_symbols)
    pairs = [tuple(p) for a, b in zip(ends - shard.doc_symbols, ends, strict=True) for p in zip(shard.symbols[a : b - 1], shard.symbols[a + 1 : b], strict=True)]
    assert max(np.unique(pairs, axis=0, return_counts=True)[1]) < token_output.MIN_COUNT
    assert token_output.Shard(token_output.write_shard([])).documents() == []


def test_re_pair_depth():
    """A passage of 1,000 ids in 40 documents ends in few symbols, and any part of it is read by itself."""
    rng = np.random.default_rng(5)
    phrase = rng.integers(3, 50_000, 1000)
    made = [np.concatenate([rng.integers(3, 50_000, 7), phrase, [2]]).astype(np.uint32) for _ in range(40)]
    shard = token_output.Shard(token_output.write_shard(made))
    assert shard.lengths.max() >= 500 and shard.doc_symbols.max() < 20
    for _ in range(50):
        i, a, b = rng.integers(0, 40), *sorted(rng.integers(0, 1008, 2))
        assert (shard.read(i, a, b) == made[i][a:b]).all()


def test_encoder_pieces():
    """Pieces are cut where the tokenizer cuts: whatever stands around line ends and blanks."""
    from tokenizers import Tokenizer

    t, enc, rng = Tokenizer.from_file(VOCABULARY), token_output.Encoder(VOCABULARY), random.Random(3)
    parts = [" ", "\n", "\n\n", "a", "Bc", "'s", "12", "é", "...", "\t", "\u00a0", "\u3000", "<|endoftext|>", "x" * 60, "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 15))) for _ in range(3000)] + ["a\nb", "a b\nc d\n\ne", "\na", "a\n"]
    for at in range(0, len(texts), 200):
        for text, ids in zip(texts[at : at + 200], enc.encode(texts[at : at + 200]), strict=True):
            assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 2], repr(text)


def test_encoder_repeats():
    """Words met before, also those with other signs behind them, don't go to the tokenizer again."""
    enc, asked = token_output.Encoder(VOCABULARY), []

    class Spy:
        def __init__(self, tokenizer):
            self.t = tokenizer

        def encode(self, text, **more):
            asked.append(text)
            return self.t.encode(text, **more)

        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return self.t.encode_batch_fast(texts, **more)

    plain = enc.tokenizer
    enc.tokenizer = Spy(plain)
    enc.encode(["x alphabet betamax 12"])
    asked.clear()
    text = "x alphabet, betamax.%% alphabet! 12; \u00fc."
    assert enc.encode([text])[0].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]
    assert asked and not any("alphabet" in x or "betamax" in x or "12" in x for x in asked)


def test_encoder_generations():
    """Small generations, which turn over, and pieces too long for them give the same ids."""
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(VOCABULARY), random.Random(4)
    enc = token_output.Encoder(VOCABULARY, kept=40)
    some = ["".join(rng.choice("abcde") for _ in range(rng.choice([2, 3, 4, 70]))) + rng.choice(["", ",", ".\u2014", "'", "_", "'s."]) for _ in range(150)]
    for _ in range(30):
        texts = [rng.choice([" ", "\n", "  "]).join(rng.choices(some, k=rng.randint(0, 25))) for _ in range(7)] + [None]
        for text, ids in zip(texts, enc.encode(texts), strict=True):
            assert ids.tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 2], repr(text)
        assert not any(len(x) > 48 for x in enc.cache.at)


def test_re_pair_rounds(monkeypatch):
    """Rounds after the first count only pairs that may be frequent."""
    counted, plain = [], token_output._frequent
    monkeypatch.setattr(token_output, "_frequent", lambda pair: counted.append(len(pair)) or plain(pair))
    rng = np.random.default_rng(6)
    phrase = rng.integers(3, 90, 64)
    # pairs in a run overlap, so not all frequent ones are replaced in the first round
    made = [np.concatenate([rng.integers(3, 50_000, 300), phrase, np.full(9, 5), [2]]).astype(np.uint32) for _ in range(300)]
    shard = token_output.Shard(token_output.write_shard(made))
    assert all((a == b).all() for a, b in zip(shard.documents(), made, strict=True))
    assert len(counted) > 4 and sum(counted[1:]) < counted[0]


def test_lines(spark):
    texts = [f"menu\nbody {i}\n\nmenu" if i % 2 == 0 else f"other {i}\nmenu" if i < 4 else f"other {i}" for i in range(20)] + [None, ""]
    got = {r.doc_id: r for r in line_dedup.drop_lines(docs(spark, texts), ratio=0.5).collect()}
    assert got[0].text == "body 0\n" and (got[0].n_lines, got[0].n_dropped) == (4, 2)
    assert got[1].text == "other 1\nmenu" and got[20].text == "" and got[20].n_lines == 1
    wide = {r.doc_id: r.text for r in line_dedup.drop_lines(docs(spark, texts), ratio=0.5, most=-1).collect()}
    assert wide == {i: r.text for i, r in got.items()}
    assert line_dedup.drop_lines(hard(spark)).count() == 10 and line_dedup.drop_lines(docs(spark, [])).count() == 0


def test_mixing(spark):
    import pandas as pd

    cells = pd.DataFrame({"source": ["a", "a", "b", "b"], "lang": ["x", "y", "x", "y"], "topic": ["t"] * 4, "tokens": [700, 100, 100, 100]})
    w = mixing.rake(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.6, "y": 0.4}})
    fitted = w * cells.tokens
    assert np.allclose(fitted[:2].sum(), 500) and np.allclose(fitted[[0, 2]].sum(), 600) and np.allclose(fitted.sum(), 1000)
    c = mixing.calibrate(cells.tokens.to_numpy(float), w, 400)
    assert np.isclose((cells.tokens * np.minimum(1, c * w)).sum(), 400)
    rng = random.Random(9)
    d = docs(spark, [words(rng, rng.randint(1, 300)) for _ in range(600)])
    got = mixing.weighted(d, fraction=0.5).toPandas()
    assert abs((got.tokens * got.probability).sum() / got.tokens.sum() - 0.5) < 1e-6
    assert abs(got.tokens[got.sampled].sum() / got.tokens.sum() - 0.5) < 0.1
    assert mixing.mixed(d, fraction=0.5).count() == got.sampled.sum()
    assert mixing.weighted(hard(spark)).count() == 10 and mixing.mixed(hard(spark)).columns == hard(spark).columns
    assert mixing.weighted(docs(spark, [])).count() == 0


def test_raking_plain():
    """Raked weights against a plain loop over dictionaries; a source named None is not the null source."""
    import pandas as pd

    rng = random.Random(8)
    keys = [(s, la, t) for s in ("a", "b", "None", None) for la in ("x", "y") for t in ("p", "q")]
    cells = pd.DataFrame([(*k, rng.randint(1, 500)) for k in keys], columns=["source", "lang", "topic", "tokens"])
    targets = {"source": {"a": 0.4, "b": 0.3, "None": 0.2, None: 0.1}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.7, "q": 0.3}}
    now = dict(zip(keys, map(float, cells.tokens), strict=True))
    total = sum(now.values())
    for _ in range(500):
        for m, name in enumerate(("source", "lang", "topic")):
            for value, share in targets[name].items():
                have = sum(v for k, v in now.items() if k[m] == value)
                now |= {k: v * share * total / have for k, v in now.items() if k[m] == value}
    got = mixing.rake(cells, targets) * cells.tokens
    assert np.allclose(got, [now[k] for k in keys], rtol=1e-6)


def test_raking_conflict():
    """Languages and topics that nearly coincide can't both have their targets; the wanted tokens are drawn all the same."""
    import pandas as pd

    table = {
        "de": [270762, 15228728, 141878, 338640, 360689, 131804, 628570, 1179983],
        "en": [38107861, 2206560, 9015518, 1575644, 1845445, 7818220, 5650975, 4915527],
        "es": [81468, 146717, 65190, 177872, 11368658, 77763, 338736, 563047],
        "fr": [98181, 465995, 109035, 15914771, 536890, 116672, 707533, 847224],
    }
    rng, rows = np.random.default_rng(2), []
    for source in range(20):
        tokens = np.rint(np.concatenate([*table.values()]) / 1000 * rng.uniform(0.9, 1.1, 32) * (10 if source == 0 else 1)).astype(int)
        rows += [(f"src{source}", lang, f"topic{t}", n) for (lang, t), n in zip([(k, t) for k in table for t in range(8)], tokens, strict=True)]
    cells = pd.DataFrame(rows, columns=["source", "lang", "topic", "tokens"])
    targets = mixing.tempered(cells)
    with np.errstate(over="raise", invalid="raise"):
        got = mixing.probabilities(cells, targets, 0.8)
    assert (got >= 0).all() and (got <= 1 + 1e-9).all()
    assert (got * cells.tokens).sum() == pytest.approx(0.8 * cells.tokens.sum())
    assert mixing.reached(cells.assign(probability=got), targets).shortfall.max() < 0.03


def test_raking_tables(spark):
    """Raking over tables gives the weights and probabilities of the driver's; capped values are whole in both."""
    import pandas as pd

    rng = random.Random(3)
    cells = pd.DataFrame([(s, la, t, rng.randint(1, 4000) * (20 if s == "a" else 1)) for s in ("a", "b", "c", None) for la in ("x", "y") for t in ("p", "q", "r")], columns=["source", "lang", "topic", "tokens"])
    rows = [tuple(None if v is None else v for v in r) for r in cells.itertuples(index=False)]
    df = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    for targets in ({"source": {"a": 0.5, "b": 0.3}, "lang": {"x": 0.5, "y": 0.5}},):
        want = targets or mixing.tempered(cells)
        got = {(r.source, r.lang, r.topic): (r.weight, r.probability) for r in mixing.raked_table(df, targets, 0.5, rounds=10).collect()}
        weight, chance = mixing.rake(cells, want), mixing.probabilities(cells, want, 0.5)
        for k, w, p in zip(rows, weight, chance, strict=True):
            assert got[k[:3]][0] == pytest.approx(w, rel=1e-3) and got[k[:3]][1] == pytest.approx(p, abs=5e-3)


def test_topics(spark):
    """Texts of two vocabularies fall apart; names are those of the nearest centre; long texts are whole."""
    rng = random.Random(2)
    texts = [" ".join(("w" if i % 2 else "zz") + str(rng.randrange(200)) for _ in range(60)) for i in range(200)] + [None, " ", "w1 " * 400_000]
    model = mixing.fit_topics(docs(spark, texts), topics=2)
    names = model.name(texts)
    assert len(set(names[0:200:2])) == 1 and len(set(names[1:200:2])) == 1 and names[0] != names[1] and names[200:202] == ["empty", "empty"] and names[202] == names[1]
    assert mixing.token_count("a b\n c") == 3 and mixing.token_count(None) == mixing.token_count(" ") == 1 and mixing.token_count("x") == 1
    with pytest.MonkeyPatch.context() as m:
        m.setattr(mixing, "BLOCK", 50)
        assert model.name(texts[:202]) == names[:202]


def test_lean_tasks(monkeypatch):
    """What a worker keeps goes before a task of another kind starts, and again when it has ended."""
    kept, seen = ["pieces"], []
    monkeypatch.setattr(common, "_kept", [kept.clear])

    @common.lean
    def run(batches):
        for b in batches:
            seen.append(list(kept))
            kept.append(b)
            yield b

    assert list(run([1, 2])) == [1, 2] and seen == [[], [1]] and not kept


def test_token_tasks_let_go(monkeypatch):
    """A token task whose encoder doesn't stay leaves none in its worker."""
    import pyarrow as pa
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words of a text"])], names=["doc_id", "text"])
    path = public_tokenizers.path("byte_bpe_50k.json")
    stay, go = (list(token_output._writer(path, 1000, 100, stays)(iter([batch]))) for stays in (True, False))
    assert stay == go and token_output._encoder.cache_info().currsize == 0


def test_mixing_hot_source(spark):
    """All marginals of the sample have their target shares; what lacks the tokens is taken whole and told."""
    import pandas as pd

    rng = random.Random(5)
    rows = []
    for i in range(6000):
        hot = rng.random() < 0.4
        lang = "en" if rng.random() < (0.8 if hot else 0.5) else rng.choice(["de", "fr"])
        rows.append((i, " ".join(["word"] * (rng.randint(150, 300) if rng.random() < 0.7 else rng.randint(20, 100))), lang, "hot" if hot else f"s{rng.randrange(5)}", 0))
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows, SCHEMA)
    size = F.when(F.length("text") < 600, "short").otherwise("long")
    for fraction, whole in ((0.5, set()), (0.8, {"short"})):
        got = mixing.weighted(d, size, fraction=fraction).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n"]), on="doc_id")
        assert abs((got.tokens * got.probability).sum() / got.tokens.sum() - fraction) < 1e-6
        told = {(r.margin, r.value): r for r in mixing.shares(d, size, fraction=fraction).collect()}
        targets = mixing.tempered(got)
        for m in mixing.MARGINS:
            mine = (got.tokens * got.probability).groupby(got[m]).sum() / (got.tokens * got.probability).sum()
            drawn = got.tokens[got.sampled].groupby(got[m]).sum() / got.tokens[got.sampled].sum()
            scale = {mine[v] / targets[m][v] for v in mine.index if v not in whole}
            assert max(scale) - min(scale) < 1e-6 and (whole & set(mine.index) or abs(max(scale) - 1) < 1e-6)
            for v in mine.index:
                assert abs(drawn[v] - mine[v]) < 0.02 and abs(told[m, v].share - mine[v]) < 1e-9
                assert abs(told[m, v].shortfall - max(0, targets[m][v] - mine[v])) < 1e-9
                assert (got.probability[got[m] == v].min() == 1) == (v in whole)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[50] = x[51] = x[52] = x[700]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (1000, [1.0] * 15 + [None]), (1001, [float("nan")] * 16), (1002, []), (None, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, shard_rows=200, block_rows=4).collect()}
    q = np.floor(1024 * x.astype(float)).astype(np.int64)
    for i in range(0, 900, 100):
        s = q @ q[i]
        best = sorted((-int(v), j) for j, v in enumerate(s) if j != i)[:10]
        assert [got[(i, k + 1)] for k in range(10)] == [(j, -v) for v, j in best]
    assert len(got) == 90
    assert topk.top_k(df.where("vec_id is null")).count() == 0 and topk.top_k(df.where("vec_id < 4")).count() == 3


def test_html(spark):
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><article><h1>Head &amp; line</h1><p>First  part\nof it.<br>More <b>words</b> here, and some more.<p>Second &eacute; part is here as well.</article><div class="comments"><p>Nice post, thanks a lot.</p></div><footer>&copy; x</footer><script>var a="<p>no</p>";</script>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>" + "x " * 50_000), (1, "u", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as text", "1 as n_chars")
    got = html_text.extract(df).collect()
    want = "Head & line\n\nFirst part of it. More words here, and some more.\n\nSecond é part is here as well."
    assert sorted(r.text for r in got if r.page_id == 1) == [want, want] and all(r.n_chars == len(r.text) for r in got) and len(got) == 5
    assert html_text.extract(df.where("page_id = 9")).count() == 0


@pytest.mark.parametrize(
    "odd",
    [
        "<script>for(i=0;i<n;i++){x()}</script>",
        "<script>var s = '<!--'; t = \"<b \" + 'don\\'t';</SCRIPT >",
        "<style>a:after{content:'<!-- <x'}</style>",
        "<textarea>a <b c</textarea>",
        "<video src=v><p>no video</p><div>x</div></video>",
        "<video src=v>",
        "<video src=v><video src=w>no video</video>",
        "<iframe src=v>",
        "<iframe src=v><iframe src=w></iframe>",
        "<div><object data=v><select><option>one</div>",
        "<svg><path d='M0'/><g>",
        "<svg><text>no</text><foreignObject><div>no</div></foreignObject></svg>",
        "<select><option>one<option>two</select>",
        "<template><p>no</p><template><p>no</p></template></template>",
        "<noscript><div><p>no</div></noscript>",
    ],
)
def test_html_silent(odd):
    """What stands in or after a silent element never takes text of the page with it."""
    page = f"<body><article><p>before</p>{odd}<p>first part</p></article><svg><g></g></svg><object></object><p>after"
    assert [b.text for b in html_text.leaf_blocks(page)] == ["before", "first part", "after"]


#: Pages of other markup than the generator's; main blocks are marked by a ¶.
HAND = (
    "<html><body><div class=topbar><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div><div id=page><h1>¶Storm reaches the coast</h1><p>¶A storm reached the northern coast on Monday evening, and many ferries stayed in their harbours.</p><p>¶Waves of nine metres were seen at the outer light.</p></div><div id=bottom><p>&copy; 2020 Coast Times. All rights reserved.</p></div></body></html>",
    "<body><table class=layout><tr><td class=leftnav><a href=a>One</a><br><a href=b>Two</a></td><td class=body><h2>¶How to tie a bowline</h2><p>¶Make a small loop, bring the end up through it, around the standing part and back down.</p><ol><li>¶Leave a long end.</li><li>¶Pull it tight.</li></ol></td></tr></table><div class=foot>Contact | Imprint</div>",
    "<main><h1>¶Release notes</h1><p>¶This version mends two faults and adds a reader for tiled cubes.</p><ul><li>¶Faster start.</li><li>¶Less memory.</li></ul></main><footer><ul><li><a href=/x>About</a></li><li><a href=/y>Jobs</a></li></ul></footer>",
    "<header><a href=/>Blog</a></header><article><header><h1>¶A week on the island</h1></header><p>¶We took the early boat and had the beach to ourselves until noon.</p><blockquote>¶Never trust a calm sea, the keeper said.</blockquote><p>¶On the last day it rained.</p></article><section id=comments><h3>3 comments</h3><p>Lovely pictures!</p><p>When did you go?</p></section>",
    "<p>¶Only one paragraph stands on this page, and it is the whole of the article that it holds.</p>",
    "<h1>¶Notice of works</h1><p>¶The harbour road is closed from Monday to Friday while the quay wall is mended.</p>",
    "<div class=wrapper><div class=cookie-bar><p>We use cookies to improve this site.</p><button>Accept all</button></div><div class=article-text><p>¶The museum has bought a chart of 1720 that shows the old channel before it silted up.</p><p>¶It will hang in the main hall from May.</p></div></div>",
    "<nav class=crumbs><a href=/>Start</a> &gt; <a href=/r>Recipes</a></nav><div class=recipe><h1>¶Fish soup</h1><p>¶Fry the onions in butter until they are soft, then add the stock and the potatoes.</p><p>¶Add the fish at the end and let it stand for five minutes.</p></div><aside class=more><h4>More recipes</h4><ul><li><a href=1>Bread</a></li><li><a href=2>Pie</a></li></ul></aside>",
    "<article><h1>¶Cookies in the oven</h1><p>¶These cookies need twelve minutes in a hot oven, and the newsletter of the bakery says that butter makes all the difference.</p></article><div class='newsletter'><p>Subscribe to our newsletter</p></div>",
    "<body><div class=menu><ul><li><a href=1>Products</a></li><li><a href=2>Support</a></li></ul></div><div class=text>¶Our pumps have kept cellars dry for sixty years, and every one is tested under load before it leaves the hall.</div><div class=legal>Terms of use | Privacy policy</div>",
    "<section><h2>¶Question</h2><p>¶Why does the tide come later every day?</p><h2>¶Answer</h2><p>¶Because the moon moves on while the earth turns, the place has to turn a little farther to meet it again.</p></section><form><p>Your e-mail</p><input name=m><button>Send</button></form>",
    "<div id=sidebar><h3>Archive</h3><ul><li><a href=1>May</a></li><li><a href=2>June</a></li></ul></div><div id=content><h1>¶Field diary</h1><p>¶Walked the dunes from the tower to the groyne and counted forty terns.</p><pre>¶tower 12  groyne 28</pre><p>¶Wind north, six.</p></div>",
)


def test_html_hand():
    """Block F1 on hand-labelled pages; every page with an article gives some of it."""
    field, hit, got, want = html_text.trained(), 0, 0, 0
    for page in HAND:
        truth = [b.text.startswith("¶") for b in html_text.leaf_blocks(page)]
        clean = html_text.leaf_blocks(page.replace("¶", ""))
        states = html_text.main_states(clean, field)
        assert len(clean) == len(truth) and any(s and t for s, t in zip(states, truth, strict=True)), page
        hit += sum(bool(s) and t for s, t in zip(states, truth, strict=True))
        got, want = got + sum(map(int, states)), want + sum(truth)
    print("block F1", 2 * hit / (got + want))
    assert 2 * hit / (got + want) > 0.9


def test_html_viterbi():
    """The decoded path against all paths, and the gradient against differences."""
    import itertools

    rng = np.random.default_rng(4)
    field = html_text.Field(rng.normal(size=(html_text.WIDTH, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    feats = [rng.integers(0, html_text.WIDTH, 5).tolist() for _ in range(7)]

    def score(path, f):
        e = f.potentials(feats)
        return f.first[path[0]] + sum(e[i, s] for i, s in enumerate(path)) + sum(f.step[a, b] for a, b in zip(path, path[1:], strict=False))

    paths = list(itertools.product((0, 1), repeat=7))
    assert tuple(field.decode(feats)) == max(paths, key=lambda p: score(p, field))
    for allowed in ([2], [0, 3, 5], list(range(7))):
        best = {i: max(score(p, field) for p in paths if p[i]) for i in allowed}
        assert html_text.likeliest(field, feats, allowed) == max(allowed, key=best.get)
    states = np.array([0, 1, 1, 0, 1, 0, 0])
    likelihood = lambda f: score(states, f) - np.logaddexp.reduce([score(p, f) for p in paths])
    _, step, first = html_text._gradient(field, feats, states)
    for a in range(2):
        moved = html_text.Field(field.emit, field.step, field.first + 1e-6 * np.eye(2)[a])
        assert abs((likelihood(moved) - likelihood(field)) / 1e-6 - first[a]) < 1e-4
        for b in range(2):
            moved = html_text.Field(field.emit, field.step + 1e-6 * np.outer(np.eye(2)[a], np.eye(2)[b]), field.first)
            assert abs((likelihood(moved) - likelihood(field)) / 1e-6 - step[a, b]) < 1e-4


def test_html_deep():
    """Elements nested thousands deep keep their ancestors, and long blocks are read to their end."""
    page = "<article>" + "<div class=x>" * 3000 + "<p>inside</p>" + "</div>" * 3000 + "<p>" + "word " * 200 + "cookie</p></article><p>after"
    blocks = html_text.leaf_blocks(page)
    assert [b.text[:6] for b in blocks] == ["inside", "word w", "after"] and "article" in blocks[0].above and "article" not in blocks[2].above
    assert len(html_text.block_features(blocks)[1]) > len(html_text.block_features([html_text.Block("word " * 200, "p", blocks[1].above, 0)])[0]) - 1


def test_html_field():
    pages = html_text.labelled_pages(260, seed=99)
    field = html_text.train(pages[:200])
    right = [(field.decode(html_text.block_features(b)) == np.array(s)).mean() for b, s in pages[200:] if b]
    assert np.mean(right) > 0.95


def test_queries_and_pipeline(spark, tmp_path):
    """Every query runs on small tables with nulls, and the pipeline keeps what a plain version keeps."""
    import corpus_pipeline
    from swellframe.llm import entry

    rng = random.Random(4)
    item = words(rng, 14, 10**6)
    texts = [words(rng, rng.randint(20, 80)) for _ in range(120)]
    texts[10] = texts[9]
    texts[20] += " " + item
    for i in range(0, 120, 6):
        texts[i] += " blorgh"
    texts[33] = None
    d = docs(spark, texts)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, int(i % 6 == 0)) for i in range(120)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(101)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    sizes = {name: f(spark, str(tmp_path)).count() for name, f in entry.queries().items()}
    other = {"op9_topk": 20, "op10_html": 1, "op12_lexical": 1, "op13_whitening": 101}  # one document holds the item's words; one column varies
    assert sizes == {n: other.get(n, 120) for n in sizes}

    got = d
    stay = {i for i, t in enumerate(texts) if "blorgh" not in (t or "")}
    for (name, stage), keep in zip(corpus_pipeline.STAGES[:3], (stay, stay - {10}, stay - {10, 20}), strict=True):
        got = stage(spark, got, str(tmp_path))
        assert got.columns == d.columns and {r.doc_id for r in got.select("doc_id").collect()} == keep, name
    kept = {r.doc_id for r in corpus_pipeline.mix_sources(spark, got, "").collect()}
    # every stage takes hard rows, and no rows at all
    for odd in (hard(spark), hard(spark).where("doc_id = 99")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, odd, str(tmp_path))
            assert name == "token_ids" or out.columns == odd.columns
            assert out.count() <= odd.count()
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == kept and corpus_pipeline.ORACLE_SQL is None
    start = 0
    for r in sorted(final, key=lambda r: r.doc_id):
        assert r.start == start
        start += r.n_tokens


def test_topics_of_all_documents(spark):
    """Rarities and centres come from every document, however many: they are those of a plain count, and every centre is
    the direction of the documents nearest to it."""
    rng = random.Random(12)
    texts = [" ".join(f"{'abc'[i % 3]}{rng.randrange(300)}" for _ in range(8)) for i in range(5_000)]
    model = mixing.fit_topics(docs(spark, texts))
    counts = sum(np.bincount(bucket, minlength=mixing.BUCKETS) for _, bucket, _ in mixing.word_counts(texts))
    assert np.allclose(model.rarity, np.log(5_001 / (counts + 1)) + 1, atol=1e-5)
    x = mixing.directions(texts, model.rarity).astype(float)
    own = (x @ model.centres.T).argmax(axis=1)
    for k, centre in enumerate(model.centres):
        near = x[own == k].sum(axis=0)
        assert near @ centre / np.linalg.norm(near) / np.linalg.norm(centre) > 0.999
