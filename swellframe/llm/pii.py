"""Personal data spans by weak supervision.

Strict patterns give the base spans, which always stay. Looser patterns give candidates: numbers in groups, spelled-out
addresses, assigned secrets, card-like numbers of any checksum, dotted numbers of any size, addresses without an
ending. Labelers vote on every candidate and base span, of which only candidates count: the pattern, the form (checksums, ranges, digits, variety of
signs), gazetteers (domain endings, dialling and card prefixes, shapes of keys), cue words before it, and words and
signs around it that speak against it; each votes for, against or abstains, and a failing form is final. Votes are counted by pattern over all
documents, and expectation-maximisation estimates every labeler's reliability and each pattern's chance of being
personal. A logistic span classifier is trained on those chances, with
counts of span features over all documents, and adds the candidates that it finds likely and that touch no base span.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swellframe.llm.common import same_columns


KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method finds.
MORE_KINDS = ("secret",)
_ORDER = {k: i for i, k in enumerate(KINDS + MORE_KINDS)}

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the strict patterns, leftmost and not overlapping within a kind, by start and kind."""
    out = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]]))


_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[{] ?(?:at|AT) ?[)\]}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[{] ?(?:dot|DOT) ?[)\]}]) ?[A-Za-z0-9-]{1,63}){1,4}")
_GROUPS = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?[ .\-/][0-9]{2,4}[ .\-/][0-9]{3,5}(?:[ .\-/][0-9]{2,5}){0,2}(?![0-9A-Za-z])")
_SECRET = re.compile(r"(?<![A-Za-z])[A-Za-z_]{2,24}[ ]{0,2}[=:][ ]{0,2}[\"']?([A-Za-z0-9_\-+/]{12,}+)")

_LOOSE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{2,63}(?![A-Za-z0-9.@-])")

#: Generic endings of domains; any two letters are a country's (fixed values).
ENDINGS = frozenset("com org net edu gov mil int info biz name pro museum aero coop jobs mobi travel tel cat asia post io dev app cloud online shop site blog tech store xyz club news live world email".split())
#: Dialling prefixes (fixed values): countries of one and two digits, and the first two digits of those of three.
DIAL = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
DIAL_3 = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 80 85 87 88 96 97 99".split())
#: Ranges of the first digits of card numbers (fixed values).
ISSUERS = ((1, 4, 4), (2, 51, 55), (4, 2221, 2720), (2, 34, 34), (2, 37, 37), (4, 6011, 6011), (3, 644, 649), (2, 65, 65), (4, 3528, 3589), (3, 300, 305), (2, 36, 36), (2, 38, 39), (2, 62, 62))
CUES = {
    "email": frozenset("mail email e contact write kontakt schreiben correo escribir courriel contacter adresse address at".split()),
    "ip": frozenset("ip ipv host server address adresse dirección addr client remote from node ping".split()),
    "card": frozenset("card visa mastercard amex credit debit karte kreditkarte carte tarjeta crédito payment pan".split()),
    "phone": frozenset("tel phone call fax mobile telefon téléphone teléfono handy móvil cell ring whatsapp".split()),
    "secret": frozenset("token secret key password passwd pwd apikey auth bearer credential private access passwort clave".split()),
}
AGAINST = frozenset("version release isbn issn page chapter license figure table section build order invoice seite kapitel página total sum price".split())
LABELERS = ("pattern", "form", "gazetteer", "context", "against")
_LETTERS = re.compile(r"[^\W\d_]+")


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Looser spans that touch neither a base span nor each other."""
    found = []
    if "(" in text or "[" in text or "{" in text:
        found += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    if "@" in text:
        found += [("email", *m.span()) for m in _LOOSE_AT.finditer(text)]
    if "=" in text or ":" in text:
        found += [("secret", *m.span(1)) for m in _SECRET.finditer(text)]
    found += [("phone", *m.span()) for m in _GROUPS.finditer(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text)]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(_digits(m[0])) <= 19]
    taken = sorted((s, e) for _, s, e in base)
    out, last, i = [], 0, 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= last and not (i < len(taken) and taken[i][0] < e):
            out.append((kind, s, e))
            last = e
    return out


def _issued(digits: str) -> bool:
    return any(low <= int(digits[:n]) <= high for n, low, high in ISSUERS)


def _well_formed(kind: str, own: str, digits: str) -> bool:
    """What each kind's form asks for beyond its loose pattern."""
    if kind == "email":
        return "." in own.rsplit("@", 1)[-1] if "@" in own else True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in own.split("."))
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return any(c.isalpha() for c in own) and bool(digits) and len(set(own)) >= 8


def _known(kind: str, own: str, digits: str) -> int:
    """The gazetteers' vote."""
    if kind == "email":
        end = re.split(r"[.\s)\]}@]+", own.strip(" )]}"))[-1].lower()
        return 1 if end in ENDINGS or len(end) == 2 and end.isalpha() else -1
    if kind == "ip":
        first = own.split(".")[0][-3:]
        return 1 if 1 <= int(first) <= 223 and int(first) != 127 else -1
    if kind == "card":
        return 1 if _issued(digits) else -1
    if kind == "phone":
        return (1 if digits[:1] in DIAL or digits[:2] in DIAL or digits[:2] in DIAL_3 else -1) if own[:1] == "+" else 0
    return 1 if len(own) in (32, 40, 64) and re.fullmatch(r"[0-9a-f]+", own) else 0


def _around(text: str, span: tuple[str, int, int]) -> tuple[bool, bool]:
    """Whether a cue word stands before the span, and whether something right before or after speaks against it."""
    kind, s, e = span
    before = _LETTERS.findall(text[max(0, s - 40) : s].lower())
    odd = bool(AGAINST.intersection(before[-2:])) or text[max(0, s - 2) : s].strip() in ("$", "€", "£", "#", "v") or text[e : e + 1] in ("%", "$", "€")
    return bool(CUES[kind].intersection(before[-5:])), odd


def votes(text: str, span: tuple[str, int, int], strict: bool) -> tuple[int, ...]:
    """Of each labeler: 1 for, -1 against, 0 none."""
    kind, s, e = span
    own = text[s:e]
    digits = _digits(own)
    cue, odd = _around(text, span)
    pattern = 1 if strict else -1 if kind in ("ip", "card") else 0
    return pattern, 1 if _well_formed(kind, own, digits) else -1, _known(kind, own, digits), 1 if cue else 0, -1 if odd else 0


def features(text: str, span: tuple[str, int, int]) -> tuple[int, ...]:
    """Small whole numbers that describe a span for the classifier."""
    kind, s, e = span
    own = text[s:e]
    n, digits = len(own), _digits(own)
    cue, odd = _around(text, span)
    return (_ORDER[kind], min(n // 6, 8), len(digits) * 4 // n, len(set(own)) * 4 // n, int(cue), int(odd), int(_well_formed(kind, own, digits)) + 2 * _ORDER[kind])


def _inputs(feats: np.ndarray, kinds: int = len(_ORDER)) -> np.ndarray:
    """The classifier's inputs: one-hot kinds and bins."""
    sizes = (kinds, 9, 5, 5, 2, 2, 2 * kinds)
    cols = [np.ones(len(feats))]
    for j, size in enumerate(sizes):
        cols += [feats[:, j] == v for v in range(size)]
    return np.stack(cols, axis=1).astype(float)


@dataclass
class PiiModel:
    prior: float
    reliability: np.ndarray  # (labeler, class, vote + 1)
    weights: np.ndarray

    def keep(self, text: str, span) -> bool:
        """Whether a candidate is likely; one whose form fails, such as its checksum or range, never is."""
        kind, s, e = span
        return _well_formed(kind, text[s:e], _digits(text[s:e])) and bool(_inputs(np.array([features(text, span)])) @ self.weights > 0)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50):
    """Vote patterns (m, labelers) in -1, 0, 1 with counts -> prior, reliabilities, each pattern's chance.

    Labelers are taken as independent given the class; the start trusts the majority, and a weak prior keeps votes
    that were never seen possible."""
    n, k = patterns.shape
    p = 1 / (1 + np.exp(-1.0 * patterns.sum(axis=1)))
    prior, rel = 0.5, np.full((k, 2, 3), 1 / 3)
    for _ in range(rounds):
        w = np.stack([counts * (1 - p), counts * p])
        prior = (w[1].sum() + 1) / (counts.sum() + 2)
        for j in range(k):
            for v in (-1, 0, 1):
                rel[j, :, v + 1] = w[:, patterns[:, j] == v].sum(axis=1)
            # a vote for is evidence for: the prior counts lean that way
            rel[j] += np.array([[2.0, 1.0, 0.5], [0.5, 1.0, 2.0]])
            rel[j] /= rel[j].sum(axis=1, keepdims=True)
        like = np.log([1 - prior, prior])[:, None] + sum(np.log(rel[j][:, patterns[:, j] + 1]) for j in range(k))
        p = 1 / (1 + np.exp(np.clip(like[0] - like[1], -30, 30)))
    return prior, rel, p


def _span_counts(batches):
    """(votes, features, n) of all spans of the task."""
    seen: dict[tuple, int] = {}
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                base = base_spans(text)
                for span, strict in [(s, True) for s in base] + [(s, False) for s in candidates(text, base)]:
                    key = (*votes(text, span, strict), *features(text, span))
                    seen[key] = seen.get(key, 0) + 1
    keys = list(seen)
    yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in keys], pa.list_(pa.int32())), pa.array([seen[k] for k in keys], pa.int64())], names=["key", "n"])


def train(docs: DataFrame) -> PiiModel:
    """docs (text) -> a model, from counts over all documents; no span at all gives one that adds none."""
    got = docs.select("text").mapInArrow(_span_counts, "key array<int>, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toPandas()  # votes and bins only: their number is bounded
    return fit(got)


def fit(got) -> PiiModel:
    width = _inputs(np.zeros((1, 7), int)).shape[1]
    if not len(got):
        return PiiModel(0.5, np.full((len(LABELERS), 2, 3), 1 / 3), np.zeros(width))
    keys, n = np.array(got.key.tolist(), int), got.n.to_numpy(float)
    vote, feats = keys[:, : len(LABELERS)], keys[:, len(LABELERS) :]
    # base spans stay whatever the model says, and their votes would tell them from all candidates: they don't count
    n = np.where(vote[:, 0] == 1, 0.0, n)
    patterns, which = np.unique(vote, axis=0, return_inverse=True)
    prior, rel, chance = expectation_maximisation(patterns, np.bincount(which.ravel(), n))
    x, y, b = _inputs(feats), chance[which.ravel()], np.zeros(width)
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (n * q * (1 - q))[:, None]).T @ x + np.eye(width)
        b += np.clip(np.linalg.solve(h, x.T @ (n * (y - q)) - b), -3, 3)
    return PiiModel(prior, rel, b)


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def spans_of(text: str | None, model: PiiModel):
    base = base_spans(text) if text else []
    loose = candidates(text, base) if text else []
    more = [s for s in loose if model.keep(text, s)]
    return base, sorted(base + more, key=lambda s: (s[1], _ORDER[s[0]])), len(loose) - len(more)


MORE = ("n_spans", "n_secret", "n_added", "n_rejected")


def find(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per row: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base
    spans, spans (all of them), with code point offsets and exclusive ends, n_spans (their number), n_secret (secrets
    among them), n_added (what the method adds to the base) and n_rejected (candidates that it doesn't).

    Null texts are empty and have no spans; texts of any length are read whole; of spans that start together the kind
    listed first comes first; null ids stay, repeated rows are treated alike, other columns are ignored. An empty table
    gives an empty result."""
    model = model or train(docs)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                got = [spans_of(t, model) for t in part.column(1).to_pylist()]
                count = lambda f: pa.array([f(*g) for g in got], pa.int64())
                more = [count(lambda b, s, r: len(s)), count(lambda b, s, r: sum(x[0] == "secret" for x in s)), count(lambda b, s, r: len(s) - len(b)), count(lambda b, s, r: r)]
                counts = [pa.array([sum(s[0] == k for s in base) for base, _, _ in got], pa.int64()) for k in KINDS]
                digest = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _, _ in got]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(digest), pa.array([_joined(s) for _, s, _ in got]), *more], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", *MORE])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, " + ", ".join(f"{m} long" for m in MORE))


def redact(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """docs with every span of `text` replaced by its kind in angle brackets; all columns and rows stay, null texts
    too, repeated rows fare alike; an empty table stays empty."""
    model = model or train(docs)
    at = docs.columns.index("text")

    def clean(text):
        if not text:
            return text
        out, last = [], 0
        for k, s, e in spans_of(text, model)[1]:
            if s >= last:
                out += [text[last:s], f"<{k}>"]
            last = max(last, e)
        return "".join([*out, text[last:]])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                yield part.set_column(at, part.schema.field(at), pa.array([clean(t) for t in part.column(at).to_pylist()], part.schema.field(at).type))

    return same_columns(docs, run)
