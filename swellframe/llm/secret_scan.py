"""Secret scans by a trigram inverted index, in DataFrame functions only.

Every rule's regular expression is turned into a Boolean query over trigrams that any match must hold. Texts are known
by a hash, so copies share their postings; a posting list holds, sorted, the texts of one block of hashes that contain
one trigram, so no list outgrows its block. The lists of a block are intersected and united as the rules' queries say,
and what is left, a text and the rules that may match in it, meets the documents again: only there the expressions
run. Rules whose query is always true, as they lack a mandatory trigram, scan every text. Postings of trigrams that no
rule asks for would never be read and are not written unless they are asked for (`build_index`).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from re import _constants as rx
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swellframe.llm.common import cut

#: Texts to a block of the index at most, on average.
BLOCK_TEXTS = 4_096
#: Strings that a part of an expression may stand for before it counts as any of many.
CHOICES = 48


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` (Java's and Python's common syntax) whose `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed patterns of the base kinds. Runs of 24 hex digits or more are the runs of any length that have 24.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24),
)
#: Published forms of keys of well-known services, and keys and passwords in files and addresses.
MORE = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]+-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("login", r"://[^\x00-\x20/:@\"'<>]++:[^\x00-\x20/:@\"'<>]++@[A-Za-z0-9]"),
)
RULES = BASE + MORE


# -- Boolean trigram queries: True, a trigram, or ("and" | "or", the parts) --


def _both(kind: str, parts: Iterable) -> object:
    flat = set()
    for p in parts:
        flat |= p[1] if isinstance(p, tuple) and p[0] == kind else {p}
    if kind == "or" and True in flat:
        return True
    flat.discard(True)
    held = {p: p[1] if isinstance(p, tuple) else frozenset([p]) for p in flat}
    if kind == "and":  # a disjunction with a part that must hold anyway says nothing
        flat = {p for p in flat if not (isinstance(p, tuple) and p[1] & (flat - {p}))}
    else:  # neither does a part that asks for all that another asks for, and more
        flat = {p for p in flat if not any(held[q] < held[p] for q in flat)}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def _all_of(*parts):
    return _both("and", parts)


def _grams(strings: set[str]):
    """What holds if a text contains one of the strings."""
    if not strings or min(map(len, strings)) < 3:
        return True
    return _both("or", (_all_of(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings))


@dataclass(frozen=True)
class _Part:
    """What a part of an expression matches: exactly one of `exact`, or something that begins and ends with one of
    `first` and `last` and for which `query` holds."""

    exact: frozenset | None
    first: frozenset
    last: frozenset
    query: object = True

    def loose(self) -> _Part:
        if self.exact is None:
            return self
        return _Part(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), _grams(set(self.exact)))


def _exactly(strings: Iterable[str]) -> _Part:
    s = frozenset(strings)
    return _Part(s, s, s)


_NOTHING, _ANYTHING = _exactly([""]), _Part(None, frozenset([""]), frozenset([""]))


def _then(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= CHOICES:
        return _exactly(x + y for x in a.exact for y in b.exact)
    heads, tails = a.exact or a.first, b.exact or b.last
    across = {x + y for x in (a.exact or a.last) for y in (b.exact or b.first)}
    first = {x + y for x in heads for y in b.first} if a.exact is not None else heads
    last = {x + y for x in a.last for y in tails} if b.exact is not None else tails
    query = _all_of(a.loose().query, b.loose().query, *(_grams(x) for x in (across, first, last)))
    return _Part(None, frozenset(x[:2] for x in first), frozenset(x[-2:] for x in last), query)


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts) and len(union := frozenset().union(*(p.exact for p in parts))) <= CHOICES:
        return _exactly(union)
    parts = [p.loose() for p in parts]
    return _Part(None, frozenset().union(*(p.first for p in parts)), frozenset().union(*(p.last for p in parts)), _both("or", (p.query for p in parts)))


def _class(items) -> _Part:
    chars: set[int] = set()
    for op, value in items:
        if op is rx.LITERAL:
            chars.add(value)
        elif op is rx.RANGE and value[1] < 128:
            chars.update(range(value[0], value[1] + 1))
        else:
            return _ANYTHING
    low = {chr(c).lower() for c in chars}
    return _exactly(low) if len(low) <= 8 and max(chars) < 128 else _ANYTHING


def _read(nodes) -> _Part:
    out = _NOTHING
    for op, value in nodes:
        if op is rx.LITERAL:
            part = _exactly([chr(value).lower()]) if value < 128 else _ANYTHING
        elif op is rx.IN:
            part = _class(value)
        elif op is rx.BRANCH:
            part = _either([_read(x) for x in value[1]])
        elif op is rx.SUBPATTERN:
            part = _read(value[3])
        elif op is rx.ATOMIC_GROUP:
            part = _read(value)
        elif op in (rx.MAX_REPEAT, rx.MIN_REPEAT, rx.POSSESSIVE_REPEAT):
            least, most, body = value
            inner = _read(body)
            if least == 0:
                part = _either([inner, _NOTHING]) if most == 1 else _ANYTHING
            else:
                part = inner if most == 1 else inner.loose()
        elif op in (rx.AT, rx.ASSERT, rx.ASSERT_NOT):
            part = _NOTHING
        else:
            part = _ANYTHING
        out = _then(out, part)
    return out


def trigram_query(pattern: str):
    """The Boolean query over trigrams of plain signs, letters lowered, that holds for every text with a match; True if there is none."""
    return _read(_parser.parse(pattern)).loose().query


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(p) for p in query[1]))


# -- The index --


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once, not wherever a later expression names it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def build_index(docs: DataFrame, grams: Iterable[str] | None = None, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """docs (text, ...) -> (block, gram, keys): the sorted hashes of the block's texts that hold the trigram once their
    letters are lowered; of all trigrams, or of `grams` only. Null and short texts have no trigrams, equal texts are one; an empty table has
    an empty index. Texts are taken whole."""
    blocks = max(1, -(-docs.count() // block_texts))
    low = _once(docs.select(_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text")), "low", F.lower("text"))
    if grams is None:
        held = F.array_distinct(F.regexp_extract_all("low", F.lit("(?s)(?=(...))"), F.lit(1)))
    else:
        held = F.filter(F.array(*map(F.lit, sorted(set(grams)))).cast("array<string>"), lambda g: F.contains("low", g))
    seen = low.select("key", F.explode(held).alias("gram"))
    return seen.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "gram").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def _answer(query) -> Column:
    """A query's texts in one block, from `lists`, the block's posting lists by trigram."""
    if isinstance(query, str):
        return F.coalesce(F.try_element_at("lists", F.lit(query)), F.array().cast("array<bigint>"))
    parts = [_answer(p) for p in sorted(query[1], key=str)]
    return reduce(F.array_intersect if query[0] == "and" else F.array_union, parts)


def candidates(index: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """(key, rules): the texts for which the trigram query of a rule holds, with a bit set for each such rule."""
    asked = [(k, trigram_query(r.pattern)) for k, r in enumerate(rules)]
    asked = [(k, q) for k, q in asked if q is not True]
    if not asked:
        return index.select(F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("rules")).limit(0)
    read = index.where(F.col("gram").isin(sorted(set().union(*(trigrams_of(q) for _, q in asked)))))
    blocks = read.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("lists"))

    def marked(k, q):
        return F.transform(_answer(q), lambda key: F.struct(key.alias("key"), F.lit(1 << k).cast("bigint").alias("rule")))

    found = F.concat(*[marked(k, q) for k, q in asked])
    return blocks.select(F.inline(found)).groupBy("key").agg(F.bit_or("rule").alias("rules"))


# -- Verification --


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("bigint"), lambda s, v: s + v)


def _most(x: Column) -> Column:
    return F.coalesce(F.array_max(x), F.lit(0).cast("bigint"))


def _running(rows: DataFrame, column: str, name: str, total=_sum, plus=lambda a, b: a + b) -> DataFrame:
    """Adds, for every element of an array of longs, the total of those before it. Arrays have no running totals, so it
    goes in chunks of about the root of their number."""
    before = lambda x: F.transform(x, lambda _, i: total(F.slice(x, 1, i)))
    w, x = F.col("_w"), F.col(column)
    rows = _once(rows, "_w", F.greatest(F.ceil(F.sqrt(F.size(x))), F.lit(1)).cast("int"))
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / w).cast("int") - 1), lambda b: F.slice(x, b * w + 1, w))
    rows = _once(rows, "_c", F.when(F.size(x) > 0, chunks).otherwise(F.array().cast("array<array<bigint>>")))
    rows = _once(rows, "_t", F.transform("_c", total))
    rows = _once(rows, "_h", before(F.col("_t")))
    return _once(rows, name, F.flatten(F.zip_with("_c", "_h", lambda c, h: F.transform(before(c), lambda s: plus(s, h))))).drop("_w", "_c", "_t", "_h")


def _matched(rows: DataFrame, k: int, r: Rule, may: Column) -> DataFrame:
    """Adds the spans of rule k, as s{k}, in the rows where it may match: a match starts where the lengths of all
    matches before it, and of all that stands between them, end."""
    text, pattern, m = F.col("text"), F.lit(r.pattern), F.col("m")
    rows = _once(rows, "m", F.when(may, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.array().cast("array<string>")))
    measured = F.regexp_extract_all(text, pattern, F.lit(r.group)) if r.group else m
    before = F.transform(F.slice(F.split(text, r.pattern, -1), 1, F.size(m)), F.char_length)
    both = F.arrays_zip(before.alias("gap"), F.transform(m, F.char_length).alias("n"), F.transform(measured, lambda x: F.char_length(x) >= r.least).alias("kept"))
    rows = _once(rows, "g", F.when(F.size("m") > 0, both).otherwise(F.array().cast("array<struct<gap: int, n: int, kept: boolean>>"))).drop("m")
    rows = _once(rows, "d", F.transform("g", lambda g: (g["gap"] + g["n"]).cast("bigint")))
    rows = _running(rows, "d", "b").drop("d")
    at = F.zip_with("b", "g", lambda b, g: F.struct((b + g["gap"]).alias("start"), F.lit(k).alias("rule"), (b + g["gap"] + g["n"]).alias("end"), g["kept"].alias("kept")))
    return _once(rows, f"s{k}", F.filter(at, lambda x: x["kept"])).drop("g", "b")


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, most: int = 1_000_000, salt: int = 32) -> DataFrame:
    """One row per row of docs (doc_id, text, ...): doc_id and spans, an array of (start, kind, end) in code points, end
    exclusive, by start and then by the order of the rules.

    Each rule's matches are leftmost and don't overlap; those that are too short are dropped and not tried again.
    Matches of different rules may overlap. Null and empty texts have no spans; repeated rows are searched each; null
    ids stay; texts of any length are searched whole; other columns are ignored; an empty table gives an empty result.
    Candidates are broadcast while they number at most `most` (16 bytes each); beyond that documents meet them in a
    shuffle, in `salt` parts a text, as one text may fill a third of the rows."""
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = set().union(*map(trigrams_of, asked.values()))
    found = cut(candidates(build_index(docs.select("text"), grams), rules), "secret-candidates") if grams else None
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if found is None:
        rows = rows.withColumn("rules", F.lit(0).cast("bigint"))
    elif found.count() <= most:
        rows = rows.withColumn("key", _key(F.col("text"))).join(F.broadcast(found), "key", "left")
    else:
        rows = rows.withColumn("key", _key(F.col("text"))).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salt)))
        rows = rows.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salt - 1).cast("bigint")))), ["key", "salt"], "left")
    out = rows.select("doc_id", "text", F.coalesce("rules", F.lit(0).cast("bigint")).alias("rules"))
    for k, r in enumerate(rules):
        may = F.lit(True) if asked[r.kind] is True else F.col("rules").bitwiseAND(F.lit(1 << k).cast("bigint")) != 0
        out = _matched(out, k, r, may)
    spans = [F.col(f"s{k}") for k in range(len(rules))]
    out = _once(out.drop("text"), "all", F.array_sort(F.concat(*spans)))
    names = F.array(*[F.lit(r.kind) for r in rules])
    return out.select("doc_id", F.transform("all", lambda x: F.struct(x["start"].alias("start"), F.element_at(names, x["rule"] + 1).alias("kind"), x["end"].alias("end"))).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """One row per row of docs: doc_id and text with every span, or run of overlapping spans, replaced by `mark`; null texts stay
    null. The cases are those of `find`."""
    here = docs.select(F.struct("doc_id", "text").alias("doc_id"), "text")
    found = _once(_once(find(here, rules), "text", F.col("doc_id.text")), "ends", F.transform("spans", lambda x: x["end"]))
    # a span that no earlier one reaches begins a run; what stays before it begins where the furthest of them ends
    found = _running(found, "ends", "far", _most, F.greatest)
    heads = F.zip_with("spans", "far", lambda x, far: F.struct(x["start"].alias("start"), far.alias("end")))
    found = _once(found, "heads", F.filter(heads, lambda x, i: (i == 0) | (x["start"] >= x["end"])))
    clean = F.transform("heads", lambda h: F.substring("text", (h["end"] + 1).cast("int"), (h["start"] - h["end"]).cast("int")))
    last = F.expr("substring(text, cast(array_max(ends) + 1 as int))")
    done = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.concat(F.array_join(clean, mark), F.lit(mark), last))
    return found.select(F.col("doc_id.doc_id").alias("doc_id"), done.alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added; the cases are those of
    `find`, whose spans are written as kind:start:end."""
    found = find(docs, RULES)
    base = [r.kind for r in BASE]
    written = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *map(count, base), F.sha2(written(own), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), (F.size("spans") - F.size(own)).cast("long").alias("n_added"))


#: The rules' patterns in RE2's syntax, with the group that is measured and its least length.
_PATTERNS = {
    "assign": (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
    "github": ("gh[oprsu]_[A-Za-z0-9]{36,}", 0, 1),
    "slack": ("xox[abeprs]-[A-Za-z0-9-]{10,}", 0, 1),
    "google": ("AIza[A-Za-z0-9_-]{35}", 0, 1),
    "stripe": ("[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]+-----END [A-Z ]*PRIVATE KEY-----", 0, 1),
    "login": (r"""://[^\x00-\x20/:@"''<>]+:[^\x00-\x20/:@"''<>]+@[A-Za-z0-9]""", 0, 1),
}


def _oracle() -> str:
    arms = " UNION ALL ".join(
        f"SELECT r, '{kind}' AS kind, {k} AS rule, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS g, string_split_regex(t, '{p}') AS gap, {least} AS least FROM d"
        for k, (kind, (p, group, least)) in enumerate(_PATTERNS.items())
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({arms}),
x AS (SELECT r, kind, rule, least, unnest(m) AS m, unnest(g) AS g, unnest(gap[1:len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
s AS (SELECT r, kind, rule, m, g, least, sum(length(gap) + length(m)) OVER (PARTITION BY r, rule ORDER BY i) AS e FROM x),
k AS (SELECT r, kind, rule, CAST(e - length(m) AS BIGINT) AS b, concat(kind, ':', CAST(e - length(m) AS BIGINT), ':', CAST(e AS BIGINT)) AS span FROM s WHERE length(g) >= least),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (rule > 2) AS n_added,
             string_agg(span, ',' ORDER BY b, rule) FILTER (rule < 3) AS base, string_agg(span, ',' ORDER BY b, rule) AS spans FROM k GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added
FROM d LEFT JOIN a USING (r)
"""


ORACLE = _oracle()
