"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between tags of block elements, with white space folded and character
references decoded. Each block has features of its ancestors (tags, words of class, id and role), of its text (length,
link share, ending, signs) and of its place. The field, with states "main" and "other", is trained on labelled pages by
its exact gradient (forward-backward) and decoded by Viterbi; blocks decoded as main are joined by two newlines.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)")
_INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_SIGNS = re.compile(r"[>\"']")
#: Characters in which a tag's end is looked for before the page is gone through for all ends at once.
_NEAR = 1 << 8
_ATTRIBUTE = re.compile(r"(?i)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[a-z]+")

#: Elements whose text is no text of the page.
SILENT = frozenset(("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "math", "select", "title", "canvas", "audio", "video"))
#: Of these, the ones whose content is no markup: it reaches to the next end tag of the name.
RAW = frozenset(("script", "style", "textarea", "title", "iframe"))
#: Of these, the ones that never hold one of their own kind.
_ONCE = frozenset(("iframe", "noscript", "select", "canvas", "audio", "video"))
_OPENS = {t: re.compile(rf"<{t}(?=[\s/>])", re.I | re.A) for t in _ONCE}
_ENDS = {t: re.compile(rf"</{t}(?:(?=[\s/>])[^>]*+>?|\Z)", re.I | re.A) for t in SILENT}
#: Elements that break the text into blocks.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Open elements that a new one of the kind closes.
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_LISTS = frozenset(("ul", "ol", "dl", "table", "tbody", "thead", "div", "section", "article", "nav", "aside", "body", "html", "main", "footer", "header", "form", "menu"))


class _Source:
    """A page's tokens. A tag ends at the first `>` outside quotes, or, if there is none, at the first one of any kind;
    without one either, its `<` is text. Each look-up that could reach far is answered from one pass over the page."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.starts: list[int] | None = None

    def _far(self, at: int) -> int:
        """Where the `>` outside quotes after `at`, itself outside, stands; -1 if nowhere."""
        if self.starts is None:
            # from the end of the page: a quote leads on behind the next one of its kind
            signs = [(m.start(), m[0]) for m in _SIGNS.finditer(self.page)]
            found, after = -1, {'"': -1, "'": -1}
            follow = [-1] * len(signs)
            for i in range(len(signs) - 1, -1, -1):
                place, sign = signs[i]
                if sign == ">":
                    found = place
                else:
                    pair = after[sign]
                    found = follow[pair + 1] if -1 < pair < len(signs) - 1 else -1
                    after[sign] = i
                follow[i] = found
            self.starts, self.follow = [x for x, _ in signs], follow
        i = bisect_left(self.starts, at)
        return self.follow[i] if i < len(self.follow) else -1

    def token(self, at: int) -> tuple[int, str | None, bool, str]:
        """(end, tag, whether it closes, attributes) of the token at a place; without a tag it is text if the last is
        its text, and markup to skip if that is empty."""
        page = self.page
        if page[at] != "<":
            end = page.find("<", at)
            end = len(page) if end < 0 else end
            return end, None, False, page[at:end]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return len(page) if end < 0 else end + 3, None, False, ""
        if at < self.last:
            name = _NAME.match(page, at)
            if name:
                inside = _INSIDE.match(page, name.end(), name.end() + _NEAR)
                end = inside.end() - 1 if inside else self._far(name.end())
                if end < 0:
                    end = page.find(">", name.end())
                return end + 1, name[2].lower(), bool(name[1]), page[name.end() : end]
            if page[at + 1] in "!?/":
                return page.find(">", at) + 1, None, False, ""
        return at + 1, None, False, "<"


@dataclass
class Block:
    text: str
    tag: str
    above: tuple[str, ...]  # features of the ancestors
    linked: int  # characters inside links


def leaf_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a whole page, in order.

    Silent elements are raw, and end at the next end tag of their name whatever stands before it, or are ancestors
    like others, which also end where an element around them does (svg and math at a block within them, too). One
    that has no end tag before the next of its kind, or before the end of the page, is taken as empty; only script
    and style then reach to the end of the page."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # tags, each with the features of all elements down to it
    opened: Counter[str] = Counter()
    within: list[str] = []  # the open block elements
    text: list[str] = []
    linked = links = at = 0
    quiet = None  # place in the stack of the outermost silent element
    source = page or ""
    tokens = _Source(source)
    ends: dict[str, re.Match | None] = {}

    def flush():
        nonlocal linked
        if text:
            own = " ".join(html.unescape("".join(text)).split())
            if own:
                above = stack[-1][1] if stack else ()
                tag = within[-1] if within else "body"
                out.append(Block(own, tag, above, linked))
            text.clear()
            linked = 0

    def push(tag, features):
        above = stack[-1][1] if stack else ()
        new = tuple(dict.fromkeys(f for f in features if f not in above))
        stack.append((tag, above + new if new else above))
        opened[tag] += 1
        if tag in BLOCKS:
            within.append(tag)

    def pop():
        nonlocal quiet
        tag = stack.pop()[0]
        opened[tag] -= 1
        if tag in BLOCKS:
            within.pop()
        if quiet == len(stack):
            quiet = None
        return tag

    def end_ahead(tag):
        if tag not in ends or ends[tag] and ends[tag].start() < at:
            ends[tag] = _ENDS[tag].search(source, at)
        end = ends[tag]
        return None if end and tag in _ONCE and _OPENS[tag].search(source, at, end.start()) else end

    while at < len(source):
        at, tag, closing, attributes = tokens.token(at)
        if tag is None:
            if quiet is None and attributes:
                text.append(attributes)
                linked += len(attributes) * (links > 0)
            continue
        if closing:
            if quiet is not None:
                if not opened[tag]:
                    continue
                while quiet is not None and stack[-1][0] != tag:
                    pop()
                if quiet is not None:
                    pop()
                    continue
            if tag in BLOCKS:
                flush()
            if tag == "a":
                links = max(0, links - 1)
            if opened[tag]:
                while pop() != tag:
                    pass
            continue
        empty = attributes.endswith("/")
        if tag in SILENT:
            end = None if empty else end_ahead(tag)
            if tag in RAW:
                if end or not empty and tag in ("script", "style"):
                    at = end.end() if end else len(source)
            elif end:
                push(tag, ())
                quiet = len(stack) - 1 if quiet is None else quiet
            continue
        if quiet is not None:
            if tag in BLOCKS and stack[quiet][0] in ("svg", "math") and not (opened["foreignobject"] or opened["desc"] or opened["annotation-xml"]):
                while quiet is not None:
                    pop()
            else:
                if tag not in VOID and not empty:
                    push(tag, ())
                continue
        if tag in BLOCKS:
            flush()
            links = 0
            shut = _CLOSES.get(tag, {"p"} if tag not in ("button", "label") else set())
            while stack and (stack[-1][0] in shut or stack[-1][0] not in BLOCKS and any(t in shut for t, _ in stack[-4:])) and stack[-1][0] not in _LISTS:
                pop()
        elif tag == "br":
            text.append(" ")
        if tag == "a":
            links += 1
        if tag not in VOID:
            named = [tag]
            for a in _ATTRIBUTE.finditer(attributes):
                named += ["." + w for w in _WORD.findall((a[2] or a[3] or a[4] or "").lower())]
            push(tag, tuple(named))
    while quiet is not None:
        pop()
    flush()
    return out


#: Words of notices and legal lines, looked for in the whole block.
PHRASES = {
    "rights": ("©", "copyright", "all rights reserved", "terms of use", "privacy policy", "impressum"),
    "notice": ("cookie", "consent", "gdpr", "we value your privacy"),
    "offer": ("subscribe", "sign up", "newsletter", "log in", "sponsored", "advertisement"),
}

WIDTH = 1 << 13


def _hashed(name: str) -> int:
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % WIDTH


_slot = lru_cache(1 << 15)(_hashed)


def block_features(blocks: list[Block]) -> list[list[int]]:
    """Feature slots of each block."""
    out = []
    n = len(blocks)
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        names = ["bias", "tag=" + b.tag, f"words={min(words.bit_length(), 8)}", f"links={min(4, 5 * b.linked // max(1, len(b.text)))}", f"end={b.text[-1] if b.text[-1] in '.!?:;,|' else 'other'}", f"long={words > 25}"]
        names += ["up=" + a for a in b.above]
        names.append(f"first={i == 0}")
        names.append(f"last={i == n - 1}")
        if n == 1:
            names.append("alone")
        low, size = b.text.lower(), "long" if words > 25 else "in" if "article" in b.above or "main" in b.above else "short"
        names += [f"{kind}={size}" for kind, signs in PHRASES.items() if any(x in low for x in signs)]
        out.append([_slot(x) for x in names])
    return out


@dataclass
class Field:
    """Weights of features (slot, state), of transitions and of first states; state 1 is main."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray

    def potentials(self, feats: list[list[int]]) -> np.ndarray:
        sizes = np.array([len(f) for f in feats])
        return np.add.reduceat(self.emit[np.concatenate([np.array(f) for f in feats])], np.cumsum(sizes) - sizes, axis=0)

    def decode(self, feats: list[list[int]]) -> np.ndarray:
        """The most probable states, by Viterbi; of equal paths the one of lower states."""
        e = self.potentials(feats).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        x, y = self.first[0] + e[0][0], self.first[1] + e[0][1]
        back = []
        for p, q in e[1:]:
            to0, to1 = int(y + s10 > x + s00), int(y + s11 > x + s01)
            back.append((to0, to1))
            x, y = max(x + s00, y + s10) + p, max(x + s01, y + s11) + q
        out = [int(y > x)]
        for b in reversed(back):
            out.append(b[out[-1]])
        return np.array(out[::-1])


def likeliest(field: Field, feats: list[list[int]], allowed: list[int]) -> int:
    """Which of the allowed blocks is main on the most probable path that has one of them as main."""
    e = field.potentials(feats)
    ahead, behind = [field.first + e[0]], [np.zeros(2)]
    for x in e[1:]:
        ahead.append((ahead[-1][:, None] + field.step).max(axis=0) + x)
    for x in e[:0:-1]:
        behind.append((field.step + (x + behind[-1])[None]).max(axis=1))
    return max(allowed, key=lambda i: ahead[i][1] + behind[len(e) - 1 - i][1])


def main_states(blocks: list[Block], field: Field) -> np.ndarray:
    """States of a page's blocks. A page whose every block looks like another thing may still have a text: then the
    likeliest one of the blocks of eight words or more, mostly outside links and without a notice's words, is main."""
    feats = block_features(blocks)
    states = field.decode(feats)
    if not states.any():
        prose = [i for i, b in enumerate(blocks) if b.text.count(" ") >= 7 and 2 * b.linked < len(b.text) and not any(x in b.text.lower() for signs in PHRASES.values() for x in signs)]
        if prose:
            states[likeliest(field, feats, prose)] = 1
    return states


def _gradient(field: Field, feats, states):
    """Gradient of the log likelihood of one labelled sequence: as for each block (2,), steps (2, 2), first (2,)."""
    e = field.potentials(feats)
    n = len(e)
    a, b = np.empty((n, 2)), np.zeros((n, 2))
    a[0] = field.first + e[0]
    for i in range(1, n):
        a[i] = np.logaddexp(a[i - 1, 0] + field.step[0], a[i - 1, 1] + field.step[1]) + e[i]
    for i in range(n - 2, -1, -1):
        x = b[i + 1] + e[i + 1]
        b[i] = np.logaddexp(field.step[:, 0] + x[0], field.step[:, 1] + x[1])
    z = np.logaddexp(*a[-1])
    node = -np.exp(a + b - z)
    node[np.arange(n), states] += 1
    step = np.zeros((2, 2))
    for i in range(1, n):
        step -= np.exp(a[i - 1][:, None] + field.step + (e[i] + b[i])[None] - z)
        step[states[i - 1], states[i]] += 1
    first = -np.exp(a[0] + b[0] - z)
    first[states[0]] += 1
    return node, step, first


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Labelled pages (blocks, states) -> the field, by gradient steps page after page with Adagrad rates."""
    field = Field(np.zeros((WIDTH, 2)), np.zeros((2, 2)), np.zeros(2))
    g_emit, g_step, g_first = np.full((WIDTH, 2), 1e-2), np.full((2, 2), 1e-2), np.full(2, 1e-2)
    data = [(block_features(b), np.array(s)) for b, s in pages if b]
    rng = random.Random(11)
    for _ in range(epochs):
        rng.shuffle(data)
        for feats, states in data:
            node, step, first = _gradient(field, feats, states)
            at = np.concatenate([np.array(f) for f in feats])
            rows = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
            grad = np.zeros_like(field.emit)
            np.add.at(grad, at, node[rows])
            used = np.unique(at)
            g = grad[used] - decay * field.emit[used]
            g_emit[used] += g * g
            field.emit[used] += rate * g / np.sqrt(g_emit[used])
            g_step += step * step
            field.step += rate * step / np.sqrt(g_step)
            g_first += first * first
            field.first += rate * first / np.sqrt(g_first)
    return field


#: Wrappers of the parts of the labelled pages; {} stands for their blocks.
MAIN_SHELLS = ('<article>{}</article>', '<main>{}</main>', '<main><article>{}</article></main>', '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<div class="post-body entry-content">{}</div>', '<section class="article">{}</section>', '<div class="story">{}</div>', '<article class="post">{}</article>', '<div>{}</div>')
OTHER_SHELLS = (
    '<nav>{}</nav>', '<nav class="menu">{}</nav>', '<header>{}</header>', '<header class="site-header">{}</header>', '<footer>{}</footer>', '<div class="footer">{}</div>', '<aside>{}</aside>', '<aside class="sidebar">{}</aside>', '<div id="sidebar">{}</div>',
    '<div class="ad">{}</div>', '<div class="ads banner">{}</div>', '<div class="advert">{}</div>', '<section class="sponsored promo">{}</section>', '<div class="cookie-notice">{}</div>', '<div role="dialog" class="consent">{}</div>', '<div class="notice">{}</div>', '<div class="newsletter subscribe">{}</div>', '<form>{}</form>',
    '<form class="search">{}</form>', '<section class="comments">{}</section>', '<div id="comments">{}</div>', '<ol class="comment-list">{}</ol>', '<div class="comment">{}</div>', '<div class="related">{}</div>', '<div class="share social">{}</div>', '<ul class="breadcrumb">{}</ul>', '<div class="menu">{}</div>', '<div class="widget">{}</div>', '<div role="navigation">{}</div>', '<div class="alert">{}</div>',
)


#: Lines of notices, legal lines and offers for the labelled pages.
NOTICES = (
    "We use cookies to improve this site.", "This site asks for your consent to cookies.", "Accept all cookies", "We value your privacy.", "\u00a9 2021 {}. All rights reserved.", "Copyright {} and others", "Terms of use | Privacy policy", "Subscribe to our newsletter", "Sign up for news about {}", "Log in to comment",
    "Sponsored: {}", "Advertisement", "Share this {}", "Read more about {}", "{} replied: {}", "Posted by {}",
)


def labelled_pages(n: int = 1000, seed: int = 3) -> list[tuple[list[Block], list[int]]]:
    """Training pages put together from the shells above with random words; main blocks are known by a mark that is
    taken off again before training. Advertisements, notices and comments also stand inside the main part; some pages
    have one block, no wrapper around the main part, or nothing but it, and articles also speak of cookies and news."""
    rng = random.Random(seed)
    mark = "\u2063"

    def words(a, b):
        return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(a, b)))

    def notice():
        return rng.choice(NOTICES).replace("{}", words(1, 3))

    def prose(main):
        p = (words(1, 4) if rng.random() < 0.25 else words(4, 80)).capitalize()
        if main and rng.random() < 0.12:  # an article may speak of such things
            p += " " + rng.choice(("cookies", "a newsletter", "their consent", "copyright", "who subscribe")) + " " + words(14, 60)
        return f"<p>{mark if main else ''}{p}" + rng.choice([".", ".", ".", ".", "?", "!", ""]) + ("</p>" if rng.random() < 0.9 else "")

    def block(main):
        m, r = mark if main else "", rng.random()
        if r < 0.72:
            return prose(main)
        if r < 0.8:
            return f"<h{rng.randint(2, 4)}>{m}{words(1, 8)}</h{rng.randint(2, 4)}>"
        if r < 0.86:
            return "<ul>" + "".join(f"<li>{m}{words(2, 20)}.</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if r < 0.9:
            return f"<blockquote>{m}{words(5, 40)}.</blockquote>"
        if r < 0.94:
            return f"<p>{m}{words(3, 10)} <a href='/x'>{words(1, 4)}</a> {words(2, 30)}.</p>"
        if r < 0.965:
            return "<table>" + "".join(f"<tr><td>{m}{words(1, 3)}</td><td>{m}{words(1, 3)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        return rng.choice((f"<pre>{m}{words(3, 30)}</pre>", f"<div>{m}{words(3, 60)}.</div>"))

    def other():
        shell, r = rng.choice(OTHER_SHELLS), rng.random()
        if r < 0.3:
            inner = "<ul>" + "".join(f"<li><a href='/{i}'>{words(1, 3)}</a></li>" for i in range(rng.randint(2, 8))) + "</ul>"
        elif r < 0.62:
            inner = "".join(block(False) for _ in range(rng.randint(1, 4)))
        elif r < 0.74:
            inner = words(2, 40)
        else:
            return (shell if rng.random() < 0.4 else rng.choice(('<div>{}</div>', '<p>{}</p>', '<section>{}</section>'))).format(notice())
        return shell.format(inner)

    out = []
    for _ in range(n):
        kind = rng.random()
        inner = [f"<h1>{mark}{words(3, 12)}</h1>"] if rng.random() < (0.9 if kind > 0.3 else 0.3) else []
        shell = "{}" if kind < 0.12 or rng.random() < 0.06 else rng.choice(MAIN_SHELLS)
        if kind > 0.86:  # text right inside the main part's element
            inner = [f"{mark}{words(12, 80)}."]
        for _ in range(1 if kind < 0.06 else rng.randint(1, 12)):
            if ("<article" in shell or "<main" in shell) and rng.random() < 0.05:
                inner.append(f"<p>{mark}{notice()}</p>")
            inner.append(block(True) if kind > 0.02 else f"<div>{mark}{words(2, 30)}</div>")
            if rng.random() < 0.08 and kind > 0.3:
                inner.append(other())
        before, after = (0, 0) if kind < 0.2 else (rng.randint(0, 4), rng.randint(0, 4))
        parts = [other() for _ in range(before)] + [shell.format("".join(inner))] + [other() for _ in range(after)]
        blocks = leaf_blocks("<html><body>" + "".join(parts) + rng.choice(["</body></html>", ""]))
        states = [int(mark in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(mark, "") or "x"
        out.append((blocks, states))
    return out


@lru_cache(1)
def trained() -> Field:
    return train(labelled_pages())


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page)
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, s in zip(blocks, main_states(blocks, field), strict=True) if s)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """pages (page_id, url, html, ...) -> one row per row: page_id, url, text (main blocks joined by two newlines,
    empty if none), n_chars (its code points).

    Null html is empty; repeated rows are treated alike; pages of any length are read whole and nothing is cut off;
    other columns, and null ids and addresses, make no difference. An empty table gives an empty result."""
    field = field or trained()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = [main_text(h, field) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
