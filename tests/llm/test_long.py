"""Texts made to be slow: places that look far ahead, and hits inside very many exceptions."""

import random
import time

import pytest

from swellframe.llm import html_text, toxicity
from tests.llm.test_llm import docs


def took(run):
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


@pytest.mark.parametrize("bit", ["<a ", '<a href="', "<a \">\"<a '>'", "<!--", "</ ", "<a <", "<select>", "<i>", "<b>x</b>", "<script>", "<td>", "<!", "<video>x"])
def test_html_linear(bit):
    """Twenty times the page takes about twenty times as long."""
    short, long = (took(lambda k=k: html_text.leaf_blocks(bit * (k // len(bit)))) for k in (50_000, 1_000_000))
    assert long < 30 and long < 80 * short + 1


def plain_end(page, at):
    """The `>` outside quotes after a place, found sign by sign."""
    quote = None
    for i in range(at, len(page)):
        c = page[i]
        if quote is None and c == ">":
            return i
        if quote is None and c in "\"'":
            if c not in page[i + 1 :]:
                return -1
            quote = c
        elif c == quote:
            quote = None
    return -1


def test_html_tag_ends():
    rng = random.Random(8)
    for _ in range(400):
        page = "".join(rng.choice("\"'>ax ") for _ in range(rng.randrange(1, 40)))
        source = html_text._Source(page)
        quote_free = [at for at in range(len(page))]
        assert [source._far(at) for at in quote_free] == [plain_end(page, at) for at in quote_free], page


def test_toxicity_linear():
    match = toxicity.ToxicityModel({"trash": 2.0, " can ": 1.0}, list(toxicity.EXCEPTIONS)).matcher()
    assert match("trash can " * 300_000) == (0, 600_000, [])
    assert took(lambda: match("trash can " * 1_000_000)) < 40
    rng = random.Random(1)
    for _ in range(300):
        places = sorted(rng.sample(range(60), rng.randrange(10)))
        ranges = sorted((a, a + rng.randrange(1, 9)) for a in rng.sample(range(60), rng.randrange(8)))
        assert toxicity._outside(places, ranges) == [p for p in places if not any(a <= p < b for a, b in ranges)]


def test_toxicity_rows(spark):
    """Every labelled row of its own text is learned from, near copies too; equal texts, and rows of one id, count once."""
    texts = [f"common words of a text badword{i % 2} number{i}" for i in range(12)] + ["calm and plain words here now"] * 3 + [f"calm words {i} of peace" for i in range(12)]
    table = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i < 12)) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    once = toxicity.train(table, labels)
    again = toxicity.train(table.union(table), labels)
    assert (once.lexicon, once.exceptions) == (again.lexicon, again.exceptions) and once.lexicon and again.curve == pytest.approx(once.curve)
    mixed = table.union(docs(spark, ["other text"] * 5)).union(docs(spark, [f"varied {k}" for k in range(5)]))
    assert toxicity.train(mixed, labels).lexicon  # ids 0 to 4 have several texts
