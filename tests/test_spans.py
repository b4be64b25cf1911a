"""Shared spans against brute force, and lines and gates of pages on literal cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import html
from lectern.operators import spans
from lectern.sources import boilerplate


def longest(a, b):
    """(first begin in a, length) of the longest common substring."""
    best = (0, 0)
    for i in range(len(a)):
        while i + best[1] < len(a) and a[i : i + best[1] + 1] in b:
            best = (i, best[1] + 1)
    return best


def test_longest_spans_against_brute_force():
    r = random.Random(3)
    for _ in range(400):
        a, b = ("".join(r.choices("ab é", k=r.randrange(0, 40))) for _ in range(2))
        begin, n = spans.Substrings(a).longest_in(b)
        assert (begin, n) == longest(a, b) or n == 0 == longest(a, b)[1]
    text = "ab" * 5000
    began = time.time()
    assert spans.Substrings(text).longest_in("b" + text + "c" + text) == (0, 10_000)
    assert spans.Substrings(text).longest_in("cc") == (0, 0) and time.time() - began < 5


def test_shared_spans_of_rows(spark):
    rows = [(1, "He said  The\nQuick brown fox", "the quick brown dog"), (2, "see https://a.example/the-quick-brown now", "https://a.example/the-quick-brown"), (3, None, "x"), (4, "short", "short"), (5, "", None), (6, "one two three, four five", "four five, one two three")]
    got = {r.k: (r.span, r.length) for r in spans.longest_shared(spark.createDataFrame(rows, "k int, a string, b string"), ["k"], F.col("a"), F.col("b")).collect()}
    assert got == {1: ("the quick brown ", 16), 2: ("", 0), 3: ("", 0), 4: ("", 0), 5: ("", 0), 6: ("one two three", 13)}


def test_lines_of_a_site(spark):
    """Counted once a page, on half of the newest pages and on two; a site of one page keeps all; order is kept."""
    pages = [("a", 1, "Home\n\nfirst\nHome"), ("a", 2, " Home \nsecond"), ("a", 3, "third\nAbout\nHome"), ("a", 4, None), ("b", 9, "Home\nonly"), (None, 5, "x\ny"), (None, 6, "y\nz")]
    frame = spark.createDataFrame(pages, "host string, page_id int, text string")
    again = boilerplate.repeated_lines(frame)
    assert sorted(map(str, again.collect())) == sorted(map(str, spark.createDataFrame([("a", "Home", 3), (None, "y", 2)], "host string, line string, on_pages long").collect()))
    got = {(r.host, r.page_id): r.text for r in boilerplate.without_repeated(frame, again).collect()}
    assert got == {("a", 1): "first", ("a", 2): "second", ("a", 3): "third\nAbout", ("a", 4): "", ("b", 9): "Home\nonly", (None, 5): "x", (None, 6): "z"}
    many = spark.createDataFrame([("c", k, "old" if k < 30 else "new") for k in range(50)], "host string, page_id int, text string")
    assert [r.line for r in boilerplate.repeated_lines(many).collect()] == ["new"]


def test_gates(spark):
    pages = [('<div class="x gh-post-upgrade-cta">', "a", "gh-post-upgrade-cta"), ("<script>gh-post-upgrade-cta</script>", "a", None), ("<p>", "This post is for paying subscribers only", "members-cta-copy"), ("<p>", "This post is for you. Members", None), ('<div class="ad">', "ad", None), (None, None, None)]
    frame = spark.createDataFrame(pages, "html string, text string, want string")
    assert all(r.got == r.want for r in frame.withColumn("got", boilerplate.gate(F.col("html"), F.col("text"))).collect())


def naive(page):
    """The text of marked-up text as its definition has it, replacement by replacement."""
    import re

    page = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1>", "", page)
    page = re.sub(r"(?i)</(p|h[1-6]|li|blockquote|div|figure|figcaption|tr|pre)\s*>", "\n\n", re.sub(r"(?i)<br\s*/?>", "\n", page))
    out = [re.sub(r"[ \t\xa0]+", " ", html.decode(x)).strip() for x in re.sub(r"<[^>]*>", "", page).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


@pytest.mark.parametrize("seed", range(3))
def test_densest_container_against_brute_force(seed):
    """Over well-formed pages: every container's text made by itself, the whole page first."""
    r = random.Random(seed)

    def part(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(["word ", "two  words", "<p>a line</p>", "<br>", "&amp;&nbsp;", "long " * r.randrange(1, 30)])
        tag = r.choice(["div", "article", "main", "section", "p", "ul", "nav"])
        return f'<{tag} class="{r.choice("xyz")} q">' + "".join(part(depth - 1) for _ in range(r.randrange(1, 4))) + f"</{tag}>"

    for _ in range(150):
        page = "".join(part(4) for _ in range(3))
        apart = html.re.sub(r"(?i)</?(?:nav|header|footer|aside|main|section|article|ul|ol|dl|table)(?:\s[^>]*)?>", lambda m: "\n\n" + m[0], page)
        best, name = naive(apart), "page"
        for tag in html.CONTAINERS:
            opens = [m for m in html.re.finditer(rf"<{tag}\b[^>]*>", apart)]
            for m in opens:
                depth = 0
                for n in html.re.finditer(rf"<(/?){tag}\b[^>]*>", apart[m.start() :]):
                    depth += -1 if n[1] else 1
                    if depth == 0:
                        text = naive(apart[m.end() : m.start() + n.start()])
                        if 0.8 * len(best) <= len(text) < len(best):
                            best, name = text, f"{tag}.{html.class_of(m[0]).split()[0]}"
                        break
        assert html.densest(page) == (best, name)
    began = time.time()
    assert html.densest("<div>" * 20_000 + "text " * 100 + "</div>" * 20_000)[0] == ("text " * 100).strip() and time.time() - began < 10
