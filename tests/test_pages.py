"""Content of pages: roots by nesting, links and images that stand in the content."""

import random
import re

from wiretally.functions import html_blocks
from wiretally.operators import read_pages

MARKS = [rf"""class=["'][^"']*\b{n}\b""" for n in ("post-content", "article-body", "entry-content")] + [
    r"""id=["']content["']"""]


def plain_root(html):
    """Inside of the first marked element, tag by tag."""
    for mark in MARKS:
        found = re.search(mark, html, re.I | re.A)
        if not found:
            continue
        start = html.rfind("<", 0, found.start())
        name = start >= 0 and re.match(r"<(\w+)", html[start:], re.A)
        opened = html.find(">", start) if name else -1
        if opened < 0:
            continue
        depth = 1
        for tag in re.finditer(rf"</{name[1]}>|<{name[1]}[\s>]", html[opened + 1:], re.I):
            depth += -1 if tag[0].startswith("</") else 1
            if depth == 0:
                if tag.start():
                    return html[opened + 1:opened + 1 + tag.start()]
                break
    return None


def test_nested_roots_against_plain(spark):
    rng = random.Random(5)
    parts = ["<div>", "</div>", "<DIV class='a'>", "</Div>", "<div\n>", '<div class="x post-content y">', '<p id="content">', "</p>", "<p>",
             "<section class='entry-content'>", "</section>", "text", "\U0001F600", "<divider>", 'class="article-body"', "<", "<br>", " id='content'", ""]
    texts = ["", "post-content", '<div class="post-content"></div>', '<div class="post-contents">a</div>', '<div class="post-content">open',
             '<div class="post-content"></div><p id="content">second</p>', '<div class="post-content"']
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "i int, h string")
    got = {r["i"]: r["x"] for r in df.select("i", html_blocks.nested_root("h").alias("x")).collect()}
    want = {i: plain_root(t) for i, t in enumerate(texts)}
    assert got.pop(len(texts)) is None
    assert got == want
    assert sum(w is not None for w in want.values()) > 200


def test_nested_root_of_a_long_page(spark, value):
    inner = "<div>a</div>" * 20_000
    got = value(html_blocks.page_root("h"), h=f'<body><div class="entry-content">{inner}</div>b</body>')
    assert got == inner


def test_links_and_images_of_the_content(spark):
    html = ("<article><h1><a href='/h'>head</a></h1><table><tr><td><a href='/t'>cell</a><img src='t.png'></td></tr></table>"
            "<pre><a href='/c'>code</a></pre><p><a href='/p'>text</a> <a href='/i'><img alt='q' src='s.png'></a></p></article>")
    df = spark.createDataFrame([("u", html, 200), ("v", None, 200), ("w", "", 200)], "url string, html string, status int")
    rows = {r["url"]: r for r in read_pages.read_pages(df).collect()}
    assert [tuple(x) for x in rows["u"]["links"]] == [("text", "/p"), ("![q](s.png)", "/i")]
    assert [tuple(x) for x in rows["u"]["images"]] == [("q", "s.png")]
    assert rows["u"]["content"] == "# head\n\n| cell |\n| --- |\n\n```\ncode\n```\n\n[text](/p) [![q](s.png)](/i)"
    assert rows["w"]["content"] == "" and rows["w"]["links"] == []


def test_no_python_reads_pages(spark):
    df = spark.createDataFrame([("u", "<div class='post-content'>x</div>", 200)], "url string, html string, status int")
    plan = read_pages.read_pages(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
