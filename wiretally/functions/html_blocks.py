"""HTML to Markdown, and content roots that need nesting depth.

A replacement whose text depends on the match is done in the JVM: the text is split at the pattern,
the matches are rewritten, and both are zipped together again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretally.functions.common import WS, c, let, trim_ws
from wiretally.functions.pages import (
    ATTRS,
    ROOT_MARKS,
    body_root,
    decode_entities,
    needs_nested_root,
    simple_content_root,
    strip_noise,
    strip_tags,
)


def replace_with(
    text: Column, pattern: str, rewrite: Callable[..., Column], groups: tuple[int, ...] = (1,)
) -> Column:
    """Replace every match by ``rewrite(group, ...)``. The pattern must not match an empty text."""

    def of(s: Column) -> Column:
        names = [f"g{g}" for g in groups]
        found = F.arrays_zip(
            *[F.regexp_extract_all(s, F.lit(pattern), F.lit(g)).alias(n)
              for g, n in zip(groups, names)]
        )
        texts = F.transform(found, lambda m: rewrite(*[m[n] for n in names]))
        pieces = F.split(s, pattern, -1)
        joined = F.zip_with(
            pieces, texts, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))
        )
        return F.when(s.rlike(pattern), F.array_join(joined, "")).otherwise(s)

    return let(text, of)


def _clean(inner: Column) -> Column:
    return trim_ws(strip_tags(inner))


def _framed(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _quote(inner: Column) -> Column:
    lines = F.transform(F.split(_clean(inner), "\n"), lambda x: F.concat(F.lit("> "), x))
    return _framed("\n\n", F.array_join(lines, "\n"), "\n\n")


def _table(inner: Column) -> Column:
    trs = F.regexp_extract_all(inner, F.lit(rf"(?is)<tr{ATTRS}>(.*?)</tr>"), F.lit(1))
    cells = F.transform(
        trs,
        lambda tr: F.transform(
            F.regexp_extract_all(
                tr, F.lit(rf"(?is)<(?:td|th){ATTRS}>(.*?)</(?:td|th)>"), F.lit(1)
            ),
            _clean,
        ),
    )

    def lines(rows: Column) -> Column:
        width = F.array_max(F.transform(rows, F.size))

        def line(row: Column) -> Column:
            full = F.concat(row, F.array_repeat(F.lit(""), width - F.size(row)))
            return F.concat(F.lit("| "), F.array_join(full, " | "), F.lit(" |"))

        rule = F.concat(
            F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |")
        )
        body = F.transform(rows, line)
        ordered = F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, F.lit(2), F.size(body)))
        return F.when(F.size(rows) > 0, _framed("\n\n", F.array_join(ordered, "\n"), "\n\n")).otherwise(
            ""
        )

    return let(F.filter(cells, lambda r: F.size(r) > 0), lines)


def _image(tag: Column) -> Column:
    src = decode_entities(F.regexp_extract(tag, r"""(?i)src=["']([^"']*)["']""", 1))
    alt = decode_entities(F.regexp_extract(tag, r"""(?i)alt=["']([^"']*)["']""", 1))
    return let(
        F.struct(src.alias("src"), alt.alias("alt")),
        lambda x: F.when(x["src"] != "", _framed("![", x["alt"], "](", x["src"], ")")).otherwise(""),
    )


def _link(href: Column, inner: Column) -> Column:
    return let(
        F.struct(_clean(inner).alias("text"), decode_entities(href).alias("href")),
        lambda x: F.when(
            (x["text"] != "") & (x["href"] != ""), _framed("[", x["text"], "](", x["href"], ")")
        ).otherwise(x["text"]),
    )


def _list(inner: Column, numbered: bool) -> Column:
    """Items in order; text between the items is kept, as the item replacement leaves it."""
    pattern = rf"(?is)<li{ATTRS}>(.*?)</li>"
    items = F.transform(
        F.regexp_extract_all(inner, F.lit(pattern), F.lit(1)),
        lambda x, i: F.concat(
            F.concat((i + 1).cast("string"), F.lit(". ")) if numbered else F.lit("- "),
            _clean(x),
            F.lit("\n"),
        ),
    )
    joined = F.zip_with(
        F.split(inner, pattern, -1), items, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))
    )
    return _framed("\n\n", _clean(F.array_join(joined, "")), "\n\n")


def _fence(inner: Column) -> Column:
    return _framed("\n\n```\n", inner, "\n```\n\n")


def markdown_blocks(html: Column | str) -> Column:
    """First part of the rewrites: headings, quotes, code and tables. Links and images inside them are gone after it."""
    md = F.regexp_replace(c(html), r"(?s)<!--.*?-->", "")
    for level in range(1, 7):
        mark = "#" * level + " "
        md = replace_with(
            md,
            rf"(?is)<h{level}{ATTRS}>(.*?)</h{level}>",
            lambda x, mark=mark: _framed("\n\n", mark, _clean(x), "\n\n"),
        )
    md = replace_with(md, rf"(?is)<blockquote{ATTRS}>(.*?)</blockquote>", _quote)
    md = replace_with(
        md,
        rf"(?is)<pre{ATTRS}>{WS}*<code{ATTRS}>(.*?)</code>{WS}*</pre>",
        lambda x: _fence(decode_entities(trim_ws(x))),
    )
    md = replace_with(
        md, rf"(?is)<pre{ATTRS}>(.*?)</pre>", lambda x: _fence(decode_entities(_clean(x)))
    )
    md = replace_with(
        md, rf"(?is)<code{ATTRS}>(.*?)</code>", lambda x: _framed("`", decode_entities(x), "`")
    )
    return replace_with(md, rf"(?is)<table{ATTRS}>(.*?)</table>", _table)


def markdown_images(md: Column | str) -> Column:
    """Second part: images."""
    return replace_with(c(md), rf"(?i)<img{WS}+[^>]*>", _image, groups=(0,))


def markdown_text(md: Column | str) -> Column:
    """Last part: links, emphasis, lists and paragraphs, then tags stripped and entities decoded."""
    md = replace_with(
        c(md),
        rf"""(?is)<a{WS}+[^>]*href=["']([^"']*)["'][^>]*>(.*?)</a>""",
        _link,
        groups=(1, 2),
    )
    md = replace_with(
        md,
        rf"(?is)<(?:strong|b){ATTRS}>(.*?)</(?:strong|b)>",
        lambda x: _framed("**", strip_tags(x), "**"),
    )
    md = replace_with(
        md,
        rf"(?is)<(?:em|i){ATTRS}>(?!mg)(.*?)</(?:em|i)>",
        lambda x: _framed("*", strip_tags(x), "*"),
    )
    md = replace_with(md, rf"(?is)<ol{ATTRS}>(.*?)</ol>", lambda x: _list(x, True))
    md = replace_with(md, rf"(?is)<ul{ATTRS}>(.*?)</ul>", lambda x: _list(x, False))
    md = replace_with(
        md, rf"(?is)<p{ATTRS}>(.*?)</p>", lambda x: _framed("\n\n", trim_ws(x), "\n\n")
    )
    md = F.regexp_replace(md, rf"(?i)<br{WS}*/?>", "\n")
    md = decode_entities(strip_tags(md))
    return trim_ws(F.regexp_replace(md, r"\n{3,}", "\n\n"))


def html_to_markdown(html: Column | str) -> Column:
    """Markdown of a content root, by a fixed order of rewrites."""
    return markdown_text(markdown_images(markdown_blocks(html)))


def _inside(h: Column, mark: str) -> Column:
    """Inside of the element whose start tag carries the first match of ``mark``: a fold over the element's own tags
    that counts depth and length. Null without a match, an end tag or an inside."""

    def named(e: Column) -> Column:
        # e: the text from the start tag's "<" on
        name = F.regexp_extract(e, r"^<([A-Za-z0-9_]+)", 1)
        opened = F.locate(">", e)
        return F.when((name != "") & (opened > 0), closed(e.substr(opened + 1, F.length(e)), name))

    def closed(rest: Column, name: Column) -> Column:
        tags = F.concat(F.lit("(?i)</"), name, F.lit(">|<"), name, F.lit(f"(?:{WS}|>)"))

        def step(a: Column, x: Column) -> Column:
            depth = a["depth"] + F.when(x["tag"].startswith("</"), -1).otherwise(1)
            at = a["at"] + F.length(x["piece"]).cast("bigint")
            return F.when(a["end"].isNotNull(), a).otherwise(F.struct(
                depth.alias("depth"), (at + F.length(x["tag"])).alias("at"), F.when(depth == 0, at).alias("end")))

        # the last piece has no tag behind it
        parts = F.filter(
            F.arrays_zip(F.split(rest, tags, -1).alias("piece"), F.regexp_extract_all(rest, tags, F.lit(0)).alias("tag")),
            lambda x: x["tag"].isNotNull())
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("end"))
        end = F.aggregate(parts, start, step, lambda a: a["end"])
        return let(end, lambda n: F.when(n > 0, rest.substr(F.lit(1), n.cast("int"))))

    def of(before: Column) -> Column:
        tail = F.substring_index(before, "<", -1)
        start = F.length(before) - F.length(tail)
        return F.when(before.contains("<"), let(h.substr(start, F.length(h)), named))

    return F.when(h.rlike(mark), let(F.get(F.split(h, mark, 2), F.lit(0)), of))


def nested_root(html: Column | str) -> Column:
    """Inside of the first element that carries a content class or id, whose nested tags are counted."""
    return F.coalesce(*[_inside(c(html), mark) for mark in ROOT_MARKS])


def page_root(cleaned: Column | str) -> Column:
    """Content root of a page whose noise is already stripped."""
    h = c(cleaned)
    return F.coalesce(
        simple_content_root(h), nested_root(F.when(needs_nested_root(h), h)), body_root(h)
    )


__all__ = ["html_to_markdown", "markdown_blocks", "markdown_images", "markdown_text", "page_root", "replace_with",
           "nested_root", "strip_noise"]
