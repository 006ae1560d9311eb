"""Landed JSON payloads of known sites to page reads: one routed projection, and joins where a page
needs other items."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions.common import c, let, trim_ws
from wiretally.functions.text import token_cost

# The first route whose pattern matches wins
ROUTES = [
    ("forum", r"reddit\.com/r/[^/]+/comments/|reddit\.com/r/[^/]+/?$|reddit\.com/r/[^/]+/?(?:\?|$)"
              r"|reddit\.com/user/[^/]+"),
    ("video", r"youtube\.com/watch\?v=|youtu\.be/"),
    ("encyclopedia", r"[a-z]{2,3}\.wikipedia\.org/wiki/[^#?]+"),
    ("news", r"news\.ycombinator\.com/item\?id=[0-9]+|news\.ycombinator\.com/?(?:\?|$)"),
    ("articles", r"grokipedia\.com/(?:wiki|article)/[^#?]+|grokipedia\.com/search\?"
                 r"|grokipedia\.com/?$|grokipedia\.com/?(?:\?|#|$)"),
    ("social", r"(?:twitter\.com|x\.com)/\w+/status/[0-9]+|(?:twitter\.com|x\.com)/\w+/?$"),
    ("wiki", r"^https?://(?:www\.)?deepwiki\.com/[^/]+/[^/]+"),
]


@dataclass(frozen=True)
class Limits:
    """How much of a payload goes into its content; None: all of it."""

    posts: int | None = None
    comments: int | None = None
    stories: int | None = None
    replies: int | None = None
    sources: int | None = None
    images: int | None = None
    photos: int | None = None
    article_chars: int | None = None
    #: A social post has no title or summary of its own; they are excerpts of its text.
    title_chars: int | None = 80
    summary_chars: int | None = 200


ALL = Limits()
# The sizes of a preview.
PREVIEW = Limits(posts=25, comments=25, stories=10, replies=10, sources=10, images=5, photos=4, article_chars=20_000)
LINK = "array<struct<text:string,href:string>>"
IMAGE = "array<struct<alt:string,src:string>>"


def _head(items: Column, limit: int | None) -> Column:
    return items if limit is None else F.slice(items, 1, limit)


def _excerpt(text: Column, limit: int | None, more: str = "") -> Column:
    if limit is None:
        return text
    return F.concat(F.substring(text, 1, limit), F.when(F.length(text) > limit, more).otherwise(""))


def route(url: Column | str) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(ROUTES):
        out = F.when(c(url).rlike(pattern), name).otherwise(out)
    return out


def _text(v: Column, path: str) -> Column:
    """Text at a path; an empty text counts as missing."""
    return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))


def _num(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "bigint")


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _or(x: Column, default: str) -> Column:
    return F.coalesce(x, F.lit(default))


def _s(x: Column | int | str) -> Column:
    return F.lit(x) if isinstance(x, (str, int)) else x.cast("string")


def _cat(*parts) -> Column:
    return F.concat(*[_s(p) for p in parts])


def iso_time(seconds: Column) -> Column:
    """ISO-8601 UTC text of epoch seconds, whatever the session's time zone is."""
    at = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)
    return F.when(F.coalesce(seconds, F.lit(0)) != 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def _grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def _row(title, author, description, content, type_, source, site, links=None, images=None,
         published=None, canonical=None) -> Column:
    none = F.lit(None).cast("string")

    def or_none(x):
        return none if x is None else _s(x)

    return F.struct(
        or_none(title).alias("title"), or_none(author).alias("author"),
        or_none(description).alias("description"), or_none(content).alias("content"),
        (F.array() if links is None else links).cast(LINK).alias("links"),
        (F.array() if images is None else images).cast(IMAGE).alias("images"),
        _s(type_).alias("type"), or_none(published).alias("published_at"), _s(source).alias("source"),
        or_none(canonical).alias("canonical"), _s(site).alias("site_name"),
    )


def _link(text: Column | str, href: Column) -> Column:
    return F.struct(_s(text).alias("text"), href.alias("href"))


def _image(alt: Column | str, src: Column) -> Column:
    return F.struct(_s(alt).alias("alt"), src.alias("src"))


# ------------------------------------------------------------------------------------------
# forum
# ------------------------------------------------------------------------------------------
def forum_comments(v: Column, limits: Limits = ALL) -> Column:
    """Comments of a post page as (id, author, body, score)."""
    kept = F.filter(
        _items(v, "$[1].data.children"),
        lambda x: (F.try_variant_get(x, "$.kind", "string") == "t1")
        & F.try_variant_get(x, "$.data", "variant").isNotNull(),
    )
    return F.transform(
        _head(kept, limits.comments),
        lambda x: F.struct(
            _or(_text(x, "$.data.id"), "").alias("id"),
            _or(_text(x, "$.data.author"), "[deleted]").alias("author"),
            _or(_text(x, "$.data.body"), "").alias("body"),
            F.coalesce(_num(x, "$.data.score"), F.lit(0)).alias("score"),
        ),
    )


def forum_post(v: Column, comments: Column) -> Column:
    """Post page. ``comments``: (id, author, body, score, recovered)."""
    p = "$[0].data.children[0].data"
    score = F.coalesce(_num(v, f"{p}.score"), F.lit(0))
    lines = F.array_join(
        F.transform(
            comments,
            lambda x: _cat(F.when(x["recovered"], "[recovered] ").otherwise(""), x["author"], " (",
                           x["score"], " pts): ", x["body"]),
        ),
        "\n\n",
    )
    selftext = _text(v, f"{p}.selftext")
    content = F.concat(
        F.coalesce(F.concat(selftext, F.lit("\n\n---\n")), F.lit("")),
        _cat("Score: ", score, " | ", F.size(comments), " comments\n\n", lines),
    )
    link, perma = _text(v, f"{p}.url"), _text(v, f"{p}.permalink")
    links = F.when(link.isNotNull() & ~link.eqNullSafe(perma), F.array(_link("Link", link))).otherwise(
        F.array().cast(LINK)
    )
    author = _text(v, f"{p}.author")
    return F.when(
        F.try_variant_get(v, p, "variant").isNotNull(),
        _row(
            _text(v, f"{p}.title"), author,
            _cat("r/", _or(_text(v, f"{p}.subreddit"), ""), " post by u/", _or(author, "null"), " (", score, " points)"),
            content, "discussion", "reddit-json", "Reddit", links,
            published=iso_time(_num(v, f"{p}.created_utc")),
            canonical=F.concat(F.lit("https://www.reddit.com"), perma),
        ),
    )


def forum_listing(v: Column, url: Column, limits: Limits = ALL) -> Column:
    posts = _head(
        F.filter(_items(v, "$.data.children"), lambda x: F.try_variant_get(x, "$.data", "variant").isNotNull()),
        limits.posts,
    )

    def of(ps: Column) -> Column:
        title = lambda x: F.coalesce(_text(x, "$.data.title"), _text(x, "$.data.link_title"), F.lit(""))
        lines = F.transform(
            ps,
            lambda x, i: _cat(i + 1, ". ", title(x), " (", F.coalesce(_num(x, "$.data.score"), F.lit(0)),
                              " pts, ", F.coalesce(_num(x, "$.data.num_comments"), F.lit(0)),
                              " comments) by u/", _or(_text(x, "$.data.author"), "[deleted]")),
        )
        linked = F.filter(ps, lambda x: _text(x, "$.data.permalink").isNotNull())
        links = F.transform(
            linked, lambda x: _link(title(x), F.concat(F.lit("https://www.reddit.com"), _text(x, "$.data.permalink")))
        )
        sub = F.nullif(F.regexp_extract(url, "/r/([^/]+)", 1), F.lit(""))
        user = F.nullif(F.regexp_extract(url, "/user/([^/]+)", 1), F.lit(""))
        return _row(
            F.coalesce(F.concat(F.lit("r/"), sub), F.concat(F.lit("u/"), user), F.lit("Reddit listing")),
            None, _cat(F.size(ps), " posts"), F.array_join(lines, "\n"), "listing", "reddit-json", "Reddit", links,
        )

    return let(posts, of)


# ------------------------------------------------------------------------------------------
# one-document sites
# ------------------------------------------------------------------------------------------
def encyclopedia(v: Column, url: Column) -> Column:
    slug = F.regexp_extract(url, r"wikipedia\.org/wiki/([^#?]+)", 1)
    title = F.coalesce(_text(v, "$.title"), _text(v, "$.displaytitle"), F.try_url_decode(slug))
    page, thumb = _text(v, "$.content_urls.desktop.page"), _text(v, "$.thumbnail.source")
    return _row(
        title, None, _text(v, "$.description"), _or(_text(v, "$.extract"), ""), "article",
        "wikipedia-rest", "Wikipedia",
        F.filter(F.array(_link("Full article", page)), lambda x: x["href"].isNotNull()),
        F.filter(F.array(_image(title, thumb)), lambda x: x["src"].isNotNull()),
        _text(v, "$.timestamp"), page,
    )


def video(v: Column, url: Column) -> Column:
    title, author = _text(v, "$.title"), _text(v, "$.author_name")
    channel, thumb = _text(v, "$.author_url"), _text(v, "$.thumbnail_url")
    content = F.concat_ws(
        "\n", F.concat(F.lit("Title: "), title), F.concat(F.lit("Author: "), author),
        F.concat(F.lit("Channel: "), channel),
    )
    return F.when(
        title.isNotNull(),
        _row(title, author, F.coalesce(F.concat(F.lit("Video by "), author), F.lit("YouTube video")),
             content, "video", "youtube-oembed", "YouTube",
             F.filter(F.array(_link(_or(author, "Channel"), channel)), lambda x: x["href"].isNotNull()),
             F.filter(F.array(_image(title, thumb)), lambda x: x["src"].isNotNull()), None, url),
    )


def article(v: Column, url: Column, limits: Limits = ALL) -> Column:
    """Article with its sources and a statistics line."""
    slug = F.regexp_extract(url, r"grokipedia\.com/(?:wiki|article)/([^#?]+)", 1)
    title = F.coalesce(_text(v, "$.page.title"), F.replace(F.try_url_decode(slug), F.lit("_"), F.lit(" ")))
    text = F.coalesce(_text(v, "$.page.content"), _text(v, "$.page.description"), F.lit(""))
    cites = _items(v, "$.page.citations")
    views = _num(v, "$.page.stats.totalViews")

    def of(x: Column) -> Column:
        body, top = x["text"], _head(x["cites"], limits.sources)
        cut = body if limits.article_chars is None else F.when(
            F.length(body) > limits.article_chars,
            F.concat(F.substring(body, 1, limits.article_chars),
                     _cat("\n\n[Truncated — full article is ", F.length(body), " chars. ",
                          F.size(x["cites"]), " citations available.]")),
        ).otherwise(body)
        sources = F.array_join(
            F.transform(top, lambda s, i: _cat(i + 1, ". [", _or(_text(s, "$.title"), "Source"), "](",
                                               _or(_text(s, "$.url"), "undefined"), ")")), "\n")
        block = F.when(F.size(top) > 0, F.concat(F.lit("\n\n## Sources\n"), sources)).otherwise("")
        stats = F.when(
            F.coalesce(views, F.lit(0)) != 0,
            _cat("\n\nViews: ", _grouped(views), " | Quality: ",
                 _or(_text(v, "$.page.stats.qualityScore"), "N/A"), " | Language: ",
                 _or(_text(v, "$.page.metadata.language"), "en")),
        ).otherwise("")
        links = F.concat(
            F.array(_link("Full article", F.concat(F.lit("https://grokipedia.com/wiki/"), slug))).cast(LINK),
            F.transform(F.filter(top, lambda s: _text(s, "$.url").isNotNull()),
                        lambda s: _link(_or(_text(s, "$.title"), "Source"), _text(s, "$.url"))).cast(LINK),
        )
        images = F.transform(
            _head(_items(v, "$.page.images"), limits.images),
            lambda m: _image(F.coalesce(_text(m, "$.caption"), title), _or(_text(m, "$.url"), "")),
        )
        return _row(
            title, _text(v, "$.page.metadata.lastEditor"), _text(v, "$.page.description"),
            F.concat(cut, block, stats), "article", "grokipedia-api", "Grokipedia", links, images,
            iso_time(_num(v, "$.page.metadata.lastModified")),
            F.concat(F.lit("https://grokipedia.com/wiki/"), slug),
        )

    return F.when(
        F.try_variant_get(v, "$.page", "variant").isNotNull(),
        let(F.struct(text.alias("text"), cites.alias("cites")), of),
    )


def article_search(v: Column, url: Column) -> Column:
    term = F.try_url_decode(F.regexp_extract(url, r"grokipedia\.com/search\?.*q=([^&#]+)", 1))

    def of(rs: Column) -> Column:
        def line(r: Column, i: Column) -> Column:
            views = _num(r, "$.viewCount")
            seen = F.when(F.coalesce(views, F.lit(0)) != 0, _cat(" (", _grouped(views), " views)")).otherwise("")
            snippet = trim_ws(F.replace(F.regexp_replace(_or(_text(r, "$.snippet"), ""), "</?em>", "**"),
                                        F.lit("\n"), F.lit(" ")))
            return _cat(i + 1, ". **[", _or(_text(r, "$.title"), "undefined"), "](https://grokipedia.com/wiki/",
                        _or(_text(r, "$.slug"), "undefined"), ")**", seen, "\n   ", snippet)

        links = F.transform(rs, lambda r: _link(F.coalesce(_text(r, "$.title"), _text(r, "$.slug")),
                                                F.concat(F.lit("https://grokipedia.com/wiki/"), _text(r, "$.slug"))))
        return F.when(
            F.size(rs) > 0,
            _row(_cat('Grokipedia search: "', term, '"'), None, _cat(F.size(rs), ' results for "', term, '"'),
                 F.array_join(F.transform(rs, line), "\n\n"), "search-results", "grokipedia-api", "Grokipedia", links),
        )

    return let(_items(v, "$.results"), of)


def article_home(v: Column) -> Column:
    """Home page from a document with ``stats`` and ``edits`` parts."""
    pages = _grouped(F.coalesce(F.try_variant_get(v, "$.stats.totalPages", "bigint"), F.lit(0)))
    size = F.coalesce(F.try_variant_get(v, "$.stats.indexSizeBytes", "double"), F.lit(0.0)) / F.lit(1024.0**3)
    edits = _items(v, "$.edits.editRequests")

    def line(e: Column) -> Column:
        kind = F.lower(F.replace(_text(e, "$.type"), F.lit("EDIT_REQUEST_TYPE_"), F.lit("")))
        return _cat("- **", _or(F.replace(_text(e, "$.slug"), F.lit("_"), F.lit(" ")), "Unknown"),
                    "** — edited by ", _or(_text(e, "$.userId"), "Anonymous"), " (",
                    _or(F.replace(kind, F.lit("_"), F.lit(" ")), "undefined"), ")\n")

    content = F.concat(
        _cat("# Grokipedia\n\nAn open source, comprehensive collection of all knowledge.\n\n**", pages,
             " articles** | **", F.format_string("%.1f", size), " GB index**\n\n"),
        F.when(F.size(edits) > 0, F.concat(F.lit("## Recent Activity\n"),
                                           F.array_join(F.transform(edits, line), ""))).otherwise(""),
    )
    return _row("Grokipedia", None, _cat("Open knowledge base with ", pages, " articles"), content, "website",
                "grokipedia-api", "Grokipedia", canonical="https://grokipedia.com")


# Marks of article blocks
BLOCK_MARKS = {
    "header-one": "\n# ", "header-two": "\n## ", "header-three": "\n### ",
    "unordered-list-item": "• ", "ordered-list-item": "1. ", "blockquote": "> ",
}


def social(v: Column, url: Column, limits: Limits = ALL) -> Column:
    """A post with its author, engagement, embedded article, quoted post, photos and cover."""
    user = F.regexp_extract(url, r"(?:twitter\.com|x\.com)/(\w+)/status/", 1)
    name, screen = _text(v, "$.tweet.author.name"), _text(v, "$.tweet.author.screen_name")
    known = F.try_variant_get(v, "$.tweet.author", "variant").isNotNull()
    text = F.coalesce(_text(v, "$.tweet.text"), _text(v, "$.tweet.raw_text.text"))
    has_article = F.try_variant_get(v, "$.tweet.article", "variant").isNotNull()
    article_title = _text(v, "$.tweet.article.title")
    marks = F.create_map(*[F.lit(x) for kv in BLOCK_MARKS.items() for x in kv])

    def counted(path: str, label: str) -> Column:
        n = _num(v, f"$.tweet.{path}")
        return F.when(F.coalesce(n, F.lit(0)) != 0, F.concat(_grouped(n), F.lit(label)))

    engagement = F.nullif(
        F.concat_ws(" · ", counted("likes", " likes"), counted("retweets", " RTs"),
                    counted("views", " views"), counted("bookmarks", " bookmarks")), F.lit(""))
    blocks = F.transform(
        F.filter(_items(v, "$.tweet.article.content.blocks"), lambda b: _text(b, "$.text").isNotNull()),
        lambda b: F.concat(F.coalesce(F.try_element_at(marks, F.try_variant_get(b, "$.type", "string")), F.lit("")),
                           _text(b, "$.text")),
    )
    article_text = F.when(
        F.try_variant_get(v, "$.tweet.article.content.blocks", "variant").isNotNull(), F.array_join(blocks, "\n")
    ).otherwise(_text(v, "$.tweet.article.preview_text"))
    quoted = F.coalesce(
        _cat(_text(v, "$.tweet.quote.author.name"), " (@", _text(v, "$.tweet.quote.author.screen_name"), ")"),
        F.lit("Unknown"))
    followers = _num(v, "$.tweet.author.followers")
    content = F.concat_ws(
        "\n",
        F.when(known, _cat("**", name, "** (@", screen, ")")),
        _text(v, "$.tweet.author.description"),
        F.when(F.coalesce(followers, F.lit(0)) != 0, F.concat(F.lit("Followers: "), _grouped(followers))),
        F.concat(F.lit("\n"), text),
        engagement,
        F.when(has_article, F.concat(F.lit("\n## "), _or(article_title, "Article"))),
        F.when(has_article, article_text),
        F.when(F.try_variant_get(v, "$.tweet.quote", "variant").isNotNull(),
               _cat("\n> Quoting ", quoted, ":\n> ", _or(_text(v, "$.tweet.quote.text"), ""))),
    )
    who = F.when(known, _cat(name, " (@", screen, ")")).otherwise(user)
    site = _text(v, "$.tweet.author.website.url")
    cover = _text(v, "$.tweet.article.cover_media.media_info.original_img_url")
    photos = F.transform(
        _head(_items(v, "$.tweet.media.photos"), limits.photos), lambda p: _image("Tweet image", _text(p, "$.url")))
    title = F.coalesce(
        article_title,
        _cat(who, ": ", _excerpt(text, limits.title_chars, "…")),
        _cat("Tweet by ", who),
    )
    return F.when(
        F.try_variant_get(v, "$.tweet", "variant").isNotNull(),
        _row(title, F.coalesce(name, user), _excerpt(text, limits.summary_chars), content,
             F.when(has_article, "article").otherwise("social"), "twitter-fxtwitter", "X (Twitter)",
             F.filter(F.array(_link(_or(_text(v, "$.tweet.author.website.display_url"), "Website"), site)),
                      lambda x: x["href"].isNotNull()),
             F.concat(photos.cast(IMAGE),
                      F.filter(F.array(_image(_or(article_title, "Article cover"), cover)),
                               lambda x: x["src"].isNotNull()).cast(IMAGE)),
             _text(v, "$.tweet.created_at"), url),
    )


# ------------------------------------------------------------------------------------------
# wiki text streams
# ------------------------------------------------------------------------------------------
def stream_blocks(body: Column | str) -> Column:
    """Text blocks ``id:T<hex length>,text`` of a stream: one fold over its lines, whose state is the
    open block and how many bytes it still needs."""
    start = r"^[0-9a-f]+:T([0-9a-f]+),(.*)$"
    empty = F.array().cast("array<string>")
    zero = F.struct(
        F.lit(None).cast("string").alias("cur"), F.lit(0).cast("bigint").alias("need"),
        F.lit(0).cast("bigint").alias("have"), empty.alias("blocks"),
    )

    def push(acc: Column) -> Column:
        return F.when(acc["cur"].isNotNull(), F.array_append(acc["blocks"], acc["cur"])).otherwise(acc["blocks"])

    def state(cur: Column, need: Column, have: Column, blocks: Column) -> Column:
        return F.struct(cur.cast("string").alias("cur"), need.cast("bigint").alias("need"),
                        have.cast("bigint").alias("have"), blocks.alias("blocks"))

    def step(acc: Column, line: Column) -> Column:
        opened = F.regexp_extract(line, start, 2)
        grown = F.concat(acc["cur"], F.lit("\n"), line)
        have = acc["have"] + F.octet_length(line) + 1
        full = have >= acc["need"]
        return (
            F.when(line.rlike(start),
                   state(opened, F.conv(F.regexp_extract(line, start, 1), 16, 10), F.octet_length(opened), push(acc)))
            .when(acc["cur"].isNull(), acc)
            .when(line.rlike("^[0-9a-f]+:[^T]"), state(F.lit(None), F.lit(0), F.lit(0), push(acc)))
            .otherwise(state(F.when(~full, grown), acc["need"], have,
                             F.when(full, F.array_append(acc["blocks"], grown)).otherwise(acc["blocks"])))
        )

    return F.aggregate(F.split(c(body), "\n"), zero, step, push)


def longest_block(blocks: Column) -> Column:
    """The longest text; the last one among equals."""
    return F.aggregate(
        blocks, F.lit(None).cast("string"),
        lambda acc, b: F.when(F.length(acc) > F.length(b), acc).otherwise(b),
    )


def wiki(body: Column, url: Column) -> Column:
    org = F.regexp_extract(url, r"deepwiki\.com/([^/]+)/", 1)
    repo = F.regexp_extract(url, r"deepwiki\.com/[^/]+/([^/]+)", 1)
    rest = F.regexp_extract(url, r"deepwiki\.com/[^/]+/[^/]+(/.*)?$", 1)
    slug = F.concat(org, F.lit("/"), repo)

    def of(main: Column) -> Column:
        files = "ts|js|md|json|tsx|jsx|py|rs|go|toml|yaml|yml|css|html"
        head = r"\[([^\]]+)\]\((?!https?://)"
        out = F.regexp_replace(main, F.lit(head + rf"([^)]+\.(?:{files}))\)"),
                               F.concat(F.lit("[$1](https://github.com/"), slug, F.lit("/blob/main/$2)")))
        out = F.regexp_replace(out, F.lit(head + r"#([^)]*)\)"),
                               F.concat(F.lit("[$1](https://deepwiki.com/"), slug, F.lit("/$2)")))
        out = F.regexp_replace(out, F.lit(head + r"([^)]+)\)"),
                               F.concat(F.lit("[$1](https://deepwiki.com/"), slug, F.lit("/$2)")))
        first = F.nullif(F.regexp_extract(main, r"(?m)^#\s+(.+)$", 1), F.lit(""))
        return F.when(
            F.length(main) >= 50,
            _row(F.concat(F.coalesce(F.concat(first, F.lit(" — ")), F.lit("")), slug, F.lit(" | DeepWiki")),
                 None, F.concat(F.lit("DeepWiki documentation for "), slug), out, "wiki", "deepwiki-rsc",
                 "DeepWiki", canonical=F.concat(F.lit("https://deepwiki.com/"), slug, rest)),
        )

    return let(longest_block(stream_blocks(body)), of)


# ------------------------------------------------------------------------------------------
# jobs
# ------------------------------------------------------------------------------------------
def _finish(df: DataFrame, row: Column, *extra: str) -> DataFrame:
    """Spread the row struct; rows without one vanish. A generator evaluates the struct once, where
    a filter and a projection would evaluate it for each of its fields."""
    some = F.filter(F.array(row), lambda r: r.isNotNull())
    return df.select(*extra, "url", F.inline(some)).withColumn("tokens", token_cost("content"))


def recover_comments(posts: DataFrame, archive: DataFrame | None, limits: Limits = ALL) -> DataFrame:
    """Comments of post pages; deleted ones are replaced from an archive of (id, author, body).

    Only the deleted comments meet the archive: an equi-join on the comment's id. A post has at most
    25 comments, so putting them back together is bounded."""
    listed = posts.withColumn("comments", forum_comments(F.col("v"), limits))
    gone = ["[deleted]", "[removed]"]
    if archive is None:
        plain = F.transform("comments", lambda x: F.struct(
            x["id"].alias("id"), x["author"].alias("author"), x["body"].alias("body"),
            x["score"].alias("score"), F.lit(False).alias("recovered")))
        return listed.withColumn("comments", plain)
    known = archive.filter((F.coalesce("body", F.lit("")) != "") & ~F.col("body").isin(gone)).select(
        "id", F.coalesce("author", F.lit("[deleted]")).alias("a_author"), F.col("body").alias("a_body"))
    lost = listed.select("url", F.explode("comments").alias("x")).filter(
        F.col("x.body").isin(gone) & (F.col("x.id") != "")).select("url", F.col("x.id").alias("id"))
    found = lost.join(known, "id").groupBy("url").agg(
        F.map_from_entries(F.collect_list(F.struct("id", F.struct("a_author", "a_body")))).alias("found"))

    def mend(x: Column) -> Column:
        hit = F.try_element_at("found", x["id"])
        use = x["body"].isin(gone) & hit.isNotNull()
        return F.struct(
            x["id"].alias("id"),
            F.when(use, hit["a_author"]).otherwise(x["author"]).alias("author"),
            F.when(use, hit["a_body"]).otherwise(x["body"]).alias("body"),
            x["score"].alias("score"), F.coalesce(use, F.lit(False)).alias("recovered"),
        )

    return listed.join(found, "url", "left").withColumn("comments", F.transform("comments", mend))


def forum_posts(payloads: DataFrame, archive: DataFrame | None = None, limits: Limits = ALL) -> DataFrame:
    posts = payloads.filter((F.col("status") == 200) & (route("url") == "forum")).withColumn(
        "v", F.try_parse_json("body")).filter(F.try_variant_get("v", "$", "array<variant>").isNotNull())
    mended = recover_comments(posts, archive, limits)
    return _finish(mended, forum_post(F.col("v"), F.col("comments")))


def normalise_payloads(payloads: DataFrame, limits: Limits = ALL) -> DataFrame:
    """Page reads of all payloads that need no other row: one projection, routed per URL."""
    u, v = F.col("url"), F.col("v")
    staged = payloads.filter(F.col("status") == 200).withColumn("route", route("url")).filter(
        F.col("route").isNotNull()).withColumn(
        "v", F.when(F.col("route") != "wiki", F.try_parse_json("body")))
    is_search = u.rlike(r"grokipedia\.com/search\?.*q=[^&#]+")
    is_article = u.rlike(r"grokipedia\.com/(?:wiki|article)/[^#?]+")
    row = (
        F.when((F.col("route") == "forum") & F.try_variant_get(v, "$.data.children", "array<variant>").isNotNull(),
               forum_listing(v, u, limits))
        .when(F.col("route") == "video", video(v, u))
        .when((F.col("route") == "encyclopedia") & v.isNotNull(), encyclopedia(v, u))
        .when((F.col("route") == "articles") & is_search, article_search(v, u))
        .when((F.col("route") == "articles") & is_article, article(v, u, limits))
        .when((F.col("route") == "articles") & v.isNotNull(), article_home(v))
        .when(F.col("route") == "social", social(v, u, limits))
        .when(F.col("route") == "wiki", wiki(F.col("body"), u))
    )
    return _finish(staged, row, "route")


def parse_items(items: DataFrame) -> DataFrame:
    """Landed news items (id, body) as columns."""
    v = F.try_parse_json("body")
    return items.withColumn("v", v).filter(F.col("v").isNotNull()).select(
        "id",
        _text(F.col("v"), "$.by").alias("by"), _text(F.col("v"), "$.title").alias("title"),
        _text(F.col("v"), "$.text").alias("text"), _text(F.col("v"), "$.url").alias("link"),
        F.coalesce(_num(F.col("v"), "$.score"), F.lit(0)).alias("score"),
        F.coalesce(_num(F.col("v"), "$.descendants"), F.lit(0)).alias("descendants"),
        _or(_text(F.col("v"), "$.type"), "story").alias("kind"), _num(F.col("v"), "$.time").alias("time"),
        F.coalesce(F.try_variant_get("v", "$.deleted", "boolean"), F.lit(False)).alias("deleted"),
        F.coalesce(F.try_variant_get("v", "$.kids", "array<bigint>"), F.array().cast("array<bigint>")).alias("kids"),
    )


def news_items(pages: DataFrame, items: DataFrame, limits: Limits = ALL) -> DataFrame:
    """Item pages with their comments that are not deleted. ``pages``: (url)."""
    parsed = parse_items(items)
    wanted = pages.select("url", F.regexp_extract("url", r"item\?id=([0-9]+)", 1).try_cast("bigint").alias("id"))
    item = wanted.join(parsed, "id")
    kids = item.select("url", F.posexplode(_head(F.col("kids"), limits.replies)).alias("n", "id"))
    lines = (
        kids.join(parsed.filter(~F.col("deleted")).select("id", "by", "text"), "id")
        .groupBy("url")
        .agg(F.array_sort(F.collect_list(F.struct(
            "n", _cat(_or(F.col("by"), "[deleted]"), ": ", _or(F.col("text"), "[deleted]")).alias("line")))).alias("ls"))
        .select("url", F.array_join(F.transform("ls", lambda x: x["line"]), "\n\n").alias("comments"))
    )
    j = item.join(lines, "url", "left")
    content = F.concat_ws(
        "\n\n", F.col("text"), _cat("Score: ", F.col("score"), " | ", F.size("kids"), " comments"),
        F.concat(F.lit("---\n"), "comments"),
    )
    row = _row(
        F.col("title"), F.col("by"),
        _cat("HN ", F.col("kind"), " by ", _or(F.col("by"), "null"), " (", F.col("score"), " points)"), content,
        F.col("kind"), "hackernews-firebase", "Hacker News",
        F.filter(F.array(_link(_or(F.col("title"), "Link"), F.col("link"))), lambda x: x["href"].isNotNull()),
        published=iso_time(F.col("time")),
        canonical=_cat("https://news.ycombinator.com/item?id=", F.col("id")),
    )
    return _finish(j, row)


def news_front(pages: DataFrame, items: DataFrame, limits: Limits = ALL) -> DataFrame:
    """Front pages (url, body = JSON array of ids) as numbered stories."""
    ids = F.from_json("body", "array<bigint>")
    slots = pages.filter(F.try_parse_json("body").isNotNull()).select(
        "url", F.posexplode(_head(ids, limits.stories)).alias("n", "id"))
    found = slots.join(parse_items(items), "id").groupBy("url").agg(
        F.array_sort(F.collect_list(F.struct("n", "title", "score", "descendants", "by", "link"))).alias("s"))
    lines = F.transform("s", lambda x, i: _cat(
        i + 1, ". ", _or(x["title"], "[untitled]"), " (", x["score"], " pts, ", x["descendants"],
        " comments) by ", _or(x["by"], "[deleted]")))
    links = F.transform(F.filter("s", lambda x: x["link"].isNotNull()),
                        lambda x: _link(_or(x["title"], "Link"), x["link"]))
    row = _row("Hacker News — Top Stories", None, _cat("Top ", F.size("s"), " stories"),
               F.array_join(lines, "\n"), "listing", "hackernews-firebase", "Hacker News", links,
               canonical="https://news.ycombinator.com/")
    return _finish(found, row)
