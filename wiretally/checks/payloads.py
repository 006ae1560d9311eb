"""Checks of the payload normalisers, over payloads derived from the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.checks.base import query
from wiretally.operators import payloads as P
from wiretally.sources import derived as D


def conversations(spark, sf):
    return D.table(spark, sf, "conversations")


def _s(x):
    return F.col(x).cast("string")


def forum_payloads(spark, sf):
    """One post page per conversation: its first turn is the post, the others are comments."""
    c = conversations(spark, sf)
    comment = F.struct(
        F.when(F.col("turn") % 5 == 4, "more").otherwise("t1").alias("kind"),
        F.struct(
            F.concat(F.lit("c"), _s("conv_id"), F.lit("_"), _s("turn")).alias("id"),
            F.when(F.col("turn") % 4 != 3, F.col("role")).alias("author"),
            F.when(F.col("turn") % 3 == 2, "[deleted]").otherwise(F.col("text")).alias("body"),
            (F.col("turn") * 2).alias("score"),
        ).alias("data"),
    )
    per = c.groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("text"),
        F.array_sort(F.collect_list(F.struct("turn", comment.alias("c")))).alias("all"),
    )
    children = F.transform(F.filter("all", lambda x: x["turn"] > 0), lambda x: x["c"])
    post = F.struct(F.struct(F.array(F.struct(F.struct(
        F.concat(F.lit("Post "), _s("conv_id")).alias("title"), F.lit("op").alias("author"),
        F.when(F.col("conv_id") % 2 == 0, F.col("text")).otherwise("").alias("selftext"),
        F.col("conv_id").alias("score"), F.lit("sub").alias("subreddit"),
        F.lit("https://x.example/l").alias("url"), F.concat(F.lit("/r/sub/"), _s("conv_id")).alias("permalink"),
        (F.lit(1704067200) + F.col("conv_id")).alias("created_utc"),
    ).alias("data"))).alias("children")).alias("data"))
    replies = F.struct(F.struct(children.alias("children")).alias("data"))
    body = F.concat(F.lit("["), F.to_json(post), F.lit(","), F.to_json(replies), F.lit("]"))
    url = F.concat(F.lit("https://www.reddit.com/r/sub/comments/"), _s("conv_id"))
    return per.select("conv_id", url.alias("url"), F.lit(200).alias("status"), body.alias("body"))


@query("forum_posts", """WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE turn > 0 AND turn % 5 <> 4),
 k AS (SELECT * FROM c WHERE rn <= 25),
 l AS (SELECT conv_id, count(*) AS n, string_agg(CASE WHEN turn % 3 = 2 AND turn % 2 = 0 THEN '[recovered] arch (' || (turn * 2) || ' pts): ' || upper(role)
    ELSE CASE WHEN turn % 4 = 3 THEN '[deleted]' ELSE role END || ' (' || (turn * 2) || ' pts): ' || CASE WHEN turn % 3 = 2 THEN '[deleted]' ELSE text END END, chr(10) || chr(10) ORDER BY turn) AS txt FROM k GROUP BY conv_id),
 p AS (SELECT conv_id, min_by(text, turn) AS text FROM conversations GROUP BY conv_id),
 r AS (SELECT p.conv_id, CASE WHEN p.conv_id % 2 = 0 AND p.text <> '' THEN p.text || chr(10) || chr(10) || '---' || chr(10) ELSE '' END || 'Score: ' || p.conv_id || ' | ' || coalesce(n, 0) || ' comments' || chr(10) || chr(10) || coalesce(txt, '') AS content FROM p LEFT JOIN l USING (conv_id))
SELECT 'Post ' || conv_id AS title, md5(content) AS digest, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens,
 strftime(make_timestamp((1704067200 + conv_id) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS published_at, 'r/sub post by u/op (' || conv_id || ' points)' AS description FROM r""")
def _(spark, sf):
    arch = conversations(spark, sf).filter("turn % 2 = 0").select(
        F.concat(F.lit("c"), _s("conv_id"), F.lit("_"), _s("turn")).alias("id"),
        F.lit("arch").alias("author"), F.upper("role").alias("body"))
    out = P.forum_posts(forum_payloads(spark, sf), arch, P.PREVIEW)
    return out.select("title", F.md5("content").alias("digest"), "tokens", "published_at", "description")


def items(spark, sf):
    i = F.col("c_custkey")
    body = F.to_json(F.struct(
        F.when(i % 11 != 0, F.col("c_mktsegment")).alias("by"), F.col("c_name").alias("title"),
        F.when(i % 2 == 0, F.concat(F.lit("text "), _s("c_custkey"))).alias("text"),
        F.when(i % 3 == 0, "https://l.example/x").alias("url"), (i % 50).alias("score"),
        (i % 9).alias("descendants"), F.lit("story").alias("type"), (F.lit(1704067200) + i).alias("time"),
        F.when(i % 7 == 0, True).alias("deleted"), F.when(i % 13 > 0, F.sequence(i + 1, i + i % 13)).otherwise(F.array().cast("array<bigint>")).alias("kids")))
    return D.table(spark, sf, "customer").select(i.alias("id"), body.alias("body"))


@query("news_items", """WITH it AS (SELECT c_custkey AS id, c_mktsegment AS seg, c_name AS name, c_custkey % 13 AS nk FROM customer),
 k AS (SELECT it.id, t.i, o.id AS kid, CASE WHEN o.id % 11 = 0 THEN '[deleted]' ELSE o.seg END || ': ' || CASE WHEN o.id % 2 = 0 THEN 'text ' || o.id ELSE '[deleted]' END AS line
   FROM it, unnest(range(1, 11)) AS t(i) JOIN it o ON o.id = it.id + t.i WHERE t.i <= it.nk AND o.id % 7 <> 0),
 l AS (SELECT id, string_agg(line, chr(10) || chr(10) ORDER BY i) AS txt FROM k GROUP BY id),
 r AS (SELECT it.*, CASE WHEN id % 2 = 0 THEN 'text ' || id || chr(10) || chr(10) ELSE '' END || 'Score: ' || (id % 50) || ' | ' || nk || ' comments' || coalesce(chr(10) || chr(10) || '---' || chr(10) || txt, '') AS content FROM it LEFT JOIN l USING (id))
SELECT name AS title, CASE WHEN id % 11 <> 0 THEN seg END AS author, md5(content) AS digest, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS links, 'https://news.ycombinator.com/item?id=' || id AS canonical FROM r""")
def _(spark, sf):
    i = items(spark, sf)
    pages = i.select(F.concat(F.lit("https://news.ycombinator.com/item?id="), _s("id")).alias("url"))
    return P.news_items(pages, i, P.PREVIEW).select(
        "title", "author", F.md5("content").alias("digest"), F.size("links").alias("links"), "canonical")


@query("news_front", """WITH p AS (SELECT n_nationkey AS n FROM nation), s AS (SELECT n, t.i, n * 3 + t.i AS id FROM p, unnest(range(0, 10)) AS t(i)),
 j AS (SELECT n, i, c.*, row_number() OVER (PARTITION BY n ORDER BY i) AS rn FROM s JOIN customer c ON c_custkey = id)
SELECT 'https://news.ycombinator.com/?p=' || n AS url, string_agg(rn || '. ' || c_name || ' (' || (c_custkey % 50) || ' pts, ' || (c_custkey % 9) || ' comments) by ' || CASE WHEN c_custkey % 11 = 0 THEN '[deleted]' ELSE c_mktsegment END, chr(10) ORDER BY rn) AS content,
 'Top ' || count(*) || ' stories' AS description FROM j GROUP BY n""")
def _(spark, sf):
    n = F.col("n_nationkey")
    pages = D.table(spark, sf, "nation").select(
        F.concat(F.lit("https://news.ycombinator.com/?p="), n.cast("string")).alias("url"),
        F.to_json(F.sequence(n * 3, n * 3 + 20)).alias("body"))
    return P.news_front(pages, items(spark, sf), P.PREVIEW).select("url", "content", "description")


def doc_payloads(spark, sf):
    """One payload per document, its shape by the document's number."""
    d = D.table(spark, sf, "documents")
    k, i = F.col("doc_id") % 8, F.col("doc_id").cast("string")
    sid = F.concat(F.lit("p"), i)

    def js(**cols):
        return F.to_json(F.struct(*[v.alias(n) for n, v in cols.items()]))

    listing = js(data=F.struct(F.transform(F.sequence(F.lit(1), F.lit(1) + F.col("doc_id") % 30), lambda n: F.struct(F.struct(
        F.concat(F.lit("t"), n.cast("string")).alias("title"), n.alias("score"), F.concat(F.lit("/r/a/"), n.cast("string")).alias("permalink")).alias("data"))).alias("children")))
    cites = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda n: F.struct(
        F.concat(F.lit("s"), n.cast("string")).alias("title"), F.concat(F.lit("https://s/"), n.cast("string")).alias("url")))
    body = (
        F.when(k == 0, listing)
        .when(k == 1, js(title=sid, author_name=F.col("lang"), author_url=F.lit("https://v/c"), thumbnail_url=F.lit("https://v/t")))
        .when(k == 2, js(title=sid, extract=F.col("text"), description=F.col("lang"),
                         content_urls=F.struct(F.struct(F.lit("https://w/p").alias("page")).alias("desktop"))))
        .when(k == 3, js(page=F.struct(F.col("text").alias("content"), cites.alias("citations"),
                                       F.struct((F.col("doc_id") * 1000).alias("totalViews")).alias("stats"))))
        .when(k == 4, js(results=F.array(F.struct(sid.alias("title"), sid.alias("slug"), F.lit(1234567).alias("viewCount"),
                                                  F.lit("a <em>b</em>\nc").alias("snippet")))))
        .when(k == 5, js(stats=F.struct((F.col("doc_id") * 10).alias("totalPages"), F.lit("3221225472").alias("indexSizeBytes")),
                         edits=F.struct(F.array(F.struct(F.lit("A_b").alias("slug"), F.lit("EDIT_REQUEST_TYPE_FIX_TYPO").alias("type"))).alias("editRequests"))))
        .when(k == 6, js(tweet=F.struct(F.col("text").alias("text"), (F.col("doc_id") * 100).alias("likes"),
                                        F.struct(F.lit("Ann").alias("name"), F.lit("ann").alias("screen_name")).alias("author"))))
        .otherwise(F.concat(F.lit('0:["x"]\n1a:T'), F.lower(F.hex(F.octet_length("text") + 6)), F.lit(",# Hi\n\n"), F.col("text"),
                            F.lit('\n2:["$"]\n3:T5,abcde\n4:["y"]')))
    )
    url = (
        F.when(k == 0, F.concat(F.lit("https://www.reddit.com/r/a"), i, F.lit("/")))
        .when(k == 1, F.concat(F.lit("https://youtu.be/"), i))
        .when(k == 2, F.concat(F.lit("https://en.wikipedia.org/wiki/"), sid))
        .when(k == 3, F.concat(F.lit("https://grokipedia.com/wiki/A_"), i))
        .when(k == 4, F.concat(F.lit("https://grokipedia.com/search?q=a%20"), i))
        .when(k == 5, F.concat(F.lit("https://grokipedia.com/?"), i))
        .when(k == 6, F.concat(F.lit("https://x.com/ann/status/"), i))
        .otherwise(F.concat(F.lit("https://deepwiki.com/o/r"), i))
    )
    return d.select("doc_id", url.alias("url"), F.lit(200).alias("status"), body.alias("body"))


@query("route_payloads", """
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'forum' WHEN 1 THEN 'video' WHEN 2 THEN 'encyclopedia' WHEN 3 THEN 'articles' WHEN 4 THEN 'articles' WHEN 5 THEN 'articles' WHEN 6 THEN 'social' ELSE 'wiki' END AS route FROM documents""")
def _(spark, sf):
    return doc_payloads(spark, sf).select("doc_id", P.route("url").alias("route"))


_PAYLOADS = r"""WITH d AS (SELECT *, doc_id % 8 AS k, 'p' || doc_id AS sid, chr(10) AS nl FROM documents),
 r AS (SELECT k, CASE k WHEN 0 THEN 'https://www.reddit.com/r/a' || doc_id || '/' WHEN 1 THEN 'https://youtu.be/' || doc_id WHEN 2 THEN 'https://en.wikipedia.org/wiki/' || sid
   WHEN 3 THEN 'https://grokipedia.com/wiki/A_' || doc_id WHEN 4 THEN 'https://grokipedia.com/search?q=a%20' || doc_id WHEN 5 THEN 'https://grokipedia.com/?' || doc_id
   WHEN 6 THEN 'https://x.com/ann/status/' || doc_id ELSE 'https://deepwiki.com/o/r' || doc_id END AS url,
  CASE k WHEN 0 THEN 'r/a' || doc_id WHEN 3 THEN 'A ' || doc_id WHEN 4 THEN 'Grokipedia search: "a ' || doc_id || '"' WHEN 5 THEN 'Grokipedia'
   WHEN 6 THEN CASE WHEN text = '' THEN 'Tweet by Ann (@ann)' ELSE 'Ann (@ann): ' || text[1:80] || CASE WHEN length(text) > 80 THEN '…' ELSE '' END END WHEN 7 THEN 'Hi — o/r' || doc_id || ' | DeepWiki' ELSE sid END AS title,
  CASE k WHEN 0 THEN (SELECT string_agg(n || '. t' || n || ' (' || n || ' pts, 0 comments) by u/[deleted]', chr(10) ORDER BY n) FROM unnest(range(1, least(doc_id % 30 + 2, {items} + 1))) AS t(n))
   WHEN 1 THEN 'Title: ' || sid || nl || 'Author: ' || lang || nl || 'Channel: https://v/c' WHEN 2 THEN text
   WHEN 3 THEN CASE WHEN length(text) > {chars} THEN text[1:{chars}] || nl || nl || '[Truncated — full article is ' || length(text) || ' chars. 12 citations available.]' ELSE text END || nl || nl || '## Sources' || nl
     || (SELECT string_agg(n || '. [s' || n || '](https://s/' || n || ')', chr(10) ORDER BY n) FROM unnest(range(1, {sources} + 1)) AS t(n)) || CASE WHEN doc_id > 0 THEN nl || nl || 'Views: ' || format('{:,}', doc_id * 1000) || ' | Quality: N/A | Language: en' ELSE '' END
   WHEN 4 THEN '1. **[' || sid || '](https://grokipedia.com/wiki/' || sid || ')** (1,234,567 views)' || nl || '   a **b** c'
   WHEN 5 THEN '# Grokipedia' || nl || nl || 'An open source, comprehensive collection of all knowledge.' || nl || nl || '**' || format('{:,}', doc_id * 10) || ' articles** | **3.0 GB index**' || nl || nl || '## Recent Activity' || nl || '- **A b** — edited by Anonymous (fix typo)' || nl
   WHEN 6 THEN '**Ann** (@ann)' || CASE WHEN text <> '' THEN nl || nl || text ELSE '' END || CASE WHEN doc_id > 0 THEN nl || format('{:,}', doc_id * 100) || ' likes' ELSE '' END
   END AS content FROM d)
SELECT url, title, md5(content) AS digest, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM r WHERE k <> 7 AND NOT (k = 6 AND title IS NULL)"""


def payload_sql(items, chars, sources):
    """SQL of all routes but wiki bodies, which ``wiki_streams`` has, under the given limits."""
    return _PAYLOADS.replace("{items}", str(items)).replace("{chars}", str(chars)).replace("{sources}", str(sources))


@query("normalise_payloads", payload_sql(25, 20000, 10))
def _(spark, sf):
    out = P.normalise_payloads(doc_payloads(spark, sf), P.PREVIEW).filter("route <> 'wiki'")
    return out.select("url", "title", F.md5("content").alias("digest"), "tokens")


@query("wiki_links", r"""WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS i, chr(10) AS nl, text FROM documents WHERE doc_id % 8 = 7),
 t AS (SELECT *, 'https://deepwiki.com/o/r' || i AS url FROM d)
SELECT url, md5('# Hi' || nl || nl || text || nl || '[code](https://github.com/o/r' || i || '/blob/main/src/a' || i || '.ts) [part](https://deepwiki.com/o/r' || i
  || '/p' || i || ') [page](https://deepwiki.com/o/r' || i || '/Page_' || i || ') [out](https://e.example/' || i || '.md)') AS digest FROM t""")
def _(spark, sf):
    """All wiki bodies, each with a link of every kind that is rewritten and one that is not."""
    d = D.table(spark, sf, "documents").filter("doc_id % 8 = 7").withColumn("i", _s("doc_id"))
    text = F.concat("text", F.lit("\n[code](src/a"), "i", F.lit(".ts) [part](#p"), "i", F.lit(") [page](Page_"), "i",
                    F.lit(") [out](https://e.example/"), "i", F.lit(".md)"))
    body = F.concat(F.lit('0:["x"]\n1a:T'), F.lower(F.hex(F.octet_length("text") + 6)), F.lit(",# Hi\n\n"), F.col("text"),
                    F.lit('\n2:["$"]\n3:T5,abcde\n4:["y"]'))
    rows = d.withColumn("text", text).select(
        "doc_id", F.concat(F.lit("https://deepwiki.com/o/r"), "i").alias("url"), F.lit(200).alias("status"), body.alias("body"))
    out = P.normalise_payloads(rows).filter("route = 'wiki'")
    return out.select("url", F.md5("content").alias("digest"))


@query("wiki_streams", r"""WITH d AS (SELECT doc_id, '# Hi' || chr(10) || chr(10) || text AS t FROM documents WHERE doc_id % 8 = 7),
 m AS (SELECT doc_id, t, 'o/r' || doc_id AS slug, regexp_replace(t, '\]\((https?://)', ']' || chr(1) || '\1', 'g') AS a FROM d WHERE length(t) >= 50),
 f AS (SELECT *, regexp_replace(a, '\[([^\]]+)\]\(([^)]+\.(?:ts|js|md|json|tsx|jsx|py|rs|go|toml|yaml|yml|css|html))\)', '[\1]' || chr(1) || 'https://github.com/' || slug || '/blob/main/\2)', 'g') AS b FROM m),
 g AS (SELECT *, regexp_replace(regexp_replace(b, '\[([^\]]+)\]\(#([^)]*)\)', '[\1]' || chr(1) || 'https://deepwiki.com/' || slug || '/\2)', 'g'),
   '\[([^\]]+)\]\(([^)]+)\)', '[\1]' || chr(1) || 'https://deepwiki.com/' || slug || '/\2)', 'g') AS c FROM f)
SELECT 'https://deepwiki.com/' || slug AS url, 'Hi — ' || slug || ' | DeepWiki' AS title, md5(replace(c, chr(1), '(')) AS digest FROM g""")
def _(spark, sf):
    out = P.normalise_payloads(doc_payloads(spark, sf)).filter("route = 'wiki'")
    return out.select("url", "title", F.md5("content").alias("digest"))


@query("whole_payloads", payload_sql(10 ** 9, 10 ** 9, 12))
def _(spark, sf):
    """Every listing, article and post without limits."""
    out = P.normalise_payloads(doc_payloads(spark, sf)).filter("route <> 'wiki'")
    return out.select("url", "title", F.md5("content").alias("digest"), "tokens")


@query("whole_listings", """SELECT 'https://www.reddit.com/r/a' || doc_id || '/' AS url,
 (SELECT string_agg(n || '. t' || n || ' (' || n || ' pts, 0 comments) by u/[deleted]', chr(10) ORDER BY n) FROM unnest(range(1, doc_id % 30 + 2)) AS t(n)) AS content
FROM documents WHERE doc_id % 8 = 0""")
def _(spark, sf):
    out = P.normalise_payloads(doc_payloads(spark, sf))
    return out.filter("route = 'forum'").select("url", "content")


def social_payloads(spark, sf):
    """One social post per document, with and without author, article, quoted post and photos."""
    d = D.table(spark, sf, "documents").withColumn("i", _s("doc_id"))
    n = F.col("doc_id")

    def block(kind, text):
        return F.struct(F.lit(kind).alias("type"), (F.lit(text) if isinstance(text, str) else text).alias("text"))

    blocks = F.array(
        block("header-one", "Top"), block("unstyled", F.col("text")), block("unordered-list-item", "a"), block("ordered-list-item", "b"),
        block("header-two", ""), block("blockquote", "c"), block("header-two", "d"), block("header-three", "e"))
    author = F.struct(
        F.lit("Ann B").alias("name"), F.lit("ann").alias("screen_name"), F.when(n % 2 == 0, "About me").alias("description"),
        (n % 11 * 1234).alias("followers"),
        F.when(n % 2 == 1, F.struct(F.concat(F.lit("https://a.example/"), "i").alias("url"),
                                    F.when(n % 4 == 1, "a.example").alias("display_url"))).alias("website"))
    article = F.when(n % 3 == 0, F.struct(
        F.concat(F.lit("Art "), "i").alias("title"), F.struct(blocks.alias("blocks")).alias("content"), F.lit(None).cast("string").alias("preview_text"),
        F.struct(F.struct(F.concat(F.lit("https://m/"), "i").alias("original_img_url")).alias("media_info")).alias("cover_media"),
    )).when(n % 3 == 2, F.struct(
        F.lit(None).cast("string").alias("title"), F.lit(None).alias("content"), F.col("lang").alias("preview_text"), F.lit(None).alias("cover_media")))
    quote = F.when(n % 4 == 1, F.struct(F.struct(F.lit("Bo").alias("name"), F.lit("bo").alias("screen_name")).alias("author"), F.col("text").alias("text"))).when(
        n % 4 == 2, F.struct(F.lit(None).alias("author"), F.lit("mine").alias("text")))
    photos = F.when(n % 6 > 0, F.transform(F.sequence(F.lit(1), (n % 6).cast("int")), lambda p: F.struct(
        F.concat(F.lit("https://p/"), p.cast("string")).alias("url"))))
    tweet = F.struct(
        F.when(n % 5 != 4, F.col("text")).alias("text"), F.struct(F.col("text").alias("text")).alias("raw_text"),
        F.when(n % 7 != 0, author).alias("author"), (n * 100).alias("likes"), (n % 3).alias("retweets"), (n * 1000).alias("views"),
        (n % 2).alias("bookmarks"), article.alias("article"), quote.alias("quote"), F.struct(photos.alias("photos")).alias("media"),
        F.lit("2024-01-01").alias("created_at"))
    return d.select(
        F.concat(F.lit("https://x.com/u"), "i", F.lit("/status/"), "i").alias("url"), F.lit(200).alias("status"),
        F.to_json(F.struct(tweet.alias("tweet"))).alias("body"))


@query("social_posts", """WITH d AS (SELECT *, CAST(doc_id AS VARCHAR) AS i, doc_id % 7 <> 0 AS known, chr(10) AS nl, doc_id AS n, nullif(text, '') AS t FROM documents),
 w AS (SELECT *, CASE WHEN known THEN 'Ann B (@ann)' ELSE 'u' || i END AS who FROM d)
SELECT 'https://x.com/u' || i || '/status/' || i AS url,
  CASE WHEN n % 3 = 0 THEN 'Art ' || i WHEN t IS NULL THEN 'Tweet by ' || who ELSE who || ': ' || t[1:80] || CASE WHEN length(t) > 80 THEN '…' ELSE '' END END AS title,
  CASE WHEN known THEN 'Ann B' ELSE 'u' || i END AS author, t[1:200] AS description, CASE WHEN n % 3 = 1 THEN 'social' ELSE 'article' END AS type,
  concat_ws(nl, CASE WHEN known THEN '**Ann B** (@ann)' END, CASE WHEN known AND n % 2 = 0 THEN 'About me' END,
    CASE WHEN known AND n % 11 > 0 THEN 'Followers: ' || format('{:,}', n % 11 * 1234) END, nl || t,
    nullif(concat_ws(' · ', CASE WHEN n > 0 THEN format('{:,}', n * 100) || ' likes' END, CASE WHEN n % 3 > 0 THEN (n % 3) || ' RTs' END,
      CASE WHEN n > 0 THEN format('{:,}', n * 1000) || ' views' END, CASE WHEN n % 2 > 0 THEN '1 bookmarks' END), ''),
    CASE n % 3 WHEN 0 THEN nl || '## Art ' || i WHEN 2 THEN nl || '## Article' END,
    CASE n % 3 WHEN 0 THEN concat_ws(nl, nl || '# Top', t, '• a', '1. b', '> c', nl || '## d', nl || '### e') WHEN 2 THEN nullif(lang, '') END,
    CASE n % 4 WHEN 1 THEN nl || '> Quoting Bo (@bo):' || nl || '> ' || coalesce(t, '') WHEN 2 THEN nl || '> Quoting Unknown:' || nl || '> mine' END) AS content,
  CASE WHEN known AND n % 2 = 1 THEN CASE WHEN n % 4 = 1 THEN 'a.example' ELSE 'Website' END || ' https://a.example/' || i ELSE '' END AS links,
  concat_ws(nl, nullif(array_to_string(list_transform(range(1, n % 6 + 1), lambda p: 'Tweet image https://p/' || p), chr(10)), ''),
    CASE WHEN n % 3 = 0 THEN 'Art ' || i || ' https://m/' || i END) AS images
FROM w""")
def _(spark, sf):
    """Every document as a social post, with its whole article, quote, link and all photos."""
    out = P.normalise_payloads(social_payloads(spark, sf))

    def joined(column, *fields):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(" ", *[x[f] for f in fields])), "\n")

    return out.select("url", "title", "author", "description", "type", "content",
                      joined("links", "text", "href").alias("links"), joined("images", "alt", "src").alias("images"))
