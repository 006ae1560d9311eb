"""Checks of the page jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.checks.base import query
from wiretally.checks.sqlparts import EXR, PAGES, WITH, WS, lit, tag_sql
from wiretally.functions import bodies, text, urls
from wiretally.functions import pages as G
from wiretally.operators import passive_index, read_pages, registry, triage
from wiretally.sources import derived as D


def responses(spark, sf):
    return D.page_responses(spark, sf)


def _entities(expr: str) -> str:
    expr = f"replace({expr}, '&amp;', chr(57363))"
    for name, ch in G.ENTITIES.items():
        if name != "&amp;":
            expr = f"replace({expr}, {lit(name)}, {lit(ch)})"
    return f"replace({expr}, chr(57363), '&')"


def _group(expr: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({expr}, {lit(pattern)}, {group})[1]"


def _trim(expr: str) -> str:
    return f"regexp_replace({expr}, {lit(f'^{WS}+|{WS}+$')}, '', 'g')"


def _strip(expr: str) -> str:
    return f"regexp_replace({expr}, '<[^>]*>', '', 'g')"


def _meta(attr: str, value: str) -> str:
    v = value.replace(".", r"\.")
    one = _group("html", rf"""(?i)<meta\s+{attr}=["']{v}["']\s+content=["']([^"']*)["']""")
    two = _group("html", rf"""(?i)<meta\s+content=["']([^"']*)["']\s+{attr}=["']{v}["']""")
    return _entities(f"coalesce({one}, {two})")


def _clean_sql() -> str:
    expr = "html"
    for tag in K.NOISE_TAGS:
        expr = f"regexp_replace({expr}, {lit(f'(?is)<{tag}({WS}|>).*?</{tag}>')}, '', 'g')"
        expr = f"regexp_replace({expr}, {lit(f'(?i)<{tag}(({WS}|/)[^>]*)?>')}, '', 'g')"
    return expr


_PR = f"""WITH pr AS ({PAGES}),
 cl AS (SELECT *, {_clean_sql()} AS clean FROM pr),
 rt AS (SELECT *, coalesce({_group('clean', f'(?is){tag_sql("article")}(.*?)</article>', 2)},
   {_group('clean', f'(?is){tag_sql("main")}(.*?)</main>', 2)},
   {_group('clean', f'(?is){tag_sql("body")}(.*?)</body>', 2)}, clean) AS root FROM cl),
 tx AS (SELECT *, {_trim(f"regexp_replace({_strip('root')}, {lit(WS + '+')}, ' ', 'g')")} AS txt FROM rt)"""


@query("page_head", f"""{_PR}
SELECT page_id, {_entities(_trim(_group('html', f'(?is){tag_sql("title")}(.*?)</title>', 2)))} AS title,
  {_meta('property', 'og:title')} AS og_title, {_meta('property', 'og:type')} AS og_type, {_meta('name', 'author')} AS author,
  {_group('html', '(?i)<link rel="canonical" href="([^"]*)"')} AS canonical FROM pr""")
def _(spark, sf):
    return responses(spark, sf).select("page_id", G.page_head("html").alias("h")).select(
        "page_id", "h.title", "h.og_title", "h.og_type", "h.author", "h.canonical"
    )


@query("strip_noise", f"{_PR} SELECT page_id, md5(clean) AS digest, length(clean) AS chars FROM cl")
def _(spark, sf):
    c = responses(spark, sf).select("page_id", G.strip_noise("html").alias("c"))
    return c.select("page_id", F.md5("c").alias("digest"), F.length("c").cast("bigint").alias("chars"))


@query("page_text", f"""{_PR}
SELECT page_id, md5(txt) AS digest, length(txt) AS chars, CAST(ceil(length(txt) / 4.0) AS BIGINT) AS tokens,
  length(txt) < 200 AND ({' OR '.join(f"contains(html, {lit(m)})" for m in K.SPA_MARKERS)}) AS spa_shell FROM tx""")
def _(spark, sf):
    r = read_pages.with_root(responses(spark, sf)).withColumn("t", G.page_text("root"))
    return r.select(
        "page_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("chars"),
        text.token_cost("t").alias("tokens"), G.is_spa_shell("html", "root").alias("spa_shell"),
    )


_A = rf"""(?is)<a{WS}+[^>]*href=["']([^"']*)["'][^>]*>(.*?)</a>"""


@query("page_links", f"""{_PR},
 l AS (SELECT page_id, regexp_extract_all(html, {lit(_A)}, 1) AS hs, regexp_extract_all(html, {lit(_A)}, 2) AS ts FROM pr),
 z AS (SELECT page_id, t.i AS pos, {_entities('hs[t.i]')} AS href, {_trim(_strip('ts[t.i]'))} AS text FROM l, unnest(range(1, len(hs) + 1)) AS t(i))
SELECT page_id, text, href, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos FROM z WHERE text <> '' AND href <> ''""")
def _(spark, sf):
    return responses(spark, sf).select("page_id", F.posexplode(G.page_links("html")).alias("p", "l")).select(
        "page_id", "l.text", "l.href", F.col("p").cast("bigint").alias("pos")
    )


@query("page_images", f"""{_PR}
SELECT page_id, 'pic' AS alt, '/i/' || page_id || '.png' AS src FROM pr WHERE page_id % 10 NOT IN (3, 5, 7) AND contains(html, '<img')""")
def _(spark, sf):
    return responses(spark, sf).select("page_id", F.explode(G.page_images("html")).alias("i")).select(
        "page_id", "i.alt", "i.src"
    )


@query("page_headings", f"""{_PR},
 l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h1>.*?</h1>|<h2>.*?</h2>|<h3>.*?</h3>|<h4>.*?</h4>|<h5>.*?</h5>|<h6>.*?</h6>')) AS h FROM pr)
SELECT page_id, CAST(h[3] AS INTEGER) AS level, {_trim(_strip('h'))} AS text FROM l""")
def _(spark, sf):
    return responses(spark, sf).select("page_id", F.explode(G.page_headings("html")).alias("h")).select(
        "page_id", "h.level", "h.text"
    )


@query("page_tables", f"""{_PR}
SELECT page_id, r, cells FROM (SELECT page_id, unnest([0, 1, 2]) AS r, unnest(['k|v', 'id|' || page_id, 'one|']) AS cells
 FROM pr WHERE page_id % 10 NOT IN (3, 5, 7) AND contains(html, '<table>'))""")
def _(spark, sf):
    t = responses(spark, sf).select("page_id", F.explode(G.page_tables("html")).alias("t"))
    return t.select("page_id", F.posexplode("t").alias("r", "row")).select(
        "page_id", "r", F.array_join("row", "|").alias("cells")
    )


@query("page_elements", f"""{_PR},
 l AS (SELECT page_id, regexp_extract_all(html, '<(a [^>]*href=[^>]*|input[^>]*)>', 1)[:100] AS tags FROM pr)
SELECT page_id, count(*) AS n, CAST(sum(CASE WHEN tag LIKE 'a %' THEN 1 ELSE 0 END) AS BIGINT) AS anchors,
  CAST(sum(CASE WHEN contains(tag, 'type="password"') THEN 1 ELSE 0 END) AS BIGINT) AS passwords
FROM (SELECT page_id, unnest(tags) AS tag FROM l) GROUP BY page_id""")
def _(spark, sf):
    e = responses(spark, sf).select("page_id", F.explode(G.page_elements("html", K.ELEMENT_LIMIT)).alias("e"))
    return e.groupBy("page_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("e.tag") == "a").alias("anchors"),
        F.count_if(F.col("e.type") == "password").alias("passwords"),
    )


def _attrs(name: str) -> str:
    return f"<{name}(?:{WS}[^>]*)?>"


def _rewritten(expr: str, pattern: str, rewrite: str, groups: tuple[int, ...] = (1,)) -> str:
    """``expr`` with every match replaced by ``rewrite`` over g1, g2 (the groups) and n (its number)."""
    found = ", ".join(f"regexp_extract_all({expr}, {lit(pattern)}, {g})" for g in groups)
    for at, g in enumerate(groups):
        rewrite = rewrite.replace(f"{{g{at + 1}}}", f"z[{at + 2}]")
    return (f"array_to_string(list_transform(list_zip(string_split_regex({expr}, {lit(pattern)}), {found}), "
            f"lambda z, n: z[1] || coalesce({rewrite}, '')), '')")


def _clean_text(expr: str) -> str:
    return _trim(_strip(expr))


def _table_sql(inner: str) -> str:
    cells = (f"list_transform(regexp_extract_all(tr, {lit('(?is)' + _attrs('(?:td|th)') + '(.*?)</(?:td|th)>')}, 1), "
             f"lambda td: {_clean_text('td')})")
    rows = (f"list_filter(list_transform(regexp_extract_all({inner}, {lit('(?is)' + _attrs('tr') + '(.*?)</tr>')}, 1), "
            f"lambda tr: {cells}), lambda r: len(r) > 0)")
    width = "list_max(list_transform(rs, lambda r: len(r)))"
    line = f"'| ' || array_to_string(list_resize(r, {width}, ''), ' | ') || ' |' || chr(10)"
    rule = f"'|' || repeat(' --- |', {width}) || chr(10)"
    lines = f"list_transform(rs, lambda r, i: {line} || CASE WHEN i = 1 THEN {rule} ELSE '' END)"
    return (f"list_transform([{rows}], lambda rs: CASE WHEN len(rs) > 0 THEN chr(10) || chr(10) "
            f"|| rtrim(array_to_string({lines}, ''), chr(10)) || chr(10) || chr(10) ELSE '' END)[1]")


def _list_sql(inner: str, mark: str) -> str:
    items = _rewritten(inner, f"(?is){_attrs('li')}(.*?)</li>", f"{mark} || {_clean_text('{g1}')} || chr(10)")
    # its own lambda names: it stands inside another rewrite
    items = items.replace("lambda z, n:", "lambda y, m:").replace("z[1]", "y[1]").replace("z[2]", "y[2]")
    return items


def _framed_sql(text: str) -> str:
    return f"chr(10) || chr(10) || {text} || chr(10) || chr(10)"


def _markdown_ctes(source: str, root: str) -> str:
    """CTEs ``m0 … md``: ``root`` of ``source`` becomes ``m`` (Markdown), with its ``links`` and ``images``."""
    tag = "(?is)" + "{}" + "(.*?)</{}>"

    def paired(name: str) -> str:
        return tag.format(_attrs(name), name)

    steps = [(paired(f"h{n}"), _framed_sql(f"'{'#' * n} ' || {_clean_text('{g1}')}"), (1,)) for n in range(1, 7)]
    quote = f"'> ' || replace({_clean_text('{g1}')}, chr(10), chr(10) || '> ')"
    fence = "'```' || chr(10) || {} || chr(10) || '```'"
    steps += [
        (paired("blockquote"), _framed_sql(quote), (1,)),
        (rf"(?is){_attrs('pre')}{WS}*{_attrs('code')}(.*?)</code>{WS}*</pre>",
         _framed_sql(fence.format(_entities(_trim("{g1}")))), (1,)),
        (paired("pre"), _framed_sql(fence.format(_entities(_clean_text("{g1}")))), (1,)),
        (paired("code"), f"'`' || {_entities('{g1}')} || '`'", (1,)),
    ]
    out, last = [f" m0 AS (SELECT *, regexp_replace({root}, '(?s)<!--.*?-->', '', 'g') AS m FROM {source})"], "m0"

    def add(expr: str, extra: str = "") -> None:
        nonlocal last
        name = f"m{len(out)}"
        out.append(f" {name} AS (SELECT * EXCLUDE (m), {expr} AS m{extra} FROM {last})")
        last = name

    for pattern, rewrite, groups in steps:
        add(_rewritten("m", pattern, rewrite, groups))
    tables = paired("table")
    add(f"array_to_string(list_transform(list_zip(string_split_regex(m, {lit(tables)}), regexp_extract_all(m, {lit(tables)}, 1)), "
        f"lambda z: z[1] || coalesce({_table_sql('z[2]')}, '')), '')")

    def attr(of: str, name: str) -> str:
        pattern = f"""(?i){name}=["']([^"']*)["']"""
        return _entities(f"regexp_extract({of}, {lit(pattern)}, 1)")

    image, link = rf"(?i)<img{WS}+[^>]*>", rf"""(?is)<a{WS}+[^>]*href=["']([^"']*)["'][^>]*>(.*?)</a>"""
    src, alt = attr("{g1}", "src"), attr("{g1}", "alt")
    pairs = f"list_transform(regexp_extract_all(m, {lit(image)}), lambda t: {attr('t', 'alt')} || chr(9) || {attr('t', 'src')})"
    add(_rewritten("m", image, f"CASE WHEN {src} <> '' THEN '![' || {alt} || '](' || {src} || ')' ELSE '' END", (0,)),
        f", array_to_string(list_filter({pairs}, lambda p: p NOT LIKE '%' || chr(9)), chr(10)) AS images")
    text, href = _clean_text("{g2}"), _entities("{g1}")
    ends = (f"list_transform(list_zip(regexp_extract_all(m, {lit(link)}, 2), regexp_extract_all(m, {lit(link)}, 1)), "
            f"lambda p: {_clean_text('p[1]')} || chr(9) || {_entities('p[2]')})")
    add(_rewritten("m", link, f"CASE WHEN {text} <> '' AND {href} <> '' THEN '[' || {text} || '](' || {href} || ')' ELSE {text} END", (1, 2)),
        f", array_to_string(list_filter({ends}, lambda p: p NOT LIKE '%' || chr(9) AND p NOT LIKE chr(9) || '%'), chr(10)) AS links")
    add(_rewritten("m", tag.format(_attrs("(?:strong|b)"), "(?:strong|b)"), f"'**' || {_strip('{g1}')} || '**'"))
    add(_rewritten("m", f"(?is){_attrs('(?:em|i)')}(|[^m].*?|m|m[^g].*?)</(?:em|i)>", f"'*' || {_strip('{g1}')} || '*'"))
    for name, mark in (("ol", "m || '. '"), ("ul", "'- '")):
        add(_rewritten("m", paired(name), _framed_sql(_clean_text(_list_sql("{g1}", mark)))))
    add(_rewritten("m", paired("p"), _framed_sql(_trim("{g1}"))))
    add(f"regexp_replace(m, {lit(rf'(?i)<br{WS}*/?>')}, chr(10), 'g')")
    add(_entities(_strip("m")))
    add(_trim(f"regexp_replace(m, '{chr(92)}n{{3,}}', chr(10) || chr(10), 'g')"))
    out.append(f" md AS (SELECT * FROM {last})")
    return ",\n".join(out)


_READ = f"""{_PR},
 rd AS (SELECT page_id, html, txt, root, coalesce(nullif({_meta('property', 'og:title')}, ''),
   {_entities(_trim(_group('html', f'(?is){tag_sql("title")}(.*?)</title>', 2)))}) AS title,
   coalesce({_meta('property', 'og:type')}, 'unknown') AS type,
   CASE WHEN page_id % 10 = 7 THEN 'spa-shell' WHEN txt = '' THEN 'og-tags-only' ELSE 'readability' END AS source
   FROM tx WHERE status = 200)"""


_MD = f"""{_READ},
{_markdown_ctes('rd', 'root')}"""


@query("page_markdown", f"{_MD} SELECT page_id, title, source, md5(m) AS digest, CAST(ceil(length(m) / 4.0) AS BIGINT) AS tokens FROM md")
def _(spark, sf):
    r = read_pages.read_pages(responses(spark, sf))
    return r.select("page_id", "title", "source", F.md5("content").alias("digest"), "tokens")


def _joined(column, *fields):
    return F.array_join(F.transform(column, lambda x: F.concat_ws("\t", *[x[f] for f in fields])), "\n")


@query("read_page_contents", f"{_MD} SELECT page_id, m AS content, links, images FROM md")
def _(spark, sf):
    """Whole content of all pages that were read, with the links and images that stand in it."""
    r = read_pages.read_pages(responses(spark, sf))
    return r.select("page_id", "content", _joined("links", "text", "href").alias("links"),
                    _joined("images", "alt", "src").alias("images"))


_BOXED = {"div": "post-content", "section": "entry-content"}


def boxed(spark, sf):
    """Pages whose article became an element named by a class, with elements of its own kind inside and behind."""
    page = responses(spark, sf).filter(F.col("html").contains("<article>"))
    tag = F.when(F.col("page_id") % 2 == 0, "div").otherwise("section")
    name = F.when(F.col("page_id") % 2 == 0, _BOXED["div"]).otherwise(_BOXED["section"])
    start = F.concat(F.lit("<"), tag, F.lit(' id="x" class="wide '), name, F.lit('"><'), tag, F.lit(">in</"), tag, F.lit(">"))
    end = F.concat(F.lit("<"), tag, F.lit("\n>deep<"), tag, F.lit(">er</"), tag, F.lit("></"), tag, F.lit("></"), tag,
                   F.lit("><"), tag, F.lit(">behind</"), tag, F.lit(">"))
    html = F.replace(F.replace("html", F.lit("<article>"), start), F.lit("</article>"), end)
    return page.select("page_id", "url", "status", "headers", html.alias("html"))


@query("nested_roots", f"""{_PR},
 bx AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'div' ELSE 'section' END AS t, {_group('clean', '(?s)<article>(.*?)</article>')} AS x FROM cl WHERE contains(html, '<article>')),
 nr AS (SELECT page_id, '<' || t || '>in</' || t || '>' || x || '<' || t || chr(10) || '>deep<' || t || '>er</' || t || '></' || t || '>' AS root FROM bx)
SELECT page_id, md5(root) AS digest, length(root) AS chars FROM nr""")
def _(spark, sf):
    """Content roots that are named by a class and hold elements of their own kind."""
    r = read_pages.with_root(boxed(spark, sf))
    return r.select("page_id", F.md5("root").alias("digest"), F.length("root").cast("bigint").alias("chars"))


@query("read_pages", f"{_READ} SELECT page_id, title, type, source, CAST(ceil(length(html) / 4.0) AS BIGINT) AS html_tokens FROM rd")
def _(spark, sf):
    r = read_pages.read_pages(responses(spark, sf))
    return r.select("page_id", "title", "type", "source", "html_tokens")


@query("savings_vs_html", f"""{_READ}
SELECT source, count(*) AS pages, CAST(sum(ceil(length(txt) / 4.0)) AS BIGINT) AS read_tokens,
  CAST(sum(ceil(length(html) / 4.0)) AS BIGINT) AS html_tokens,
  floor((1.0 - CAST(sum(ceil(length(txt) / 4.0)) AS DOUBLE) / sum(ceil(length(html) / 4.0))) * 1000 + 0.5) / 10.0 AS savings_pct
FROM rd GROUP BY source""")
def _(spark, sf):
    r = read_pages.with_root(responses(spark, sf).filter("status = 200")).withColumn(
        "t", G.page_text("root")
    )
    source = F.when(G.is_spa_shell("html", "root"), "spa-shell").when(
        F.col("t") == "", "og-tags-only").otherwise("readability")
    return read_pages.savings_by_source(
        r.select(source.alias("source"), text.token_cost("t").alias("tokens"),
                 text.token_cost("html").alias("html_tokens"))
    )


@query("savings_of_content", f"""{_MD}
SELECT source, count(*) AS pages, CAST(sum(ceil(length(m) / 4.0)) AS BIGINT) AS read_tokens,
  CAST(sum(ceil(length(html) / 4.0)) AS BIGINT) AS html_tokens,
  floor((1.0 - CAST(sum(ceil(length(m) / 4.0)) AS DOUBLE) / sum(ceil(length(html) / 4.0))) * 1000 + 0.5) / 10.0 AS savings_pct
FROM md GROUP BY source""")
def _(spark, sf):
    """Savings by the content that reading returns."""
    return read_pages.savings_by_source(read_pages.read_pages(responses(spark, sf)))


@query("peek_pages", f"""{_PR},
 p AS (SELECT *, status = 200 AND content_type = 'application/json' AS js FROM pr),
 q AS (SELECT *, CASE WHEN js THEN NULL WHEN h_cf_ray IS NOT NULL THEN 'cloudflare' WHEN h_px IS NOT NULL THEN 'perimeterx'
   WHEN h_dd IS NOT NULL THEN 'datadome' END AS bot FROM p)
SELECT page_id, status, h_server AS server, bot AS bot_protection, CASE h_powered WHEN 'Next.js' THEN 'next.js' WHEN 'Express' THEN 'express'
   WHEN 'PHP/8.1' THEN 'php' ELSE CASE WHEN h_link IS NOT NULL THEN 'wordpress' WHEN h_shopify IS NOT NULL THEN 'shopify'
   WHEN h_drupal IS NOT NULL THEN 'drupal' END END AS framework,
  js OR (status BETWEEN 200 AND 399 AND bot IS NULL) AS accessible,
  CASE WHEN js THEN 'read' WHEN status = 401 THEN 'auth_required' WHEN bot IS NOT NULL OR status IN (403, 429) OR status >= 500
   THEN 'blocked' ELSE 'read' END AS recommendation FROM q""")
def _(spark, sf):
    return triage.peek(responses(spark, sf)).drop("url", "content_type")


_FW = f"""{_PR},
 f AS (SELECT page_id, origin, name, n, ord, CASE WHEN name = 'Django' THEN 2 WHEN n >= 2 THEN 0 ELSE 1 END AS rank FROM (
   SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, unnest(['WordPress', 'Next.js', 'Drupal', 'Django', 'Nuxt', 'GraphQL', 'Shopify']) AS name,
     unnest([0, 2, 5, 7, 3, 4, 1]) AS ord,
     unnest([CAST(contains(html, '/wp-json/') AS INT) + CAST(contains(html, '/wp-content/') AS INT) + CAST(coalesce(contains(h_link, '/wp-json/'), false) AS INT),
       CAST(contains(html, '__NEXT_DATA__') AS INT) + CAST(contains(html, '/_next/') AS INT) + CAST(coalesce(h_powered = 'Next.js', false) AS INT),
       CAST(h_drupal IS NOT NULL AS INT), CAST(contains(html, 'django') AS INT), CAST(contains(html, 'nuxt-link') AS INT),
       CAST(contains(html, 'relay-') AS INT) + CAST(contains(html, 'urql') AS INT) + CAST(contains(html, '/graphql') AS INT),
       CAST(contains(html, 'shopify-section') AS INT) + CAST(contains(html, 'cdn.shopify.com') AS INT)]) AS n FROM pr) WHERE n > 0)"""


@query("page_frameworks", f"""{_FW}
SELECT page_id, name, CASE rank WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, n AS signals,
  row_number() OVER (PARTITION BY page_id ORDER BY rank, ord) - 1 AS pos FROM f""")
def _(spark, sf):
    """Frameworks of all pages from the table of rules."""
    fw = registry.detect(responses(spark, sf), ["page_id"]).select("page_id", F.posexplode("frameworks").alias("p", "f"))
    return fw.select(
        "page_id", "f.name", "f.confidence", F.size("f.signals").alias("signals"),
        F.col("p").cast("bigint").alias("pos"),
    )


@query("page_user_frameworks", f"""{_PR},
 n AS (SELECT page_id, CAST(contains(html, '<article') AND contains(lower(html), '</style>') AS INT) AS a, CAST(h_server IS NOT NULL AS INT) AS b FROM pr)
SELECT page_id, CASE WHEN a + b >= 2 THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN a = 1 AND b = 1 THEN 'styled article,server' WHEN a = 1 THEN 'styled article' ELSE 'server' END AS signals, 0 AS paths
FROM n WHERE a + b > 0""")
def _(spark, sf):
    """A detector that a user adds as rows: two texts that a page must both have, and a header."""
    mine = [(1000, "Magazine", "count", "styled article", "html", "<article", False),
            (1001, "Magazine", "count", "styled article", "html", "</STYLE>", True),
            (1002, "Magazine", "count", "server", "Server", None, False)]
    rules = registry.default_rules(spark).unionByName(spark.createDataFrame(mine, registry.RULE_SCHEMA))
    fw = registry.detect(responses(spark, sf), ["page_id"], rules).select("page_id", F.explode("frameworks").alias("f"))
    return fw.filter("f.name = 'Magazine'").select(
        "page_id", "f.confidence", F.array_join("f.signals", ",").alias("signals"), F.size("f.api_paths").alias("paths"))


@query("safe_parse_json", f"""{WITH}{EXR}
SELECT seq, CASE WHEN kind IN ('down', 'noise') THEN 'VARCHAR' ELSE json_type(CAST(resp_body AS JSON)) END AS type,
  CASE WHEN kind IN ('down', 'noise') THEN resp_body END AS text FROM exr""")
def _(spark, sf):
    """All response bodies: JSON as it is, other texts as a JSON string."""
    v = bodies.safe_parse_json("response_body")
    kind = F.schema_of_variant(v)
    return D.exchanges(spark, sf).select(
        "seq", F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").when(
            kind == "STRING", "VARCHAR").otherwise(kind).alias("type"),
        F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).alias("text"))


@query("page_auth_required", f"""{_PR}
SELECT page_id, status = 401 OR h_location IS NOT NULL OR page_id % 10 = 5 AS auth_required,
  CASE WHEN h_location IS NOT NULL THEN h_location WHEN page_id % 10 = 5 THEN '/account/login' END AS login_url,
  CASE WHEN status = 401 THEN 1 ELSE 0 END + CASE WHEN h_location IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN page_id % 10 = 5 THEN 1 ELSE 0 END AS signals,
  CASE WHEN page_id % 10 = 5 THEN 'recaptcha' END AS captcha FROM pr""")
def _(spark, sf):
    p = responses(spark, sf).withColumn("a", G.page_auth("html", "headers"))
    return p.select(
        "page_id", "a.auth_required", "a.login_url", F.size("a.signals").alias("signals"),
        G.captcha_kind("html").alias("captcha"),
    )


def _probe_ctes(paths) -> str:
    rows = ", ".join(f"({i}, {lit(p)})" for i, p in enumerate(paths))
    return f""" org AS (SELECT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, min(page_id) AS n FROM pages GROUP BY 1),
 cand(pos, path) AS (VALUES {rows}),
 probe_targets AS (SELECT origin, path, pos, n FROM org, cand),
 landed AS ({D.probes_sql(D.ANSI)})"""


def landed_probes(spark, sf, candidates=K.PROBE_PATHS):
    pages = D.table(spark, sf, "pages")
    origins = pages.groupBy(urls.url_origin("url").alias("origin")).agg(F.min("page_id").alias("n"))
    targets = origins.select("origin", "n", F.posexplode(
        F.array(*[F.lit(p) for p in candidates])).alias("pos", "path"))
    targets.createOrReplaceTempView("probe_targets")
    return triage.probe_targets(origins, candidates), spark.sql(D.probes_sql(D.SPARK)).drop("pos")


_IS_API = """(contains(content_type, 'json') OR contains(content_type, 'xml') OR (status IN (401, 403) AND NOT contains(content_type, 'html'))
   OR contains(body, '__schema') OR (body LIKE '{%' AND json_valid(body)))"""


@query("probe_results", f"""WITH {_probe_ctes(K.PROBE_PATHS)}
SELECT origin, pos, path, status, content_type, {_IS_API} AS is_api FROM landed WHERE status < 400 OR status IN (401, 403)""")
def _(spark, sf):
    targets, landed = landed_probes(spark, sf)
    return triage.probe_results(targets, landed)


@query("discovered_specs", f"""WITH {_probe_ctes(K.SPEC_PATHS)}, pr AS ({PAGES}),
 s AS (SELECT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, 'https://h/openapi.json' AS spec_url, -1 AS rank FROM pr WHERE h_link IS NOT NULL
   UNION ALL SELECT origin, origin || path, pos FROM landed WHERE status = 200 AND contains(content_type, 'json') AND body = '{{"a":1}}')
SELECT origin, spec_url, min(rank) AS rank, CASE WHEN min(rank) < 0 THEN 'link' ELSE 'probe' END AS found_by FROM s GROUP BY ALL""")
def _(spark, sf):
    targets, landed = landed_probes(spark, sf, K.SPEC_PATHS)
    spec = (F.col("status") == 200) & F.col("content_type").contains("json") & (F.col("body") == '{"a":1}')
    probes = targets.join(landed, ["origin", "path"]).withColumn("is_spec", spec)
    return triage.discovered_specs(responses(spark, sf), probes)


_DISC = f"""{_FW}, {_probe_ctes(K.PROBE_PATHS)},
 pro AS (SELECT origin, count(*) FILTER (WHERE {_IS_API}) AS api_probes FROM landed WHERE status < 400 OR status IN (401, 403) GROUP BY origin),
 spc AS (SELECT origin, n % 3 AS spec_endpoints FROM org WHERE n % 5 = 0),
 per AS (SELECT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, count(*) AS pages,
   bool_or(status = 401 OR h_location IS NOT NULL OR page_id % 10 = 5) AS auth_required FROM pr GROUP BY 1),
 bst AS (SELECT origin, min(rank) AS rank FROM f GROUP BY origin),
 nam AS (SELECT origin, string_agg(name, ',' ORDER BY rank, name) AS frameworks FROM (SELECT origin, name, min(rank) AS rank FROM f GROUP BY ALL) GROUP BY origin),
 dsc AS (SELECT per.origin, pages, CASE WHEN spec_endpoints > 0 THEN 'high' WHEN rank = 0 THEN 'medium' WHEN rank = 1 OR api_probes > 0 THEN 'low' ELSE 'none' END AS confidence,
   frameworks, coalesce(api_probes, 0) AS api_probes, auth_required
   FROM per LEFT JOIN pro USING (origin) LEFT JOIN spc USING (origin) LEFT JOIN bst USING (origin) LEFT JOIN nam USING (origin))"""


def discovery(spark, sf):
    targets, landed = landed_probes(spark, sf)
    specs = D.table(spark, sf, "pages").groupBy(urls.url_origin("url").alias("origin")).agg(
        F.min("page_id").alias("n")).filter("n % 5 = 0").select(
        "origin", (F.col("n") % 3).alias("endpoints"))
    return triage.discovery(responses(spark, sf), triage.probe_results(targets, landed), specs)


@query("site_discovery", f"{_DISC} SELECT * FROM dsc")
def _(spark, sf):
    return discovery(spark, sf)


@query("discovery_with_index", f"""{_DISC},
 hits AS (SELECT regexp_extract(url, '://([^:/?#]+)', 1) AS domain, count(*) AS total_hits, count(DISTINCT page_id % 5) AS indexed_endpoints
   FROM pr WHERE page_id % 3 <> 0 GROUP BY 1)
SELECT origin, confidence, regexp_extract(origin, '://([^:/]+)', 1) AS domain, total_hits, indexed_endpoints
FROM dsc LEFT JOIN hits ON regexp_extract(origin, '://([^:/]+)', 1) = domain""")
def _(spark, sf):
    # the index of calls that the sites' pages made: two of three answered with JSON, on five paths
    n = F.col("page_id")
    none = F.create_map().cast("map<string,string>")
    made = responses(spark, sf).select(
        F.timestamp_micros(n).cast("timestamp_ntz").alias("ts"), n.alias("ts_us"), n.alias("seq"),
        F.concat(urls.url_origin("url"), F.lit("/api/"), F.get(F.lit(["cart", "menu", "news", "stock", "team"]), (n % 5).cast("int"))).alias("url"),
        F.lit("GET").alias("method"),
        none.alias("request_headers"), none.alias("response_headers"), F.lit(200).alias("status"),
        F.when(n % 3 != 0, "application/json").otherwise("text/html").alias("content_type"))
    index = passive_index.domain_index(passive_index.passive_index(made))
    out = triage.with_passive_index(discovery(spark, sf), index)
    return out.select("origin", "confidence", "domain", "total_hits", "indexed_endpoints")


_PATHS = ", ".join(
    f"({lit(n)}, {lit(p)})" for n in ("WordPress", "Next.js", "Drupal", "Nuxt", "GraphQL", "Shopify")
    for p in K.FRAMEWORK_PATHS[n]
)


@query("predicted_endpoints", f"""{_FW}, pat(name, path) AS (VALUES {_PATHS}),
 o AS (SELECT f.origin, f.rank, f.name, pat.path FROM f JOIN pat USING (name) WHERE f.rank < 2
   UNION ALL SELECT f.origin, f.rank, f.name, '/_next/data/' || regexp_extract(html, '"buildId":"([^"]+)"', 1) || '/' FROM f JOIN pr USING (page_id)
   WHERE f.name = 'Next.js' AND contains(html, 'buildId')),
 bst AS (SELECT origin, min(rank) AS rank FROM o GROUP BY origin)
SELECT origin, 'GET' AS method, path, min(name) AS name, 'get-' || lower(regexp_replace(array_to_string(list_filter(string_split(path, '/'), lambda s: s <> ''), '-'), '[^A-Za-z0-9-]', '', 'g')) AS id
FROM o JOIN bst USING (origin, rank) GROUP BY origin, path""")
def _(spark, sf):
    p = triage.predicted_endpoints(responses(spark, sf))
    name = F.regexp_replace("signal", "discovered-from-", "")
    proper = F.lit(None).cast("string")
    for n in K.FRAMEWORK_PATHS:
        proper = F.coalesce(proper, F.when(name == n.lower(), n))
    return p.select("origin", "method", "path", proper.alias("name"), "id")


