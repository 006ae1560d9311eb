"""HTML expressions: head, noise, content root, text, links, triage marks.

Tag patterns ask for a space or ``>`` after the tag name, so ``<b`` does not match ``<body>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.functions.common import WS, c, contains_any, let, trim_ws
from wiretally.functions.headers import header, lower_keys

S = WS  # one whitespace character
ATTRS = rf"(?:{WS}[^>]*)?"

# The decoded entities
ENTITIES = {
    "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'",
    "&nbsp;": " ",
}
_AMP = "\uFDD2"

#: Attributes that name a content root, in order of precedence.
ROOT_MARKS = [
    rf"""(?i)class=["'][^"']*(?<![A-Za-z0-9_]){name}(?![A-Za-z0-9_])""" for name in K.CONTENT_CLASSES
] + [r"""(?i)id=["']content["']"""]


def decode_entities(s: Column | str) -> Column:
    """Decode seven entities, each once: ``&amp;lt;`` gives ``&lt;``."""
    out = F.replace(c(s), F.lit("&amp;"), F.lit(_AMP))
    for name, text in ENTITIES.items():
        if name != "&amp;":
            out = F.replace(out, F.lit(name), F.lit(text))
    return F.replace(out, F.lit(_AMP), F.lit("&"))



def _first(html: Column, pattern: str) -> Column:
    """First group of the first match. The match is located once, then only it is searched."""
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))


def meta_content(html: Column | str, attr: str, value: str) -> Column:
    v = value.replace(".", r"\.")
    name_first = rf"""(?i)<meta{S}+{attr}=["']{v}["']{S}+content=["']([^"']*)["']"""
    content_first = rf"""(?i)<meta{S}+content=["']([^"']*)["']{S}+{attr}=["']{v}["']"""
    return decode_entities(F.coalesce(_first(c(html), name_first), _first(c(html), content_first)))


def page_title(html: Column | str) -> Column:
    return decode_entities(trim_ws(_first(c(html), rf"(?is)<title{ATTRS}>(.*?)</title>")))


def page_canonical(html: Column | str) -> Column:
    rel = rf"""(?i)<link{S}+[^>]*rel=["']canonical["'][^>]*href=["']([^"']*)["'][^>]*>"""
    href = rf"""(?i)<link{S}+[^>]*href=["']([^"']*)["'][^>]*rel=["']canonical["'][^>]*>"""
    return decode_entities(F.coalesce(_first(c(html), rel), _first(c(html), href)))


def page_head(html: Column | str) -> Column:
    """Title, og: fields, canonical link, author and publish time."""
    h = c(html)
    return F.struct(
        page_title(h).alias("title"),
        meta_content(h, "property", "og:title").alias("og_title"),
        meta_content(h, "property", "og:description").alias("og_description"),
        meta_content(h, "property", "og:image").alias("og_image"),
        meta_content(h, "property", "og:type").alias("og_type"),
        meta_content(h, "property", "og:site_name").alias("og_site_name"),
        page_canonical(h).alias("canonical"),
        meta_content(h, "name", "author").alias("author"),
        meta_content(h, "property", "article:published_time").alias("published_time"),
    )


def strip_noise(html: Column | str) -> Column:
    """Remove noise elements: for each tag the paired ones first, then lone opening tags."""
    out = c(html)
    for tag in K.NOISE_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}(?:{S}|>).*?</{tag}>", "")
        out = F.regexp_replace(out, rf"(?i)<{tag}(?:[{S[1:-1]}/][^>]*)?>", "")
    return out


def simple_content_root(html: Column | str) -> Column:
    """Content of the first article, main or role=main element; null when there is none."""
    h = c(html)
    return F.coalesce(
        _first(h, rf"(?is)<article{ATTRS}>(.*?)</article>"),
        _first(h, rf"(?is)<main{ATTRS}>(.*?)</main>"),
        _first(h, r"""(?is)<[^>]+role=["']main["'][^>]*>(.*?)</div>"""),
    )


def needs_nested_root(html: Column | str) -> Column:
    """The content root is named by a class or id, so nesting has to be counted."""
    return simple_content_root(html).isNull() & c(html).rlike("|".join(ROOT_MARKS))


def body_root(html: Column | str) -> Column:
    return F.coalesce(_first(c(html), rf"(?is)<body{ATTRS}>(.*?)</body>"), c(html))


def content_root(html: Column | str, nested: Column | None = None) -> Column:
    """Content root: a simple element, a nested one found by :mod:`html_blocks`, body, or all."""
    if nested is None:
        return F.coalesce(simple_content_root(html), body_root(html))
    return F.coalesce(simple_content_root(html), nested, body_root(html))


def strip_tags(html: Column | str) -> Column:
    return F.regexp_replace(c(html), "<[^>]*>", "")


def page_text(html: Column | str) -> Column:
    return trim_ws(F.regexp_replace(strip_tags(html), f"{WS}+", " "))


def page_links(html: Column | str) -> Column:
    """Array of (text, href) where both are non-empty, in page order."""
    pattern = rf"""(?is)<a{S}+[^>]*href=["']([^"']*)["'][^>]*>(.*?)</a>"""
    hits = F.arrays_zip(
        F.regexp_extract_all(c(html), F.lit(pattern), F.lit(2)).alias("inner"),
        F.regexp_extract_all(c(html), F.lit(pattern), F.lit(1)).alias("href"),
    )
    links = F.transform(
        hits,
        lambda x: F.struct(
            trim_ws(strip_tags(x["inner"])).alias("text"), decode_entities(x["href"]).alias("href")
        ),
    )
    return F.filter(links, lambda x: (x["text"] != "") & (x["href"] != ""))


def page_images(html: Column | str) -> Column:
    """Array of (alt, src) where the source is non-empty, in page order."""
    tags = F.regexp_extract_all(c(html), F.lit(rf"(?i)<img{S}+[^>]*>"), F.lit(0))
    images = F.transform(
        tags,
        lambda t: F.struct(
            decode_entities(F.regexp_extract(t, r"""(?i)alt=["']([^"']*)["']""", 1)).alias("alt"),
            decode_entities(F.regexp_extract(t, r"""(?i)src=["']([^"']*)["']""", 1)).alias("src"),
        ),
    )
    return F.filter(images, lambda x: x["src"] != "")


def page_headings(html: Column | str) -> Column:
    """Array of (level, text) in page order."""
    pattern = rf"(?is)<h([1-6]){ATTRS}>(.*?)</h\1>"
    hits = F.arrays_zip(
        F.regexp_extract_all(c(html), F.lit(pattern), F.lit(1)).alias("level"),
        F.regexp_extract_all(c(html), F.lit(pattern), F.lit(2)).alias("inner"),
    )
    return F.transform(
        hits,
        lambda x: F.struct(
            x["level"].cast("int").alias("level"), trim_ws(strip_tags(x["inner"])).alias("text")
        ),
    )


def page_tables(html: Column | str) -> Column:
    """Array of tables, each an array of rows padded to the widest row."""
    tables = F.regexp_extract_all(c(html), F.lit(rf"(?is)<table{ATTRS}>(.*?)</table>"), F.lit(1))

    def rows_of(table: Column) -> Column:
        trs = F.regexp_extract_all(table, F.lit(rf"(?is)<tr{ATTRS}>(.*?)</tr>"), F.lit(1))
        cells = F.transform(
            trs,
            lambda tr: F.transform(
                F.regexp_extract_all(
                    tr, F.lit(rf"(?is)<(?:td|th){ATTRS}>(.*?)</(?:td|th)>"), F.lit(1)
                ),
                lambda x: trim_ws(strip_tags(x)),
            ),
        )
        rows = F.filter(cells, lambda r: F.size(r) > 0)
        width = F.array_max(F.transform(rows, F.size))
        return F.transform(
            rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))
        )

    return F.filter(F.transform(tables, rows_of), lambda t: F.size(t) > 0)


def is_spa_shell(html: Column | str, root: Column | str) -> Column:
    return (F.length(page_text(root)) < K.SPA_TEXT_LIMIT) & contains_any(html, K.SPA_MARKERS)


def page_elements(html: Column | str, limit: int | None = None) -> Column:
    """Interactive elements, the first ``limit`` if one is given: (ref, tag, text, href, type, name, role, placeholder).
    Layout is unknown here, so hidden elements are not left out."""
    pattern = (
        rf"(?is)<(a(?={S}[^>]*href=)|button|input|select|textarea"
        rf"|[a-z][a-z0-9]*(?=[^>]*{S}(?:role=[\"'](?:button|link)[\"']|onclick=|tabindex=)))"
        rf"({ATTRS})/?>"
    )

    def attr(tag: Column, name: str) -> Column:
        return F.nullif(
            F.regexp_extract(tag, rf"""(?i){S}{name}=["']([^"']*)["']""", 1), F.lit("")
        )

    whole = F.regexp_extract_all(c(html), F.lit(pattern), F.lit(0))
    names = F.regexp_extract_all(c(html), F.lit(pattern), F.lit(1))
    zipped = F.arrays_zip(whole.alias("tag"), names.alias("name"))
    if limit is not None:
        zipped = F.slice(zipped, 1, limit)
    return F.transform(
        zipped,
        lambda x, i: F.struct(
            F.concat(F.lit("e"), i.cast("string")).alias("ref"),
            F.lower(x["name"]).alias("tag"),
            attr(x["tag"], "href").alias("href"),
            attr(x["tag"], "type").alias("type"),
            attr(x["tag"], "name").alias("name"),
            attr(x["tag"], "role").alias("role"),
            attr(x["tag"], "placeholder").alias("placeholder"),
        ),
    )


def captcha_kind(html: Column | str) -> Column:
    return (
        F.when(contains_any(html, ["Just a moment...", "cdn-cgi/challenge-platform",
                                   "cf-browser-verification"]), "cloudflare")
        .when(contains_any(html, ["g-recaptcha", "google.com/recaptcha"]), "recaptcha")
        .when(contains_any(html, ["h-captcha", "hcaptcha.com"]), "hcaptcha")
    )


def _signals(*pairs: tuple[str, Column]) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in pairs])
    )


def framework_signals(html: Column | str, headers: Column | str) -> list[tuple[str, str, Column]]:
    """(framework, confidence rule, signals) of the built-in rules. The rule is ``count`` (two signals make
    it high) or a fixed level. Rules of users go through ``operators.registry``."""
    m = lower_keys(headers)

    def holds(place: str, wanted: str | None, fold: bool) -> Column:
        where = c(html) if place == "html" else header(m, place)
        return where.isNotNull() if wanted is None else (F.lower(where) if fold else where).contains(wanted)

    found: dict[str, dict[str, Column]] = {}
    levels = {}
    for framework, level, signal, place, wanted, fold in K.FRAMEWORK_RULES:
        signals = found.setdefault(framework, {})
        one = holds(place, wanted, fold)
        signals[signal] = signals[signal] & one if signal in signals else one
        levels[framework] = level
    return [(name, levels[name], _signals(*signals.items())) for name, signals in found.items()]


def _framework_row(ord_: int, name: str, rule: str, paths: Column):
    def row(s: Column) -> Column:
        level = (
            F.when(F.size(s) >= 2, "high").otherwise("medium") if rule == "count" else F.lit(rule)
        )
        rank = F.when(level == "high", 0).when(level == "medium", 1).otherwise(2)
        return F.when(
            F.size(s) > 0,
            F.struct(rank.alias("rank"), F.lit(ord_).alias("ord"), F.lit(name).alias("name"),
                     level.alias("confidence"), s.alias("signals"), paths.alias("api_paths")),
        )

    return row


def page_frameworks(html: Column | str, headers: Column | str) -> Column:
    """Array of (rank, ord, name, confidence, signals, api_paths), best confidence first."""
    build_id = F.nullif(
        F.regexp_extract(c(html), rf'"buildId"{S}*:{S}*"([^"]+)"', 1), F.lit("")
    )
    rows = []
    for ord_, (name, rule, signals) in enumerate(framework_signals(html, headers)):
        paths = F.array(*[F.lit(p) for p in K.FRAMEWORK_PATHS[name]])
        if name == "Next.js":
            paths = F.array_compact(
                F.concat(paths, F.array(F.concat(F.lit("/_next/data/"), build_id, F.lit("/"))))
            )

        rows.append(let(signals, _framework_row(ord_, name, rule, paths)))
    return F.array_sort(F.array_compact(F.array(*rows)))


def page_auth(html: Column | str, headers: Column | str) -> Column:
    """(auth_required, signals, login_url) of a page."""
    h = c(html)
    location = header(headers, "location")
    to_login = location.rlike(K.AUTH_PATH_RE)
    password = h.rlike(rf"""(?i)<input[^>]*type{S}*={S}*["']password["'][^>]*>""")
    form = (
        rf"""(?i)<form[^>]*action{S}*={S}*["']([^"']*(?:login|signin|sign-in|auth)[^"']*)["']"""
    )
    refresh = _first(
        h,
        rf"""(?i)<meta[^>]*http-equiv{S}*={S}*["']refresh["'][^>]*content{S}*={S}*["']"""
        rf"""[^"']*url{S}*={S}*([^"'{S[1:-1]}>]+)""",
    )
    refresh_login = refresh.rlike(K.AUTH_PATH_RE)
    sso_form = rf"""(?i)<form[^>]*action{S}*={S}*["'][^"']*(?:sso|saml)[^"']*["'][^>]*>"""
    challenge = header(headers, "www-authenticate")
    signals = F.array_compact(
        F.array(
            F.concat(F.lit("WWW-Authenticate header: "), challenge),
            F.when(to_login, F.concat(F.lit("Location redirect to auth path: "), location)),
            F.when(password, F.lit("Detected login form with password input")),
            F.when(refresh_login, F.concat(F.lit("Meta redirect to auth path: "), refresh)),
            F.when(h.rlike(K.OAUTH_LINK_RE), F.lit("OAuth provider login link detected")),
            F.when(h.rlike("(?i)saml") & h.rlike(sso_form),
                   F.lit("SSO/SAML authentication form detected")),
        )
    )
    login_url = F.coalesce(
        F.when(to_login, location), F.when(password, _first(h, form)), F.when(refresh_login, refresh)
    )
    return F.struct(
        (F.size(signals) > 0).alias("auth_required"), signals.alias("signals"),
        login_url.alias("login_url"),
    )


def is_api_probe(status: Column | str, content_type: Column | str, body: Column | str) -> Column:
    """A probed path answered like an API."""
    ct = F.lower(F.coalesce(c(content_type), F.lit("")))
    text = trim_ws(c(body))
    return (
        ct.contains("json")
        | ct.contains("xml")
        | (c(status).isin(401, 403) & ~ct.contains("html"))
        | F.coalesce(c(body).contains('"data"') & c(body).contains('"__schema"'), F.lit(False))
        | F.coalesce(
            text.rlike(r"^[{\[]") & F.try_parse_json(text).isNotNull(), F.lit(False)
        )
    )


def is_probe_kept(status: Column | str) -> Column:
    return (c(status) < 400) | c(status).isin(401, 403)
