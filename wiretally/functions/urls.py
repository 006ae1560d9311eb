"""URL and host expressions: parts, filters, safety."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.functions.common import any_of, c, let, trim_ws

# scheme :// [userinfo@] host [:port] path [?query] [#fragment]
URL_RE = (
    r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\s]+)(?::(\d*))?"
    r"(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"
)

#: URLs of the web whose host is not private; what they begin with excludes every other scheme.
_PUBLIC_RE = URL_RE.replace(r"([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?", (
    r"(?i:https?)://(?:[^/?#@]*@)?(?!(?i:" + K.PRIVATE_HOST_RE.removeprefix("^").removesuffix("$") + r")(?:[:/?#]|$))"))


def url_scheme(url: Column | str) -> Column:
    return F.lower(F.nullif(F.regexp_extract(c(url), URL_RE, 1), F.lit("")))


def url_host(url: Column | str) -> Column:
    """Lower-case host, or null when the URL is not valid."""
    return F.lower(F.nullif(F.regexp_extract(c(url), URL_RE, 2), F.lit("")))


def url_port(url: Column | str) -> Column:
    """Port, without the scheme's own default one."""
    port = F.nullif(F.regexp_extract(c(url), URL_RE, 3), F.lit(""))
    scheme = url_scheme(url)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when(~F.coalesce(default, F.lit(False)), port)


def url_path(url: Column | str) -> Column:
    """Path, ``/`` when empty, null when the URL is not valid."""
    return F.when(
        url_host(url).isNotNull(),
        F.coalesce(F.nullif(F.regexp_extract(c(url), URL_RE, 4), F.lit("")), F.lit("/")),
    )


def url_query(url: Column | str) -> Column:
    return F.nullif(F.regexp_extract(c(url), URL_RE, 5), F.lit(""))


def url_origin(url: Column | str) -> Column:
    port = url_port(url)
    return F.concat(
        url_scheme(url), F.lit("://"), url_host(url), F.coalesce(F.concat(F.lit(":"), port), F.lit(""))
    )


def url_parts(url: Column | str) -> Column:
    """host, path, origin and query text of a URL; all null when it is not valid."""
    return F.struct(
        url_host(url).alias("host"),
        url_path(url).alias("path"),
        url_origin(url).alias("origin"),
        url_query(url).alias("query"),
    )


def form_decode(s: Column) -> Column:
    """Decode one form-encoded piece; a broken escape leaves the piece as it is."""
    plus = F.regexp_replace(s, r"\+", " ")
    return F.coalesce(F.try_url_decode(s), plus)


def query_pairs(query: Column | str) -> Column:
    """``a=1&b=2`` to an ordered array of (name, value); a name without ``=`` has an empty value."""
    parts = F.filter(F.split(F.coalesce(c(query), F.lit("")), "&"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            form_decode(F.substring_index(p, "=", 1)).alias("name"),
            F.when(
                p.contains("="), form_decode(F.regexp_replace(p, r"^[^=]*=", ""))
            ).otherwise("").alias("value"),
        ),
    )


def pairs_to_map(pairs: Column) -> Column:
    """Last value of a repeated name wins."""
    return F.aggregate(
        pairs,
        F.create_map().cast("map<string,string>"),
        lambda acc, p: F.map_concat(
            F.map_filter(acc, lambda k, _v: k != p["name"]), F.create_map(p["name"], p["value"])
        ),
    )


def query_names(url: Column | str) -> Column:
    """The names of :func:`query_params` in order, without their values."""
    parts = F.filter(F.split(F.coalesce(url_query(url), F.lit("")), "&"), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.transform(parts, lambda p: form_decode(F.substring_index(p, "=", 1)))))


def query_params(url: Column | str) -> Column:
    """Query of a URL as MAP name → example value."""
    return let(query_pairs(url_query(url)), pairs_to_map)


def parse_form(body: Column | str) -> Column:
    """``a=b&c=d`` as a map. Pieces without ``=`` are skipped."""
    parts = F.filter(F.split(c(body), "&"), lambda p: p.contains("="))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            form_decode(F.substring_index(p, "=", 1)).alias("name"),
            form_decode(F.regexp_replace(p, r"^[^=]*=", "")).alias("value"),
        ),
    )
    return let(pairs, pairs_to_map)


def host_suffixes(host: Column | str) -> Column:
    """The host and its parents down to two labels."""
    return let(
        F.split(c(host), r"\."),
        lambda labels: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        ),
    )


def parent_domains(host: Column | str) -> Column:
    """Parents only: a.b.example.com → [b.example.com, example.com]."""
    return let(host_suffixes(host), lambda s: F.slice(s, 2, F.size(s)))


def is_blocklisted(host: Column | str, hosts: Iterable[str] = K.TRACKER_HOSTS) -> Column:
    """The host or one of its parents is on the list. One alternation over the host's tail, so the
    check is a single pass with no join."""
    tails = "|".join(h.replace(".", r"\.") for h in hosts)
    return c(host).rlike(rf"(?:^|\.)(?:{tails})$")


def is_path_noise(path: Column | str) -> Column:
    return c(path).isin(K.NOISE_PATHS) | c(path).startswith(K.NOISE_PREFIX)


def content_type_base(content_type: Column | str) -> Column:
    return trim_ws(F.substring_index(F.lower(c(content_type)), ";", 1))


def capture_reject_reason(
    url: Column | str, status: Column | str, content_type: Column | str
) -> Column:
    """Null for traffic worth keeping, else the first rule that rejects it. Cheap rules first."""
    u = c(url)
    ext = F.lit(False)
    for scheme in K.EXTENSION_SCHEMES:
        ext = ext | u.startswith(scheme)
    return (
        F.when(ext, "extension")
        .when(~c(status).between(200, 299), "status")
        .when(~F.coalesce(content_type_base(content_type).isin(K.JSON_CONTENT_TYPES), F.lit(False)),
              "content-type")
        .when(url_host(u).isNull(), "invalid-url")
        .when(is_blocklisted(url_host(u)), "blocklist")
        .when(let(url_path(u), is_path_noise), "noise-path")
    )


def should_capture(url, status, content_type) -> Column:
    return capture_reject_reason(url, status, content_type).isNull()


def is_domain_match(host: Column | str, target: Column | str) -> Column:
    t = F.coalesce(F.when(c(target).contains("://"), url_host(target)), c(target))
    return let(
        F.regexp_replace(t, r"^www\.", ""),
        lambda x: (c(host) == x) | c(host).endswith(F.concat(F.lit("."), x)),
    )


def parse_domain_patterns(text: Column | str) -> Column:
    return F.filter(
        F.transform(F.split(F.coalesce(c(text), F.lit("")), ","), trim_ws), lambda p: p != ""
    )


def matches_domain_glob(host: Column | str, patterns: Column) -> Column:
    """Empty list matches all; ``*.x`` matches x and its subdomains; else equality."""
    h = c(host)

    def one(p: Column) -> Column:
        base = F.substring(p, F.lit(3), F.length(p))
        return F.when(
            p.startswith("*."), (h == base) | h.endswith(F.concat(F.lit("."), base))
        ).otherwise(h == p)

    return (F.size(patterns) == 0) | F.exists(patterns, one)


def is_allowed_url(url: Column | str) -> Column:
    # one pass over the URL: its scheme, and a host that is valid and not private
    u = c(url)
    return F.coalesce(u.rlike(_PUBLIC_RE), F.lit(False)) & ~u.rlike(K.NOISE_URL_RE)


def is_sensitive_path(path: Column | str) -> Column:
    # all parts begin with a slash, so that only slashes are tried
    return c(path).rlike("(?i)/" + any_of((p.removeprefix("/") for p in K.SENSITIVE_PATHS), False).join(("(?:", ")")))


def is_index_content_type(content_type: Column | str) -> Column:
    ct = F.lower(F.coalesce(c(content_type), F.lit("")))
    return (
        ct.contains("application/json")
        | ct.contains("application/graphql")
        | ct.contains("application/vnd.api+json")
    )


def _ip_number(part: Column) -> Column:
    """Decimal, octal (0…) or hex (0x…) part of an IPv4, with any number of leading zeros. A number of more digits than
    are looked at is larger than any address."""
    hexed, octal = r"(?i)^0x0*([0-9a-f]{1,14})$", r"^0+([0-7]{1,16})$"
    return (
        F.when(part.rlike(hexed), F.conv(F.regexp_extract(part, hexed, 1), 16, 10))
        .when(part.rlike(octal), F.conv(F.regexp_extract(part, octal, 1), 8, 10))
        .when(part.rlike(r"^(?:0|[1-9]\d{0,15})$"), part)
        .try_cast("bigint")
    )


def normalize_ipv4(host: Column | str) -> Column:
    """Dotted-decimal form of an IPv4 written with one to four decimal, octal or hex parts, the last
    of which fills the remaining bytes; null when the host is none."""

    def of(n: Column) -> Column:
        count = F.size(n)
        last = F.element_at(n, -1)
        heads = F.slice(n, F.lit(1), count - 1)
        ok = (
            count.between(1, 4)
            & F.forall(n, lambda x: x.isNotNull())
            & F.forall(heads, lambda x: x <= 255)
            & (last < F.pow(F.lit(256.0), F.lit(5) - count))
        )
        high = F.aggregate(heads, F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x)
        value = high * F.pow(F.lit(256.0), F.lit(5) - count).cast("bigint") + last
        return F.when(
            F.coalesce(ok, F.lit(False)),
            let(value.cast("bigint"), lambda v: F.concat_ws(
                ".", *[F.shiftright(v, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]
            )),
        )

    return F.when(
        c(host).rlike(r"(?i)^[0-9a-fx.]+$"), let(F.transform(F.split(c(host), r"\."), _ip_number), of)
    )


def _mapped_v4(host: Column) -> Column:
    """IPv4 inside an IPv6-mapped host, in either spelling."""
    dotted = r"(?i)^\[?::ffff:(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\]?$"
    hexed = r"(?i)^\[?::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})\]?$"
    hi = F.conv(F.regexp_extract(host, hexed, 1), 16, 10).try_cast("bigint")
    lo = F.conv(F.regexp_extract(host, hexed, 2), 16, 10).try_cast("bigint")
    return F.when(host.rlike(dotted), F.regexp_extract(host, dotted, 1)).when(
        host.rlike(hexed),
        F.concat_ws(
            ".",
            F.shiftright(hi, 8).bitwiseAND(255),
            hi.bitwiseAND(255),
            F.shiftright(lo, 8).bitwiseAND(255),
            lo.bitwiseAND(255),
        ),
    )


def url_safety_reason(url: Column | str) -> Column:
    """Why a URL must not be requested; null when it is safe. The first rule that fits wins."""
    u = c(url)
    scheme = url_scheme(u)
    raw_host = url_host(u)

    def reason(host: Column) -> Column:
        internal = F.lit(False)
        for suffix in K.INTERNAL_SUFFIXES:
            internal = internal | host.endswith(suffix)

        def by_ip(ip: Column) -> Column:
            def octet(i: int) -> Column:
                return F.get(F.split(ip, r"\."), F.lit(i)).try_cast("int")

            def rules(o: Column) -> Column:
                a, b, d = o["a"], o["b"], o["d"]

                def says(what: str) -> Column:
                    return F.concat(F.lit(f"URL targets {what}: "), host)

                return (
                    F.when(a == 0, says("unspecified address"))
                    .when(a == 127, says("loopback address"))
                    .when(a == 10, says("private IP"))
                    .when((a == 172) & b.between(16, 31), says("private IP"))
                    .when((a == 192) & (b == 168), says("private IP"))
                    .when((a == 169) & (b == 254), says("link-local address"))
                    .when((a == 100) & b.between(64, 127), says("CGNAT address"))
                    .when((a == 192) & (b == 0) & (d == 0), says("IETF reserved address"))
                    .when((a == 198) & b.isin(18, 19), says("benchmarking address"))
                    .when(a >= 240, says("reserved address"))
                )

            return F.when(
                ip.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"),
                let(F.struct(octet(0).alias("a"), octet(1).alias("b"), octet(2).alias("d")), rules),
            )

        return (
            F.when(host.isin(K.INTERNAL_HOSTS),
                   F.concat(F.lit("URL targets internal hostname: "), host))
            .when(internal, F.concat(F.lit("URL targets internal domain: "), host))
            .when(host.isin("[::1]", "::1"), F.lit("URL targets IPv6 loopback"))
            .when(host.rlike(r"(?i)^\[?fe[89ab][0-9a-f]:"),
                  F.concat(F.lit("URL targets IPv6 link-local address: "), host))
            .when(host.rlike(r"(?i)^\[?f[cd][0-9a-f]{2}:"),
                  F.concat(F.lit("URL targets IPv6 unique-local address: "), host))
            .otherwise(by_ip(host))
        )

    return (
        F.when(scheme.isNull() & u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:(?!//)"),
               F.concat(F.lit("Non-HTTP scheme: "),
                        F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1))))
        .when(raw_host.isNull(), F.lit("Invalid URL"))
        .when(~scheme.isin("http", "https"), F.concat(F.lit("Non-HTTP scheme: "), scheme, F.lit(":")))
        .otherwise(
            let(
                F.struct(
                    F.coalesce(_mapped_v4(raw_host), normalize_ipv4(raw_host)).alias("ip"),
                    raw_host.alias("raw"),
                ),
                # a host whose last label is a number is an IPv4 or nothing
                lambda h: F.when(
                    h["ip"].isNull() & h["raw"].rlike(r"(?i)(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)$"),
                    F.lit("Invalid URL"),
                ).otherwise(reason(F.coalesce(h["ip"], h["raw"]))),
            )
        )
    )


def is_safe_url(url: Column | str) -> Column:
    return url_safety_reason(url).isNull()


def normalize_templated_host(host: Column | str) -> Column:
    """Drop leading ``{var}.`` labels."""
    return F.regexp_replace(c(host), r"^(?:\{[^}]+\}\.)+", "")


def normalize_server_url(url: Column | str) -> Column:
    u = c(url)
    return F.when(
        u.contains("{") & u.rlike(r"^https?://[^/]+"),
        F.concat(
            F.regexp_extract(u, r"^(https?://)", 1),
            normalize_templated_host(F.regexp_extract(u, r"^https?://([^/]+)", 1)),
            F.regexp_extract(u, r"^https?://[^/]+(.*)$", 1),
        ),
    ).otherwise(u)


def link_header(header: Column | str, rel: str) -> Column:
    """URL of a relation in a Link header; null when there is none."""
    hit = F.filter(
        F.split(c(header), ","),
        lambda p: F.trim(F.regexp_extract(p, r'<[^>]+>.*rel\s*=\s*"?([^",;]+)"?', 1)) == rel,
    )
    return F.regexp_extract(F.get(hit, F.lit(0)), r"<([^>]+)>", 1)


def has_placeholder_host(urls: Column) -> Column:
    def one(u: Column) -> Column:
        out = F.lit(False)
        for h in K.PLACEHOLDER_HOSTS:
            out = out | u.contains(h)
        return out

    return F.exists(urls, one)


