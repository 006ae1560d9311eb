"""Pieces of reference SQL shared by the checks. They restate the rules in another engine's words:
joins, recursion and unnesting instead of folds and array functions."""

from __future__ import annotations

from wiretally import constants as K
from wiretally.sources import derived as D

EX = D.exchanges_sql(D.ANSI)
PAGES = D.page_responses_sql(D.ANSI)
SPECS = D.specs_sql(D.ANSI)
DIRECTORY = D.directory_sql(D.ANSI)

WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def b(pattern: str) -> str:
    return pattern.replace("{b}", r"\b")


_NOUNS = ", ".join(
    f"({lit(n)}, {lit(s[0])}, {lit(s[1]) if len(s) > 1 else 'NULL'})"
    for n, s in K.RESOURCE_SLOTS.items()
)
_KEEP = in_list(sorted(set(K.STRUCTURAL_WORDS) | set(K.RESOURCE_SLOTS)))


def templates(source: str, column: str = "raw_path") -> str:
    """CTEs ending in ``tmpl(raw_path, path)`` for the distinct paths of a table: one recursion step
    per segment."""
    return rf"""
 nouns(noun, s1, s2) AS (VALUES {_NOUNS}),
 all_paths AS (SELECT DISTINCT {column} AS raw_path FROM {source} WHERE {column} IS NOT NULL),
 segs AS (SELECT raw_path, t.i AS i, string_split(raw_path, '/')[t.i] AS seg,
     lower(coalesce(string_split(raw_path, '/')[t.i - 1], '')) AS prev
   FROM all_paths, unnest(range(1, len(string_split(raw_path, '/')) + 1)) AS t(i)),
 kinds AS (SELECT segs.*, s1, s2, CASE
     WHEN seg = '' THEN 'E'
     WHEN regexp_full_match(seg, '[0-9]+') THEN 'N'
     WHEN regexp_full_match(lower(seg), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') THEN ':id'
     WHEN regexp_full_match(lower(seg), '[0-9a-f]{{16,}}') THEN ':hash'
     WHEN regexp_matches(seg, '[0-9]{{8,}}') THEN ':slug'
     WHEN length(replace(replace(seg, '-', ''), '_', '')) >= 12 AND regexp_matches(seg, '[A-Za-z]')
        AND regexp_matches(seg, '[0-9]') THEN ':hash'
     WHEN noun IS NOT NULL THEN 'R'
     WHEN lower(seg) IN {in_list(K.STRUCTURAL_WORDS)} THEN 'T'
     WHEN prev IN {_KEEP} AND length(seg) >= 2
        AND NOT regexp_full_match(seg, '[a-z]{{2,}}(-[a-z]{{2,}})*') THEN 'X'
     ELSE 'W' END AS kind
   FROM segs LEFT JOIN nouns ON lower(seg) = noun),
 fold(raw_path, i, txt, q1, q2) AS (
   SELECT raw_path, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
   FROM all_paths
   UNION ALL
   SELECT k.raw_path, k.i,
     CASE WHEN k.i = 1 THEN '' ELSE f.txt || '/' END || CASE
       WHEN kind IN ('E', 'R', 'T') THEN seg WHEN kind LIKE ':%' THEN kind
       WHEN kind = 'W' THEN coalesce(q1, seg) ELSE coalesce(q1, ':id') END,
     CASE WHEN kind = 'E' THEN q1 WHEN kind = 'R' THEN s1 WHEN kind IN ('N', 'X', 'W') THEN q2 END,
     CASE WHEN kind = 'E' THEN q2 WHEN kind = 'R' THEN s2 END
   FROM fold f JOIN kinds k ON k.raw_path = f.raw_path AND k.i = f.i + 1),
 tmpl AS (SELECT raw_path, max_by(txt, i) AS path FROM fold WHERE i > 0 GROUP BY raw_path)"""


CLEAN = (
    "coalesce(nullif(regexp_replace(regexp_replace({p}, '^/_next/data/[^/]+/', '/'), "
    "'\\.json$', ''), ''), '/')"
).replace("\\\\", "\\")

_BLOCK = " OR ".join(
    f"host = {lit(h)} OR host LIKE {lit('%.' + h)}" for h in K.TRACKER_HOSTS
)

# exchanges with host, reject reason and content type base
EXR = rf"""
 ex AS ({EX}),
 exr AS (SELECT *, host AS domain, path AS raw_path, CASE
     WHEN status < 200 OR status > 299 THEN 'status'
     WHEN trim(lower(string_split(content_type, ';')[1])) NOT IN {in_list(K.JSON_CONTENT_TYPES)}
       THEN 'content-type'
     WHEN {_BLOCK} THEN 'blocklist'
     WHEN path IN {in_list(K.NOISE_PATHS)} OR path LIKE '/\_next/static/%' ESCAPE '\' THEN 'noise-path'
     END AS reason FROM ex)"""

# accepted exchanges with template path, operation, id and key
KEYED = rf"""{EXR},
 acc AS (SELECT * FROM exr WHERE reason IS NULL),{templates('exr')},
 keyed0 AS (SELECT acc.* EXCLUDE (path), tmpl.path,
     CASE WHEN kind = 'graphql' THEN coalesce(json_extract_string(req_body, '$.operationName'),
       regexp_extract(json_extract_string(req_body, '$.query'), '^query (\w+)', 1)) END AS operation
   FROM acc JOIN tmpl USING (raw_path)),
 keyed AS (SELECT *, {CLEAN.format(p='path')} AS cleaned,
     method || CASE WHEN operation IS NOT NULL THEN ' graphql:' || operation
       ELSE ' ' || {CLEAN.format(p='path')} END AS key FROM keyed0)"""

WITH = "WITH RECURSIVE "


def entropy_of(source: str, column: str) -> str:
    """CTE ``ent(val, bits)``: entropy of the distinct values of a column."""
    return f"""
 vals AS (SELECT DISTINCT {column} AS val FROM {source} WHERE {column} IS NOT NULL),
 chars AS (SELECT val, ch, count(*) AS n FROM (SELECT val, unnest(string_split(val, '')) AS ch FROM vals)
   WHERE ch <> '' GROUP BY val, ch),
 ent AS (SELECT val, round(-sum(n / length(val) * log2(n / length(val))), 12) AS bits FROM chars
   GROUP BY val)"""


UUID_SQL = (
    "regexp_full_match(lower({v}), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-"
    "[0-9a-f]{{12}}')"
)

# the scrubber, as nested replacements in RE2
_OCT = "(0{0,2}[0-9]|0?[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_KIND = rf"(RSA{WS}+|EC{WS}+|DSA{WS}+)?"
_SCRUB = [
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[email]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[ssn]"),
    (r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", "[card]"),
    (r"\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b", "\\1.\\2.\\3.\\4"),
    (rf"\x{{E001}}{_OCT}\.{_OCT}\.{_OCT}\.{_OCT}\x{{E002}}", "[ip]"),
    (r"[\x{E001}\x{E002}]", ""),
    (r"\+[1-9]\d{7,14}", "[phone]"),
    (rf"\(\d{{3}}\)([-.]|{WS})\d{{3}}([-.]|{WS})\d{{4}}|\d{{3}}([-.]|{WS})\d{{3}}([-.]|{WS})\d{{4}}",
     "[phone]"),
    (rf"\bBearer{WS}+[A-Za-z0-9._~+/-]+=*\b", "[token]"),
    (r"\beyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\b", "[token]"),
    (rf"(?s)-----BEGIN{WS}+{_KIND}PRIVATE{WS}+KEY-----.*?-----END{WS}+{_KIND}PRIVATE{WS}+KEY-----",
     "[private-key]"),
    (r"\b(AKIA|ASIA)[A-Z0-9]{16}\b", "[aws-key]"),
    (r"\bAIza[A-Za-z0-9_-]{35}\b", "[gcp-key]"),
    (rf"\bBasic{WS}+[A-Za-z0-9+/]{{8,}}={{0,2}}\b", "[token]"),
]


def scrub_sql(expr: str) -> str:
    for pattern, mark in _SCRUB:
        expr = f"regexp_replace({expr}, {lit(pattern)}, {lit(mark)}, 'g')"
    return expr


def tag_sql(name: str) -> str:
    return rf"<{name}({WS}[^>]*)?>"


# request headers as rows (seq, name, value)
HEADER_ROWS = """
 hdr AS (SELECT seq, 'accept' AS name, 'application/json' AS value FROM exr
   UNION ALL SELECT seq, 'user-agent', 'probe/1.0' FROM exr
   UNION ALL SELECT seq, 'authorization', h_authorization FROM exr WHERE h_authorization IS NOT NULL
   UNION ALL SELECT seq, 'x-api-key', h_api_key FROM exr WHERE h_api_key IS NOT NULL
   UNION ALL SELECT seq, 'x-csrf-token', h_csrf FROM exr WHERE h_csrf IS NOT NULL
   UNION ALL SELECT seq, 'cookie', h_cookie FROM exr WHERE h_cookie IS NOT NULL
   UNION ALL SELECT seq, 'x-blob', h_blob FROM exr WHERE h_blob IS NOT NULL
   UNION ALL SELECT seq, 'x-request-id', h_request_id FROM exr
   UNION ALL SELECT seq, 'content-type', h_content_type FROM exr WHERE h_content_type IS NOT NULL
   UNION ALL SELECT seq, 'sec-fetch-mode', h_fetch_mode FROM exr WHERE h_fetch_mode IS NOT NULL)"""
