"""Personal data, secrets, entropy and token cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.functions.common import NOT_BEFORE_WORD, WORD, WS, B, c, contains_any, let

_OCTET = r"0{0,2}[0-9]|0?[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5]"
_MARK_IN, _MARK_OUT = "\uFDD0", "\uFDD1"
_LOCAL = r"[a-zA-Z0-9._%+-]"
_KEY_KIND = rf"(?:RSA{WS}+|EC{WS}+|DSA{WS}+)?"


def _word_start(first: str, rest: str) -> str:
    """A pattern that begins at a word boundary. The first character is tested before the boundary,
    which fails fast at almost every position of a text."""
    return f"{first}(?<!{WORD}{first}){rest}"


_D = "[0-9]"
_SEP = rf"(?:[-.]|{WS})"
_IP_REST = r"[0-9]{0,2}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
# The order, the patterns and the marks of the scrubber: (class, texts of which one
# must occur, pattern, mark). A run of local-part characters is tried once, from its start.
SCRUB_STEPS = [
    ("email", ["@"], rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}", "[email]"),
    ("ssn", ["-"], _word_start(_D, rf"{_D}{{2}}-{_D}{{2}}-{_D}{{4}}{NOT_BEFORE_WORD}"), "[ssn]"),
    ("card", [],
     _word_start(_D, rf"{_D}{{3}}[- ]?{_D}{{4}}[- ]?{_D}{{4}}[- ]?{_D}{{4}}{NOT_BEFORE_WORD}"), "[card]"),
    ("ip", ["."], None, "[ip]"),
    ("phone_intl", ["+"], r"\+[1-9][0-9]{7,14}", "[phone]"),
    ("phone_us", [],
     rf"(?=[(0-9])(?:\({_D}{{3}}\){_SEP}{_D}{{3}}{_SEP}{_D}{{4}}|{_D}{{3}}{_SEP}{_D}{{3}}{_SEP}{_D}{{4}})",
     "[phone]"),
    ("bearer", ["Bearer"], _word_start("B", rf"earer{WS}+[A-Za-z0-9._~+/-]+=*{B}"), "[token]"),
    ("jwt", ["eyJ"],
     _word_start("e", rf"yJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+{B}"), "[token]"),
    ("private_key", ["-----BEGIN"],
     rf"-----BEGIN{WS}+{_KEY_KIND}PRIVATE{WS}+KEY-----(?s:.*?)"
     rf"-----END{WS}+{_KEY_KIND}PRIVATE{WS}+KEY-----", "[private-key]"),
    ("aws_key", ["AKIA", "ASIA"],
     _word_start("A", rf"(?:KIA|SIA)[A-Z0-9]{{16}}{NOT_BEFORE_WORD}"), "[aws-key]"),
    ("gcp_key", ["AIza"], _word_start("A", rf"Iza[A-Za-z0-9_-]{{35}}{B}"), "[gcp-key]"),
    ("basic", ["Basic"], _word_start("B", rf"asic{WS}+[A-Za-z0-9+/]{{8,}}={{0,2}}{B}"), "[token]"),
]
_QUAD = _word_start(_D, rf"{_IP_REST}{NOT_BEFORE_WORD}")
IPV4_RE = _QUAD
_IPV4_VALID = rf"{_MARK_IN}(?:{_OCTET})(?:\.(?:{_OCTET})){{3}}{_MARK_OUT}"


def _mark_ipv4(s: Column) -> Column:
    """Mark every dotted quad, so that one with an octet above 255 still uses up its text."""
    return F.regexp_replace(s, _QUAD, f"{_MARK_IN}$0{_MARK_OUT}")


def _scrub_ipv4(s: Column) -> Column:
    done = F.regexp_replace(_mark_ipv4(s), _IPV4_VALID, "[ip]")
    return F.translate(done, _MARK_IN + _MARK_OUT, "")


def _may_hold(s: Column, needles: list[str]) -> Column:
    return contains_any(s, needles) if needles else F.lit(True)


def scrub_pii(text: Column | str) -> Column:
    """Replace personal data and secrets by class marks, in a fixed order. A class whose literal part
    does not occur is skipped."""

    def step(name: str, needles: list[str], pattern: str | None, mark: str):
        def of(s: Column) -> Column:
            new = _scrub_ipv4(s) if name == "ip" else F.regexp_replace(s, pattern, mark)
            return F.when(_may_hold(s, needles), new).otherwise(s)

        return of

    out = c(text)
    for args in SCRUB_STEPS:
        out = let(out, step(*args))
    return out


def with_pii(df: DataFrame, text: str, scrubbed: str = "scrubbed") -> DataFrame:
    """Add the scrubbed text and one ``n_<class>`` count per class. Every class is counted on the
    text as the classes before it left it, so a match is counted once."""
    out = df.withColumn(scrubbed, F.col(text))
    for name, needles, pattern, mark in SCRUB_STEPS:
        count, may = f"n_{name}", _may_hold(F.col(scrubbed), needles)
        if name == "ip":
            out = out.withColumn("__marked", F.when(may, _mark_ipv4(F.col(scrubbed))))
            out = out.withColumn(
                count, F.coalesce(F.regexp_count("__marked", F.lit(_IPV4_VALID)), F.lit(0)))
            replaced = F.translate(
                F.regexp_replace("__marked", _IPV4_VALID, mark), _MARK_IN + _MARK_OUT, "")
            out = out.withColumn(
                scrubbed, F.when(F.col(count) > 0, replaced).otherwise(F.col(scrubbed))
            ).drop("__marked")
        else:
            out = out.withColumn(
                count, F.when(may, F.regexp_count(scrubbed, F.lit(pattern))).otherwise(0))
            out = out.withColumn(
                scrubbed,
                F.when(F.col(count) > 0, F.regexp_replace(scrubbed, pattern, mark)).otherwise(
                    F.col(scrubbed)
                ),
            )
    return out


PII_CLASSES = [step[0] for step in SCRUB_STEPS]


def shannon_entropy(s: Column | str) -> Column:
    """Bits per character; 0 for an empty text."""

    def of(text: Column) -> Column:
        n = F.length(text).cast("double")
        chars = F.filter(F.array_distinct(F.split(text, "")), lambda x: x != "")

        def add(acc: Column, ch: Column) -> Column:
            p = (n - F.length(F.replace(text, ch, F.lit("")))) / n
            return acc - p * F.log2(p)

        return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(chars, F.lit(0.0), add))

    return let(c(s), of)


def jwt_payload(token: Column | str) -> Column:
    """Payload of a JWT as VARIANT; null when the text is not one."""
    t = c(token)
    parts = F.split(t, r"\.")
    body = F.translate(F.get(parts, F.lit(1)), "-_", "+/")
    padded = F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4))))
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    # nothing is decoded of other texts
    value = let(text, lambda x: F.when(F.substring(F.ltrim(x), 1, 1).isin("{", "["), F.try_parse_json(x)))
    return F.when(t.startswith("eyJ") & (F.size(parts) == 3), value)


def jwt_claims(token: Column | str) -> Column:
    """exp, iat, iss, aud and scope, each kept only when it has the right JSON type."""

    def of(v: Column) -> Column:
        def typed(name: str, kind: str) -> Column:
            part = F.try_variant_get(v, f"$.{name}", "variant")
            is_text = F.schema_of_variant(part) == "STRING"
            if kind == "string":
                return F.when(is_text, F.try_variant_get(v, f"$.{name}", "string"))
            is_num = F.schema_of_variant(part).rlike("^(BIGINT|DOUBLE|DECIMAL)")
            return F.when(is_num, F.try_variant_get(v, f"$.{name}", "double"))

        return F.when(
            v.isNotNull(),
            F.struct(
                typed("exp", "number").alias("exp"),
                typed("iat", "number").alias("iat"),
                typed("iss", "string").alias("iss"),
                typed("aud", "string").alias("aud"),
                typed("scope", "string").alias("scope"),
            ),
        )

    return let(jwt_payload(token), of)


def strip_bearer(value: Column | str) -> Column:
    return F.regexp_replace(c(value), "^Bearer ", "")


def classify_token(value: Column | str) -> Column:
    """(is_token, confidence, format) of a header or parameter value."""

    def of(raw: Column) -> Column:
        def decide(x: Column) -> Column:
            jwt, bits = x["jwt"], x["bits"]
            is_token = jwt | (bits >= K.ENTROPY_MEDIUM)
            high = jwt | (bits >= K.ENTROPY_HIGH)
            return F.struct(
                is_token.alias("is_token"),
                F.when(high, "high").otherwise("medium").alias("confidence"),
                F.when(jwt, "jwt").otherwise("opaque").alias("format"),
            )

        # entropy is rounded far below the bars so that summation order cannot move a value across; a JWT, an id or a
        # short text is decided without it
        def weigh(jwt: Column) -> Column:
            plain = ~jwt & (F.length(raw) >= K.MIN_TOKEN_LENGTH) & ~raw.rlike(K.UUID_RE)
            bits = F.when(plain, F.round(shannon_entropy(raw), 12)).otherwise(0.0)
            return F.struct(jwt.alias("jwt"), bits.alias("bits"))

        return let(let(jwt_payload(raw).isNotNull(), weigh), decide)

    return let(strip_bearer(value), of)


def is_likely_token(value: Column | str) -> Column:
    return classify_token(value)["is_token"]


def is_expired(expires_s: Column | str, now_s: Column | str, skew_s: int = 30) -> Column:
    """A token is refreshed ``skew_s`` seconds before its end. Unknown expiry is not expired."""
    return F.coalesce(c(expires_s) < c(now_s) + F.lit(skew_s), F.lit(False))


def token_cost(text: Column | str) -> Column:
    """Four characters count as one token."""
    return F.ceil(F.length(c(text)) / F.lit(4.0)).cast("bigint")


def tokens_of_length(n: Column | str) -> Column:
    return F.ceil(c(n) / F.lit(4.0)).cast("bigint")
