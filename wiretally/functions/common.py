"""Small shared pieces for Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word boundaries over ASCII words. Java's own \b treats accented letters as word characters.
WORD = "[A-Za-z0-9_]"
B = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
NOT_AFTER_WORD = f"(?<!{WORD})"
NOT_BEFORE_WORD = f"(?!{WORD})"

# The whitespace class of ECMAScript: wider than Java's \s.
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bounded(pattern: str) -> str:
    """Fill the ``{b}`` marks of a fixed pattern with an ASCII word boundary."""
    return pattern.replace("{b}", B)


def any_of(parts: Iterable[str], ignore_case: bool = True) -> str:
    """One alternation out of many patterns."""
    body = "|".join(bounded(p) for p in parts)
    return ("(?i)" if ignore_case else "") + body


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def str_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def trim_ws(s: Column | str) -> Column:
    return F.regexp_replace(c(s), f"^{WS}+|{WS}+$", "")


def contains_any(s: Column | str, parts: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c(s).contains(p)
    return out


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def ordinal(ts_us: Column | str, seq: Column | str) -> Column:
    """One sortable number out of (event time, sequence): a hash aggregate can take its minimum,
    which it cannot for a struct."""
    return c(ts_us).cast("decimal(38,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + c(
        seq
    ).cast("decimal(20,0)")


def ordinal_seq(order: Column | str) -> Column:
    """The sequence number inside an :func:`ordinal`."""
    return (c(order) % F.lit("10000000000000000000").cast("decimal(20,0)")).cast("bigint")


def ordinal_us(order: Column | str) -> Column:
    """The event time inside an :func:`ordinal`."""
    return F.floor(c(order) / F.lit("10000000000000000000").cast("decimal(20,0)")).cast("bigint")


def round_half_up(x: Column) -> Column:
    """Round a half towards plus infinity, also for negative numbers."""
    return F.floor(x + F.lit(0.5))
