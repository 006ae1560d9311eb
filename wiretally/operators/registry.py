"""Framework detectors as rows of a table.

A rule says where to look (``html`` or a header), for which text, and which signal of which framework that is. Conditions of
one signal must all hold. Users add detectors by adding rows. All texts that rules look for in pages go into one automaton,
built once per task, which finds them in a single pass over a page, however many rules there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.functions.pages import S

RULE_SCHEMA = ("pos int, framework string, level string, signal string, place string, text string, fold boolean")
#: A registry is a table of settings that every task holds; more rows than this are taken for another table.
MAX_RULES = 100_000
#: Pages of a batch whose findings are returned together.
PAGES = 256
LEVELS = ["high", "medium", "low"]
FOUND = "array<struct<rank:int,ord:int,name:string,confidence:string,signals:array<string>>>"
FOUND_TYPE = pa.list_(pa.struct([("rank", pa.int32()), ("ord", pa.int32()), ("name", pa.string()),
                                 ("confidence", pa.string()), ("signals", pa.list_(pa.string()))]))


def default_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules: ``pos`` orders frameworks and signals; ``level`` is a fixed one or ``count`` (two signals make it
    high); a null ``text`` means that the header is present; ``fold`` compares in lower case."""
    rows = [(i, *rule) for i, rule in enumerate(K.FRAMEWORK_RULES)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


@dataclass
class Matcher:
    """Rules ready to be matched: conditions by place, and signals by their conditions."""

    rules: list[tuple]
    needs: dict[tuple[str, str], set[int]] = field(default_factory=dict)
    levels: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        import ahocorasick

        self.rules = sorted(self.rules, key=lambda r: r[0])
        texts: dict[bool, dict[str, list[int]]] = {False: {}, True: {}}
        self.headers: dict[str, list[tuple[int, str | None, bool]]] = {}
        for n, (_, framework, level, signal, place, text, fold) in enumerate(self.rules):
            self.needs.setdefault((framework, signal), set()).add(n)
            self.levels.setdefault(framework, level)
            if place == "html":
                if text:
                    texts[bool(fold)].setdefault(text.lower() if fold else text, []).append(n)
            else:
                self.headers.setdefault(place.lower(), []).append((n, text, bool(fold)))
        self.order = {name: i for i, name in enumerate(self.levels)}
        self.automata = []
        for fold, known in texts.items():
            if known:
                automaton = ahocorasick.Automaton()
                for text, numbers in known.items():
                    automaton.add_word(text, numbers)
                automaton.make_automaton()
                self.automata.append((fold, automaton))

    def conditions(self, html: str | None, headers: list[tuple[str, str]] | None) -> set[int]:
        """Numbers of the conditions that a page meets."""
        met: set[int] = set()
        for fold, automaton in self.automata:
            for _, numbers in automaton.iter((html or "").lower() if fold else html or ""):
                met.update(numbers)
        for name, value in headers or []:
            for n, text, fold in self.headers.get((name or "").lower(), []):
                if value is not None and (text is None or (text.lower() in value.lower() if fold else text in value)):
                    met.add(n)
        return met

    def frameworks(self, met: set[int]) -> list[dict]:
        signals: dict[str, list[str]] = {}
        for (framework, signal), needed in self.needs.items():
            if needed <= met:
                signals.setdefault(framework, []).append(signal)
        out = []
        for name, found in signals.items():
            level = self.levels[name]
            if level == "count":
                level = "high" if len(found) >= 2 else "medium"
            out.append({"rank": LEVELS.index(level), "ord": self.order[name], "name": name, "confidence": level,
                        "signals": found})
        return sorted(out, key=lambda f: (f["rank"], f["ord"]))


def api_paths(name: Column, html: Column) -> Column:
    """Paths that a framework usually serves; none for frameworks of user rules."""
    known = F.create_map(*[x for n, paths in K.FRAMEWORK_PATHS.items() for x in (
        F.lit(n), F.array(*[F.lit(p) for p in paths]))])
    build = F.nullif(F.regexp_extract(html, rf'"buildId"{S}*:{S}*"([^"]+)"', 1), F.lit(""))
    more = F.when((name == "Next.js") & build.isNotNull(),
                  F.array(F.concat(F.lit("/_next/data/"), build, F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.coalesce(F.try_element_at(known, name), F.array().cast("array<string>")), more)


def matched(matcher: Matcher, part: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of pages, headers last, with the frameworks found in place of the headers. One page at a time
    becomes Python's, because a batch has up to 10,000 of them."""
    html, headers = part.columns[-2:]
    for start in range(0, part.num_rows, PAGES):
        found = []
        for page, given in zip(html.slice(start, PAGES), headers.slice(start, PAGES), strict=True):
            entries = [(h["key"], h["value"]) for h in given.as_py() or []]
            found.append(matcher.frameworks(matcher.conditions(page.as_py(), entries)))
        yield pa.RecordBatch.from_arrays(
            [*part.slice(start, PAGES).columns[:-1], pa.array(found, FOUND_TYPE)], names=names)


def detect(pages: DataFrame, keep: list[str], rules: DataFrame | None = None) -> DataFrame:
    """The kept columns and ``frameworks`` (rank, ord, name, confidence, signals, api_paths; best confidence first) of
    pages (``html``, ``headers``). A null page or header map has no signals."""
    rows = (rules if rules is not None else default_rules(pages.sparkSession)).select(
        *[f.split()[0] for f in RULE_SCHEMA.split(", ")]).limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    table = [tuple(r) for r in rows]
    kept = pages.select(*keep, F.col("html").alias("page_html"), F.map_entries("headers").alias("page_headers"))
    schema = kept.drop("page_headers").withColumn("found", F.lit(None).cast(FOUND)).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(table)
        for part in parts:
            yield from matched(matcher, part, [*schema.names])

    def with_paths(f: Column) -> Column:
        return F.struct(f["rank"].alias("rank"), f["ord"].alias("ord"), f["name"].alias("name"),
                        f["confidence"].alias("confidence"), f["signals"].alias("signals"),
                        api_paths(f["name"], F.col("page_html")).alias("api_paths"))

    return kept.mapInArrow(run, schema).select(*keep, F.transform("found", with_paths).alias("frameworks"))
