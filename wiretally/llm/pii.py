"""Personal data: fixed patterns, and a span classifier trained by weak supervision.

Base kinds are found by their patterns. Looser candidates (all base spans, digit groups, titled names, written-out
mail addresses) get votes of five labelers: a strict pattern, two gazetteers, words of the context for and against.
Expectation-maximisation over the counts of the vote patterns, of which there are at most 3**5, estimates how
reliable each labeler is and how likely each pattern is personal data. With these soft labels a
naive Bayes classifier over shape, size and neighbouring words is trained; its spans outside base spans are added
with the kind ``model``. A text is scanned once; what follows works on the narrow table of its candidates.

Everything runs on built-in functions. The patterns are possessive and anchored to the begin of a run of their
characters (or to the end of the last match), which gives the matches of the plain patterns in linear time.
Offsets are running sums over the pieces between matches, in n log n steps for n matches.

Defined cases
    A null text is empty and has no spans. Matches do not overlap within a base kind; across kinds they may.
    Rows alike are scanned each. Without candidates nothing is trained and only base spans are returned.
    Offsets count code points, the end being exclusive. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import text_of
from wiretally.session import landed

KINDS = ["email", "ip", "card", "phone", "model"]

# Patterns.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"(?<![0-9A-Za-z.+@-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z@])"
NAME = r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?"
WRITTEN = r"(?i)\b[a-z0-9._-]{2,30} ?(?:\[at\]|\(at\)| at ) ?[a-z0-9-]{2,30} ?(?:\[dot\]|\(dot\)| dot ) ?[a-z]{2,10}\b"
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"

# What the labelers look for.
STRICT = (r"^(?:\+?[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
          r"|^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}$|^[^ @]+@[^ @]+\.[A-Za-z]{2,}$")
MAIL_HOSTS = r"(?i)(?:gmail|outlook|hotmail|yahoo|icloud|proton|gmx|web|mail[0-9]*|example)\W"
FIRST_NAMES = (r"\b(?:James|Mary|John|Anna|Robert|Maria|Michael|Laura|David|Sarah|Thomas|Julia|Peter|Emma|Paul|Marie|"
               r"Pierre|Hans|Carlos|Juan|Jose|Carmen|Luis|Klaus|Sophie|Louis|Claire|Stefan|Petra|Miguel)\b")
FOR = (r"(?i)\b(?:phone|tel|telephone|mobile|call|fax|sms|whatsapp|e-?mail|mail|contact|write|reach|card|visa|"
       r"mastercard|amex|payment|iban|account|ssn|social security|ip|host|address|name|sincerely|regards)\b")
AGAINST = (r"(?i)\b(?:version|release|build|isbn|issn|doi|page|pages|figure|fig|table|chapter|section|order|invoice|"
           r"ticket|year|population|total|sum|approximately|about|ratio|score|equation|step)\b[^.]{0,12}$")
LABELERS = 5
#: Values of each feature of the final classifier.
SLOTS = 256
FEATURES = 5


def located(text: Column, pattern: str, where: Column) -> Column:
    """Matches of a pattern as structs ``start, end, body, left, right``; none where ``where`` is not true.
    left and right are the neighbouring 40 and 10 code points, up to the next match."""
    pieces, bodies = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.when(where, F.struct(pieces.alias("pieces"), bodies.alias("bodies")))
    found = F.transform(F.filter(F.array(both), lambda b: b.isNotNull()), lambda b: _placed(b["pieces"], b["bodies"]))
    return F.flatten(found)


def _placed(pieces: Column, bodies: Column) -> Column:
    sizes = F.transform(bodies, lambda b, i: F.length(F.get(pieces, i)) + F.length(b))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(bodies) + F.lit(1.0))).cast("int"))

    def double(x: Column, k: Column) -> Column:
        step = F.pow(F.lit(2.0), k).cast("int")
        return F.transform(x, lambda v, i: v + F.when(i >= step, F.get(x, i - step)).otherwise(0))

    def match(end: Column, i: Column) -> Column:
        body = F.get(bodies, i)
        return F.struct((end - F.length(body)).alias("start"), end.alias("end"), body.alias("body"),
                        F.substring(F.get(pieces, i), -40, 40).alias("left"),
                        F.substring(F.get(pieces, i + 1), 1, 10).alias("right"))

    return F.transform(F.aggregate(rounds, sizes, double), match)


def digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    turned = F.reverse(number)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(turned, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def base_matches(text: Column) -> list[Column]:
    """Arrays of the valid matches of the four base kinds."""
    cards = F.filter(located(text, CARD, text.rlike("[0-9][0-9 -]{10}")), lambda m: F.length(digits(m["body"])) <= 19)
    return [
        located(text, EMAIL, F.contains(text, F.lit("@"))),
        F.filter(located(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda m: m["body"].rlike(OCTETS)),
        F.filter(cards, lambda m: luhn(digits(m["body"]))),
        F.filter(located(text, PHONE, F.contains(text, F.lit("+"))),
                 lambda m: F.length(digits(m["body"])).between(9, 15)),
    ]


def votes(m: Column, kind: int) -> Column:
    """Votes of the labelers on a candidate as digits of base 3: 0 abstains, 1 is for, 2 against."""
    body, left, right = m["body"], m["left"], m["right"]
    number = digits(body)
    if kind <= 3:
        strict = F.lit(1)
    else:
        strict = F.when(body.rlike(STRICT), 1).when(number.rlike(r"^([0-9])\1*$") | (
            (F.length(number) > 0) & (F.length(number) < 9)), 2).otherwise(0)
    hosts = F.when(body.rlike(MAIL_HOSTS), 1).otherwise(0)
    names = F.when(F.concat(body, right).rlike(FIRST_NAMES) | left.rlike(FIRST_NAMES), 1).otherwise(0)
    near = F.when(left.rlike(FOR), 1).otherwise(0)
    against = F.when(left.rlike(AGAINST), 2).when(right.rlike(r"^ ?(?:%|km|kg|euros?|dollars?|years?)"), 2).otherwise(0)
    packed = F.lit(0)
    for vote in (strict, hosts, names, near, against):
        packed = packed * 3 + vote
    return packed


def features(m: Column, kind: int) -> Column:
    """Slots of a candidate's features: kind and digits, size, word before, character after, marks inside."""
    body = m["body"]
    word = F.lower(F.regexp_extract(m["left"], r"([A-Za-z]+)[^A-Za-z]*$", 1))
    marks = F.array_join(F.array_distinct(F.split(F.regexp_replace(body, "[A-Za-z0-9]", ""), "")), "")
    parts = [F.concat(F.lit(f"{kind}:"), F.length(digits(body)).cast("string")),
             F.least(F.length(body), F.lit(40)).cast("string"), word,
             F.regexp_replace(F.substring(m["right"], 1, 1), "[A-Za-z]", "a"), marks]
    return F.array(*[F.pmod(F.xxhash64(p), F.lit(SLOTS)).cast("int") for p in parts])


def candidates(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns, ``base`` (spans: start, kind number, end) and ``found`` (the same with votes and
    feature slots) of every whole text."""
    text = F.col("scanned_text")
    matches = base_matches(text)
    more = [located(text, NUMBER, text.rlike("[0-9][0-9 ().-]{5}")),
            located(text, NAME, text.rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\b")),
            located(text, WRITTEN, text.rlike(r"(?i)[\[( ]at[\]) ]") & text.rlike(r"(?i)[\[( ]dot[\]) ]"))]
    scanned = docs.select(*columns, text_of().alias("scanned_text")).select(
        *columns, *[m.alias(f"matches_{k}") for k, m in enumerate([*matches, *more])])

    def spans(k: int) -> Column:
        return F.transform(f"matches_{k}", lambda m: F.struct(
            m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))

    def judged(k: int) -> Column:
        return F.transform(f"matches_{k}", lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(k <= 3).alias("known"),
            votes(m, k).alias("votes"), features(m, k).alias("slots")))

    return scanned.select(*columns, F.array_sort(F.concat(*[spans(k) for k in range(4)])).alias("base"),
                          F.concat(*[judged(k) for k in range(len(matches) + len(more))]).alias("found"))


def reliabilities(counts: dict[int, int], rounds: int = 100) -> tuple[float, dict[int, float]]:
    """Expectation-maximisation over counts of vote patterns: the share of personal data, and its probability
    for every pattern. Each labeler has its own rates of voting for, against and not at all in either class."""
    def unpack(pattern: int) -> list[int]:
        return [pattern // 3 ** (LABELERS - 1 - j) % 3 for j in range(LABELERS)]

    patterns = {p: unpack(p) for p in counts}
    total = sum(counts.values())
    prior = 0.5
    rates = [[[0.4, 0.2, 0.4], [0.4, 0.4, 0.2]] for _ in range(LABELERS)]  # [class][vote]: class 0, then 1
    chance: dict[int, float] = {}
    for _ in range(rounds):
        for p, vs in patterns.items():
            odds = math.log(prior / (1 - prior)) + sum(
                math.log(rates[j][1][v] / rates[j][0][v]) for j, v in enumerate(vs))
            chance[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        yes = sum(chance[p] * n for p, n in counts.items())
        prior = min(max((yes + 1) / (total + 2), 1e-3), 1 - 1e-3)
        new = []
        for j in range(LABELERS):
            sums = [[1.0, 0.2, 1.0], [1.0, 1.0, 0.2]]  # the votes' meaning, as pseudo-counts
            for p, n in counts.items():
                sums[1][patterns[p][j]] += chance[p] * n
                sums[0][patterns[p][j]] += (1 - chance[p]) * n
            new.append([[x / sum(row) for x in row] for row in sums])
        moved = max(abs(a - b) for x, y in zip(rates, new, strict=True)
                    for r, s in zip(x, y, strict=True) for a, b in zip(r, s, strict=True))
        rates = new
        if moved < 1e-9:
            break
    return prior, chance


def lookup(values: list[float], at: Column) -> Column:
    return F.get(F.lit(values), at)


def train(found: DataFrame) -> tuple[float, list[list[float]]] | None:
    """Log odds of the class and of every slot of every feature, from the candidates of all texts."""
    single = found.select(F.explode("found").alias("c")).select("c.votes", "c.slots")
    counts = {r["votes"]: r["n"] for r in single.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    prior, chance = reliabilities(counts)
    table = [0.0] * 3 ** LABELERS
    for p, c in chance.items():
        table[p] = c
    soft = single.select(lookup(table, F.col("votes")).alias("p"), F.posexplode("slots").alias("feature", "slot"))
    sums = soft.groupBy("feature", "slot").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    yes, no = [[0.5] * SLOTS for _ in range(FEATURES)], [[0.5] * SLOTS for _ in range(FEATURES)]
    for r in sums:
        yes[r["feature"]][r["slot"]] += r["yes"]
        no[r["feature"]][r["slot"]] += r["no"]
    odds = [[math.log((y / sum(ys)) / (n / sum(ns))) for y, n in zip(ys, ns, strict=True)]
            for ys, ns in zip(yes, no, strict=True)]
    return math.log(prior / (1 - prior)), odds


def find(docs: DataFrame, columns: list[str], threshold: float = 0.5) -> DataFrame:
    """The named columns and ``spans`` (by start, then kind) of every whole text: base spans and added ones."""
    found = landed(candidates(docs, columns), "candidates")
    model = train(found)

    def named(s: Column) -> Column:
        return F.struct(F.get(F.lit(KINDS), s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    spans = F.col("base")
    if model is not None:
        prior, odds = model

        def chosen(c: Column) -> Column:
            score = F.lit(prior)
            for j in range(FEATURES):
                score = score + lookup(odds[j], F.get(c["slots"], j))
            apart = ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
            return ~c["known"] & (score > math.log(threshold / (1 - threshold))) & apart

        added = F.transform(F.filter("found", chosen), lambda c: F.struct(
            c["start"].alias("start"), F.lit(4).alias("kind"), c["end"].alias("end")))
        spans = F.array_sort(F.concat(spans, F.array_distinct(added)))
    return found.select(*columns, F.transform(spans, named).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str) -> Column:
    """Number of spans of one kind."""
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
