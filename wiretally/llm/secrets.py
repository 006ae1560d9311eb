"""Secret scans: fixed patterns and a linear-chain conditional random field.

Patterns give the base spans (kinds ``assign``, ``access``, ``hex``). A random field tags every token as
begin, inside or outside of a secret from its shape, its neighbours and features of its file, and
is decoded by Viterbi; the runs it finds outside base spans are added with the kind ``crf``.

The field learns from the base spans of at most ``per_kind`` documents with a likely match and as many
others, those of the smallest hash: a bound stated here. Scanning covers every whole text. Tokens
that no best path can leave outside the state "outside" are recognised by a bound on what a change
to it can cost, for a whole batch at once; Viterbi runs on the stretches between them, with an equal result.

Defined cases
    A null text is an empty one and has no spans. Base matches do not overlap within a kind; across kinds they may.
    Rows alike are scanned each. Without a base match to learn from, only base spans are returned.
    Offsets count code points, the end being exclusive. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import row_digest, text_of
from wiretally.session import landed

KINDS = ["assign", "access", "hex", "crf"]
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that count by themselves as neighbours of a secret; other words count by their shape.
CONTEXT = {"password", "passwd", "secret", "token", "api", "apikey", "api_key", "key", "access", "auth",
           "authorization", "bearer", "basic", "credential", "credentials", "aws", "private", "client",
           "login", "user", "id", "pin", "pass", "pwd", "export", "set", "const", "var", "let", "value"}
TOKEN = re.compile(r"[\w+/-]+(?:\.[\w+/-]+)*|[^\w\s]")
#: A rough test for the sample, in the JVM's dialect.
HINT = r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: Feature space per token and neighbour; each feature has a weight for every state.
SLOTS = 1 << 14
WINDOW = 25
NEVER = -1e3
#: Different tokens whose scores one task remembers, and characters decoded together.
REMEMBERED = 400_000
TOGETHER = 400_000

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns by start, then kind."""
    found: list[Span] = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _slot(name: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(name) % SLOTS


def signature(token: str) -> str:
    """What a token's features depend on: purely alphabetic ones that are no context words differ only in
    case and size, so most words of a text share a few signatures."""
    if token.isalpha() and (low := token.lower()) not in CONTEXT:
        case = "a" if token == low else "A" if token.isupper() else "Aa"
        return f" {case}{min(len(token).bit_length(), 6)}"  # no token begins with a space
    return token


def own_features(token: str) -> list[int]:
    n = len(token)
    sign = signature(token)
    if sign[0] == " ":
        return [_slot(f"own:{sign}")] * 6
    digits = sum(c.isdigit() for c in token)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(token[:200]).values()) if n <= 200 else 5.0
    hexed = all(c in "0123456789abcdef" for c in token)
    size = min(n.bit_length(), 8)
    classes = {"A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in token}
    return [_slot(f"own:{x}") for x in (
        f"shape={''.join(sorted(classes))[:8]}", f"size={size}", f"digits={digits * 4 // n}:{size}",
        f"switches={min(switches, 6)}", f"entropy={int(entropy)}:{size}", f"hex={hexed}:{size}")]


def near_features(token: str, place: str) -> list[int]:
    """Features that a token gives its neighbour at ``place`` (before, before2, after)."""
    sign = signature(token)
    low = token.lower()
    word = sign if sign[0] == " " else low if low in CONTEXT or len(token) == 1 else "#"
    size = min(len(token).bit_length(), 6)
    digits = "9" if any(c.isdigit() for c in token) else "-"
    return [_slot(f"{place}:{word}"), _slot(f"{place}:{digits}{size}")]


def file_feature(text: str) -> int:
    marks = sum(text.count(c) for c in "={}:;|#\"")
    lines = text.count("\n") + 1
    return _slot(f"file:{min(8, (marks * 200 // (len(text) + 1)))}:{min(4, len(text) // lines // 80)}")


@dataclass
class Field:
    """``states``: a row of three scores per feature slot; ``moves``: score of state after state."""

    states: np.ndarray
    moves: np.ndarray


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(features: np.ndarray, y: np.ndarray, mask: np.ndarray, rounds: int = 12, rate: float = 0.3,
        ridge: float = 1e-4, seed: int = 5) -> Field:
    """Conditional likelihood of windows by gradient steps. ``features``: window x token x slot numbers;
    ``y``: states; ``mask``: which tokens exist. Windows are computed side by side."""
    states, moves = np.zeros((SLOTS, 3)), np.zeros((3, 3))
    sums, move_sums = np.full((SLOTS, 3), 1e-6), np.full((3, 3), 1e-6)
    barred = np.zeros((3, 3))
    barred[OUTSIDE, INSIDE] = NEVER
    rng = np.random.default_rng(seed)
    n, t, k = features.shape
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(n), max(1, n // 128)):
            f, gold, on = features[part], y[part], mask[part]
            e = states[f].sum(axis=2)
            e[:, 0, INSIDE] += NEVER
            e[~on] = [0.0, NEVER, NEVER]
            step = moves + barred
            ahead, back = np.zeros(e.shape), np.zeros(e.shape)
            ahead[:, 0] = e[:, 0]
            for i in range(1, t):
                ahead[:, i] = e[:, i] + _log_sum(ahead[:, i - 1, :, None] + step[None], 1)
            for i in range(t - 2, -1, -1):
                back[:, i] = _log_sum(step[None] + (e[:, i + 1] + back[:, i + 1])[:, None, :], 2)
            z = _log_sum(ahead[:, -1], 1)
            p = np.exp(ahead + back - z[:, None, None])
            grad = -p
            np.put_along_axis(grad, gold[:, :, None],
                              np.take_along_axis(grad, gold[:, :, None], 2) + 1.0, 2)
            grad[~on] = 0.0
            pair = np.exp(ahead[:, :-1, :, None] + step[None, None] + (e + back)[:, 1:, None, :]
                          - z[:, None, None, None])
            both = (on[:, 1:] & on[:, :-1])[:, :, None, None]
            expected = (pair * both).sum(axis=(0, 1))
            seen = np.zeros((3, 3))
            ok = both[:, :, 0, 0]
            np.add.at(seen, (gold[:, :-1][ok], gold[:, 1:][ok]), 1.0)
            change = np.zeros((SLOTS, 3))
            np.add.at(change, f.reshape(-1, k), grad.reshape(-1, 1, 3))
            change = change / len(part) - ridge * states
            sums += change ** 2
            states += rate * change / np.sqrt(sums)
            move = (seen - expected) / len(part) - ridge * moves
            move_sums += move ** 2
            moves += rate * move / np.sqrt(move_sums)
    return Field(states, moves + barred)


def windows(text: str, hot: bool) -> Iterator[tuple[list[list[int]], list[int]]]:
    """Training windows of a text: around every base value, or one from its middle."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    values = []
    for start, end, kind in base_spans(text):
        m = ASSIGN.match(text, start) if kind == "assign" else None
        values.append((m.start(2), m.end(2)) if m else (start, end))
    values.sort()
    y, v = [], 0
    for i, (start, end) in enumerate(tokens):
        while v < len(values) and values[v][1] <= start:
            v += 1
        inside = v < len(values) and values[v][0] < end
        first = not (i and y[i - 1] and values[v][0] <= tokens[i - 1][0]) if inside else False
        y.append((BEGIN if first else INSIDE) if inside else OUTSIDE)
    words = [text[a:b] for a, b in tokens]
    centres = [i for i, s in enumerate(y) if s == BEGIN][:50] if hot else []
    for c in centres or [len(words) // 2]:
        low = max(0, c - WINDOW // 2)
        part = range(low, min(len(words), low + WINDOW))
        if part:
            around = [features_at(words, i) for i in part]
            whole = file_feature(text)
            yield [[*f, whole] for f in around], [y[i] if i > low or y[i] != INSIDE else BEGIN for i in part]


def features_at(words: list[str], i: int) -> list[int]:
    def near(j: int, place: str) -> list[int]:
        return near_features(words[j], place) if 0 <= j < len(words) else [_slot(f"{place}:none")] * 2

    return own_features(words[i]) + near(i - 1, "before") + near(i - 2, "before2") + near(i + 1, "after")


def train(docs: DataFrame, *, per_kind: int = 1500) -> Field | None:
    """A field learned from the base spans of a bounded sample; None where there is nothing to learn from."""
    key = F.xxhash64(row_digest())
    keyed = docs.select(key.alias("k"), text_of().rlike(HINT).alias("likely"))
    chosen = landed(
        keyed.filter("likely").select("k").distinct().orderBy("k").limit(per_kind).unionByName(
            keyed.select("k").distinct().orderBy("k").limit(per_kind)).distinct(), "secret-sample")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                got = list(windows(text, True)) or []
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(got)),
                         pa.array([[x for row in f for x in row] for f, _ in got], pa.list_(pa.int32())),
                         pa.array([y for _, y in got], pa.list_(pa.int32()))], names=["k", "f", "y"])

    # At most 2 * per_kind hashes: the side to broadcast.
    sample = docs.select(key.alias("k"), text_of().alias("text")).join(F.broadcast(chosen), "k").dropDuplicates(["k"])
    rows = landed(sample.mapInArrow(cut, "k bigint, f array<int>, y array<int>"), "secret-windows")

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((k, f, y) for part in parts for k, f, y in zip(*(c.to_pylist() for c in part.columns), strict=True))
        if not any(s for _, _, y in got for s in y):
            return
        width = len(got[0][1]) // len(got[0][2])
        f = np.zeros((len(got), WINDOW, width), np.int64)
        y, on = np.zeros((len(got), WINDOW), np.int64), np.zeros((len(got), WINDOW), bool)
        for i, (_, flat, states) in enumerate(got):
            n = len(states)
            f[i, :n], y[i, :n], on[i, :n] = np.array(flat).reshape(n, width), states, True
        field = fit(f, y, on)
        yield pa.RecordBatch.from_arrays(
            [pa.array([field.states.tobytes()]), pa.array([field.moves.tobytes()])], names=["states", "moves"])

    learned = rows.coalesce(1).mapInArrow(learn, "states binary, moves binary").collect()
    if not learned:
        return None
    return Field(np.frombuffer(learned[0]["states"]).reshape(SLOTS, 3),
                 np.frombuffer(learned[0]["moves"]).reshape(3, 3))


def viterbi(e: np.ndarray, moves: np.ndarray, last: bool) -> list[int]:
    """Best states of a stretch that follows an outside token, and precedes one unless ``last``."""
    step = moves.tolist()
    best, came = [step[OUTSIDE][s] + float(e[0, s]) for s in range(3)], []
    for row in e[1:].tolist():
        back, now = [], []
        for s in range(3):
            top = max(range(3), key=lambda a: (best[a] + step[a][s], -a))
            back.append(top)
            now.append(best[top] + step[top][s] + row[s])
        best = now
        came.append(back)
    end = max(range(3), key=lambda s: (best[s] + (0.0 if last else step[s][OUTSIDE]), -s))
    path = [end]
    for back in reversed(came):
        path.append(back[path[-1]])
    return path[::-1]


def settled(e: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Tokens that are outside in every best path. Turning one token outside changes the score by its own
    scores, by the moves to both neighbours, and, if the next token was inside, by making that one a begin;
    where even the least such change is a gain, no best path has the token in another state."""
    gap = np.concatenate([e[1:, BEGIN] - e[1:, INSIDE], [0.0]])
    sure = np.ones(len(e), bool)
    states = (OUTSIDE, BEGIN, INSIDE)
    for y in (BEGIN, INSIDE):
        before = min(moves[a, OUTSIDE] - moves[a, y] for a in states if moves[a, y] > NEVER / 2)
        plain = min(0.0, *(moves[OUTSIDE, c] - moves[y, c] for c in (OUTSIDE, BEGIN)))
        turned = moves[OUTSIDE, BEGIN] - moves[y, INSIDE] + min(
            0.0, *(moves[BEGIN, d] - moves[INSIDE, d] for d in states))
        change = e[:, OUTSIDE] - e[:, y] + before + np.minimum(plain, turned + gap)
        sure &= change > 1e-9
    return sure


class Scanner:
    """Base spans and those of the field, for many texts at a time."""

    def __init__(self, field: Field | None) -> None:
        self.field = field
        self.known: dict[str, int] = {}
        self.used = 0
        self.table = np.zeros((1024, 4, 3))
        if field is not None:
            s = field.states
            self.edge = np.stack([s[_slot(f"{p}:none")] * 2 for p in ("before", "before2", "after")])

    def _id(self, token: str) -> int:
        sign = signature(token)
        if sign in self.known:
            self.known[token] = self.known[sign]
            return self.known[sign]
        n = self.used
        self.used += 1
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        s = self.field.states
        self.table[n, 0] = s[own_features(token)].sum(axis=0)
        for j, place in enumerate(("before", "before2", "after")):
            self.table[n, j + 1] = s[near_features(token, place)].sum(axis=0)
        self.known[token] = self.known[sign] = n
        return n

    def scores(self, words: list[list[str]], texts: list[str]) -> np.ndarray:
        """Scores of every token of every text in every state."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.used = 0
        known, new = self.known, self._id
        ids = np.fromiter((i if (i := known.get(w)) is not None else new(w) for ws in words for w in ws), np.int64)
        sizes = np.array([len(ws) for ws in words])
        row = np.repeat(np.arange(len(words)), sizes)
        t = self.table
        e = t[ids, 0] + self.field.states[[file_feature(x) for x in texts]][row]
        for j, shift in ((1, 1), (2, 2), (3, -1)):
            near = np.tile(self.edge[j - 1], (len(ids), 1))
            if shift > 0 and len(ids) > shift:
                same = row[shift:] == row[:-shift]
                near[shift:][same] = t[ids[:-shift], j][same]
            elif shift < 0 and len(ids) > 1:
                same = row[1:] == row[:-1]
                near[:-1][same] = t[ids[1:], j][same]
            e += near
        return e

    def field_spans(self, texts: list[str]) -> list[list[Span]]:
        out: list[list[Span]] = [[] for _ in texts]
        words = [TOKEN.findall(x) for x in texts]
        if self.field is None or not any(words):
            return out
        e = self.scores(words, texts)
        ends = np.cumsum([len(ws) for ws in words])
        start = 0
        for i, end in enumerate(ends.tolist()):
            part = e[start:end]
            start = end
            if not len(part):
                continue
            open_ = np.flatnonzero(~settled(part, self.field.moves))
            if not len(open_):
                continue
            places: list[tuple[int, int]] | None = None
            for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
                path = viterbi(part[run[0]:run[-1] + 1], self.field.moves, run[-1] == len(part) - 1)
                if any(path):
                    places = places or [m.span() for m in TOKEN.finditer(texts[i])]
                    for j, s in zip(run.tolist(), path, strict=True):
                        if s == BEGIN:
                            out[i].append((*places[j], "crf"))
                        elif s == INSIDE:
                            out[i][-1] = (out[i][-1][0], places[j][1], "crf")
        return out

    def __call__(self, texts: list[str]) -> list[list[Span]]:
        all_spans = []
        for text, more in zip(texts, self.field_spans(texts), strict=True):
            base = base_spans(text)
            added = [s for s in more if not any(b[0] <= s[0] and s[1] <= b[1] for b in base)]
            all_spans.append(sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]))))
        return all_spans


def masked(text: str, spans: list[Span], mark: str) -> str:
    """``text`` with every run of overlapping spans replaced by ``mark``."""
    out, done = [], 0
    for start, end, _ in spans:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join(out) + text[done:] if spans else text


def scan(docs: DataFrame, field: Field | None, columns: list[str], mark: str | None = None) -> DataFrame:
    """The named columns of ``docs`` and ``spans`` (by start, then kind) of the whole text; with ``mark``
    also ``masked``, the text with its secrets replaced."""
    kept = docs.select(*columns, text_of().alias("scanned_text"))
    span = "array<struct<kind: string, start: int, end: int>>"
    schema = docs.select(*columns, F.lit(None).cast(span).alias("spans"),
                         *([F.lit("").alias("masked")] if mark else [])).schema
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for part in parts:
            texts, start = part.column(len(columns)).to_pylist(), 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and size < TOGETHER:
                    size += len(texts[end])
                    end += 1
                group = texts[start:end]
                spans = scanner(group)
                cols = [part.column(i).slice(start, end - start) for i in range(len(columns))]
                cols.append(pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in spans], kind))
                if mark:
                    cols.append(pa.array([masked(x, s, mark) for x, s in zip(group, spans, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
                start = end

    return kept.mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str) -> Column:
    """Number of spans of one kind."""
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
