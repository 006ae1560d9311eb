"""Quality classifier: naive Bayes features under a linear support-vector machine.

A text is the set of its hashed n-grams: words and word pairs in lower case, and one to three word
shapes in a row (letter case, digits and marks, runs shortened, whether a word repeats its predecessor).
Each indicator is scaled by its log-count ratio between the classes, the vector is brought to unit length,
and a hinge-loss model is fitted by dual coordinate descent. Its margin becomes a probability by a
logistic curve fitted to margins of held-out folds, shifted to the class shares of all training labels.

The fit uses at most ``per_class`` labelled rows of each class, those of the smallest hash of their id:
a bound stated here, whatever the table's size. Scoring covers every whole text, with a model of fixed size.

Defined cases
    A null text is an empty one; texts without words have the score of the model's bias.
    Labels: null ids and null qualities are left out, an id labelled both ways too. Ids labelled
    repeatedly count once, with the least text where they have several. Without two classes every score is the share of label 1 (0.5 without labels).
    Rows of equal text get equal scores. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.session import landed

#: Hash space of the n-grams; the model has so many weights.
BITS = 20
#: Different words whose hashes one task remembers.
REMEMBERED = 300_000
#: Texts featurised together, in characters.
TOGETHER = 400_000


@dataclass
class Model:
    """``weights`` already hold the log-count ratio's factor; ``scale`` is that ratio itself."""

    weights: np.ndarray
    scale: np.ndarray
    bias: float
    slope: float
    shift: float


def shape(word: str) -> str:
    """Character classes of a word, equal ones in a row written once."""
    out = []
    for c in word:
        k = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(64 - BITS)


class Featuriser:
    """Texts to sorted sets of feature numbers, many texts at a time."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def _word(self, word: str) -> tuple[int, int]:
        import xxhash

        if len(self.known) >= REMEMBERED:
            self.known.clear()
        got = (xxhash.xxh64_intdigest(word.lower(), 1), xxhash.xxh64_intdigest(shape(word), 2))
        self.known[word] = got
        return got

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all texts, text after text, and where each text begins (and the last ends)."""
        known, word_of = self.known, self._word
        pairs: list[tuple[int, int]] = []
        sizes = []
        for text in texts:
            words = text.split()
            pairs += [known.get(w) or word_of(w) for w in words]
            sizes.append(len(words))
        n = len(pairs)
        row = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        both = np.array(pairs, dtype=np.uint64)
        w, s = both[:, 0], both[:, 1].copy()
        same = np.zeros(n, bool)
        same[1:] = (w[1:] == w[:-1]) & (row[1:] == row[:-1])
        s[same] = s[same] * np.uint64(3) + np.uint64(1)
        k2 = row[1:] == row[:-1]
        k3 = k2[1:] & k2[:-1]
        a, b, c = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
        grams = [
            (row, _mix(w)), (row, _mix(s + c)),
            (row[1:][k2], _mix(w[:-1] * a + w[1:] * b)[k2]),
            (row[1:][k2], _mix(s[:-1] * b + s[1:] * a + c)[k2]),
            (row[2:][k3], _mix(s[:-2] * a + s[1:-1] * c + s[2:] * b)[k3]),
        ]
        keys = np.sort(np.concatenate([(r << np.uint64(BITS)) | g for r, g in grams]))
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])].astype(np.int64)
        ends = np.searchsorted(keys >> BITS, np.arange(len(texts) + 1))
        return keys & ((1 << BITS) - 1), ends


def batches(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Texts in groups of about TOGETHER characters, each with the place of its first."""
    start, size, group = 0, 0, []
    for i, text in enumerate(texts):
        group.append(text or "")
        size += len(group[-1])
        if size >= TOGETHER:
            yield start, group
            start, size, group = i + 1, 0, []
    if group:
        yield start, group


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = 12,
            seed: int = 3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for min 1/2 |w|^2 + sum cost_i max(0, 1 - y_i w.x_i), the bias being
    the weight of a feature that is always 1. x_i: the scaled indicators of row i at unit length."""
    w, bias = np.zeros(len(scale)), 0.0
    xs = []
    for r in rows:
        v = scale[r]
        xs.append(v / (np.linalg.norm(v) or 1.0))
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            r, x = rows[i], xs[i]
            gradient = y[i] * (w[r] @ x + bias) - 1
            curvature = 2.0 if len(r) else 1.0
            new = min(max(alpha[i] - gradient / curvature, 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def log_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of the classes' smoothed, normalised indicator counts; 0 for features seen nowhere."""
    counts = {}
    for label in (1, -1):
        picked = [r for r, k in zip(rows, y, strict=True) if k == label]
        counts[label] = np.bincount(np.concatenate([np.zeros(0, np.int64), *picked]), minlength=1 << BITS)
    seen = (counts[1] + counts[-1]) > 0
    p, q = counts[1] + smooth, counts[-1] + smooth
    return np.where(seen, np.log((p / p.sum()) / (q / q.sum())), 0.0)


def margins(rows: list[np.ndarray], w: np.ndarray, bias: float, scale: np.ndarray) -> np.ndarray:
    out = []
    for r in rows:
        v = scale[r]
        out.append((w[r] @ v) / (np.linalg.norm(v) or 1.0) + bias)
    return np.array(out)


def logistic(m: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, by Newton steps with a small ridge."""
    a, b, t = 1.0, 0.0, (y > 0).astype(float)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        v = p * (1 - p)
        g = np.array([((p - t) * m).sum() + 1e-2 * a, (p - t).sum() + 1e-2 * b])
        h = np.array([[(v * m * m).sum() + 1e-2, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-2]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-7:
            break
    return float(max(a, 1e-6)), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, share: float, cost: float = 1.0, folds: int = 3) -> Model:
    """``share``: of label 1 among all training labels; ``y``: 1 and -1."""
    per = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * cost

    def one(keep: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        part = [rows[i] for i in np.flatnonzero(keep)]
        scale = log_ratios(part, y[keep])
        w, bias = descend(part, y[keep], scale, per[keep])
        return w, bias, scale

    fold = np.arange(len(rows)) % folds
    held = np.zeros(len(rows))
    for k in range(folds):
        w, bias, scale = one(fold != k)
        held[fold == k] = margins([rows[i] for i in np.flatnonzero(fold == k)], w, bias, scale)
    slope, shift = logistic(held, y)
    sampled = (y > 0).mean()
    shift += math.log(share / (1 - share)) - math.log(sampled / (1 - sampled))
    w, bias, scale = one(np.ones(len(rows), bool))
    return Model((w * scale).astype(np.float32), scale.astype(np.float32), float(bias), slope, float(shift))


def training_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, y``: one row per id that is labelled in one way only."""
    return (labels.filter("doc_id is not null and quality is not null")
            .groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z"))
            .filter("y = z").select("doc_id", F.col("y").cast("int").alias("y")))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; never for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 3000) -> Model | float:
    """A model, or the share of label 1 where there are not two classes. ``labels`` holds training
    rows only; ``per_class`` bounds the sample of each class."""
    spark = docs.sparkSession
    ids = landed(training_labels(labels), "quality-labels")
    counts = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ones, total = counts.get(1, 0), sum(counts.values())
    if not 0 < ones < total:
        return ones / total if total else 0.5
    by_hash = F.xxhash64("doc_id")
    sample = ids.filter("y = 1").orderBy(by_hash, "doc_id").limit(per_class).unionByName(
        ids.filter("y <> 1").orderBy(by_hash, "doc_id").limit(per_class))

    def featurise(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featuriser()
        for part in parts:
            y, key = part.column("y").to_pylist(), part.column("doc_id")
            for start, group in batches(part.column("text").to_pylist()):
                found, ends = make(group)
                n = len(group)
                yield pa.RecordBatch.from_arrays(
                    [key.slice(start, n), pa.array(y[start:start + n], pa.int32()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))],
                    names=["doc_id", "y", "features"])

    # The sample has at most 2 * per_class narrow rows: it is the side to broadcast. An id on many rows counts once.
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = landed(chosen.mapInArrow(featurise, "doc_id bigint, y int, features array<int>"), "quality-sample")
    share = ones / total

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(((k, y, f) for part in parts for k, y, f in zip(
            part.column(0).to_pylist(), part.column(1).to_pylist(),
            [np.array(v.values, dtype=np.int64) for v in part.column(2)], strict=True)),
            key=lambda x: (x[0], x[1], len(x[2]), x[2].tobytes()))
        if len({y for _, y, _ in got}) < 2:
            return
        order = np.random.default_rng(5).permutation(len(got))
        m = fit([got[i][2] for i in order], np.array([1 if got[i][1] == 1 else -1 for i in order]), share)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x]) for x in (m.weights.tobytes(), m.scale.tobytes(), m.bias, m.slope, m.shift)],
            names=["weights", "scale", "bias", "slope", "shift"])

    learned = rows.coalesce(1).mapInArrow(
        learn, "weights binary, scale binary, bias double, slope double, shift double").collect()
    if not learned:
        return share
    r = learned[0]
    return Model(np.frombuffer(r["weights"], np.float32), np.frombuffer(r["scale"], np.float32),
                 r["bias"], r["slope"], r["shift"])


def score_texts(model: Model, make: Featuriser, texts: list[str | None]) -> np.ndarray:
    out = np.zeros(len(texts))
    for start, group in batches(texts):
        found, ends = make(group)
        some = np.flatnonzero(ends[1:] > ends[:-1])  # texts without features have a sum of nothing
        top, norm = np.zeros(len(group)), np.zeros(len(group))
        if len(some):  # each text is summed by itself, so its score does not depend on its neighbours
            top[some] = np.add.reduceat(model.weights[found].astype(np.float64), ends[some])
            norm[some] = np.add.reduceat(np.square(model.scale[found], dtype=np.float64), ends[some])
        size = np.sqrt(norm)
        m = top / np.where(size > 1e-9, size, 1.0) + model.bias
        out[start:start + len(group)] = 1 / (1 + np.exp(-np.clip(model.slope * m + model.shift, -60, 60)))
    return out


def score(docs: DataFrame, model: Model | float, columns: list[str]) -> DataFrame:
    """The named columns of ``docs`` and ``score``, from the text alone."""
    kept = docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("scored_text"))
    if isinstance(model, float):
        return kept.select(*columns, F.lit(model).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*columns, F.lit(0.0).alias("score")).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, m = Featuriser(), shared.value
        for part in parts:
            scores = score_texts(m, make, part.column(len(columns)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(len(columns))), pa.array(scores)], names=[*columns, "score"])

    return kept.mapInArrow(run, schema)
