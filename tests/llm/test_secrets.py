import hashlib
import random
import re

import numpy as np
from odd_documents import ODD

from wiretally.llm import secrets

SF = "/root/testdata/sf0.01"
PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.I | re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def plain(text):
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(PATTERNS)
             for m in p.finditer(text) if ok(m)]
    return [(a, b, name) for a, _, b, name in sorted(found)]


def test_base_spans_of_hard_texts():
    rng = random.Random(3)
    parts = ["token", "TOKEN", "api_key", "apikey", "Secret", "password", "passwd", "=", ":", " = ", "'", '"', " ",
             "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "deadbeef", "abcdefghijkl", "==", "é", "ſecret", "\n", "_", "Z9"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secrets.base_spans(text) == plain(text), text
    assert secrets.base_spans("token=api_key: abcdefghijklmnop") == []  # no retry inside a dropped match


def test_settled_tokens_are_outside_in_every_best_path():
    rng = np.random.default_rng(2)
    for _ in range(300):
        moves = rng.normal(0, 1, (3, 3))
        moves[secrets.OUTSIDE, secrets.INSIDE] = secrets.NEVER
        e = rng.normal(0, 2, (rng.integers(1, 12), 3)) + [2.0, 0, 0]
        whole = secrets.viterbi(e, moves, True)
        sure = secrets.settled(e, moves)
        assert all(s == secrets.OUTSIDE for s, k in zip(whole, sure, strict=True) if k)
        path = [0] * len(e)
        open_ = np.flatnonzero(~sure)
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            if len(run):
                path[run[0]:run[-1] + 1] = secrets.viterbi(e[run[0]:run[-1] + 1], moves, run[-1] == len(e) - 1)
        assert path == whole


def test_viterbi_against_all_paths():
    import itertools
    rng = np.random.default_rng(4)
    for _ in range(50):
        moves = rng.normal(0, 1, (3, 3))
        moves[0, 2] = secrets.NEVER
        e = rng.normal(0, 1, (5, 3))

        def total(path, e=e, moves=moves):
            return sum(moves[a, b] + e[i, b] for i, (a, b) in enumerate(zip((0, *path), path, strict=False)))

        assert tuple(secrets.viterbi(e, moves, True)) == max(itertools.product(range(3), repeat=5), key=total)


def test_the_field_learns_to_find_secrets_without_their_pattern():
    rng = random.Random(5)

    def text(line):
        words = [rng.choice(["some", "plain", "words", "of", "prose", "in", "1999", "a", "row"]) for _ in range(40)]
        return " ".join(words[:20] + line + words[20:])

    def value():
        return "".join(rng.choice("0123456789abcdef") for _ in range(40))

    got = [w for i in range(120) for w in secrets.windows(
        text(["token", "=", f'"{value()}"']) if i % 2 else text([]), True)]
    width = len(got[0][0][0])
    f, y = np.zeros((len(got), secrets.WINDOW, width), np.int64), np.zeros((len(got), secrets.WINDOW), np.int64)
    on = np.zeros(y.shape, bool)
    for i, (a, b) in enumerate(got):
        f[i, :len(b)], y[i, :len(b)], on[i, :len(b)] = a, b, True
    scanner = secrets.Scanner(secrets.fit(f, y, on))
    hidden = value().upper().replace("0", "X")
    new = text(["token", "=", f'"{hidden[:20]}_{hidden[20:]}"'])
    plain_text = text([])
    spans = scanner([new.replace("token =", "token ->"), plain_text])
    assert spans[1] == []
    assert all(s[2] in secrets.KINDS for s in spans[0])
    assert scanner([text(["token", "=", f'"{value()}"'])])[0][0][2] == "assign"


def test_masking():
    assert secrets.masked("ab token=abcdefghijkl1 z", [(3, 22, "assign"), (9, 15, "hex")], "#") == "ab # z"
    assert secrets.masked("x", [], "#") == "x"


def test_odd_rows_and_query(spark, odd, nothing):
    field = secrets.train(odd)
    rows = secrets.scan(odd.select("doc_id", "text"), field, ["doc_id", "text"], mark="[S]").collect()
    assert len(rows) == len(ODD)
    assert all(r["masked"] == (r["text"] or "") and r["spans"] == [] for r in rows)
    assert secrets.train(nothing) is None
    assert secrets.scan(nothing, None, ["doc_id"]).count() == 0

    from wiretally.llm.queries import QUERIES
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_secret_field"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [
            sum(k == name for _, _, k in base) for name in ("assign", "access", "hex")]
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
    assert sum(r["n_assign"] for r in rows) > 0
