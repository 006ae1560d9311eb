import hashlib
import random
import re
import time

from odd_documents import ODD

from wiretally.llm import pii

SF = "/root/testdata/sf0.01"
PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, body):
    number = re.sub("[^0-9]", "", body)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in body.split(".")),
            "card": 12 <= len(number) <= 19 and luhn(number), "phone": 9 <= len(number) <= 15}[kind]


def plain(text):
    found = [(m.start(), k, m.end(), name) for k, (name, p) in enumerate(PATTERNS)
             for m in re.finditer(p, text) if valid(name, m[0])]
    return [(name, a, b) for a, _, b, name in sorted(found)]


def base(rows):
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "model"] for r in rows}


def test_base_spans_of_hard_texts(spark):
    rng = random.Random(7)
    parts = ["a@b.co", "@", ".", "_x", "user", "mail.example.com", "1.2.3.4", "255", "256", "0", "001", " ", "-", "é", "𝒳",
             "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-0100", "+", "(", ")", "12", "%", "\n", "5500005555555559"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = base(pii.find(docs, ["doc_id"]).collect())
    for i, text in enumerate(texts):
        assert got[i] == plain(text), text


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 300_000 + " x@y.zz", "1 " * 200_000 + "@", "a." * 150_000 + "@", "+" * 200_000, "a@b" + ".c" * 100_000,
             "x@y.zz 4111 1111 1111 1111 " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    start = time.time()
    got = base(pii.find(docs, ["doc_id"]).collect())
    assert time.time() - start < 60
    assert got[0] == [("email", 300_001, 300_007)] and got[4] == [("email", 0, 200_003)]
    assert len(got[5]) == 10_000 and got[5][-1] == ("card", 27 * 4999 + 7, 27 * 4999 + 26)


def test_reliabilities_of_planted_labelers():
    rng = random.Random(1)
    counts, truth = {}, {}
    for _ in range(4000):
        y = rng.random() < 0.3
        votes = [rng.choices([0, 1 if y else 2, 2 if y else 1], [0.3, 0.7 * q, 0.7 * (1 - q)])[0]
                 for q in (0.95, 0.9, 0.85, 0.9, 0.6)]
        p = 0
        for v in votes:
            p = p * 3 + v
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(y)
    prior, chance = pii.reliabilities(counts)
    assert abs(prior - 0.3) < 0.05
    right = sum((chance[p] > 0.5) == y for p, ys in truth.items() for y in ys)
    assert right / 4000 > 0.93


def test_the_classifier_adds_spans_like_the_known_ones(spark):
    rng = random.Random(2)
    docs = []
    for i in range(300):
        tail = f"{rng.randint(200, 999)}-555-{rng.randint(1000, 9999)}"
        docs.append((i, f"please call phone {'+1 ' if i % 2 else ''}{tail} today, said person {i}"))
    docs += [(1000 + i, f"see version {rng.randint(1000000, 9999999)} of table {i}") for i in range(300)]
    rows = {r["doc_id"]: r["spans"] for r in pii.find(
        spark.createDataFrame(docs, "doc_id bigint, text string"), ["doc_id"]).collect()}
    added = {i for i, s in rows.items() if any(x["kind"] == "model" for x in s)}
    assert sum(i % 2 == 0 for i in added if i < 1000) > 140  # numbers without a prefix, in the same context
    assert not {i for i in added if i >= 1000}


def test_odd_rows_and_query(spark, odd, nothing):
    rows = pii.find(odd, ["doc_id", "score"]).collect()
    assert len(rows) == len(ODD) and all(r["spans"] == [] and r["score"] == f"score-{r['doc_id']}" for r in rows)
    assert pii.find(nothing, ["doc_id"]).count() == 0

    from wiretally.llm.queries import QUERIES
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op8_weak_supervision_pii"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _ in PATTERNS] == [sum(s[0] == k for s in spans) for k, _ in PATTERNS]
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_plan_has_no_python(spark):
    from wiretally.llm.queries import QUERIES
    for name in ("op1_poisson_mixing", "op8_weak_supervision_pii", "op9_order_minhash"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name
