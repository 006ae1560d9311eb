import hashlib
import re
from collections import Counter, defaultdict

import xxhash
from odd_documents import ODD
from pyspark.sql import functions as F

from wiretally.llm import orderhash

SF = "/root/testdata/sf0.01"


def of_long(x, seed):
    return xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed)


def plain_entries(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen, bins = Counter(), defaultdict(list)
    for i in range(max(len(words) - 2, min(len(words), 1))):
        h = 42
        for w in words[i:i + 3]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        h >>= 29
        v = of_long(seen[h], of_long(h, 42)) >> 29
        seen[h] += 1
        bins[v >> 30].append((v, i))
    out = []
    for b in sorted(bins):
        h = 42
        for _, v in sorted((i, v) for v, i in sorted(bins[b])[:2]):
            h = of_long(v, h)
        out.append(b << 32 | h & 0xFFFFFFFF)
    return out


def plain_likeness(a, b):
    filled = {x >> 32 for x in a} | {x >> 32 for x in b}
    return len(set(a) & set(b)) / len(filled) if filled else 1.0


def plain_rows(docs):
    """docs in their order; of each the edited text and the three entry lists."""
    out = []
    for k, (i, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + after[:quarter]
        out.append((str(i), len(text), edited, plain_entries(text), plain_entries(edited), plain_entries(after)))
    return out


def test_query(spark):
    from wiretally.llm.queries import QUERIES
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = {str(r["doc_id"]): r for r in QUERIES["op9_order_minhash"](spark, SF).collect()}
    assert len(rows) == len(docs)
    for i, n, edited, a, b, c in plain_rows(docs):
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == "".join(f"{x:010x}" for x in a)
        assert r["edited_fingerprint"] == "".join(f"{x:010x}" for x in b)
        assert abs(r["near_edited"] - plain_likeness(a, b)) < 1e-12
        assert abs(r["near_next"] - plain_likeness(a, c)) < 1e-12


def test_odd_rows(spark, odd, nothing):
    rows = orderhash.edited_pairs(odd).collect()
    tie = {(r["doc_id"], r["text"]): r["tie"] for r in odd.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()}
    docs = sorted(((i, t or "") for i, t, *_ in ODD), key=lambda d: (d[0] is not None, d[0] or 0, tie[d]))
    want = sorted((i, n, e, a, b, c) for i, n, e, a, b, c in plain_rows(docs))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited"], r["entries"], r["edited_entries"], r["next_entries"])
                  for r in rows) == want
    assert orderhash.edited_pairs(nothing).count() == 0


def test_next_across_buckets(spark):
    for ids in ([3], [None], [5, 5, 5], [None, None, 1], list(range(0, 90, 3)), [None, *range(40), 7, 7, 7]):
        docs = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id bigint, text string")
        for rows in (1, 2, 7, 1000):
            out = orderhash.with_next(docs, ["text"], rows).collect()
            assert len(out) == len(ids)
            # every text has one predecessor, and the successors form one ring through the sorted ids
            after = {r["text"]: r["next_text"] for r in out}
            assert sorted(after.values()) == sorted(after)
            known = {f"t{k}": (i is not None, i or 0) for k, i in enumerate(ids)}
            falls = sum(known[b] < known[a] for a, b in after.items())
            assert falls == (len(set(known.values())) > 1)


def test_order_matters_and_copies_agree(spark):
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    docs = spark.createDataFrame(
        [(1, " ".join(words)), (2, " ".join(moved)), (3, "  ".join(words)), (4, " ".join(words[:390] + ["x"] * 10))],
        "doc_id bigint, text string")
    e = {r["doc_id"]: r["e"] for r in orderhash.with_entries(docs, "text", "e").collect()}
    assert e[1] == e[3]
    assert plain_likeness(e[1], e[4]) > plain_likeness(e[1], e[2]) > 0  # the same words in another order are farther
