import pytest
from oracle import compare, connect
from test_mixing import digest, expected
from test_nearcopies import pairs_of
from test_simhash import plain_fingerprint, plain_roots

import __spark_entry__ as entry
import corpus_pipeline
from wiretally.llm import mixing, quality, secrets, simhash
from wiretally.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name], []) is None


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality"](spark, docs, SF)
    assert good.columns == docs.columns
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet").filter(~quality.held_out()))
    make = quality.Featuriser()
    want = [r for r in docs.collect() if quality.score_texts(model, make, [r["text"]])[0] >= 0.3]
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, want))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in want}
    assert all((i in kept) == bool(y) for i, y in labels.items() if i in {r["doc_id"] for r in docs.collect()})

    good = good.checkpoint() if spark.sparkContext.getCheckpointDir() else good
    rows = good.collect()
    single = stages["near_duplicates"](spark, good, SF)
    assert single.columns == docs.columns
    rows.sort(key=lambda r: (r["doc_id"], digest(r["doc_id"], r["text"])))
    prints = [plain_fingerprint(r["text"]) for r in rows]
    found = pairs_of([set(simhash.hashes((r["text"] or "").encode(), 5)) for r in rows])
    roots = plain_roots(range(len(rows)), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3
                        or found.get((min(i, j), max(i, j)), 0) >= 0.8)
    first = {}
    for i, r in enumerate(rows):
        first.setdefault(roots[i], r["doc_id"])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(first.values())

    clean = stages["secrets"](spark, single, SF)
    assert clean.columns == docs.columns
    before = {r["doc_id"]: r for r in single.collect()}
    after = {r["doc_id"]: r for r in clean.collect()}
    assert set(before) == set(after)
    for i, r in after.items():
        assert secrets.base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
        if not secrets.base_spans(before[i]["text"]):
            assert r == before[i]

    mixed = stages["mixing"](spark, clean, SF)
    assert mixed.columns == docs.columns
    plain = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in after.values()]
    assert sorted((str(r["doc_id"]), str(r["text"]), str(r["source"])) for r in mixed.collect()) == sorted(
        x[:3] for x in expected(plain, None, 0.7, None, 7))

    packed = stages["packing"](spark, mixed, SF).collect()
    tokens = sum(len(r["text"].split()) for r in mixed.collect())
    assert sum(r["n_tokens"] for r in packed) == tokens == sum(len(r["text"].split()) for r in packed)


def test_run_follows_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    found = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, docs.collect()))


def test_odd_and_empty_documents(spark, odd, nothing):
    for docs in (odd, nothing):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
            assert name == "packing" or now.columns == docs.columns
        assert now.count() >= 0 and (docs is odd or now.count() == 0)
    assert mixing.mix(nothing).columns == nothing.columns


def test_the_rest_works_without_this_package(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True,
                         env={**os.environ, "PYTHONPATH": str(copy)}).stdout.split()
    assert int(out[-2]) > 100 and out[-1] == "False"
