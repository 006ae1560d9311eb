import hashlib
import math

from pyspark.sql import functions as F

from wiretally.llm import mixing


def copies(mean, digest, seed):
    """Inverse of the Poisson distribution by a plain loop."""
    parts = max(1, math.ceil(mean / 16))
    total = 0
    for j in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}|{j}|{digest}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-mean / parts)
        s = p
        while s <= u and k < 64:
            k += 1
            p *= mean / parts / k
            s += p
        total += k
    return total


def digest(doc_id, text):
    return hashlib.md5(f"{'' if doc_id is None else doc_id}|{text or ''}".encode()).hexdigest()


def expected(rows, weights, temperature, total, seed):
    size = {}
    for _, text, _, source in rows:
        size[source] = size.get(source, 0) + len(text or "") + 1
    w = {s: weights.get(s, 0) if weights else n**temperature for s, n in size.items()}
    goal = total or sum(size.values())
    return sorted(
        (str(i), str(t), str(s), n) for i, t, _, s in rows
        for n in range(1, copies(w[s] / sum(w.values()) * goal / size[s], digest(i, t), seed) + 1))


def got(df):
    return sorted((str(r["doc_id"]), str(r["text"]), str(r["source"]), r["mixed"]["replica"])
                  for r in df.select("doc_id", "text", "source", "mixed").collect())


def test_counts_of_odd_rows(spark, odd):
    from odd_documents import ODD
    plain = odd.drop("mixed")
    assert got(mixing.mix(plain, details=True)) == expected(ODD, None, 0.7, None, 7)
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), (None, 2.0)], "source string, weight double")
    df = mixing.mix(plain, weights, total=5e6, seed=3, details=True)
    assert got(df) == expected(ODD, {"a": 1, "b": 3, None: 2}, None, 5e6, 3)


def test_columns_and_empty(odd, nothing):
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix(odd).filter("doc_id = 1 and score <> 'score-1'").count() == 0
    assert mixing.mix(nothing).count() == 0


def test_reaches_the_target_shares(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 2)).alias("source"))
    weights = spark.createDataFrame([("hot", 1.0), ("s0", 2.0), ("s1", 5.0)], "source string, weight double")
    out = mixing.mix(docs, weights).groupBy("source").agg(F.sum(F.length("text") + 1).alias("n")).collect()
    shares = {r["source"]: r["n"] / sum(x["n"] for x in out) for r in out}
    for source, weight in (("hot", 1), ("s0", 2), ("s1", 5)):
        assert abs(shares[source] - weight / 8) < 0.02
