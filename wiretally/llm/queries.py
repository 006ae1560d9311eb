"""Registered queries of this package, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from wiretally.llm import (
    cells,
    feast,
    forest,
    mixing,
    orderhash,
    packing,
    pii,
    product,
    quality,
    repeats,
    secrets,
    simhash,
    warc,
)
from wiretally.llm.common import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document replicated so that sources weigh their size to the power 0.7."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), details=True)
    return mixed.select("doc_id", "source", "text", F.col("mixed.replica").alias("replica"),
                        F.col("mixed.copies").alias("copies"), F.col("mixed.place").alias("place"))


ORACLES["op1_poisson_mixing"] = """
with docs as (
  select doc_id, source, text, length(coalesce(text, '')) + 1 as size,
         md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')) as digest
  from documents),
sizes as (select source, sum(size)::double as size, pow(sum(size)::double, 0.7) as weight from docs group by source),
rates as (select source, weight / (select sum(weight) from sizes) * (select sum(size) from sizes) / size as rate
          from sizes),
plan as (select source, rate, greatest(ceil(rate / 16.0), 1)::int as parts from rates),
cdf as (select source, list(p order by k) as cdf from (
          select source, k, sum(exp(-rate / parts) * pow(rate / parts, k) / gamma(k + 1.0))
                            over (partition by source order by k) as p
          from plan, range(65) t(k)) group by source),
drawn as (
  select d.*, list_sum(list_transform(range(1, p.parts + 1), lambda j: len(list_filter(c.cdf, lambda x: x <=
           ('0x' || substr(md5('7|' || j || '|' || d.digest), 1, 13))::bigint / 4503599627370496.0)))) as copies
  from docs d join plan p on d.source is not distinct from p.source
  join cdf c on d.source is not distinct from c.source)
select doc_id, source, text, r::int as replica, copies::int as copies,
       md5('7|place|' || r || '|' || digest) as place
from drawn, lateral (select unnest(range(1, copies::bigint + 1)) as r)
"""


@query
def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 2,048 tokens in batches of 16,384, from 8 optimal buckets."""
    return packing.pack(table(spark, sf_dir, "documents"))


ORACLES["op2_length_buckets"] = r"""
with recursive docs as (
  select doc_id, md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')) as digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n
  from documents),
cut as (
  select doc_id, piece, least(n - piece * 2048, 2048) as n_tokens, greatest(least(n - piece * 2048, 2048), 1) as length,
         ('0x' || substr(md5('pack|' || piece || '|' || digest), 1, 13))::bigint / 4503599627370496.0 as u
  from docs, lateral (select unnest(range(0, greatest(ceil(n / 2048.0), 1)::bigint)) as piece)),
hist as (
  select row_number() over (order by length) as i, length, sum(n) over (order by length) as rows,
         sum(n * length) over (order by length) as tokens
  from (select length, count(*) as n from cut group by length)),
dp as (
  select 1 as k, i, length * rows - tokens as cost, [length] as path from hist
  union all
  select d.k + 1, h.i, min(d.cost + h.length * (h.rows - p.rows) - (h.tokens - p.tokens)),
         list_append(arg_min(d.path, (d.cost + h.length * (h.rows - p.rows) - (h.tokens - p.tokens)) * 100000 + d.i),
                     h.length)
  from dp d join hist p on p.i = d.i join hist h on h.i > d.i
  where d.k < least(8, (select count(*) from hist))
  group by d.k, h.i, h.length),
edges as (select path from dp where k = least(8, (select count(*) from hist)) order by i desc limit 1),
placed as (
  select cut.*, list_filter(path, lambda x: x < length) as below, path from cut, edges),
numbered as (
  select *, len(below) + 1 as bucket, path[len(below) + 1] as boundary,
         row_number() over (partition by len(below) order by u, doc_id, piece) - 1 as place
  from placed)
select doc_id, piece::int as piece, n_tokens::int as n_tokens, bucket::int as bucket, boundary::int as boundary,
       (place // (16384 // boundary))::bigint as batch, (place % (16384 // boundary))::int as slot
from numbered
"""


@query
def op3_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every whole text, learned from labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(~quality.held_out()))
    return quality.score(docs, model, ["doc_id"]).select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op4_secret_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: fixed patterns, and what a random field adds."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id",
        *[secrets.count_of(kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]],
        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"))


@query
def op7_simhash_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every whole text and its class of near-duplicates, linked at up to 3 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op5_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without the bytes of 400-byte strings that also start elsewhere."""
    left = repeats.without_repeats(table(spark, sf_dir, "documents"))
    size = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["to"] - s["from"])
    return left.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to Zstandard archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op6_warc_zstd"] = """
with base as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
last as (
  select payload_digest, max(page_id) as last from base where payload_bytes >= 1000
  group by payload_digest, payload_bytes having count(*) > 1)
select page_id, payload_bytes, payload_digest,
       case when last is not null and page_id is distinct from last then 'revisit' else 'response' end as record_type,
       case when page_id is distinct from last then last end as refers_to
from base left join last using (payload_digest)
"""


@query
def op10_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found for every row whose id is divisible by 50, among all others."""
    return forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op8_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: fixed patterns, and what the trained classifier adds."""
    found = pii.find(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select(
        "doc_id", *[pii.count_of(kind).alias(f"n_{kind}") for kind in pii.KINDS[:4]],
        F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


@query
def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they and the next document's are."""
    pairs = orderhash.edited_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        orderhash.fingerprint(F.col("entries")).alias("fingerprint"),
        orderhash.fingerprint(F.col("edited_entries")).alias("edited_fingerprint"),
        orderhash.likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
        orderhash.likeness(F.col("entries"), F.col("next_entries")).alias("near_next"))


@query
def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 8 leading components of the covariance, at unit variance."""
    return feast.whiten(table(spark, sf_dir, "embeddings"), ["vec_id"]).select(
        "vec_id", "component", "n", F.col("deviation").cast("bigint").alias("deviation"), "whitened", "explained",
        "identity_error")


@query
def op12_product_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links of a cosine of at least 0.98 inside its label, and its class."""
    return product.near_duplicates(table(spark, sf_dir, "embeddings"), ["vec_id"])


ORACLES["op12_product_near_duplicates"] = """
with recursive vecs as (
  select row_number() over () as r, vec_id, label, embedding::double[] as v,
         coalesce(label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
                  and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as usable
  from embeddings),
links as materialized (
  select a.r as a, b.r as b, b.vec_id from vecs a join vecs b on a.label = b.label and a.r <> b.r
  where a.usable and b.usable and list_cosine_similarity(a.v, b.v) >= 0.98),
reach as (
  select r as a, r as b from vecs
  union
  select reach.a, links.b from reach join links on reach.b = links.a),
least as (select a, min(vec_id) as component_id from reach join vecs on b = r group by a),
counted as (select a, count(*) as n_links from links group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, coalesce(vec_id = component_id, false) as kept
from vecs join least on r = least.a left join counted on r = counted.a
"""


@query
def op13_grid_cell_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as 8 codebook indexes, with its error and that of all vectors of its label."""
    vectors = table(spark, sf_dir, "embeddings")
    books = cells.train(vectors)
    coded = cells.with_group_error(cells.compress(vectors, books, ["vec_id", "label"]), "label")
    return coded.select("vec_id", "code", "error", F.col("group_error").alias("label_error"),
                        F.lit(cells.digest(books)).alias("codebooks_sha256"))


def _near(n: int) -> str:
    """Every part with the index and distance of its nearest entry of codebook n."""
    return f"""near{n} as materialized (
  select k, p, any_value(x) as x, min(d * 16 + e) % 16 as e, min(d * 16 + e) // 16 as d
  from (select a.k, a.p, a.x, b.e, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) ** 2))::bigint
               as d from cut a join book{n} b on a.p = b.p) group by k, p)"""


def _book(n: int) -> str:
    """Codebook n: entries moved to the floor of the mean of their parts."""
    return f"""book{n} as materialized (
  select b.p, b.e, coalesce(m.x, b.x) as x from book{n - 1} b left join (
    select p, e, list(floor_mean order by i) as x from (
      select p, e, i, (sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) as floor_mean
      from (select p, e, unnest(x) as c, unnest(range(1, len(x) + 1)) as i from near{n - 1}) group by p, e, i)
    group by p, e) m on b.p = m.p and b.e = m.e)"""


_ROUNDS = ",\n".join(f"{_near(n - 1)},\n{_book(n)}" for n in range(1, 7))
ORACLES["op13_grid_cell_codes"] = f"""
with kept as (
  select row_number() over (order by vec_id, embedding) as k, vec_id, label,
         list_transform(embedding, lambda c: floor(4096 * c::double)::bigint) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
cut as materialized (
  select k, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] as x from kept, range(8) t(p)),
book0 as (select p, k - 1 as e, x from cut where k <= 16),
{_ROUNDS},
{_near(6)},
coded as (
  select k, string_agg(lpad(lower(printf('%x', e::int)), 2, '0'), '' order by p) as code, sum(d)::bigint as error
  from near6 group by k),
books as (
  select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from book6)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from kept join coded using (k), books
"""


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
