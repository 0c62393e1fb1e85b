"""Registered queries of the training-data operators, with the SQL that must agree where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import lexical, licenses, lm, neardup, packing, pieces, quality, repeats, rules, runs, sharding, topk, toxicity
from panelyard.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_sites(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op6_hyperminhash(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"))


@query
def op7_residual_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2)


@query
def op8_adaptive_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.judge(table(spark, sf, "documents"))


@query
def op10_interleave(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf, "documents"), shards=24)


@query
def op2_segment_top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query
def op9_partial_matching(spark: SparkSession, sf: str) -> DataFrame:
    return lm.score_documents(table(spark, sf, "documents"))


@query
def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of documents: their source, language and a folder of a hundred ids, to three depths by id."""
    docs = table(spark, sf, "documents")
    name, folder = F.col("doc_id").cast("string"), F.floor(F.col("doc_id") / 100).cast("string")
    depth = F.pmod(F.col("doc_id"), F.lit(4))
    path = (F.when(depth == 0, F.concat_ws("/", "source", name)).when(depth == 1, F.concat_ws("/", "source", "lang", name))
            .otherwise(F.concat_ws("/", "source", "lang", folder, name)))
    return licenses.scan(docs, path)


@query
def op5_sampled_pieces(spark: SparkSession, sf: str) -> DataFrame:
    rows = pieces.encode(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.crc32(F.array_join("ids", ",").cast("binary"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), digest.alias("ids_crc32"), "lossless")


def _planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of all documents; of every tenth, by a digest of the id, the words from some place on are made periodic."""
    h = F.crc32(F.col("doc_id").cast("string"))

    def periodic(words):
        n, g = F.size(words), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        # the array is bound to a lambda variable, so that it is made once and not once a word
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n == 0, F.col("text")).otherwise(F.array_join(
            F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(words, place(i.cast("long")).cast("int") + 1)), " "))

    words = F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    made = F.transform(F.array(words), periodic)[0]
    return docs.select("doc_id", F.when(h % 10 == 0, made).otherwise(F.col("text")).alias("text"))


@query
def op12_block_convolution(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs.periodic_runs(_planted(table(spark, sf, "documents")))
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate(
        "runs", F.col("runs")[0],
        lambda a, b: F.when(better(b, a), b).otherwise(a))  # ties: the first in order of start, then period
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = rows.withColumn("best", F.when(F.size("runs") > 0, best))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


@query
def op11_pipelined_terms(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=50)


@query
def op13_induced_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    rows = repeats.remove_repeats(table(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op2_segment_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
 FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20"""

ORACLE["op11_pipelined_terms"] = """
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*) AS nd, sum(n)::BIGINT AS len FROM sizes),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, nd),
found AS (SELECT tf.doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nd) // len)))) AS c
 FROM tf JOIN weights USING (term) JOIN sizes ON sizes.doc_id = tf.doc_id, whole),
scores AS (SELECT item_id, doc_id, CAST(sum(c) AS BIGINT) AS score FROM wanted JOIN found USING (term) GROUP BY ALL),
ranks AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k, doc_id, score
 FROM scores WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM ranks WHERE k <= 50"""

ORACLE["op13_induced_suffixes"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, md5(substring(x, CAST(2 * s + 1 AS BIGINT), 200)) AS g
 FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS s FROM d WHERE n >= 100)),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1 AS later FROM w),
e AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS fresh FROM f WHERE later),
g AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM e),
r AS (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS b FROM g GROUP BY ALL),
c AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM r),
p AS (SELECT c.doc_id, a, substring(x, CAST(2 * z + 1 AS BIGINT), CAST(2 * (a - z) AS BIGINT)) AS part, b FROM c JOIN d USING (doc_id)),
k AS (SELECT doc_id, string_agg(part, '' ORDER BY a) AS head, max(b) AS z, sum(b - a) AS removed, count(*) AS spans
 FROM (SELECT p.doc_id, p.a, p.b, p.part FROM p) GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(coalesce(head, '') || substring(x, CAST(2 * coalesce(z, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
