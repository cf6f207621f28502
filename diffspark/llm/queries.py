"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode_decode
from .common import shared_dir, table
from .counts import token_counts
from .importance import importance_resample
from .jaccard import link_report
from .kneser_ney import classify
from .mix import mix_report
from .quality_rules import compression_bands
from .secrets import secret_report
from .tokenfile import read_token_files, write_token_files
from .topk import exact_top_k
from .toxicity import toxicity
from .warc import read_warc, write_warc
from .whitening import whiten


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source weights 5, 2, 1; shares of 150 % of all words; targets of at most twice a source."""
    return mix_report(table(spark, sf_dir, "documents"), keep=["doc_id"], weights=(5, 2, 1), share=1.5, most=2.0)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wavelet-matrix files of all documents, written and read back."""
    out = shared_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out, end_id=2)
    return read_token_files(spark, out)


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty ledger, so that every blob is scanned."""
    return secret_report(table(spark, sf_dir, "documents"), shared_dir(spark, "ledger"), keep=["doc_id"])


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "lang", "n_chars", "perplexity", "low", "high", "kept")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_report(table(spark, sf_dir, "documents"), width=5, percent=80)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every distinct text is encoded."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark, "counts"), keep=["doc_id"])


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws 5 % of the documents of at least 20 words towards the benchmark's n-grams."""
    rows = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"], percent=5, least_words=20)
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 16 components of all distinct vectors."""
    return whiten(table(spark, sf_dir, "embeddings"), components=16)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic from a score of 0.7 on."""
    rows = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"], limit=0.7)
    return rows.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))


QUERIES = {f.__name__: f for f in (op1_mix, op2_exact_top_k, op3_token_files, op4_compression_bands, op5_secret_scan, op6_warc, op7_kneser_ney, op8_jaccard_join, op9_bpe, op10_token_counts, op11_importance_resample, op12_whiten, op13_toxicity)}

ORACLE_SQL = {
    "op11_importance_resample": r"""
WITH RECURSIVE byte_step AS (SELECT i, 0 AS k, i::UINTEGER AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, (CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END)::UINTEGER FROM byte_step WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM byte_step WHERE k = 8),
texts AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (SELECT kind, id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT kind, id, r, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT kind, id, r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, range(1, 4) o(n))),
grams AS (SELECT kind, id, r, g, count(*) AS k FROM runs GROUP BY ALL),
bucket AS (SELECT g, CAST(xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(range(1, strlen(g) + 1), lambda j: ('0x' || substr(hex(encode(g)), 2 * j - 1, 2))::UINTEGER)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])::UINTEGER), 4294967295::UINTEGER) % 10000 AS INTEGER) AS b
  FROM (SELECT DISTINCT g FROM grams), tab),
counts AS (SELECT b, sum(k) FILTER (kind = 0) AS s, sum(k) FILTER (kind = 1) AS t FROM grams JOIN bucket USING (g) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (total_s + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (total_t + 10000)))) AS BIGINT) AS gain
  FROM counts, (SELECT coalesce(sum(s), 0)::DOUBLE AS total_s, coalesce(sum(t), 0)::DOUBLE AS total_t FROM counts)),
weight AS (SELECT r, sum(k * gain) AS w, sum(k) AS n FROM grams JOIN bucket USING (g) JOIN gain USING (b) WHERE kind = 0 GROUP BY r),
scored AS (SELECT id AS doc_id, len(words.w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight.w, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight.w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weight USING (r) WHERE kind = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM placed""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', substr(s, i, 1)) - 1), 4, '0')), '') AS bits FROM d)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT
    + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM b""",
    "op2_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5""",
    "op8_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.k >= 80 * (na.n + nb.n - p.k)),
c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.doc_id WHERE c.r < l.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(r) FROM c WHERE c.doc_id = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)""",
}
