"""The queries of this subpackage, by name, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wordreel.llm import (
    align, bpe, counts, language, lattice, neardup, packing, quality, spots, substrings, topk,
    variants, warc)
from wordreel.llm.base import held_out, table
from wordreel.llm.variants_sql import SPELLING_VARIANTS

Run = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 2,048 ids."""
    out = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates that every document is in."""
    return neardup.classify(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "class_id", "class_size", "kept")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document; learned from the labels not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"),
                          ~held_out("doc_id", 5))
    rows = docs.select("doc_id", held_out("doc_id", 5).alias("held_out"), "text")
    return quality.score(rows, model).drop("text")


def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 200-byte strings that occur twice."""
    return substrings.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return spots.compare_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors with the highest inner product, for every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


def op7_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from the archives."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                      "refers_to")


def op8_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to."""
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the subword lattice and a unigram baseline."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return lattice.score(docs, held_out("doc_id", 7, 2), group="lang")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the smallest compressed size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs, ~held_out("doc_id", 5))
    rows = docs.select("doc_id", held_out("doc_id", 5).alias("held_out"), "text")
    return language.predict(rows, model).drop("text")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word, the more frequent spelling it varies, and the end of that chain."""
    return variants.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers correspond in every document."""
    return align.align(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over 2,048 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counts.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES: dict[str, Run] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_quality": op3_quality,
    "op4_repeated_substrings": op4_repeated_substrings,
    "op5_spot_signatures": op5_spot_signatures,
    "op6_max_score": op6_max_score,
    "op7_warc_segments": op7_warc_segments,
    "op8_byte_pairs": op8_byte_pairs,
    "op9_lattice_scores": op9_lattice_scores,
    "op10_language": op10_language,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_token_alignment": op12_token_alignment,
    "op13_token_counts": op13_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op6_max_score": """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    "op7_warc_segments": """
WITH p AS MATERIALIZED (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS MATERIALIZED (
  SELECT page_id, octet_length(payload) AS payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(sha1(payload), 1 + (i // 8) * 10, 10) AS BIGINT)
                >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1)), '') AS payload_digest
  FROM p
), o AS (
  SELECT payload_digest, payload_bytes, min(page_id) AS origin FROM d GROUP BY ALL
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> origin THEN origin END AS refers_to
FROM d JOIN o USING (payload_digest, payload_bytes)
""",
    "op11_spelling_variants": SPELLING_VARIANTS,
}
