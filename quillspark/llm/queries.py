"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import block_anchors, bpe_pieces, decontamination, language_id, legacy_archive, license_scan, merkle_manifest, metric_join, quality_gam, quality_rules, run_index, site_style, whitening
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.query(spark, table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.query(table(spark, sf_dir, "pages"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.groups(table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.query(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(table(spark, sf_dir, "documents"))


def quality_rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy of op7_quality_rules contributes, from its ledger."""
    return quality_rules.ablation(quality_rules.ledger(quality_rules.measure(table(spark, sf_dir, "documents"))), "v1")


def op8_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy_archive.query(table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_anchors.query(table(spark, sf_dir, "documents"))


def op10_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.query(table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.query(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.query(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_html_extraction, op3_benchmark_decontamination, op4_jaccard_join, op5_suffix_dedup, op6_quality_classifier, op7_quality_rules, op8_legacy_archives, op9_substring_dedup, op10_piece_encoding, op11_merkle_manifest, op12_language_id, op13_embedding_whitening, quality_rules_ablation)}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op1_license_scan": license_scan.oracle(),
    "op7_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, generate_subscripts(w, 1) AS i, w FROM d WHERE len(w) >= 3),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM win WHERE i <= len(w) - 2),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM tri, (VALUES (0), (1), (2)) AS t(k) WHERE c > 1 GROUP BY 1),
li AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, line, count(*) AS c FROM li WHERE regexp_matches(line, '{_WORD}') GROUP BY 1, 2),
dup AS (SELECT doc_id, sum(c) AS n_lines, sum(c - 1) AS n FROM lines GROUP BY 1),
m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    coalesce(dup.n_lines, 0) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '[A-Za-z]')) AS n_alpha
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
b AS (
  SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 30 * n_words)::INT
    + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 25 * n_words)::INT
    + 64 * (n_alpha >= 50 AND 100 * n_upper > 70 * n_alpha)::INT AS failed_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits::BIGINT AS failed_bits FROM b""",
    "op11_merkle_manifest": merkle_manifest.oracle(),
    "op8_legacy_archives": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY 1)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.digest AS payload_digest, CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < p.page_id THEN f.first END AS refers_to FROM p LEFT JOIN f USING (digest)""",
}

_BITS = ", ".join(f"('{r}', {1 << i})" for i, r in enumerate(quality_rules.POLICIES["v1"]))
ORACLES["quality_rules_ablation"] = f"""
WITH book AS ({ORACLES["op7_quality_rules"]})
SELECT rule, count(*) FILTER (failed_bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (failed_bits = bit)::BIGINT AS n_only,
  count(*) FILTER (failed_bits & ~bit = 0)::BIGINT AS n_kept_without FROM book, (VALUES {_BITS}) AS r(rule, bit) GROUP BY rule"""
