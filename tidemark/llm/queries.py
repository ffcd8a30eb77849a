"""The queries of the corpus operators over the synthetic tables, and the SQL that checks those SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_extract, line_dedup, minhash, mixing, oracle, quality_classifier, quality_rules, substring_dedup, suffix_dedup
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("th")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents"), TOKENIZER))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents"), least=1)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("th")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_bpe": op3_bpe,
    "op5_mixing": op5_mixing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_minhash": op9_minhash,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE_SQL = {
    "op2_exact_dedup": """
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_points,
                   sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT text_sha256, first(doc_id ORDER BY n_points DESC, doc_id) AS keep_id, count(*) AS group_size
            FROM t GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
    """,
    "op8_quality_rules": """
        WITH w AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
            FROM documents
        ), c AS (
            SELECT doc_id, text, words, len(words) AS n_words,
                   coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
                   len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                   len(regexp_extract_all(text, '!')) AS n_marks,
                   len(regexp_extract_all(text, '[A-Z]')) AS n_upper,
                   len(regexp_extract_all(text, '[A-Za-z]')) AS n_letters,
                   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
            FROM w
        ), g AS (
            SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM c WHERE len(words) >= 5
        ), f AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i+1], words[i+2], words[i+3], words[i+4]) AS n FROM g
        ), r AS (
            SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM f, range(5) AS t(k) WHERE n > 1 GROUP BY doc_id
        ), m AS (
            SELECT c.doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words, n_marks, n_upper, n_letters, len(lines) AS n_lines,
                   len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_stutters
            FROM c LEFT JOIN r ON c.doc_id = r.doc_id
        ), b AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
        )
        SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 10 * n_symbols > n_words OR 5 * n_marks > n_words OR 2 * n_upper > n_letters
                    OR 5 * n_stutters > n_words OR 2 * n_dup_lines > n_lines OR 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words) AS kept
        FROM b
    """,
    "op1_html_extract": oracle.PAGES,
    "op6_suffix_dedup": oracle.STRINGS,
    "op7_line_dedup": oracle.LINES,
    "op9_minhash": oracle.NEAR,
    "op10_substring_dedup": oracle.SUBSTRING,
}
