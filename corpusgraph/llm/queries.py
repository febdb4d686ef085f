"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm import chat, decontam, hpyp, langid, partenum, permindex, pfair, quality, rollup, secret_scan
from corpusgraph.llm.staging import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hpyp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpyp.score(_table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pfair.mixed(docs).select("doc_id", "source", "block", "position_in_block", "slot", "release", "deadline")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.language_id(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = chat.neighbours(_table(spark, sf_dir, "conversations"))
    out = chat.preference_pairs(chosen, rejected)
    mask = lambda c: F.expr(f"array_join(transform({c}, m -> concat(m.start, ':', m.end)), ',')").alias(c)
    return out.select("pair_id", "n_common", "prompt", "chosen", "rejected", mask("chosen_mask"), mask("rejected_mask"), "identical")


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return rollup.maintained(docs, labels, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and path are the document's source, and its language within the source: documents have no address."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    return quality.classify(docs, _table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(_table(spark, sf_dir, "documents"))


def op10_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permindex.search(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_hpyp_score, op2_source_mix, op3_language_id, op4_preference_format, op5_token_rollup, op6_quality, op7_decontamination, op8_ngram_jaccard, op9_secret_scan, op10_permutation_search)}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLES: dict[str, str] = {
    "op5_token_rollup": rf"""
WITH marks AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT d.source, d.lang, m.toxic, m.quality, len({_WORDS}) AS w1, strlen(coalesce(text, '')) AS b1,
        len(list_filter({_WORDS}, lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]'))) AS w2
      FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id),
left_over AS (SELECT *, (coalesce(toxic, 0) = 1) AS gone, (coalesce(toxic, 0) <> 1 AND quality = 0) AS low FROM d)
SELECT source, lang, t.tokenizer, CAST(count(*) FILTER (NOT gone) AS BIGINT) AS n_docs,
  CAST(sum(CASE WHEN gone THEN 0 WHEN t.tokenizer = 'bytes.1' THEN b1 WHEN low THEN w2 ELSE w1 END) AS BIGINT) AS n_tokens,
  CAST(1 + max(CASE WHEN gone THEN 1 ELSE 0 END) + max(CASE WHEN low AND t.tokenizer = 'words.1' THEN 1 ELSE 0 END) AS BIGINT) AS n_batches
FROM left_over CROSS JOIN (VALUES ('words.1'), ('bytes.1')) t(tokenizer)
GROUP BY source, lang, t.tokenizer HAVING count(*) FILTER (NOT gone) > 0""",
}
