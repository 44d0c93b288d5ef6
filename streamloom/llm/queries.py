"""The corpus operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm import chat, decontam, html, line_dedup, near_dup, packing, pii, quality, secrets, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduped(_table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("row.doc_id", "n_lines", F.col("n_gone").alias("n_removed"), F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chat.digest(chat.expand(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(_table(spark, sf_dir, "documents")))


def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(quality.document_statistics(docs), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_minhash_near_dedup, op3_chat_formatting, op4_pii, op5_repeated_strings, op6_secret_scan, op7_benchmark_decontamination, op8_quality_rules, op9_html_extraction, op10_packing)}

#: Escaped texts and roles grow by one for each backslash and each "<|" (and each line end in a role).
ORACLE_SQL = {
    "op3_chat_formatting": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), l as (
  select *, row_number() over (partition by conv_id order by turn, role, text) as k,
         24 + length(role) + length(text)
         + length(text) - length(replace(text, chr(92), '')) + (length(text) - length(replace(text, '<|', ''))) // 2
         + length(role) - length(replace(role, chr(92), '')) + (length(role) - length(replace(role, '<|', ''))) // 2
         + length(role) - length(replace(role, chr(10), '')) as c
  from t
), r as (
  select *, sum(c) over (partition by conv_id order by k) as upto,
         count(*) over (partition by conv_id) as n
  from l
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(upto) filter (role = 'assistant' or k = n) as bigint) as formatted_chars
from r group by conv_id
""",
}
