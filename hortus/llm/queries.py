"""Registered queries of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.llm import (chat, decontaminate, divergence, exact_dedup, hard_negatives, line_dedup, minhash, mixing, simhash, suffixes,
                        token_counts, toxicity, warc)
from hortus.llm.common import table


def op1_warc(spark, sf_dir: str) -> DataFrame:
    return warc.read_records(warc.write_archives(table(spark, sf_dir, "pages")))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mixing.draw(table(spark, sf_dir, "documents")).drop("source")


def op9_chat(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.format_windows(turns.unionByName(extra)))


def op10_suffixes(spark, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved))


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_line_dedup, op3_exact_dedup, op4_token_counts, op5_decontamination, op6_toxicity, op7_minhash, op8_mixing,
    op9_chat, op10_suffixes, op11_hard_negatives, op12_simhash, op13_divergence, pipeline)}

ORACLES = {
    "op3_exact_dedup": r"""
        with t as (select doc_id, length(coalesce(text, '')) n,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) text_sha256 from documents),
             r as (select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) keep_id,
                          count(*) over (partition by text_sha256) group_size from t)
        select doc_id, keep_id, group_size, doc_id = keep_id kept, text_sha256 from r""",
    "op11_hard_negatives": hard_negatives.SQL,
    "op13_divergence": divergence.SQL,
}
