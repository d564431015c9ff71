"""The training-data operators as named queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import clustering, decontamination, hard_negatives, language_id, oracles, packing, quality_rules, simhash, suffix_dedup, suffix_tree_lm, token_counts, topk, warc, word_bpe
from corpusloom.llm.common import table


#: Blocks of 100 bytes, sampled so that every repeated passage of 282 bytes (over fifty words of usual length) has one.
BLOCKS = suffix_dedup.Sizes(period=183, block=100)


def tokenizer(name: str) -> str:
    """Where the installed vocabulary files are; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"), length=400, sizes=BLOCKS)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), limit=4096)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, width=3)


def op5_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(table(spark, sf_dir, "documents"), ~language_id.held_out(F.col("doc_id"), 10, 0))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh row are taken as wrong, one on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_simhash": op4_simhash,
        "op5_suffix_tree_lm": op5_suffix_tree_lm,
        "op6_quality_rules": op6_quality_rules,
        "op7_topk": op7_topk,
        "op8_language_id": op8_language_id,
        "op9_warc": op9_warc,
        "op10_bpe_roundtrip": op10_bpe_roundtrip,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_decontamination": op13_decontamination,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    """The other queries have no SQL: their hashes, tokenizers and models are beyond it."""
    return oracles.all_sql()
