"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of docs, whatever they are called. run() writes each
stage's result to the shared folder and goes on from the copy.

In every stage a null text counts as empty, texts are read whole however long
they are, rows that repeat are rows like others (the near-duplicate stage keeps
one of them) and no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import language_id, packing, quality_rules, simhash, suffix_dedup
from corpusloom.llm.common import OWN, stage, table
from corpusloom.llm.queries import tokenizer

#: A text whose best language has a smaller share than this is rejected.
LEAST_LANGUAGE_SHARE = 0.4
#: Bytes of a repeated passage: about what fifty short words take up.
PASSAGE_BYTES = 200
#: Chunks of text that a worker remembers the tokens of: few, as the workers of all stages stay in memory.
MEMO_CHUNKS = 400_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter (null and empty ones too), or in no language that the labels know, go; a missing lang is filled in. Ties go to the first language by name."""
    lang, share = f"{OWN}lang", f"{OWN}share"
    told = language_id.predict(docs, language_id.learn(docs), lang, share)
    kept = told.where((F.col(lang) != language_id.UNKNOWN) & (F.col(share) >= LEAST_LANGUAGE_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the base rules or lose too much with their host's common lines go; those lines go too. A null source is a host of its own."""
    return quality_rules.cleaned(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near texts (five-word shingles, similarity 0.8) the one with the smallest id stays; a null id comes last."""
    return simhash.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once are cut out; texts without a word left go."""
    return suffix_dedup.without_repeats(docs, PASSAGE_BYTES).where(F.col("text").rlike(quality_rules.A_WORD))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids; an empty text is one piece of one id."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), packing.Plan(memo_entries=MEMO_CHUNKS))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
