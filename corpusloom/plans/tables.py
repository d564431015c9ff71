"""The test tables as the operators' inputs.

documents has no year, country or title; they follow from doc_id by rules that
DuckDB can follow too: year is 2022 + doc_id % 5, the country of the corpus
analysis is lang, and media_country is Malaysia or Indonesia by doc_id % 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.profile import fixture
from corpusloom.operators import contexts, corpus, scoring
from corpusloom.sources import io

PROFILE = fixture()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def corpus_docs(spark: SparkSession, sf_dir: str, use_lemma: bool = False) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), "source", (F.col("doc_id") % 5 + 2022).cast("int").alias("year"), F.col("lang").alias("country"), F.col("lang").alias("language"), F.lit("").alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    return corpus.prepare(rows, PROFILE, use_lemma)


def referent_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, "Malaysia").otherwise("Indonesia").alias("media_country"), F.col("source").alias("outlet_name"), F.lit("").alias("date"), F.lit("").alias("title"), "text")


def referent_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.extract(referent_docs(spark, sf_dir), PROFILE)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.checked(scoring.multi_country(scoring.score(referent_contexts(spark, sf_dir), PROFILE)))
