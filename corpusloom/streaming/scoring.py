"""Scoring of documents as they arrive.

Contexts and their measures depend on one document each, so the batch
operators run unchanged on a stream; only the override joins are static.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions.profile import Profile
from corpusloom.operators import contexts, scoring


def scored_stream(docs: DataFrame, profile: Profile) -> DataFrame:
    """Scored contexts of a streaming frame of documents."""
    return scoring.score(contexts.extract(docs, profile), profile)


def read_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def write(scored: DataFrame, folder: str, checkpoint: str):
    """Append scored contexts; returns the running query."""
    return scored.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
