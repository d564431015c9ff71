"""Reports in Markdown from the analysis' tables. Only aggregates of bounded size reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown_table(df: DataFrame, most: int = 20) -> str:
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def sentiment_by_country(summary: DataFrame) -> DataFrame:
    """Means weighted by documents."""
    return summary.groupBy("country").agg(F.sum("doc_count").alias("doc_count"), F.round(F.sum(F.col("avg_sent_score") * F.col("doc_count")) / F.sum("doc_count"), 6).alias("avg_sent_score")).orderBy("country")


def summed(counts: DataFrame, name: str, most: int = 10) -> DataFrame:
    return counts.groupBy("country", name).agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "country", name).limit(most)


def marked(significance: DataFrame) -> DataFrame:
    return significance.withColumn("significant", F.when(F.col("p_value").cast("double") < 0.05, "yes").otherwise("no"))


def corpus_report(tables: dict[str, DataFrame]) -> str:
    """A section for each table, in order."""
    parts = ["# Corpus report", ""]
    for title, df in tables.items():
        parts += [f"## {title}", "", markdown_table(df), ""]
    return "\n".join(parts)
