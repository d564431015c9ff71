"""Dense numbers in order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.dedup import checkpointed

#: Bits of monotonically_increasing_id that count the rows of a partition.
PLACE_BITS = 33


def numbered(df: DataFrame, column: str = "n", order: list[str | Column] | None = None, first: int = 1) -> DataFrame:
    """df with consecutive numbers in the order of some columns, or in the order in which it is stored.

    Rows are dealt into ranges of the order, written down, counted range by
    range, and numbered from where their range starts; one number for each range
    is all that is gathered. Rows equal in all columns of the order are numbered
    among each other as they come. No rows give no rows.
    """
    rows = df if order is None else df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    rows = checkpointed(rows.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.spark_partition_id().alias("_part"), place.alias("_place")))
    starts, at = [], first
    for part, n in sorted(rows.groupBy("_part").agg(F.count("*")).collect()):  # a row for each partition
        starts.append((part, at))
        at += n
    known = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return rows.join(F.broadcast(known), "_part").select("_row.*", (F.col("_start") + F.col("_place")).alias(column))


def with_ids(df: DataFrame, order: list[str | Column] | None = None, column: str = "doc_id", prefix: str = "doc_") -> DataFrame:
    """df with ids of six digits at least, from 000001 on, in place of a column of that name."""
    rows = numbered(df.drop(column), "_number", order)
    return rows.withColumn(column, F.format_string(f"{prefix}%06d", "_number")).drop("_number")
