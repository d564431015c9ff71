"""What the operators share: reading tables, cutting lineage, small encoders."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts may be long, so batches stay short.
BATCH_ROWS = 512
#: How columns of our own begin that stand beside columns of any name.
OWN = "corpusloom 3f9c1e "
#: The folder that holds the package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Up to this size a table that is one file is dealt out anew to all cores.
SPREAD_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder.

    A small single file is spread over all cores, as it may be one row group,
    which one task would have to work on alone; others stay as they are stored.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= SPREAD_BYTES and len(df.inputFiles()) == 1 else df


def short_batches(df: DataFrame) -> DataFrame:
    """Let Python workers get short batches, so that long texts fit in memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    known = df.sparkSession.sparkContext.environment
    paths = known.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:  # where this package is not installed, workers on the same files find it here
        known["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it names none, a local master uses a temporary folder; on a cluster,
    whose executors would not see that, it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    own = tempfile.mkdtemp(prefix="corpusloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the copy."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of input from which shuffle files are worth letting go of at once.
RELEASE_BYTES = 32 << 20


def release(spark: SparkSession, size: int) -> None:
    """Let go of shuffle files that nothing refers to any more, if what they hold is large; size: bytes of the input.

    Spark removes them when the driver happens to collect its garbage; after a
    cut in the lineage of a large result that is worth doing at once.
    """
    if size < RELEASE_BYTES:
        return
    spark.range(1).count()  # the last job's references go when another one comes
    for _ in range(3):  # the first rounds end what holds the references; removal itself goes on in the background
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def stage(df: DataFrame) -> DataFrame:
    """Write df as a compressed table into the shared folder and go on from the table.

    For large intermediate results: a checkpoint is not compressed.
    """
    path = f"{shared_dir(df.sparkSession)}/corpusloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_column(df: DataFrame, column: str = "text"):
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
