"""Decisions on candidate terms: a log that only grows, and the state that it amounts to.

An entry of the log is never changed. The state of a term in a dictionary is
what its last entry says, by time and then by the entry's id, which is a hash of
what the entry says; so an entry that was written twice counts once, and any
order, file layout or partitioning of the log gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the change log, and what an action makes of a candidate.
LOG = "timestamp string, user_action string, term string, dictionary string, old_value string, new_value string, reason string, examples string, source string"
OUTCOMES = {"approve": "approved", "reject": "rejected"}
SOURCE = "calibration_corpus"
#: Beside them: the note of a decision and the entry's own id.
ENTRY = f"{LOG}, note string, entry_id string"
NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def entries(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Log entries for decisions (timestamp, candidate_term, dictionary, user_action, reason, note).

    candidates: candidate_id, candidate_term, proposed_dictionary and, where it
    is there, example_contexts; of candidates that repeat a term and dictionary
    the first by id counts. Decisions on what is no candidate, and of other
    actions than OUTCOMES, have no entry. Null reasons and notes are empty.
    """
    examples = F.col("example_contexts").cast("string") if "example_contexts" in candidates.columns else F.lit("")
    first = candidates.groupBy(F.col("candidate_term").cast("string").alias("term"), F.col("proposed_dictionary").cast("string").alias("dictionary")).agg(F.min_by(F.coalesce(examples, F.lit("")), "candidate_id").alias("examples"))
    outcome = F.try_element_at(F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair]), F.col("user_action"))
    asked = decisions.select(F.col("timestamp").cast("string").alias("timestamp"), "user_action", F.col("candidate_term").cast("string").alias("term"), "dictionary", outcome.alias("new_value"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("reason", "note")]).where(F.col("new_value").isNotNull())
    rows = asked.join(first, ["term", "dictionary"]).withColumns({"old_value": F.lit("candidate"), "source": F.lit(SOURCE)})
    said = F.to_json(F.struct(*NAMES[:-1]))
    return rows.withColumn("entry_id", F.sha2(said, 256)).select(*NAMES)


def append(log: DataFrame, path: str) -> None:
    """Add entries to the log in a folder."""
    log.select(*NAMES).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY).parquet(path)


def compacted(log: DataFrame) -> DataFrame:
    """The last entry of each term and dictionary, with the number of its entries (decisions) and of changes of mind.

    Entries of a term are gathered as pairs of time and outcome only for that
    count; which entry is the last is settled by a maximum.
    """
    once = log.dropDuplicates(["entry_id"])
    turn = F.struct("timestamp", "entry_id")
    last = once.groupBy("term", "dictionary").agg(F.max_by(F.struct(*[c for c in NAMES if c not in ("term", "dictionary")]), turn).alias("x"), F.count("*").alias("decisions"))
    return last.select("term", "dictionary", "x.*", "decisions")


def replayed(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """candidates with the status and note that the log leaves them with; those never decided on keep their status."""
    state = compacted(log).select(F.col("term").alias("_t"), F.col("dictionary").alias("_d"), F.col("new_value").alias("_s"), F.col("note").alias("_n"))
    there = (F.col("candidate_term").cast("string") == F.col("_t")) & (F.col("proposed_dictionary").cast("string") == F.col("_d"))
    old = {c: F.col(c) if c in candidates.columns else F.lit(d) for c, d in (("status", "new"), ("note", ""))}
    rows = candidates.join(state, there, "left")
    return rows.withColumns({"status": F.coalesce("_s", old["status"]), "note": F.coalesce("_n", old["note"])}).drop("_t", "_d", "_s", "_n")


def decided(candidates: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """The files verified_terms and rejected_terms as the log leaves them: a candidate is in one of them at most."""
    state = replayed(candidates, log)
    return {"verified_terms": state.where(F.col("status") == "approved"), "rejected_terms": state.where(F.col("status") == "rejected")}


def rewrite(spark: SparkSession, path: str, target: str) -> None:
    """Write a log's last entries as a new, shorter log; the old one stays as it is."""
    compacted(read(spark, path)).drop("decisions").select(*NAMES).write.mode("errorifexists").parquet(target)
