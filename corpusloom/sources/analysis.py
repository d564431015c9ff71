"""All files of an analysis of referents in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import scoring
from corpusloom.sources import io

#: Names of the files, and contexts whose formulas are written out.
FILES = ("contexts_full", "aggregated_by_article", "aggregated_by_outlet", "aggregated_by_media_country_and_ref_country", "summary_matrix", "flagged_cases")
MOST_FORMULAS = 6_000
REPORT_TITLE, NO_ISSUES = "# lexicon_quality_report", ("- status: OK", "- notes: no schema violations detected.")


def with_formula_traces(scored: DataFrame, most: int | None = MOST_FORMULAS) -> tuple[DataFrame, DataFrame]:
    """(contexts with formula_trace_id, the formula traces of the first contexts by id).

    most is the limit of what a reader is shown; None for all. The id of a
    context is that of its last formula and empty beyond the limit.
    """
    some = scored if most is None else scored.orderBy("context_id").limit(most)
    traces = scoring.formula_traces(some)
    last = traces.where(F.col("formula_name") == "IP").select("context_id", F.col("trace_id").alias("formula_trace_id"))
    return scored.join(last, "context_id", "left").na.fill({"formula_trace_id": ""}), traces


def issue_lines(issues: DataFrame) -> DataFrame:
    """The report on dictionaries as lines of Markdown, in order: place and line. issues: file, level, issue, details."""
    each = issues.select(F.lit(3).alias("place"), F.format_string("- [%s] %s: %s (%s)", "level", "file", "issue", "details").alias("line"))
    total = issues.agg(F.count("*").alias("n"))
    head = F.when(F.col("n") == 0, F.array(F.lit(REPORT_TITLE), F.lit(""), *[F.lit(x) for x in NO_ISSUES])).otherwise(F.array(F.lit(REPORT_TITLE), F.lit(""), F.format_string("- total_issues: %d", "n")))
    return total.select(F.posexplode(head).alias("place", "line")).unionByName(each)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def save(tables: dict[str, DataFrame], folder: str, marker_traces: DataFrame | None = None, issues: DataFrame | None = None, change_log: DataFrame | None = None, most_formulas: int | None = MOST_FORMULAS) -> None:
    """Write an analysis: its tables (some of FILES), traces as tables and JSON, the report on dictionaries and their change log.

    Every file is a folder that Spark's tasks write side by side, in Parquet and
    CSV, traces in JSON too. Contexts get the ids of their formula traces.
    """
    if unknown := set(tables) - set(FILES):
        raise ValueError(f"unknown tables: {', '.join(sorted(unknown))}")
    tables = dict(tables)
    if "contexts_full" in tables:
        tables["contexts_full"], formulas = with_formula_traces(tables["contexts_full"], most_formulas)
        write_json(formulas, f"{folder}/formula_traces.json")
    if marker_traces is not None:
        tables["marker_traces"] = marker_traces
        write_json(marker_traces, f"{folder}/marker_traces.json")
    if issues is not None:
        tables["lexicon_quality_report"] = issues
        lines = issue_lines(issues).repartitionByRange("place", "line").sortWithinPartitions("place", "line")
        lines.select("line").write.mode("overwrite").text(f"{folder}/lexicon_quality_report.md")
    if change_log is not None:
        tables["dictionary_change_log"] = change_log
    io.save_outputs(tables, folder)
