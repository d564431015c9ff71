"""Dictionaries from several places as one: terms by priority, each once whatever its letter case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import numbering

#: Under which names a column may come, the first that is there counts.
MARKER = ("marker", "term", "lemma")
NAMES = {
    "ideological_markers": {"term": MARKER},
    "emotional_markers": {"term": ("marker", "term"), "intensity": ("intensity", "intensity_level")},
    "metaphor_markers": {"term": MARKER},
    "evi_lexicon": {"term": ("term", "marker"), "polarity": ("polarity", "polarity_hint"), "category": ("category",)},
    "actor_actions": {"term": ("verb_or_phrase", "term"), "polarity": ("action_polarity", "polarity")},
    "consequence_markers": {"term": ("term_or_phrase", "term"), "polarity": ("consequence_polarity", "polarity")},
    "technical_mention_patterns": {"term": ("pattern",)},
}
#: Columns that a table may lack: the lexicon of evaluation without categories is all of one kind.
OPTIONAL = {("evi_lexicon", "category")}
#: What levels and polarities are also called.
LEVELS = {"weak": ("weak", "low"), "medium": ("medium", "mid"), "strong": ("strong", "high")}
SIDES = {"pos": ("positive", "pos", "+"), "neg": ("negative", "neg", "-")}
CATEGORIES = {"action": ("action", "actor_action"), "consequence": ("consequence",)}

LIST = "list string, term string, place long"


def called(value: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """The name under which one of its aliases is kept; null for others."""
    low = F.lower(T.stripped(value.cast("string")))
    return F.coalesce(*[F.when(low.isin(*aliases), name) for name, aliases in names.items()])


def override_terms(name: str, table: DataFrame) -> DataFrame:
    """list, term and place (the row's number) of a table of overrides, whose columns may have any of their NAMES.

    table: place and the columns. Lists are the marker lists, emotional_<level>
    and rubric_<side>_<lex, action or consequence>. Rows without a term, a level
    or a side that is known are left out, and tables that lack a needed column
    give no rows.
    """
    columns = {field: next((c for c in names if c in table.columns), None) for field, names in NAMES[name].items()}
    if any(c is None and (name, field) not in OPTIONAL for field, c in columns.items()):
        return table.sparkSession.createDataFrame([], LIST)
    of = lambda field: F.col(columns[field]) if columns.get(field) else F.lit("")
    if name == "emotional_markers":
        target = F.concat(F.lit("emotional_"), called(of("intensity"), LEVELS))
    elif name in ("evi_lexicon", "actor_actions", "consequence_markers"):
        kind = {"actor_actions": F.lit("action"), "consequence_markers": F.lit("consequence")}.get(name, F.coalesce(called(of("category"), CATEGORIES), F.lit("lex")))
        target = F.concat(F.lit("rubric_"), called(of("polarity"), SIDES), F.lit("_"), kind)
    else:
        target = F.lit({"ideological_markers": "ideological", "metaphor_markers": "metaphor", "technical_mention_patterns": "technical_patterns"}[name])
    rows = table.select(target.alias("list"), T.stripped(F.coalesce(of("term").cast("string"), F.lit(""))).alias("term"), F.col("place").cast("long").alias("place"))
    return rows.where(F.col("list").isNotNull() & (F.col("term") != ""))


def overrides(tables: dict[str, DataFrame]) -> DataFrame:
    """The terms of all tables of overrides by name; the place of a term goes by the order of the tables first."""
    parts = [override_terms(name, tables[name]).withColumn("table", F.lit(i)) for i, name in enumerate(NAMES) if name in tables]
    rows = reduce(DataFrame.unionByName, parts)
    return numbering.numbered(rows, "_n", ["table", "place", "term"]).select("list", "term", F.col("_n").alias("place"))


def united(parts: list[DataFrame]) -> DataFrame:
    """list, term and n (from 1 in each list) of several lists together: those of an earlier part first, in their own order.

    parts: list, term and place. A term that occurs again in any letter case
    counts where it stands first, as it is written there. Blank terms are none.
    """
    rows = reduce(DataFrame.unionByName, [p.select("list", T.stripped(F.coalesce("term", F.lit(""))).alias("term"), F.lit(i).alias("part"), F.col("place").cast("long").alias("place")) for i, p in enumerate(parts)])
    first = rows.where(F.col("term") != "").groupBy("list", F.lower("term").alias("key")).agg(F.min(F.struct("part", "place", "term")).alias("x"))
    ranked = numbering.numbered(first.select("list", "x.part", "x.place", "x.term"), "_n", ["list", "part", "place", "term"])
    starts = ranked.groupBy("list").agg((F.min("_n") - 1).alias("_before"))
    return ranked.join(starts, "list").select("list", "term", (F.col("_n") - F.col("_before")).alias("n"))
