"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed, and the distinct documents of each host that
hold a line are counted, equal texts once. Lines that more documents of a host
hold than its limit are removed from its documents; a document that loses too
much, or that fails the base rules, is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import OWN, text_column

SPACES = r"[\x20\x09-\x0D]+"
A_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Names of our own columns beside those of docs.
LINES, ROW, KEPT = (f"{OWN}{x}" for x in ("lines", "row", "kept"))


@dataclass(frozen=True)
class Limits:
    """A line is common if over `least_docs` distinct texts of a host hold it, however many it has.

    In small hosts over `share` of the texts are enough, if they are over `few_docs`.
    A document is depleted if fewer than `least_words` words stay, or if over
    `most_removed` of its words are in common lines.
    """

    share: float = 0.05
    least_docs: int = 25
    few_docs: int = 5
    least_words: int = 10
    most_removed: float = 0.8


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def pair_hash(values: Column, apart: int, n: Column) -> Column:
    """Hashes of each value with the one so many places later; the last ones pair with null."""
    return F.zip_with(values, F.slice(values, F.lit(1 + apart), F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))


def line_key(line: Column) -> Column:
    """The hash of a line in lower case with single spaces."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), SPACES, " ")))


def with_key(docs: DataFrame) -> DataFrame:
    """row_key names a row by its id and text: rows equal in both are one document."""
    text = text_column(docs)
    return docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), text.alias("text")).withColumn("text_key", F.xxhash64("text")).withColumn("row_key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_key", F.length("text"), "host"))


def base_measures(rows: DataFrame) -> DataFrame:
    """The measures of each text; rows: what with_key gives.

    Repeated windows are looked for by hash: eight words are hashed pairwise in
    three steps; only texts with equal hashes sort them to find their places.
    """
    keep = ("doc_id", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(A_WORD))
    out = rows.select("doc_id", "row_key", "text", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"), lines.alias("lines"))
    out = out.select(
        "doc_id",
        "row_key",
        F.size("h").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "h",
    )
    n = F.size("h")
    out = out.select(*keep, pair_hash(F.col("h"), 1, n).alias("h"))
    out = out.select(*keep, pair_hash(F.col("h"), 2, n).alias("h"))
    out = out.select(*keep, pair_hash(F.col("h"), 4, n).alias("h"))
    out = out.select(*keep, F.slice("h", F.lit(1), F.greatest(n - 7, F.lit(0))).alias("h"))
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    # behind the random condition, which always holds, filters are not pushed below and the columns not worked out anew for them
    out = out.select(*keep, F.when((F.rand(0) >= 0.0) & repeats, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"))

    def place(k: Column) -> Column:
        here = F.get("s", k)
        return F.when((here["h"] == F.get("s", k - 1)["h"]) | (here["h"] == F.get("s", k + 1)["h"]), here["i"])

    places = F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), F.size("s") - 1), place), lambda i: i.isNotNull()))
    out = out.select(*keep, F.when((F.rand(0) >= 0.0) & F.col("s").isNotNull(), places).alias("p"))
    covered = F.aggregate(F.zip_with("p", F.slice("p", F.lit(2), F.size("p")), lambda a, b: F.least(F.lit(8), F.coalesce(b - a, F.lit(8)))), F.lit(0), lambda s, x: s + x)
    out = out.select(*keep, F.when(F.col("p").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def lines_of(rows: DataFrame) -> DataFrame:
    """host, text_key, row_key, line and its words: a row for each distinct line of each row that has a word."""
    parts = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(A_WORD)), lambda x: F.struct(line_key(x).alias("line"), F.size(words_of(x)).cast("long").alias("words")))
    each = rows.select("host", "text_key", "row_key", F.explode(parts).alias("x"))
    return each.groupBy("host", "text_key", "row_key", F.col("x.line").alias("line")).agg(F.sum("x.words").alias("words"))


def common_lines(rows: DataFrame, lines: DataFrame, limits: Limits) -> DataFrame:
    """host and line of the lines that too many distinct texts of the host hold."""
    hosts = rows.groupBy("host").agg(F.count_distinct("text_key").alias("host_texts"))
    held = lines.groupBy("host", "line").agg(F.count_distinct("text_key").alias("texts")).where(F.col("texts") > min(limits.few_docs, limits.least_docs))
    return held.join(hosts, "host").where((F.col("texts") > limits.least_docs) | (F.col("texts") > limits.share * F.col("host_texts"))).select("host", "line")


def removed_words(rows: DataFrame, limits: Limits) -> DataFrame:
    """row_key, removed (words in common lines) and removed_lines (their hashes), for rows that lose any."""
    lines = lines_of(rows)
    lost = lines.join(common_lines(rows, lines, limits), ["host", "line"], "left_semi")
    return lost.groupBy("row_key").agg((F.sum("words")).alias("removed"), F.collect_set("line").alias("removed_lines"))


def judged(rows: DataFrame, limits: Limits) -> DataFrame:
    """The measures of every row with row_key, removed_words, removed_lines (null if none) and kept."""
    times = rows.groupBy("row_key").agg(F.count("*").alias("times"))
    lost = removed_words(rows, limits).join(times, "row_key").select("row_key", F.expr("removed div times").alias("removed"), "removed_lines")
    out = base_measures(rows).join(lost, "row_key", "left").withColumn("removed_words", F.coalesce("removed", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < limits.least_words) | (F.col("removed_words") > limits.most_removed * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def verdicts(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The measures of every row of docs, base_failed, kept and removed_words.

    docs: doc_id, text and source (the host); other columns are ignored,
    whatever their names. Null and empty texts have no words and fail the base
    rules; very long ones are read whole; a null source is a host of its own;
    rows that repeat an id stay; no rows give none. A line's documents are
    counted by their texts: a departure from counting ids, as copies of one text
    would else make each of its lines common.
    """
    return judged(with_key(docs), limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def cleaned(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The kept rows of docs with all their columns; texts lose their common lines (and n_chars, if there, is made anew).

    Texts without common lines stay as they are, rows that repeat an id too.
    """
    # the filter stands above an aggregate: pushed into the measures it would work them out again and again
    kept = judged(with_key(docs), limits).groupBy("row_key").agg(F.first("removed_lines").alias(LINES), F.bool_or("kept").alias(KEPT)).where(F.col(KEPT)).drop(KEPT)
    text = text_column(docs)
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(text), F.length(text), F.coalesce(F.col("source").cast("string"), F.lit("")))
    out = docs.withColumn(ROW, key).join(kept.withColumnRenamed("row_key", ROW), ROW)
    stay = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(A_WORD) | ~F.array_contains(LINES, line_key(x))), "\n")
    whole = F.col(LINES).isNull()
    new = {"text": F.when(whole, F.col("text")).otherwise(stay)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(stay)).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
