"""Referent contexts: windows of sentences around mentions, merged where they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.profile import Profile

FIELDS = ("doc_id", "media_country", "outlet_name", "date", "title", "text")


def required(df: DataFrame) -> DataFrame:
    """The six fields as text, null as the empty text; a missing one raises."""
    if missing := [f for f in FIELDS if f not in df.columns]:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    return df.withColumns({f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in FIELDS})


def prefilter(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Texts that hold any of the terms anywhere, inside words too."""
    return docs.where(F.col("text").rlike("(?iu)" + "|".join(T.quoted(t.strip()) for t in terms if t.strip())))


def islands(hits: Column) -> Column:
    """Arrays of struct(i, found) split where neighbours are over two sentences apart.

    One fold over the hits of a text: no shuffle, whatever the number of texts.
    """
    empty = F.filter(F.array(F.slice(hits, F.lit(1), F.lit(1))), lambda x: F.lit(False))

    def step(done: Column, hit: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        near = hit["i"] - F.get(last, F.size(last) - 1)["i"] <= 2
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, F.array(hit))))
        return F.when((F.size(done) > 0) & near, grown).otherwise(F.concat(done, F.array(F.array(hit))))

    return F.aggregate(hits, empty, step)


def found_keywords(sentence: Column, keywords: list[str]) -> Column:
    """The keywords in a sentence; one alternation is tried first, as most sentences hold none."""
    pairs = F.array(*[F.struct(F.lit(k).alias("term"), F.lit(T.term_pattern(k)).alias("pattern")) for k in sorted(set(keywords))])
    found = F.transform(F.filter(pairs, lambda p: F.rlike(sentence, p["pattern"])), lambda p: p["term"])
    return F.when(sentence.rlike(T.any_pattern(keywords)), found).otherwise(F.array().cast("array<string>"))


def mentions(keywords: list[str]):
    return lambda s, i: F.struct(i.alias("i"), found_keywords(s, keywords).alias("found"))


def extract(docs: DataFrame, profile: Profile) -> DataFrame:
    """A row for each merged window of each referent in each document (fields as required() gives them).

    Texts are read and split once for all referents.
    """
    given = required(docs).select(*FIELDS)
    every = [k for ks in profile.referents.values() for k in ks]
    some = given.where(F.col("text").rlike(T.any_pattern(every))).withColumn("sents", T.held(T.sentences(F.col("text"))))
    hits = {f"_h{i}": T.held(F.filter(F.transform("sents", mentions(ks)), lambda h: F.size(h["found"]) > 0)) for i, ks in enumerate(profile.referents.values())}
    of_each = F.array(*[F.struct(F.lit(name).alias("ref_country"), islands(F.col(h)).alias("windows")) for name, h in zip(profile.referents, hits, strict=True)])
    rows = some.withColumns(hits).select(*FIELDS, "sents", F.inline(of_each))
    out = rows.select(*FIELDS, "sents", "ref_country", F.posexplode("windows").alias("_n", "w"))
    low = F.greatest(F.get("w", F.lit(0))["i"] - 1, F.lit(0))
    high = F.least(F.get("w", F.size("w") - 1)["i"] + 1, F.size("sents") - 1)
    out = out.withColumns({"low": low, "high": high})
    return out.select(
        F.format_string("%s__%s__%03d", "doc_id", "ref_country", F.col("_n") + 1).alias("context_id"),
        "doc_id", "media_country", "outlet_name", "date", "title", "ref_country",
        F.array_sort(F.array_distinct(F.flatten(F.transform("w", lambda h: h["found"])))).alias("keywords"),
        F.array_join(F.slice("sents", F.col("low") + 1, F.col("high") - F.col("low") + 1), " ").alias("context_text"),
        F.when(F.col("low") > 0, F.get("sents", F.col("low") - 1)).otherwise("").alias("previous_sentence"),
        F.array_join(F.transform("w", lambda h: F.get("sents", h["i"])), " ").alias("target_sentence"),
        F.coalesce(F.get("sents", F.col("high") + 1), F.lit("")).alias("next_sentence"),
    ).withColumn("matched_keywords", F.array_join("keywords", "; "))
