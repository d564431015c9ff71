"""The older document-level indices: densities by token and a discrete evaluation from -2 to 2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import stats
from corpusloom.functions import text as T
from corpusloom.functions.profile import Profile


def around_mentions(text: Column, aliases: list[str], profile: Profile, drop_empty: bool = True) -> Column:
    """The tokens of every sentence with an alias and its neighbours; overlapping neighbourhoods repeat their tokens."""
    tokens = F.transform(T.sentences(text), lambda s: T.preprocess(T.tokenize(s, us=True), True, profile.strict_stopwords))
    hit = lambda s: F.exists(s, lambda t: T.among(t, aliases))

    def near(sents: Column) -> Column:
        around = lambda i: F.flatten(F.slice(sents, F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)))
        return F.flatten(F.transform(sents, lambda s, i: F.when(hit(s), around(i)).otherwise(F.array().cast("array<string>"))))

    return stats.once(F.filter(tokens, lambda t: F.size(t) > 0) if drop_empty else tokens, near)


def document_indices(docs: DataFrame, profile: Profile, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """IDI, EMI, MTI, EVI and IP of each document; aliases: of each country, its anchors by default."""
    aliases = aliases or profile.anchors
    around = None
    for country, terms in aliases.items():
        fits = F.col("country") == country
        here = around_mentions(F.col("text"), terms, profile)
        around = F.when(fits, here) if around is None else around.when(fits, here)
    tokens = F.col("tokens")
    n = lambda terms: T.hits_in(tokens, terms)
    rows = docs.withColumn("_near", around).withColumn("_context", F.when(F.coalesce(F.size("_near"), F.lit(0)) > 0, F.col("_near")).otherwise(tokens))
    rows = rows.withColumns({f"n_{k}": n(v) for k, v in profile.ideology.items()} | {f"e_{k}": n(v) for k, v in profile.emotion.items()} | {f"m_{k}": n(v) for k, v in profile.metaphor.items()})
    w = F.greatest(F.size(T.content(tokens, profile.strict_stopwords)), F.lit(1))
    share = lambda x: T.clamp(x.cast("double") / F.col("W"), 0.0, 1.0)
    plus = lambda *names: sum((F.col(x) for x in names[1:]), F.col(names[0]))
    rows = rows.withColumn("W", w).withColumns(
        {
            "IDI": share(plus(*[f"n_{k}" for k in profile.ideology])),
            "EMI": share(F.col("e_weak") / F.lit(3.0) + 2.0 * F.col("e_medium") / F.lit(3.0) + F.col("e_strong")),
            "MTI": share(plus(*[f"m_{k}" for k in profile.metaphor])),
            "R": T.hits_by_language(F.col("_context"), F.col("language"), profile.positive, profile.any_positive),
            "E": T.hits_by_language(F.col("_context"), F.col("language"), profile.negative, profile.any_negative),
            "n_eval": F.size("_context"),
        }
    )
    s = (F.col("R") - F.col("E")).cast("double") / F.greatest(F.size(T.content(F.col("_context"), profile.strict_stopwords)), F.lit(1))
    rows = rows.withColumn("EVI", F.when(s <= -0.02, -2).when(s < -0.005, -1).when(s < 0.005, 0).when(s < 0.02, 1).otherwise(2))
    ip = T.clamp((F.col("IDI") + F.col("EMI") + F.col("MTI")) * F.col("EVI"), -6.0, 6.0)
    counts = [f"n_{k}" for k in profile.ideology] + [f"e_{k}" for k in profile.emotion] + [f"m_{k}" for k in profile.metaphor]
    return rows.select("seq", "source", "year", "country", "language", "W", *counts, "n_eval", "R", "E", "EVI", *[F.round(c, 6).alias(c) for c in ("IDI", "EMI", "MTI")], F.round(ip, 6).alias("IP"))


def summary(indices: DataFrame, *keys: str) -> DataFrame:
    """Means of the indices by keys, from the rounded values."""
    return indices.groupBy(*keys).agg(F.count("*").alias("doc_count"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("IDI", "EMI", "EVI", "MTI", "IP")])
