"""The strict corpus analysis: profiles, frequencies, contexts, collocations, keyness,
sentiment, frames, trends, representativeness and significance.

docs has seq (input order), source, year, country, language, text and tokens
(an array; see prepare). Nothing is collected; every result is a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import stats
from corpusloom.functions import text as T
from corpusloom.functions.profile import Profile


def prepare(docs: DataFrame, profile: Profile, use_lemma: bool = True, min_year: int | None = None, max_year: int | None = None) -> DataFrame:
    """docs with tokens; documents outside the years or without a token are left out."""
    if min_year is not None:
        docs = docs.where(F.col("year") >= min_year)
    if max_year is not None:
        docs = docs.where(F.col("year") <= max_year)
    raw = docs.withColumn("_raw", T.tokenize(F.coalesce("text", F.lit("")), us=True))
    if "language" not in docs.columns:
        raw = raw.withColumn("language", T.detect_language(F.col("_raw"), F.col("source")))
    # a generator of one row keeps what follows, filters above all, from working the tokens out again
    made = raw.select("*", F.explode(F.array(T.preprocess(F.col("_raw"), use_lemma, profile.strict_stopwords))).alias("tokens")).drop("_raw")
    return made.where(F.size("tokens") > 0)


def profile_by(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.groupBy(*keys).agg(F.count("*").alias("doc_count"))


def corpus_profile(docs: DataFrame) -> DataFrame:
    """All profiles in one pass; null stands for a key that a profile does not have."""
    sets = [["source"], ["country"], ["year"], ["language"], ["source", "country", "year"]]
    keys = ("source", "country", "year", "language")
    return docs.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("profile"), F.count("*").alias("doc_count"))


def token_counts(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.select(*keys, F.explode("tokens").alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("freq"))


def document_frequency(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("doc_freq"))


def top_tokens(docs: DataFrame, n: int = 250) -> DataFrame:
    return token_counts(docs).orderBy(F.desc("freq"), "token").limit(n)


def top_tokens_by(docs: DataFrame, key: str, n: int = 250) -> DataFrame:
    return best_by(token_counts(docs, key), [key], [F.desc("freq"), F.asc("token")], n)


def best_by(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def anchor_terms(profile: Profile) -> list[str]:
    return sorted({t for terms in profile.anchors.values() for t in terms})


def kwic(docs: DataFrame, profile: Profile, window: int = 7, most: int | None = 12_000) -> DataFrame:
    """Anchor tokens in context. most: a report's row limit, in document order; None for all."""
    terms = anchor_terms(profile)
    some = docs.where(F.arrays_overlap("tokens", T.literal_array(terms)))

    def line(pos: Column) -> Column:
        left = F.array_join(F.slice("tokens", F.greatest(pos - window + 1, F.lit(1)), F.least(pos, F.lit(window))), " ")
        right = F.array_join(F.slice("tokens", pos + 2, F.lit(window)), " ")
        return F.struct(pos.alias("pos"), left.alias("left_context"), F.get("tokens", pos).alias("keyword"), right.alias("right_context"))

    lines = some.select("seq", "source", "year", "country", F.explode(F.transform(places(F.col("tokens"), terms), line)).alias("x"))
    rows = lines.select("seq", "x.pos", "source", "year", "country", "x.left_context", "x.keyword", "x.right_context")
    return rows if most is None else rows.orderBy("seq", "pos").limit(most)


def places(tokens: Column, terms: list[str]) -> Column:
    """Where terms stand among tokens, from 0. What is exploded are these few and not all tokens with their text beside each."""
    return F.filter(F.transform(tokens, lambda t, i: F.when(T.among(t, terms), i)), lambda i: i.isNotNull())


def referent_sentences(docs: DataFrame, profile: Profile, most: int | None = 12_000) -> DataFrame:
    """Sentences with an anchor, the first anchor of the first country that has one, and their neighbours.

    An anchor is what is left of a word without an ending, so only sentences
    that hold its letters are split into words.
    """

    def words(s: Column) -> Column:
        return T.preprocess(T.tokenize(s, us=True), True, profile.strict_stopwords)

    maybe = "(?iu)" + "|".join([*map(T.quoted, anchor_terms(profile)), T.US])

    def told(s: Column, i: Column) -> Column:
        def first(t: Column) -> Column:
            found = [F.get(F.filter(t, in_set(terms)), F.lit(0)) for terms in profile.anchors.values()]
            country = F.coalesce(*[F.when(x.isNotNull(), c) for c, x in zip(profile.anchors, found, strict=True)])
            return F.struct(i.alias("i"), country.alias("anchor_country"), F.coalesce(*found).alias("anchor_term"))

        return F.when(s.rlike(maybe), F.get(F.transform(F.array(words(s)), first), F.lit(0)))

    def around(sents: Column) -> Column:
        hits = F.filter(F.transform(sents, told), lambda h: h["anchor_term"].isNotNull())
        before = lambda i: F.when(i > 0, F.get(sents, i - 1)).otherwise("")
        return F.transform(hits, lambda h: F.struct(h["i"].alias("i"), h["anchor_country"].alias("anchor_country"), h["anchor_term"].alias("anchor_term"), before(h["i"]).alias("prev_sent"), F.get(sents, h["i"]).alias("hit_sent"), F.coalesce(F.get(sents, h["i"] + 1), F.lit("")).alias("next_sent")))

    some = docs.where(F.col("text").rlike(maybe)).select("seq", "source", "year", "country", F.explode(F.flatten(F.transform(F.array(T.sentences(F.col("text"))), around))).alias("x"))
    rows = some.select("seq", "x.i", "source", "year", "country", "x.anchor_country", "x.anchor_term", "x.prev_sent", "x.hit_sent", "x.next_sent")
    rows = rows.withColumn("expanded_context", F.array_join(F.filter(F.array("prev_sent", "hit_sent", "next_sent"), lambda s: s != ""), " "))
    return rows if most is None else rows.orderBy("seq", "i").limit(most)


def in_set(terms: list[str]):
    return lambda t: T.among(t, terms)


def content_but(terms: list[str], profile: Profile):
    return lambda w: ~T.among(w, terms) & T.is_content(w, profile.strict_stopwords)


def collocations(docs: DataFrame, profile: Profile, window: int = 5, least: int = 5, top: int = 250, most_common: float = 0.4) -> DataFrame:
    """Content words near anchors with MI, t-score and G2. Windows are slices of the token array: no self join."""
    every = anchor_terms(profile)
    some = docs.where(F.arrays_overlap("tokens", T.literal_array(every)))

    def near(pos: Column) -> Column:
        left = F.slice("tokens", F.greatest(pos - window + 1, F.lit(1)), F.least(pos, F.lit(window)))
        return F.struct(F.get("tokens", pos).alias("anchor"), F.concat(left, F.slice("tokens", pos + 2, F.lit(window))).alias("around"))

    around = some.select(F.inline(F.transform(places(F.col("tokens"), every), near)))
    # the empty word counts the anchors themselves
    kept = lambda terms: F.array_append(F.filter("around", content_but(terms, profile)), "")
    of_each = F.array_compact(F.array(*[F.when(T.among(F.col("anchor"), terms), F.struct(F.lit(c).alias("anchor_country"), kept(terms).alias("near"))) for c, terms in profile.anchors.items()]))
    both = around.select(F.inline(of_each)).select("anchor_country", F.explode("near").alias("collocate"))
    counted = both.groupBy("anchor_country", "collocate").agg(F.count("*").alias("cooc_freq"))
    anchors = counted.where(F.col("collocate") == "").select("anchor_country", F.col("cooc_freq").alias("c_x"))
    vocabulary = docs.select(F.explode("tokens").alias("collocate"), F.col("seq").alias("_d")).groupBy("collocate", "_d").agg(F.count("*").alias("n")).groupBy("collocate").agg(F.sum("n").alias("c_y"), F.count("*").alias("df"))
    totals = docs.agg(F.sum(F.size("tokens")).alias("n"), F.count("*").alias("n_docs"))
    frequent = counted.where((F.col("collocate") != "") & (F.col("cooc_freq") >= least))
    rows = frequent.join(vocabulary, "collocate").join(anchors, "anchor_country").join(F.broadcast(totals)).where(F.col("df") <= most_common * F.col("n_docs"))
    a, x, y, n = F.col("cooc_freq"), F.col("c_x"), F.col("c_y"), F.col("n")
    b, c = F.greatest(x - a, F.lit(0)), F.greatest(y - a, F.lit(0))
    d = F.greatest(n - a - b - c, F.lit(0))
    scored = rows.select("anchor_country", "collocate", "cooc_freq", F.round(stats.mutual_information(a, x, y, n), 5).alias("mi"), F.round(stats.t_score(a, x, y, n), 5).alias("t_score"), F.round(stats.llr(a, b, c, d), 5).alias("llr_g2"))
    return best_by(scored, ["anchor_country"], [F.desc("llr_g2"), F.desc("cooc_freq"), F.asc("collocate")], top)


def keyness(docs: DataFrame, least: int = 5, top: int = 3000) -> DataFrame:
    """Over-represented tokens of each country against the rest."""
    counts = token_counts(docs, "country")
    whole = Window.partitionBy("token")
    rows = counts.withColumn("all_freq", F.sum("freq").over(whole)).where(F.col("freq") >= least)
    sizes = docs.groupBy("country").agg(F.sum(F.size("tokens")).alias("sub_total"))
    total = sizes.agg(F.sum("sub_total").alias("total"))
    rows = rows.join(F.broadcast(sizes), "country").join(F.broadcast(total)).withColumn("rest_total", F.col("total") - F.col("sub_total"))
    a = F.col("freq")
    b, c = F.col("sub_total") - a, F.col("all_freq") - a
    d = F.col("rest_total") - c
    rows = rows.where((F.col("sub_total") > 0) & (F.col("rest_total") > 0)).withColumns({"sub_rate": a.cast("double") / F.col("sub_total"), "rest_rate": c.cast("double") / F.col("rest_total"), "g2": stats.llr(a, b, c, d)})
    over = rows.where(F.col("sub_rate") > F.col("rest_rate"))
    return over.select("country", "token", F.col("freq").alias("sub_freq"), F.round("sub_rate", 8).alias("sub_rate"), F.round("rest_rate", 8).alias("rest_rate"), F.round("g2", 5).alias("llr_g2")).orderBy(F.desc("llr_g2"), "country", "token").limit(top)


def sentiment(docs: DataFrame, profile: Profile) -> DataFrame:
    """seq, source, year, country, sent_score, label, hits and token_count of each document."""
    pos = T.hits_by_language(F.col("tokens"), F.col("language"), profile.positive, profile.any_positive)
    neg = T.hits_by_language(F.col("tokens"), F.col("language"), profile.negative, profile.any_negative)
    rows = docs.select("seq", "source", "year", "country", pos.alias("pos_hits"), neg.alias("neg_hits"), F.size("tokens").alias("token_count"))
    rows = rows.withColumn("score", (F.col("pos_hits") - F.col("neg_hits")).cast("double") / F.greatest("token_count", F.lit(1)))
    label = F.when(F.col("score") > 0.001, "positive").when(F.col("score") < -0.001, "negative").otherwise("neutral")
    return rows.select("seq", "source", "year", "country", "score", F.round("score", 6).alias("sent_score"), label.alias("label"), "pos_hits", "neg_hits", "token_count")


def sentiment_summary(docs: DataFrame, profile: Profile) -> DataFrame:
    counts = [F.count_if(F.col("label") == x).alias(f"{x}_docs") for x in ("positive", "negative", "neutral")]
    return sentiment(docs, profile).groupBy("country", "year").agg(F.count("*").alias("doc_count"), F.round(F.avg("score"), 6).alias("avg_sent_score"), *counts)


def marker_counts(docs: DataFrame, by_language: dict, otherwise: dict, keys: list[str], name: str) -> DataFrame:
    """Hits of each named list by keys, zero counts left out."""
    names = sorted({n for lists in [*by_language.values(), otherwise] for n in lists})
    counted = [F.struct(F.lit(n).alias("name"), T.hits_by_language(F.col("tokens"), F.col("language"), {lang: lists.get(n, ["\0"]) for lang, lists in by_language.items()}, otherwise.get(n, ["\0"])).alias("hits")) for n in names]
    each = docs.select(*keys, F.explode(F.array(*counted)).alias("x")).where(F.col("x.hits") > 0)
    return each.groupBy(*keys, F.col("x.name").alias(name)).agg(F.sum("x.hits").alias("count"))


def frame_counts(docs: DataFrame, profile: Profile, keys: tuple[str, ...] = ("country", "year")) -> DataFrame:
    return marker_counts(docs, profile.frames, profile.any_frames, list(keys), "frame")


def persuasion_counts(docs: DataFrame, profile: Profile) -> DataFrame:
    return marker_counts(docs, profile.persuasion, profile.any_persuasion, ["source", "country", "year"], "marker_group")


def trends(docs: DataFrame, profile: Profile) -> DataFrame:
    """Yearly slopes of volume and mean sentiment by country over all years of the corpus; missing years are 0."""
    scored = sentiment(docs, profile).groupBy("country", "year").agg(F.count("*").alias("volume"), F.avg("score").alias("mean_score"))
    grid = scored.select("country").distinct().join(F.broadcast(scored.select("year").distinct()))
    full = grid.join(scored, ["country", "year"], "left").na.fill({"volume": 0, "mean_score": 0.0})
    slope = lambda y: F.round(F.coalesce(F.regr_slope(F.col(y).cast("double"), F.col("year").cast("double")), F.lit(0.0)), 6)
    return full.groupBy("country").agg(slope("volume").alias("volume_slope_per_year"), slope("mean_score").alias("sentiment_slope_per_year"), F.min("year").alias("from_year"), F.max("year").alias("to_year"))


def concentration(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Diversity of sources within keys: HHI, entropy and shares."""
    counts = docs.groupBy(*keys, "source").agg(F.count("*").alias("n"))
    shares = counts.withColumn("p", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy(*keys)))
    rows = shares.groupBy(*keys).agg(F.sum("n").alias("doc_count"), F.count("*").alias("active_sources"), F.sum(F.col("p") * F.col("p")).alias("hhi"), (-F.sum(F.col("p") * F.ln("p"))).alias("entropy"), F.max("p").alias("most"), F.min("p").alias("least"))
    sources = docs.agg(F.count_distinct("source").alias("total_sources"))
    r6 = lambda c, name: F.round(c, 6).alias(name)
    return rows.join(F.broadcast(sources)).select(
        *keys, "doc_count", "active_sources", "total_sources",
        r6(F.col("active_sources").cast("double") / F.col("total_sources"), "coverage_ratio"), r6(F.col("hhi"), "hhi_concentration"), r6(F.col("entropy") + 0.0, "shannon_entropy"),
        r6(F.when(F.col("entropy") > 0, F.exp("entropy")).otherwise(1.0), "effective_sources"), r6(F.col("most"), "max_source_share"), r6(F.col("least"), "min_active_source_share"), r6(F.col("most") / F.col("least"), "imbalance_ratio_max_to_min"),
    )


def source_balance(docs: DataFrame) -> DataFrame:
    counts = docs.groupBy("source", "country").agg(F.count("*").alias("doc_count"))
    share = lambda key: F.round(F.col("doc_count").cast("double") / F.sum("doc_count").over(Window.partitionBy(key)), 6)
    return counts.withColumns({"share_within_source": share("source"), "share_within_country": share("country")})


def country_pairs(docs: DataFrame) -> DataFrame:
    countries = docs.select("country").distinct()
    return countries.toDF("country_a").join(F.broadcast(countries.toDF("country_b")), F.col("country_a") < F.col("country_b"))


def chi2_pairs(counts: DataFrame, pairs: DataFrame, target: str) -> DataFrame:
    """Chi-square and Cramer's V of each pair's 2 x k table; counts: country, category, n. All categories count for df."""
    cats = counts.select("category").distinct()
    k = cats.agg(F.count("*").alias("k"))
    grid = pairs.join(F.broadcast(cats))
    value = lambda side: counts.select(F.col("country").alias(side), "category", F.col("n").alias(f"n_{side}"))
    cells = grid.join(value("country_a"), ["country_a", "category"], "left").join(value("country_b"), ["country_b", "category"], "left").na.fill(0)
    pair = Window.partitionBy("country_a", "country_b")
    a, b = F.col("n_country_a").cast("double"), F.col("n_country_b").cast("double")
    cells = cells.withColumns({"row_a": F.sum(a).over(pair), "row_b": F.sum(b).over(pair)}).withColumn("n", F.col("row_a") + F.col("row_b"))
    part = lambda o, row: F.coalesce(F.try_divide((o - F.try_divide(F.col(row) * (a + b), F.col("n"))) * (o - F.try_divide(F.col(row) * (a + b), F.col("n"))), F.nullif(F.try_divide(F.col(row) * (a + b), F.col("n")), F.lit(0.0))), F.lit(0.0))
    rows = cells.groupBy("country_a", "country_b").agg(F.sum(part(a, "row_a") + part(b, "row_b")).alias("chi2"), F.max("n").alias("n")).join(F.broadcast(k))
    real = (F.col("k") >= 2) & (F.col("n") > 0)
    rows = rows.withColumns({"chi2": F.when(real, F.col("chi2")).otherwise(0.0), "df": F.when(real, F.col("k") - 1).otherwise(0).cast("int"), "v": F.when(real, F.sqrt(F.try_divide(F.col("chi2"), F.col("n")))).otherwise(0.0)})
    return rows.select("country_a", "country_b", F.lit(target).alias("test_target"), F.round("chi2", 6).alias("chi2"), "df", F.round("v", 6).alias("cramers_v"), T.cramers_v_label(F.col("v")).alias("effect_size_label"), F.col("chi2").alias("_chi2"))


def significance(docs: DataFrame, profile: Profile, p_values: bool = True) -> DataFrame:
    """Pairwise tests of frame and sentiment distributions; p_value is text with eight places."""
    pairs = country_pairs(docs)
    frames = frame_counts(docs, profile, ("country",)).select("country", F.col("frame").alias("category"), F.col("count").alias("n"))
    labels = sentiment(docs, profile).groupBy("country", F.col("label").alias("category")).agg(F.count("*").alias("n"))
    three = docs.sparkSession.createDataFrame([("positive",), ("negative",), ("neutral",)], "category string")
    labels = docs.select("country").distinct().join(F.broadcast(three)).join(labels, ["country", "category"], "left").na.fill({"n": 0})
    rows = chi2_pairs(frames, pairs, "frame_distribution").unionByName(chi2_pairs(labels, pairs, "sentiment_distribution"))
    if p_values:
        rows = rows.withColumn("p_value", F.format_string("%.8f", stats.chi2_p_value(F.col("_chi2"), F.col("df"))))
    return rows.drop("_chi2")


def log_odds(docs: DataFrame, least: int = 20, top: int = 120) -> DataFrame:
    """Tokens that tell two countries apart, by smoothed log odds."""
    counts = token_counts(docs, "country")
    sizes = docs.groupBy("country").agg(F.sum(F.size("tokens")).alias("n"))
    pairs = country_pairs(docs).join(F.broadcast(sizes.toDF("country_a", "n1")), "country_a").join(F.broadcast(sizes.toDF("country_b", "n2")), "country_b")
    # every count goes to the pairs of its country: no outer join of vocabularies
    sides = pairs.select("country_a", "country_b", "n1", "n2", F.explode(F.array("country_a", "country_b")).alias("country"))
    both = counts.join(F.broadcast(sides), "country").groupBy("country_a", "country_b", "n1", "n2", "token").agg(F.sum(F.when(F.col("country") == F.col("country_a"), F.col("freq")).otherwise(0)).alias("freq_a"), F.sum(F.when(F.col("country") == F.col("country_b"), F.col("freq")).otherwise(0)).alias("freq_b"))
    a, b = F.col("freq_a"), F.col("freq_b")
    odds = lambda x, n: F.ln((x + F.lit(0.5)) / (F.greatest(F.col(n) - x, F.lit(0)) + F.lit(0.5)))
    z = (odds(a, "n1") - odds(b, "n2")) / F.sqrt(1.0 / (a + F.lit(0.5)) + 1.0 / (b + F.lit(0.5)))
    rows = both.where(a + b >= least).withColumn("z", z).withColumn("z_score", F.round("z", 6))
    out = best_by(rows, ["country_a", "country_b"], [F.desc(F.abs("z_score")), F.asc("token")], top)
    return out.select("country_a", "country_b", "token", "freq_a", "freq_b", "z_score", F.when(F.col("z") > 0, F.col("country_a")).otherwise(F.col("country_b")).alias("favored_country"))
