"""Every named query of the library with, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import lexicons as L
from corpusloom.functions import stats
from corpusloom.functions import text as T
from corpusloom.operators import aggregate, app_tables, calibration, collector, contexts, corpus, dedup, interpret, legacy, lexicon, numbering, percentile, scoring
from corpusloom.plans import calibration_queries, oracles, tables
from corpusloom.plans.calibration_queries import calibration_texts
from corpusloom.plans.tables import PROFILE
from corpusloom.sources import io

Query = Callable[[SparkSession, str], DataFrame]
#: Categories and frames for the words of the test profile.
CATEGORIES = {"Alpha": {"Worth": ["worth"], "Wit": ["stup"]}, "Beta": {"Granted": ["licensed"]}}
FRAMES = {"law": ["licen", "public"], "abuse": ["stupid", "worth"], "labour": ["work"]}
METRICS = ["IDI", "EMI", "MTI", "IP_context_abs"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted impact by media country and referent: the whole chain from texts to indices."""
    return aggregate.by_media_and_referent(tables.scored(spark, sf_dir))


def on_docs(f: Callable[[DataFrame], DataFrame], use_lemma: bool = False) -> Query:
    return lambda spark, sf_dir: f(tables.corpus_docs(spark, sf_dir, use_lemma))


def on_scored(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(tables.scored(spark, sf_dir))


def on_texts(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(tables.documents(spark, sf_dir))


def article_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the collector's articles: the country and theme words of the test pages are common English."""
    pages = io.spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return pages.select(F.col("page_id").alias("seq"), F.regexp_extract("url", r"https?://([^/]+)", 1).alias("source"), (F.col("page_id") % 5 + 2022).cast("int").alias("year"), F.lit("").alias("title"), T.html_text(F.coalesce("html", F.lit(""))).alias("content"))


def lexicon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate terms as a dictionary of emotional markers, whose levels, weights and states follow from frequency and length, right and wrong."""
    n, size = F.col("frequency"), F.length("candidate_term")
    of = lambda values, x: F.element_at(F.array(*[F.lit(v) for v in values]), (x % len(values) + 1).cast("int"))
    found = calibration_queries.candidates(spark, sf_dir).select(F.col("candidate_term").alias("term"), of(("weak", "medium", "strong", "mild"), n).alias("intensity_level"), of(("0.3333", "0.6667", "1.0", "", "many"), size + n).alias("weight"), of(("true", "", "maybe", "no", "context_dependent"), n + 2 * size).alias("verified"))
    df = numbering.numbered(found, "row", ["term"])
    return df.withColumns({c: F.lit("") for c in L.LEXICON_SCHEMAS["emotional_markers.csv"] if c not in df.columns})


def corpus_profile_all(docs: DataFrame) -> DataFrame:
    return corpus.corpus_profile(docs).select(F.col("profile").cast("int").alias("profile"), *[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in ("source", "country", "year", "language")], "doc_count")


def dedup_all(docs: DataFrame) -> DataFrame:
    every, again, near = dedup.dropped(docs)
    distinct = every.join(again, "seq", "left_anti")
    return dedup.statistics(every, distinct, distinct.join(near, "seq", "left_anti"))


def near_survivors(docs: DataFrame) -> DataFrame:
    every, again, near = dedup.dropped(docs)
    return every.join(again.unionByName(near), "seq", "left_anti")


def exact_counts(docs: DataFrame) -> DataFrame:
    return dedup.exact(docs).select("seq")


def context_measures(rows: DataFrame) -> DataFrame:
    return rows.select("context_id", "N_content", "N_ideol", "N_e_w", "N_e_m", "N_e_s", "N_met", "IDI", "EMI", "MTI")


def sentences_with_anchor(docs: DataFrame) -> DataFrame:
    return corpus.referent_sentences(docs, PROFILE, None).select("seq", "i", "anchor_country", "anchor_term", "prev_sent", "hit_sent", "next_sent")


def rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in columns})


def ranked(rows: DataFrame) -> DataFrame:
    done = percentile.with_levels(percentile.ranks(rows.select("context_id", *METRICS), METRICS), METRICS)
    return done.select("context_id", *[F.round(f"{m}_percentile", 4).alias(f"{m}_percentile") for m in METRICS], *[f"{m}_level" for m in METRICS])


def ranked_by_referent(rows: DataFrame) -> DataFrame:
    done = percentile.ranks(rows.select("context_id", "ref_country", *METRICS), METRICS, ["ref_country"])
    return done.select("context_id", *[F.round(f"{m}_percentile", 4).alias(f"{m}_percentile") for m in METRICS])


def against_baseline(rows: DataFrame) -> DataFrame:
    base = rows.where(F.col("media_country") == "Malaysia")
    done = percentile.baseline_ranks(rows.select("context_id", *METRICS), base, METRICS)
    return done.select("context_id", *[F.round(f"{m}_baseline_percentile", 4).alias(f"{m}_baseline_percentile") for m in METRICS])


def country_and_theme(docs: DataFrame) -> DataFrame:
    """Hits of all themes and of all countries, and the first of each; scores are made once."""
    scores = {"t": collector.scores(F.lit(""), F.col("text"), collector.THEMES, collector.THEME_WINDOW), "c": collector.scores(F.lit(""), F.col("text"), collector.COUNTRIES, collector.COUNTRY_WINDOW)}
    rows = docs.select("doc_id", *[v.alias(k) for k, v in scores.items()])
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0), lambda a, b: a + b)
    return rows.select("doc_id", total("t").alias("theme_hits"), collector.primary(F.col("t"), list(collector.THEMES), "general").alias("theme"), total("c").alias("country_hits"), collector.primary(F.col("c"), list(collector.COUNTRIES), "none").alias("country"))


def queries() -> dict[str, Query]:
    chi = lambda p: lambda d: corpus.significance(d, PROFILE, p)
    return {
        # profiles and frequencies
        "corpus_profile_lang": on_docs(lambda d: corpus.profile_by(d, "language")),
        "corpus_profile_source_lang_year": on_docs(lambda d: corpus.profile_by(d, "source", "country", "year")),
        "corpus_profile_all": on_docs(corpus_profile_all),
        "token_freq_overall": on_docs(lambda d: corpus.top_tokens(d, 250)),
        "token_freq_by_lang": on_docs(lambda d: corpus.top_tokens_by(d, "country", 250)),
        "token_freq_by_source": on_docs(lambda d: corpus.top_tokens_by(d, "source", 250)),
        "doc_freq": on_docs(corpus.document_frequency),
        "lemma_freq": on_docs(lambda d: corpus.top_tokens(d, 250), use_lemma=True),
        # text functions
        "sentence_count": on_texts(lambda d: d.select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))),
        "n_content": on_texts(lambda d: d.select("doc_id", T.n_content(F.col("text")).alias("n_content"))),
        "content_pos_mix": on_texts(lambda d: d.select("lang", F.explode(T.pos_tag(T.tokenize(F.col("text")))).alias("x")).groupBy("lang", F.col("x.pos").alias("pos")).agg(F.count("*").alias("n"))),
        "language_detect": on_texts(lambda d: d.select("doc_id", T.detect_language(T.tokenize(F.col("text"), us=True), F.lit("none")).alias("detected"))),
        "strip_boilerplate": on_texts(lambda d: d.select("doc_id", F.length(T.strip_boilerplate(F.col("text"))).alias("n_chars_left"))),
        # contexts of anchors, association
        "kwic": on_docs(lambda d: corpus.kwic(d, PROFILE, 7, None)),
        "referent_sentences": on_docs(sentences_with_anchor),
        "collocations": on_docs(lambda d: corpus.collocations(d, PROFILE)),
        "keywords_llr": on_docs(corpus.keyness),
        "logodds_tokens": on_docs(corpus.log_odds),
        # sentiment, frames, persuasion, trends
        "sentiment_doc": on_docs(lambda d: corpus.sentiment(d, PROFILE).select("seq", "sent_score", "label", "pos_hits", "neg_hits", "token_count")),
        "sentiment_by_country_year": on_docs(lambda d: corpus.sentiment_summary(d, PROFILE)),
        "frame_counts": on_docs(lambda d: corpus.frame_counts(d, PROFILE)),
        "persuasion_counts": on_docs(lambda d: corpus.persuasion_counts(d, PROFILE)),
        "trend_slopes": on_docs(lambda d: corpus.trends(d, PROFILE)),
        # representativeness, significance
        "source_concentration": on_docs(lambda d: corpus.concentration(d, ["country", "year"])),
        "source_concentration_total": on_docs(lambda d: corpus.concentration(d, ["country"])),
        "source_balance": on_docs(corpus.source_balance),
        "chi2_pairs": on_docs(chi(False)),
        "chi2_pairs_p": on_docs(chi(True)),
        # duplicates
        "exact_dedup": on_docs(exact_counts),
        "near_dedup": on_docs(near_survivors),
        "dedup_stats": on_docs(dedup_all),
        "simhash64": on_docs(lambda d: d.select("seq", stats.simhash64(F.col("tokens")).alias("h"))),
        # referent contexts and their scores
        "quick_prefilter": on_texts(lambda d: contexts.prefilter(d, ["threat", "worthless ", "icens"]).select("doc_id")),
        "referent_contexts": lambda s, d: tables.referent_contexts(s, d).drop("keywords", "date", "title"),
        "context_marker_counts": on_scored(context_measures),
        "context_evi": on_scored(lambda r: r.select("context_id", "positive_score", "negative_score", "EVI_raw", "EVI_norm")),
        "context_salience": on_scored(lambda r: r.select("context_id", "referent_salience", "referent_role", "is_technical_mention")),
        "context_ip": on_scored(lambda r: r.select("context_id", F.round("IP_context", 6).alias("ip"), F.round("IP_context_abs", 6).alias("ip_abs"), F.round("IP_old_context", 6).alias("ip_old"), "aggregation_weight")),
        "context_coarse_evi": lambda s, d: scoring.score(tables.referent_contexts(s, d), PROFILE, "coarse").select("context_id", "EVI_raw"),
        "multi_ref_contexts": on_scored(lambda r: r.select("context_id", "multi_country_context")),
        "flagged_cases": on_scored(lambda r: scoring.flagged(r).select("context_id", "flag_case_type")),
        "marker_traces": on_scored(lambda r: scoring.traces(r, PROFILE).select("context_id", "indicator", "marker_text", "hits", "matched_span", "marker_id")),
        "formula_traces": on_scored(scoring.formula_traces),
        "context_interpretation": on_scored(lambda r: r.select("context_id", interpret.evi_words(F.col("EVI_raw")).alias("evi_words"), interpret.ip_words(F.col("IP_context"), F.col("IP_context_abs")).alias("ip_words"))),
        "keyword_category": lambda s, d: tables.referent_contexts(s, d).select("context_id", interpret.keyword_category(F.col("ref_country"), F.col("keywords"), CATEGORIES).alias("keyword_category")),
        "dominant_frames": on_scored(lambda r: interpret.dominant(r, FRAMES, "frame")),
        # aggregates
        "impact_by_media_ref": on_scored(aggregate.by_media_and_referent),
        "impact_by_outlet": on_scored(aggregate.by_outlet),
        "impact_by_article": on_scored(aggregate.by_article),
        "summary_matrix": on_scored(aggregate.summary_matrix),
        "reader_matrix": on_scored(lambda r: app_tables.matrix(app_tables.reader_columns(r)).drop("interpretation_summary")),
        "dominant_evi": on_scored(lambda r: aggregate.dominant_evi(r, ["media_country", "ref_country"])),
        "reference_summary": on_scored(lambda r: aggregate.reference_summary(r, ["ref_country"])),
        "diagnostics": on_scored(aggregate.diagnostics),
        # percentiles, calibration
        "percentile_ranks": on_scored(ranked),
        "percentile_ranks_by_referent": on_scored(ranked_by_referent),
        "baseline_percentiles": on_scored(against_baseline),
        "anchor_status": on_scored(lambda r: percentile.anchor_status(r).select("context_id", "anchor_status")),
        "metric_distributions": on_scored(lambda r: percentile.distributions(r, METRICS, {"all": [], "referent": ["ref_country"], "media_referent": ["media_country", "ref_country"]})),
        "outliers": on_scored(lambda r: percentile.outliers(r.select("context_id", *METRICS), METRICS).select("context_id", "metric")),
        **calibration_queries.queries(),
        "whole_text_scores": lambda s, d: rounded(interpret.whole_text_scores(calibration_texts(s, d), PROFILE), "IDI_raw", "EMI_raw", "MTI_raw", "IP_i", "IP_abs_i"),
        "whole_text_report": lambda s, d: interpret.whole_text_report(interpret.whole_text_scores(calibration_texts(s, d), PROFILE)),
        "text_rollup": on_scored(lambda r: calibration.text_rollup(percentile.anchor_status(r))),
        # lexicon
        "candidate_terms": lambda s, d: lexicon.extract_candidates(tables.referent_contexts(s, d)).select("candidate_term", "frequency", "proposed_dictionary", "confidence_score"),
        "lexicon_validation": lambda s, d: lexicon.validate("emotional_markers.csv", lexicon_rows(s, d)),
        # collector
        "document_country": lambda s, d: tables.documents(s, d).select("doc_id", io.country_of(F.concat_ws("_", "lang", F.col("doc_id").cast("string")), F.coalesce("text", F.lit(""))).alias("country")),
        "html_paragraph_text": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.length(T.html_text(F.coalesce("html", F.lit("")))).alias("n_chars")),
        "page_link_filter": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.array_join(collector.links(F.col("html"), "^https?://"), " ").alias("links")),
        "country_theme_scores": lambda s, d: country_and_theme(tables.documents(s, d)),
        "capped_sample": lambda s, d: collector.capped(tables.corpus_docs(s, d), 3, ("source", "country", "year")).select("seq", "source", "country", "year"),
        # the older document model
        "legacy_doc_indices": on_docs(lambda d: legacy.document_indices(d, PROFILE), use_lemma=True),
        "legacy_summary": on_docs(lambda d: legacy.summary(legacy.document_indices(d, PROFILE), "country", "year"), use_lemma=True),
    }


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
