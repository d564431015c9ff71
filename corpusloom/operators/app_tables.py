"""Scored contexts and their aggregates under the names and with the further columns of the reader's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import percentile

#: Names under which percentiles are kept, by the column they are of.
PERCENTILES = {"IDI_raw": "IDI", "EMI_raw": "EMI", "MTI_raw": "MTI", "IP_i": "IP", "IP_abs_i": "IP_abs"}
#: Columns stored with eight places, and per cent with six.
EIGHT = ("IDI_raw", "EMI_raw", "MTI_raw", "IP_i", "IP_abs_i", "IP_context", "IP_context_abs", "EVI_norm", "discursive_energy")
SIX = ("IDI_percent_value", "EMI_percent_value", "MTI_percent_value")
NOTHING_LEFT = "No content-relevant referent contexts"


def reader_columns(scored: DataFrame, lexicon_version: str = "", by: list[str] | None = None) -> DataFrame:
    """Scored contexts with the readers' aliases, percentiles, levels, sentences and places.

    by: percentiles are those within groups of these columns instead of all rows.
    Null measures are zero.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    named = {f"{m}_raw": number(m) for m in ("IDI", "EMI", "MTI")} | {"IP_i": number("IP_context"), "IP_abs_i": F.abs(number("IP_context")), "IP": number("IP_context"), "IP_abs_context": F.abs(number("IP_context")), "EVI_raw_r": F.col("EVI_raw"), "EVI_norm_r": F.col("EVI_norm"), "S_r": number("referent_salience"), "EVI_P_score": F.coalesce("positive_score", F.lit(0)), "EVI_N_score": F.coalesce("negative_score", F.lit(0)), "lexicon_version_used": F.lit(lexicon_version)}
    rows = scored.withColumns(named)
    rows = rows.withColumns({f"{m}_r": F.col(f"{m}_raw") for m in ("IDI", "EMI", "MTI")} | {f"{m}_percent_value": F.col(f"{m}_raw") * 100.0 for m in ("IDI", "EMI", "MTI")})
    ranked = percentile.ranks(rows, list(PERCENTILES), by).withColumnsRenamed({f"{c}_percentile": f"{n}_percentile" for c, n in PERCENTILES.items()})
    levels = {f"{n}_empirical_level": T.empirical_level(F.col(f"{n}_percentile")) for n in PERCENTILES.values()}
    rows = ranked.withColumns(levels | {f"{n}_level_empirical": v for n, v in zip(PERCENTILES.values(), levels.values(), strict=True)})
    said = {
        "percentile_explanation": F.format_string("IDI pctl=%.1f, EMI pctl=%.1f, MTI pctl=%.1f, IP_abs pctl=%.1f", *[F.col(f"{n}_percentile") for n in ("IDI", "EMI", "MTI", "IP_abs")]),
        "interpretation_summary": F.format_string("EVI=%.1f, IP_i=%.6f, S_r=%.2f", F.col("EVI_raw").cast("double"), "IP_i", "S_r"),
    }
    places = {c: F.round(c, 8) for c in EIGHT if c in rows.columns} | {c: F.round(c, 6) for c in SIX}
    rows = rows.withColumns(said).withColumns(places)
    return rows.withColumns({f"{m}_percent": F.col(f"{m}_percent_value") for m in ("IDI", "EMI", "MTI")})


def mean_of(value: Column, n: Column) -> Column:
    """The mean from a sum in whole billionths: the order of summation has no part in it. Zero for none."""
    return F.coalesce(F.try_divide(F.sum(F.round(value * percentile.UNITS).cast("decimal(28,0)")).cast("double"), n.cast("double")) / float(percentile.UNITS), F.lit(0.0))


def aggregated(rows: DataFrame, keys: list[str], exclude_technical: bool = True) -> DataFrame:
    """Counts, means with per cent and percentiles, weighted impact and shares of each key, from one aggregation.

    rows: as reader_columns gives them. Contexts without weight (technical ones
    too, if excluded) count among the contexts and articles and in no mean. Null
    keys are a key.
    """
    technical = F.coalesce("is_technical_mention", F.lit(False))
    weight = F.coalesce(F.col("aggregation_weight").cast("double"), F.lit(0.0))
    weight = F.when(technical, 0.0).otherwise(weight) if exclude_technical else weight
    rows = rows.withColumns({"_w": weight, "_technical": technical})
    ok = F.col("_w") > 0
    n = F.count_if(ok)
    mean = lambda c: mean_of(F.when(ok, F.col(c).cast("double")), n)
    units = lambda x: F.sum(F.round(F.when(ok, x) * percentile.UNITS).cast("decimal(28,0)")).cast("double")
    ratio = lambda c: F.coalesce(F.try_divide(units(F.col(c) * F.col("_w")), F.nullif(units(F.col("_w")), F.lit(0.0))), F.lit(0.0))
    share = lambda condition: F.coalesce(F.try_divide(F.count_if(ok & condition).cast("double"), n.cast("double")), F.lit(0.0))
    means = {f"mean_{m}_{kind}": mean(f"{m}_{kind}") for m in ("IDI", "EMI", "MTI") for kind in ("raw", "percent_value", "percentile")}
    means |= {"mean_EVI_raw": mean("EVI_raw"), "mean_EVI_norm": mean("EVI_norm"), "IP_final": ratio("IP_i"), "IP_abs_final": ratio("IP_abs_i"), "mean_IP_percentile": mean("IP_percentile"), "mean_IP_abs_percentile": mean("IP_abs_percentile")}
    evi = F.col("EVI_raw")
    shares = {"positive_context_share": share(evi > 0), "negative_context_share": share(evi < 0), "neutral_context_share": share(evi == 0), "central_context_share": share(F.col("referent_salience") == 1.0)}
    counts = {"number_of_contexts": F.count("*"), "number_of_articles": F.count_distinct("doc_id"), "contexts_analyzed": n, "contexts_excluded": F.count_if(F.col("_w") == 0), "technical_mentions_count": F.count_if("_technical"), "technical_mentions_excluded": F.count_if(F.col("_technical") & F.lit(exclude_technical))}
    out = rows.groupBy(*keys).agg(*[v.alias(k) for k, v in (counts | means | shares).items()])
    return out.withColumn("warning", F.when(F.col("contexts_analyzed") == 0, NOTHING_LEFT).otherwise(""))


def matrix(rows: DataFrame, exclude_technical: bool = True) -> DataFrame:
    """The aggregates of media country and referent with the names of a calibrated report and a sentence."""
    out = aggregated(rows, ["media_country", "ref_country"], exclude_technical)
    said = F.format_string("IDI pctl=%.1f; EMI pctl=%.1f; MTI pctl=%.1f; IP_abs pctl=%.1f", *[F.col(f"mean_{n}_percentile") for n in ("IDI", "EMI", "MTI", "IP_abs")])
    return out.withColumns({"mean_IP": F.col("IP_final"), "mean_abs_IP": F.col("IP_abs_final"), "mean_EVI": F.col("mean_EVI_raw"), "interpretation_summary": said})
