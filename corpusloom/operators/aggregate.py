"""Aggregates of scored contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_CONTEXT = "No substantive referent contexts after salience filtering"


def valid_mean(column: str, ok: Column) -> Column:
    """The mean, from a rounded sum: the order of summation must not show in the last place."""
    return F.coalesce(F.try_divide(F.round(F.sum(F.when(ok, F.col(column).cast("double"))), 9), F.count_if(ok)), F.lit(0.0))


def weighted(keys: list[str], scored: DataFrame, exclude_technical: bool = True) -> DataFrame:
    """Means, shares and weighted impact of the contexts of each key, all from one aggregation."""
    rows = scored
    if exclude_technical:
        rows = rows.withColumn("aggregation_weight", F.when(F.coalesce("is_technical_mention", F.lit(False)), 0.0).otherwise(F.col("aggregation_weight")))
    w, ok = F.col("aggregation_weight"), F.col("aggregation_weight") > 0
    share = lambda condition: F.coalesce(F.avg(F.when(ok, condition.cast("double"))), F.lit(0.0))
    ratio = lambda x: F.coalesce(F.try_divide(F.round(F.sum(F.when(ok, w * x)), 9), F.nullif(F.round(F.sum(F.when(ok, w)), 9), F.lit(0.0))), F.lit(0.0))
    technical = F.count_if(F.coalesce("is_technical_mention", F.lit(False)))
    r = lambda x: F.round(x, 6)
    out = rows.groupBy(*keys).agg(
        *[r(valid_mean(c, ok)).alias(f"mean_{c}") for c in ("IDI", "EMI", "MTI", "EVI_raw", "EVI_norm")],
        r(valid_mean("IP_context", ok)).alias("mean_IP_unweighted"),
        r(ratio(F.col("IP_context"))).alias("IP_final"),
        r(ratio(F.abs("IP_context"))).alias("IP_abs_final"),
        r(share(F.col("EVI_raw") > 0)).alias("positive_context_share"),
        r(share(F.col("EVI_raw") < 0)).alias("negative_context_share"),
        r(share(F.col("EVI_raw") == 0)).alias("neutral_context_share"),
        r(share(F.col("referent_salience") == 1.0)).alias("central_context_share"),
        r(share(F.col("referent_salience") == 0.25)).alias("background_context_share"),
        r(valid_mean("referent_salience", ok)).alias("mean_referent_salience"),
        F.count_if(ok).alias("contexts_analyzed"),
        F.count_if(F.col("aggregation_weight") == 0).alias("contexts_excluded"),
        F.count("*").alias("number_of_contexts"),
        technical.alias("technical_mentions_count"),
        (technical if exclude_technical else F.lit(0).cast("long")).alias("technical_mentions_excluded"),
        F.count_distinct(F.when(ok, F.col("doc_id"))).alias("number_of_articles"),
    )
    return out.withColumn("warning", F.when(F.col("contexts_analyzed") == 0, NO_CONTEXT).otherwise(""))


def by_article(scored: DataFrame) -> DataFrame:
    return weighted(["doc_id", "media_country", "outlet_name", "ref_country"], scored)


def by_outlet(scored: DataFrame) -> DataFrame:
    return weighted(["media_country", "outlet_name", "ref_country"], scored)


def by_media_and_referent(scored: DataFrame) -> DataFrame:
    return weighted(["media_country", "ref_country"], scored)


def summary_matrix(scored: DataFrame) -> DataFrame:
    return by_media_and_referent(scored).join(dominant_evi(scored, ["media_country", "ref_country"], ok=F.col("aggregation_weight") > 0), ["media_country", "ref_country"], "left").na.fill({"dominant_EVI": 0}).orderBy("media_country", "ref_country")


def dominant_evi(scored: DataFrame, keys: list[str], column: str = "EVI_raw", ok: Column | None = None) -> DataFrame:
    """The most frequent rounded value in -10..10; ties to the one nearest the mean, then the larger in magnitude; 0 without one.

    ok: which rows count. The condition stands inside the value and not in a
    filter, which the optimiser would trace through all of a score's columns.
    """
    rounded = F.bround(F.col(column).cast("double")).cast("int")
    counted = rounded.between(-10, 10) if ok is None else rounded.between(-10, 10) & ok
    counts = scored.select(*keys, F.when(counted, rounded).alias("v")).groupBy(*keys, "v").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys)
    mean = F.try_divide(F.sum(F.col("n") * F.col("v")).over(group).cast("double"), F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).over(group))
    order = group.orderBy(F.col("v").isNull(), F.desc("n"), F.abs(F.col("v") - F.col("mean")), F.desc(F.abs("v")), "v")
    return counts.withColumn("mean", mean).withColumn("_k", F.row_number().over(order)).where("_k = 1").select(*keys, F.coalesce("v", F.lit(0)).alias("dominant_EVI"))


def reference_summary(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Ratios of sums over the valid contexts, or over all where none is valid."""
    ok = F.col("aggregation_weight") > 0
    of = lambda c: F.when(F.bool_or(ok), F.sum(F.when(ok, c))).otherwise(F.sum(c))
    n = F.greatest(of(F.col("N_content")), F.lit(1))
    emi = of(F.col("N_e_w")) / F.lit(3.0) + 2.0 * of(F.col("N_e_m")) / F.lit(3.0) + of(F.col("N_e_s"))
    contexts = of(F.lit(1))
    return scored.groupBy(*keys).agg(F.round(of(F.col("N_ideol")).cast("double") / n, 6).alias("IDI"), F.round(emi / n, 6).alias("EMI"), F.round(of(F.col("N_met")).cast("double") / n, 6).alias("MTI"), F.round(of(F.col("EVI_raw")).cast("double") / contexts, 6).alias("EVI"), contexts.alias("contexts"))


def trace_coverage(scored: DataFrame, traces: DataFrame) -> DataFrame:
    """Contexts with counted markers and no trace."""
    counted = scored.where(F.col("N_ideol") + F.col("N_e_w") + F.col("N_e_m") + F.col("N_e_s") + F.col("N_met") > 0)
    return counted.join(traces.select("context_id").distinct(), "context_id", "left_anti").select("context_id")


def diagnostics(scored: DataFrame) -> DataFrame:
    """check, status and detail of the run as a whole."""
    checks = {
        "contexts": (F.count("*"), F.count("*") > 0),
        "content_words": (F.sum("N_content"), F.sum("N_content") > 0),
        "technical_mentions": (F.count_if("is_technical_mention"), F.count_if("is_technical_mention") < F.count("*")),
        "markers": (F.sum(F.col("N_ideol") + F.col("N_e_w") + F.col("N_e_m") + F.col("N_e_s") + F.col("N_met")), F.sum(F.col("N_ideol") + F.col("N_e_w") + F.col("N_e_m") + F.col("N_e_s") + F.col("N_met")) > 0),
        "evaluated": (F.count_if(F.col("EVI_raw") != 0), F.count_if(F.col("EVI_raw") != 0) > 0),
        "weights": (F.count_if(F.col("aggregation_weight") > 0), F.count_if(F.col("aggregation_weight") > 0) > 0),
        "evi_range": (F.count_if(~F.col("EVI_raw").between(-10, 10)), F.count_if(~F.col("EVI_raw").between(-10, 10)) == 0),
        "densities": (F.count_if((F.col("IDI") > 1) | (F.col("EMI") > 1) | (F.col("MTI") > 1)), F.count_if((F.col("IDI") > 1) | (F.col("EMI") > 1) | (F.col("MTI") > 1)) == 0),
    }
    one = scored.agg(*[F.struct(F.coalesce(v, F.lit(0)).cast("string").alias("detail"), F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("warning").alias("status")).alias(n) for n, (v, ok) in checks.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"{n}.status").alias("status"), F.col(f"{n}.detail").alias("detail")) for n in checks])))
