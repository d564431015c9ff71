"""Scoring of referent contexts: densities, evaluation rubric, salience, impact, notes, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.profile import Profile

#: Bylines and datelines, with {} for the capital, and what counts as a predicate.
BYLINES = (r"^reporting by .+ in {}\.?$", r"^by .+ in {}\.?$", r"^reuters in {}\.?$", r"^associated press in {}\.?$", r"^reporting from {}\.?$", r"^laporan oleh .+ di {}\.?$", r"^dilaporkan dari {}\.?$", r"^из {}\.?$", r"^в {}\.?$")
PREDICATE = r"(?U)\b(support|threat|pressure|cooperat|invest|develop|aggress|violat|stabil|interfer)\w*\b"
COARSE_TO_RAW = {-2: -10, -1: -5, 0: 0, 1: 5, 2: 10}


def by_referent(values: dict[str, Column], otherwise) -> Column:
    out = None
    for name, value in values.items():
        fits = F.col("ref_country") == name
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def technical(profile: Profile, extra: tuple[str, ...] = ()) -> Column:
    """struct(flag, reason): the context is a byline, a dateline or only a place name."""
    txt = T.stripped(F.lower("context_text"))
    cases = {}
    for name, capital in profile.capitals.items():
        byline = txt.rlike("|".join(p.format(T.quoted(capital)) for p in BYLINES))
        for pattern in extra:
            byline = byline | txt.rlike("^(?:" + pattern + ")")
        place = txt.rlike(rf"(?U)\b(in|from|di|dari|в|из)\s+{T.quoted(capital)}\b") & ~txt.rlike(PREDICATE) & (F.size(T.tokenize(txt)) <= 14)
        title = capital.title()
        cases[name] = F.when(byline, f"{title} appears only in byline/dateline.").when(place, f"{title} used as geographic location only.")
    reason = F.when(txt == "", "Empty context.").otherwise(by_referent(cases, None))
    return F.struct(reason.isNotNull().alias("flag"), F.coalesce(reason, F.lit("")).alias("reason"))


def contains_any(text: Column, cues: list[str]) -> Column:
    return text.rlike("|".join(T.quoted(c) for c in sorted(set(cues), key=len, reverse=True)))


def hits(contexts: DataFrame, profile: Profile) -> DataFrame:
    """contexts with the hits (arrays of term and n) of every marker list and the rubric's criteria."""
    text = F.col("context_text")
    evaluated = T.stripped(F.concat_ws(" ", "title", F.when(F.col("target_sentence") == "", text).otherwise(F.col("target_sentence"))))
    columns = {"h_ideol": T.term_hits(text, profile.ideological_terms), "h_met": T.term_hits(text, profile.metaphor_terms)}
    columns |= {f"h_{level}": T.term_hits(text, profile.emotional_terms.get(level, ["\0"])) for level in ("weak", "medium", "strong")}
    for name, (positive, negative, _) in profile.rubric.items():
        columns |= {f"p_{name}": T.term_hits(F.col("_eval"), positive), f"n_{name}": T.term_hits(F.col("_eval"), negative)}
    columns["N_content"] = T.n_content(text, profile.stopwords)
    return contexts.withColumn("_eval", evaluated).withColumns({c: T.held(v) for c, v in columns.items()})


def sum_of(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def rubric(rows: DataFrame, profile: Profile) -> DataFrame:
    """positive_score, negative_score, EVI_raw, EVI_norm and their evidence, from hits()."""
    title = F.lower("title")
    in_title = title.contains(F.lower("ref_country")) | contains_any(title, ["washington", "beijing", "moscow"])
    authority = contains_any(F.lower("context_text"), profile.authority)
    new = {}
    for side, label in (("p", "positive"), ("n", "negative")):
        points = {name: T.score_by_terms(F.col(f"{side}_{name}"), most) for name, (_, _, most) in profile.rubric.items()}
        repeated = sum_of([T.total(F.col(f"{side}_{name}")) for name in profile.rubric])
        base = sum_of(list(points.values()))
        prominent = F.when((base > 0) & (in_title | (repeated >= 2) | authority), 1).otherwise(0)
        new |= {f"{label}_score": T.clamp(base + prominent, 0, 10).cast("int"), f"evi_{'pos' if side == 'p' else 'neg'}_hits": repeated, f"{label}_evidence_terms": F.array_join(F.array_sort(F.array_distinct(F.flatten(F.array(*[T.found_terms(F.col(f"{side}_{name}")) for name in profile.rubric])))), "; ")}
        new |= {f"_{side}_{name}": v for name, v in points.items()} | {f"_{side}_salience": prominent}
    rows = rows.withColumns({c: T.held(v) for c, v in new.items()})
    rows = rows.withColumn("EVI_raw", (F.col("positive_score") - F.col("negative_score")).cast("int")).withColumn("EVI_norm", F.col("EVI_raw") / F.lit(10.0))
    parts = [F.struct(F.col(f"_p_{n}").alias("positive"), F.col(f"_n_{n}").alias("negative")).alias(f"criterion_{i}_{n}") for i, n in enumerate([*profile.rubric, "salience"], 1)]
    polarity = F.when(F.col("EVI_raw") > 0, "positive").when(F.col("EVI_raw") < 0, "negative").otherwise("neutral")
    told = F.format_string("%s receives a %s score: P=%d, N=%d, EVI=%d. Score is derived from lexical, action, consequence, ideological and prominence criteria.", "ref_country", polarity, "positive_score", "negative_score", "EVI_raw")
    return rows.withColumns({"evi_evidence": F.to_json(F.struct(*parts)), "evi_explanation": told}).drop(*[f"_{s}_{n}" for s in "pn" for n in [*profile.rubric, "salience"]])


def coarse(rows: DataFrame, profile: Profile) -> Column:
    """The signed difference of hits in the whole context, as -10, -5, 0, 5 or 10."""
    terms = lambda side: sorted({t for lists in profile.rubric.values() for t in lists[side]})
    score = T.total(T.term_hits(F.col("context_text"), terms(0))) - T.total(T.term_hits(F.col("context_text"), terms(1)))
    level = F.when(score <= -3, -2).when(score < 0, -1).when(score == 0, 0).when(score < 3, 1).otherwise(2)
    return F.element_at(F.create_map(*[F.lit(x) for pair in COARSE_TO_RAW.items() for x in pair]), level)


def salience(profile: Profile) -> dict[str, Column]:
    """referent_salience and role, from technical, scores and target_sentence."""
    actions = [*profile.rubric["action"][0], *profile.rubric["action"][1], *profile.neutral_actions]
    acts = contains_any(F.lower("target_sentence"), actions)
    evaluated = F.col("positive_score") + F.col("negative_score") > 0
    pick = lambda a, b, c, d: F.when(F.col("_technical.flag"), a).when(~evaluated & ~acts, b).when(~evaluated, c).otherwise(d)
    return {"referent_salience": pick(0.0, 0.25, 0.5, 1.0), "referent_role": pick("technical", "background", "secondary_actor", "central_actor")}


def impact(rows: DataFrame) -> DataFrame:
    """Energy, impact and weight of each context, from the rounded densities."""
    number = lambda names: F.coalesce(F.col(next(n for n in names if n in rows.columns)).try_cast("double"), F.lit(0.0))
    energy = number(("IDI_i", "IDI_r", "IDI")) + number(("EMI_i", "EMI_r", "EMI")) + number(("MTI_i", "MTI_r", "MTI"))
    evi = number(("EVI_norm_i", "EVI_norm_r", "EVI_norm"))
    ip = F.when(evi == 0, 0.0).otherwise(evi * (1.0 + energy))
    return rows.withColumns({"discursive_energy": energy, "IP_context": ip, "IP_context_abs": F.abs(ip), "IP_old_context": energy * evi, "aggregation_weight": T.clamp(number(("S_i", "S_r", "referent_salience", "salience")), 0.0, 1.0)})


def score(contexts: DataFrame, profile: Profile, evi_mode: str = "fine", manual: DataFrame | None = None, review: DataFrame | None = None) -> DataFrame:
    """All measures of each context, as one projection (two small joins with overrides).

    manual: context_id, ref_country, EVI_raw (-10..10), referent_salience.
    review: context_id, ref_country, marker, is_metaphor; with it only confirmed
    metaphor terms count. evi_mode: fine, suggested, coarse or manual.
    """
    rows = hits(contexts, profile)
    notes = []
    if review is not None:
        confirmed = review.where(T.truthy(F.col("is_metaphor"))).groupBy("context_id", "ref_country").agg(F.collect_set("marker").alias("_confirmed"))
        rows = rows.join(confirmed, ["context_id", "ref_country"], "left")
        n_met = F.size(F.array_intersect(T.found_terms(F.col("h_met")), F.coalesce("_confirmed", F.array().cast("array<string>"))))
        notes.append(F.when((F.size("h_met") > 0) & (F.col("N_met") == 0), "metaphor_candidates_present_but_not_confirmed"))
    else:
        n_met = T.total(F.col("h_met"))
        notes.append(F.when(F.col("N_met") > 0, "metaphor_needs_manual_verification"))
    rows = rows.withColumns({"N_ideol": T.total(F.col("h_ideol")), "N_e_w": T.total(F.col("h_weak")), "N_e_m": T.total(F.col("h_medium")), "N_e_s": T.total(F.col("h_strong")), "N_met": n_met})
    density = lambda x: F.round(F.when(F.col("N_content") > 0, T.clamp(x.cast("double") / F.col("N_content"), 0.0, 1.0)).otherwise(0.0), 6)
    rows = rows.withColumns({"IDI": density(F.col("N_ideol")), "EMI": density(F.col("N_e_w") / F.lit(3.0) + 2.0 * F.col("N_e_m") / F.lit(3.0) + F.col("N_e_s")), "MTI": density(F.col("N_met"))})
    rows = rubric(rows, profile)
    if evi_mode == "coarse":
        rows = rows.withColumn("EVI_raw", coarse(rows, profile).cast("int"))
    if manual is not None:
        valid = manual.where(F.col("EVI_raw").between(-10, 10)).dropDuplicates(["context_id", "ref_country"]).select("context_id", "ref_country", F.col("EVI_raw").cast("int").alias("_evi"), F.when(F.col("referent_salience").isin(0.0, 0.25, 0.5, 1.0), F.col("referent_salience").cast("double")).alias("_s"))
        rows = rows.join(valid, ["context_id", "ref_country"], "left")
    if evi_mode == "manual":
        rows = rows.withColumn("EVI_raw", F.coalesce("_evi", F.lit(0)) if manual is not None else F.lit(0))
        notes.append(F.when(F.col("_evi").isNull(), "manual_evi_missing") if manual is not None else F.lit("manual_evi_missing"))
    if evi_mode == "suggested":
        rows = rows.withColumn("evi_explanation", F.concat(F.lit("Suggested: "), "evi_explanation"))
    rows = rows.withColumn("EVI_norm", F.col("EVI_raw") / F.lit(10.0)).withColumn("_technical", T.held(technical(profile))).withColumns({c: T.held(v) for c, v in salience(profile).items()})
    if manual is not None:
        rows = rows.withColumn("referent_salience", F.coalesce("_s", "referent_salience"))
    rows = rows.withColumns({"is_technical_mention": F.col("referent_salience") == 0.0, "technical_reason": F.col("_technical.reason")})
    rows = impact(rows)
    low_evidence = (F.abs("EVI_raw") >= 7) & (F.col("positive_evidence_terms") == "") & (F.col("negative_evidence_terms") == "")
    notes += [
        F.when(F.col("N_content") <= 0, "invalid_n_content_zero"),
        F.when((F.col("EMI") >= 0.12) & (F.col("EVI_raw") == 0), "high_emi_neutral_evi"),
        F.when((F.col("IDI") >= 0.12) & (F.col("EVI_raw") == 0), "high_idi_neutral_evi"),
        F.when(F.col("N_content") < 8, "low_n_content"),
        F.when((F.col("positive_score") > 0) & (F.col("negative_score") > 0), "ambivalent_context"),
        F.when(low_evidence, "high_evi_low_evidence"),
        F.when((F.col("referent_salience") == 0.0) & ~F.col("_technical.flag"), "salience_zero_but_not_technical"),
    ]
    counts = F.to_json(F.create_map(F.lit("IDI"), "N_ideol", F.lit("EMI_weak"), "N_e_w", F.lit("EMI_medium"), "N_e_m", F.lit("EMI_strong"), "N_e_s", F.lit("MTI"), "N_met"))
    return rows.withColumns({"notes": F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*notes)))), "; "), "marker_counts_by_indicator": counts}).drop("_eval", "_technical", "_confirmed", "_evi", "_s")


def multi_country(scored: DataFrame) -> DataFrame:
    """With multi_country_context: the same passage is a context of several referents."""
    same = Window.partitionBy("doc_id", "context_text")
    return scored.withColumn("multi_country_context", F.size(F.collect_set("ref_country").over(same)) > 1)


def checked(scored: DataFrame) -> DataFrame:
    """Values outside their ranges set right, and the impact worked out anew."""
    empty = F.col("N_content") <= 0
    rows = scored.withColumns({c: T.clamp(F.when(empty, 0.0).otherwise(F.col(c)), 0.0, 1.0) for c in ("IDI", "EMI", "MTI")})
    rows = rows.withColumns({"EVI_raw": F.when(F.col("EVI_raw").between(-10, 10), F.col("EVI_raw")).otherwise(0), "referent_salience": F.when(F.col("referent_salience").between(0.0, 1.0), F.col("referent_salience")).otherwise(0.0)})
    return impact(rows.withColumns({"EVI_norm": F.col("EVI_raw") / F.lit(10.0), "is_technical_mention": F.col("referent_salience") == 0.0}))


def flagged(scored: DataFrame) -> DataFrame:
    """A row for each context and reason to look at it again."""
    c = F.col
    no_terms = (c("positive_evidence_terms") == "") & (c("negative_evidence_terms") == "")
    rules = {
        "technical_mentions_detected": c("is_technical_mention"),
        "multi_country_contexts": c("multi_country_context") if "multi_country_context" in scored.columns else F.lit(False),
        "high_IDI_neutral_EVI": (c("IDI") >= 0.12) & (c("EVI_raw") == 0),
        "high_EMI_neutral_EVI": (c("EMI") >= 0.12) & (c("EVI_raw") == 0),
        "ambivalent_contexts": (c("positive_score") > 0) & (c("negative_score") > 0),
        "high_EVI_low_evidence": (F.abs("EVI_raw") >= 7) & no_terms,
        "low_N_content": c("N_content") < 8,
        "ip_out_of_expected_range": F.abs("IP_context") > 6,
        "invalid_evi_raw": ~c("EVI_raw").between(-10, 10),
        "invalid_evi_norm": F.abs(c("EVI_norm") - c("EVI_raw") / F.lit(10.0)) > 1e-9,
        "invalid_referent_salience": ~c("referent_salience").between(0.0, 1.0),
        "invalid_referent_salience_set": ~c("referent_salience").isin(0.0, 0.25, 0.5, 1.0),
        "salience_zero_not_technical": (c("referent_salience") == 0.0) & ~c("is_technical_mention"),
        "salience_zero_weight_mismatch": (c("referent_salience") == 0.0) & (c("aggregation_weight") != 0.0),
        "evi_zero_ip_nonzero": (c("EVI_norm") == 0.0) & (F.abs("IP_context") > 1e-9),
    }
    reasons = F.array_union(T.split_cell(c("notes")), F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()])))
    return scored.withColumn("flag_case_type", F.explode(F.array_sort(F.array_distinct(reasons))))


def traces(scored: DataFrame, profile: Profile, meta: DataFrame | None = None) -> DataFrame:
    """A row for each indicator and term that a context was scored by; meta: term (lower case) and its fields."""
    of = lambda name, column: F.transform(column, lambda x: F.struct(F.lit(name).alias("indicator"), x["term"].alias("marker_text"), x["n"].alias("hits")))
    found = [of("IDI", F.col("h_ideol")), of("EMI_weak", F.col("h_weak")), of("EMI_medium", F.col("h_medium")), of("EMI_strong", F.col("h_strong")), of("MTI", F.col("h_met"))]
    found += [of("EVI_positive", F.col(f"p_{n}")) for n in profile.rubric] + [of("EVI_negative", F.col(f"n_{n}")) for n in profile.rubric]
    silent = F.when(F.col("referent_salience") == 0.0, F.array(F.struct(F.lit("S_r").alias("indicator"), F.col("technical_reason").alias("marker_text"), F.lit(0).alias("hits")))).otherwise(F.filter(F.array(F.struct(F.lit("").alias("indicator"), F.lit("").alias("marker_text"), F.lit(0).alias("hits"))), lambda x: F.lit(False)))
    rows = scored.select("context_id", "doc_id", "ref_country", "context_text", F.explode(F.array_distinct(F.concat(*found, silent))).alias("t")).select("context_id", "doc_id", "ref_country", "context_text", "t.*")
    span = T.first_span(F.col("context_text"), F.col("marker_text"))
    rows = rows.withColumns({"marker_id": F.sha2(F.concat_ws("\x1f", "context_id", "indicator", "marker_text"), 256), "matched_span": span}).drop("context_text")
    return rows if meta is None else rows.join(last_of_each(meta), F.lower("marker_text") == F.col("term"), "left").drop("term")


def last_of_each(meta: DataFrame) -> DataFrame:
    """One row for each term (in lower case, without white space at the ends): the last one by row, where rows are numbered."""
    rows = meta.withColumn("term", F.lower(T.stripped(F.col("term")))).where(F.col("term") != "")
    fields = [c for c in rows.columns if c not in ("term", "row")]
    order = F.col("row") if "row" in rows.columns else F.lit(0)
    return rows.groupBy("term").agg(F.max_by(F.struct(*fields), order).alias("_f")).select("term", "_f.*")


def formula_traces(scored: DataFrame) -> DataFrame:
    """Six formulas for each context, symbolic and with its numbers."""
    c = F.col
    dens = lambda name, symbolic, n: (name, symbolic, F.format_string("%s = %s / %d", F.lit(name), n, "N_content"), c(name), c(name) * 100)
    emi = F.round(c("N_e_w") / F.lit(3.0) + 2.0 * c("N_e_m") / F.lit(3.0) + c("N_e_s"), 6)
    rows = [
        dens("IDI", "IDI = N_ideol / N_content", c("N_ideol").cast("string")),
        dens("EMI", "EMI = (1/3 N_weak + 2/3 N_medium + N_strong) / N_content", T.number_text(emi)),
        dens("MTI", "MTI = N_met / N_content", c("N_met").cast("string")),
        ("EVI", "EVI = P - N; EVI_norm = EVI / 10", F.format_string("EVI = %d - %d = %d", "positive_score", "negative_score", "EVI_raw"), c("EVI_raw").cast("double"), F.lit(None).cast("double")),
        ("S_r", "S_r in {0, 0.25, 0.5, 1}", F.format_string("S_r = %s", T.number_text(c("referent_salience"))), c("referent_salience"), c("referent_salience") * 100),
        ("IP", "IP = EVI_norm (1 + IDI + EMI + MTI)", F.format_string("IP = %s * (1 + %s)", T.number_text(c("EVI_norm")), T.number_text(F.round("discursive_energy", 6))), c("IP_context"), F.lit(None).cast("double")),
    ]
    structs = [F.struct(F.lit(n).alias("formula_name"), F.lit(s).alias("symbolic_formula"), sub.alias("substitution"), F.round(r, 6).alias("result_raw"), F.round(p, 4).alias("result_percent")) for n, s, sub, r, p in rows]
    return scored.select("context_id", F.inline(F.array(*structs))).withColumn("trace_id", F.sha2(F.concat_ws("\x1f", "context_id", "formula_name"), 256))
