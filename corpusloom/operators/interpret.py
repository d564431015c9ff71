"""What scored contexts mean in words, and choices that a reader of a report makes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.profile import Profile
from corpusloom.operators import percentile

#: What an evaluation means, up to each bound (below 0 for the one before neutral).
EVI_WORDS = (
    (-10, "Предельно негативная репрезентация."),
    (-8, "Очень сильная делегитимация."),
    (-6, "Выраженно негативная оценка."),
    (-4, "Умеренно негативная оценка."),
    (-1e-12, "Слабая негативная окраска."),
    (0, "Нейтральная/информационная подача."),
    (3, "Слабая позитивная окраска."),
    (5, "Умеренно позитивная оценка."),
    (7, "Выраженно позитивная оценка."),
    (9, "Очень сильная легитимация."),
    (float("inf"), "Предельно позитивная репрезентация."),
)
#: What an impact means.
IP_NEUTRAL = "Образ преимущественно нейтрален или слабо оценочно оформлен."
IP_POLARISED = "Среднее направление близко к нейтральному, но есть поляризация оценок."
IP_POSITIVE = "Преобладает позитивная направленность образа. Сила воздействия определяется по |IP|."
IP_NEGATIVE = "Преобладает негативная направленность образа. Сила воздействия определяется по |IP|."
#: Levels in Russian.
LEVELS_RU = {"very_low": "очень низкий", "low": "низкий", "medium": "средний", "elevated": "повышенный", "high": "высокий", "extreme": "экстремально высокий"}
#: Parts of keywords that tell a category, by referent.
CATEGORIES = {
    "China": {
        "Leadership": ["xi", "jinping", "beijing", "cpc", "ccp", "prc", "communist party"],
        "Economy": ["yuan", "renminbi", "economy", "trade", "bri", "belt and road", "huawei", "tiktok", "alibaba"],
        "Security": ["taiwan", "south china sea", "pla", "xinjiang", "sanction", "military"],
        "Culture": ["culture", "confucius", "cinema", "music", "sport", "olympic"],
    },
    "USA": {
        "Leadership": ["biden", "trump", "white house", "washington", "congress", "senate"],
        "Economy": ["dollar", "federal reserve", "treasury", "wall street", "economy", "tariff", "trade"],
        "Security": ["pentagon", "nato", "military", "sanction", "defense", "state department"],
        "Culture": ["american culture", "hollywood", "silicon valley", "music", "sport"],
    },
    "Russia": {
        "Leadership": ["putin", "kremlin", "moscow", "lavrov", "medvedev"],
        "Economy": ["ruble", "economy", "energy", "gazprom", "rosneft", "sanction"],
        "Security": ["military", "ukraine war", "csto", "eaeu", "defense"],
        "Culture": ["russian culture", "orthodox", "cinema", "sport"],
    },
}
#: Parts of marker terms that tell a frame or a strategy.
FRAME_RULES = {
    "Суверенитет и легитимность": ["sovereignty", "суверенитет", "legitimate", "responsible actor", "defender"],
    "Угроза и секьюритизация": ["threat", "aggression", "security", "угроза", "агресс", "конфликт"],
    "Партнерство и развитие": ["cooperation", "development", "partnership", "growth", "cooperat", "развитие"],
    "Геополитическое соперничество": ["hegemony", "authoritarian", "санкц", "sanction", "nato", "military"],
}
STRATEGY_RULES = {
    "Легитимация": ["legitimate", "responsible", "stability", "protects", "defends", "cooperation"],
    "Делегитимация": ["violates", "aggressor", "threat", "authoritarian", "диктат", "угроза"],
    "Секьюритизация": ["security", "threat", "military", "defense", "sanction", "конфликт"],
    "Эмоционализация": ["fear", "anger", "catastrophe", "heroic", "panic", "outrage"],
    "Метафоризация": ["battle", "frontline", "wave", "chessboard", "storm", "path"],
}
#: Words of a whole text's evaluation.
POSITIVE_WORDS = ("partner", "cooperation", "support", "stability", "development", "trust", "constructive")
NEGATIVE_WORDS = ("threat", "aggression", "pressure", "crisis", "interference", "coercion", "conflict")
#: Calibration types that a baseline filter keeps.
BASELINE_TYPES = {"neutral_news_only": "neutral_news", "political_news_only": "standard_political_news"}
MIGRATED = "Detected legacy EVI_norm. Recalculated using EVI_norm = EVI / 10."


def evi_words(evi: Column) -> Column:
    return F.coalesce(*[F.when(evi <= bound, words) for bound, words in EVI_WORDS])


def ip_words(ip: Column, ip_abs: Column, near_zero: float = 0.05) -> Column:
    near = F.abs(ip) < near_zero
    return F.when(near & (ip_abs < near_zero), IP_NEUTRAL).when(near, IP_POLARISED).when(ip > 0, IP_POSITIVE).otherwise(IP_NEGATIVE)


def indicator_words(name: str, value: Column, percentile: Column, level: Column, kind: Column | None = None, language: str = "en") -> Column:
    """A sentence on where a value stands in the calibration corpus; kind: the baseline's calibration type."""
    number = F.bround(percentile).cast("int").cast("string")
    value = F.format_string("%.4f", value.cast("double"))
    some = kind if kind is not None else F.lit(None).cast("string")
    there = F.coalesce(some != "", F.lit(False))
    if language.lower().startswith("ru"):
        level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LEVELS_RU.items() for x in pair]), level), level)
        tail = F.when(there, F.concat(F.lit(" (тип baseline: "), some, F.lit(")"))).otherwise("")
        return F.concat(F.lit(f"Значение {name} = "), value, F.lit(" соответствует "), number, F.lit("-му процентилю калибровочного корпуса. Это "), level, F.lit(" уровень относительно эмпирической нормы"), tail, F.lit("."))
    tail = F.when(there, F.concat(F.lit(" (baseline type: "), some, F.lit(")"))).otherwise("")
    return F.concat(F.lit(f"{name} = "), value, F.lit(" corresponds to the "), number, F.lit("th percentile of the calibration corpus. This indicates "), level, F.lit(" level relative to the empirical baseline"), tail, F.lit("."))


def keyword_category(ref_country: Column, keywords: Column, categories: dict = CATEGORIES) -> Column:
    """The categories of which a keyword has a hint in it, in order; keywords: an array. other without one."""
    low = F.transform(keywords, lambda k: F.lower(T.stripped(k)))
    out = F.lit(None).cast("string")
    for referent, hints_of in categories.items():
        has = lambda hints: F.exists(low, lambda k: k.rlike("|".join(map(T.quoted, hints))))
        found = F.concat_ws("; ", *[F.when(F.coalesce(has(hints), F.lit(False)), name) for name, hints in hints_of.items()])
        out = F.when(ref_country == referent, F.nullif(found, F.lit(""))).otherwise(out)
    return F.coalesce(out, F.lit("other"))


def of_category(rows: DataFrame, category: str, column: str = "keyword_category") -> DataFrame:
    """Rows of a category; all stands for every one."""
    return rows if category == "all" else rows.where(F.array_contains(T.split_cell(F.col(column)), category))


def mini_terms(entered: str) -> list[str]:
    """Terms of a list that a user typed: parted by commas, semicolons or lines, each once whatever its case."""
    seen: dict[str, str] = {}
    for term in (x.strip() for x in re.split(r"[,\n;]+", entered)):
        if term:
            seen.setdefault(term.casefold(), term)
    return list(seen.values())


def mini_referents(contexts: DataFrame, terms: list[str]) -> DataFrame:
    """contexts once for each term (mini_referent) that their text or keywords hold, inside words too and in any case."""
    text = F.lower(F.concat_ws("\n", "context_text", "matched_keywords"))
    held = F.array_compact(F.array(*[F.when(text.contains(t.lower()), t) for t in terms])) if terms else F.array().cast("array<string>")
    return contexts.withColumn("mini_referent", F.explode(held))


def baseline_filter(baseline: DataFrame, scored: DataFrame, mode: str) -> DataFrame:
    """The part of a calibration baseline that a mode names, or all of it where that part is empty."""
    if mode == "same_ref_country_only":
        kept = baseline.join(scored.select("ref_country").distinct(), "ref_country", "left_semi").select(*baseline.columns)
        return kept if not kept.isEmpty() else baseline
    if mode in BASELINE_TYPES:
        some = F.col("calibration_type") == BASELINE_TYPES[mode]
    elif mode == "same_language_only" and "language" in scored.columns and "language" in baseline.columns:
        most = scored.where(F.col("language").isNotNull()).groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").first()
        some = F.col("language") == (most.language if most else "")
    else:
        return baseline
    kept = baseline.where(some)
    return kept if not kept.isEmpty() else baseline


def migration_warning(scored: DataFrame) -> DataFrame:
    """With migration_warning: whether any row has its evaluation over 5 instead of over 10."""
    raw, norm = (F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in ("EVI_raw", "EVI_norm"))
    old = (F.abs(norm - raw / 5.0) < 1e-9) & (F.abs(norm - raw / 10.0) > 1e-9)
    told = scored.agg(F.when(F.coalesce(F.bool_or(old), F.lit(False)), MIGRATED).otherwise("").alias("migration_warning"))
    return scored.join(F.broadcast(told))


def with_formula(scored: DataFrame, mode: str) -> DataFrame:
    """Impact by the formula that a mode names: legacy leaves out the 1 beside the energy."""
    legacy = mode.startswith("legacy")
    evi, energy = F.col("EVI_norm"), F.col("IDI") + F.col("EMI") + F.col("MTI")
    ip = F.when(evi == 0, 0.0).otherwise(evi * (energy if legacy else 1.0 + energy))
    version = "legacy_energy_times_evi_norm" if legacy else "updated_evi_norm_times_1_plus_energy"
    return scored.withColumns({"IP_context": ip, "IP_context_abs": F.abs(ip), "IP_formula_version": F.lit(version)})


def outlier_flags(ranked: DataFrame, metrics: tuple[str, ...] = ("IDI", "EMI", "MTI", "IP_context_abs")) -> DataFrame:
    """Rows above the 99th percentile of any metric, flagged; ranked: with <metric>_percentile."""
    above = [F.coalesce(F.col(f"{m}_percentile").try_cast("double"), F.lit(0.0)) > 99 for m in metrics]
    return ranked.where(F.array_contains(F.array(*above), True)).withColumn("flag_case_type", F.lit("suspicious_percentile_outliers"))


def silent_corpus(scored: DataFrame) -> DataFrame:
    """One row, flag_case_type, if there are contexts and the weights of all add up to nothing."""
    return scored.agg(F.count("*").alias("n"), F.coalesce(F.sum("aggregation_weight"), F.lit(0.0)).alias("w")).where("n > 0 and w = 0").select(F.lit("zero_salience_all_contexts").alias("flag_case_type"))


def dominant(scored: DataFrame, rules: dict[str, list[str]], name: str) -> DataFrame:
    """name, score and up to five examples of every rule that marker terms of the contexts have a part of.

    Terms are counted first, so the rules meet each of them once.
    """
    found = [F.col("h_ideol"), F.col("h_met"), *[F.col(c) for c in scored.columns if c.startswith(("p_", "n_")) and c not in ("p_", "n_")]]
    bag = scored.select(F.explode(F.flatten(F.array(*[T.found_terms(f) for f in found]))).alias("term")).groupBy(F.lower("term").alias("term")).agg(F.count("*").alias("n"))
    fits = F.array_compact(F.array(*[F.when(F.col("term").rlike("|".join(map(T.quoted, parts))), label) for label, parts in rules.items()]))
    rows = bag.withColumn(name, F.explode(fits))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "term"))), 1, 5)
    return rows.groupBy(name).agg(F.sum("n").alias("score"), F.array_join(F.transform(best, lambda x: x["term"]), ", ").alias("examples"))


def whole_text_scores(texts: DataFrame, profile: Profile, mode: str = "updated") -> DataFrame:
    """calibration_id, calibration_type and the indicators of whole calibration texts."""
    text = F.coalesce("text", F.lit(""))
    hits = {"ideol": profile.ideological_terms, "met": profile.metaphor_terms} | {k: profile.emotional_terms.get(k, ["\0"]) for k in ("weak", "medium", "strong")}
    words = lambda terms: F.regexp_count(text, F.lit(r"(?iuU)\b(?:" + "|".join(terms) + r")\b"))
    evi = T.clamp(words(POSITIVE_WORDS) - words(NEGATIVE_WORDS), -10, 10).cast("int")
    rows = texts.select("calibration_id", F.coalesce("calibration_type", F.lit("ordinary_political_news")).alias("calibration_type"), F.greatest(T.n_content(text, profile.stopwords), F.lit(1)).alias("n"), evi.alias("EVI_raw"), *[T.total(T.term_hits(text, terms)).alias(k) for k, terms in hits.items()])
    share = lambda x: T.clamp(x.cast("double") / F.col("n"), 0.0, 1.0)
    rows = rows.select("calibration_id", "calibration_type", share(F.col("ideol")).alias("IDI"), share(F.col("weak") / F.lit(3.0) + 2.0 * F.col("medium") / F.lit(3.0) + F.col("strong")).alias("EMI"), share(F.col("met")).alias("MTI"), "EVI_raw", (F.col("EVI_raw") / F.lit(10.0)).alias("EVI_norm"))
    out = with_formula(rows, mode)
    return out.select("calibration_id", "calibration_type", F.col("IDI").alias("IDI_raw"), F.col("EMI").alias("EMI_raw"), F.col("MTI").alias("MTI_raw"), "EVI_raw", "EVI_norm", F.col("IP_context").alias("IP_i"), F.col("IP_context_abs").alias("IP_abs_i"))


def whole_text_report(details: DataFrame) -> DataFrame:
    """Counts, means and upper quartiles of whole_text_scores by calibration type."""
    r = lambda x: F.round(x, 6)
    names = {"IDI": "IDI_raw", "EMI": "EMI_raw", "MTI": "MTI_raw", "IP_abs": "IP_abs_i"}
    means = [r(F.avg(c)).alias(f"mean_{n}") for n, c in (names | {"EVI_raw": "EVI_raw"}).items()]
    sums = details.groupBy("calibration_type").agg(F.count("calibration_id").alias("count"), *means)
    upper = percentile.group_quantiles(details, list(names.values()), "calibration_type", {"p75": 0.75})
    return sums.join(upper.select("calibration_type", *[r(f"{c}_p75").alias(f"p75_{n}") for n, c in names.items()]), "calibration_type")


#: Blocks of a text at most, as a reader sees them.
MOST_BLOCKS = 15


def context_blocks(text: Column, terms: list[str], most: int = MOST_BLOCKS) -> Column:
    """The first sentences that hold a term: hit_sentence, expanded_context (with its neighbours) and markers.

    An array of structures, empty for null or blank texts and without terms. A
    text is split once; sentences are tried with one alternation before single
    terms are told apart.
    """
    known = sorted({t for t in terms if t.strip()})
    kind = "array<struct<hit_sentence:string,expanded_context:string,markers:string>>"
    if not known:
        return F.array().cast(kind)
    some = T.any_pattern(known)

    def blocks(sents: Column) -> Column:
        at = F.filter(F.transform(sents, lambda s, i: F.when(s.rlike(some), i)), lambda i: i.isNotNull())

        def block(i: Column) -> Column:
            found = F.array_compact(F.array(*[F.when(F.get(sents, i).rlike(T.any_pattern([t])), t) for t in known]))
            around = F.concat_ws(" ", F.get(sents, i - 1), F.get(sents, i), F.get(sents, i + 1))
            return F.struct(F.get(sents, i).alias("hit_sentence"), around.alias("expanded_context"), F.array_join(found, ", ").alias("markers"))

        return F.transform(F.slice(at, 1, most), block)

    sents = T.sentences(F.coalesce(text, F.lit("")))
    return F.when(F.coalesce(text, F.lit("")).rlike(some), F.flatten(F.transform(F.array(sents), blocks))).otherwise(F.array()).cast(kind)
