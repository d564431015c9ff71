"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from corpusloom.functions import lexicons as L
from corpusloom.functions import text as T
from corpusloom.plans import calibration_queries, more_oracles
from corpusloom.plans.tables import PROFILE

P = PROFILE


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def r6(x: str) -> str:
    """Rounded half up on the decimal text, as Spark does."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), 6) AS DOUBLE)"


#: The mean of value in whole billionths, rounded half up to six places without doubles.
UNITS_SUM = "sum(CAST(round(value * 1000000000) AS HUGEINT))::HUGEINT"
MEAN6 = f"((2 * {UNITS_SUM} + 1000 * count(*) - ((2 * {UNITS_SUM} + 1000 * count(*)) % (2000 * count(*)) + 2000 * count(*)) % (2000 * count(*))) // (2000 * count(*)))::DOUBLE / 1000000.0::DOUBLE"


def half_up(x: str) -> str:
    """Half up to six places, after what doubles leave beyond the ninth is gone."""
    return r6(f"round({x}, 9)")


def among(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


TOKEN = T.TOKEN.replace("'", "''")
RAW = f"list_filter(list_transform(regexp_extract_all(%s, '{TOKEN}'), lambda t: trim(lower(t), '-''_')), lambda t: t <> '')"
US = T.US
STOP = quoted(L.STOPWORDS_STRICT)
CORE = quoted(L.STOPWORDS_CORE)


def lemma(t: str) -> str:
    cases = "".join(f" WHEN suffix({t}, '{e}') AND length({t}) > {len(e) + 2} THEN left({t}, length({t}) - {len(e)})" for e in (*T.ENGLISH_ENDINGS, *T.INDONESIAN_ENDINGS))
    return f"CASE{cases} ELSE {t} END"


def preprocessed(text: str, use_lemma: bool) -> str:
    kept = f"list_filter({RAW % f"regexp_replace({text}, '{US}', ' usa ', 'g')"}, lambda t: NOT list_contains({STOP}, t))"
    if use_lemma:
        kept = f"list_transform({kept}, lambda t: {lemma('t')})"
    return f"list_filter({kept}, lambda t: NOT list_contains({STOP}, t) AND length(t) >= 2)"


def docs(use_lemma: bool = False) -> str:
    return f"""base AS (SELECT doc_id AS seq, source, CAST(doc_id % 5 + 2022 AS INT) AS year, lang AS country, lang AS language, coalesce(text, '') AS text FROM documents),
    docs AS (SELECT * FROM (SELECT *, {preprocessed('text', use_lemma)} AS tokens FROM base) WHERE len(tokens) > 0),
    toks AS (SELECT seq, source, year, country, unnest(tokens) AS token FROM docs)"""


def sents(text: str) -> str:
    parts = f"string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30))"
    return f"list_filter(list_transform({parts}, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


def hits(tokens: str, values) -> str:
    return f"len(list_filter({tokens}, lambda t: t IN {among(values)}))"


def by_language(tokens: str, lists: dict, otherwise) -> str:
    return "CASE " + " ".join(f"WHEN language = '{k}' THEN {hits(tokens, v)}" for k, v in lists.items()) + f" ELSE {hits(tokens, otherwise)} END"


POS = by_language("tokens", P.positive, P.any_positive)
NEG = by_language("tokens", P.negative, P.any_negative)
SENT = f"sent AS (SELECT seq, source, year, country, pos_hits, neg_hits, token_count, score, CASE WHEN score > 0.001 THEN 'positive' WHEN score < -0.001 THEN 'negative' ELSE 'neutral' END AS label FROM (SELECT *, (pos_hits - neg_hits)::DOUBLE / greatest(token_count, 1) AS score FROM (SELECT seq, source, year, country, {POS} AS pos_hits, {NEG} AS neg_hits, len(tokens) AS token_count FROM docs)))"


def marker_rows(lists: dict, otherwise: dict) -> str:
    names = sorted({n for x in [*lists.values(), otherwise] for n in x})
    return " UNION ALL ".join(f"SELECT seq, source, year, country, '{n}' AS name, {by_language('tokens', {k: v.get(n, ['@']) for k, v in lists.items()}, otherwise.get(n, ['@']))} AS hits FROM docs" for n in names)


FRAMES = f"frames AS ({marker_rows(P.frames, P.any_frames)})"


def xlogx(x: str) -> str:
    return f"(CASE WHEN ({x}) > 0 THEN ({x})::DOUBLE * ln(({x})::DOUBLE) ELSE 0 END)"


def llr(a: str, b: str, c: str, d: str) -> str:
    plus = [a, b, c, d, f"({a}) + ({b}) + ({c}) + ({d})"]
    minus = [f"({a}) + ({b})", f"({c}) + ({d})", f"({a}) + ({c})", f"({b}) + ({d})"]
    return f"greatest(0.0, 2.0 * ({' + '.join(map(xlogx, plus))} - {' - '.join(map(xlogx, minus))}))"


ANCHORS = " UNION ALL ".join(f"SELECT '{c}' AS anchor_country, {quoted(ts)} AS terms" for c, ts in P.anchors.items())


def pattern(term: str) -> str:
    return rf"(?i)\b{T.quoted(term)}\b".replace("'", "''")


def count_of(text: str, term: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern(term)}'))"


def total_of(text: str, terms) -> str:
    return "(" + " + ".join(count_of(text, t) for t in sorted(set(terms))) + ")"


def found_of(text: str, terms) -> str:
    return "(" + " + ".join(f"({count_of(text, t)} > 0)::INT" for t in sorted(set(terms))) + ")"


def contexts() -> str:
    """Contexts by gaps and islands over sentence numbers."""
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, i, s, '{name}' AS ref_country, list_filter({quoted(sorted(ks))}, lambda k: regexp_matches(s, '(?i)\\b' || k || '\\b')) AS found FROM each" for name, ks in P.referents.items()
    )
    return f"""split AS (SELECT doc_id, source, {sents("coalesce(text, '')")} AS sents FROM documents),
    each AS (SELECT doc_id, unnest(range(len(sents))) AS i, unnest(sents) AS s FROM split),
    hits AS (SELECT * FROM ({kinds}) WHERE len(found) > 0),
    marks AS (SELECT *, CASE WHEN i - lag(i) OVER w > 2 THEN 1 ELSE 0 END AS new FROM hits WINDOW w AS (PARTITION BY doc_id, ref_country ORDER BY i)),
    groups AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, ref_country ORDER BY i) AS g FROM marks),
    windows AS (SELECT doc_id, ref_country, g, greatest(min(i) - 1, 0) AS low, max(i) + 1 AS high, string_agg(s, ' ' ORDER BY i) AS target_sentence, list_sort(list_distinct(flatten(list(found)))) AS keywords FROM groups GROUP BY ALL),
    contexts AS (SELECT printf('%s__%s__%03d', CAST(w.doc_id AS VARCHAR), ref_country, CAST(g + 1 AS INT)) AS context_id, CAST(w.doc_id AS VARCHAR) AS doc_id, CASE WHEN w.doc_id % 2 = 0 THEN 'Malaysia' ELSE 'Indonesia' END AS media_country, source AS outlet_name, ref_country,
        array_to_string(keywords, '; ') AS matched_keywords, array_to_string(sents[low + 1 : least(high, len(sents) - 1) + 1], ' ') AS context_text, CASE WHEN low > 0 THEN sents[low] ELSE '' END AS previous_sentence, target_sentence, coalesce(sents[least(high, len(sents) - 1) + 2], '') AS next_sentence
        FROM windows w JOIN split USING (doc_id))"""


def scored() -> str:
    """Contexts with all measures of the fixture profile, in which titles are empty and no context is technical by its capital."""
    text, ev = "context_text", "trim(CASE WHEN target_sentence = '' THEN context_text ELSE target_sentence END)"
    content = f"len(list_filter({RAW % text}, lambda t: NOT list_contains({CORE}, t) AND length(t) >= 2))"
    sides = {}
    for side, k in (("p", 0), ("n", 1)):
        points = " + ".join(f"least({most}, {found_of('ev', lists[k])})" for lists_most in [(x, x[2]) for x in P.rubric.values()] for lists, most in [lists_most])
        repeated = " + ".join(total_of("ev", x[k]) for x in P.rubric.values())
        sides[side] = (points, repeated)
    authority = " OR ".join(f"contains(lower(context_text), '{c}')" for c in P.authority)
    acts = " OR ".join(f"contains(lower(target_sentence), '{c}')" for c in [*P.rubric["action"][0], *P.rubric["action"][1], *P.neutral_actions])
    places = "regexp_matches(lower(context_text), '\\b(in|from|di|dari|в|из)\\s+capital\\b') AND FALSE"
    density = lambda x: r6(f"CASE WHEN N_content > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({x})::DOUBLE / N_content)) ELSE 0.0::DOUBLE END")
    return contexts() + f""",
    counted AS (SELECT *, {ev} AS ev, CAST({content} AS INT) AS N_content, {total_of(text, P.ideological_terms)} AS N_ideol, {total_of(text, P.emotional_terms['weak'])} AS N_e_w, {total_of(text, P.emotional_terms['medium'])} AS N_e_m, {total_of(text, P.emotional_terms['strong'])} AS N_e_s, {total_of(text, P.metaphor_terms)} AS N_met FROM contexts),
    points AS (SELECT *, {sides['p'][0]} AS pp, {sides['p'][1]} AS pr, {sides['n'][0]} AS np, {sides['n'][1]} AS nr, ({authority}) AS auth, ({acts}) AS acts, {places} AS place FROM counted),
    rated AS (SELECT *, CAST(least(10, pp + CASE WHEN pp > 0 AND (pr >= 2 OR auth) THEN 1 ELSE 0 END) AS INT) AS positive_score, CAST(least(10, np + CASE WHEN np > 0 AND (nr >= 2 OR auth) THEN 1 ELSE 0 END) AS INT) AS negative_score,
        {density('N_ideol')} AS IDI, {density('N_e_w / 3.0::DOUBLE + 2.0::DOUBLE * N_e_m / 3.0::DOUBLE + N_e_s')} AS EMI, {density('N_met')} AS MTI FROM points),
    judged AS (SELECT *, positive_score - negative_score AS EVI_raw, (positive_score - negative_score) / 10.0::DOUBLE AS EVI_norm, CASE WHEN positive_score + negative_score = 0 AND NOT acts THEN 0.25::DOUBLE WHEN positive_score + negative_score = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS referent_salience FROM rated),
    scored AS (SELECT *, CASE WHEN EVI_norm = 0 THEN 0.0 ELSE EVI_norm * (1.0::DOUBLE + (IDI + EMI + MTI)) END AS IP_context, abs(CASE WHEN EVI_norm = 0 THEN 0.0 ELSE EVI_norm * (1.0::DOUBLE + (IDI + EMI + MTI)) END) AS IP_context_abs, (IDI + EMI + MTI) * EVI_norm AS IP_old, referent_salience AS aggregation_weight FROM judged)"""


def weighted(keys: str) -> str:
    mean = lambda c, n=None: f"{r6(f'round(sum({c}::DOUBLE), 9) / count(*)')} AS {n or 'mean_' + c}"
    share = lambda c, n: f"{r6(f'avg(({c})::INT::DOUBLE)')} AS {n}"
    return f"""SELECT {keys}, {mean('IDI')}, {mean('EMI')}, {mean('MTI')}, {mean('EVI_raw')}, {mean('EVI_norm')}, {mean('IP_context', 'mean_IP_unweighted')},
    {r6('round(sum(aggregation_weight * IP_context), 9) / round(sum(aggregation_weight), 9)')} AS IP_final, {r6('round(sum(aggregation_weight * IP_context_abs), 9) / round(sum(aggregation_weight), 9)')} AS IP_abs_final,
    {share('EVI_raw > 0', 'positive_context_share')}, {share('EVI_raw < 0', 'negative_context_share')}, {share('EVI_raw = 0', 'neutral_context_share')}, {share('referent_salience = 1', 'central_context_share')}, {share('referent_salience = 0.25', 'background_context_share')}, {mean('referent_salience')},
    count(*) AS contexts_analyzed, 0::BIGINT AS contexts_excluded, count(*) AS number_of_contexts, 0::BIGINT AS technical_mentions_count, 0::BIGINT AS technical_mentions_excluded, count(DISTINCT doc_id) AS number_of_articles, '' AS warning FROM scored GROUP BY {keys}"""


def concentration(keys: str) -> str:
    return f"""WITH {docs()}, c AS (SELECT {keys}, source, count(*) AS n FROM docs GROUP BY ALL), s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY {keys}) AS p FROM c),
    r AS (SELECT {keys}, sum(n)::BIGINT AS doc_count, count(*) AS active_sources, sum(p * p) AS hhi, -sum(p * ln(p)) AS e, max(p) AS hi, min(p) AS lo FROM s GROUP BY {keys}), t AS (SELECT count(DISTINCT source) AS total_sources FROM docs)
    SELECT {keys}, doc_count, active_sources, total_sources, round(active_sources::DOUBLE / total_sources, 6) AS coverage_ratio, round(hhi, 6) AS hhi_concentration, round(e + 0.0, 6) AS shannon_entropy, round(CASE WHEN e > 0 THEN exp(e) ELSE 1.0 END, 6) AS effective_sources, round(hi, 6) AS max_source_share, round(lo, 6) AS min_active_source_share, round(hi / lo, 6) AS imbalance_ratio_max_to_min FROM r, t"""


def chi2(counts: str, target: str, categories: str) -> str:
    return f"""SELECT a AS country_a, b AS country_b, '{target}' AS test_target, round(CASE WHEN k >= 2 AND n > 0 THEN chi2 ELSE 0 END, 6) AS chi2, CAST(CASE WHEN k >= 2 AND n > 0 THEN k - 1 ELSE 0 END AS INT) AS df, v, CASE WHEN k >= 2 AND n > 0 THEN chi2 ELSE 0 END / 2 AS half FROM (
      SELECT a, b, sum(CASE WHEN ra * (x + y) / n > 0 THEN (x - ra * (x + y) / n) ** 2 / (ra * (x + y) / n) ELSE 0 END + CASE WHEN rb * (x + y) / n > 0 THEN (y - rb * (x + y) / n) ** 2 / (rb * (x + y) / n) ELSE 0 END) AS chi2, max(n) AS n, max(k) AS k, CASE WHEN max(k) >= 2 AND max(n) > 0 THEN sqrt(sum(CASE WHEN ra * (x + y) / n > 0 THEN (x - ra * (x + y) / n) ** 2 / (ra * (x + y) / n) ELSE 0 END + CASE WHEN rb * (x + y) / n > 0 THEN (y - rb * (x + y) / n) ** 2 / (rb * (x + y) / n) ELSE 0 END) / max(n)) ELSE 0 END AS v FROM (
        SELECT a, b, x, y, sum(x) OVER p AS ra, sum(y) OVER p AS rb, sum(x) OVER p + sum(y) OVER p AS n, count(*) OVER p AS k FROM (
          SELECT p.a, p.b, c.category, coalesce(u.n, 0)::DOUBLE AS x, coalesce(w.n, 0)::DOUBLE AS y FROM pairs p CROSS JOIN ({categories}) c LEFT JOIN ({counts}) u ON u.country = p.a AND u.category = c.category LEFT JOIN ({counts}) w ON w.country = p.b AND w.category = c.category) WINDOW p AS (PARTITION BY a, b)) GROUP BY a, b)"""


#: The tail of chi-square by the power series of the incomplete gamma function, whose terms are all positive.
TAIL = "CASE WHEN df <= 0 OR half <= 0 THEN 1.0::DOUBLE WHEN half > 700 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - list_sum(list_transform(range(0, 2000), lambda i: exp((df / 2.0::DOUBLE + i) * ln(half) - half - lgamma(df / 2.0::DOUBLE + i + 1))))) END"


def significance(p_values: bool = False) -> str:
    frames = "SELECT country, name AS category, sum(hits)::BIGINT AS n FROM frames WHERE hits > 0 GROUP BY ALL"
    labels = "SELECT country, label AS category, count(*) AS n FROM sent GROUP BY ALL"
    both = chi2(frames, "frame_distribution", f"SELECT DISTINCT category FROM ({frames})") + " UNION ALL " + chi2(labels, "sentiment_distribution", "SELECT unnest(['positive', 'negative', 'neutral']) AS category")
    return f"""WITH {docs()}, {SENT}, {FRAMES}, cs AS (SELECT DISTINCT country FROM docs), pairs AS (SELECT x.country AS a, y.country AS b FROM cs x JOIN cs y ON x.country < y.country)
    SELECT country_a, country_b, test_target, chi2, df, round(v, 6) AS cramers_v, CASE WHEN v < 0.1 THEN 'negligible' WHEN v < 0.3 THEN 'small' WHEN v < 0.5 THEN 'moderate' ELSE 'strong' END AS effect_size_label{f", printf('%.8f', {TAIL}) AS p_value" if p_values else ''} FROM ({both})"""


LEVEL = "CASE WHEN {0} <= 10 THEN 'minimal' WHEN {0} <= 20 THEN 'very_low' WHEN {0} <= 35 THEN 'low' WHEN {0} <= 50 THEN 'moderately_low' WHEN {0} <= 65 THEN 'medium' WHEN {0} <= 80 THEN 'elevated' WHEN {0} <= 90 THEN 'high' WHEN {0} <= 97 THEN 'very_high' ELSE 'extreme' END"
METRICS = ("IDI", "EMI", "MTI", "IP_context_abs")


def rank_of(m: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    tied = f"PARTITION BY {by + ', ' if by else ''}{m}"
    return f"(rank() OVER ({part} ORDER BY {m}) + (count(*) OVER ({tied}) - 1) / 2.0::DOUBLE) / count(*) OVER ({part}) * 100"


def reader_matrix() -> str:
    """Means from sums in whole billionths."""
    billionths = lambda x: f"sum(CAST(round(({x})::DOUBLE * 1000000000) AS HUGEINT))::DOUBLE"
    mean = lambda x: f"{billionths(x)} / count(*)::DOUBLE / 1000000000.0::DOUBLE"
    share = lambda x: f"count(*) FILTER ({x})::DOUBLE / count(*)::DOUBLE"
    ranks = {"IDI": "IDI", "EMI": "EMI", "MTI": "MTI", "IP": "ip", "IP_abs": "abs(ip)"}
    raw = ", ".join(f"{mean(m)} AS mean_{m}_raw, {mean(f'round({m} * 100.0::DOUBLE, 6)')} AS mean_{m}_percent_value, {mean(f'{m}_rank')} AS mean_{m}_percentile" for m in ("IDI", "EMI", "MTI"))
    final = f"{billionths('round(ip, 8) * aggregation_weight')} / {billionths('aggregation_weight')}"
    final_abs = f"{billionths('round(abs(ip), 8) * aggregation_weight')} / {billionths('aggregation_weight')}"
    return f"""WITH {scored()}, i AS (SELECT *, IP_context::DOUBLE AS ip FROM scored), p AS (SELECT *, {', '.join(f'round({rank_of(x)}, 6) AS {n}_rank' for n, x in ranks.items())} FROM i)
    SELECT media_country, ref_country, count(*) AS number_of_contexts, count(DISTINCT doc_id) AS number_of_articles, count(*) AS contexts_analyzed, 0::BIGINT AS contexts_excluded, 0::BIGINT AS technical_mentions_count, 0::BIGINT AS technical_mentions_excluded, {raw},
        {mean('EVI_raw')} AS mean_EVI_raw, {mean('EVI_norm')} AS mean_EVI_norm, {final} AS IP_final, {final_abs} AS IP_abs_final, {mean('IP_rank')} AS mean_IP_percentile, {mean('IP_abs_rank')} AS mean_IP_abs_percentile,
        {share('EVI_raw > 0')} AS positive_context_share, {share('EVI_raw < 0')} AS negative_context_share, {share('EVI_raw = 0')} AS neutral_context_share, {share('referent_salience = 1')} AS central_context_share, '' AS warning,
        {final} AS mean_IP, {final_abs} AS mean_abs_IP, {mean('EVI_raw')} AS mean_EVI FROM p GROUP BY media_country, ref_country"""


def tag(t: str) -> str:
    cases = "".join(" WHEN " + " OR ".join(f"suffix({t}, '{e}')" for e in es) + f" THEN '{n}'" for n, es in T.TAG_ENDINGS.items())
    return f"CASE WHEN list_contains({CORE}, {t}) THEN 'FUNC'{cases} ELSE 'NOUN' END"


def all_sql() -> dict[str, str]:
    base = f"WITH {docs()}"
    sc = f"WITH {scored()}"
    top = lambda key: f"{base}, c AS (SELECT {key}, token, count(*) AS freq FROM toks GROUP BY ALL) SELECT {key}, token, freq FROM c QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY freq DESC, token) <= 250"
    hint = lambda lang: f"len(list_intersect(list_distinct(raw), {quoted(sorted(set(L.LANG_HINTS[lang])))}))"
    anchor_terms = sorted({t for ts in P.anchors.values() for t in ts})
    sql = {
        "corpus_profile_lang": f"{base} SELECT language, count(*) AS doc_count FROM docs GROUP BY language",
        "corpus_profile_source_lang_year": f"{base} SELECT source, country, year, count(*) AS doc_count FROM docs GROUP BY ALL",
        "corpus_profile_all": f"""{base}, d AS (SELECT source, country, CAST(year AS VARCHAR) AS year, language FROM docs)
            SELECT CAST(grouping(source) * 8 + grouping(country) * 4 + grouping(year) * 2 + grouping(language) AS INT) AS profile, coalesce(source, '-') AS source, coalesce(country, '-') AS country, coalesce(year, '-') AS year, coalesce(language, '-') AS language, count(*) AS doc_count FROM d GROUP BY GROUPING SETS ((source), (country), (year), (language), (source, country, year))""",
        "token_freq_overall": f"{base} SELECT token, count(*) AS freq FROM toks GROUP BY token ORDER BY freq DESC, token LIMIT 250",
        "token_freq_by_lang": top("country"),
        "token_freq_by_source": top("source"),
        "doc_freq": f"{base} SELECT token, count(DISTINCT seq) AS doc_freq FROM toks GROUP BY token",
        "lemma_freq": f"WITH {docs(True)} SELECT token, count(*) AS freq FROM toks GROUP BY token ORDER BY freq DESC, token LIMIT 250",
        "sentence_count": f"SELECT doc_id, CAST(len({sents('text')}) AS INT) AS n_sentences FROM documents",
        "n_content": f"SELECT doc_id, CAST(len(list_filter({RAW % 'text'}, lambda t: NOT list_contains({CORE}, t) AND length(t) >= 2)) AS INT) AS n_content FROM documents",
        "content_pos_mix": f"WITH w AS (SELECT lang, unnest({RAW % 'text'}) AS t FROM documents) SELECT lang, {tag('t')} AS pos, count(*) AS n FROM w GROUP BY ALL",
        "language_detect": f"""WITH r AS (SELECT doc_id, {RAW % f"regexp_replace(text, '{US}', ' usa ', 'g')"} AS raw FROM documents), h AS (SELECT doc_id, {hint('en')} AS a, {hint('id')} AS b, {hint('ms')} AS c, {hint('ru')} AS d FROM r)
            SELECT doc_id, CASE WHEN greatest(a, b, c, d) < 2 THEN 'mixed' WHEN a = greatest(a, b, c, d) THEN 'en' WHEN b = greatest(a, b, c, d) THEN 'id' WHEN c = greatest(a, b, c, d) THEN 'ms' ELSE 'ru' END AS detected FROM h""",
        "strip_boilerplate": f"SELECT doc_id, CAST(length(array_to_string(list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: NOT regexp_matches(lower(x), '{'|'.join(T.BOILERPLATE)}')), chr(10))) AS INT) AS n_chars_left FROM documents",
        "kwic": f"""{base}, h AS (SELECT seq, source, year, country, tokens, unnest(range(len(tokens))) AS pos FROM docs)
            SELECT seq, CAST(pos AS INT) AS pos, source, year, country, array_to_string(tokens[greatest(pos - 6, 1) : pos], ' ') AS left_context, tokens[pos + 1] AS keyword, array_to_string(tokens[pos + 2 : pos + 8], ' ') AS right_context FROM h WHERE tokens[pos + 1] IN {among(anchor_terms)}""",
        "referent_sentences": f"""{base}, s AS (SELECT seq, {sents('text')} AS sents FROM docs), e AS (SELECT seq, sents, unnest(range(len(sents))) AS i FROM s), w AS (SELECT *, {preprocessed('sents[i + 1]', True)} AS t FROM e),
            f AS (SELECT *, {', '.join(f"list_filter(t, lambda x: x IN {among(ts)})[1] AS f{n}" for n, ts in enumerate(P.anchors.values()))} FROM w)
            SELECT seq, CAST(i AS INT) AS i, CASE {' '.join(f"WHEN f{n} IS NOT NULL THEN '{c}'" for n, c in enumerate(P.anchors))} END AS anchor_country, coalesce({', '.join(f'f{n}' for n in range(len(P.anchors)))}) AS anchor_term, CASE WHEN i > 0 THEN sents[i] ELSE '' END AS prev_sent, sents[i + 1] AS hit_sent, coalesce(sents[i + 2], '') AS next_sent FROM f WHERE coalesce({', '.join(f'f{n}' for n in range(len(P.anchors)))}) IS NOT NULL""",
        "collocations": f"""{base}, an AS ({ANCHORS}), pos AS (SELECT seq, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM docs), hit AS (SELECT a.anchor_country, a.terms, seq, tokens, i FROM pos JOIN an a ON list_contains(a.terms, tokens[i])),
            near AS (SELECT anchor_country, terms, unnest(list_concat(tokens[greatest(i - 5, 1) : i - 1], tokens[i + 1 : i + 5])) AS w FROM hit), co AS (SELECT anchor_country, w, count(*) AS a FROM near WHERE NOT list_contains(terms, w) AND NOT list_contains({STOP}, w) AND length(w) >= 2 GROUP BY ALL HAVING count(*) >= 5),
            ax AS (SELECT anchor_country, count(*) AS x FROM hit GROUP BY ALL), v AS (SELECT token, count(*) AS y, count(DISTINCT seq) AS df FROM toks GROUP BY token), tt AS (SELECT count(*) AS n FROM toks), nd AS (SELECT count(*) AS m FROM docs),
            j AS (SELECT anchor_country, w AS collocate, a, x, y, n, greatest(x - a, 0) AS b, greatest(y - a, 0) AS c, greatest(n - a - greatest(x - a, 0) - greatest(y - a, 0), 0) AS d FROM co JOIN ax USING (anchor_country) JOIN v ON v.token = w, tt, nd WHERE df <= 0.4 * m),
            r AS (SELECT anchor_country, collocate, a AS cooc_freq, round(log2(a::DOUBLE * n / (x::DOUBLE * y)), 5) AS mi, round((a - x::DOUBLE * y / n) / sqrt(a::DOUBLE), 5) AS t_score, round({llr('a', 'b', 'c', 'd')}, 5) AS llr_g2 FROM j)
            SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY anchor_country ORDER BY llr_g2 DESC, cooc_freq DESC, collocate) <= 250""",
        "keywords_llr": f"""{base}, c AS (SELECT country, token, count(*) AS a FROM toks GROUP BY ALL), s AS (SELECT country, sum(a)::BIGINT AS st FROM c GROUP BY country), t AS (SELECT token, sum(a)::BIGINT AS af FROM c GROUP BY token), n AS (SELECT sum(a)::BIGINT AS n FROM c),
            j AS (SELECT country, token, a, st - a AS b, af - a AS c, (n - st) - (af - a) AS d, a::DOUBLE / st AS sr, (af - a)::DOUBLE / (n - st) AS rr FROM c JOIN s USING (country) JOIN t USING (token), n WHERE a >= 5)
            SELECT country, token, a AS sub_freq, round(sr, 8) AS sub_rate, round(rr, 8) AS rest_rate, round({llr('a', 'b', 'c', 'd')}, 5) AS llr_g2 FROM j WHERE sr > rr ORDER BY llr_g2 DESC, country, token LIMIT 3000""",
        "logodds_tokens": f"""{base}, c AS (SELECT country, token, count(*) AS f FROM toks GROUP BY ALL), s AS (SELECT country, sum(f)::BIGINT AS n FROM c GROUP BY country), p AS (SELECT x.country AS ca, y.country AS cb, x.n AS n1, y.n AS n2 FROM s x JOIN s y ON x.country < y.country),
            v AS (SELECT ca, cb, n1, n2, token FROM p JOIN c ON c.country IN (ca, cb) GROUP BY ALL), j AS (SELECT v.*, coalesce(a.f, 0) AS fa, coalesce(b.f, 0) AS fb FROM v LEFT JOIN c a ON a.country = ca AND a.token = v.token LEFT JOIN c b ON b.country = cb AND b.token = v.token),
            z AS (SELECT *, (ln((fa + 0.5::DOUBLE) / (greatest(n1 - fa, 0) + 0.5::DOUBLE)) - ln((fb + 0.5::DOUBLE) / (greatest(n2 - fb, 0) + 0.5::DOUBLE))) / sqrt(1.0::DOUBLE / (fa + 0.5::DOUBLE) + 1.0::DOUBLE / (fb + 0.5::DOUBLE)) AS z FROM j WHERE fa + fb >= 20)
            SELECT ca AS country_a, cb AS country_b, token, fa AS freq_a, fb AS freq_b, round(z, 6) AS z_score, CASE WHEN z > 0 THEN ca ELSE cb END AS favored_country FROM z QUALIFY row_number() OVER (PARTITION BY ca, cb ORDER BY abs(round(z, 6)) DESC, token) <= 120""",
        "sentiment_doc": f"{base}, {SENT} SELECT seq, round(score, 6) AS sent_score, label, CAST(pos_hits AS INT) AS pos_hits, CAST(neg_hits AS INT) AS neg_hits, CAST(token_count AS INT) AS token_count FROM sent",
        "sentiment_by_country_year": f"{base}, {SENT} SELECT country, year, count(*) AS doc_count, round(avg(score), 6) AS avg_sent_score, count(*) FILTER (label = 'positive') AS positive_docs, count(*) FILTER (label = 'negative') AS negative_docs, count(*) FILTER (label = 'neutral') AS neutral_docs FROM sent GROUP BY ALL",
        "frame_counts": f"{base}, {FRAMES} SELECT country, year, name AS frame, sum(hits)::BIGINT AS count FROM frames WHERE hits > 0 GROUP BY ALL",
        "persuasion_counts": f"{base}, m AS ({marker_rows(P.persuasion, P.any_persuasion)}) SELECT source, country, year, name AS marker_group, sum(hits)::BIGINT AS count FROM m WHERE hits > 0 GROUP BY ALL",
        "trend_slopes": f"""{base}, {SENT}, g AS (SELECT c.country, y.year FROM (SELECT DISTINCT country FROM docs) c, (SELECT DISTINCT year FROM docs) y), a AS (SELECT country, year, count(*) AS v, avg(score) AS s FROM sent GROUP BY ALL)
            SELECT country, round(coalesce(regr_slope(coalesce(v, 0)::DOUBLE, year::DOUBLE), 0), 6) AS volume_slope_per_year, round(coalesce(regr_slope(coalesce(s, 0), year::DOUBLE), 0), 6) AS sentiment_slope_per_year, min(year) AS from_year, max(year) AS to_year FROM g LEFT JOIN a USING (country, year) GROUP BY country""",
        "source_concentration": concentration("country, year"),
        "source_concentration_total": concentration("country"),
        "source_balance": f"{base}, c AS (SELECT source, country, count(*) AS doc_count FROM docs GROUP BY ALL) SELECT source, country, doc_count, round(doc_count::DOUBLE / sum(doc_count) OVER (PARTITION BY source), 6) AS share_within_source, round(doc_count::DOUBLE / sum(doc_count) OVER (PARTITION BY country), 6) AS share_within_country FROM c",
        "chi2_pairs": significance(),
        "chi2_pairs_p": significance(True),
        "exact_dedup": f"{base} SELECT min(seq) AS seq FROM docs GROUP BY array_to_string(tokens, ' ')",
        "quick_prefilter": "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)threat|worthless|icens')",
        "referent_contexts": f"WITH {contexts()} SELECT * FROM contexts",
        "context_marker_counts": f"{sc} SELECT context_id, N_content, {', '.join(f'CAST({c} AS INT) AS {c}' for c in ('N_ideol', 'N_e_w', 'N_e_m', 'N_e_s', 'N_met'))}, IDI, EMI, MTI FROM scored",
        "context_evi": f"{sc} SELECT context_id, positive_score, negative_score, EVI_raw, EVI_norm FROM scored",
        "context_salience": f"{sc} SELECT context_id, referent_salience, CASE referent_salience WHEN 0.25 THEN 'background' WHEN 0.5 THEN 'secondary_actor' ELSE 'central_actor' END AS referent_role, FALSE AS is_technical_mention FROM scored",
        "context_ip": f"{sc} SELECT context_id, {r6('IP_context::DOUBLE')} AS ip, {r6('IP_context_abs::DOUBLE')} AS ip_abs, {r6('IP_old::DOUBLE')} AS ip_old, aggregation_weight FROM scored",
        "context_coarse_evi": f"WITH {contexts()}, s AS (SELECT context_id, {total_of('context_text', {t for x in P.rubric.values() for t in x[0]})} - {total_of('context_text', {t for x in P.rubric.values() for t in x[1]})} AS s FROM contexts) SELECT context_id, CAST(CASE WHEN s <= -3 THEN -10 WHEN s < 0 THEN -5 WHEN s = 0 THEN 0 WHEN s < 3 THEN 5 ELSE 10 END AS INT) AS EVI_raw FROM s",
        "multi_ref_contexts": f"WITH {contexts()}, m AS (SELECT doc_id, context_text, count(DISTINCT ref_country) AS n FROM contexts GROUP BY ALL) SELECT context_id, n > 1 AS multi_country_context FROM contexts JOIN m USING (doc_id, context_text)",
        "impact_by_media_ref": f"{sc} {weighted('media_country, ref_country')}",
        "impact_by_outlet": f"{sc} {weighted('media_country, outlet_name, ref_country')}",
        "impact_by_article": f"{sc} {weighted('doc_id, media_country, outlet_name, ref_country')}",
        "dominant_evi": f"{sc}, c AS (SELECT media_country, ref_country, EVI_raw AS v, count(*) AS n FROM scored GROUP BY ALL), m AS (SELECT *, sum(n * v) OVER w / sum(n) OVER w AS mean FROM c WINDOW w AS (PARTITION BY media_country, ref_country)) SELECT media_country, ref_country, v AS dominant_EVI FROM m QUALIFY row_number() OVER (PARTITION BY media_country, ref_country ORDER BY n DESC, abs(v - mean), abs(v) DESC, v) = 1",
        "reference_summary": f"{sc} SELECT ref_country, round(sum(N_ideol)::DOUBLE / greatest(sum(N_content), 1), 6) AS IDI, round((sum(N_e_w) / 3.0::DOUBLE + 2.0::DOUBLE * sum(N_e_m) / 3.0::DOUBLE + sum(N_e_s)) / greatest(sum(N_content), 1), 6) AS EMI, round(sum(N_met)::DOUBLE / greatest(sum(N_content), 1), 6) AS MTI, round(avg(EVI_raw), 6) AS EVI, count(*) AS contexts FROM scored GROUP BY ref_country",
        "percentile_ranks": f"{sc}, r AS (SELECT context_id, {', '.join(f'round({rank_of(m)}, 6) AS r{m}' for m in METRICS)} FROM scored) SELECT context_id, {', '.join(f'round(r{m}, 4) AS {m}_percentile, {LEVEL.format('r' + m)} AS {m}_level' for m in METRICS)} FROM r",
        "percentile_ranks_by_referent": f"{sc} SELECT context_id, {', '.join(f'round({rank_of(m, "ref_country")}, 4) AS {m}_percentile' for m in METRICS)} FROM scored",
        "baseline_percentiles": f"{sc}, b AS (SELECT * FROM scored WHERE media_country = 'Malaysia'), {', '.join(f'd{m} AS (SELECT x.v, round(100 * (SELECT count(*) FROM b WHERE b.{m} <= x.v)::DOUBLE / greatest((SELECT count(*) FROM b), 1), 4) AS p FROM (SELECT DISTINCT {m} AS v FROM scored) x)' for m in METRICS)} SELECT context_id, {', '.join(f'd{m}.p AS {m}_baseline_percentile' for m in METRICS)} FROM scored s {' '.join(f'JOIN d{m} ON d{m}.v = s.{m}' for m in METRICS)}",
        "anchor_status": f"{sc}, p AS (SELECT context_id, round(100 * cume_dist() OVER (ORDER BY IP_context_abs), 6) AS p FROM scored) SELECT context_id, CASE WHEN p >= 95 THEN 'extreme_anchor' WHEN p >= 85 THEN 'upper_anchor' WHEN p BETWEEN 45 AND 55 THEN 'middle_anchor' WHEN p <= 15 THEN 'lower_anchor' ELSE 'none' END AS anchor_status FROM p",
        "metric_distributions": f"""{sc}, l AS ({' UNION ALL '.join(f"SELECT media_country, ref_country, '{m}' AS metric, {m}::DOUBLE AS value FROM scored" for m in METRICS)}),
            g AS (SELECT 'all' AS scope, 'all' AS grp, metric, value FROM l UNION ALL SELECT 'referent', ref_country, metric, value FROM l UNION ALL SELECT 'media_referent', media_country || '|' || ref_country, metric, value FROM l)
            SELECT scope, grp AS "group", metric, count(*) AS count, min(value) AS min, max(value) AS max, {MEAN6} AS mean, {half_up('stddev_pop(value)')} AS std, {', '.join(f"{half_up(f'quantile_cont(value, {q})')} AS {n}" for n, q in (('p10', .1), ('p25', .25), ('p50', .5), ('p75', .75), ('p90', .9), ('p95', .95), ('p97', .97), ('p99', .99)))} FROM g GROUP BY ALL""",
        "outliers": f"""{sc}, {', '.join(f"o{m} AS (SELECT context_id, '{m}' AS metric FROM scored, (SELECT quantile_cont({m}, 0.99) AS hi, quantile_cont({m}, 0.5) AS mid FROM scored) WHERE {m} > hi AND (mid <= 0 OR {m} > 3 * mid))" for m in METRICS)} {' UNION ALL '.join(f'SELECT * FROM o{m}' for m in METRICS)}""",
        "candidate_terms": f"""WITH {contexts()}, w AS (SELECT lower(trim(x, '.,;:!?()[]{{}}"''')) AS t FROM (SELECT unnest(regexp_split_to_array(context_text, '\\s+')) AS x FROM contexts)), c AS (SELECT t, count(*) AS f FROM w WHERE length(t) >= 4 GROUP BY t HAVING count(*) >= 3)
            SELECT t AS candidate_term, f AS frequency, CASE WHEN regexp_matches(t, 'threat|sovereign|hegem|democr|regime|law|order') THEN 'ideological_markers' WHEN regexp_matches(t, 'fear|anger|outrage|concern|support|crisis') THEN 'emotional_markers' WHEN regexp_matches(t, 'engine|front|wave|path|bridge|chess|battle') THEN 'metaphor_markers' ELSE 'evi_lexicon' END AS proposed_dictionary,
            round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, f / 50.0::DOUBLE) + CASE WHEN regexp_matches(t, 'threat|aggress|cooper|sovereign|hegem|stability|crisis') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN length(t) > 20 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)), 4) AS confidence_score FROM c""",
        "page_link_filter": """SELECT page_id, array_to_string(list_filter(l, lambda u, i: regexp_matches(u, '^https?://') AND list_position(l, u) = i), ' ') AS links FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?i)href\\s*=\\s*["'']([^"'']+)["'']', 1) AS l FROM pages)""",
        "html_paragraph_text": r"""WITH c AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g') AS h FROM pages), p AS (SELECT page_id, h, regexp_extract_all(h, '(?is)<p[^>]*>(.*?)</p>', 1) AS ps FROM c)
            SELECT page_id, CAST(length(trim(regexp_replace(CASE WHEN len(ps) > 0 THEN array_to_string(ps, ' ') ELSE regexp_replace(h, '(?s)<[^>]+>', ' ', 'g') END, '\s+', ' ', 'g'))) AS INT) AS n_chars FROM p""",
        "country_theme_scores": more_oracles.COUNTRY_THEME,
        "capped_sample": f"{base} SELECT seq, source, country, year FROM docs QUALIFY row_number() OVER (PARTITION BY source, country, year ORDER BY seq) <= 3",
    }
    sql |= more_oracles.all_sql(docs, scored(), weighted, RAW, f"len(list_filter({RAW}, lambda t: NOT list_contains({CORE}, t) AND length(t) >= 2))")
    sql |= {"lexicon_validation": more_oracles.validation(sql["candidate_terms"]), "reader_matrix": reader_matrix()}
    return sql | calibration_queries.all_sql(scored(), sents("coalesce(text, '')"), sql["candidate_terms"], sql["text_rollup"], sql["quality_flags"])
