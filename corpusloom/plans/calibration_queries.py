"""Queries on the test tables as a calibration corpus: numbers, decisions, records, articles and the report, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import articles, calibration, calibration_report, dictionaries, interpret, ledger, lexicon, numbering, percentile, sequences
from corpusloom.operators.dedup import written
from corpusloom.plans import tables
from corpusloom.plans.tables import PROFILE

#: Sites of the test pages: the second finds no headline of its own, the third's text is a list.
SITES = [
    ("Com", "North", "example.com", ["div.title h1", "article h1"], ["div.article-body", "article"], ["time", "span.date"], None),
    ("Net", "South", "example.net", ["h2"], ["body article"], ["meta[property='og:none']"], None),
    ("Org", "East", "example.org", ["title"], ["nav li ul, nav ul"], ["time"], "props.pageProps.data"),
]


def kind(quality: Column) -> Column:
    return F.when(quality == 1, "neutral_news").when(quality == 0, "crisis_report").otherwise("analytical_article")


def calibration_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as calibration texts; the quality label stands for a type."""
    docs = tables.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    words = F.size(T.tokenize(F.coalesce("text", F.lit(""))))
    found = F.when(F.col("text").rlike(T.any_pattern([k for ks in PROFILE.referents.values() for k in ks])), "found").otherwise("")
    rows = docs.join(labels, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("calibration_id"), "text", words.alias("text_length_words"), F.lit("ok").alias("fetch_status"), kind(F.col("quality")).alias("calibration_type"), found.alias("ref_country"), F.col("lang").alias("language"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents and their labels say of a text; a document with several labels has several rows."""
    rows = tables.documents(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    focus = F.when(F.col("toxic") == 1, "EMI").when(F.col("toxic") == 0, "IDI").otherwise("mixed")
    return rows.select(
        (F.coalesce("quality", F.lit(2)) * 3 + F.coalesce("toxic", F.lit(2))).alias("seq"),
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.lit("cal_"), F.col("doc_id").cast("string")).alias("calibration_id"),
        F.col("source").alias("source_name"),
        F.lit("a title").alias("title"),
        kind(F.col("quality")).alias("calibration_type"),
        focus.alias("expected_indicator_focus"),
        F.col("lang").alias("language"),
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("notes"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.calibration_contexts(tables.scored(spark, sf_dir), metadata(spark, sf_dir))


def flags(spark: SparkSession, sf_dir: str, ratio: float | None = None) -> DataFrame:
    return calibration.quality_flags(calibration_texts(spark, sf_dir), calibration.context_records(tables.scored(spark, sf_dir)), ratio=ratio)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.extract_candidates(tables.referent_contexts(spark, sf_dir))


def decision_log(found: DataFrame) -> DataFrame:
    """Three decisions on each candidate, at times and with outcomes that follow from its length and frequency."""
    k = F.explode(F.array(*[F.lit(i) for i in range(3)]))
    rows = found.select("candidate_term", F.col("proposed_dictionary").alias("dictionary"), "frequency", k.alias("k"))
    day = 1 + (F.length("candidate_term") + 5 * F.col("k")) % 7
    action = F.element_at(F.array(F.lit("approve"), F.lit("reject"), F.lit("postpone")), ((F.col("frequency") + F.col("k")) % 3 + 1).cast("int"))
    made = rows.select(F.format_string("2025-01-%02dT00:00:00+00:00", day).alias("timestamp"), "candidate_term", "dictionary", action.alias("user_action"), F.lit(None).cast("string").alias("reason"), F.format_string("note %d", "k").alias("note"))
    return ledger.entries(found, made)


def decision_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = candidates(spark, sf_dir)
    log = decision_log(found)
    counts = ledger.compacted(log).select(F.col("term").alias("candidate_term"), F.col("timestamp").alias("decided"), "decisions")
    return ledger.replayed(found, log).join(counts, "candidate_term", "left").select("candidate_term", "proposed_dictionary", "status", "note", "decided", F.coalesce("decisions", F.lit(0).cast("long")).alias("decisions"))


def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), "source", "lang")
    return numbering.with_ids(rows, [F.asc_nulls_first("source"), F.col("seq").desc()])


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return articles.articles(pages, articles.sites(spark, SITES)).select("page_id", "source", "region", "title", "date", "year", "content")


def text_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = calibration_texts(spark, sf_dir).select("calibration_id", "ref_country", F.lit("none").alias("anchor_status"), F.lit("").alias("quality_flags"))
    rollup = calibration.text_rollup(percentile.anchor_status(tables.scored(spark, sf_dir)))
    return calibration.summarised(texts, rollup, flags(spark, sf_dir))


#: Terms whose sentences are shown.
SHOWN = ["threat", "public", "general public", "license", "work", "the"]


def shown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.documents(spark, sf_dir).select("doc_id", F.posexplode(interpret.context_blocks(F.col("text"), SHOWN)).alias("place", "b"))
    return rows.select("doc_id", "place", "b.*")


def dictionary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of sources, then candidate terms, then first words of the benchmark, in lists of dictionaries."""
    evaluation = F.lit("evi_lexicon").alias("list")
    sources = tables.documents(spark, sf_dir).select(evaluation, F.col("source").alias("term"), F.col("doc_id").alias("place"))
    found = candidates(spark, sf_dir).select(F.col("proposed_dictionary").alias("list"), F.col("candidate_term").alias("term"), F.col("frequency").alias("place"))
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(evaluation, F.get(F.split("text", " "), F.lit(0)).alias("term"), F.col("item_id").alias("place"))
    return dictionaries.united([sources, found, words])


def report_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of the report, near duplicates by both rules; the order of contexts is that of their documents, flags have none."""
    # contexts are scored once, and only the columns that facts come from are kept
    of = written(tables.scored(spark, sf_dir).select("context_id", "doc_id", "ref_country", "context_text", "IDI", "EMI", "MTI", "referent_salience", "referent_role", "IP_context", "IP_context_abs"))
    texts = calibration_texts(spark, sf_dir).drop("ref_country").join(calibration.text_rollup(percentile.anchor_status(of)).select(F.col("doc_id").alias("calibration_id"), "anchor_status"), "calibration_id", "left")
    rows = calibration.calibration_contexts(of, metadata(spark, sf_dir)).withColumn("seq", F.substring("calibration_id", 5, 20).cast("long"))
    spread = percentile.distributions(rows, list(calibration_report.METRICS), {calibration_report.WHOLE: [], calibration_report.BY_TYPE: ["calibration_type"]})
    told = calibration.quality_flags(calibration_texts(spark, sf_dir), calibration.context_records(of))
    return calibration_report.facts(texts, rows, spread, lexicon.extract_candidates(of), told.withColumn("seq", F.lit(0)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "quality_flags": flags,
        "calibration_near_duplicates": lambda s, d: calibration.similar_sets(calibration_texts(s, d)).select("seq"),
        "calibration_sequence_duplicates": lambda s, d: sequences.near_earlier(calibration_texts(s, d)).select("seq"),
        "calibration_contexts": records,
        "dense_ids": dense_ids,
        "decision_ledger": decision_ledger,
        "page_articles": page_articles,
        "calibration_report_facts": report_facts,
        "context_blocks": shown_blocks,
        "calibration_text_summaries": text_summaries,
        "dictionary_union": dictionary_union,
    }


#: Words of the test profile's referents.
REFERENT = r"(?i)\b(?:worthless|stupid|license|licensed|with)\b"

RECORDS = """, f AS (SELECT doc_id, min({'k': coalesce(quality, 2) * 3 + coalesce(toxic, 2), 'quality': quality, 'toxic': toxic}) AS x FROM labels GROUP BY doc_id),
    records AS (SELECT s.*, 'cal_' || s.doc_id AS calibration_id, d.source AS source_name, CASE WHEN x.quality = 1 THEN 'neutral_news' WHEN x.quality = 0 THEN 'crisis_report' ELSE 'analytical_article' END AS calibration_type,
        CASE WHEN x.toxic = 1 THEN 'EMI' WHEN x.toxic = 0 THEN 'IDI' ELSE 'mixed' END AS expected_indicator_focus, lang AS language, d.doc_id AS seq FROM scored s JOIN documents d ON CAST(d.doc_id AS VARCHAR) = s.doc_id LEFT JOIN f ON f.doc_id = d.doc_id)"""

DECISIONS = """, g AS (SELECT candidate_term, proposed_dictionary, unnest(range(3)) AS k, frequency FROM c),
    m AS (SELECT candidate_term, printf('2025-01-%02dT00:00:00+00:00', CAST(1 + (length(candidate_term) + 5 * k) % 7 AS INT)) AS decided, ['approved', 'rejected', NULL][CAST((frequency + k) % 3 + 1 AS INT)] AS status, printf('note %d', k) AS note FROM g),
    l AS (SELECT candidate_term, arg_max(status, decided) AS status, arg_max(note, decided) AS note, max(decided) AS decided, count(*) AS decisions FROM m WHERE status IS NOT NULL GROUP BY candidate_term)
    SELECT c.candidate_term, c.proposed_dictionary, coalesce(l.status, 'new') AS status, coalesce(l.note, '') AS note, l.decided, coalesce(l.decisions, 0) AS decisions FROM c LEFT JOIN l USING (candidate_term)"""

#: Entities of the test pages.
ENTITIES = {"&middot;": "·", "&copy;": "©", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&#39;": "''", "&amp;": "&"}


def plain(html: str) -> str:
    """Pieces of text between tags, a line each."""
    piece = "t"
    for entity, sign in ENTITIES.items():
        piece = f"replace({piece}, '{entity}', '{sign}')"
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({html}, '<[^>]*>'), lambda t: regexp_replace({piece}, '^\\s+|\\s+$', '', 'g')), lambda t: t <> ''), chr(10))"


ARTICLES = f"""WITH h AS (SELECT page_id, url, coalesce(html, '') AS html, regexp_extract(lower(url), '^https?://[^/?#:]*\\bexample\\.(com|net|org)', 1) AS site FROM pages),
    x AS (SELECT page_id, url, site, {plain("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS head, {plain("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, {plain("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")} AS body, {plain("regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)")} AS nav FROM h),
    a AS (SELECT page_id, url, CASE site WHEN 'com' THEN 'Com' WHEN 'org' THEN 'Org' END AS source, CASE site WHEN 'com' THEN 'North' WHEN 'org' THEN 'East' END AS region, CASE site WHEN 'com' THEN head WHEN 'org' THEN title ELSE '' END AS title, CASE site WHEN 'com' THEN body ELSE nav END AS content FROM x WHERE site <> '')
    SELECT page_id, source, region, title, 'no_date' AS date, TRY_CAST(nullif(regexp_extract(url, '/((?:19|20)[0-9]{{2}})/[0-9]{{2}}/[0-9]{{2}}/', 1), '') AS INT) AS year, content FROM a WHERE title <> '' AND content <> ''"""


BLOCKS = """, e AS (SELECT doc_id, sents, unnest(range(len(sents))) AS i, unnest(sents) AS s FROM split),
    h AS (SELECT *, list_filter(['general public', 'license', 'public', 'the', 'threat', 'work'], lambda k: regexp_matches(s, '(?i)\\b' || k || '\\b')) AS found FROM e)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS place, s AS hit_sentence, concat_ws(' ', CASE WHEN i > 0 THEN sents[i] END, s, sents[i + 2]) AS expanded_context, array_to_string(found, ', ') AS markers
    FROM h WHERE len(found) > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 15"""

UNION = """, r AS (SELECT 'evi_lexicon' AS list, trim(source) AS term, 0 AS part, doc_id AS place FROM documents UNION ALL SELECT proposed_dictionary, candidate_term, 1, frequency FROM c UNION ALL SELECT 'evi_lexicon', string_split(text, ' ')[1], 2, item_id FROM benchmark),
    f AS (SELECT list, min({'part': part, 'place': place, 'term': term}) AS x FROM r WHERE term <> '' GROUP BY list, lower(term))
    SELECT list, x.term AS term, row_number() OVER (PARTITION BY list ORDER BY x.part, x.place, x.term) AS n FROM f"""


def facts_sql(rollup: str, candidate: str, flag: str, mean: Callable[[str], str]) -> str:
    """rollup, candidate and flag: queries; mean: how quantiles are rounded."""
    nulls = "NULL::DOUBLE AS value, NULL::DOUBLE AS p75, NULL::DOUBLE AS p90, NULL::DOUBLE AS p95"
    quantiles = lambda m, group: f"count({m}) AS n, 0 AS place, {', '.join(f'{mean(f'quantile_cont({m}::DOUBLE, {q})')} AS {n}' for n, q in (('value', 0.5), ('p75', 0.75), ('p90', 0.9), ('p95', 0.95)))} FROM r {group}"
    metrics = {"IDI_raw": "IDI", "EMI_raw": "EMI", "MTI_raw": "MTI", "IP_abs_context": "IP_context_abs"}
    return f""", r AS MATERIALIZED (SELECT * FROM records), u AS MATERIALIZED ({rollup}), w AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
    y AS MATERIALIZED (SELECT d.doc_id AS seq, CAST(d.doc_id AS VARCHAR) AS id, CASE WHEN quality = 1 THEN 'neutral_news' WHEN quality = 0 THEN 'crisis_report' ELSE 'analytical_article' END AS kind, lang, coalesce(anchor_status, '') AS status FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = CAST(d.doc_id AS VARCHAR)),
    q AS MATERIALIZED ({flag})
    SELECT 1 AS section, 'texts' AS name, count(*) AS n, min(seq) AS place, {nulls} FROM y
    UNION ALL SELECT 2, kind, count(*), min(seq), {nulls} FROM y GROUP BY kind
    UNION ALL SELECT 3, coalesce(lang, 'nan'), count(*), min(seq), {nulls} FROM y GROUP BY lang
    UNION ALL SELECT 1, 'contexts', count(*), min(seq), {nulls} FROM r
    UNION ALL SELECT 4, ref_country, count(*), min(seq), {nulls} FROM r GROUP BY ref_country
    UNION ALL SELECT 7, id || ' | ' || kind || ' | ' || status, 1, seq, {nulls} FROM (SELECT * FROM y WHERE status IN ('upper_anchor', 'extreme_anchor') ORDER BY seq LIMIT 10)
    UNION ALL SELECT 8, 'candidates', count(*), 0, {nulls} FROM ({candidate})
    UNION ALL SELECT 9, '', count(*), 0, {nulls} FROM q
    UNION ALL SELECT 9, issue_type, count(*), 0, {nulls} FROM q GROUP BY issue_type
    {' '.join(f"UNION ALL SELECT 5, '{name}', {quantiles(m, '')}" for name, m in metrics.items())}
    UNION ALL SELECT 10, calibration_type, {quantiles("EMI", "WHERE calibration_type IN ('neutral_news', 'crisis_report') GROUP BY calibration_type")}"""


def part_of_facts_sql(scored: str, candidate: str, rollup: str, flag: str, mean: Callable[[str], str]) -> str:
    """The facts of calibration_report_facts with near duplicates by their sets of words alone: no SQL of the query, but of its facts that do not tell of near duplicates."""
    return f"WITH {scored}{RECORDS}{facts_sql(rollup, candidate, flag, mean)}"


def all_sql(scored: str, sentences: str, candidate: str, rollup: str, flag: str) -> dict[str, str]:
    """SQL of the queries but calibration_report_facts and calibration_sequence_duplicates, whose matching blocks SQL cannot express.

    scored: common table expressions; sentences: SQL for the sentences of a text; candidate: the query candidate_terms behind them; rollup, flag: queries within scored.
    """
    sc = f"WITH {scored}"
    return {
        "calibration_contexts": f"""{sc}{RECORDS} SELECT context_id, calibration_id, source_name, '' AS title, calibration_type, expected_indicator_focus, ref_country, matched_keywords, context_text, previous_sentence, target_sentence, next_sentence, N_content,
            IDI AS IDI_raw, IDI * 100.0::DOUBLE AS IDI_percent, EMI AS EMI_raw, EMI * 100.0::DOUBLE AS EMI_percent, MTI AS MTI_raw, MTI * 100.0::DOUBLE AS MTI_percent, EVI_raw, EVI_norm, referent_salience AS S_r,
            CASE referent_salience WHEN 0.25 THEN 'background' WHEN 0.5 THEN 'secondary_actor' ELSE 'central_actor' END AS salience_label, IP_context::DOUBLE AS IP_context, IP_context_abs::DOUBLE AS IP_abs_context, '' AS quality_flags, language, '' AS notes FROM records""",
        "dense_ids": "SELECT doc_id AS seq, source, lang, printf('doc_%06d', CAST(row_number() OVER (ORDER BY source ASC NULLS FIRST, doc_id DESC) AS INT)) AS doc_id FROM documents",
        "decision_ledger": f"WITH c0 AS ({candidate}), c AS (SELECT * FROM c0){DECISIONS}",
        "page_articles": ARTICLES,
        "context_blocks": f"WITH split AS (SELECT doc_id, {sentences} AS sents FROM documents){BLOCKS}",
        "dictionary_union": f"WITH c AS ({candidate}){UNION}",
        "calibration_text_summaries": f"""{sc}, u AS MATERIALIZED ({rollup}), q AS MATERIALIZED ({flag}), g AS (SELECT calibration_id, array_to_string(list_sort(list(DISTINCT issue_type)), ';') AS flags FROM q WHERE calibration_id <> 'GLOBAL' GROUP BY calibration_id),
            y AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN regexp_matches(coalesce(text, ''), '{REFERENT}') THEN 'found' ELSE '' END AS own FROM documents)
            SELECT id AS calibration_id, coalesce(nullif(ref_country, ''), own) AS ref_country, coalesce(nullif(anchor_status, ''), 'none') AS anchor_status, coalesce(flags, '') AS quality_flags FROM y LEFT JOIN u ON u.doc_id = id LEFT JOIN g ON g.calibration_id = id""",
    }
