"""Words for measures, filters of a reader, and checks that need no tables."""

import random

import duckdb
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import dedup, interpret, percentile, scoring
from corpusloom.plans import tables

SF = "/root/testdata/sf0.001"


def test_evaluation_in_words(spark):
    df = spark.createDataFrame([(v,) for v in (-10.0, -9.0, -0.5, 0.0, 0.5, 5.0, 9.0, 10.0)], "v double")
    got = [r.w for r in df.select(interpret.evi_words(F.col("v")).alias("w")).collect()]
    assert got == [interpret.EVI_WORDS[i][1] for i in (0, 1, 4, 5, 6, 7, 9, 10)]
    ip = spark.createDataFrame([(0.01, 0.01), (0.01, 0.5), (0.3, 0.3), (-0.3, 0.3)], "a double, b double")
    assert [r.w for r in ip.select(interpret.ip_words(F.col("a"), F.col("b")).alias("w")).collect()] == [interpret.IP_NEUTRAL, interpret.IP_POLARISED, interpret.IP_POSITIVE, interpret.IP_NEGATIVE]


def test_indicator_sentences(spark):
    df = spark.createDataFrame([(0.12345, 72.5, "high", "neutral_news")], "v double, p double, l string, k string")
    say = lambda **k: df.select(interpret.indicator_words("IDI", F.col("v"), F.col("p"), F.col("l"), **k).alias("s")).first().s
    assert say() == "IDI = 0.1234 corresponds to the 72th percentile of the calibration corpus. This indicates high level relative to the empirical baseline." or say().startswith("IDI = 0.1235")
    assert say(kind=F.col("k")).endswith("(baseline type: neutral_news).")
    assert "высокий уровень" in say(language="ru")


def test_categories_and_mini_referents(spark):
    rows = [("China", ["Xi Jinping", "yuan"], "Xi visits"), ("USA", ["table"], "Hollywood film"), ("Other", ["x"], "")]
    df = spark.createDataFrame(rows, "ref_country string, keywords array<string>, context_text string").withColumn("matched_keywords", F.array_join("keywords", "; "))
    told = df.withColumn("keyword_category", interpret.keyword_category(F.col("ref_country"), F.col("keywords")))
    assert [r.keyword_category for r in told.collect()] == ["Leadership; Economy", "other", "other"]
    assert interpret.of_category(told, "Economy").count() == 1
    assert interpret.of_category(told, "all").count() == 3
    terms = interpret.mini_terms("Xi, xi;YUAN\n hollywood ,")
    assert terms == ["Xi", "YUAN", "hollywood"]
    assert sorted((r.ref_country, r.mini_referent) for r in interpret.mini_referents(df, terms).collect()) == [("China", "Xi"), ("China", "YUAN"), ("USA", "hollywood")]


def test_baselines_and_warnings(spark):
    base = spark.createDataFrame([("neutral_news", "A"), ("crisis_report", "B")], "calibration_type string, ref_country string")
    scored = spark.createDataFrame([("A", 5, 1.0)], "ref_country string, EVI_raw int, EVI_norm double")
    assert interpret.baseline_filter(base, scored, "neutral_news_only").count() == 1
    assert interpret.baseline_filter(base, scored, "political_news_only").count() == 2
    assert interpret.baseline_filter(base, scored, "same_ref_country_only").first().ref_country == "A"
    assert interpret.baseline_filter(base, scored, "full_calibration_corpus").count() == 2
    assert interpret.migration_warning(scored).first().migration_warning == interpret.MIGRATED
    assert interpret.migration_warning(scored.withColumn("EVI_norm", F.lit(0.5))).first().migration_warning == ""
    silent = spark.createDataFrame([(0.0,), (0.0,)], "aggregation_weight double")
    assert interpret.silent_corpus(silent).count() == 1
    assert interpret.silent_corpus(silent.withColumn("aggregation_weight", F.lit(0.5))).count() == 0
    assert interpret.silent_corpus(silent.where("false")).count() == 0


def test_legacy_formula(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.0, -0.5), (0.1, 0.2, 0.0, 0.0)], "IDI double, EMI double, MTI double, EVI_norm double")
    assert [round(r.IP_context, 9) for r in interpret.with_formula(df, "legacy").collect()] == [-0.15, 0.0]
    assert [round(r.IP_context, 9) for r in interpret.with_formula(df, "updated").collect()] == [-0.65, 0.0]


def test_yes_and_verified(spark):
    df = spark.createDataFrame([("1",), (" Yes ",), ("t",), ("verified",), (None,), ("no",)], "v string")
    assert [tuple(r) for r in df.select(T.truthy(F.col("v")), T.is_verified(F.col("v"))).collect()] == [(True, True), (True, True), (False, False), (False, True), (False, False), (False, False)]


def test_spans_keep_to_whole_words(spark):
    text = "He went toward the sea and further on for many miles until the war. began; nobody knew why it had"
    df = spark.createDataFrame([(text, "war"), (text, "absent"), ("War!", "war"), ("a u.s. b", "u.s")], "t string, m string")
    got = [r.s for r in df.select(T.first_span(F.col("t"), F.col("m")).alias("s")).collect()]
    at = text.index("war.")
    assert got == [text[at - 25 : at + 3 + 25], "", "War!", "a u.s. b"]


def test_the_last_of_a_repeated_term_counts(spark):
    meta = spark.createDataFrame([(1, "War", "old"), (2, " war ", "new"), (3, "", "none")], "row int, term string, note string")
    assert [tuple(r) for r in scoring.last_of_each(meta).collect()] == [("war", "new")]


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g in "abc" for v in rng.choice([0.0, 0.1, 0.5, 0.7, 1.25], 37 if g == "a" else 400)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.x_p50, r.x_p97) for r in percentile.group_quantiles(df, ["x"], "g", {"p50": 0.5, "p97": 0.97}).collect()}
    for g in "abc":
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g], [0.5, 0.97]))


def simhash(tokens):
    import hashlib

    hashes = [int(hashlib.md5(t.encode()).hexdigest()[:16], 16) for t in tokens]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) >= len(hashes))


def test_near_dedup_against_all_pairs(spark):
    rows = [(r.seq, list(r.tokens)) for r in tables.corpus_docs(spark, SF).select("seq", "tokens").collect()]
    rows += [(10_000 + i, [*rows[i][1], "added"]) for i in range(0, 40, 2)] + [(20_000, list(rows[3][1]))]
    df = spark.createDataFrame(rows, "seq long, tokens array<string>")
    kept, seen = [], set()
    for seq, tokens in sorted(rows):
        if (key := " ".join(tokens)) in seen:
            continue
        seen.add(key)
        h, mine = simhash(tokens), set(tokens)
        near = lambda o: (h ^ o[1]).bit_count() <= 3 and min(len(tokens), o[2]) / max(len(tokens), o[2]) >= 0.85 and len(mine & o[3]) / len(mine | o[3]) >= 0.92  # noqa: B023, E731
        if not any(near(o) for o in kept):
            kept.append((seq, h, len(tokens), mine))
    assert sorted(r.seq for r in dedup.deduplicate(df).select("seq").collect()) == [k[0] for k in kept]


def test_quantiles_between_equal_values_are_the_value(spark):
    """In doubles (1 - d) v + d v may be below v: rows that are the 99th percentile were above it then."""
    for n, k in [(62, 11), (64, 11), (120, 11), (138, 11)]:
        rows = spark.createDataFrame([(i, k / 97 if i < 5 else 0.0) for i in range(n)], "context_id int, IDI double")
        assert percentile.outliers(rows, ["IDI"]).count() == 0


def test_quantiles_as_duckdb_has_them(spark):
    rnd = random.Random(3)
    values = {f"m{k}": [rnd.randint(0, 5) / rnd.randint(7, 90) for _ in range(rnd.randint(2, 60))] for k in range(60)}
    shares = {"p10": 0.1, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    counts = spark.createDataFrame([(m, v, 1) for m, vs in values.items() for v in vs], "metric string, v double, w long")
    con = duckdb.connect()
    for r in percentile.quantiles(counts, shares).collect():
        theirs = con.execute(f"SELECT {', '.join(f'quantile_cont(v, {q})' for q in shares.values())} FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values[r.metric]]).fetchone()
        assert tuple(r[1:]) == theirs


def test_numbers_in_traces_are_written_as_in_sql(spark):
    con = duckdb.connect()
    numbers = [0.0, 0.25, 0.001, 0.000999, 0.0001, 9.9e-05, 1e-05, 1.4e-05, -0.000123, 9999999.0, 12345678.5, 123456789012.25, 1e16, 2.5e17, -2.0]
    ours = [r[0] for r in spark.createDataFrame([(x,) for x in numbers], "x double").select(T.number_text(F.col("x"))).collect()]
    assert ours == [con.execute("SELECT '' || ?::DOUBLE", [x]).fetchone()[0] for x in numbers] == [repr(x) for x in numbers]
    row = {"context_id": "c", "N_content": 1001, "N_ideol": 1, "N_e_w": 0, "N_e_m": 0, "N_e_s": 0, "N_met": 0, "IDI": 1 / 1001, "EMI": 0.0, "MTI": 0.0, "positive_score": 1, "negative_score": 0, "EVI_raw": 1, "EVI_norm": 0.1, "referent_salience": 0.5, "discursive_energy": 1 / 1001, "IP_context": 0.1001}
    told = {r.formula_name: r.substitution for r in scoring.formula_traces(spark.createDataFrame([row])).collect()}
    assert told == {"IDI": "IDI = 1 / 1001", "EMI": "EMI = 0.0 / 1001", "MTI": "MTI = 0 / 1001", "EVI": "EVI = 1 - 0 = 1", "S_r": "S_r = 0.5", "IP": "IP = 0.1 * (1 + 0.000999)"}


def test_tokens_of_documents_without_a_key_stay_where_they_are(spark, monkeypatch):
    """All token arrays went through a shuffle before, which took nine times the input of disk."""
    monkeypatch.setattr(dedup, "checkpointed", lambda df: df)
    docs = spark.createDataFrame([(i, ["a", "b", "a", f"w{i}"]) for i in range(8)], "seq int, tokens array<string>").repartition(4)
    keys = spark.createDataFrame([(2,), (2,), (5,)], "seq int")
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = dedup.token_sets(docs, keys)
        assert {r.seq: r.t.split(dedup.PART) for r in found.collect()} == {2: ["a", "b", "w2"], 5: ["a", "b", "w5"]}
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(dedup, "FEW_SEQS", 1)
        assert {r.seq for r in dedup.token_sets(docs, keys).collect()} == {2, 5}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
