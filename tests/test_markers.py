"""Behaviour of the marker system on single sentences."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.profile import default
from corpusloom.operators import aggregate, contexts, lexicon, scoring

FIELDS = "doc_id string, media_country string, outlet_name string, date string, title string, text string"


def scored(spark, text, referent, title=""):
    docs = spark.createDataFrame([("1", "Malaysia", "x", "", title, text)], FIELDS)
    return scoring.checked(scoring.multi_country(scoring.score(contexts.extract(docs, default()), default()))).where(F.col("ref_country") == referent)


def indicators(spark, rows):
    return {r.indicator for r in scoring.traces(rows, default()).collect()}


def test_ideology(spark):
    rows = scored(spark, "China defends national sovereignty against foreign interference.", "China")
    assert rows.first().N_ideol >= 1
    assert "IDI" in indicators(spark, rows)


def test_emotion(spark):
    rows = scored(spark, "The US pressure raised serious concern.", "USA")
    r = rows.first()
    assert r.N_e_w + r.N_e_m + r.N_e_s >= 1


def test_evaluation_range(spark):
    r = scored(spark, "China is a reliable partner that supports development and stability.", "China").first()
    assert -10 <= r.EVI_raw <= 10
    assert r.EVI_norm == pytest.approx(r.EVI_raw / 10)
    assert r.EVI_raw > 0
    assert r.IP_context == pytest.approx(r.EVI_norm * (1 + r.IDI + r.EMI + r.MTI))


def test_technical_mention(spark):
    rows = scored(spark, "Reporting by John Smith in Washington.", "USA")
    r = rows.first()
    assert r.referent_salience == 0.0
    assert r.is_technical_mention
    assert "S_r" in indicators(spark, rows)
    assert aggregate.by_media_and_referent(rows).first().warning == aggregate.NO_CONTEXT


def test_content_words(spark):
    df = spark.createDataFrame([("The state strongly supports regional development in Asia.",)], "t string")
    assert df.select(T.n_content(F.col("t"))).first()[0] == 6


def test_windows(spark):
    text = "Russia a. Bbb ccc. Russia d. Eee f. Ggg h. Russia i. Jjj k."
    rows = contexts.extract(spark.createDataFrame([("7", "m", "o", "", "", text)], FIELDS), default()).orderBy("context_id").collect()
    assert [r.context_id for r in rows] == ["7__Russia__001", "7__Russia__002"]
    assert rows[0].context_text == "Russia a. Bbb ccc. Russia d. Eee f."
    assert rows[0].target_sentence == "Russia a. Russia d."
    assert rows[0].next_sentence == "Ggg h."
    assert rows[1].previous_sentence == "Eee f."


def test_nested_terms_and_cyrillic(spark):
    df = spark.createDataFrame([("РОССИЯ и Россия; kerja sama kerja sama",)], "t string")
    hits = df.select(T.term_hits(F.col("t"), ["россия", "kerja", "kerja sama"]).alias("h")).first().h
    assert {h.term: h.n for h in hits} == {"россия": 2, "kerja": 2, "kerja sama": 2}


def test_missing_field_raises(spark):
    with pytest.raises(ValueError):
        contexts.required(spark.createDataFrame([("1",)], "doc_id string"))


def test_weight_mismatch(spark):
    table = spark.createDataFrame([(1, "panic", "strong", "0.2", "true")], "row int, term string, intensity_level string, weight string, verified string")
    issues = {r.issue for r in lexicon.validate("emotional_markers.csv", table).collect()}
    assert "weight_mismatch" in issues
    assert "missing_column" in issues


def test_approval(spark):
    words = spark.createDataFrame([("sovereignty " * 4,)], "context_text string")
    found = lexicon.extract_candidates(words)
    decided = lexicon.decide(found, [found.first().candidate_id], "approve")
    dictionary = spark.createDataFrame([("freedom", "true")], "term string, verified string")
    applied = lexicon.apply_approved(dictionary, decided, "ideological_markers")
    assert {r.term for r in applied.collect()} == {"freedom", "sovereignty"}
    assert lexicon.apply_approved(applied, decided, "ideological_markers").count() == 2
    assert lexicon.log_entries(decided, "approve").count() == 1


def test_manual_override_and_review(spark):
    docs = spark.createDataFrame([("1", "m", "o", "", "", "China is a player in the game.")], FIELDS)
    rows = contexts.extract(docs, default())
    manual = spark.createDataFrame([("1__China__001", "China", -7, 0.5)], "context_id string, ref_country string, EVI_raw int, referent_salience double")
    r = scoring.score(rows, default(), "manual", manual).first()
    assert (r.EVI_raw, r.referent_salience) == (-7, 0.5)
    review = spark.createDataFrame([("1__China__001", "China", "player", "yes")], "context_id string, ref_country string, marker string, is_metaphor string")
    assert scoring.score(rows, default(), review=review).first().N_met == 1
    assert scoring.score(rows, default(), review=review.where("false")).first().N_met == 0
