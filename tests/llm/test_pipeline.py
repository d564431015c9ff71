"""Every stage with odd input: nulls, empty and very long texts, repeats, no rows and columns of clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm.common import OWN

SF = "/root/testdata/sf0.001"
CLASHES = ("_lines", "_row", "_kept", "_key", "_id", "_uid", "_sha", "lang_pred", "score", "uid", "key", "group", "bucket", f"{OWN}spare")
LONG = 500_001


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(4)
    rnd = random.Random(1)
    vocabulary = docs.where("lang = 'en'").select(F.explode(F.split("text", r"\s+")).alias("w")).where("w != ''").distinct().limit(3000)
    words = sorted(r.w for r in vocabulary.collect())
    long = " ".join(rnd.choice(words) for _ in range(60_000))
    first = docs.where("text IS NOT NULL").orderBy("doc_id").first()
    rows = [(None, None, None, None, None), (None, "", "en", "s", 0), (900_001, None, "en", None, 0), (900_002, "½ ² 12", None, "s", 6), tuple(first), tuple(first), (LONG, long, None, "s", len(long)), (None, long[:3000], "en", None, 3000)]
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    return both.withColumns({c: F.lit(7) for c in CLASHES}).cache()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage(spark, odd, name):
    step = dict(corpus_pipeline.STAGES)[name]
    out = step(spark, odd, SF)
    assert out.columns == odd.columns
    assert out.schema["n_chars"].dataType == odd.schema["n_chars"].dataType
    rows = out.collect()
    assert 0 < len(rows) <= odd.count()
    assert LONG in {r.doc_id for r in rows}
    assert all(r._lines == r.score == 7 for r in rows)
    assert all(r.text is None or r.n_chars in (None, 0, len(r.text)) or name != "suffix_array_dedup" for r in rows)
    if name == "language_id":
        assert all(any(c.isalpha() for c in r.text) for r in rows)
    if name == "suffix_array_dedup":
        assert all(r.text.split() for r in rows)
    if name == "simhash_near_dedup":
        texts = [r.text or "" for r in rows]
        assert len(texts) == len(set(texts))
    assert step(spark, odd.where("false"), SF).count() == 0


def test_packing_stage(spark, odd):
    pack = dict(corpus_pipeline.STAGES)["best_fit_packing"]
    rows = pack(spark, odd, SF).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sum(r.length for r in rows if r.doc_id == LONG) > 60_000
    assert pack(spark, odd.where("false"), SF).count() == 0


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    left = docs.count()
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0 < docs.count() <= left
        left = docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert out.select("doc_id").distinct().count() == left
