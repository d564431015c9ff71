"""Operators against plain Python on small inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stats
from corpusloom.functions import text as T
from corpusloom.operators import aggregate, collector, dedup, percentile
from corpusloom.sources import io
from corpusloom.streaming import scoring as streaming


def test_tokens(spark):
    df = spark.createDataFrame([("U.S. policy - it's \"well-known\" in 2024 Привет-",)], "t string")
    assert df.select(T.tokenize(F.col("t"), us=True)).first()[0] == ["usa", "policy", "it's", "well-known", "in", "привет"]


def test_lemmas(spark):
    words = {"beijing": "beij", "states": "stat", "ing": "ing", "serangan": "serang", "quickly": "quick"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.l for r in df.select("w", T.lemma(F.col("w")).alias("l")).collect()} == words


def test_chi_square_tails():
    assert stats.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_tail(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_tail(11.070497693516351, 5) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_tail(0.0, 3) == 1.0


def greedy(n, pairs):
    kept = []
    for j in range(n):
        if not any((i, j) in pairs for i in kept):
            kept.append(j)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_greedy_survivors(spark, seed):
    rnd = random.Random(seed)
    n = 14
    pairs = {(i, j) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.15} | {(0, 1), (1, 2)}
    docs = spark.range(n).withColumnRenamed("id", "seq")
    out = dedup.greedy_survivors(docs, spark.createDataFrame(sorted(pairs), "a long, b long"))
    assert sorted(r.seq for r in out.collect()) == greedy(n, pairs)


def test_chain_keeps_both_ends(spark):
    docs = spark.range(3).withColumnRenamed("id", "seq")
    out = dedup.greedy_survivors(docs, spark.createDataFrame([(0, 1), (1, 2)], "a long, b long"))
    assert sorted(r.seq for r in out.collect()) == [0, 2]


def test_simhash(spark):
    import hashlib

    tokens = ["a", "b", "b", "c"]
    vec = [0] * 64
    for t in tokens:
        h = int(hashlib.md5(t.encode()).hexdigest()[:16], 16)
        for i in range(64):
            vec[i] += 1 if h >> i & 1 else -1
    want = sum(1 << i for i, v in enumerate(vec) if v >= 0)
    got = spark.createDataFrame([(tokens,)], "t array<string>").select(stats.simhash64(F.col("t"))).first()[0]
    assert got & (1 << 64) - 1 == want


def test_percentiles_match_pandas(spark):
    import pandas as pd

    rnd = random.Random(1)
    values = [rnd.randint(0, 9) / 10 for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, m double")
    got = {r.id: r.m_percentile for r in percentile.ranks(df, ["m"]).collect()}
    want = pd.Series(values).rank(pct=True) * 100
    assert all(math.isclose(got[i], want[i], abs_tol=1e-5) for i in got)


def test_baseline_of_nothing(spark):
    df = spark.createDataFrame([(1, 0.5)], "id int, m double")
    assert percentile.baseline_ranks(df, df.where("false"), ["m"]).first().m_baseline_percentile == 0.0


def test_dominant_value(spark):
    rows = [("a", v) for v in (5, 5, -3, -3, 1)] + [("b", v) for v in (2, 2, -2, -2)]
    df = spark.createDataFrame(rows, "k string, EVI_raw int")
    got = {r.k: r.dominant_EVI for r in aggregate.dominant_evi(df, ["k"]).collect()}
    assert got == {"a": 5, "b": -2}


def test_country_scores(spark):
    df = spark.createDataFrame([("", "The US and us. Beijing and China."), ("", "nothing here")], "title string, content string")
    rows = collector.classified(df).collect()
    assert len(rows) == 1
    assert rows[0].country_scores == {"usa": 1, "china": 2}
    assert rows[0].primary_country == "china"
    assert rows[0].primary_subcorpus == "general"


def test_article_fields(spark):
    long = "This paragraph is long enough to be kept by the parser."
    html = f"<html><h1>Head <b>line</b></h1><p>{long} 1</p><p>{long} 2</p><p>short</p><p>{long} 3</p></html>"
    a = spark.createDataFrame([(html,)], "h string").select(collector.article_fields(F.col("h")).alias("a")).first().a
    assert a.title == "Head line"
    assert a.content.count("\n") == 2


def test_round_trip_and_header(spark, tmp_path):
    df = spark.createDataFrame([("thestar_x.txt", "Title: Hello\nDate: 2024-05-06\nbody\nread also: more")], "name string, text string")
    r = io.parse_header(df).first()
    assert (r.title, r.outlet_name, r.media_country, r.year, r.date) == ("Hello", "The Star", "Malaysia", 2024, "2024-05-06")
    assert r.text.strip() == "body"
    io.save_outputs({"t": spark.createDataFrame([(1, ["a", "b"])], "i int, l array<string>")}, str(tmp_path))
    assert io.load_table(spark, f"{tmp_path}/t.csv").first().l == "a; b"
    assert io.decode_bytes("привет".encode("cp1251")) == "привет"


def test_stream_equals_batch(spark, tmp_path):
    from corpusloom.functions.profile import default
    from corpusloom.operators import contexts, scoring

    schema = "doc_id string, media_country string, outlet_name string, date string, title string, text string"
    docs = spark.createDataFrame([(str(i), "m", "o", "", "", "China supports peace. Russia said no.") for i in range(5)], schema)
    docs.write.parquet(f"{tmp_path}/in")
    q = streaming.write(streaming.scored_stream(streaming.read_documents(spark, f"{tmp_path}/in", schema), default()).select("context_id", "EVI_raw"), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {tuple(r) for r in scoring.score(contexts.extract(docs, default()), default()).select("context_id", "EVI_raw").collect()}


def families(seed, sizes):
    """Documents of tokens in families that differ in a token or two, some by more, and strangers."""
    rnd = random.Random(seed)
    docs = []
    for f, n in enumerate(sizes):
        base = [f"f{f}w{rnd.randrange(40)}" for _ in range(60)]
        for _ in range(n):
            own = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 6])):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(30)}"
            docs.append(own)
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("sizes", [[40, 1, 1], [12, 9, 7, 5, 1, 1, 1], [1] * 10])
def test_survivors_by_the_greedy_rule(spark, sizes, monkeypatch):
    monkeypatch.setattr(dedup, "FEW_PAIRS", 0)
    docs = families(len(sizes), sizes)
    df = spark.createDataFrame(list(enumerate(docs)), "seq long, tokens array<string>")
    h = {r.seq: r.h & (1 << 64) - 1 for r in df.select("seq", stats.simhash64(F.col("tokens")).alias("h")).collect()}
    kept = []
    for j, t in enumerate(docs):
        near = lambda i: (h[i] ^ h[j]).bit_count() <= 3 and min(len(docs[i]), len(t)) / max(len(docs[i]), len(t)) >= 0.85 and len({*docs[i]} & {*t}) / len({*docs[i]} | {*t}) >= 0.92  # noqa: E731, B023
        if not any(near(i) for i in kept):
            kept.append(j)
    assert sorted(r.seq for r in dedup.survivors(df).collect()) == kept
    assert len(kept) < len(docs) or max(sizes) == 1


def test_a_family_is_compared_with_its_first_document(spark, monkeypatch):
    compared, counts = dedup.of_similar_tokens, []
    monkeypatch.setattr(dedup, "of_similar_tokens", lambda p, *a: (counts.append(p.count()), compared(p, *a))[1])
    sums = []
    for n in (50, 100):
        counts.clear()
        docs = [[*(f"w{i}" for i in range(200)), f"own{k}"] for k in range(n)]
        dedup.survivors(spark.createDataFrame(list(enumerate(docs)), "seq long, tokens array<string>")).count()
        sums.append(sum(counts))
    assert sums[1] < 3 * sums[0]


def test_signed_documents_and_parities(spark):
    """SimHashes were folded bit by bit in expressions, and token sets travelled for every pair of near hashes: most of the time on 1 GB."""
    rnd = random.Random(9)
    docs = [[f"t{rnd.randrange(n)}é" for _ in range(n)] for n in (0, 1, 2, 7, 300, 300, 2000)] + [["a", "", "b"], ["x"] * 5]
    docs += [[*docs[5], f"new{k}"] for k in range(20)]
    df = spark.createDataFrame(list(enumerate(docs)), "seq int, tokens array<string>")
    signed = dedup.signed_documents(df)
    assert {r.seq: r.h for r in signed.collect()} == {r.seq: r.h for r in df.select("seq", stats.simhash64(F.col("tokens")).alias("h")).collect()}
    assert {r.seq: (r.n, {*r.t.split(dedup.PART)} - {""}, r.d) for r in signed.collect()} == {i: (len(t), {*t} - {""}, len({*t} - {""})) for i, t in enumerate(docs)}
    x, y = signed.select("seq", "d", "p").toDF("a", "da", "pa"), signed.select("seq", "d", "p").toDF("b", "db", "pb")
    left = {(r.a, r.b) for r in x.crossJoin(y).where(dedup.may_be_similar(F.col("da"), F.col("pa"), F.col("db"), F.col("pb"), 0.92)).collect()}
    sets = [{*t} - {""} for t in docs]
    near = {(i, j) for i, s in enumerate(sets) for j, t in enumerate(sets) if s | t and len(s & t) / len(s | t) >= 0.92}
    assert near <= left and len(left) < len(near) + len(docs)
