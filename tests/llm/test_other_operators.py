"""Language model, quality rules, search, language identification, archives and the pipeline."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import language_id, quality_rules, suffix_tree_lm, topk, warc

SF = "/root/testdata/sf0.001"


def documents(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(rows[3][0], rows[3][1], "en", "s"), (9001, None, None, None), (9002, "", "en", "s"), (None, "null id", "en", "s"), (9003, "...", "en", "s")]
    return spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, score int"), rows


def test_base_scores(spark):
    df, rows = documents(spark)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [[*((t or "").encode().lower().split()), b"\n"] for _, t, *_ in rows]
    counts = Counter(x for (i, *_), ts in zip(rows, tokens, strict=True) if not held(i) for x in ts)
    n, v = sum(counts.values()), len(counts)
    # a low share of head words sends nearly all words through the shuffle
    got = suffix_tree_lm.score(df, ~language_id.held_out(F.col("doc_id"), 10, 0), suffix_tree_lm.Tree(head_words=50)).collect()
    want = sorted(((i, held(i), len(ts), sum(counts[x] > 0 for x in ts), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts), 6)) for (i, *_), ts in zip(rows, tokens, strict=True)), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    assert all(r.score < 0 for r in got)


def plain_tree(texts, tree):
    """Smoothed distributions and retained contexts, by the definition."""
    counts = {}
    for words in texts:
        padded = b"\n" * tree.longest + b" ".join(words) + b"\n"
        for i in range(tree.longest, len(padded)):
            for d in range(tree.longest + 1):
                counts.setdefault(padded[i - d : i], Counter())[padded[i]] += 1
    total = sum(counts[b""].values())
    prob = {b"": {s: (counts[b""][s] + 0.5) / (total + 0.5 * suffix_tree_lm.SYMBOLS) for s in range(256)}}
    kept = {b""}
    for c in sorted(counts, key=len):
        n = counts[c]
        if c and sum(n.values()) >= tree.least_count:
            weight = tree.weight * len(n)
            prob[c] = {s: (n[s] + weight * prob[c[1:]][s]) / (sum(n.values()) + weight) for s in range(256)}
            if sum(k * math.log(prob[c][s] / prob[c[1:]][s]) for s, k in n.items()) >= tree.least_gain:
                kept.add(c)
    return prob, kept


def test_scores_by_the_longest_retained_suffix(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 5))) for _ in range(12)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 40)))) for i in range(60)] + [(60, None), (61, "unseen zz \u0416"), (62, "a" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tree = suffix_tree_lm.Tree(longest=4, least_count=3, least_gain=1.0, weight=1.5)
    tokens = {i: (t or "").encode().lower().split() for i, t in rows}
    prob, kept = plain_tree([t for i, t in tokens.items() if i % 3], tree)
    assert 20 < len(kept) < len(prob)
    for r in suffix_tree_lm.score(df, F.col("doc_id") % 3 != 0, tree).collect():
        padded, want = b"\n" * tree.longest + b" ".join(tokens[r.doc_id]) + b"\n", 0.0
        for i in range(tree.longest, len(padded)):
            context = next(padded[i - d : i] for d in range(tree.longest, -1, -1) if padded[i - d : i] in kept)
            want += math.log10(prob[context][padded[i]])
        assert math.isclose(r.score, want, rel_tol=1e-4, abs_tol=1e-3)


def test_tree_is_a_distribution_and_follows_suffixes(spark):
    import numpy as np

    grams = Counter()
    padded = b"\n" * 3 + b"abab abab abba" + b"\n"
    for i in range(3, len(padded)):
        grams[int.from_bytes(padded[i - 3 : i + 1], "big")] += 1
    tree = suffix_tree_lm.Tree(longest=3, least_gain=0.01)
    a = suffix_tree_lm.grow(spark.createDataFrame(list(grams.items()), "gram long, times long"), tree)
    symbols = [c for c in range(256) if bytes([c]) == b" " or c == 10 or not bytes([c]).isspace()]
    assert len(symbols) == suffix_tree_lm.SYMBOLS
    assert np.allclose((10.0 ** a.log10[:, a.code[symbols]].astype(float)).sum(axis=1), 1, atol=1e-4)
    texts = [t.split() for t in (b"abab abba", b"", b"zz top", b"a" * 5000, b"abab abab abba")]
    alone = [a.scores([t])[0] for t in texts]
    assert np.allclose(a.scores(texts, lanes=7), alone)
    assert np.allclose(a.scores(texts), alone)
    few = suffix_tree_lm.grow(spark.createDataFrame(list(grams.items()), "gram long, times long"), suffix_tree_lm.Tree(longest=3, least_gain=0.01, most_contexts=4))
    assert few.contexts <= 4


def test_held_out_texts_score_better_than_by_words(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = suffix_tree_lm.score(df, ~language_id.held_out(F.col("doc_id"), 10, 0)).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = suffix_tree_lm.score(df, F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)
    assert suffix_tree_lm.score(df.where("false"), F.lit(True)).count() == 0


def measures(text):
    space = " \t\n\x0b\x0c\r"
    words = "".join("\n" if c in space else c for c in text).split("\n")
    words = [w for w in words if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if any(c not in space for c in x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_base_rules(spark):
    df, rows = documents(spark)
    extra = ["a b c d e f g h " * 5, "é à # | " * 3 + "\nx y\nx y\n \n", " one\x0btwo\x0cthree\r\n" * 30]
    more = spark.createDataFrame([(10_000 + i, t, "en", "s", 0) for i, t in enumerate(extra)], df.schema)
    got = quality_rules.verdicts(df.union(more)).collect()
    want = sorted(((i, *measures(t or "")) for i, t, *_ in [*rows, *((10_000 + i, t) for i, t in enumerate(extra))]), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == want


def test_common_lines(spark):
    rnd = random.Random(2)
    body = lambda i: " ".join(f"word{i}x{rnd.randint(0, 10**6)}" for _ in range(60))
    notice = "Subscribe to  our daily newsletter and follow us everywhere you like to read"
    rows = [(i, f"{body(i)}\n{notice.upper() if i % 2 else notice}", "host") for i in range(40)] + [(100 + i, body(i), "host") for i in range(40)]
    rows.append((200, "\n".join([notice] * 3), "host"))
    limits = quality_rules.Limits(least_docs=10, share=0.1)
    df = spark.createDataFrame([(i, t, s, len(t)) for i, t, s in rows], "doc_id long, text string, source string, n_chars int")
    got = {r.doc_id: r for r in quality_rules.verdicts(df, limits).collect()}
    assert all(got[i].kept for i in [*range(40), *range(100, 140)])
    assert not got[200].kept
    assert got[0].removed_words == len(notice.split())
    clean = {r.doc_id: r for r in quality_rules.cleaned(df, limits).collect()}
    assert 200 not in clean
    assert "ubscribe" not in clean[0].text.lower()
    assert clean[0].n_chars == len(clean[0].text)
    assert clean[100].text == rows[40][1]
    assert quality_rules.verdicts(df.where("false")).count() == 0


def test_common_lines_of_small_and_large_hosts(spark):
    body = lambda i: " ".join(f"word{i}x{k}" for k in range(30))
    notice = "Read more in our newsletter every day"
    hosts = {"small": (8, 20), "rare": (5, 20), "large": (30, 1500), "seldom": (20, 1500)}  # texts with the line, texts
    rows = [(f"{h} {i}", body(i) + ("\n" + notice if i < held else ""), h) for h, (held, n) in hosts.items() for i in range(n)]
    rows += [(f"same {i}", body(0) + "\n" + notice, "copies") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = quality_rules.verdicts(df).where("removed_words > 0").collect()
    assert Counter(r.doc_id.split()[0] for r in got) == {"small": 8, "large": 30}


def test_topk(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(12)]) for i in range(300)]
    rows += [(50, rows[50][1]), (301, rows[7][1]), (302, None), (303, [1.0, None] + [0.0] * 10), (304, [float("nan")] * 12), (305, [float("inf")] * 12), (None, [0.5] * 12), (400, [1.0, 2.0]), (350, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    exact = [(i, [math.floor(256 * x) for x in v]) for i, v in [(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()] if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (i, q) in enumerate(exact):
        if i % 50 == 0:
            others = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for m, (j, v) in enumerate(exact) if m != n and len(v) == len(q))
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(others[:5])]
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, topk.Blocks(queries=3, candidates=70, dimensions=3, seeds=40))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0


def test_bounds_drop_candidates():
    import numpy as np

    rnd = np.random.default_rng(3)
    vectors = rnd.normal(size=(4000, 64))
    vectors = np.floor(256 * vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.int64)
    vertical, mass = np.ascontiguousarray(vectors.T), (vectors.astype(float) ** 2).sum(axis=1)
    floor = topk.floors(vectors[:20], np.arange(20), vectors[:1000], np.arange(1000), 5)
    shares = []
    for i in range(20):
        shares.append([])
        at, score = topk.best(vectors[i], vertical, mass, 6, 8, floor[i], shares[-1])
        want = np.sort(vectors @ vectors[i])[::-1][:6]
        assert sorted(score.tolist(), reverse=True)[:6] == want.tolist()
    alive = np.mean(shares, axis=0).round(3)
    print("alive by block of 8 of 64 dimensions:", alive.tolist())
    assert alive[3] < 0.3


def test_language(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    small, rows = documents(spark)
    out = {r.doc_id: r for r in language_id.identify(small).collect()}
    assert out[9001].lang_pred == out[9002].lang_pred == out[9003].lang_pred == "und"
    nothing = language_id.identify(small.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language_id.identify(small.where("false")).count() == 0


def test_backing_off():
    fit = language_id.Fit(longest=3)
    model = language_id.Model([("a", 0, "known", 5), ("b", 0, "known", 1), ("a", 3, "xyz", 1), ("b", 1, "q", 9)], fit)
    assert model.predict("known")[0] == "a"
    assert model.word("xyz") == model.tables[3]["xyz"]
    assert model.predict("q")[0] == "b"
    assert model.predict("123")[0] == "und"


@pytest.mark.parametrize("segment", [40, 32_768])
def test_archives(spark, tmp_path, segment):
    html = ["<p>ä</p>" * 300, None, "", "WARC/1.1\r\n\r\nx\r\n\r\n", "0\r\n\r\n" * 9, "y" * 20_000]
    rows = [(i, f"http://x/{i}\r\nbad", html[i % len(html)]) for i in range(20)] + [(3, "u", html[3]), (None, None, "only"), (None, "n", "y" * 20_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_bytes int").repartition(3)
    warc.write(df, f"{tmp_path}/w", segment)
    got = warc.read(spark, f"{tmp_path}/w").collect()
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", -1), i)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        top = largest.get(h or "")
        response = top is None or i == top
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if response else "revisit", None if response else top))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert {bytes(r.payload) for r in got if r.payload is not None} == {(h or "").encode() for h in [*html, "only"]}


def test_broken_segments_raise(spark):
    from pyspark.errors import PySparkException

    parts = spark.createDataFrame([("o", 1, None, "response", 1, None, "d", b"abc"), ("o", 3, 9, "response", None, None, "", b"def")], warc.PARTS)
    with pytest.raises(PySparkException):
        warc.reassembled(parts).select("block").collect()
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_growing_a_tree_joins_all_lengths_at_once(spark, monkeypatch):
    """The driver's memory grows with the shuffles of a plan: one join and one sum, however long the contexts."""
    grams = [(int.from_bytes(b"abcdef"[i:] + b"abcdef"[:i], "big"), 9) for i in range(6)]
    plans, to_arrow = [], type(spark.range(0)).toArrow
    monkeypatch.setattr(type(spark.range(0)), "toArrow", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), to_arrow(df))[1])
    assert suffix_tree_lm.grow(spark.createDataFrame(grams, "gram long, times long"), suffix_tree_lm.Tree(least_gain=0.01)).contexts > 1
    assert len(plans) == 1 and plans[0].count("Join ") == 1 and plans[0].count("Aggregate ") == 1
