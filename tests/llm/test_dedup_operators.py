"""Substring and near-duplicate removal by brute force."""

import collections
import hashlib
import random

import pytest
from xxhash import xxh64_intdigest

from corpusloom.llm import simhash, suffix_dedup

TINY = suffix_dedup.Sizes(bucket_entries=500, combine_entries=700, group_bytes=3000, offsets=6)


def removed(rows, length):
    counts = collections.Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        counts.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if counts[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def mixed(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, 300))) for _ in range(20)]
    rows = []
    for i in range(60):
        t, u, k = rnd.choice(base), rnd.choice(base), rnd.random()
        if k < 0.3:
            t = t[: rnd.randint(0, len(t))] + u[rnd.randint(0, len(u)) :]
        elif k < 0.6 and t:
            x = list(t)
            x[rnd.randrange(len(x))] = "x"
            t = "".join(x)
        elif k < 0.7:
            t = t * 2
        rows.append((i, t))
    return [*rows, (5, rows[5][1]), (None, None), (7, ""), (None, "aaa" * 100)]


def test_difference_covers():
    for length in (5, 9, 20, 100, 400, 1000):
        v, cover = suffix_dedup.Sizes().cover(length)
        assert 5 * v <= 4 * length or v == 1
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


#: Names of so few bits that unequal strings share them: only the comparison of bytes can tell.
CLASHING = suffix_dedup.Sizes(bucket_entries=500, combine_entries=700, group_bytes=3000, offsets=6, name_bits=(7, 64))


@pytest.mark.parametrize(("length", "sizes"), [(3, TINY), (20, TINY), (40, TINY), (100, suffix_dedup.Sizes()), (20, CLASHING)])
def test_substrings(spark, length, sizes):
    rows = mixed(length)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_bytes string").repartition(3)
    assert sorted([tuple(r)[:5] for r in suffix_dedup.deduplicate(df, length, sizes).collect()], key=str) == removed(rows, length)


def test_shared_blocks(spark):
    """Sampled blocks at more than one sampled place, by brute force; every repeated passage of enough bytes has one."""
    rows = mixed(2)
    sizes = suffix_dedup.Sizes(bucket_entries=500, combine_entries=700, group_bytes=3000, offsets=6, period=13, block=10)
    v, cover = sizes.cover(60)
    assert v == 13
    at = collections.Counter()
    places = {}
    for n, (_, t) in enumerate(rows):
        b = (t or "").encode()
        places[n] = [b[p : p + 10] for p in range(len(b) - 9) if p % v in cover]
        at.update(places[n])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.deduplicate(df, 60, sizes).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == removed(rows, 60)
    want = [(rows[n][0], sum(at[x] > 1 for x in found)) for n, found in places.items()]
    assert sorted([(r.doc_id, r.n_shared_blocks) for r in got], key=str) == sorted(want, key=str)
    long_enough = removed(rows, 22)
    assert {i for i, _, gone, *_ in long_enough if gone and i is not None} <= {r.doc_id for r in got if r.n_shared_blocks}


def test_names_that_clash_are_found_out(spark):
    df = spark.createDataFrame(mixed(9), "doc_id long, text string")
    assert suffix_dedup.attempted(df, 20, CLASHING, False, 0)[2]
    assert not suffix_dedup.attempted(df, 20, CLASHING, False, 1)[2]
    with pytest.raises(RuntimeError):
        suffix_dedup.repeats(df, 20, suffix_dedup.Sizes(name_bits=(7, 7)))


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.deduplicate(df, 20, TINY).count() == 0
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.near_groups(df).count() == 0


def test_kept_text(spark):
    shared = "this passage is repeated word for word in two texts"
    df = spark.createDataFrame([(1, f"first {shared} end", "s", 3), (2, f"second {shared} stop", "s", 3), (3, "alone", "s", 5)], "doc_id long, text string, source string, n_chars long")
    out = {r.doc_id: r for r in suffix_dedup.without_repeats(df, 30).collect()}
    assert out[1].text == "firstend" or out[1].text == "first end" or "passage" not in out[1].text
    assert out[1].n_chars == len(out[1].text)
    assert out[3].text == "alone"


def brute_fingerprint(text, width=3):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rnd = random.Random(3)
    words = ["alpha", "Beta", "gamma", "délta", "eps", "zeta"]
    rows = []
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.randint(0, 120))]
        for _ in range(3):
            copy = list(base)
            if copy and rnd.random() < 0.7:
                copy[rnd.randrange(len(copy))] = "x"
            rows.append((len(rows), "\t ".join(copy)))
    rows += [(4, rows[4][1]), (200, None), (201, "\n"), (None, rows[0][1])]
    got = simhash.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")).collect()
    assert len(got) == len(rows)
    prints = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                group[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    want = sorted(((d, f"{prints[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)
    assert sorted([tuple(r) for r in got], key=str) == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    assert {labels[i] for i in range(41)} == {0}
    assert labels[101] == 100


def test_further_edges_join_known_components(spark, monkeypatch):
    of = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    first, further = [(i, i + 1) for i in range(10)] + [(20, 21), (30, 31)], [(5, 21), (3, 7), (40, 41), (30, 31), (41, 42)]
    components, gone_through = simhash.components, []
    labels, whole = components(of(first)), components(of(first + further))
    monkeypatch.setattr(simhash, "components", lambda edges: (gone_through.extend(sorted(map(tuple, edges.collect()))), components(edges))[1])
    assert sorted(simhash.merged(labels, of(further)).collect()) == sorted(whole.collect())
    assert gone_through == [(0, 20), (40, 41), (41, 42)]
    assert sorted(simhash.merged(labels, of([(3, 7)])).collect()) == sorted(labels.collect())
    assert len(gone_through) == 3


def test_later_pairs_do_not_go_through_all_edges_again(spark, monkeypatch):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    components, calls = simhash.components, []
    monkeypatch.setattr(simhash, "components", lambda edges: (calls.append(edges.count()), components(edges))[1])
    assert len({r.group for r in simhash.near_groups(df).collect()}) == 1
    assert len(calls) == 1


def test_near_groups(spark):
    rnd = random.Random(9)
    base = " ".join(f"w{rnd.randint(0, 400)}" for _ in range(200)).split()
    near = list(base)
    near[50] = "other"
    far = [f"v{rnd.randint(0, 400)}" for _ in range(200)]
    texts = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(far)), (5, None), (6, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    groups = {r.doc_id: r.group for r in simhash.near_groups(df).collect()}
    assert groups[1] == groups[2] == groups[3] != groups[4]
    assert groups[5] == groups[6]
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == [1, 4, 5]


def similarity(x, y):
    p, q = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (x, y))
    return len(p & q) / len(p | q)


def grouped(spark, texts):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r.group for r in simhash.near_groups(df).collect()}


def test_near_pairs_in_a_large_template_family(spark):
    rnd = random.Random(4)
    some = lambda n: [f"w{rnd.randint(0, 50_000)}" for _ in range(n)]
    template, texts = some(300), []
    for _ in range(150):
        own = some(100)
        texts += [own[:50] + template + own[50:], own[:50] + template + own[50:80] + some(20)]
    groups = grouped(spark, texts)
    for i in range(0, len(texts), 2):
        assert similarity(texts[i], texts[i + 1]) >= 0.8
        assert groups[i] == groups[i + 1]
    assert similarity(texts[0], texts[2]) < 0.7
    assert len(set(groups.values())) == 150


@pytest.mark.parametrize("words", [30, 120, 400])
def test_near_pairs_edited_in_one_block(spark, words):
    rnd = random.Random(words)
    some = lambda n: [f"w{int(rnd.paretovariate(0.7))}" for _ in range(n)]
    texts, asked = [], []
    for k in range(120):
        base = some(words)
        n = round(words * rnd.uniform(0.03, 0.2))
        at = rnd.randint(0, words - n)
        texts += [base, (base + some(n), base[: words - n], base[:at] + some(n) + base[at + n :])[k % 3]]
        if similarity(*texts[-2:]) >= 0.8:
            asked.append(len(texts) - 2)
    groups = grouped(spark, texts)
    assert len(asked) > 60
    assert [i for i in asked if groups[i] != groups[i + 1]] == []
