"""Decontamination, centroid clustering and hard negatives against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import clustering, decontamination, hard_negatives

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def plain_contamination(docs, items, width=10):
    known = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            known.setdefault(tuple(words[i : i + width]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        words = words_of(text)
        hit, found = set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(words) - n + 1):
                if (own := known.get(tuple(words[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_suffix_array_and_index():
    import numpy as np

    rnd = random.Random(3)
    for n in (1, 2, 7, 60, 500):
        for highest in (1, 3, 40):
            text = np.array([rnd.randint(0, highest) if rnd.random() < 0.9 else 0 for _ in range(n - 1)] + [0], np.int32)
            index = decontamination.FMIndex(text, highest, 4)
            plain = text.tolist()
            phrases = [[rnd.randint(1, highest) for _ in range(rnd.randint(1, 3))] for _ in range(30)]
            table = np.array([p + [0] * (3 - len(p)) for p in phrases], np.int32)
            low, high = index.search(table, np.array([len(p) for p in phrases]))
            for p, a, b in zip(phrases, low.tolist(), high.tolist(), strict=True):
                want = [i for i in range(n) if plain[i : i + len(p)] == p]
                assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def mixed_texts():
    rnd = random.Random(11)
    vocabulary = ["an", "be", "Ce", "dé", "e1", "fó", "GA", "ha", "i", "jo"]
    make = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", ",", ".\n"]) for _ in range(n))
    items = [(i, make(rnd.choice([12, 14, 25]))) for i in range(12)]
    items += [(100, make(4)), (101, "Ha i"), (102, ""), (103, None), (104, "..."), (None, make(11)), (5, make(11)), (6, items[6][1]), (7, items[8][1])]
    docs = []
    for i in range(60):
        parts = [make(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            own = words_of(rnd.choice(items)[1])
            a = rnd.randint(0, max(0, len(own) - 1))
            parts += [b"-".join(own[a : a + rnd.randint(5, 20)]).decode().upper(), make(rnd.randint(0, 9)), "zz"]
        docs.append((i, " ".join(parts)))
    docs += [(200, None), (201, ""), (None, items[0][1]), (3, docs[3][1]), (3, docs[3][1]), (202, "x" * 50_000 + " " + (items[1][1] + " ") * 500), (203, " ".join(["ha", "i"]) + " ha\x00i")]
    return docs, items


@pytest.mark.parametrize("sizes", [decontamination.Sizes(), decontamination.Sizes(block_windows=40, shard_symbols=50, sample=3, located=7)])
def test_contamination_by_brute_force(spark, sizes):
    docs, items = mixed_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_words string").repartition(3)
    tests = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, phrase int")
    got = sorted((tuple(r) for r in decontamination.contamination(df, tests, sizes).collect()), key=str)
    assert got == plain_contamination(docs, items)


def test_decontaminated_texts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before, {item.upper()}! after", 5), (2, "one two three", 6), (3, None, 7), (4, f"{item} {item}", None)]
    df = spark.createDataFrame(docs, "spans long, text string, items int")
    tests = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontamination.decontaminated(df, tests)
    assert got.schema == df.schema
    assert {r.spans: r.text for r in got.collect()} == {1: "Before, ! after", 2: "one two three", 3: None, 4: ""}


def test_contamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert sorted(tuple(r)[:4] for r in decontamination.contamination(docs, items).collect()) == [(1, 2, 0, 0), (2, 0, 0, 0)]
    assert decontamination.contamination(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int, cluster string"


def plain_lloyd(rows, k, rounds, components, seed=3):
    """rows: (id, vector of integers), already kept ones."""
    name = lambda r: (1, "", r[1]) if r[0] is None else (0, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(rows, key=name)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda i: (far(v, centroids[i]), i))
    for _ in range(rounds):
        label = [nearest(v) for _, v in rows]
        for i in range(len(centroids)):
            own = [v for (_, v), x in zip(rows, label, strict=True) if x == i]
            if own:
                centroids[i] = [sum(d) // len(own) for d in zip(*own, strict=True)]
    label = [nearest(v) for _, v in rows]
    distance = [far(v, centroids[i]) for (_, v), i in zip(rows, label, strict=True)]
    inertia = [sum(d for d, x in zip(distance, label, strict=True) if x == i) for i in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, x, d, inertia[x], sum(inertia), digest[x]) for (i, _), x, d in zip(rows, label, distance, strict=True)), key=str)


def vectors(n, components, seed, spread):
    """Points about a few centres, on a coarse grid so that ties are common, with repeated rows and odd ones."""
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-1, 1) for _ in range(components)] for _ in range(5)]
    rows = [(i, [round(x + rnd.gauss(0, spread), 1) for x in rnd.choice(centres)], i % 4, "x") for i in range(n)]
    rows += [rows[3], rows[3], (None, rows[5][1], 1, None), (7, rows[8][1], 2, "x")]
    rows += [(n + i, rows[9][1], i % 3, "x") for i in range(n // 3)]
    odd = [(9001, None, 1, "x"), (9002, [1.0], 1, "x"), (9003, [float("nan")] * components, 1, "x"), (9004, [float("inf")] * components, 1, "x"), (9005, [None] * components, 1, "x"), (9006, [1e30] * components, 2, "x")]
    return rows, odd


@pytest.mark.parametrize(("n", "k", "components", "block", "spread"), [(120, 8, 3, 1024, 0.3), (150, 20, 2, 16, 0.05), (60, 4, 5, 7, 0.0), (3, 8, 4, 10, 0.2)])
def test_clusters_by_brute_force(spark, n, k, components, block, spread):
    rows, odd = vectors(max(n, 10), components, n, spread)
    rows = rows if n > 3 else rows[:3]
    plan = clustering.Lloyd(clusters=k, rounds=3, components=components, block=block, pairs=64)
    got = clustering.clusters(spark.createDataFrame(rows + odd, VECTORS).repartition(3), plan)
    import numpy as np

    whole = [(i, [int(np.floor(float(np.float32(x)) * 1024)) for x in v]) for i, v, *_ in rows]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_lloyd(whole, k, 3, components)


def test_trees_prune_in_clustered_vectors():
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.integers(-1000, 1000, (16, 8))
    points = np.concatenate([c + rng.integers(-20, 20, (64, 8)) for c in centres])
    tree = clustering.CoverTree(points, 1.3)
    block = type("Block", (), {k: getattr(tree, k) for k in clustering.PARTS if k != "vectors"})()
    place = np.empty(len(points), np.int64)
    place[tree.order] = np.arange(len(points))
    block.vectors, block.point = points[tree.order], place[tree.point]
    seen = [0, 0]
    label = clustering.assign(block, centres, clustering.CoverTree(centres, 1.3), 1 << 12, seen)
    assert (label == ((block.vectors[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert sum(seen) < len(points) * len(centres) / 10


def test_cover_tree_holds_what_it_promises():
    import numpy as np

    points = np.random.default_rng(2).integers(-50, 50, (300, 3))
    tree = clustering.CoverTree(points, 1.3)
    for i in range(len(tree.point)):
        members = tree.order[tree.low[i] : tree.high[i]]
        assert np.isclose(np.sqrt(((points[members] - points[tree.point[i]]) ** 2).sum(axis=1)).max(), tree.radius[i])
        if tree.count[i]:
            own = range(tree.first[i], tree.first[i] + tree.count[i])
            assert sorted(x for c in own for x in tree.order[tree.low[c] : tree.high[c]]) == sorted(members)
            centres = points[tree.point[own.start : own.stop]].astype(float)
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))[np.triu_indices(len(centres), 1)]
            assert apart.min() > max(tree.radius[c] for c in own) * 0.999 and tree.point[i] in tree.point[own.start : own.stop]


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert clustering.clusters(none).collect() == []
    assert clustering.clusters(spark.createDataFrame([(1, None, 1, "x")], VECTORS)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain_negatives(rows, positives=5, negatives=3):
    """rows: (id, label, vector of integers), already kept ones."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for i, (anchor, label, v) in enumerate(rows):
        if anchor % 50 == 0:
            scored = sorted((-dot(v, w), other, own) for j, (other, own, w) in enumerate(rows) if j != i and len(w) == len(v))
            for p, positive, _ in [x for x in scored if x[2] == label][:positives]:
                window = [(s, other) for s, other, own in scored if own != label and 50 * -p <= 100 * -s <= 95 * -p]
                out += [(anchor, positive, rank, other, -p, -s) for rank, (s, other) in enumerate(window[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("plan", [hard_negatives.Mining(), hard_negatives.Mining(candidates=40, anchors=3, near=4, sample=50, codewords=8), hard_negatives.Mining(sample=0)])
def test_hard_negatives_by_brute_force(spark, plan):
    import numpy as np

    rows, odd = vectors(250, 7, 4, 0.5)
    rows += [rows[50], rows[50], rows[100], (150, rows[0][1], 1, "x"), (4000, [0.5, 0.25], 1, "x"), (4001, [0.5, 0.5], 1, "x"), (4003, [0.4, 0.3], 2, "x")]
    odd += [(9050, [0.1] * 7, None, "x")]
    got = hard_negatives.mine(spark.createDataFrame(rows + odd, VECTORS).repartition(3), F.col("vec_id") % 50 == 0, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")), plan)
    kept = [(i, (c + 1) % 10 if i % 7 == 0 else c, [int(np.floor(float(np.float32(x)) * 256)) for x in v]) for i, v, c, _ in rows if i is not None]
    want = plain_negatives(kept)
    assert len(want) > 50
    assert sorted(tuple(r) for r in got.collect()) == want


def test_bounds_hold_and_filter():
    import numpy as np

    rng = np.random.default_rng(7)
    points = np.floor(rng.normal(0, 32, (4000, 64))).astype(np.int64)
    plan = hard_negatives.Mining()
    book = hard_negatives.codebook(points[:2000], plan)
    split = hard_negatives.parts(points, plan.subspace)
    code = np.stack([hard_negatives.nearest(split[:, s], book[s]) for s in range(len(book))], axis=1)
    left = (split - book[np.arange(len(book)), code]).reshape(len(points), -1)
    n = np.arange(len(points))
    import pyarrow as pa

    rows = hard_negatives.Candidates(pa.table({"row": n, "vec_id": n, "label": n % 10, "times": n * 0 + 1, "residual": np.sqrt((left**2).sum(axis=1)), "vector": [v.astype("<i4").tobytes() for v in points], "codes": [c.astype("<u2").tobytes() for c in code]}), book)
    scored = [0]
    for anchor in points[::100]:
        exact = points @ anchor
        approx, off = rows.bounds(anchor)
        assert (np.abs(exact - approx) <= off).all()
        low, high = 10_000, 24_000
        at, scores = rows.best(anchor, approx, off, n % 10 != 3, 3, low, high, plan.near, scored)
        inside = sorted((-s, i) for i, s in enumerate(exact.tolist()) if low <= s <= high and i % 10 != 3)
        assert [(-s, i) for i, s in zip(at.tolist(), scores.tolist(), strict=True)] == inside[:3]
    assert scored[0] < 0.5 * 40 * len(points)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 50 == 0).collect() == []
