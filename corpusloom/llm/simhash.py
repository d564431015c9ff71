"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two
fingerprints within the radius have a variant in common, so a shuffle on the
variants brings them together; colliding pairs are made distinct and verified.
A variant gathers at most as many distinct fingerprints as a ball of half the
radius holds (65 for radius 2), however many documents share them: documents
are folded into distinct fingerprints first, with a map-side combine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import OWN, cut, release, short_batches, text_column


def fingerprint(text: str, width: int) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        hashes = [xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = [0, *(ends[: n - width] + 1).tolist()]
        hashes = [xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t, width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f - (1 << 64) if f >> 63 else f for f in found], pa.int64())], ["doc_id", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return short_batches(docs).select("doc_id", text_column(docs).alias("text")).mapInArrow(run, f"doc_id {id_type}, fp long")


def masks(radius: int) -> list[int]:
    """All signed 64-bit words with at most radius bits set."""
    found = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Verified links (a, b) with a < b between fingerprints (column fp) that connect all within the radius.

    For an even radius every two fingerprints that meet at a variant are linked,
    so a star around the smallest carries the same connections as all pairs;
    for an odd one all pairs are made and verified.
    """
    half = (radius + 1) // 2
    variants = F.explode(F.array(*[F.lit(m).cast("long") for m in masks(half)])) if half < 2 else F.explode(F.from_json(F.lit(str(masks(half))), "array<long>"))
    met = distinct.select("fp", variants.alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")).groupBy("variant").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    first = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")) if radius % 2 == 0 else met.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b"))
    return first.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) of every node of edges (a, b).

    Each round takes the smallest label among a node and its neighbours and then
    follows labels once more, so chains halve; it ends when nothing changes.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = cut(low.join(up, "label", "left").select("node", F.least("label", "above").alias("label"), "was"))
        done = jumped.where(F.col("label") != F.col("was")).isEmpty()
        labels = jumped.select("node", "label")
        if done:
            return labels


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels, as components gives them, after further edges (a, b); nodes may be new.

    Only the components that the edges join are gone through, each as one node.
    """
    of = [labels.toDF(x, f"of_{x}") for x in "ab"]
    ends = edges.select("a", "b").join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    across = cut(ends.where("a != b").distinct())
    if across.isEmpty():
        return labels
    now = components(across)
    moved = labels.join(now.toDF("label", "now"), "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    return cut(moved.union(now).distinct())


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs.

    docs: doc_id and text; other columns are ignored, whatever their names.
    component_id is the smallest doc_id that links reach, the row's own included.
    Texts without a word have fingerprint 0 and are linked like any other; null
    texts count as empty; very long ones are read whole; a bit that exactly half
    of the shingles set is 0; rows that repeat an id stay; rows with a null id stay
    and name no component (its component_id is null if no other id is there).
    """
    prints = cut(fingerprints(docs, width))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(distinct, radius))
    labelled = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", F.coalesce("label", "fp").alias("label"), "first")
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    by_print = labelled.join(smallest, "label").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@dataclass(frozen=True)
class Sketches:
    """Settings of near_groups: words of a shingle, least similarity, and how the search goes about it.

    What is found does not depend on the rest: radius is that of the SimHash
    balls, rounds the number of stars that are tried before all pairs; how
    frequent a shingle is, is told from one text in `sampled`, for `frequent`
    shingles at most, which orders the shingles and decides the work; up to
    few_keys keys of texts are broadcast, more meet the texts in a shuffle.
    """

    wide: int = 5
    similarity: float = 0.8
    radius: int = 2
    rounds: int = 2
    sampled: int = 8
    frequent: int = 1_000_000
    few_keys: int = 500_000


#: 64-bit words of the parity bits.
PARITY_WORDS = 8
PARITY = [f"p{i}" for i in range(PARITY_WORDS)]


class WordHashes(dict):
    """The hash of each word; forgets all when it has learnt many."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= 100_000:
            self.clear()
        found = xxh64_intdigest(word, 42)
        if len(word) <= 64:
            self[word] = found
        return found


def stirred(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, width: int, known: WordHashes):
    """The distinct hashes of a text's shingles, sorted; a shorter text is one shingle."""
    import numpy as np

    words = text.encode("utf-8", "surrogatepass").lower().split()
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    h = np.full(n, len(words) if len(words) < width else width, np.uint64)
    for k in range(min(width, len(words))):
        h = stirred(h * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n])
    return np.unique(h)


def majority(hashes) -> int:
    """The 64-bit SimHash fingerprint of distinct shingles, as a signed number."""
    import numpy as np

    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")[0])


def parity(hashes):
    """512 bits, each telling whether an odd number of the hashes fall on it, as signed 64-bit words.

    A shingle that only one of two texts has changes one bit, so the bits of two
    texts differ in no more places than their shingles do.
    """
    import numpy as np

    place = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 9)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=64 * PARITY_WORDS) & 1, bitorder="little").view("<i8")


def frequent_shingles(texts: DataFrame, s: Sketches):
    """The shingles in three or more of the sampled texts, sorted, and in how many they are: at most s.frequent, the most frequent ones."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            found = [shingle_hashes(t.as_py(), s.wide, known) for t in b.column(0)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["shingle"])

    some = texts.where(F.pmod("key", F.lit(s.sampled)) == 0).dropDuplicates(["key"]).select("text")
    counts = short_batches(some).mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2")
    got = counts.orderBy(F.desc("n"), "shingle").limit(s.frequent).toArrow()
    shingles, n = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(shingles)
    return shingles[order], n[order]


def sketched(texts: DataFrame, s: Sketches) -> DataFrame:
    """key, n (shingles), rarest (the first of them in the order of all texts), fp (SimHash) and the parity words of key and text.

    Two sets of a Jaccard similarity of at least t have t of the larger one's
    elements in common, so the first n - ceil(t n) + 1 of each, in any one
    order, have an element in common. Rare shingles come first.
    """
    known = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        shingles, counts = known.value
        words = WordHashes()
        for b in batches:
            n, rarest, fp, bits = [], [], [], []
            for t in b.column(1):
                h = shingle_hashes(t.as_py(), s.wide, words)
                n.append(len(h))
                fp.append(majority(h))
                bits.append(parity(h))
                first = len(h) - int(np.ceil(s.similarity * len(h) - 1e-6)) + 1
                if len(shingles):
                    at = np.minimum(np.searchsorted(shingles, h), len(shingles) - 1)
                    h = h[np.argsort(np.where(shingles[at] == h, counts[at], 0), kind="stable")]
                rarest.append(h[:first].view(np.int64))
            words_of_bits = np.array(bits, np.int64).reshape(-1, PARITY_WORDS)
            columns = [b.column(0), pa.array(n, pa.int32()), pa.array(rarest, pa.list_(pa.int64())), pa.array(fp, pa.int64()), *(pa.array(np.ascontiguousarray(words_of_bits[:, i])) for i in range(PARITY_WORDS))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "rarest", "fp", *PARITY])

    return short_batches(texts).mapInArrow(run, "key long, n int, rarest array<long>, fp long, " + ", ".join(f"{p} long" for p in PARITY))


def shared_shingles(sketches: DataFrame) -> DataFrame:
    """shingle, key, i (its place in the order) and n of the rarest shingles that two or more texts have."""
    each = sketches.select("key", "n", F.posexplode("rarest").alias("i", "shingle"))
    held = sketches.select(F.explode("rarest").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("texts")).where("texts > 1")
    return each.join(held, "shingle", "left_semi").select("shingle", "key", "i", "n")


def may_be_near(s: Sketches) -> Column:
    """Whether two texts (na, ia; nb, ib) can be near if the shingle is the first that they have in common.

    From there on they have at most the shorter rest in common, and similar
    texts have t / (1 + t) of both sizes. A near pair passes at its first one.
    """
    rest = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    return rest + F.lit(1e-6) >= (F.col("na") + F.col("nb")) * F.lit(s.similarity / (1 + s.similarity))


def few_apart(s: Sketches) -> Column:
    """Whether the parity bits of two texts (na, nb) differ in no more places than near texts' shingles do."""
    apart = None
    for p in PARITY:
        here = F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b")))
        apart = here if apart is None else apart + here
    return apart <= (F.col("na") + F.col("nb")) * F.lit((1 - s.similarity) / (1 + s.similarity)) + F.lit(1e-6)


def bits_of(sketches: DataFrame, side: str) -> DataFrame:
    return sketches.select(F.col("key").alias(side), F.col("n").alias(f"n{side}"), *[F.col(p).alias(f"{p}_{side}") for p in PARITY])


def ball_pairs(sketches: DataFrame, s: Sketches) -> DataFrame:
    """Pairs (a, b) of texts whose SimHash fingerprints are equal or linked through balls: each fingerprint's smallest key stands for it."""
    distinct = cut(sketches.groupBy("fp").agg(F.min("key").alias("first")))
    own = sketches.join(distinct, "fp").where(F.col("key") != F.col("first")).select(F.col("first").alias("a"), F.col("key").alias("b"))
    linked = links(distinct, s.radius)
    firsts = distinct.select("fp", "first")
    across = linked.join(firsts.toDF("a", "first_a"), "a").join(firsts.toDF("b", "first_b"), "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    return own.union(across)


def star(shared: DataFrame, labels: DataFrame | None, turn: int, s: Sketches) -> DataFrame:
    """Distinct pairs (a, b) of each text and one text that has the shingle, where they are not in one component yet.

    Which text it is changes with the shingle and the turn.
    """
    of = F.col("key") if labels is None else F.coalesce("label", "key")
    told = (shared if labels is None else shared.join(labels, shared.key == labels.node, "left")).select("shingle", "key", "i", "n", of.alias("of"))
    centre = told.groupBy("shingle").agg(F.min(F.struct(F.xxhash64("shingle", "key", F.lit(turn)).alias("h"), "key", "i", "n", "of")).alias("c"))
    both = told.join(centre, "shingle").where((F.col("of") != F.col("c.of")) & (F.col("key") != F.col("c.key")))
    pairs = both.select("key", F.col("c.key").alias("other"), F.col("i").alias("ia"), F.col("n").alias("na"), F.col("c.i").alias("ib"), F.col("c.n").alias("nb")).where(may_be_near(s))
    return pairs.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def all_pairs(shared: DataFrame, labels: DataFrame, sketches: DataFrame, s: Sketches) -> DataFrame:
    """Distinct pairs (a, b), a < b, of all texts that have a shingle in common, may be near by both bounds and are not in one component yet."""
    told = cut(shared.join(labels, shared.key == labels.node, "left").select("shingle", "key", "i", "n", F.coalesce("label", "key").alias("of")))
    several = told.groupBy("shingle").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low < high").select("shingle")
    mixed = cut(told.join(several, "shingle", "left_semi").join(sketches.select("key", *PARITY), "key"))
    a, b = (mixed.select("shingle", F.col("key").alias(x), F.col("i").alias(f"i{x}"), F.col("n").alias(f"n{x}"), F.col("of").alias(f"of_{x}"), *[F.col(p).alias(f"{p}_{x}") for p in PARITY]) for x in "ab")
    met = a.join(b, (a.shingle == b.shingle) & (a.a < b.b) & (a.of_a != b.of_b) & may_be_near(s) & few_apart(s))
    return met.select("a", "b").distinct()


def verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, s: Sketches, size: int = 0) -> DataFrame:
    """The pairs that are near: the parity bits turn down most others, the shingles of both texts decide. size: as release takes it."""
    left = cut(pairs.join(bits_of(sketches, "a"), "a").join(bits_of(sketches, "b"), "b").where(few_apart(s)).select("a", "b").distinct())
    release(left.sparkSession, size)  # of the shuffles of the pairs, before the texts travel
    if left.isEmpty():
        return left

    def jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known = WordHashes()
        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = shingle_hashes(x.as_py(), s.wide, known), shingle_hashes(y.as_py(), s.wide, known)
                common = len(np.intersect1d(p, q, assume_unique=True))
                near.append(common + 1e-9 >= s.similarity * (len(p) + len(q) - common))
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    asked = left.select("a").union(left.select("b")).distinct().toDF("key")
    few = asked.count() <= s.few_keys  # then only the texts that are asked for travel
    needed = texts.join(F.broadcast(asked) if few else asked, "key", "left_semi").dropDuplicates(["key"])
    told = left.join(needed.toDF("a", "text_a"), "a").join(needed.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    near = cut(short_batches(told).mapInArrow(jaccard, "a long, b long"))
    release(near.sparkSession, size)
    return near


def text_key(docs: DataFrame) -> Column:
    return F.xxhash64(text_column(docs))


def near_groups(docs: DataFrame, s: Sketches = Sketches()) -> DataFrame:
    """doc_id, key (a hash of the text) and group (the smallest key that near pairs reach) of every row of docs.

    Every two near texts come into one group. Most are linked through SimHash
    balls and, as similar texts' fingerprints may differ in more bits than a
    ball holds, through stars over their rarest shingles, each with work in
    proportion to the texts. What is still apart after these is compared with
    all that shares a rare shingle, as far as two exact bounds allow.

    Equal texts have one key and so one group. Null texts count as empty; texts
    with fewer words than a shingle are one shingle; very long ones are read
    whole; other columns are ignored. No rows give no rows.
    """
    rows = docs.select("doc_id", text_key(docs).alias("key"))
    texts = docs.select(text_key(docs).alias("key"), text_column(docs).alias("text"))
    sketches = cut(sketched(texts, s).dropDuplicates(["key"]))
    shared = cut(shared_shingles(sketches))
    size = 16 * (sketches.agg(F.sum("n")).first()[0] or 0)  # a shingle takes up about as many bytes of shuffle
    release(docs.sparkSession, size)
    labels = components(verified(ball_pairs(sketches, s).union(star(shared, None, 0, s)), sketches, texts, s, size))
    for turn in range(1, s.rounds):
        labels = merged(labels, verified(star(shared, labels, turn, s), sketches, texts, s, size))
    labels = merged(labels, verified(all_pairs(shared, labels, sketches, s), sketches, texts, s, size))
    return rows.join(labels, rows.key == labels.node, "left").select("doc_id", "key", F.coalesce("label", "key").alias("group"))


def one_of_each(docs: DataFrame, s: Sketches = Sketches()) -> DataFrame:
    """The rows of docs, all columns, of which no nearer one stays: of each group the row with the smallest id.

    Of rows that repeat an id and text one stays; a null id comes last.
    """
    id_, key = f"{OWN}id", f"{OWN}key"
    groups = near_groups(docs, s)
    stay = groups.groupBy("group").agg(F.min_by(F.struct("doc_id", "key"), F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("of")).select(F.col("of.doc_id").alias(id_), F.col("of.key").alias(key))
    keyed = docs.withColumns({key: text_key(docs), id_: F.col("doc_id")})
    # the key alone deals out the rows, so that dropping repeated rows needs no second shuffle of the texts
    same_id = (keyed[id_] == stay[id_]) | (keyed[id_].isNull() & stay[id_].isNull())
    kept = keyed.join(stay, (keyed[key] == stay[key]) & same_id, "left_semi")
    return kept.dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
