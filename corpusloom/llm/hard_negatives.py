"""Hard negatives by product quantisation with stored residual norms.

Vectors are cut into short subspaces and each part becomes the number of its
nearest codeword; beside these codes the norm of what they leave out is stored.
For an anchor a table of its products with all codewords gives an approximate
score of any row, and the anchor's norm times the row's residual norm bounds
what the score is off (Cauchy-Schwarz). The exact scores of a few promising rows
set a bar; rows whose bounds say that they cannot reach it, or lie outside the
window, are out for certain; all others are scored exactly, in integers.

Codebooks are fitted on a bounded sample, which touches the speed and never the
result. Anchors and rows are dealt into blocks of bounded size by hash, so that
a label or a vector that many rows share spreads, and every pair of blocks is
searched by one task, which returns as many rows as an anchor can use.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stage
from corpusloom.llm.vectors import integers, matrix

STORED = "row long, vec_id long, label long, times long, asks boolean, dims int, vector binary, codes binary, residual double"
FOUND = "anchor_row long, positive_score long, row long, vec_id long, score long, times long"


@dataclass(frozen=True)
class Mining:
    """Positives of an anchor and negatives of a positive; hundredths of the positive's score between which negatives lie; what components are multiplied with; components of a subspace, codewords, sampled rows and rounds of their fit; rows of a block of anchors and of candidates; rows scored exactly for the first bar."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    subspace: int = 2
    codewords: int = 256
    sample: int = 4096
    rounds: int = 6
    anchors: int = 4096
    candidates: int = 8192
    near: int = 32


def parts(vectors, width: int):
    """Vectors by subspace: (rows, subspaces, width), the last filled up with zeros."""
    import numpy as np

    short = -vectors.shape[1] % width
    return np.pad(vectors, ((0, 0), (0, short))).reshape(len(vectors), -1, width)


def nearest(points, words):
    """The number of the codeword nearest to each point."""
    scores = points.astype(float) @ words.T.astype(float)
    scores *= -2
    scores += (words.astype(float) ** 2).sum(axis=1)
    return scores.argmin(axis=1)


def codebook(vectors, plan: Mining):
    """Codewords of every subspace, integers (subspaces, codewords, width), by a few rounds of Lloyd's method."""
    import numpy as np

    rng, split = np.random.default_rng(1), parts(vectors, plan.subspace)
    books = np.zeros((split.shape[1], plan.codewords, plan.subspace), np.int64)
    for s in range(split.shape[1]):
        points = split[:, s]
        words = points[rng.permutation(np.arange(plan.codewords) % len(points))].astype(np.float64)
        for _ in range(plan.rounds):
            own = nearest(points, words)
            n = np.bincount(own, minlength=plan.codewords)
            for d in range(plan.subspace):
                sums = np.bincount(own, points[:, d], minlength=plan.codewords)
                words[n > 0, d] = sums[n > 0] / n[n > 0]
        books[s] = np.rint(words)
    return books


def codebooks(rows: DataFrame, plan: Mining) -> dict:
    """A codebook for each length of vectors in a sample of bounded size; other lengths have none, and their whole norm is residual."""
    import numpy as np

    got = rows.select("vector", F.xxhash64("vec_id", "vector").alias("h")).orderBy("h").limit(plan.sample).select("vector").toArrow().column(0).combine_chunks()
    lengths = np.diff(got.offsets.to_numpy())
    return {int(n): codebook(matrix(got.filter(pa.array(lengths == n)), int(n)), plan) for n in np.unique(lengths) if n}


def encoded(books, plan: Mining):
    """The worker that adds codes and residual norms. books: a broadcast."""

    def run(batches):
        import numpy as np

        for batch in batches:
            column = batch.column("vector")
            dims = np.diff(column.offsets.to_numpy())
            codes, residual, vectors = [b""] * len(dims), np.zeros(len(dims)), [b""] * len(dims)
            for n in np.unique(dims).tolist():
                at = np.flatnonzero(dims == n)
                own = matrix(column.take(pa.array(at)), n) if n else np.zeros((len(at), 0), np.int64)
                book, left = books.value.get(n), own
                if book is not None:
                    split = parts(own, plan.subspace)
                    code = np.stack([nearest(split[:, s], book[s]) for s in range(len(book))], axis=1)
                    left = (split - book[np.arange(len(book)), code]).reshape(len(at), -1)
                    code = code.astype(np.uint16)
                residual[at] = np.sqrt((left.astype(np.float64) ** 2).sum(axis=1))
                for k, i in enumerate(at.tolist()):
                    codes[i], vectors[i] = code[k].tobytes() if book is not None else b"", own[k].astype("<i4").tobytes()
            columns = [batch.column(c) for c in ("row", "vec_id", "label", "times", "asks")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(dims, pa.int32()), pa.array(vectors, pa.binary()), pa.array(codes, pa.binary()), pa.array(residual)], names=[c.split()[0] for c in STORED.split(", ")])

    return run


class Candidates:
    """A block of rows: exact vectors, codes and residual norms."""

    def __init__(self, rows: pa.Table, book):
        import numpy as np

        rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        self.row, self.vec_id, self.label, self.times, self.residual = (rows.column(c).to_numpy() for c in ("row", "vec_id", "label", "times", "residual"))
        self.vectors = stored(rows)
        self.book = book
        self.codes = np.ascontiguousarray(np.frombuffer(b"".join(rows.column("codes").to_pylist()), "<u2").reshape(len(self.row), -1).T) if book is not None else None
        self.rounding = 1e-12 * np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0))

    def bounds(self, anchor):
        """Approximate scores of all rows and how much they may be off."""
        import numpy as np

        approx = np.zeros(len(self.row))
        if self.book is not None:
            table = np.einsum("swd,sd->sw", self.book, parts(anchor[None], self.book.shape[2])[0]).astype(np.float64)
            for own, codes in zip(table, self.codes, strict=True):
                approx += own[codes]
        return approx, np.sqrt((anchor.astype(np.float64) ** 2).sum()) * (self.residual * (1 + 1e-9) + self.rounding) + 1e-6

    def best(self, anchor, approx, off, allowed, k: int, low: int | None, high: int | None, near: int, scored: list | None = None):
        """Places and exact scores of the k best allowed rows with scores from low to high; ties to the smaller vec_id."""
        import numpy as np

        can = allowed if low is None else allowed & (approx + off >= low) & (approx - off <= high)
        open_ = np.flatnonzero(can)
        first = open_ if high is None else open_[approx[open_] <= high]
        if len(first) > near:
            first = first[np.argpartition(-approx[first], near - 1)[:near]]
        scores = self.vectors[first] @ anchor
        scores = scores if low is None else scores[(scores >= low) & (scores <= high)]
        bar = np.partition(scores, -k)[-k] if len(scores) >= k else low
        if bar is not None:
            open_ = open_[approx[open_] + off[open_] >= bar]
        scores = self.vectors[open_] @ anchor
        if scored is not None:
            scored[0] += len(open_)
        if low is not None:
            inside = (scores >= low) & (scores <= high)
            open_, scores = open_[inside], scores[inside]
        order = np.lexsort((open_, -scores))[:k]  # rows are in the order of vec_id
        return open_[order], scores[order]


def stored(rows: pa.Table):
    import numpy as np

    return np.frombuffer(b"".join(rows.column("vector").to_pylist()), "<i4").reshape(rows.num_rows, -1).astype(np.int64)


def table_of(found: dict) -> pa.Table:
    return pa.table({c: pa.array(found[c], pa.int64()) for c in found})


def searched(books, plan: Mining, windows: bool):
    """The worker for a block of anchors and one of candidates. windows: negatives between bounds, else positives."""

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        found: dict[str, list] = {c.split()[0]: [] for c in FOUND.split(", ")}
        if not anchors.num_rows or not candidates.num_rows:
            return table_of(found)
        rows = Candidates(candidates, books.value.get(anchors.column("dims")[0].as_py()))
        scores = anchors.column("scores").to_pylist() if windows else [[None]] * anchors.num_rows
        for row, label, vector, own_scores in zip(anchors.column("row").to_pylist(), anchors.column("label").to_pylist(), stored(anchors), scores, strict=True):
            approx, off = rows.bounds(vector)
            allowed = rows.label != label if windows else (rows.row != row) | (rows.times > 1)
            for score in own_scores:
                low, high = (-(-plan.low * score // 100), plan.high * score // 100) if windows else (None, None)
                if windows and low > high:
                    continue
                at, exact = rows.best(vector, approx, off, allowed, plan.negatives if windows else plan.positives, low, high, plan.near)
                found["anchor_row"] += [row] * len(at)
                found["positive_score"] += [score] * len(at)
                found["row"] += rows.row[at].tolist()
                found["vec_id"] += rows.vec_id[at].tolist()
                found["score"] += exact.tolist()
                found["times"] += (rows.times[at] - (rows.row[at] == row)).tolist()
        return table_of(found)

    return run


def first_of(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of each group with their rank; a row that repeats counts as often as it does."""
    one = F.lit(1).cast("long")
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "row", "copy")
    copies = found.where(F.col("times") > 0).withColumn("copy", F.explode(F.sequence(one, F.least(F.col("times"), F.lit(k).cast("long")))))
    return copies.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, plan: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    vectors: vec_id, embedding and label (or what label says instead of it);
    other columns are ignored, whatever their names. Rows with a null id or
    label, a null vector, or a null, non-finite or too large component
    (vectors.SPAN) take no part. Vectors are compared with those of their own
    length (512 at most for components near SPAN). Rows that are equal in all
    three are each an anchor, a positive and a negative: an anchor's copies are
    among its positives, and its results come once for each copy. No rows give
    no rows.
    """
    label = F.col("label") if label is None else label
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), is_anchor.alias("asks"), integers(F.col("embedding"), plan.scale).alias("vector"))
    valid = whole.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    books = vectors.sparkSession.sparkContext.broadcast(codebooks(valid, plan))
    folded = valid.groupBy("vec_id", "label", "vector", "asks").agg(F.count("*").alias("times")).withColumn("row", F.monotonically_increasing_id())
    rows = stage(folded.mapInArrow(encoded(books, plan), STORED))  # written once, so that row stays what it is
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    candidate_blocks, anchor_blocks = max(1, -(-n // plan.candidates)), max(1, -(-asking // plan.anchors))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    anchors = rows.where("asks")
    asked = lambda df: df.select("*", deal(anchor_blocks).alias("a")).select("*", every(candidate_blocks).alias("c"))
    dealt = rows.toDF(*rows.columns).select("*", deal(candidate_blocks).alias("c")).select("*", every(anchor_blocks).alias("a"))
    # dealt has columns of its own: both sides of a cogroup that share some would lose them
    by_label, by_block = ["label", "dims", "a", "c"], ["dims", "a", "c"]
    near = asked(anchors).groupBy(*by_label).cogroup(dealt.groupBy(*by_label)).applyInArrow(searched(books, plan, False), FOUND)
    positives = stage(first_of(near, ["anchor_row"], plan.positives).select("anchor_row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = positives.groupBy(F.col("anchor_row").alias("row")).agg(F.collect_set("positive_score").alias("scores"))
    hard = asked(anchors.join(windows, "row")).groupBy(*by_block).cogroup(dealt.groupBy(*by_block)).applyInArrow(searched(books, plan, True), FOUND)
    negatives = first_of(hard, ["anchor_row", "positive_score"], plan.negatives).select("anchor_row", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    return positives.join(negatives, ["anchor_row", "positive_score"]).join(named, "anchor_row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
