"""Lloyd's clustering with two trees.

Vectors stay in the partitions they are read in, cut into blocks of bounded
size; each block is put into a cover tree once and the trees are written to the
shared folder, row by row a block. In every round the centroids are put into a
tree of the same kind and travel to all tasks; a task walks its trees and that
one together, a level at a time. Of a node of vectors and a node of centroids
the distance of their points and their radii bound all distances between them:
a pair goes once its lower bound is above the upper bound that another centroid
gives the node. Where one centroid is left, the whole node is its own; pairs of
leaves are compared exactly, in integers. A task returns a sum for each
centroid, and the driver holds nothing but centroids.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import short_batches, stage
from corpusloom.llm.vectors import integers, matrix

#: As many centroids may travel to all tasks.
MOST_CLUSTERS = 1 << 12


@dataclass(frozen=True)
class Lloyd:
    """Clusters, rounds, components of a vector and what they are multiplied with; the prefix of the hash that picks the first centroids; vectors of a tree, the ratio of its radii from level to level, and pairs of nodes looked at together."""

    clusters: int = 8
    rounds: int = 10
    components: int = 64
    scale: int = 1024
    seed: int = 3
    block: int = 1024
    base: float = 1.3
    pairs: int = 1 << 15


class CoverTree:
    """A cover tree over the rows of vectors, written down breadth first.

    A node has a point, its members (order[low:high]) and the radius in which
    they lie about the point. With the smallest power of base that holds this
    radius, its children lie in balls of the next smaller power, their points
    are further apart than that, and the node's own point is among them. Where
    all members are equal the node is a leaf.
    """

    def __init__(self, vectors, base: float):
        import numpy as np

        x = vectors.astype(np.float64)
        squares = (x * x).sum(axis=1)
        self.order = np.arange(len(x))
        point, low, high, radius, first, count = [0], [0], [len(x)], [], [], []

        def distances(at, members):
            d = np.sqrt(np.maximum(squares[at] + squares[members] - 2 * (x[members] @ x[at]), 0))
            d[members == at] = 0
            return d

        for i, p in enumerate(point):  # grows as children are added
            members = self.order[low[i] : high[i]]
            near = distances(p, members)
            reach = near.max()
            radius.append(reach)
            first.append(len(point))
            count.append(0)
            if reach <= 0:
                continue
            ball = base ** np.floor(np.log(reach) / np.log(base))
            ball = ball / base if ball >= reach else ball
            which, centres = np.zeros(len(members), np.int64), [p]
            while near.max() > ball:
                centre = members[near.argmax()]
                d = distances(centre, members)
                which[d < near] = len(centres)
                near = np.minimum(near, d)
                centres.append(centre)
            self.order[low[i] : high[i]] = members[np.argsort(which, kind="stable")]
            ends = low[i] + np.cumsum(np.bincount(which, minlength=len(centres)))
            point += centres
            low += [low[i], *ends[:-1].tolist()]
            high += ends.tolist()
            count[-1] = len(centres)
        self.point, self.low, self.high, self.first, self.count = (np.array(v, np.int32) for v in (point, low, high, first, count))
        self.radius = np.array(radius, np.float64)


#: How a block and its tree are stored: vectors in the order of the tree, point by its place there.
PARTS = {"vectors": "i4", "point": "i4", "low": "i4", "high": "i4", "first": "i4", "count": "i4", "radius": "f8"}


def planted(id_type: T.DataType, plan: Lloyd):
    """The worker that turns rows (id, vector) into blocks."""

    def block(ids: pa.Array, vectors):
        import numpy as np

        tree = CoverTree(vectors, plan.base)
        place = np.empty(len(vectors), np.int64)
        place[tree.order] = np.arange(len(vectors))
        tree.vectors, tree.point = vectors[tree.order], place[tree.point]
        whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(tree.order)))
        return pa.RecordBatch.from_arrays([whole, *(pa.array([getattr(tree, k).astype(kind).tobytes()], pa.binary()) for k, kind in PARTS.items())], names=["ids", *PARTS])

    def run(batches):
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            while n >= plan.block:
                rows = pa.Table.from_batches(waiting)
                head, rest = rows.slice(0, plan.block), rows.slice(plan.block)
                yield block(head.column(0).combine_chunks(), matrix(head.column(1), plan.components))
                waiting, n = rest.to_batches(), n - plan.block
        if n:
            rows = pa.Table.from_batches(waiting)
            yield block(rows.column(0).combine_chunks(), matrix(rows.column(1), plan.components))

    return run, T.StructType([T.StructField("ids", T.ArrayType(id_type)), *(T.StructField(k, T.BinaryType()) for k in PARTS)])


class Block:
    """A stored block and its tree."""

    def __init__(self, row: dict, width: int):
        import numpy as np

        for k, kind in PARTS.items():
            setattr(self, k, np.frombuffer(row[k], kind))
        self.vectors = self.vectors.reshape(-1, width).astype(np.int64)


def assign(block, centroids, tree: CoverTree, most: int, seen: list | None = None):
    """The nearest centroid of each vector of the block, ties to the smaller number.

    seen, if given, gets the pairs of nodes whose distance was taken and the
    pairs of vector and centroid that were compared exactly.
    """
    import numpy as np

    x, y = block.vectors.astype(np.float64), centroids.astype(np.float64)
    slack = 1e-6 * np.sqrt(max((x * x).sum(axis=1).max(initial=0), (y * y).sum(axis=1).max(initial=0))) + 1e-9
    label = np.full(len(x), -1, np.int64)
    waiting = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while waiting:
        v, c = waiting.pop()
        starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        if len(v) > most and len(starts) > 1:
            half = starts[len(starts) // 2]
            waiting += [(v[:half], c[:half]), (v[half:], c[half:])]
            continue
        d = np.sqrt(((x[block.point[v]] - y[tree.point[c]]) ** 2).sum(axis=1))
        if seen is not None:
            seen[0] += len(v)
        upper = np.minimum.reduceat(d, starts) + block.radius[v[starts]] + slack
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(v)]))
        stay = d - block.radius[v] - tree.radius[c] - slack <= upper[group]
        v, c = v[stay], c[stay]
        starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(v)]))
        c_leaf = tree.count[c] == 0
        alone = (np.bincount(group) == 1)[group] & c_leaf & (tree.high[c] - tree.low[c] == 1)
        for node, centroid in zip(v[alone].tolist(), tree.order[tree.low[c[alone]]].tolist(), strict=True):
            label[block.low[node] : block.high[node]] = centroid
        leaves = (block.count[v] == 0) & np.logical_and.reduceat(c_leaf, starts)[group] & ~alone
        exactly(block, centroids, tree, v[leaves], c[leaves], label, most, seen)
        open_ = ~alone & ~leaves
        if open_.any():
            waiting.append(children(block, tree, v[open_], c[open_]))
    return label


def children(block, tree, v, c):
    """The pairs of the children of both nodes of each pair; a leaf stands for itself. Pairs of one node of vectors stay together."""
    import numpy as np

    many_v, many_c = np.maximum(block.count[v], 1).astype(np.int64), np.maximum(tree.count[c], 1).astype(np.int64)
    both = many_v * many_c
    pair = np.repeat(np.arange(len(v)), both)
    number = np.arange(len(pair)) - np.repeat(np.cumsum(both) - both, both)
    child_v = np.where(block.count[v][pair] > 0, block.first[v][pair] + number // many_c[pair], v[pair])
    child_c = np.where(tree.count[c][pair] > 0, tree.first[c][pair] + number % many_c[pair], c[pair])
    order = np.argsort(child_v, kind="stable")
    return child_v[order], child_c[order]


def exactly(block, centroids, tree, v, c, label, most: int, seen) -> None:
    """Compare all members of leaf v with all of leaf c, pair by pair of leaves, in integers."""
    import numpy as np

    starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
    numbers = [np.concatenate([tree.order[tree.low[i] : tree.high[i]] for i in part]) for part in np.split(c, starts[1:])] if len(v) else []
    vector, centroid = [], []

    def taken():
        a, b = np.concatenate(vector), np.concatenate(centroid)
        d = ((block.vectors[a] - centroids[b]) ** 2).sum(axis=1)
        order = np.lexsort((b, d, a))
        best = order[np.r_[True, a[order][1:] != a[order][:-1]]]
        label[a[best]] = b[best]
        vector.clear()
        centroid.clear()

    size = 0
    for node, own in zip(v[starts].tolist(), numbers, strict=True):
        step = max(1, most // len(own))
        for low in range(int(block.low[node]), int(block.high[node]), step):
            members = np.arange(low, min(low + step, int(block.high[node])))
            vector.append(np.repeat(members, len(own)))
            centroid.append(np.tile(own, len(members)))
            size += len(vector[-1])
            if seen is not None:
                seen[1] += len(vector[-1])
            if size >= most:
                taken()
                size = 0
    if vector:
        taken()


def summed(centroids, plan: Lloyd):
    """The worker of a round: for each centroid the number and the sum of its vectors, once a task."""

    def run(batches):
        import numpy as np

        tree = CoverTree(centroids, plan.base)
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for row in batch.select(list(PARTS)).to_pylist():
                block = Block(row, plan.components)
                label = assign(block, centroids, tree, plan.pairs)
                order = np.argsort(label, kind="stable")
                starts = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]])
                own = label[order][starts]
                n[own] += np.diff(np.r_[starts, len(label)])
                sums[own] += np.add.reduceat(block.vectors[order], starts, axis=0)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(there, pa.int32()), "n": pa.array(n[there], pa.int64()), "sums": pa.array(list(sums[there]), pa.list_(pa.int64()))})

    return run


def moved(blocks: DataFrame, centroids, plan: Lloyd):
    """The centroids after a round; those without a vector stay where they are."""
    import numpy as np

    parts = short_batches(blocks).mapInArrow(summed(centroids, plan), "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "part")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for r in each.collect():  # clusters x components rows
        out[r.cluster, r.dim] = int(r.total) // r.n
    return np.ascontiguousarray(out)


def placed(id_type: T.DataType, centroids, plan: Lloyd):
    """The last worker: each vector's centroid and squared distance."""

    def run(batches):
        tree = CoverTree(centroids, plan.base)
        for batch in batches:
            for ids, row in zip(batch.column("ids"), batch.select(list(PARTS)).to_pylist(), strict=True):
                block = Block(row, plan.components)
                label = assign(block, centroids, tree, plan.pairs)
                distance = ((block.vectors - centroids[label]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(label, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run, T.StructType([T.StructField("vec_id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])


def fit(vectors: DataFrame, plan: Lloyd = Lloyd()):
    """(vec_id, cluster and distance of each kept vector; the centroids as a matrix of integers).

    vectors: vec_id of any type and embedding; other columns are ignored,
    whatever their names. Vectors that are null, have another number of
    components, or hold null, non-finite or too large ones (vectors.SPAN) are
    left out. Rows that repeat are vectors like others, and null ids too, which
    come last in the choice of the first centroids. Of fewer vectors than
    clusters each is a first centroid; without vectors there are no rows.
    """
    import numpy as np

    if plan.clusters > MOST_CLUSTERS:
        raise ValueError(f"at most {MOST_CLUSTERS} clusters: all centroids travel to all tasks")
    whole = integers(F.col("embedding"), plan.scale)
    rows = vectors.select("vec_id", whole.alias("vector")).where(F.size("vector") == plan.components)
    id_type = rows.schema["vec_id"].dataType
    name = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(name.alias("name"), "vector").orderBy(F.asc_nulls_last("name"), "vector").limit(plan.clusters).collect()
    centroids = np.array([r.vector for r in first], np.int64).reshape(-1, plan.components)
    run, kind = planted(id_type, plan)
    blocks = stage(short_batches(rows).mapInArrow(run, kind))
    if not first:
        return vectors.sparkSession.createDataFrame([], placed(id_type, centroids, plan)[1]), centroids
    for _ in range(plan.rounds):
        centroids = moved(blocks, centroids, plan)
    run, kind = placed(id_type, centroids, plan)
    return short_batches(blocks).mapInArrow(run, kind), centroids


def clusters(vectors: DataFrame, plan: Lloyd = Lloyd()) -> DataFrame:
    """vec_id, cluster and distance with cluster_inertia, inertia (null where they need more than 64 bits) and the hash of the final centroid; odd rows as in fit."""
    assigned, centroids = fit(vectors, plan)
    assigned = stage(assigned)
    totals = {r.cluster: int(r.inertia) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}  # a row for each centroid
    fits = lambda n: n if n < 1 << 63 else None
    names = [(i, fits(totals.get(i, 0)), fits(sum(totals.values())), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    table = vectors.sparkSession.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
