"""Exact top-k search by columnar branch-and-bound.

Vectors are kept in vertical layout, a row for each dimension. A query
accumulates inner products block of dimensions by block, those that hold most
of its own mass first; what the remaining dimensions can still add is bounded
by the remaining masses of both sides (Cauchy-Schwarz). Candidates whose upper
bound falls below the k-th best lower bound are dropped and the survivors
compacted. Each query starts with a threshold, its k-th best among a bounded
number of seed rows, and carries it to every block of candidates.

Queries and candidates are dealt into blocks of bounded size and every pair of
blocks is searched by one task; each leaves k rows for a query. A candidate
travels once for each block of queries, a query once for each block of
candidates, so larger blocks mean less traffic for the same search.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUT = "query_key long, query_id long, vec_id long, score long, times long"


@dataclass(frozen=True)
class Blocks:
    """Rows of a block of queries and of candidates, dimensions of a block, and seed rows."""

    queries: int = 16_384
    candidates: int = 16_384
    dimensions: int = 8
    seeds: int = 2_048


def integers(vector: Column) -> Column:
    """floor(256 x) of every component, as long; null if the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def best(query, vertical, mass, k: int, width: int, floor: float = float("-inf"), alive_by_block: list | None = None):
    """Places and inner products of the k best columns of vertical, ties at the k-th place included.

    mass: the sum of squares of each column. floor: a score that the k-th best
    is known to reach. Dimensions come in the order of the query's own mass, so
    that little of it remains after the first blocks. alive_by_block, if given,
    gets the share of the columns that are left after each block.
    """
    import numpy as np

    order = np.argsort(-np.abs(query), kind="stable")
    own = np.sqrt(np.append(np.cumsum((query[order].astype(np.float64) ** 2)[::-1])[::-1], 0.0))
    n = vertical.shape[1]
    alive, partial, rest = np.arange(n), np.zeros(n, np.int64), mass
    for start in range(0, len(query), width):
        stop = min(start + width, len(query))
        at = order[start:stop]
        part = vertical[at] if len(alive) == n else vertical[at[:, None], alive]
        partial = partial + query[at] @ part
        if stop < len(query) and len(alive) > k:
            rest = rest - (part.astype(np.float64) ** 2).sum(axis=0)
            most = own[stop] * np.sqrt(np.maximum(rest, 0)) * (1 + 1e-9) + 1e-6
            least = max(floor, np.partition(partial - most, -k)[-k])
            stay = partial + most >= least
            alive, partial, rest = alive[stay], partial[stay], rest[stay]
        if alive_by_block is not None:
            alive_by_block.append(len(alive) / n)
    if len(alive) > k:
        stay = partial >= np.partition(partial, -k)[-k]
        alive, partial = alive[stay], partial[stay]
    return alive, partial


def matrix(rows: pa.Table):
    """The vectors of rows, one a line, as 64-bit integers."""
    import numpy as np

    flat = rows.column("vector").combine_chunks().flatten().to_numpy()
    return flat.reshape(rows.num_rows, -1).astype(np.int64, copy=False)


def floors(vectors, keys, seed, seed_keys, k: int):
    """For each query a score that its k-th best reaches: the k-th best among the seed rows but its own."""
    import numpy as np

    if len(seed) <= k or vectors.shape[1] != seed.shape[1]:
        return np.full(len(vectors), -np.inf)
    out = []
    for s in range(0, len(vectors), 512):
        scores = (vectors[s : s + 512] @ seed.T).astype(np.float64)
        scores[keys[s : s + 512, None] == seed_keys] = -np.inf
        out.append(np.partition(scores, -k, axis=1)[:, -k])
    return np.concatenate(out)


def searched(k: int, width: int, seeds):
    """seeds: a broadcast of (vectors, keys) by number of dimensions."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        import numpy as np

        out: dict[str, list] = {"query_key": [], "query_id": [], "vec_id": [], "score": [], "times": []}
        if queries.num_rows and candidates.num_rows:
            candidates = candidates.sort_by([("vec_id", "ascending")])
            keys, ids, times = (candidates.column(c).to_numpy() for c in ("row_key", "vec_id", "times"))
            vertical = np.ascontiguousarray(matrix(candidates).T)
            mass = (vertical.astype(np.float64) ** 2).sum(axis=0)
            asked, asked_keys = matrix(queries), queries.column("row_key").to_numpy()
            seed = seeds.value.get(asked.shape[1])
            known = floors(asked, asked_keys, *seed, k) if seed else np.full(len(asked), -np.inf)
            for key, query_id, vector, floor in zip(asked_keys.tolist(), queries.column("vec_id").to_pylist(), asked, known.tolist(), strict=True):
                at, score = best(vector, vertical, mass, k + 1, width, floor)  # one more: the query's own row may be among them
                left = k
                for i in np.lexsort((ids[at], -score)).tolist():
                    n = int(times[at[i]]) - (int(keys[at[i]]) == key)
                    if n > 0 and left > 0:
                        n = min(n, left)
                        left -= n
                        for name, value in zip(out, (key, query_id, int(ids[at[i]]), int(score[i]), n), strict=True):
                            out[name].append(value)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def seed_rows(rows: DataFrame, most: int) -> dict:
    """(vectors, keys) of at most so many rows, by number of dimensions: a bounded start for the thresholds."""
    import numpy as np

    got = rows.select("dims", "row_key", "vector").orderBy("row_key").limit(most).toArrow()
    dims = got.column("dims").to_numpy()
    out = {}
    for d in np.unique(dims).tolist():
        own = got.filter(pa.array(dims == d))
        out[d] = (matrix(own), own.column("row_key").to_numpy())
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, blocks: Blocks = Blocks()) -> DataFrame:
    """query_id, rank, vec_id and score: the k best candidates of every query row, ties to the smaller vec_id.

    vectors: vec_id and embedding; other columns are ignored, whatever their
    names. Candidates are all rows but the query's own. Rows whose id is null,
    or whose vector is null or holds null or non-finite components, take no
    part; vectors are compared with those of their own length. Rows equal in id
    and vector are each a candidate and each a query, so they return as often
    as they repeat. No rows give no rows.
    """
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("vector"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    rows = whole.groupBy("vec_id", "vector", "asks").agg(F.count("*").alias("times")).withColumn("row_key", F.xxhash64("vec_id", "vector")).withColumn("dims", F.size("vector"))
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    seeds = vectors.sparkSession.sparkContext.broadcast(seed_rows(rows, blocks.seeds))
    candidate_blocks, query_blocks = max(1, -(-n // blocks.candidates)), max(1, -(-asking // blocks.queries))
    deal = lambda n: F.pmod(F.xxhash64("row_key"), F.lit(n))
    columns = ("row_key", "vec_id", "vector", "times")
    asked = rows.where("asks").select(*columns, "dims", deal(query_blocks).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(candidate_blocks - 1))).alias("c"))
    all_rows = rows.select(*columns, "dims", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), deal(candidate_blocks).alias("c"))
    asked, all_rows = (x.withColumns({"q": F.col("q").cast("int"), "c": F.col("c").cast("int")}) for x in (asked, all_rows))
    found = asked.groupBy("dims", "q", "c").cogroup(all_rows.groupBy("dims", "q", "c")).applyInArrow(searched(k, blocks.dimensions, seeds), OUT)
    copies = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    order = Window.partitionBy("query_key", "query_id").orderBy(F.desc("score"), "vec_id", "copy")
    ranked = copies.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    again = rows.where(F.col("asks") & (F.col("times") > 1)).select(F.col("row_key").alias("query_key"), F.col("times").alias("again"))
    out = ranked.join(again, "query_key", "left").withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("again", F.lit(1).cast("long")))))
    return out.select("query_id", "rank", "vec_id", "score")
