"""Exact and greedy near-duplicate removal in input order."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import stats


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that spark.checkpoint.dir names, or, on a local master, in one of our own where that is unset."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage as checkpointed does, by a table: unlike a checkpoint it is compressed, and of its columns only those asked for are read."""
    path = f"{shared_folder(df.sparkSession)}/corpusloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The folder that holds the package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def short_batches(df: DataFrame) -> DataFrame:
    """Let Python workers get short batches, as texts may be long, and find this package where it is not installed."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    known = df.sparkSession.sparkContext.environment
    paths = known.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return df


#: Between the tokens of a set; no token has it.
PART = "\x1f"
#: Bits of a set's parities, and the hashes of tokens that a worker remembers.
PARITIES, REMEMBERED = 1024, 500_000


def parities(hashes) -> list[int]:
    """PARITIES bits in signed longs, each telling whether an odd number of the hashes (64 bits) fall on it: those of two sets differ in no more places than the sets do."""
    import numpy as np

    odd = np.bincount((hashes % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def differing(odd_a: Column | str, odd_b: Column | str) -> Column:
    """In how many places parities differ."""
    return sum((F.bit_count(F.get(odd_a, F.lit(i)).bitwiseXOR(F.get(odd_b, F.lit(i)))) for i in range(PARITIES // 64)), F.lit(0))


def may_be_similar(na: Column, odd_a: Column, nb: Column, odd_b: Column, jaccard: float) -> Column:
    """False only where sets of na and nb members with these parities are less similar than jaccard."""
    return (F.least(na, nb) + F.lit(1e-6) >= F.greatest(na, nb) * F.lit(jaccard)) & (differing(odd_a, odd_b) <= (na + nb) * F.lit((1 - jaccard) / (1 + jaccard)) + F.lit(1e-6))


def signed_documents(docs: DataFrame) -> DataFrame:
    """Of the tokens digest, h (SimHash, as stats.simhash64 has it) and their number n; of their set the size d, the parities p and the members t, as one text, which is smaller than an array.

    All is worked out in one reading; what is asked for later is read from the copy, column by column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known: dict[str, int] = {}
        for b in batches:
            if len(known) > REMEMBERED:
                known.clear()
            hs, ds, ps, ts = [], [], [], []
            for n, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                tokens = t.split(PART) if n else []
                members = list(dict.fromkeys(tokens))
                for x in members:
                    if x not in known:
                        known[x] = int.from_bytes(hashlib.md5(x.encode("utf-8", "surrogatepass")).digest()[:8], "big")
                hashes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
                ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                hs.append(int(np.packbits(2 * ones >= len(tokens), bitorder="little").view("<i8")[0]))
                members = [x for x in members if x]
                ds.append(len(members))
                ps.append(parities(np.fromiter(map(known.__getitem__, members), np.uint64, len(members))))
                ts.append(PART.join(members))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hs, pa.int64()), b.column(2), pa.array(ds, pa.int32()), pa.array(ps, pa.list_(pa.int64())), pa.array(ts, pa.string())], ["seq", "digest", "h", "n", "d", "p", "t"])

    rows = docs.select("seq", F.unhex(F.md5(F.array_join("tokens", " "))).alias("digest"), F.size("tokens").alias("n"), F.array_join("tokens", PART).alias("t"))
    kind = rows.schema["seq"].dataType.simpleString()
    return written(short_batches(rows).mapInArrow(run, f"seq {kind}, digest binary, h long, n int, d int, p array<long>, t string"))


def repeats(signed: DataFrame) -> DataFrame:
    """seq of the documents (seq, digest) whose tokens an earlier one has."""
    again = signed.groupBy("digest").agg(F.min("seq").alias("first"), F.count("*").alias("times")).where("times > 1")
    return signed.join(again, "digest").where(F.col("seq") > F.col("first")).select("seq")


def exact(docs: DataFrame) -> DataFrame:
    """The first document of each token sequence. Only digests and places in the order are grouped."""
    firsts = docs.select("seq", F.unhex(F.md5(F.array_join("tokens", " "))).alias("digest")).groupBy("digest").agg(F.min("seq").alias("seq"))
    return docs.join(firsts.select("seq"), "seq", "left_semi")


def blocks(bits: int) -> list[int]:
    """Masks, of which hashes that differ in at most so many bits agree under one.

    Up to three bits: any three of six blocks, so keys are of about 32 bits and
    few hashes share one by chance. Beyond that the four bands of 16 bits,
    within which such hashes are looked for.
    """
    if bits > 3:
        return [0xFFFF << (16 * i) for i in range(4)]
    edges = [0, 11, 22, 33, 44, 54, 64]
    parts = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, 3)]


def as_signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def keyed(signed: DataFrame, bits: int) -> DataFrame:
    """key, seq, h and n for each key under which documents with near hashes meet, of those that share a key with another."""
    masks = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(as_signed(m)).cast("long").alias("mask")) for i, m in enumerate(blocks(bits))])).alias("m")
    keys = signed.select("seq", "h", "n", masks).select(F.xxhash64("m.i", F.col("h").bitwiseAND(F.col("m.mask"))).alias("key"), "seq", "h", "n").repartition("key")
    shared = keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    return checkpointed(keys.join(shared, "key", "left_semi"))


#: So many places of documents are sent to all tasks; more meet the documents in a shuffle.
FEW_SEQS = 500_000


def asked_for(docs: DataFrame, seqs: DataFrame) -> DataFrame:
    """The rows of docs (seq and others) that seqs (seq) names. Where these are few the others do not travel."""
    seqs = checkpointed(seqs.select("seq").distinct())
    return docs.join(F.broadcast(seqs) if seqs.count() <= FEW_SEQS else seqs, "seq", "left_semi")


def token_sets(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """seq and distinct tokens t, as one text, of the documents (signed, or with tokens) that keys (seq) names."""
    return asked_for(docs.select("seq", "t" if "t" in docs.columns else F.array_join(F.array_distinct("tokens"), PART).alias("t")), keys)


def passing(pairs: DataFrame, bits: int, length_ratio: float) -> DataFrame:
    """(a, b) of pairs (a, ha, na, b, hb, nb) whose hashes and lengths are near."""
    alike = F.least("na", "nb").cast("double") / F.greatest("na", "nb") >= length_ratio
    return pairs.where((stats.hamming(F.col("ha"), F.col("hb")) <= bits) & alike).select("a", "b").distinct()


def of_similar_tokens(pairs: DataFrame, signed: DataFrame, jaccard: float) -> DataFrame:
    """Those of pairs (a, b) whose token sets are near. Sets travel only for pairs that sizes and parities leave."""
    x, y = signed.select("seq", "d", "p").toDF("a", "da", "pa"), signed.select("seq", "d", "p").toDF("b", "db", "pb")
    alike = may_be_similar(F.col("da"), F.col("pa"), F.col("db"), F.col("pb"), jaccard)
    left = checkpointed(pairs.join(x, "a").join(y, "b").where(alike).select("a", "b"))
    sets = token_sets(signed, left.select(F.col("a").alias("seq")).union(left.select("b")))
    both = left.join(sets.toDF("a", "ta"), "a").join(sets.toDF("b", "tb"), "b")
    ta, tb = (F.array_remove(F.split(c, PART), "") for c in ("ta", "tb"))
    return both.where(stats.jaccard_of_sets(ta, tb) >= jaccard).select("a", "b")


def all_near(keys: DataFrame, signed: DataFrame, jaccard: float, bits: int, length_ratio: float) -> DataFrame:
    """All near pairs (a before b) of documents in keyed rows."""
    x, y = keys.toDF("key", "a", "ha", "na"), keys.toDF("key", "b", "hb", "nb")
    return of_similar_tokens(passing(x.join(y, "key").where("a < b"), bits, length_ratio), signed, jaccard)


def near_pairs(docs: DataFrame, jaccard: float = 0.92, bits: int = 3, length_ratio: float = 0.85) -> DataFrame:
    """Pairs (a, b), a before b, whose SimHashes differ in few bits and share a band of 16, and that pass the tests of length and tokens.

    All pairs of a family are among them: to drop documents use survivors.
    """
    signed = signed_documents(docs)
    return all_near(keyed(signed, bits), signed, jaccard, bits, length_ratio)


#: Pairs that share a key, for each document: from so few on all are looked at; so do they if a round drops a smaller share than this of the open documents.
FEW_PAIRS, LEAST_DROPPED = 4, 0.1


def near_earlier(signed: DataFrame, jaccard: float = 0.92, bits: int = 3, length_ratio: float = 0.85) -> DataFrame:
    """seq of the documents near to an earlier survivor among those that signed, as signed_documents gives it, has.

    In each round a document that is the first of all its keys stays: nothing
    before it is open any more, and what stayed before was compared with it.
    Those that share a key with it are compared with it alone, and go if they
    are near. A family costs a comparison for each of its documents so. When few
    pairs share a key, or few of those that do are near, all pairs that do are
    compared, and the rest is settled from those that are near.
    """
    keys, total = keyed(signed, bits), max(1, signed.count())
    gone = None
    while True:
        pairs = keys.groupBy("key").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0.0))).first()[0]
        if pairs <= FEW_PAIRS * total:
            break
        leads = keys.groupBy("key").agg(F.min(F.struct("seq", "h", "n")).alias("lead"))
        marked = checkpointed(keys.join(leads, "key"))
        open_ = checkpointed(marked.groupBy("seq").agg(F.bool_and(F.col("lead.seq") == F.col("seq")).alias("first")))
        stay = open_.where("first").select("seq")
        met = marked.where(F.col("lead.seq") < F.col("seq")).select(F.col("lead.seq").alias("a"), F.col("lead.h").alias("ha"), F.col("lead.n").alias("na"), F.col("seq").alias("b"), F.col("h").alias("hb"), F.col("n").alias("nb"))
        met = met.join(stay.withColumnRenamed("seq", "a"), "a", "left_semi")
        near = checkpointed(of_similar_tokens(passing(met, bits, length_ratio), signed, jaccard).select(F.col("b").alias("seq")).distinct())
        gone = near if gone is None else gone.unionByName(near)
        keys = checkpointed(keys.join(stay.unionByName(near), "seq", "left_anti").select("key", "seq", "h", "n"))
        if near.count() < LEAST_DROPPED * open_.count():
            break
    last = greedy_dropped(all_near(keys, signed, jaccard, bits, length_ratio))
    return last if gone is None else gone.unionByName(last)


def survivors(docs: DataFrame, jaccard: float = 0.92, bits: int = 3, length_ratio: float = 0.85) -> DataFrame:
    """docs without those near to an earlier survivor."""
    return docs.join(near_earlier(signed_documents(docs), jaccard, bits, length_ratio), "seq", "left_anti")


def greedy_survivors(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """docs without those near to an earlier survivor, pairs (a before b) being all that are near."""
    return docs.join(greedy_dropped(pairs), "seq", "left_anti")


def greedy_dropped(pairs: DataFrame) -> DataFrame:
    """seq of the documents near to an earlier one that stays.

    A document whose earlier neighbours are all dropped is kept; one with a
    kept earlier neighbour is dropped; rounds go on until all are settled.
    """
    pairs = checkpointed(pairs)
    state = checkpointed(pairs.select(F.col("b").alias("seq")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        # a document without an earlier neighbour is not in state and is kept
        known = pairs.join(state.select(F.col("seq").alias("a"), "kept", F.lit(True).alias("open")), "a", "left").select("b", F.when(F.col("open").isNull(), F.lit(True)).otherwise(F.col("kept")).alias("kept_a"))
        told = known.groupBy("b").agg(F.bool_or("kept_a").alias("any_kept"), F.count_if(F.col("kept_a").isNull()).alias("unknown"))
        new = state.join(told, state.seq == told.b).select("seq", F.coalesce("kept", F.when(F.coalesce("any_kept", F.lit(False)), F.lit(False)).when(F.col("unknown") == 0, F.lit(True))).alias("kept"))
        new = checkpointed(new)
        left, before = (x.agg(F.count_if(F.col("kept").isNull())).first()[0] for x in (new, state))
        state = new
        if not left or left == before:
            break
    return state.where(~F.col("kept")).select("seq")


def deduplicate(docs: DataFrame, jaccard: float = 0.92, bits: int = 3) -> DataFrame:
    """docs without repeats, and without those near to an earlier survivor."""
    _, again, near = dropped(docs, jaccard, bits)
    return docs.join(again.unionByName(near), "seq", "left_anti")


def dropped(docs: DataFrame, jaccard: float = 0.92, bits: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """seq of all documents, of the repeats, and of those near to an earlier survivor."""
    signed = signed_documents(docs)
    again = checkpointed(repeats(signed))
    near = checkpointed(near_earlier(signed.join(again, "seq", "left_anti"), jaccard, bits))
    return signed.select("seq"), again, near


def statistics(before: DataFrame, distinct: DataFrame, after: DataFrame) -> DataFrame:
    """metric and value: how many documents there were, were dropped and stay."""
    counts = before.agg(F.count("*").alias("b")).join(distinct.agg(F.count("*").alias("e"))).join(after.agg(F.count("*").alias("a")))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in (("before", F.col("b")), ("exact_removed", F.col("b") - F.col("e")), ("near_removed", F.col("e") - F.col("a")), ("after", F.col("a")))])
    return counts.select(F.inline(rows))
