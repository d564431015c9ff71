"""Best-fit packing by sums of squares.

A document goes where the sum, over all residual gaps, of the squared counts of
open sequences with that gap becomes smallest; a perfect fit closes a sequence.
Documents come longest first, and a new sequence is opened only for one that no
open sequence takes.

Only lengths matter to the choice, so texts never travel: documents become
pieces where they are read, and the pieces (a few numbers each) are dealt into
groups of bounded size that are packed independently.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import short_batches, text_column
from corpusloom.llm.word_bpe import MEMO_ENTRIES, word_bpe

PIECE = "piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Plan:
    """Tokens of a sequence, the id after each document, about how many pieces a group has, and chunks of text that a worker remembers."""

    capacity: int = 2048
    end_id: int = 0
    group_pieces: int = 16_384
    memo_entries: int = MEMO_ENTRIES


def pieces(docs: DataFrame, tokenizer_path: str, plan: Plan) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_bpe(tokenizer_path, plan.memo_entries)
        end = plan.end_id.to_bytes(4, "little")
        for b in batches:
            rows, at = [], []
            for i, ids in enumerate(own.encode_all(b.column(1).to_pylist())):
                ids += end
                for n, start in enumerate(range(0, len(ids) // 4, plan.capacity)):
                    part = ids[4 * start : 4 * (start + plan.capacity)]
                    rows.append((n, start, len(part) // 4, zlib.crc32(part)))
                    at.append(i)
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return short_batches(docs).select("doc_id", text_column(docs).alias("text")).mapInArrow(run, f"doc_id {id_type}, {PIECE}")


def sum_of_squares(lengths, capacity: int):
    """The sequence (from 0) of each length, in the order given, and how many sequences there are.

    Of the open sequences that take a piece, one whose gap makes the squared
    counts smallest gets it; a new sequence is opened only if none takes it.
    """
    import numpy as np

    counts = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    where: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, used = np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        there = counts[size:capacity]  # gaps from size on
        if there.any():
            # gap g becomes g - size: (n[g] - 1)^2 + (n[g - size] + 1)^2 - n[g]^2 - n[g - size]^2
            change = 2 * (counts[: capacity - size] - there + 1)
            change[0] = 1 - 2 * there[0]  # a full sequence has no gap to count
            change[there == 0] = 1 << 40
            gap = size + int(change.argmin())
            bin_ = where[gap].pop()
            counts[gap] -= 1
        else:
            bin_, gap, used = used, capacity, used + 1
        out[i] = bin_
        if gap > size:
            where[gap - size].append(bin_)
            counts[gap - size] += 1
    return out, used


def packed(lengths, capacity: int):
    """The sequence of each length, longest first, and how many sequences there are."""
    import numpy as np

    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    bins[order], n = sum_of_squares(lengths[order], capacity)
    return bins, n


def pack(docs: DataFrame, tokenizer_path: str, plan: Plan = Plan()) -> DataFrame:
    """The pieces of all documents with sequence_id and offset.

    docs: doc_id and text; other columns are ignored, whatever their names. A
    document is its ids and the end id; only documents longer than a sequence
    are cut. Null and empty texts are one piece of one id. Rows that repeat an
    id are packed each. No rows give no pieces.
    """
    n = docs.count()
    groups = max(1, round(n / plan.group_pieces))
    dealt = pieces(docs, tokenizer_path, plan).withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))

    def run(group: pa.Table) -> pa.Table:
        import numpy as np

        group = group.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])  # the same at every attempt
        lengths = group.column("length").to_numpy()
        bins, _ = packed(lengths, plan.capacity)
        offsets = np.empty(len(bins), np.int64)
        by_bin = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[by_bin])
        starts = ends - lengths[by_bin]
        first = np.r_[True, bins[by_bin][1:] != bins[by_bin][:-1]]
        offsets[by_bin] = starts - np.maximum.accumulate(np.where(first, starts, 0))
        number = (group.column("deal")[0].as_py() << 40) + bins
        return group.drop_columns(["deal"]).append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("deal").applyInArrow(run, f"doc_id {id_type}, {PIECE}, sequence_id long, offset long")
