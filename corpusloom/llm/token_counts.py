"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a text form a linked list; a heap holds every adjacent pair
whose concatenation is a piece, keyed by rank and then by position. The lowest
pair is popped, merged if it is still intact, and its two new neighbours are
pushed. The count is the number of initial symbols minus the merges (a symbol
left that is no piece counts as its UTF-8 bytes); identifiers are never made.

No piece has a space mark after another character, so a text can be cut in
front of every run of space marks, and around characters that no longer piece
holds; equal chunks are merged once and remembered.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import short_batches, text_column

#: Chunks that a worker remembers before it starts anew, and the longest of them.
MEMO_ENTRIES = 700_000
MEMO_CHARS = 64
SPACE = "▁"


class PieceCounter:
    """Counts of the pieces that a byte-pair sentencepiece model gives."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.rank[model.id_to_piece(i)] = -model.get_score(i)
        if any(SPACE in piece.lstrip(SPACE) for piece in self.rank):
            raise ValueError("the model has pieces across words")
        joined = {c for piece in self.rank if len(piece) > 1 for c in piece}
        lone = "".join(c for c in "\n\t\r" if c not in joined)
        self.chunks = re.compile(f"[{lone}]|{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" if lone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.memo: dict[str, int] = {}

    def merged(self, chunk: str) -> int:
        rank = self.rank
        symbols: list[str] = list(chunk)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                heap.append((rank[pair], i, pair))
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != pair:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = pair, ""
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (new := pair + symbols[k]) in rank:
                    heapq.heappush(heap, (rank[new], i, new))
            if (h := before[i]) >= 0 and (new := symbols[h] + pair) in rank:
                heapq.heappush(heap, (rank[new], h, new))
        for s in symbols:
            if s and s not in rank:
                left += len(s.encode()) - 1
        return left

    def count(self, text: str) -> int:
        if not text:
            return 0
        memo, total = self.memo, 0
        for chunk in self.chunks.findall(SPACE + text.replace(" ", SPACE)):
            n = memo.get(chunk)
            if n is None:
                n = self.merged(chunk)
                if len(chunk) <= MEMO_CHARS:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[chunk] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Tokens of every text, one row for each row of docs.

    docs: doc_id and text; other columns are ignored, whatever their names.
    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null
    ids stay as they are; no rows give no rows. Texts are never cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for b in batches:
            counts = pa.array([own.count(t) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), counts], ["doc_id", "n_bytes", "n_tokens"])

    text = text_column(docs)
    given = short_batches(docs).select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counted = given.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
