"""Benchmark decontamination with an FM-index for each shard of the training documents.

The windows of the test items are the phrases: so many consecutive words, or all
words of a shorter item. Documents stay where they are stored; what a task reads
is cut into shards of bounded size. A shard's words become symbols, one for each
word that the phrases know; a stretch without as many known words in a row as
the shortest phrase has cannot hold a phrase and becomes a single separator,
nothing else is left out. Over these symbols stands an FM-index: suffix array,
Burrows-Wheeler transform in a wavelet tree, and suffix positions at every so
many places. All phrases are searched backwards at once, occurrences are located
by walking to the next sampled place, and the spans that they cover are merged.

Phrases are read in blocks of a checked size. Nearly every set of test items is
one block; a larger one costs a further reading of the documents for each block,
whose finds are added to those of the blocks before.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import OWN, short_batches, stage

#: Bytes of words as they are, A-Z as a-z, all others as a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Stands behind each text; no word, as FOLD leaves no such byte.
END = b"\0"
WORDS, SPANS, ITEMS = f"{OWN}words", f"{OWN}spans", f"{OWN}items"
ADDED = [T.StructField(WORDS, T.LongType()), T.StructField(SPANS, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))), T.StructField(ITEMS, T.ArrayType(T.StringType()))]
SPAN_TYPE = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


@dataclass(frozen=True)
class Sizes:
    """Words of a window; windows and bytes of a block of phrases; symbols and bytes of text of a shard; places from one sampled suffix to the next; occurrences located at once."""

    width: int = 10
    block_windows: int = 500_000
    block_bytes: int = 64 << 20
    shard_symbols: int = 1 << 20
    shard_bytes: int = 48 << 20
    sample: int = 16
    located: int = 1 << 20


def suffix_array(codes):
    """Where the suffixes of codes start, in their order: prefixes of twice the length each round, until all differ."""
    import numpy as np

    n, bits = len(codes), max(1, int(codes.max()).bit_length() + 1)
    width = max(1, min(62 // bits, n))
    key = np.zeros(n, np.int64)
    for i in range(width):
        key <<= bits
        key[: n - i] += codes[i:] + 1
    sa = np.argsort(key, kind="stable")
    slots, own, second = np.arange(n), key[sa], np.zeros(n, np.int64)
    rank = np.empty(n, np.int64)
    while True:
        first = np.r_[True, (own[1:] != own[:-1]) | (second[1:] != second[:-1])]
        rank[sa[slots]] = np.maximum.accumulate(np.where(first, slots, 0))
        slots = slots[~(first & np.r_[first[1:], True])]
        if not len(slots):
            return sa
        at = sa[slots]
        second = np.zeros(len(at), np.int64)
        inside = at + width < n
        second[inside] = rank[at[inside] + width] + 1
        own = rank[at]
        order = np.lexsort((second, own))
        sa[slots], own, second = at[order], own[order], second[order]
        width *= 2


class Bits:
    """Bits with the number of ones before any place."""

    def __init__(self, bits):
        import numpy as np

        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed[: -(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, at):
        import numpy as np

        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at):
        import numpy as np

        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletTree:
    """A wavelet tree whose levels lie one behind the other: at each, values whose bit is 0 come first."""

    def __init__(self, values, bits: int):
        import numpy as np

        self.levels = []
        for shift in range(bits - 1, -1, -1):
            ones = (values >> shift) & 1 == 1
            self.levels.append((shift, Bits(ones), int(len(values) - np.count_nonzero(ones))))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, value, at):
        """How many of the first at values are value; both are arrays."""
        import numpy as np

        low = np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            one = (value >> shift) & 1 == 1
            low_ones, at_ones = bits.rank(low), bits.rank(at)
            low, at = np.where(one, zeros + low_ones, low - low_ones), np.where(one, zeros + at_ones, at - at_ones)
        return at - low

    def get(self, at):
        import numpy as np

        value = np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            value |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return value


class FMIndex:
    """An index of symbols, where 0 separates stretches and stands at the end.

    Separators count as different symbols, smaller than all others, so that
    suffixes differ at the end of their stretch at the latest. Places behind a
    separator are sampled, so that no walk crosses one.
    """

    def __init__(self, symbols, highest: int, sample: int):
        import numpy as np

        parts = np.flatnonzero(symbols == 0)
        codes = symbols.astype(np.int64) + len(parts)
        codes[parts] = np.arange(len(parts))
        sa = suffix_array(codes)
        self.n = len(symbols)
        self.below = np.r_[0, np.cumsum(np.bincount(symbols, minlength=highest + 1))]
        self.tree = WaveletTree(symbols[sa - 1].astype(np.int64), max(1, highest.bit_length()))
        marked = (sa % sample == 0) | (symbols[sa - 1] == 0)
        self.marked, self.places = Bits(marked), sa[marked]

    def search(self, phrases, lengths):
        """The first row of each phrase's suffixes and the row behind the last: words are taken from the last one backwards."""
        import numpy as np

        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        active = np.arange(len(lengths))
        for i in range(1, int(lengths.max(initial=0)) + 1):
            active = active[(lengths[active] >= i) & (low[active] < high[active])]
            c = phrases[active, lengths[active] - i].astype(np.int64)
            ranks = self.tree.rank(np.r_[c, c], np.r_[low[active], high[active]])
            low[active], high[active] = self.below[c] + ranks[: len(c)], self.below[c] + ranks[len(c) :]
        return low, high

    def locate(self, rows):
        """The places in the text where the suffixes of these rows start."""
        import numpy as np

        places, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(at):
            there = self.marked.get(rows)
            places[at[there]] = self.places[self.marked.rank(rows[there])] + steps
            at, rows, steps = at[~there], rows[~there], steps + 1
            c = self.tree.get(rows)
            rows = self.below[c] + self.tree.rank(c, rows)
        return places


def coded(texts, symbols: dict, most: int = 4 << 20):
    """The symbols of all words of texts (0: none), -1 behind each text; words are made for a few MB at once."""
    import numpy as np

    out, waiting, size = [], [], 0

    def taken():
        words = b" ".join(waiting).split()
        waiting.clear()
        out.append(np.fromiter(map(symbols.get, words, repeat(0)), np.int32, len(words)))

    for text in texts:
        text, at = text.translate(FOLD), 0
        while len(text) - at > most and (stop := text.find(b" ", at + most)) >= 0:
            waiting.append(text[at:stop])
            taken()
            at = stop
        waiting += [text[at:], END]
        size += len(text) - at
        if size >= most:
            taken()
            size = 0
    taken()
    return np.concatenate(out)


def stretches(words, shortest: int):
    """What of words can hold a phrase, a 0 behind each stretch, and the places that this has there."""
    import numpy as np

    breaks = np.r_[-1, np.flatnonzero(words <= 0)]
    long = np.flatnonzero(np.diff(breaks) > shortest)
    change = np.zeros(len(words) + 1, np.int32)
    change[breaks[long] + 1] += 1
    change[breaks[long + 1] + 1] -= 1
    places = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    return np.maximum(words[places], 0), places


def cover(text, known: dict, sizes: Sizes):
    """Which symbols of text lie in a phrase, and (place, phrase) of every occurrence, a part at a time."""
    import numpy as np

    index = FMIndex(text, known["highest"], sizes.sample)
    low, high = index.search(known["phrases"], known["lengths"])
    found = np.flatnonzero(low < high)
    ends = np.cumsum(high[found] - low[found])
    for start in range(0, int(ends[-1]) if len(ends) else 0, sizes.located):
        number = np.arange(start, min(start + sizes.located, int(ends[-1])))
        which = np.searchsorted(ends, number, side="right")
        phrase = found[which]
        yield index.locate(high[phrase] - (ends[which] - number)), phrase


def searched(phrases, sizes: Sizes, text_at: int, keep_text: bool, added: bool):
    """The worker: a broadcast of phrases meets the documents of one task, a shard at a time. added: the columns of an earlier block are there and are added to."""

    def finds(shard, known):
        """Merged spans by (batch, first word, word behind the last) and distinct (batch, row, item) of a shard."""
        import numpy as np

        text = np.concatenate([s for _, _, _, s, _ in shard])
        if not len(text):
            return [[] for _ in shard], [{} for _ in shard]
        starts = np.r_[0, np.cumsum([len(s) for _, _, _, s, _ in shard])]
        of = np.repeat(np.arange(len(shard)), np.diff(starts))
        place = np.concatenate([p for *_, p in shard])
        row_ends = [ends for _, ends, *_ in shard]
        row = np.concatenate([np.searchsorted(ends, p) for ends, (*_, p) in zip(row_ends, shard, strict=True)])
        change, pairs = np.zeros(len(text) + 1, np.int64), []
        for at, phrase in cover(text, known, sizes):
            np.add.at(change, at, 1)
            np.add.at(change, at + known["lengths"][phrase], -1)
            pairs.append(np.unique(np.stack([of[at], row[at], phrase]), axis=1))
        covered = np.r_[False, np.cumsum(change[:-1]) > 0, False]
        edges = np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2)  # a separator is never covered: spans stay in their stretch
        spans = [[] for _ in shard]
        for first, behind in edges.tolist():
            b = int(of[first])
            spans[b].append((int(row[first]), int(place[first]), int(place[behind - 1]) + 1))
        items = [{} for _ in shard]
        if pairs:
            for b, r, phrase in np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist():
                items[b].setdefault(r, set()).update(known["owners"][known["first"][phrase] : known["first"][phrase + 1]].tolist())
        return spans, items

    def emit(shard, known):
        spans, items = finds(shard, known)
        for (batch, ends, _, _, _), own_spans, own_items in zip(shard, spans, items, strict=True):
            starts = [0, *(ends[:-1] + 1).tolist()]
            counts = [e - s for s, e in zip(starts, ends.tolist(), strict=True)]
            by_row: list[list] = [[] for _ in counts]
            for r, first, behind in own_spans:
                by_row[r].append({"start": first - starts[r], "stop": behind - starts[r]})
            names = [sorted(known["items"][i] for i in own_items.get(r, ())) for r in range(len(counts))]
            columns, fields = batch.columns, list(batch.schema)
            if added:
                by_row = [(old or []) + new for old, new in zip(batch.column(len(columns) - 2).to_pylist(), by_row, strict=True)]
                names = [sorted({*(old or []), *new}) for old, new in zip(batch.column(len(columns) - 1).to_pylist(), names, strict=True)]
                columns, fields = columns[:-3], fields[:-3]
            if not keep_text:
                columns, fields = columns[:text_at] + columns[text_at + 1 :], fields[:text_at] + fields[text_at + 1 :]
            columns = [*columns, pa.array(counts, pa.int64()), pa.array(by_row, pa.list_(SPAN_TYPE)), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*fields, (WORDS, pa.int64()), (SPANS, pa.list_(SPAN_TYPE)), (ITEMS, pa.list_(pa.string()))]))

    def run(batches):
        import numpy as np

        known, shard, size, read = phrases.value, [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            words = coded((t or b"" for t in batch.column(text_at).cast(pa.binary()).to_pylist()), known["symbols"])
            symbols, places = stretches(words, known["shortest"]) if known["shortest"] else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            shard.append((batch, np.flatnonzero(words == -1), len(words), symbols, places))
            size, read = size + len(symbols), read + batch.nbytes
            if size >= sizes.shard_symbols or read >= sizes.shard_bytes:
                yield from emit(shard, known)
                shard, size, read = [], 0, 0
        if shard:
            yield from emit(shard, known)

    return run


def windows(items: DataFrame, width: int) -> DataFrame:
    """The distinct (phrase, item) of items; words of a phrase are joined by a space."""

    def run(batches):
        for batch in batches:
            phrase, item = [], []
            for text, name in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or b"").translate(FOLD).split()
                own = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
                phrase += own
                item += [name] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(phrase, pa.binary()), pa.array(item, pa.string())], names=["phrase", "item"])

    named = items.select("text", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"))
    return short_batches(named).mapInArrow(run, "phrase binary, item string").distinct()


def packed(pairs: pa.Table, width: int) -> dict:
    """Phrases as symbols of their words, and the items of each."""
    import numpy as np

    pairs = pairs.sort_by([("phrase", "ascending"), ("item", "ascending")])
    texts, names = pairs.column("phrase").to_pylist(), pairs.column("item").to_pylist()
    new = [i for i, t in enumerate(texts) if not i or t != texts[i - 1]]
    symbols: dict[bytes, int] = {}
    table, lengths = np.zeros((len(new), width), np.int32), np.zeros(len(new), np.int64)
    for at, i in enumerate(new):
        own = [symbols.setdefault(w, len(symbols) + 1) for w in texts[i].split()]
        table[at, : len(own)] = own
        lengths[at] = len(own)
    items = sorted(set(names))
    number = {n: i for i, n in enumerate(items)}
    owners = np.array([number[n] for n in names], np.int32)
    return {"symbols": symbols | {END: -1}, "highest": len(symbols), "phrases": table, "lengths": lengths, "shortest": int(lengths.min(initial=width)) if len(new) else 0, "first": np.array([*new, len(texts)], np.int64), "owners": owners, "items": items}


def mark(docs: DataFrame, items: DataFrame, sizes: Sizes = Sizes(), keep_text: bool = True) -> DataFrame:
    """docs with three columns: words (WORDS), spans of words in test windows (SPANS) and the items whose windows occur (ITEMS).

    docs: text and any columns whatever they are called; items: item_id and
    text, other columns are ignored. A null text has no words; neither have
    items of null text, which occur nowhere. A null item_id counts as the empty
    one; items of one id are one item. Rows that repeat are rows like others.
    No rows give no rows; without items nothing is marked.
    """
    spark = docs.sparkSession
    pairs = stage(windows(items, sizes.width))
    n, size = pairs.agg(F.count("*"), F.coalesce(F.sum(F.length("phrase") + F.length("item")), F.lit(0))).first()
    blocks = max(1, -(-n // sizes.block_windows), -(-size // sizes.block_bytes))
    text_at = docs.columns.index("text")
    out = docs
    for b in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("phrase", "item"), F.lit(blocks)) == b)
        phrases = spark.sparkContext.broadcast(packed(own.toArrow(), sizes.width))
        keep = keep_text or b + 1 < blocks
        kept = [f for i, f in enumerate(docs.schema.fields) if keep or i != text_at]
        out = short_batches(out).mapInArrow(searched(phrases, sizes, text_at, keep, b > 0), T.StructType([*kept, *ADDED]))
        if b + 1 < blocks:
            out = stage(out)
    return out


def n_covered(spans: Column) -> Column:
    """Words in spans, each counted once."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["stop"]).alias("end"), (a["n"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(s["start"], a["end"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), start, step)["n"]


def contamination(docs: DataFrame, items: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated; what odd rows give is said at mark."""
    marked = mark(docs.select("doc_id", "text"), items, sizes, keep_text=False)
    hit = n_covered(F.col(SPANS))
    return marked.select(
        "doc_id",
        F.col(WORDS).alias("n_words"),
        hit.alias("n_hit"),
        F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ITEMS), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """docs without the words in test windows and what stands between them; other texts stay byte for byte. The columns are those of docs."""
    import re

    text_at, n = docs.columns.index("text"), len(docs.columns)
    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

    def without(text: bytes, spans: list) -> bytes:
        places = [m.span() for m in word.finditer(text)]
        out, at = [], 0
        for span in sorted(spans, key=lambda s: s["start"]):
            out.append(text[at : max(at, places[span["start"]][0])])
            at = max(at, places[span["stop"] - 1][1])
        return b"".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            kept = [without(t, s) if s else t for t, s in zip(texts, batch.column(n + 1).to_pylist(), strict=True)]
            columns = batch.columns[:n]
            columns[text_at] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*list(batch.schema)[:text_at], (batch.schema.field(text_at).name, pa.string()), *list(batch.schema)[text_at + 1 : n]]))

    return short_batches(mark(docs, items, sizes)).mapInArrow(run, docs.schema)
