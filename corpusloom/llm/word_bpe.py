"""Byte-pair encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never
be merged across, so the place between the two is a certain cut. Words are cut
at all such places; the fragments are merged independently and concatenated.

Normalisation and splitting into words are the tokenizer file's own. Neither
looks across white space, so texts are taken chunk by chunk and the ids of
equal chunks are remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import short_batches, text_column

#: Chunks that a worker remembers before it starts anew, the longest fragment merged in rows, and the rank of no pair.
MEMO_ENTRIES = 900_000
SHORT = 32
NONE = 2**31 - 1
#: The code points with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = re.compile(f"[^{WHITE}]+")
#: What str.split takes for white space beyond that.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: The file's own splitting and lowering for letters up to U+017F (without U+0130, whose small letter is two characters), which no
#: normalisation changes. The letters and numbers among these characters, capitals left out.
PLAIN = re.compile("[\\x21-\\x7e\\xa1-\u012f\u0131-\u017f]+")
LATIN_WORDS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f0-9\xb2\xb3\xb9\xbc-\xbe]+")


class WordBpe:
    """Ids as the tokenizers library gives them for a file of this kind."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        import numpy as np
        from tokenizers import Tokenizer

        self.memo_entries = memo_entries

        library = Tokenizer.from_file(path)
        self.normalize, self.words = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        if said["decoder"] is not None or said["post_processor"] is not None or model["byte_fallback"] or model["continuing_subword_prefix"]:
            raise ValueError("only plain byte-pair files with word ends are read")
        end, vocab = model["end_of_word_suffix"] or "", model["vocab"]
        self.specials = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.names = {i: t for t, i in [*vocab.items(), *self.specials.items()]}
        # the file writes every byte as one character: printable ones as themselves
        self.byte = {c: i for i, c in enumerate(byte_characters())}
        for sample in ("it's", "we'll-go-on", "a1b22", "#tag_x", "don't've", "\xe9t\xe9\xb2\xbd\xab\xdf\xbb"):
            if [bytes(map(self.byte.__getitem__, w)) for w, _ in self.words(sample)] != [w.encode() for w in LATIN_WORDS.findall(sample)]:
                raise ValueError("the file splits words in another way")
        self.inner, self.last = (np.array([vocab[c + e] for c in self.byte], np.int64) for e in ("", end))
        # bytes that are neighbours in no token: a certain cut between the two
        self.cut = np.ones((256, 256), bool)
        for token in vocab:
            at = [self.byte[c] for c in (token.removesuffix(end) if end else token) if c in self.byte]
            self.cut[at[:-1], at[1:]] = False
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[x] << 32 | vocab[y] for x, y in pairs], np.int64)
        order = np.unique(keys, return_index=True)[1]  # of a pair listed twice the first counts
        self.slots = two_tables(keys[order], order)
        self.merged = np.array([vocab[x + y] for x, y in pairs], np.int64)  # by rank
        self.memo: dict[str, bytes] = {}

    def ranks(self, left, right):
        """The rank of each pair, NONE for those that do not merge."""
        import numpy as np

        keys = left << 32 | right  # with -1 on a side this is no listed pair's key
        (keys_a, ranks_a), (keys_b, ranks_b) = self.slots
        a, b = slots_of(keys)
        return np.where(keys_a[a] == keys, ranks_a[a], np.where(keys_b[b] == keys, ranks_b[b], NONE))

    def merge_rows(self, ids):
        """Merge fragments side by side: each row's lowest pair, again and again. ids: a row for each, filled up with -1."""
        import numpy as np

        ids, out = ids.copy(), np.full_like(ids, -1)
        rows = np.arange(len(ids))
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        places = np.arange(ids.shape[1])
        while len(ids):
            at = rank.argmin(axis=1)
            lowest = rank[np.arange(len(ids)), at]
            done = lowest == NONE
            if done.any():
                out[rows[done]] = ids[done]
                ids, rank, rows, at, lowest = (x[~done] for x in (ids, rank, rows, at, lowest))
                if not len(ids):
                    break
            each = np.arange(len(ids))
            ids[each, at] = self.merged[lowest]
            source = np.minimum(places + (places > at[:, None]), len(places) - 1)  # the merged pair's second place closes up
            ids = np.take_along_axis(ids, source, axis=1)
            ids[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(source[:, :-1], rank.shape[1] - 1), axis=1)
            rank[:, -1] = NONE
            rank[each, at] = self.ranks(ids[each, at], ids[each, at + 1])
            before = at > 0
            rank[each[before], at[before] - 1] = self.ranks(ids[each[before], at[before] - 1], ids[each[before], at[before]])
        return out

    def heaped(self, ids: list[int]) -> list[int]:
        """Merge a long fragment: a heap of pairs over a linked list."""
        import numpy as np

        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known = np.array(ids, np.int64)
        first = self.ranks(known[:-1], known[1:]).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        one = lambda a, b: int(self.ranks(np.array([a]), np.array([b]))[0])
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue  # one of the two was merged meanwhile
            new = ids[i] = int(self.merged[r])
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := one(new, ids[k])) != NONE:
                    heapq.heappush(heap, (r, i, new, ids[k]))
            if (h := before[i]) >= 0 and (r := one(ids[h], new)) != NONE:
                heapq.heappush(heap, (r, h, ids[h], new))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[bytes]):
        """The ids of all words one after the other, and how many each has."""
        import numpy as np

        size = np.fromiter(map(len, words), np.int64, len(words))
        buffer = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size)
        ids = self.inner[buffer]
        ids[ends - 1] = self.last[buffer[ends - 1]]
        first = np.zeros(len(buffer), bool)
        first[ends - size] = True
        first[1:] |= self.cut[buffer[:-1], buffer[1:]]
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, len(buffer)))
        left = np.ones(len(starts), np.int64)
        kept = np.zeros(len(buffer), bool)
        kept[starts] = True
        for low, high in ((1, 4), (4, 8), (8, 12), (12, 20), (20, SHORT)):
            at = np.flatnonzero((lengths > low) & (lengths <= high))
            for part in np.array_split(at, max(1, len(at) // 8_000)):
                if len(part):
                    places = starts[part][:, None] + np.arange(high)
                    inside = np.arange(high) < lengths[part][:, None]
                    merged = self.merge_rows(np.where(inside, ids[np.minimum(places, len(ids) - 1)], -1))
                    real = merged >= 0
                    ids[places[real]] = merged[real]
                    kept[places[real]] = True
                    left[part] = real.sum(axis=1)
        for f in np.flatnonzero(lengths > SHORT).tolist():
            merged = self.heaped(ids[starts[f] : starts[f] + lengths[f]].tolist())
            ids[starts[f] : starts[f] + len(merged)] = merged
            kept[starts[f] : starts[f] + len(merged)] = True
            left[f] = len(merged)
        word = np.searchsorted(ends, starts, side="right")
        return ids[kept].astype("<u4"), np.bincount(word, weights=left, minlength=len(words)).astype(np.int64)

    def split(self, chunks: list[str]) -> tuple[list[bytes], list[str], list[int]]:
        """The words of chunks as bytes, in an order of its own, the chunks in that order, and how many words each has."""
        plain = [c for c in chunks if c.isprintable() and PLAIN.fullmatch(c)]
        found = LATIN_WORDS.findall("\n".join(plain).lower())
        breaks = [i for i, w in enumerate(found) if w == "\n"]
        counts = [end - start - 1 for start, end in zip([-1, *breaks], [*breaks, len(found)], strict=True)] if plain else []
        words = [w.encode() for w in found if w != "\n"]
        known = set(plain)
        others = [c for c in chunks if c not in known]
        for chunk in others:
            own = [bytes(map(self.byte.__getitem__, w)) for w, _ in self.words(self.normalize(chunk))]
            words += own
            counts.append(len(own))
        return words, [*plain, *others], counts

    def learn(self, chunks: list[str]) -> None:
        """Remember the ids of chunks (without white space and special tokens)."""
        import numpy as np

        words, chunks, counts = self.split(chunks)
        ends = np.zeros(1, np.int64)
        packed = b""
        if words:
            ids, sizes = self.encode_words(words)
            packed, ends = ids.tobytes(), np.append(0, np.cumsum(sizes) * 4)
        edges = ends[np.append(0, np.cumsum(counts))].tolist()
        for chunk, start, end in zip(chunks, edges[:-1], edges[1:], strict=True):
            self.memo[chunk] = packed[start:end]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each whole text."""
        if self.special is not None and any(map(self.special.search, texts)):
            return [b"".join(struct.pack("<I", self.specials[p]) if p in self.specials else self.plain([p])[0] for p in self.special.split(t)) if self.special.search(t) else self.plain([t])[0] for t in texts]
        return self.plain(texts)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def plain(self, texts: list[str]) -> list[bytes]:
        memo, split = self.memo, [CHUNKS.findall(t) if SEPARATORS.search(t) else t.split() for t in texts]
        all_chunks = set().union(*split)
        new = all_chunks.difference(memo)
        if len(memo) + len(new) > self.memo_entries:
            memo.clear()
            new = all_chunks
        if new:
            self.learn(list(new))
        out = [b"".join(map(memo.__getitem__, chunks)) for chunks in split]
        if len(memo) > self.memo_entries:
            memo.clear()
        return out

    def decode(self, ids: bytes) -> str:
        """The tokens' own strings, joined by spaces: a file without a decoder is decoded so."""
        names = self.names
        return " ".join([names[i] for (i,) in struct.iter_unpack("<I", ids)])


SLOT_BITS = 17


def slots_of(keys):
    """A key's place in either of two tables."""
    import numpy as np

    k = keys.astype(np.uint64)
    return (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS), (k * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - SLOT_BITS)


def two_tables(keys, ranks):
    """Two tables of keys and ranks, in which every key is at its place in one of them (cuckoo hashing)."""
    import numpy as np

    out = [(np.full(1 << SLOT_BITS, -2, np.int64), np.full(1 << SLOT_BITS, NONE, np.int32)) for _ in range(2)]
    places = [p.tolist() for p in slots_of(keys)]
    held = [{}, {}]
    for i in range(len(keys)):
        side = 0
        for _ in range(500):
            at = places[side][i]
            i, held[side][at] = held[side].get(at), i
            if i is None:
                break
            side = 1 - side
        else:
            raise ValueError("too many pairs for the tables")
    for (k, r), taken in zip(out, held, strict=True):
        at, of = np.array(list(taken), np.int64), np.array(list(taken.values()), np.int64)
        k[at], r[at] = keys[of], ranks[of]
    return out


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is visible in Latin-1, else the next one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(others)) for b in range(256)]


@lru_cache(maxsize=2)
def word_bpe(path: str, memo_entries: int = MEMO_ENTRIES) -> WordBpe:
    return WordBpe(path, memo_entries)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit) and decoded of every whole text.

    Null and empty texts have no ids and decode to the empty text; very long
    ones are encoded whole. Repeated rows and null ids stay; other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_bpe(tokenizer_path)
        for b in batches:
            ids = own.encode_all(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([own.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return short_batches(docs).select("doc_id", text_column(docs).alias("text")).mapInArrow(run, f"doc_id {id_type}, ids binary, decoded string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: what encode() gives, as digests made on the spot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_bpe(tokenizer_path)
        for b in batches:
            ids = own.encode_all(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(own.decode(i).encode()).hexdigest() for i in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return short_batches(docs).select("doc_id", text_column(docs).alias("text")).mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
