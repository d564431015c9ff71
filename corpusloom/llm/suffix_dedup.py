"""Exact substring deduplication by a distributed difference-cover suffix sort.

A string of `length` bytes is removed wherever it starts more than once. Only
suffixes at positions of a difference cover modulo v are sorted at first: for
any two starts i and j there is one k < v with i + k and j + k both in the
cover, so two equal strings meet at a sampled position k bytes on. The steps:

1. Sampled blocks (the `length - v + 1` bytes at a sampled position, which
   every string over that position's offsets contains) are named and sorted.
   A position whose name is unique is discarded: nothing through it repeats.
2. The names recurse to longer windows around the sampled positions that are
   left, for a few ranges of offsets k each: where a window that holds a whole
   range of strings repeats, all of them do; where the part that the strings of
   a range share is unique, none does; either way the range is settled.
3. The remaining suffixes, at any position of an unsettled range, are merged
   with one of each settled class that they may equal, and sorted.
4. Adjacent prefixes are compared: whatever was found to repeat is compared,
   byte by byte, with its neighbour in the sorted order. Neighbouring starts
   with neighbouring partners are compared as one stretch.

Names are hashes, so the order is that of the names and not of the alphabet.
Unequal names tell strings apart for certain; equal ones only route them to
each other and step 4 decides. If it ever finds a difference, all is done again
with other names, so the result is exact whatever the hashes do.

Sorting means dealing names to buckets by range and sorting each bucket. A task
sends a name that it holds several times only once (a map-side combine), so a
bucket gets at most one entry for a name and task, however many copies there
are, and each place is compared with one neighbour only. Texts move once to
meet their candidates, then only the texts that have any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import OWN, cut, release, short_batches, text_column


@dataclass(frozen=True)
class Sizes:
    """Entries of a bucket, entries that a task combines at once, bytes of text in a group, and offsets in a range.

    period: of the difference cover, at most (0: four fifths of the length);
    block: bytes of a sampled block, at most (0: as many as every string has).

    name_bits: how many bits of a name count, at each attempt (fewer for tests, which force equal names so).
    """

    bucket_entries: int = 500_000
    combine_entries: int = 500_000
    group_bytes: int = 8_000_000
    offsets: int = 77
    period: int = 0
    block: int = 0
    name_bits: tuple[int, ...] = (64, 64, 64)

    def buckets(self, entries: float) -> int:
        return max(1, round(entries / self.bucket_entries))

    def cover(self, length: int) -> tuple[int, tuple[int, ...]]:
        return difference_cover(self.period or 4 * length // 5)

    def sampled_block(self, length: int) -> int:
        whole = length - self.cover(length)[0] + 1
        return min(self.block, whole) if self.block else whole


class Names:
    """Names of strings, other ones at each attempt."""

    def __init__(self, sizes: Sizes, attempt: int):
        self.attempt = attempt
        self.mask = (1 << 64) - (1 << (64 - sizes.name_bits[attempt]))

    def of(self, strings, kind: int = 0):
        import numpy as np
        from xxhash import xxh3_64_intdigest

        seed = kind << 8 | self.attempt
        return np.fromiter((xxh3_64_intdigest(x, seed) for x in strings), np.uint64) & np.uint64(self.mask)


@lru_cache(maxsize=8)
def difference_cover(most: int) -> tuple[int, tuple[int, ...]]:
    """v and a perfect difference set modulo v, v at most so much.

    v = p^2 + p + 1 for a prime p: the powers of an element of GF(p^3) that lie
    in a plane over GF(p) (Singer's construction).
    """
    primes = [p for p in range(2, 200) if all(p % q for q in range(2, p)) and p * p + p + 1 <= most]
    if not primes:
        return 1, (0,)
    p = primes[-1]
    v = p * p + p + 1
    for coefficients in range(p, p**3):
        a, b, c = coefficients // p // p, coefficients // p % p, coefficients % p
        x, plane = (1, 0, 0), []
        for i in range(v):
            if not x[2]:
                plane.append(i)
            x = (c * x[2] % p, (x[0] + b * x[2]) % p, (x[1] + a * x[2]) % p)
        if len(plane) == p + 1 and len({(s - t) % v for s in plane for t in plane}) == v:
            return v, tuple(plane)
    raise AssertionError("there is a primitive polynomial for every prime")


ENTRY = "bucket int, key binary, other binary, uid binary, at binary, flag binary"
REPLY = "dbucket int, uid binary, at binary, kind binary, near_uid binary, near_at binary"
#: Starts in a row that equal as many in another text: the first start, how many, the other text and its first start.
CLAIM = [("s", "<i4"), ("n", "<i4"), ("u", "<u8"), ("q", "<i4")]
#: Flags of an entry: it is alone in its task; it stands for several of its name there; it need not be asked about.
ALONE, SEVERAL, MIXED, SETTLED = 0, 1, 2, 3


def rows_of(columns: dict, by, names: str) -> pa.Table:
    """One row for each value of by, the columns' values packed."""
    import numpy as np

    order = np.argsort(by, kind="stable")
    sorted_by = by[order]
    edges = np.flatnonzero(np.r_[True, sorted_by[1:] != sorted_by[:-1]]) if len(by) else np.zeros(0, np.int64)
    out = {names: pa.array(sorted_by[edges].astype(np.int32))}
    for name, values in columns.items():
        packed = values[order]
        out[name] = pa.array([packed[s:e].tobytes() for s, e in zip(edges, [*edges[1:], len(by)], strict=True)], pa.binary())
    return pa.table(out)


def unpacked(table: pa.Table, column: str, kind: str):
    import numpy as np

    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def bucket_of(key, buckets: int):
    """Ranges of names: the buckets are sorted parts of one order."""
    import numpy as np

    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def runs(*columns):
    """Numbers of the runs of equal values in sorted columns, and the length of each."""
    import numpy as np

    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    number = np.cumsum(new) - 1
    return number, np.bincount(number) if n else np.zeros(0, np.int64)


def before(values, firsts):
    """Each value's predecessor, its own value where a run begins."""
    import numpy as np

    return np.where(firsts, values, np.r_[values[:1], values[:-1]])


def starts_of(number):
    import numpy as np

    return np.r_[True, number[1:] != number[:-1]] if len(number) else np.zeros(0, bool)


def combined(key, uid, at, buckets: int, near: bool) -> pa.Table:
    """Entries of one task: names held several times are sent once, their other places as settled, with their neighbour (if near) as key and other."""
    import numpy as np

    order = np.lexsort((at, uid, key))
    key, uid, at = key[order], uid[order], at[order]
    number, size = runs(key)
    several, first = size[number] > 1, starts_of(number)
    flag = np.where(several, np.where(first, SEVERAL, SETTLED), ALONE).astype(np.uint8)
    spread = flag == SETTLED
    bucket = bucket_of(key, buckets)
    bucket[spread] = (uid[spread] + at[spread].astype(np.uint64)) % np.uint64(buckets)
    asked = {"key": np.where(spread, before(uid, first) if near else 0, key).astype(np.uint64), "other": np.where(spread & near, before(at, first), 0).astype(np.int32), "uid": uid, "at": at, "flag": flag}
    as_read = np.argsort(order)  # runs of one text in a bucket take little room
    return rows_of({c: x[as_read] for c, x in asked.items()}, bucket[as_read], "bucket")


def replies(groups: int, uid, at, kind, near_uid, near_at) -> pa.Table:
    import numpy as np

    return rows_of({"uid": uid, "at": at, "kind": kind.astype(np.uint8), "near_uid": near_uid, "near_at": near_at.astype(np.int32)}, (uid % np.uint64(groups)).astype(np.int32), "dbucket")


def repeated(groups: int, near_too: bool):
    """For a bucket: the places whose name occurs more than once, each with its neighbour in the order, if that is asked for too."""

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        key, other, uid, at, flag = (unpacked(table, c, t) for c, t in (("key", "<u8"), ("other", "<i4"), ("uid", "<u8"), ("at", "<i4"), ("flag", "u1")))
        place = np.flatnonzero(flag != SETTLED)
        place = place[np.lexsort((at[place], uid[place], key[place]))]
        number, size = runs(key[place])
        told = np.bincount(number, weights=flag[place] == SEVERAL, minlength=len(size)) > 0 if len(place) else np.zeros(0, bool)
        hit = ((size > 1) | told)[number] if len(place) else np.zeros(0, bool)
        near, own, rest = before(place, starts_of(number))[hit], place[hit], np.flatnonzero(flag == SETTLED)
        both = np.r_[own, rest]
        kind = np.zeros(len(both))
        if not near_too:  # the same for all takes little room
            return replies(groups, uid[both], at[both], kind, np.zeros(len(both), np.uint64), kind)
        return replies(groups, uid[both], at[both], kind, np.r_[uid[near], key[rest]], np.r_[at[near], other[rest]])

    return run


class Task:
    """Gathers entries until there are enough to combine."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.parts, self.held = make, limit, [], 0

    def add(self, *columns) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.held += len(columns[0])
        if self.held >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        import numpy as np

        if self.held:
            columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            self.parts, self.held = [], 0
            for part in self.make(*columns).to_batches(max_chunksize=16):
                yield part


def sampled(length: int, buckets: int, sizes: Sizes, names: Names):
    """Step 1: names of the blocks at sampled positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        v, cover = sizes.cover(length)
        core, cover = sizes.sampled_block(length), np.array(cover)
        task = Task(lambda *c: combined(*c, buckets, False), sizes.combine_entries)
        for b in batches:
            for uid, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                if len(text) < core:
                    continue
                at = (np.arange(0, len(text), v)[:, None] + cover).ravel()
                at = at[at <= len(text) - core]
                key = names.of(text[p : p + core] for p in at.tolist())
                yield from task.add(key, np.full(len(at), uid & (1 << 64) - 1, np.uint64), at.astype(np.int32))
        yield from task.flush()

    return run


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they travel."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([squeeze(t) for t in b.column(2).to_pylist()], pa.binary())], ["dbucket", "uid", "text"])


def met():
    """Texts of a group that have candidates, with these."""
    TEXT = pa.schema([("dbucket", pa.int32()), ("uid", pa.int64()), ("text", pa.binary()), ("first", pa.binary()), ("last", pa.binary()), ("settled_first", pa.binary()), ("settled_last", pa.binary()), ("claims", pa.binary())])

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        import numpy as np

        by_uid = Places(told)
        out = []
        for bucket, uid, text in zip(*(texts.column(c).to_pylist() for c in ("dbucket", "uid", "text")), strict=True):
            at = by_uid.of(uid)[0]
            if len(at):
                out.append((bucket, uid, text, np.unique(at).astype("<i4").tobytes(), b"", b"", b"", b""))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, TEXT.types, strict=True)], schema=TEXT)

    return run


TEXTS = "dbucket int, uid long, text binary, first binary, last binary, settled_first binary, settled_last binary, claims binary"


class Places:
    """Replies by document: at, kind, near_uid and near_at."""

    def __init__(self, told: pa.Table):
        import numpy as np

        uid, *rest = (unpacked(told, c, t) for c, t in (("uid", "<u8"), ("at", "<i4"), ("kind", "u1"), ("near_uid", "<u8"), ("near_at", "<i4")))
        order = np.argsort(uid, kind="stable")
        self.uid, self.rest = uid[order], [x[order] for x in rest]

    def of(self, uid: int):
        import numpy as np

        u = np.uint64(uid & (1 << 64) - 1)
        s, e = np.searchsorted(self.uid, u, "left"), np.searchsorted(self.uid, u, "right")
        return [x[s:e] for x in self.rest]


def claims_of(uid: int, s, n, u, q):
    """Claims (see CLAIM) without those of a place about itself."""
    import numpy as np

    own = np.uint64(uid & (1 << 64) - 1)
    out = np.empty(len(s), CLAIM)
    out["s"], out["n"], out["u"], out["q"] = s, n, u, q
    return out[(out["u"] != own) | (out["s"] != out["q"])]


def stretched(claims, length: int):
    """Claims about the same two texts at the same distance, put together where the bytes that they cover touch."""
    import numpy as np

    if not len(claims):
        return claims
    shift = claims["s"].astype(np.int64) - claims["q"]
    claims = claims[np.lexsort((claims["s"], shift, claims["u"]))]
    shift = claims["s"].astype(np.int64) - claims["q"]
    end = claims["s"].astype(np.int64) + claims["n"]
    # a short claim after a long one may begin a new stretch where the long one still goes on: compared twice, which does no harm
    new = np.r_[True, (claims["u"][1:] != claims["u"][:-1]) | (shift[1:] != shift[:-1]) | (claims["s"][1:] > end[:-1] + length - 1)]
    first = np.flatnonzero(new)
    out = claims[first]
    out["n"] = np.maximum.reduceat(end, first) - out["s"]
    return out


def offset_ranges(v: int, offsets: int) -> list[tuple[int, int]]:
    step = -(-v // -(-v // offsets))
    return [(k, min(k + step, v) - 1) for k in range(0, v, step)]


def windows(length: int, buckets: int, sizes: Sizes, names: Names):
    """Step 2: names of what the strings of a range of offsets share (key), and of the window that holds them all (other)."""

    def make(core, outer, uid, at) -> pa.Table:
        import numpy as np

        order = np.lexsort((at, uid, outer, core))
        core, outer, uid, at = core[order], outer[order], uid[order], at[order]
        group, group_size = runs(core)
        kind, kind_size = runs(core, outer)
        first_of_kind, first = starts_of(kind), starts_of(group)
        kinds = np.bincount(group, weights=first_of_kind)[group]
        # of a shared part in several windows here, one entry is sent and each window's first is looked at position by position
        flag = np.full(len(core), SETTLED, np.uint8)
        flag[first] = np.where(kinds[first] > 1, MIXED, np.where(group_size[group[first]] > 1, SEVERAL, ALONE))
        known = (kind_size[kind] > 1).astype(np.uint8)  # the whole window repeats
        look = ((kinds > 1) & first_of_kind).astype(np.uint8)
        bucket = bucket_of(core, buckets)
        spread = flag == SETTLED
        bucket[spread] = (uid[spread] + at[spread].astype(np.uint64)) % np.uint64(buckets)
        # a settled place of which nothing is known is unique; of the others only the place and its neighbour count
        bits, as_read = flag | known << 4 | look << 5, np.argsort(order)
        as_read = as_read[(bits != SETTLED)[as_read]]
        core = np.where(spread, before(uid, first_of_kind), core)
        outer = np.where(spread, before(at, first_of_kind).astype(np.uint64), outer)
        return rows_of({c: x[as_read] for c, x in (("key", core), ("other", outer), ("uid", uid), ("at", at), ("flag", bits))}, bucket[as_read], "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        v, _ = sizes.cover(length)
        spans = offset_ranges(v, sizes.offsets)
        task = Task(make, sizes.combine_entries)
        grow = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for uid, packed, places in zip(*(b.column(c).to_pylist() for c in ("uid", "text", "first")), strict=True):
                text, own, places = grow(packed), uid & (1 << 64) - 1, np.frombuffer(places, "<i4").tolist()
                n = len(text)
                for r, (k0, k1) in enumerate(spans):  # a range's number is part of its names, else two ranges could take one place for two
                    here = [p for p in places if max(k0, p + length - n) <= min(k1, p)]
                    if here:
                        core = names.of((text[p - k0 : p + length - k1] for p in here), r)
                        # a window that the text's ends cut short equals no other
                        outer = names.of((text[p - k1 : p + length - k0] if p >= k1 and p + length - k0 <= n else b"%d %d" % (own, p) for p in here), r)
                        yield from task.add(core, outer, np.full(len(here), own, np.uint64), (np.array(here, np.int64) * len(spans) + r).astype(np.int32))
        yield from task.flush()

    return run


#: Kinds of replies: the strings of the range all repeat; they are to be looked at one by one.
REPEATS, LOOK = 1, 2


def settled(groups: int):
    """For a bucket of step 2: which ranges repeat as a whole and which must be looked at position by position."""

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        core, outer, uid, at, bits = (unpacked(table, c, t) for c, t in (("key", "<u8"), ("other", "<u8"), ("uid", "<u8"), ("at", "<i4"), ("flag", "u1")))
        flag, known, look = bits & 15, (bits >> 4 & 1).astype(bool), (bits >> 5 & 1).astype(bool)
        spread = flag == SETTLED
        near_uid, near_at = np.where(spread, core, uid), np.where(spread, outer.astype(np.int64).astype(np.int32), at)
        asked = np.flatnonzero(~spread)
        asked = asked[np.lexsort((at[asked], uid[asked], outer[asked], core[asked]))]
        if len(asked):
            group, group_size = runs(core[asked])
            kind, kind_size = runs(core[asked], outer[asked])
            first_of_kind = starts_of(kind)
            mixed = (np.bincount(group, weights=first_of_kind) > 1) | (np.bincount(group, weights=flag[asked] == MIXED) > 0)
            shared = (group_size > 1) | (np.bincount(group, weights=flag[asked] >= SEVERAL) > 0)
            known[asked] |= kind_size[kind] > 1
            look[asked] |= mixed[group] & shared[group] & (first_of_kind | ~known[asked])
            near_uid[asked], near_at[asked] = before(uid[asked], first_of_kind), before(at[asked], first_of_kind)
        hit = np.flatnonzero(known | look)
        return replies(groups, uid[hit], at[hit], (known * REPEATS + look * LOOK)[hit], near_uid[hit], near_at[hit])

    return run


def narrowed(length: int, sizes: Sizes):
    """Texts of a group with the starts that are to be looked at, and those known to repeat, as first and last ones of ranges."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        import numpy as np
        import zstandard

        v, _ = sizes.cover(length)
        spans = offset_ranges(v, sizes.offsets)
        low, high = (np.array([s[x] for s in spans]) for x in (0, 1))
        by_uid, grow, out = Places(told), zstandard.ZstdDecompressor().decompress, []
        for row in texts.to_pylist():
            at, kind, near_uid, near_at = by_uid.of(row["uid"])
            if not len(at):
                continue
            n = len(grow(row["text"]))
            p, r = at // len(spans), at % len(spans)
            k0, k1 = low[r], high[r]
            first, last = np.maximum(p - k1, 0), np.minimum(p - k0, n - length)
            for names, bit in ((("first", "last"), LOOK), (("settled_first", "settled_last"), REPEATS)):
                own = (kind & bit) > 0
                for name, values in zip(names, united(first[own], last[own]), strict=True):
                    row[name] = values.astype("<i4").tobytes()
            own = (kind & REPEATS) > 0
            claims = claims_of(row["uid"], (p - k1)[own], (k1 - k0 + 1)[own], near_uid[own], (near_at // len(spans) - k1)[own])
            row["claims"] = stretched(claims, length).tobytes()
            out.append(row)
        return pa.Table.from_pylist(out, schema=texts.schema)

    return run


def united(first, last):
    """Ranges (both ends included) put together where they touch."""
    import numpy as np

    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.r_[True, first[1:] > reach[:-1] + 1]
    return first[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(first) - 1]]


def starts_in(first: bytes, last: bytes):
    import numpy as np

    return np.concatenate([np.zeros(0, np.int64), *(np.arange(s, e + 1) for s, e in zip(np.frombuffer(first, "<i4").tolist(), np.frombuffer(last, "<i4").tolist(), strict=True))])


def each_start(length: int, buckets: int, sizes: Sizes, names: Names):
    """Step 3: names of the strings at single positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        task = Task(lambda *c: combined(*c, buckets, True), sizes.combine_entries)
        grow = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for uid, packed, first, last in zip(*(b.column(c).to_pylist() for c in ("uid", "text", "first", "last")), strict=True):
                at = starts_in(first, last)
                if len(at):
                    text = grow(packed)
                    key = names.of(text[i : i + length] for i in at.tolist())
                    yield from task.add(key, np.full(len(at), uid & (1 << 64) - 1, np.uint64), at.astype(np.int32))
        yield from task.flush()

    return run


PROOF = pa.struct([("dbucket", pa.int32()), ("uid", pa.int64()), ("at", pa.int32()), ("bytes", pa.binary())])
RESULT = pa.schema([("uid", pa.int64()), ("full_sha256", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("differs", pa.bool_()), ("proofs", pa.list_(PROOF))])
RESULT_SQL = "uid long, full_sha256 string, n_removed long, n_spans long, kept_sha256 string, kept binary, differs boolean, proofs array<struct<dbucket: int, uid: long, at: int, bytes: binary>>"


def removed(length: int, groups: int, with_text: bool):
    """The texts of a group without the bytes of repeated strings.

    differs: a start of the text is not what another one of it was said to be.
    proofs: bytes that other texts are said to have, to be compared there.
    """

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        import numpy as np
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        by_uid, grow, out = Places(told), zstandard.ZstdDecompressor().decompress, []
        for row in texts.to_pylist():
            uid, text = row["uid"], grow(row["text"])
            at, _, near_uid, near_at = by_uid.of(uid)
            ok = at <= len(text) - length
            at, near_uid, near_at = at[ok], near_uid[ok], near_at[ok]
            claims = np.r_[np.frombuffer(row["claims"], CLAIM), claims_of(uid, at, 1, near_uid, near_at)]
            at = np.unique(at).astype(np.int64)
            known = [np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("settled_first", "settled_last")]
            first, last = united(np.r_[at, known[0]], np.r_[at, known[1]] + length - 1)
            if not len(first):
                continue
            ends = (last + 1).tolist()
            kept = b"".join([text[s:e] for s, e in zip([0, *ends], [*first.tolist(), len(text)], strict=True)])
            differs, proofs = False, []
            for s, n, u, q in stretched(claims, length).tolist():
                part, other = text[max(s, 0) : s + n + length - 1], u - (1 << 64) if u >> 63 else u
                if len(part) < n + length - 1:
                    differs = True  # no such place: a name stood for something else
                elif other == uid:
                    differs |= q < 0 or text[q : q + len(part)] != part
                else:
                    proofs.append({"dbucket": u % groups, "uid": other, "at": q, "bytes": squeeze(part)})
            digests = hashlib.sha256(text).hexdigest(), len(text) - len(kept), len(first), hashlib.sha256(kept).hexdigest()
            out.append((uid, *digests, squeeze(kept) if with_text else None, differs, proofs))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(RESULT), RESULT.types, strict=True)], schema=RESULT)

    return run


def compared(texts: pa.Table, proofs: pa.Table) -> pa.Table:
    """Step 4, for a group: the texts that differ from what was said of them."""
    import zstandard

    grow = zstandard.ZstdDecompressor().decompress
    own: dict[int, list[bytes]] = {}
    for uid, text in zip(texts.column("uid").to_pylist(), texts.column("text").to_pylist(), strict=True):
        own.setdefault(uid, []).append(text)
    proofs, wrong = proofs.sort_by("uid"), []
    held, whole = None, []
    for uid, at, packed in zip(proofs.column("uid").to_pylist(), proofs.column("at").to_pylist(), proofs.column("bytes"), strict=True):
        if uid != held:
            held, whole = uid, [grow(t) for t in own.get(uid, [])]
        part = grow(packed.as_py())
        if at < 0 or not whole or any(t[at : at + len(part)] != part for t in whole):
            wrong.append(uid)
    return pa.table({"uid": pa.array(wrong, pa.int64())})


def row_key(docs: DataFrame, attempt: int = 0):
    """Names a row by id and text; rows equal in both may share it."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_column(docs), F.lit(attempt))


def repeats(docs: DataFrame, length: int, sizes: Sizes = Sizes(), with_text: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """uid, full_sha256, n_removed, n_spans, kept_sha256 and kept (compressed) of the rows that lose bytes.

    Beside them uid and n_shared_blocks of the rows that have sampled blocks in
    common with other places, and the attempt that names the rows (see row_key).
    """
    if length < 1:
        raise ValueError("length must be positive")
    for attempt in range(len(sizes.name_bits)):
        found, blocks, wrong = attempted(docs, length, sizes, with_text, attempt)
        if not wrong:
            return found, blocks, attempt
    raise RuntimeError("strings of equal names differed at every attempt")


def attempted(docs: DataFrame, length: int, sizes: Sizes, with_text: bool, attempt: int) -> tuple[DataFrame, DataFrame, bool]:
    """What repeats() returns, and whether any of it was found to be wrong."""
    names = Names(sizes, attempt)
    given = short_batches(docs).select(row_key(docs, attempt).alias("uid"), text_column(docs).cast("binary").alias("text"))
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    v, cover = sizes.cover(length)
    ranges = len(offset_ranges(v, sizes.offsets))
    groups = max(1, -(-total // sizes.group_bytes))
    group = F.expr(f"cast((cast(uid as decimal(20,0)) + if(uid < 0, 18446744073709551616BD, 0BD)) % {groups} as int)")
    least = sizes.sampled_block(length)
    whole = given.where(F.octet_length("text") >= least).select(group.alias("dbucket"), "uid", "text").mapInArrow(squeezed, "dbucket int, uid long, text binary")

    def sort(entries: DataFrame, reduce) -> DataFrame:
        return entries.groupBy("bucket").applyInArrow(reduce, REPLY)

    def meet(texts: DataFrame, told: DataFrame, function, schema: str) -> DataFrame:
        return texts.groupBy("dbucket").cogroup(told.groupBy("dbucket")).applyInArrow(function, schema)

    n = sizes.buckets(total * len(cover) / v)
    texts = cut(meet(whole, sort(given.mapInArrow(sampled(length, n, sizes, names), ENTRY), repeated(groups, False)), met(), TEXTS))
    release(docs.sparkSession, total)
    blocks = texts.select("uid", (F.octet_length("first") / 4).cast("long").alias("n_shared_blocks"))
    places = texts.agg(F.sum(F.octet_length("first") / 4)).first()[0] or 0
    n = sizes.buckets(places * ranges)
    left = cut(meet(texts, sort(texts.mapInArrow(windows(length, n, sizes, names), ENTRY), settled(groups)), narrowed(length, sizes), TEXTS))
    release(docs.sparkSession, total)
    n = sizes.buckets(places * v / ranges / 4)
    found = cut(meet(left, sort(left.mapInArrow(each_start(length, n, sizes, names), ENTRY), repeated(groups, True)), removed(length, groups, with_text), RESULT_SQL))
    release(docs.sparkSession, total)
    proofs = found.select(F.explode("proofs").alias("p")).select("p.*")
    wrong = meet(left.select("dbucket", "uid", "text"), proofs, compared, "uid long").union(found.where("differs").select("uid"))
    return found.drop("differs", "proofs"), blocks, bool(wrong.limit(1).count())


def deduplicate(docs: DataFrame, length: int = 400, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_shared_blocks of every row of docs.

    docs: doc_id and text; other columns are ignored, whatever their names. A
    text is its UTF-8 bytes; null counts as empty. Each byte that a string of
    `length` bytes covers which also starts anywhere else (in the same text
    too, overlapping or not) is removed; strings do not cross texts and are
    judged on the input. Very long texts are taken whole. Rows that repeat an id
    and text count as two texts. No rows give no rows.

    n_shared_blocks is how many of the text's sampled blocks (see Sizes.block)
    stand at another sampled place too, by their names. It tells of repeated
    passages that are too short to be removed: every one of at least
    block + period - 1 bytes has such a block, shorter ones may have.
    """
    text, zero = text_column(docs), F.lit(0).cast("long")
    found, blocks, attempt = repeats(docs, length, sizes)
    out = docs.select("doc_id", row_key(docs, attempt).alias("uid"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("full_sha256"))
    lost = found.select("uid", "full_sha256", "n_removed", "n_spans", "kept_sha256").dropDuplicates(["uid", "full_sha256"])
    told = blocks.groupBy("uid").agg(F.max("n_shared_blocks").alias("n_shared_blocks"))
    out = out.join(lost, ["uid", "full_sha256"], "left").join(told, "uid", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "full_sha256").alias("kept_sha256"), F.coalesce("n_shared_blocks", zero).alias("n_shared_blocks"))


def without_repeats(docs: DataFrame, length: int, sizes: Sizes = Sizes()) -> DataFrame:
    """All columns of docs, texts without their repeated strings (n_chars anew, if there).

    Bytes of a character that a removed string cuts through go too.
    """
    uid, sha, kept = (f"{OWN}{x}" for x in ("uid", "sha", "kept"))
    found, _, attempt = repeats(docs, length, sizes, with_text=True)
    lost = found.select(F.col("uid").alias(uid), F.col("full_sha256").alias(sha), F.col("kept").alias(kept)).dropDuplicates([uid, sha]).mapInArrow(readable, f"`{uid}` long, `{sha}` string, `{kept}` string")
    out = docs.withColumns({uid: row_key(docs, attempt), sha: F.sha2(text_column(docs).cast("binary"), 256)}).join(lost, [uid, sha], "left")
    untouched = F.col(kept).isNull()
    new = {"text": F.when(untouched, F.col("text")).otherwise(F.col(kept))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(untouched, F.col("n_chars")).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def readable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept bytes as text, without what is left of characters that were cut through."""
    import zstandard

    grow = zstandard.ZstdDecompressor().decompress
    for b in batches:
        texts = [grow(t.as_py()).decode("utf-8", "ignore") for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], b.schema.names)
