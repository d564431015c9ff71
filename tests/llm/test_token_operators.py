"""Token counts, encoding and packing against the libraries and by brute force."""

import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import packing, token_counts, word_bpe
from corpusloom.llm.queries import tokenizer

TEXTS = [None, "", " ", "a", "  a  b\n\nc\t", "It's I'LL 12345 #@! don't", "ÀÉ ﬁ ΑΣ ß İstanbul", "日本語 テキスト　x", "<|endoftext|>a<|startoftext|> b", "▁▁a ▁ b", "x" * 3000, "ab " * 4000, "🙂👍🏽 <0x41> <unk>", "\x1c\x00​", "naïve—café, 3½ l’été"]


@pytest.fixture(scope="module")
def piece():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model")), token_counts.PieceCounter(tokenizer("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def word():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("word_bpe_49k.json")), word_bpe.WordBpe(tokenizer("word_bpe_49k.json"))


LIBRARIES = {}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    if not LIBRARIES:
        import sentencepiece
        from tokenizers import Tokenizer

        LIBRARIES["p"] = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model")), token_counts.PieceCounter(tokenizer("piece_bpe_32k.model"))
        LIBRARIES["w"] = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), word_bpe.WordBpe(tokenizer("word_bpe_49k.json"))
    (p, own_p), (w, own_w) = LIBRARIES["p"], LIBRARIES["w"]
    assert own_p.count(text) == len(p.encode(text))
    ids = w.encode(text, add_special_tokens=False).ids
    assert own_w.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
    assert own_w.decode(own_w.encode(text)) == w.decode(ids, skip_special_tokens=False)


def test_fixed_texts(piece, word):
    for text in TEXTS:
        text = text or ""
        assert piece[1].count(text) == len(piece[0].encode(text))
        ids = word[0].encode(text, add_special_tokens=False).ids
        assert word[1].encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def documents(spark):
    rows = [(i, t, "n") for i, t in enumerate(TEXTS)] + [(3, "a", "n"), (None, "b c", "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_counts_of_rows(spark, piece):
    out = token_counts.token_counts(documents(spark), tokenizer("piece_bpe_32k.model"), limit=100)
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 2
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows}
    assert got[0] == (0, 0, False)
    assert got[10][2]
    assert token_counts.token_counts(documents(spark).where("false"), tokenizer("piece_bpe_32k.model")).count() == 0


def test_digests_and_encode(spark, word):
    import hashlib

    rows = {r.doc_id: r for r in word_bpe.digests(documents(spark), tokenizer("word_bpe_49k.json")).collect()}
    whole = {r.doc_id: r for r in word_bpe.encode(documents(spark), tokenizer("word_bpe_49k.json")).collect()}
    for i, text in enumerate(TEXTS):
        ids = word[0].encode(text or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(bytes(whole[i].ids)).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(word[0].decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_packing(spark, word):
    plan = packing.Plan(capacity=64, group_pieces=50)
    rows = packing.pack(documents(spark), tokenizer("word_bpe_49k.json"), plan).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0
        assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
        assert parts[-1][0] + parts[-1][1] <= 64
    for i, text in enumerate(TEXTS):
        ids = [*word[0].encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        if i != 3:
            want = [(n, s, len(ids[s : s + 64]), zlib.crc32(struct.pack(f"<{len(ids[s : s + 64])}I", *ids[s : s + 64]))) for n, s in enumerate(range(0, len(ids), 64))]
            assert own == want
    assert packing.pack(documents(spark).where("false"), tokenizer("word_bpe_49k.json"), plan).count() == 0


def first_fit(lengths, capacity):
    gaps = []
    for size in lengths:
        at = next((i for i, g in enumerate(gaps) if g >= size), None)
        if at is None:
            gaps.append(capacity - size)
        else:
            gaps[at] -= size
    return len(gaps)


def test_places_by_sum_of_squares():
    """Each piece goes where a plain count of all squares is smallest."""
    import numpy as np

    rnd = np.random.default_rng(5)
    lengths = rnd.integers(1, 40, 300)
    got, used = packing.sum_of_squares(lengths, 40)
    gaps = []
    for size, bin_ in zip(lengths.tolist(), got.tolist(), strict=True):
        squares = {}
        for g in {g for g in gaps if g >= size}:
            after = [*gaps, g - size]
            after.remove(g)
            squares[g] = sum(after.count(x) ** 2 for x in set(after) if x)
        if bin_ == len(gaps):
            assert not squares
            gaps.append(40 - size)
        else:
            assert squares[gaps[bin_]] == min(squares.values())
            gaps[bin_] -= size
    assert used == len(gaps)


def test_packing_reaches_the_bound(spark):
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), tokenizer("word_bpe_49k.json")).collect()
    used, bound = len({r.sequence_id for r in rows}), -(-sum(r.length for r in rows) // 2048)
    assert used <= bound + 1


def test_packing_of_text_ids(spark):
    df = spark.createDataFrame([("b", "one", 1), (None, "two", 2), ("a", None, 3), ("b", "one", 1)], "doc_id string, text string, deal int")
    assert sorted((r.doc_id or "", r.length > 0) for r in packing.pack(df, tokenizer("word_bpe_49k.json")).collect()) == [("", True), ("a", True), ("b", True), ("b", True)]


def test_packing_is_tight():
    import numpy as np

    for most, loss in ((700, 1.02), (2048, None)):
        lengths = np.random.default_rng(1).integers(1, most + 1, 3000)
        bins, n = packing.packed(lengths, 2048)
        assert np.bincount(bins, weights=lengths).max() <= 2048
        assert len(np.unique(bins)) == n
        assert n <= (loss * -(-lengths.sum() // 2048) if loss else 1.03 * first_fit(sorted(lengths.tolist(), reverse=True), 2048))
