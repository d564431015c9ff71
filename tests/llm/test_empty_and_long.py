"""Tables without rows and very long texts, where the other tests have none."""

import hashlib

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import quality_rules, queries, simhash, warc, word_bpe

PAGES = "page_id long, url string, html string"
DOCS = "doc_id long, text string, lang string, source string"


def test_tables_without_rows(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).collect() == []
    docs = spark.createDataFrame([], DOCS)
    assert word_bpe.digests(docs, queries.tokenizer("word_bpe_49k.json")).collect() == []
    assert simhash.near_duplicates(docs, radius=2, width=3).collect() == []
    assert quality_rules.verdicts(docs).collect() == []


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(150_000))
    docs = spark.createDataFrame([(1, long, "en", "s"), (2, long + " end", "en", "s"), (3, "y" * 1_000_000, "en", "s")], DOCS)
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, radius=2, width=3).collect()}
    assert near == {1: 1, 2: 1, 3: 3}
    rules = {r.doc_id: r for r in quality_rules.verdicts(docs).collect()}
    assert (rules[1].n_words, rules[2].n_words, rules[3].n_words) == (150_000, 150_001, 1) and rules[1].n_repeat_words == 0 and rules[3].base_failed
    pages = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", None)], PAGES)
    back = {r.page_id: r for r in warc.archive_round_trip(pages).select("page_id", "payload_bytes", "record_type", "refers_to").collect()}
    assert (back[1].payload_bytes, back[1].record_type, back[1].refers_to, back[2].record_type, back[3].payload_bytes) == (len(long), "revisit", 2, "response", 0)
    got = word_bpe.digests(docs.where(F.col("doc_id") == 3), queries.tokenizer("word_bpe_49k.json")).first()
    library = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    ids = library.encode("y" * 1_000_000, add_special_tokens=False).ids
    assert (got.n_tokens, got.decoded_sha256) == (len(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
