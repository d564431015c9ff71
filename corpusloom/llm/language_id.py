"""Language identification by words first, then ever shorter character n-grams.

A word that the learned tables know is scored by its log frequency in each
language. An unseen word backs off to its n-grams: those of the greatest
length of which any is known are averaged. A text's score is the softmax of
the languages' mean scores for a word.

The tables come from a bounded sample of labelled rows (Fit.sample_rows), so
they are bounded too and every worker holds them whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import short_batches, text_column

#: Words are runs of letters, in lower case; the numerals among them (fractions, letter numbers) are taken out afterwards.
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
MEMO_ENTRIES = 150_000
MEMO_CHARS = 64
UNKNOWN = "und"


@dataclass(frozen=True)
class Fit:
    """sample_rows: labelled rows to learn from, taken evenly by a hash (about so many, all if fewer).

    A word or n-gram is known from least_count occurrences on; n-grams are of
    longest down to 1 characters of the word with a space at both ends; smooth
    is added to every count.
    """

    sample_rows: int = 3_000
    least_count: int = 2
    longest: int = 4
    smooth: float = 0.5


def words_of(text: str) -> Counter:
    """How often each word occurs; a word has a letter (Unicode category L)."""
    found = Counter(WORD.findall(text.lower()))
    for word in [w for w in found if not w.isalpha()]:
        letters = "".join(c for c in word if c.isalpha() or c in "'’").strip("'’")
        if letters != word:
            times = found.pop(word)
            if letters:
                found[letters] += times
    return found


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


class Model:
    """Log frequencies by language: of words, and of n-grams by length."""

    def __init__(self, counts: list[tuple[str, int, str, int]], fit: Fit):
        """counts: (language, n or 0 for words, the word or n-gram, how often)."""
        self.langs = sorted({lang for lang, *_ in counts})
        self.longest = fit.longest
        at = {lang: i for i, lang in enumerate(self.langs)}
        seen: dict[int, dict[str, list[float]]] = {n: {} for n in range(fit.longest + 1)}
        total = {n: [0.0] * len(self.langs) for n in seen}
        for lang, n, gram, count in counts:
            seen[n].setdefault(gram, [0] * len(self.langs))[at[lang]] += count
            total[n][at[lang]] += count
        self.tables = {}
        for n, table in seen.items():
            kinds = len(table) + 1
            low = [log(t + fit.smooth * kinds) for t in total[n]]
            self.tables[n] = {g: tuple(log(c + fit.smooth) - d for c, d in zip(cs, low, strict=True)) for g, cs in table.items()}
        self.memo: dict[str, tuple[float, ...] | None] = {}

    def word(self, word: str) -> tuple[float, ...] | None:
        found = self.tables[0].get(word)
        n = self.longest
        while found is None and n:
            known = [s for g in grams(word, n) if (s := self.tables[n].get(g))]
            if known:
                found = tuple(sum(x) / len(known) for x in zip(*known, strict=True))
            n -= 1
        return found

    def predict(self, text: str) -> tuple[str, float]:
        """The language and its share of the probability; und and 0 without a letter."""
        words = words_of(text)
        if not words:
            return UNKNOWN, 0.0
        if not self.langs:
            return UNKNOWN, 0.0
        sums, weight = [0.0] * len(self.langs), 0
        for word, times in words.items():
            if word in self.memo:
                scores = self.memo[word]
            else:
                scores = self.word(word)
                if len(word) <= MEMO_CHARS:
                    if len(self.memo) >= MEMO_ENTRIES:
                        self.memo.clear()
                    self.memo[word] = scores
            if scores is not None:
                weight += times
                for i, s in enumerate(scores):
                    sums[i] += times * s
        means = [s / weight for s in sums] if weight else sums
        best = max(means)
        shares = [exp(m - best) for m in means]
        top = shares.index(max(shares))
        return self.langs[top], shares[top] / sum(shares)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}


def learn(labelled: DataFrame, fit: Fit = Fit()) -> Model:
    """A model from text and lang of labelled (rows without a language or text are left out)."""
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.count()
    if n > fit.sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 30)) < int((1 << 30) * fit.sample_rows / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.update({(lang, w): n for w, n in words_of(text).items()})
        counts: Counter = Counter()
        for (lang, word), times in found.items():
            counts[lang, 0, word] += times
            for k in range(1, fit.longest + 1):
                for g in grams(word, k):
                    counts[lang, k, g] += times
        langs, sizes, names = zip(*counts, strict=True) if counts else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(names, pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "n", "gram", "times"])

    counted = short_batches(rows).mapInArrow(run, "lang string, n int, gram string, times long")
    known = counted.groupBy("lang", "n", "gram").agg(F.sum("times").alias("times")).where(F.col("times") >= fit.least_count)
    got = known.toArrow()
    return Model(list(zip(*(got.column(i).to_pylist() for i in range(4)), strict=True)), fit)


def predict(docs: DataFrame, model: Model, lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Every row of docs with its columns (text and any others) and at the end the language and its share, so named."""

    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            got = [own.predict(t or "") for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*b.schema.names, lang_pred, score])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField(lang_pred, StringType()), StructField(score, DoubleType())])
    return short_batches(docs).mapInArrow(run, schema)


def held_out(doc_id, folds: int, fold: int):
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def identify(docs: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs.

    docs: doc_id, text and lang; other columns are ignored, whatever their
    names. The model learns from rows that are not held out and have a
    language; lang, source and doc_id are no inputs of a prediction. Texts that
    are null or without a letter (Unicode category L) are und with score 0, and
    so is every text if there is nothing to learn from. A text of which no word
    and no character is known gets the first language in order with an even
    share. Very long texts are read whole; languages with equal scores go by
    their names. Repeated rows stay; no rows give no rows.
    """
    fold = held_out(F.col("doc_id"), 4, 2)
    model = learn(docs.where(~fold), fit)
    rows = docs.select("doc_id", fold.alias("held_out"), text_column(docs).alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
