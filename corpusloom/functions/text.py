"""Text functions as column expressions: tokens, sentences, lemmas, tags, terms.

Everything here is built from Spark's own functions, so it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import lexicons as L

#: What a token, a sentence end and the US abbreviation look like.
TOKEN = r"[A-Za-zА-Яа-яЁёІіЇїЄє'\-]+"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"
US = r"(?i)\bu\.\s*s\.?\s*a?\.?\b"
#: Endings that the light lemmatiser takes off, in this order.
ENGLISH_ENDINGS = ("ing", "ed", "ly", "es")
INDONESIAN_ENDINGS = ("nya", "lah", "kah", "pun", "ku", "mu", "an", "kan")
#: Endings by part of speech, looked for in this order.
TAG_ENDINGS = {"ADV": ("ly", "но", "nya"), "VERB": ("ing", "ed", "ize", "ise", "kan", "ть", "ти", "лся", "лась"), "ADJ": ("ous", "ive", "al", "ic", "ный", "ская", "ской", "ший", "est")}
#: Lines with one of these are boilerplate.
BOILERPLATE = ("read also", "baca juga", "follow us", "ikuti kami", "whatsapp channel", "join our", "share this", "comments", "please enter valid email", "log in", "sign up")


def literal_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def among(value: Column, values: Iterable[str]) -> Column:
    """Membership in a fixed set (one hash lookup, however large the set)."""
    return value.isin(*values)


def held(value: Column) -> Column:
    """The value, behind a condition that the optimiser may not look through.

    Filters are else pushed below the projection that makes a costly column,
    which then is worked out again at each of its uses.
    """
    return F.when(F.rand(0) >= 0.0, value)


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_token(token: Column, chars: str = "-'_") -> Column:
    return F.btrim(F.lower(token), F.lit(chars))


def tokenize(text: Column, us: bool = False) -> Column:
    """Tokens in lower case; us: the US abbreviation becomes usa first."""
    given = F.regexp_replace(text, US, " usa ") if us else text
    found = F.regexp_extract_all(given, F.lit(f"({TOKEN})"), F.lit(1))
    return F.filter(F.transform(found, lambda t: normalize_token(t)), lambda t: t != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), stripped), lambda s: s != "")


def is_content(token: Column, stopwords: Sequence[str] = L.STOPWORDS_CORE) -> Column:
    return ~among(token, stopwords) & (F.length(token) >= 2)


def content(tokens: Column, stopwords: Sequence[str] = L.STOPWORDS_CORE) -> Column:
    return F.filter(tokens, lambda t: is_content(t, stopwords))


def n_content(text: Column, stopwords: Sequence[str] = L.STOPWORDS_CORE) -> Column:
    return F.size(content(tokenize(text), stopwords))


def lemma(token: Column) -> Column:
    """The token without its first matching ending; English endings come first."""
    out = None
    for ending in (*ENGLISH_ENDINGS, *INDONESIAN_ENDINGS):
        fits = token.endswith(ending) & (F.length(token) > len(ending) + 2)
        short = token.substr(F.lit(1), F.length(token) - len(ending))
        out = F.when(fits, short) if out is None else out.when(fits, short)
    return out.otherwise(token)


def preprocess(tokens: Column, use_lemma: bool = True, stopwords: Sequence[str] = L.STOPWORDS_STRICT) -> Column:
    """Without stopwords, as lemmas, and of these the content words."""
    kept = F.filter(tokens, lambda t: ~among(t, stopwords))
    return F.filter(F.transform(kept, lemma) if use_lemma else kept, lambda t: is_content(t, stopwords))


def strip_boilerplate(text: Column) -> Column:
    bad = lambda line: F.lower(line).rlike("|".join(BOILERPLATE))
    return F.array_join(F.filter(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda line: ~bad(line)), "\n")


def detect_language(tokens: Column, source: Column) -> Column:
    """The language with most of its hint words present, if two are; else the outlet's, else mixed."""
    distinct = F.array_distinct(tokens)
    hits = {lang: F.size(F.array_intersect(distinct, literal_array(hints))) for lang, hints in L.LANG_HINTS.items()}
    best = F.greatest(*hits.values())
    outlet = F.create_map(*[F.lit(x) for pair in L.SOURCE_LANG_DEFAULT.items() for x in pair])
    out = None
    for lang, n in hits.items():
        fits = (n == best) & (best >= 2)
        out = F.when(fits, lang) if out is None else out.when(fits, lang)
    return out.otherwise(F.coalesce(F.get(F.array(outlet[source]), F.lit(0)), F.lit("mixed")))


def tag(token: Column, stopwords: Sequence[str] = L.STOPWORDS_CORE) -> Column:
    out = F.when(among(token, stopwords), "FUNC")
    for name, endings in TAG_ENDINGS.items():
        fits = token.endswith(endings[0])
        for ending in endings[1:]:
            fits = fits | token.endswith(ending)
        out = out.when(fits, name)
    return out.otherwise("NOUN")


def pos_tag(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.struct(t.alias("token"), tag(t).alias("pos")))


def quoted(term: str) -> str:
    """A regular expression for a whole-word literal that Java and RE2 read alike."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&~#" or c == "/" else c for c in term)


def term_pattern(term: str) -> str:
    return rf"(?iuU)\b{quoted(term)}\b"


def any_pattern(terms: Iterable[str]) -> str:
    """One alternation, to look first whether any term is there at all."""
    return r"(?iuU)\b(?:" + "|".join(map(quoted, sorted(terms, key=len, reverse=True))) + r")\b"


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """struct(term, n) of every term that occurs: terms are counted independently, so nested ones count twice.

    One alternation is tried first; most texts hold none of the terms and are
    done with it. The terms are then walked as an array, which keeps the plan
    small however many they are.
    """
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(term_pattern(t)).alias("pattern")) for t in sorted(set(terms))])
    counted = F.transform(pairs, lambda p: F.struct(p["term"].alias("term"), F.regexp_count(text, p["pattern"]).cast("int").alias("n")))
    found = F.filter(counted, lambda x: x["n"] > 0)
    return F.when(text.rlike(any_pattern(terms)), found).otherwise(F.filter(F.array(F.struct(F.lit("").alias("term"), F.lit(0).alias("n"))), lambda x: F.lit(False)))


def total(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0), lambda s, x: s + x["n"])


def found_terms(hits: Column) -> Column:
    return F.array_sort(F.transform(hits, lambda x: x["term"]))


def score_by_terms(hits: Column, most: int) -> Column:
    return F.least(F.lit(most), F.size(hits))


def first_span(text: Column, term: Column, around: int = 25) -> Column:
    """The first whole-word match with some characters on both sides, or the empty text."""
    escaped = F.regexp_replace(term, r"([^\p{L}\p{N}\s])", r"\\$1")
    at = F.regexp_instr(text, F.concat(F.lit(r"(?iuU)\b"), escaped, F.lit(r"\b")))
    start = F.greatest(at - around, F.lit(1))
    return F.when((at > 0) & (term != ""), F.substring(text, start, at - start + F.length(term) + around)).otherwise("")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def hits_in(tokens: Column, terms: Iterable[str]) -> Column:
    """How many of the tokens are in a fixed set."""
    terms = list(terms)
    return F.size(F.filter(tokens, lambda t: among(t, terms)))


def hits_by_language(tokens: Column, language: Column, by_language: dict[str, Iterable[str]], otherwise: Iterable[str]) -> Column:
    """hits_in with the set of the text's language."""
    out = None
    for lang, terms in by_language.items():
        n = hits_in(tokens, terms)
        out = F.when(language == lang, n) if out is None else out.when(language == lang, n)
    return out.otherwise(hits_in(tokens, otherwise))


def levels(value: Column, bounds: Sequence[float], names: Sequence[str], inclusive: bool = False) -> Column:
    """The name of the first bound that the value is below (or, inclusive, not above); the last name beyond all."""
    out = None
    for bound, name in zip(bounds, names, strict=False):
        fits = value <= bound if inclusive else value < bound
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise(names[-1])


def level_5(value: Column, cutoffs: Sequence[float]) -> Column:
    return levels(value, cutoffs, ("very_low", "low", "medium", "high", "very_high"))


def empirical_level(percentile: Column) -> Column:
    return levels(percentile, (10, 20, 35, 50, 65, 80, 90, 97), ("minimal", "very_low", "low", "moderately_low", "medium", "elevated", "high", "very_high", "extreme"), inclusive=True)


def cramers_v_label(v: Column) -> Column:
    return levels(v, (0.1, 0.3, 0.5), ("negligible", "small", "moderate", "strong"))


def coarse_from_raw(evi: Column) -> Column:
    return F.when(evi <= -8, -2).when(evi <= -3, -1).when(evi < 3, 0).when(evi < 8, 1).otherwise(2)


def evi_percent(evi_norm: Column) -> Column:
    return clamp((evi_norm + 1.0) * 50.0, 0.0, 100.0)


def split_cell(cell: Column) -> Column:
    return F.filter(F.transform(F.split(cell, ";"), stripped), lambda x: x != "")


def truthy(value: Column) -> Column:
    """What counts as yes in reviews."""
    return F.coalesce(F.lower(stripped(value.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def is_verified(value: Column) -> Column:
    """What counts as verified in dictionaries."""
    return truthy(value) | F.coalesce(F.lower(stripped(value.cast("string"))) == "verified", F.lit(False))


def year_in(text: Column) -> Column:
    """The first year 20xx that stands alone, as an int, or null."""
    return F.regexp_extract(text, r"\b(20\d{2})\b", 1).try_cast("int")


def excel_safe(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), 1, 32767)


def highlight(text: Column, terms: Iterable[str]) -> Column:
    return F.regexp_replace(text, "(" + any_pattern(terms) + ")", "<mark>$1</mark>")


def html_text(html: Column) -> Column:
    """The bodies of paragraphs (tags inside stay), or else all text without tags; scripts and styles go first."""
    plain = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    paragraphs = F.regexp_extract_all(plain, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    joined = F.when(F.size(paragraphs) > 0, F.array_join(paragraphs, " ")).otherwise(F.regexp_replace(plain, r"(?s)<[^>]+>", " "))
    return stripped(F.regexp_replace(joined, r"(?U)\s+", " "))


def number_text(x: Column) -> Column:
    """A double in the fewest digits, with an exponent only below 0.0001 and from 1e16 on, as Python writes it (Spark has one below 0.001 and from 10,000,000 on)."""
    own = x.cast("string")
    whole = F.regexp_replace(F.regexp_replace(own.try_cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    short = F.regexp_replace(F.regexp_replace(F.replace(own, F.lit(".0E"), F.lit("E")), r"E(\d)", "E+$1"), r"E([+-])(\d)$", "E$10$2")
    return F.when(~own.contains("E"), own).when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), whole).otherwise(F.lower(short))
