"""What a collector decides about fetched pages: text, links, countries, themes, caps, volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Patterns by country (any letter case, then as written) and by theme.
COUNTRIES = {
    "usa": ((r"\bUnited States\b", r"\bU\.?S\.?A\.?\b", r"\bAmerika Serikat\b", r"\bAmerika Syarikat\b", r"\bAmerican\b", r"\bWashington\b", r"\bGedung Putih\b", r"\bWhite House\b", r"\bPentagon\b", r"\bUS Congress\b", r"\bState Department\b", r"\bFederal Reserve\b", r"\bWall Street\b"), (r"\bUS\b", r"\bAS\b")),
    "russia": ((r"\bRussia\b", r"\bRusia\b", r"\bRussian\b", r"\bMoscow\b", r"\bKremlin\b", r"\bPutin\b", r"\bLavrov\b", r"\bRussian economy\b", r"\bRussian military\b", r"\bEurasian\b"), ()),
    "china": ((r"\bChina\b", r"\bChinese\b", r"\bCina\b", r"\bTiongkok\b", r"\bBeijing\b", r"\bXi Jinping\b", r"\bCCP\b", r"\bCPC\b", r"\bCommunist Party of China\b", r"\bBelt and Road\b", r"\bBRI\b", r"\bYuan\b", r"\bRenminbi\b", r"\bTaiwan Strait\b", r"\bSouth China Sea\b"), ()),
}
THEMES = {
    "security": (r"\bwar\b", r"\bmilitary\b", r"\bdefense\b", r"\bsecurity\b", r"\bthreat\b", r"\bmissile\b", r"\bperang\b", r"\bmiliter\b", r"\bpertahanan\b", r"\bkeamanan\b", r"\bancaman\b"),
    "economy": (r"\beconomy\b", r"\btrade\b", r"\btariff\b", r"\binvestment\b", r"\bmarket\b", r"\binflation\b", r"\bcurrency\b", r"\bekonomi\b", r"\bperdagangan\b", r"\btarif\b", r"\binvestasi\b", r"\bpasar\b"),
    "diplomacy": (r"\bdiplomacy\b", r"\bdiplomatic\b", r"\bmeeting\b", r"\bminister\b", r"\bsummit\b", r"\bagreement\b", r"\bdiplomasi\b", r"\bpertemuan\b", r"\bmenteri\b", r"\bktt\b", r"\bkesepakatan\b"),
    "culture": (r"\bculture\b", r"\bcultural\b", r"\bartist\b", r"\bmusic\b", r"\bfilm\b", r"\bsport\b", r"\bsports\b", r"\bbudaya\b", r"\bseniman\b", r"\bmusik\b", r"\bfilm\b", r"\bolahraga\b"),
}
COUNTRY_WINDOW, THEME_WINDOW = 2500, 4000


def hits(text: Column, patterns: tuple[str, ...], flags: str) -> Column:
    """The sum of every pattern's own hits; one alternation is tried first."""
    if not patterns:
        return F.lit(0)
    # constant patterns are compiled once, which those of an array would be for every row
    counted = sum((F.regexp_count(text, F.lit(flags + p)).cast("int") for p in patterns[1:]), F.regexp_count(text, F.lit(flags + patterns[0])).cast("int"))
    return F.when(text.rlike(flags + "(?:" + "|".join(patterns) + ")"), counted).otherwise(0)


def scores(title: Column, content: Column, profiles: dict, window: int) -> Column:
    """A map of the profiles that occur in the title and the start of the content, with their hits."""
    sample = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(content, F.lit("")), 1, window))
    counted = [x for name, p in profiles.items() for x in (F.lit(name), hits(sample, p[0], "(?iu)") + hits(sample, p[1], "") if isinstance(p[0], tuple) else hits(sample, p, "(?iu)"))]
    return F.map_filter(F.create_map(*counted), lambda _, v: v > 0)


def primary(found: Column, names: list[str], otherwise: str | None = None) -> Column:
    """The name with most hits, the first of the order among equals."""
    most = F.array_max(F.map_values(found))
    out = None
    for n in names:
        fits = F.coalesce(F.try_element_at(found, F.lit(n)), F.lit(0)) == most
        out = F.when(fits, n) if out is None else out.when(fits, n)
    return out.otherwise(F.lit(otherwise))


def classified(articles: DataFrame) -> DataFrame:
    """Articles (title, content) that name a country, with scores, primary country and theme."""
    rows = articles.withColumns({"country_scores": scores(F.col("title"), F.col("content"), COUNTRIES, COUNTRY_WINDOW), "theme_scores": scores(F.col("title"), F.col("content"), THEMES, THEME_WINDOW)}).where(F.size("country_scores") > 0)
    themes = F.when(F.size("theme_scores") > 0, F.array_sort(F.map_keys("theme_scores"))).otherwise(F.array(F.lit("general")))
    return rows.withColumns({"primary_country": primary(F.col("country_scores"), list(COUNTRIES)), "primary_subcorpus": primary(F.col("theme_scores"), list(THEMES), "general"), "subcorpora_detected": themes, "countries_detected": F.map_keys("country_scores")})


def capped(rows: DataFrame, most: int, keys: tuple[str, ...] = ("source", "primary_country", "year"), order: str = "seq") -> DataFrame:
    """The first rows of each key, in crawl order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def volumes(rows: DataFrame) -> dict[str, DataFrame]:
    """Counts over all countries and themes that an article has."""
    by_country = rows.withColumn("country", F.explode("countries_detected"))
    by_theme = rows.withColumn("theme", F.explode("subcorpora_detected"))
    n = F.count("*").alias("count")
    return {"source_country_year": by_country.groupBy("source", "country", "year").agg(n), "source_country": by_country.groupBy("source", "country").agg(n), "source_theme_year": by_theme.groupBy("source", "theme", "year").agg(n), "theme_country": by_theme.groupBy("theme", F.col("primary_country").alias("country")).agg(n)}


def page_text(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", T.html_text(F.coalesce("html", F.lit(""))))


def links(html: Column, must: str | None = None) -> Column:
    """The distinct targets of links in order, those that match a pattern."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)href\s*=\s*["\']([^"\']+)["\']'), F.lit(1)))
    return found if must is None else F.filter(found, lambda u: u.rlike(must))


def article_fields(html: Column) -> Column:
    """struct(title, content, date) of a page: headline or meta title, long paragraphs, meta date."""
    first = lambda *patterns: F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns], F.lit(""))
    title = first(r"(?is)<h1[^>]*>(.*?)</h1>", r'(?is)<meta[^>]+property=["\']og:title["\'][^>]+content=["\']([^"\']*)', r"(?is)<title[^>]*>(.*?)</title>")
    date = first(r'(?is)<meta[^>]+property=["\']article:published_time["\'][^>]+content=["\']([^"\']*)', r'(?is)<time[^>]+datetime=["\']([^"\']*)')
    clean = lambda x: T.stripped(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]+>", " "), r"(?U)\s+", " "))
    body = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), clean), lambda p: (F.length(p) >= 40) & ~F.lower(p).rlike("|".join(T.BOILERPLATE))))
    return F.struct(clean(title).alias("title"), F.when(F.size(body) >= 3, F.array_join(body, "\n")).otherwise("").alias("content"), date.alias("date"))
