"""Articles out of pages: selectors of each site as a table, and a fold over the tags of a page.

Sites are rows (name, region, domain and lists of selectors); a page meets its
site by the endings of its host, so any number of sites is one join. A page is
read once: its elements are intervals over its pieces of text, in order, so what
stands within an element is a slice and nesting needs no tree.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Elements without content, and those whose text is no text of the page.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
HIDDEN = frozenset({"script", "style", "template", "rt", "rp"})
#: Where headline and date stand if a site's own selectors find none.
META_TITLE = "meta[property='og:title']"
META_DATE = "meta[property='article:published_time'], meta[name='pubdate']"
PARAGRAPHS = "article p, div p"
NO_DATE = "no_date"
#: Parts of paragraphs, in lower case, that are no text of an article.
NO_TEXT = ("please update your browser", "can't find what you're looking for", "by registering, you agree", "privacy policy", "iklan")
#: A paragraph counts from so many characters, and so many make a text.
LEAST_CHARS, LEAST_LINES = 40, 3

SITES = "name string, region string, domain string, title_selectors array<string>, content_selectors array<string>, date_selectors array<string>, data_path string"
FIELDS = "title string, content string, date string"


def sites(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A table of sites; data_path says where a page's JSON data (script __NEXT_DATA__) holds the article, null for none."""
    return spark.createDataFrame(rows, SITES)


class Page(HTMLParser):
    """The elements of a page in order, each with the pieces of text it spans.

    An end tag closes the innermost open element of its name with all that
    stands open within; without one it means nothing. Paragraphs nest as they
    are written.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attributes: list[dict] = []
        self.parents: list[int] = []
        self.spans: list[list[int]] = []
        self.pieces: list[str] = []
        self.raw: dict[int, str] = {}
        self.open: list[int] = []
        self.buffer: list[str] = []
        self.feed(html)
        self.close()
        self.flush()
        for i in self.open:
            self.spans[i][1] = len(self.pieces)

    def flush(self) -> None:
        if self.buffer:
            piece, self.buffer = "".join(self.buffer), []
            if any(self.tags[i] in HIDDEN for i in self.open):
                self.raw[self.open[-1]] = self.raw.get(self.open[-1], "") + piece
            elif piece.strip():
                self.pieces.append(piece.strip())

    def handle_starttag(self, tag, attrs):
        self.flush()
        at = len(self.pieces)
        self.tags.append(tag)
        self.attributes.append({k: v or "" for k, v in reversed(attrs)})
        self.parents.append(self.open[-1] if self.open else -1)
        self.spans.append([at, at])
        if tag not in VOID:
            self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        if any(self.tags[i] == tag for i in self.open):
            while True:
                i = self.open.pop()
                self.spans[i][1] = len(self.pieces)
                if self.tags[i] == tag:
                    break

    def handle_data(self, data):
        self.buffer.append(data)

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def text(self, i: int) -> str:
        """What an element says: its content or datetime attribute, or the pieces in it, a line each."""
        for a in ("content", "datetime"):
            if self.attributes[i].get(a):
                return self.attributes[i][a].strip()
        return "\n".join(self.pieces[slice(*self.spans[i])])

    def matches(self, i: int, steps: list) -> bool:
        """Whether an element fits the last step and elements around it the steps before, from the inside out."""
        tag, need = steps[-1]
        if (tag and self.tags[i] != tag) or not all(fits(self.attributes[i]) for fits in need):
            return False
        rest, i = steps[:-1], self.parents[i]
        while rest and i >= 0:
            tag, need = rest[-1]
            if (not tag or self.tags[i] == tag) and all(fits(self.attributes[i]) for fits in need):
                rest = rest[:-1]
            i = self.parents[i]
        return not rest

    def select(self, selector: str) -> Iterator[int]:
        """The elements that a selector fits, in the order of the page."""
        choices = parsed(selector)
        return (i for i in range(len(self.tags)) if any(self.matches(i, steps) for steps in choices))

    def first(self, selectors: list[str]) -> str:
        """What the first element of the first selector that fits any says."""
        for s in selectors:
            for i in self.select(s):
                return self.text(i)
        return ""


STEP = re.compile(r"([\w-]+|\*)?((?:[.#][\w-]+|\[[^\]]*\])*)")
CONDITION = re.compile(r"([.#])([\w-]+)|\[\s*([\w:-]+)\s*(?:=\s*['\"]?([^'\"\]]*)['\"]?)?\s*\]")
KNOWN: dict[str, list] = {}


def parsed(selector: str) -> list:
    """Choices of steps (tag, conditions): elements, classes, ids and attributes within one another."""
    if selector not in KNOWN:
        choices = []
        for choice in selector.split(","):
            steps = []
            for part in choice.split():
                m = STEP.fullmatch(part)
                if m is None:
                    raise ValueError(f"cannot read the selector {selector!r}")
                steps.append((m[1].lower() if m[1] and m[1] != "*" else None, [condition(*c.groups()) for c in CONDITION.finditer(m[2])]))
            choices.append(steps)
        KNOWN[selector] = choices
    return KNOWN[selector]


def condition(mark, name, attribute, value):
    if mark == ".":
        return lambda a: name in a.get("class", "").split()
    if mark == "#":
        return lambda a: a.get("id") == name
    return (lambda a: attribute in a) if value is None else (lambda a: a.get(attribute) == value)


def data_of(page: Page, path: str) -> dict | None:
    """The article that a page's JSON data holds: title, content (a page of its own, or a summary) and date."""
    node = next(page.select("script#__NEXT_DATA__"), None)
    try:
        data = json.loads(page.raw.get(node, ""))
        for key in path.split("."):
            data = data.get(key, {})
        title, body = str(data.get("title") or "").strip(), data.get("content")
        content = "\n".join(Page(body).pieces) if body else ""
        content = content or str(data.get("summary") or "").strip()
        created = data.get("created")
        date = datetime.fromtimestamp(created / 1000, tz=UTC).isoformat() if isinstance(created, (int, float)) else NO_DATE
    except (ValueError, AttributeError, TypeError, OverflowError):
        return None
    return {"title": title, "content": content, "date": date} if title and content else None


def paragraphs(page: Page) -> str:
    """The long paragraphs, each once, if there are some."""
    lines = dict.fromkeys(x for i in page.select(PARAGRAPHS) if len(x := page.text(i)) >= LEAST_CHARS and not any(b in x.casefold() for b in NO_TEXT))
    return "\n".join(lines) if len(lines) >= LEAST_LINES else ""


def article(html: str, title_selectors: list[str], content_selectors: list[str], date_selectors: list[str], data_path: str | None) -> dict:
    """title, content and date of a page; empty where nothing is found."""
    page = Page(html)
    title, content, date = page.first(title_selectors), page.first(content_selectors), page.first(date_selectors)
    if data_path and not (title and content) and (found := data_of(page, data_path)):
        title, content, date = found["title"], found["content"], found["date"]
    return {"title": title or page.first([META_TITLE]), "content": content or paragraphs(page), "date": date or page.first([META_DATE]) or NO_DATE}


def with_site(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Pages with their site: the one with the longest domain that their host ends with; others have none."""
    parts = F.split(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = pages.select("page_id", F.posexplode(endings).alias("_at", "domain")).join(known, "domain")
    first = hosts.groupBy("page_id").agg(F.min_by(F.struct(*known.columns), "_at").alias("site"))
    return pages.join(first, "page_id").select(*pages.columns, "site.*")


def articles(pages: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each page of a known site that has a headline and a text.

    pages: page_id (distinct), url, html; a null html is empty. The text column
    is the article as a file of the corpus: header lines, an empty line, content.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [article(h or "", list(t), list(c), list(d), p) for h, t, c, d, p in zip(b["html"], b["title_selectors"], b["content_selectors"], b["date_selectors"], b["data_path"], strict=True)]
            yield pd.concat([b[["page_id", "url", "name", "region"]].reset_index(drop=True), pd.DataFrame(found, columns=["title", "content", "date"])], axis=1)

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = with_site(pages.select("page_id", "url", "html"), known).mapInPandas(run, f"page_id {kind}, url string, name string, region string, {FIELDS}")
    rows = rows.where((F.col("title") != "") & (F.col("content") != "")).withColumn("year", year_of(F.col("date"), F.col("url")))
    head = [F.concat(F.lit(f"{k}: "), v, F.lit("\n")) for k, v in (("Source", F.col("name")), ("Region", F.col("region")), ("Title", F.col("title")), ("URL", F.col("url")), ("Date", F.col("date")), ("Year", F.coalesce(F.col("year").cast("string"), F.lit("no_year"))))]
    return rows.select("page_id", F.col("name").alias("source"), "region", "url", "title", "date", "year", "content", F.concat(*head, F.lit("\n"), F.col("content"), F.lit("\n")).alias("text"))


def year_of(date: Column, url: Column) -> Column:
    """The year of a date, or else of an address with year, month and day."""
    told = F.nullif(F.regexp_extract(date, r"((?:19|20)[0-9]{2})", 1), F.lit(""))
    return F.coalesce(told, F.nullif(F.regexp_extract(url, r"/((?:19|20)[0-9]{2})/[0-9]{2}/[0-9]{2}/", 1), F.lit(""))).cast("int")


def search_links(bodies: DataFrame, known: DataFrame) -> DataFrame:
    """bodies with links: the distinct targets in a search answer, in its order.

    bodies: answer_id, body, mode (queryly, algolia or page) and domain; known:
    domain with base (before relative targets), must (parts of an address, one
    of which is needed; none: any) and pattern (null: any). JSON bodies are read
    as they are: items of other shapes have no link, and what is no JSON has none.
    """
    host = lambda u: F.regexp_extract(u, r"^https?://([^/?#]+)", 1)
    rows = bodies.join(known, "domain", "left")
    each = lambda path, field: F.from_json(F.get_json_object("body", path), f"array<struct<{field}:string>>")
    queryly = F.transform(each("$.items", "link"), lambda x: T.stripped(x["link"]))
    whole = lambda u: F.when(u.startswith("http"), u).otherwise(F.concat(F.col("base"), F.regexp_replace(u, "^/+", "")))
    algolia = F.transform(F.filter(F.transform(each("$.hits", "canonical_url"), lambda x: T.stripped(x["canonical_url"])), lambda u: u != ""), whole)
    page = F.transform(F.regexp_extract_all("body", F.lit(r'(?i)<a\b[^>]*?\bhref\s*=\s*["\']\s*([^"\']+?)\s*["\']'), F.lit(1)), whole)
    fits = lambda u: ((F.size("must") == 0) | F.exists("must", lambda m: F.contains(u, m))) & (F.col("pattern").isNull() | F.regexp_like(u, F.col("pattern")))
    found = F.when(F.col("mode") == "queryly", queryly).when(F.col("mode") == "algolia", algolia).otherwise(F.filter(page, fits))
    kept = F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda u: u.startswith("http") & F.contains(host(u), F.col("domain")))
    return rows.select("answer_id", F.array_distinct(kept).alias("links"))
