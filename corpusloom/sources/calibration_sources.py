"""Texts of a calibration corpus from a list of sources, each with a plan for its mode."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import numbering
from corpusloom.sources import io


@dataclass(frozen=True)
class Source:
    """A source: local files, a list of addresses, or a feed; a disabled one is not read."""

    source_name: str = "Unnamed source"
    mode: str = "local"
    language: str = "en"
    calibration_type: str = "standard_political_news"
    expected_indicator_focus: str = "mixed"
    path: str | None = None
    rss_url: str | None = None
    url_csv_path: str | None = None
    enabled: bool = True
    notes: str = ""


#: The columns of a collected text, and those that a list of addresses needs.
COLUMNS = (
    "calibration_id", "doc_id", "source_name", "source_url", "fetch_mode", "fetch_status", "publication_date", "title", "author", "outlet", "language",
    "country_context", "calibration_type", "expected_indicator_focus", "ref_country", "text", "text_length_words", "notes", "anchor_status", "quality_flags",
)
URL_COLUMNS = ("url", "source_name", "calibration_type", "expected_indicator_focus", "language", "ref_country", "notes")
#: Parts of a page that is only for subscribers.
PAYWALL = ("subscribe", "paywall", "premium")
OFF = ("false", "no", "off", "0")


def read_sources(listing: str) -> list[Source]:
    """The sources of a YAML list: entries under "sources:" that start with a dash, a key and a value on each line.

    Values may be quoted; comments and keys that are not known are passed over.
    """
    entries: list[dict] = []
    for line in listing.splitlines():
        m = re.match(r"\s*(-\s+)?([A-Za-z_]+)\s*:\s*(.*?)\s*$", line)
        if line.strip().startswith("#") or m is None or (not m[1] and m[2] == "sources"):
            continue
        if m[1]:
            entries.append({})
        if entries:
            quoted = re.match(r"(['\"])(.*?)\1", m[3])
            entries[-1][m[2]] = quoted[2] if quoted else re.sub(r"\s+#.*$", "", m[3])
    known = {f.name for f in fields(Source)}
    return [Source(**{k: v.lower() not in OFF if k == "enabled" else v for k, v in e.items() if k in known and (v or k == "notes")}) for e in entries]


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def completed(rows: DataFrame, values: dict[str, Column | str]) -> DataFrame:
    """rows as collected texts: what values do not say is empty; blank texts of files and hands are left out before."""
    of = {"anchor_status": "none", "publication_date": "", "author": "", "country_context": "", "ref_country": "", "source_url": "", "title": "", "notes": "", "quality_flags": "", "fetch_status": "ok"} | values
    of["text_length_words"] = words(F.col("text"))
    return rows.select(*[(F.lit(of[c]) if isinstance(of[c], str) else of[c] if c in of else F.col(c)).alias(c) if c in of else F.col(c) for c in COLUMNS])


def resolved(path: str, base: str) -> str:
    return path if re.match(r"^([A-Za-z][A-Za-z0-9+.-]*:|/)", path) else f"{base.rstrip('/')}/{path}"


def local_texts(spark: SparkSession, source: Source, base: str) -> DataFrame:
    """The texts of files under a path, numbered in the order of their names; the rows of tables are texts of their own."""
    tag = re.sub(r"[^a-z0-9]+", "_", source.source_name.lower()).strip("_") or "source"
    rows = io.read_files(spark, resolved(source.path, base)).withColumns({"file": F.regexp_replace("name", r"__row_\d+\.txt$", ""), "text": T.stripped(F.col("text"))})
    rows = numbering.numbered(rows.where(F.col("text") != ""), "row", ["name"])
    files = numbering.numbered(rows.select("file").distinct(), "number", ["file"])
    rows = rows.join(files, "file")
    ending = F.format_string(f"{tag}_%06d_%06d", "number", "row")
    title = F.regexp_replace(F.regexp_replace("name", r"^.*/", ""), r"\.[^.]*$", "")
    return completed(rows, {"calibration_id": F.concat(F.lit("cal_local_"), ending), "doc_id": F.concat(F.lit("cal_doc_"), ending), "source_name": source.source_name, "fetch_mode": "local", "title": title, "outlet": source.source_name, "language": source.language, "calibration_type": source.calibration_type, "expected_indicator_focus": source.expected_indicator_focus, "notes": source.notes})


def listed_texts(spark: SparkSession, source: Source, base: str, fetched: DataFrame | None) -> DataFrame:
    """A row for each address of a list, with its text where fetched (url, body) has the page; others failed.

    Nothing is fetched here. The pages are what a crawler left, say an archive.
    """
    path = resolved(source.url_csv_path, base)
    table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if missing := [c for c in URL_COLUMNS if c not in table.columns]:
        raise ValueError(f"the list of addresses lacks the columns {', '.join(missing)}")
    rows = numbering.numbered(table.select(*[F.coalesce(c, F.lit("")).alias(c) for c in URL_COLUMNS]), "row").withColumn("url", T.stripped(F.col("url"))).where(F.col("url") != "")
    pages = fetched.groupBy("url").agg(F.min("body").alias("body")) if fetched is not None else spark.createDataFrame([], "url string, body string")
    rows = rows.join(pages, "url", "left")
    body = F.coalesce("body", F.lit(""))
    closed = F.lower(body).rlike("|".join(PAYWALL))
    plain = F.when(F.lower(body).contains("<html"), T.html_text(body)).otherwise(body)
    failed = F.col("body").isNull() | closed
    rows = rows.withColumns({"text": F.when(failed, "").otherwise(plain), "reason": F.when(F.col("body").isNull(), "not_fetched").when(closed, "paywall_detected").otherwise("")})
    return completed(rows, {"calibration_id": F.format_string("cal_url_%06d", "row"), "doc_id": F.format_string("cal_doc_url_%06d", "row"), "source_url": F.col("url"), "fetch_mode": "url_list", "fetch_status": F.when(failed, "fetch_failed").otherwise("ok"), "outlet": F.col("source_name"), "source_name": F.col("source_name"), "language": F.col("language"), "calibration_type": F.col("calibration_type"), "expected_indicator_focus": F.col("expected_indicator_focus"), "ref_country": F.col("ref_country"), "notes": F.coalesce(F.nullif("notes", F.lit("")), "reason")})


def manual_texts(rows: DataFrame) -> DataFrame:
    """Rows that someone typed: place, text and any of the columns of a collected text."""
    rows = numbering.numbered(rows.withColumn("text", T.stripped(F.coalesce("text", F.lit("")))), "row", ["place"]).where(F.col("text") != "")
    given = lambda c, otherwise: F.coalesce(F.col(c).cast("string"), otherwise) if c in rows.columns else otherwise
    known = {"source_name": "manual", "outlet": "manual", "language": "en", "calibration_type": "standard_political_news", "expected_indicator_focus": "mixed", "author": "", "source_url": "", "publication_date": "", "country_context": "", "ref_country": "", "notes": "", "anchor_status": "none"}
    values = {c: given(c, F.lit(v)) for c, v in known.items()}
    return completed(rows, values | {"calibration_id": given("calibration_id", F.format_string("cal_manual_%06d", "row")), "doc_id": F.format_string("cal_doc_manual_%06d", "row"), "fetch_mode": "manual", "title": given("title", F.format_string("manual_%d", "row"))})


def collected(spark: SparkSession, sources: list[Source], base: str, manual: DataFrame | None = None, fetched: DataFrame | None = None) -> DataFrame:
    """The texts of all enabled sources and of manual rows, without repeats of id and text.

    A source without the path its mode needs gives nothing; feeds would have to
    be fetched and give nothing either.
    """
    parts = []
    for source in sources:
        if source.enabled and source.mode == "local" and source.path:
            parts.append(local_texts(spark, source, base))
        elif source.enabled and source.mode == "url_list" and source.url_csv_path:
            parts.append(listed_texts(spark, source, base, fetched))
    if manual is not None:
        parts.append(manual_texts(manual))
    if not parts:
        return spark.createDataFrame([], ", ".join(f"{c} {'int' if c == 'text_length_words' else 'string'}" for c in COLUMNS))
    # a repeat is a row like its first one but for where it was met: any of them may stay
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["calibration_id", "text"])
