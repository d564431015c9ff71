"""Readers and writers: tables, corpora of files, archives, exports."""

from __future__ import annotations

import html
import io
import json
import re
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import contexts

METADATA = "source string, region string, url string, date string, year string, title string, query_country string, query_term string, primary_country string, country_scores string, countries_detected string, primary_subcorpus string, subcorpora_detected string, theme_scores string, file_path string"
#: Names under which uploads hold a field, tried in this order, first whole and then as part of a name.
ALIASES = {"text": ("text", "content", "body", "article"), "title": ("title", "headline"), "source": ("source", "outlet_name", "outlet"), "date": ("date", "published"), "media_country": ("media_country", "country")}
#: Names of columns in uploaded tables, looked for in this order.
TABLE_COLUMNS = {
    "text": ("text", "content", "body", "article", "full_text", "текст", "материал"),
    "title": ("title", "headline", "заголовок"),
    "source": ("source", "outlet_name", "media", "publisher", "издание", "источник"),
    "date": ("date", "published_at", "datetime", "дата", "year", "год"),
    "media_country": ("media_country", "region", "страна_сми", "country"),
}
#: Parts of file names that tell an outlet, looked for in this order.
OUTLETS = {
    "antara": "Antara",
    "astro": "Astro Awani",
    "awani": "Astro Awani",
    "bernama": "Bernama",
    "kompas": "Kompas Indonesia",
    "tempo": "Tempo",
    "jakarta_post": "The Jakarta Post",
    "jakartapost": "The Jakarta Post",
    "the_star": "The Star",
    "thestar": "The Star",
    "the_edge": "The Edge Malaysia",
    "edge": "The Edge Malaysia",
}
#: The outlets of each country.
OUTLET_COUNTRIES = {
    "Malaysia": ("Astro Awani", "Bernama", "The Star", "The Edge Malaysia"),
    "Indonesia": ("Antara", "Kompas Indonesia", "Tempo", "The Jakarta Post"),
}
#: Hints of the country that a text is about; the first country wins ties and texts without a hint.
COUNTRY_HINTS = {
    "usa": ("usa", "united states", "america", "american", "washington", "u.s"),
    "russia": ("russia", "russian", "rusia", "moscow", "kremlin", "putin"),
    "china": ("china", "chinese", "cina", "tiongkok", "beijing", "xi jinping"),
}


#: Up to this size a table is dealt out anew to all cores.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small single file over all cores: it may be one row group, which one task would have to work on alone.

    Other tables stay as they are: they have row groups enough, and moving them
    costs more than it gains.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES and len(df.inputFiles()) == 1 else df


def load_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by its ending: csv, json (a list of rows or {"rows": [...]}), parquet, or xlsx through the driver."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "csv":
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if ending == "json":
        df = (spark.read.schema(schema) if schema else spark.read).option("multiLine", True).json(path)
        return df.select(F.inline("rows")) if df.columns == ["rows"] else df
    if ending == "parquet":
        return spark.read.parquet(path)
    if ending in ("xlsx", "xls"):
        return spark.createDataFrame(pd.read_excel(path, dtype=str).fillna(""))
    raise ValueError(f"unknown kind of table: {path}")


def column_for(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The column called by one of the names, the first name first, or else one whose name has one of them in it."""
    low = {c.lower(): c for c in columns}
    whole = next((low[n] for n in names if n in low), None)
    return whole or next((c for c in columns if any(n in c.lower() for n in names)), None)


def pick(df: DataFrame, field: str) -> str | None:
    """The column that holds a field."""
    return column_for(df.columns, ALIASES[field])


def as_documents(df: DataFrame, seq: str | None = None) -> DataFrame:
    """A table with any of the known column names as documents with the six required fields.

    Ids are doc_%06d by seq where there is one, else hashes of the row's text.
    """
    named = {f: F.col(c) if (c := pick(df, f)) else F.lit("") for f in ALIASES}
    doc_id = F.format_string("doc_%06d", F.col(seq)) if seq else F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat_ws("\x1f", named["title"].cast("string"), named["text"].cast("string")), 256), 1, 12))
    rows = df.select(doc_id.alias("doc_id"), named["media_country"].alias("media_country"), named["source"].alias("outlet_name"), named["date"].alias("date"), named["title"].alias("title"), T.strip_boilerplate(F.coalesce(named["text"].cast("string"), F.lit(""))).alias("text"))
    return contexts.required(rows)


def plain_path(path: Column) -> Column:
    """A path without its scheme and with escapes undone."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    return F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)


def body_of(whole: Column) -> Column:
    """What follows the first empty line, or all of a text without one."""
    lines = F.regexp_replace(whole, r"\r\n?", "\n")
    at = F.instr(lines, "\n\n")
    return F.when(at > 0, F.substring(lines, at + 2, F.length(lines))).otherwise(lines)


def read_corpus(spark: SparkSession, metadata_csv: str, min_year: int, max_year: int, folder: str | None = None) -> DataFrame:
    """Documents of a collector's metadata file: rows with a year in range and a file that is there, a row each.

    A relative file_path is taken from the metadata file's folder; folder says
    where else the texts are. seq is the order of the metadata file. Bytes that
    are no UTF-8 are left out.
    """
    meta = spark.read.schema(METADATA).option("header", True).option("multiLine", True).option("escape", '"').csv(metadata_csv)
    kept = meta.withColumns({"seq": F.monotonically_increasing_id(), "year": F.col("year").try_cast("int")}).where(F.col("year").between(min_year, max_year))
    home = metadata_csv.rsplit("/", 1)[0]
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder or home, wholetext=True)
    valid = F.coalesce(F.try_validate_utf8("value"), F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")))
    files = files.select(valid.alias("whole"), plain_path(F.col("_metadata.file_path")).alias("path"))
    given = F.when(F.col("file_path").rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?/"), plain_path(F.col("file_path"))).otherwise(F.concat(plain_path(F.lit(home + "/")), F.regexp_replace("file_path", r"^(\./)+", "")))
    rows = kept.withColumn("path", given).join(files, "path")
    return rows.select("seq", "source", "region", "year", F.col("primary_country").alias("country"), F.coalesce("title", F.lit("")).alias("title"), T.strip_boilerplate(body_of(F.col("whole"))).alias("text"))


def decode_bytes(raw: bytes) -> str:
    """Text in the first encoding that fits."""
    for name in ("utf-8", "cp1251"):
        try:
            return raw.decode(name).removeprefix("﻿")
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1")


def docx_text(raw: bytes) -> str:
    """The paragraphs of a word-processor file."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        xml = z.read("word/document.xml").decode("utf-8")
    paragraphs = ["".join(re.findall(r"<w:t[^>]*>([^<]*)</w:t>", p)) for p in re.findall(r"(?s)<w:p[ >].*?</w:p>", xml)]
    return "\n".join(html.unescape(p) for p in paragraphs if p.strip())


def pdf_text(raw: bytes) -> str:
    """The strings that a PDF's pages show, a line for each text object.

    Streams may be plain or deflated and strings literal or hexadecimal. Fonts
    with an encoding of their own are not looked up, so texts set in them come
    out as what they are stored as.
    """
    out = []
    for head, body in re.findall(rb"(?s)<<((?:(?!stream).)*?)>>\s*stream\r?\n(.*?)\r?\n?endstream", raw):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        for block in re.findall(rb"(?s)\bBT\b(.*?)\bET\b", body):
            shown = []
            for literal, packed in re.findall(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]+)>", block):
                data = bytes.fromhex(re.sub(r"\s", "", packed.decode()).ljust(2, "0")) if packed else re.sub(rb"\\(.)", lambda m: {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(m[1], m[1]), literal)
                shown.append(data.decode("utf-16-be", "ignore") if data.startswith(b"\xfe\xff") else data.decode("latin-1"))
            out.append("".join(shown))
    return "\n".join(x for x in out if x.strip())


def table_rows(name: str, raw: bytes) -> list[tuple[str, str]]:
    """The rows of a table in a file, each as a text with a header, like an uploaded file."""
    ending = name.rsplit(".", 1)[-1].lower()
    try:
        if ending == "csv":
            try:
                df = pd.read_csv(io.BytesIO(raw))
            except (ValueError, UnicodeDecodeError):
                df = pd.read_csv(io.BytesIO(raw), sep=None, engine="python")
        elif ending == "json":
            got = json.loads(decode_bytes(raw))
            df = pd.DataFrame(got.get("rows", got) if isinstance(got, dict) else got)
        else:
            df = pd.read_excel(io.BytesIO(raw))
    except (ValueError, ImportError, UnicodeDecodeError, zipfile.BadZipFile):
        return []
    df = df.fillna("")
    found = {field: column_for([str(c) for c in df.columns], names) for field, names in TABLE_COLUMNS.items()}
    if df.empty or found["text"] is None:
        return []
    df.columns = [str(c) for c in df.columns]
    out = []
    for i, row in enumerate(df.to_dict("records"), 1):
        field = lambda name, otherwise: str(row[found[name]]).strip() if found[name] else otherwise  # noqa: B023, E731
        if text := field("text", ""):
            head = f"Title: {field('title', '') or f'Row {i}'}\nDate: {field('date', '')}\nSource: {field('source', 'Table upload')}\nMediaCountry: {field('media_country', '')}"
            out.append((f"{name}__row_{i:06d}.txt", f"{head}\n\n{text}"))
    return out


def file_texts(name: str, raw: bytes) -> list[tuple[str, str]]:
    """name and text of what a file holds, by its ending; nothing for endings that are not known."""
    low = name.lower()
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            inner = [i for i in z.infolist() if not i.is_dir() and not i.filename.lower().endswith(".zip")]
            return [x for i in inner for x in file_texts(i.filename, z.read(i))]
    if low.endswith((".csv", ".json", ".xlsx", ".xls")):
        return table_rows(name, raw)
    if low.endswith((".txt", ".md", ".text")):
        text = decode_bytes(raw)
    elif low.endswith(".docx"):
        text = docx_text(raw)
    elif low.endswith(".pdf"):
        text = pdf_text(raw)
    else:
        return []
    return [(name, text)] if text.strip() else []


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """name and text of text, word-processor, PDF, table and zipped files, decoded where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(frames):
        for f in frames:
            rows = [x for name, raw in zip(f["path"], f["content"], strict=True) for x in file_texts(name, raw)]
            yield pd.DataFrame(rows, columns=["name", "text"])

    return files.mapInPandas(run, "name string, text string")


def distinct_uploads(items: DataFrame) -> DataFrame:
    """Uploads (name, text) without repeats of name, length and content."""
    return items.withColumns({"_l": F.length("text"), "_m": F.md5("text")}).dropDuplicates(["name", "_l", "_m"]).drop("_l", "_m")


def header(name: str) -> Column:
    """The value of a header line of a text, or the empty text."""
    return F.regexp_extract("text", rf"(?im)^\s*{name}:\s*(.+?)\s*$", 1)


def outlet_of(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(*[F.when(low.contains(part), outlet) for part, outlet in OUTLETS.items()], F.lit("Unknown"))


def media_country_of(outlet: Column) -> Column:
    return F.coalesce(*[F.when(outlet.isin(*outlets), country) for country, outlets in OUTLET_COUNTRIES.items()], F.lit("Unknown"))


def country_of(name: Column, text: Column) -> Column:
    """The country with most hints in the name and the first 4,000 characters of the text."""
    sample = F.lower(F.concat(name, F.lit("\n"), F.substring(text, 1, 4000)))
    counts = {c: sum((sample.contains(h).cast("int") for h in hints[1:]), sample.contains(hints[0]).cast("int")) for c, hints in COUNTRY_HINTS.items()}
    most = F.greatest(*counts.values())
    return F.coalesce(*[F.when(n == most, c) for c, n in counts.items()])


def parse_header(items: DataFrame) -> DataFrame:
    """title, outlet_name, media_country, date and year of uploads (name, text), and their text without the header lines.

    A Source or MediaCountry line goes before what the file's name tells.
    """
    first = F.get(F.filter(F.transform(F.split("text", r"\r\n|[\n\r]"), T.stripped), lambda x: x != ""), F.lit(0))
    titled = F.lower(first).startswith("title:")
    title = F.when(titled, F.coalesce(F.nullif(T.stripped(F.substring(first, F.lit(7), F.length(first))), F.lit("")), F.lit("Untitled"))).otherwise(F.coalesce(first, F.lit("Untitled")))
    outlet = F.coalesce(F.nullif(header("Source"), F.lit("")), outlet_of(F.col("name")))
    year = F.coalesce(T.year_in(F.col("name")), T.year_in(F.substring("text", 1, 500)), F.lit(2026))
    date = F.nullif(F.regexp_extract(F.substring("text", 1, 500), r"\b(20\d{2}-\d{2}-\d{2})\b", 1), F.lit(""))
    head = items.withColumns({"title": title, "outlet_name": outlet, "year": year}).withColumn("date", F.coalesce(date, F.col("year").cast("string")))
    head = head.withColumn("media_country", F.coalesce(F.nullif(header("MediaCountry"), F.lit("")), media_country_of(F.col("outlet_name"))))
    bare = T.stripped(F.regexp_replace("text", r"(?im)^\s*(Title|URL|Date):[^\n]*$", ""))
    return head.withColumn("text", T.strip_boilerplate(bare))


def build_docs(items: DataFrame, min_year: int, max_year: int) -> DataFrame:
    """Uploads (seq, name, text) as documents of the corpus analysis: those with a body and a year in range."""
    rows = parse_header(items.withColumn("country", country_of(F.col("name"), F.col("text"))))
    region = F.when(F.col("outlet_name").isin(*OUTLET_COUNTRIES["Malaysia"]), "malaysia").otherwise("indonesia")
    return rows.where((F.col("text") != "") & F.col("year").between(min_year, max_year)).select("seq", F.col("outlet_name").alias("source"), region.alias("region"), "year", "country", "title", "text")


def collected_texts(parts: list[DataFrame]) -> DataFrame:
    """Texts of several loaders together, without repeats of id and text."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropDuplicates(["calibration_id", "text"])


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays become text with semicolons, structures become JSON."""
    kinds = dict(df.dtypes)
    flat = df.select(*[F.array_join(c, "; ").alias(c) if kinds[c] == "array<string>" else F.to_json(c).alias(c) if kinds[c].startswith(("struct", "map", "array")) else F.col(c) for c in df.columns])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def save_outputs(tables: dict[str, DataFrame], folder: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """Every table as Parquet, partitioned where asked, and as CSV."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{folder}/{name}.parquet")
        write_csv(df, f"{folder}/{name}.csv")


def write_xlsx(tables: dict[str, DataFrame], path: str, most: int = 50_000) -> None:
    """A workbook of the first rows of each table; the row limit is what a sheet is for."""
    with pd.ExcelWriter(path) as book:
        for name, df in tables.items():
            df.limit(most).toPandas().to_excel(book, sheet_name=name[:31], index=False)
