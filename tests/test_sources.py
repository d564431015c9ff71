"""Readers of corpora and uploads."""

import io as bytes_io
import zipfile
import zlib

import pytest

from corpusloom.sources import io

HEADER = "source,region,url,date,year,title,query_country,query_term,primary_country,country_scores,countries_detected,primary_subcorpus,subcorpora_detected,theme_scores,file_path\n"


def test_corpus_of_files(spark, tmp_path):
    bodies = {"a/x.txt": "Title: one\nURL: u\n\nfirst line\nsecond line\n\nthird", "b/x.txt": "Title: two\r\n\r\nother body", "c/no head.txt": "only a body\nof two lines"}
    for name, text in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode() + (b"\xff" if name == "c/no head.txt" else b""))
    rows = [("S1", 2024, "b/x.txt"), ("S2", 2023, f"{tmp_path}/a/x.txt"), ("S3", 2024, "./c/no head.txt"), ("S4", 2024, "gone.txt"), ("S5", "none", "a/x.txt"), ("S6", 1999, "a/x.txt")]
    meta = tmp_path / "meta.csv"
    meta.write_text(HEADER + "".join(f'{s},r,u,d,{y},"t, {s}",q,t,china,,,,,,{p}\n' for s, y, p in rows))
    got = io.read_corpus(spark, str(meta), 2020, 2030).orderBy("seq").collect()
    assert [(r.source, r.year, r.title, r.text) for r in got] == [
        ("S1", 2024, "t, S1", "other body"),
        ("S2", 2023, "t, S2", "first line\nsecond line\n\nthird"),
        ("S3", 2024, "t, S3", "only a body\nof two lines"),
    ]


@pytest.mark.parametrize(
    ("name", "text", "outlet", "country", "title"),
    [
        ("the_star_1.txt", "A headline\nbody", "The Star", "Malaysia", "A headline"),
        ("kompas_2024.txt", "Title: Berita\nDate: 2024-03-01\nbody", "Kompas Indonesia", "Indonesia", "Berita"),
        ("kompas.txt", "Title:\nSource: The Edge Malaysia\nMediaCountry: Elsewhere\nbody", "The Edge Malaysia", "Elsewhere", "Untitled"),
        ("edge.txt", "", "The Edge Malaysia", "Malaysia", "Untitled"),
        ("x.txt", "no outlet", "Unknown", "Unknown", "no outlet"),
    ],
)
def test_headers(spark, name, text, outlet, country, title):
    r = io.parse_header(spark.createDataFrame([(name, text)], "name string, text string")).first()
    assert (r.outlet_name, r.media_country, r.title) == (outlet, country, title)
    assert "Title:" not in r.text


def test_dates_and_countries(spark):
    rows = [(1, "astro 2023.txt", "Moscow and the Kremlin say\nmore"), (2, "n.txt", "2024-05-06 Beijing"), (3, "n.txt", "nothing")]
    df = spark.createDataFrame(rows, "seq long, name string, text string")
    assert [(r.year, r.date) for r in io.parse_header(df).orderBy("seq").collect()] == [(2023, "2023"), (2024, "2024-05-06"), (2026, "2026")]
    got = {r.seq: (r.source, r.region, r.country) for r in io.build_docs(df, 2020, 2030).collect()}
    assert got == {1: ("Astro Awani", "malaysia", "russia"), 2: ("Unknown", "indonesia", "china"), 3: ("Unknown", "indonesia", "usa")}
    assert io.build_docs(df, 2024, 2024).count() == 1


def a_pdf(text: str) -> bytes:
    packed = zlib.compress(f"BT /F1 12 Tf (Hello \\(PDF\\)) Tj ({text}) Tj ET".encode())
    return b"%PDF-1.4\n1 0 obj\n<< /Length " + str(len(packed)).encode() + b" /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\nendobj\n"


def a_docx(text: str) -> bytes:
    out = bytes_io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:document>")
    return out.getvalue()


def test_files_by_ending(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("привет".encode("cp1251"))
    (tmp_path / "b.pdf").write_bytes(a_pdf(" there"))
    (tmp_path / "c.bin").write_bytes(b"not a text")
    (tmp_path / "d.csv").write_text("headline;content\nOne;First text\nTwo;\nThree;a, b, c\n")
    (tmp_path / "e.json").write_text('{"rows": [{"text": "In rows", "source": "Tempo"}]}')
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("in.docx", a_docx("A &amp; B"))
        z.writestr("in.pdf", a_pdf("!"))
        z.writestr("in.md", "# md")
        z.writestr("in.exe", "no")
    got = {r.name.rsplit("/", 1)[-1]: r.text for r in io.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == "привет"
    assert got["b.pdf"] == "Hello (PDF) there"
    assert "c.bin" not in got
    assert got["d.csv__row_000001.txt"].startswith("Title: One\nDate: \nSource: Table upload\n")
    assert got["d.csv__row_000001.txt"].endswith("\n\nFirst text")
    assert "d.csv__row_000002.txt" not in got
    assert "Source: Tempo" in got["e.json__row_000001.txt"]
    assert (got["in.docx"], got["in.pdf"], got["in.md"]) == ("A & B", "Hello (PDF)!", "# md")
    assert "in.exe" not in got


def test_an_analysis_in_files(spark, tmp_path):
    from corpusloom.operators import aggregate, scoring
    from corpusloom.plans import tables
    from corpusloom.plans.tables import PROFILE
    from corpusloom.sources import analysis

    scored = tables.scored(spark, "/root/testdata/sf0.001").cache()
    issues = spark.createDataFrame([("f.csv", "error", "missing_column", "c"), ("a.csv", "warning", "empty_verified", "row 1")], "file string, level string, issue string, details string")
    log = spark.createDataFrame([("t", "approve")], "timestamp string, user_action string")
    out = str(tmp_path)
    analysis.save({"contexts_full": scored, "aggregated_by_article": aggregate.by_article(scored)}, out, scoring.traces(scored, PROFILE), issues, log, most_formulas=5)
    formulas = spark.read.json(f"{out}/formula_traces.json")
    assert formulas.count() == 30 and formulas.select("context_id").distinct().count() == 5
    contexts = spark.read.parquet(f"{out}/contexts_full.parquet")
    assert contexts.count() == scored.count() and contexts.where("formula_trace_id <> ''").count() == 5
    assert contexts.where("formula_trace_id <> ''").join(formulas.where("formula_name = 'IP'"), contexts.formula_trace_id == formulas.trace_id).count() == 5
    assert spark.read.json(f"{out}/marker_traces.json").count() == spark.read.parquet(f"{out}/marker_traces.parquet").count() > 0
    assert [r.line for r in analysis.issue_lines(issues).orderBy("place", "line").collect()] == ["# lexicon_quality_report", "", "- total_issues: 2", "- [error] f.csv: missing_column (c)", "- [warning] a.csv: empty_verified (row 1)"]
    assert sorted(r.value for r in spark.read.text(f"{out}/lexicon_quality_report.md").collect()) == sorted(["# lexicon_quality_report", "", "- total_issues: 2", "- [error] f.csv: missing_column (c)", "- [warning] a.csv: empty_verified (row 1)"])
    assert [r.line for r in analysis.issue_lines(issues.limit(0)).orderBy("place").collect()] == ["# lexicon_quality_report", "", "- status: OK", "- notes: no schema violations detected."]
    assert spark.read.option("header", True).csv(f"{out}/dictionary_change_log.csv").count() == 1
    scored.unpersist()
