"""Dense numbers, the decision ledger, metadata, articles of sites and the report of a calibration corpus."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import app_tables, articles, calibration, calibration_report, dictionaries, interpret, ledger, numbering, percentile
from corpusloom.sources import calibration_sources


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_dense_numbers(spark, partitions):
    values = [(i * 7919 % 503, f"t{i}") for i in range(503)]
    df = spark.createDataFrame(values, "k long, text string").repartition(partitions)
    got = numbering.numbered(df, "n", ["k"]).collect()
    assert sorted((r.k, r.n) for r in got) == [(k, k + 1) for k in range(503)]
    assert numbering.numbered(df, "n", [F.desc("k")], 0).where("n = 0").first().k == 502
    ids = numbering.with_ids(df.withColumn("doc_id", F.lit("old")), ["k"])
    assert sorted(r.doc_id for r in ids.collect()) == [f"doc_{i:06d}" for i in range(1, 504)]
    stored = numbering.numbered(spark.range(100).repartition(partitions).where("id % 5 > 0").coalesce(max(1, partitions // 2)), "n")
    assert sorted(r.n for r in stored.collect()) == list(range(1, 81))
    assert numbering.numbered(df.limit(0), "n", ["k"]).collect() == []


CANDIDATES = "candidate_id string, candidate_term string, proposed_dictionary string, example_contexts string, status string"
DECISIONS = "timestamp string, candidate_term string, dictionary string, user_action string, reason string, note string"


def decisions_and_state(seed):
    rnd = random.Random(seed)
    terms = [f"term{i}" for i in range(30)]
    made = [(f"2025-01-{rnd.randint(1, 28):02d}T00:00:00+00:00", rnd.choice(terms), rnd.choice(["evi_lexicon", "ideological_markers"]), rnd.choice(["approve", "reject", "other"]), rnd.choice(["r", None]), f"n{i}") for i in range(200)]
    return terms, made


def test_a_log_gives_one_state_however_it_is_kept(spark, tmp_path):
    terms, made = decisions_and_state(5)
    candidates = spark.createDataFrame([(f"c{i}", t, "evi_lexicon", f"example {t}", "new") for i, t in enumerate(terms)] + [("c99", "term0", "evi_lexicon", "a later one", "new")], CANDIDATES)
    log = ledger.entries(candidates, spark.createDataFrame(made, DECISIONS))
    known = [m for m in made if m[2] == "evi_lexicon" and m[3] != "other"]
    assert log.count() == len(known)
    assert log.where("term = 'term0'").first().examples == "example term0"
    for part, rows in enumerate((log.repartition(7), log.where("reason = 'r'").coalesce(1), log.limit(20))):  # with entries written twice
        ledger.append(rows, f"{tmp_path}/log")
        assert part or ledger.read(spark, f"{tmp_path}/log").count() == len(known)
    states = []
    for kept in (log, log.repartition(1), log.orderBy(F.desc("timestamp")).repartition(13, "new_value"), ledger.read(spark, f"{tmp_path}/log")):
        states.append(sorted((r.candidate_id, r.status, r.note) for r in ledger.replayed(candidates, kept).collect()))
    ledger.rewrite(spark, f"{tmp_path}/log", f"{tmp_path}/short")
    short = ledger.read(spark, f"{tmp_path}/short")
    states.append(sorted((r.candidate_id, r.status, r.note) for r in ledger.replayed(candidates, short).collect()))
    assert all(s == states[0] for s in states) and short.count() == len({m[1] for m in known})
    for t in terms:
        own = [m for m in known if m[1] == t]
        status = next(s for i, s, _ in states[0] if i == f"c{terms.index(t)}")
        last = [m[3] for m in own if m[0] == max(x[0] for x in own)] if own else []
        assert status in [{"approve": "approved", "reject": "rejected"}[a] for a in last] if own else status == "new"
    done = ledger.decided(candidates, log)
    assert not {r.candidate_id for r in done["verified_terms"].collect()} & {r.candidate_id for r in done["rejected_terms"].collect()}


def test_metadata_of_the_first_row_and_columns_of_both(spark):
    rows = spark.createDataFrame([("d1", "own", 1.5), ("d2", "own", 2.5), ("d3", "own", 3.5), (None, "own", 4.5)], "doc_id string, title string, v double")
    meta = spark.createDataFrame([(2, "d1", "second", 2.0, "b"), (1, "d1", "first", 1.0, "a"), (3, "d2", None, None, None), (4, None, "none", 4.0, "n")], "seq long, doc_id string, title string, v double, kind string")
    of = lambda how: {r.doc_id: (r.title, r.v, r.kind) for r in calibration.merged_metadata(rows, meta, "doc_id", "seq", how).collect()}
    assert of("blank") == {"d1": ("", 0.0, "a"), "d2": ("", 0.0, None), "d3": ("", 0.0, None), None: ("", 0.0, "n")}
    assert of("left")["d1"] == ("own", 1.5, "a") and of("right")["d1"] == ("first", 1.0, "a") and of("right")["d3"] == (None, None, None)
    with pytest.raises(ValueError):
        of("both")


PAGE = """<html><head><title>t</title><meta property="og:title" content=" Meta title "><meta name="pubdate" content="2023-05-06"></head>
<body><div class="title big"><h1> Head <b>line</b> &amp; more</h1></div><div id="story" class="article-body x"><p>One<p>Two <i>nested</i></p> tail</p><script>var p = "<p>no</p>"</script>
<!-- no --><template>no</template><ul><li>a<li>b</ul>end</div><time datetime="2024-01-02T03:04">x</time><span class=date>yesterday</span></body></html>"""


def test_selectors_and_nesting():
    page = articles.Page(PAGE)
    assert page.first(["div.title h1"]) == "Head\nline\n& more"
    assert page.first([".none", "div#story.article-body"]) == "One\nTwo\nnested\ntail\na\nb\nend"
    assert [page.text(i) for i in page.select("p")] == ["One\nTwo\nnested\ntail", "Two\nnested"]
    assert [page.text(i) for i in page.select("div p p, body time")] == ["Two\nnested", "2024-01-02T03:04"]
    assert page.first(["meta[property='og:title']"]) == "Meta title" and page.first(["span.date", "time"]) == "yesterday"
    assert page.first(["h1.none", "p h1", "[nothing]"]) == "" and page.first(["ul > li"] if False else ["ul li li"]) == "b"
    assert articles.Page("</p>a<br>b<p>c").pieces == ["a", "b", "c"] and articles.Page("").pieces == []
    with pytest.raises(ValueError):
        articles.parsed("a:hover")


def test_articles_of_sites(spark):
    long = ["A paragraph of more than forty characters, number one.", "A paragraph of more than forty characters, number two.", "A paragraph of more than forty characters, number three."]
    fallback = "<meta property='og:title' content='T'><div>" + "".join(f"<p>{x}</p>" for x in [*long, long[0], "short", "Our privacy policy is something of more than forty characters."]) + "</div>"
    data = '<script id="__NEXT_DATA__">{"props": {"pageProps": {"data": {"title": "From data", "content": "<p>Body</p><p>two</p>", "created": 1700000000000}}}}</script>'
    broken = '<script id="__NEXT_DATA__">{"props": 3}</script>'
    known = articles.sites(spark, [
        ("Site", "Here", "example.com", ["div.title h1", "h1"], ["div.article-body", "article"], ["time"], None),
        ("Sub", "There", "news.example.com", ["h1"], ["article"], ["time"], "props.pageProps.data"),
    ])
    pages = spark.createDataFrame(
        [(1, "http://www.example.com/a", PAGE), (2, "https://news.example.com:80/2021/03/04/b", data), (3, "http://example.com/2022/01/02/", fallback), (4, "http://badexample.com/", PAGE), (5, "http://example.com/", None), (6, None, PAGE), (7, "http://x.news.example.com/", broken + PAGE), (8, "http://example.com/", "<h1>only a title</h1>")],
        "page_id long, url string, html string",
    )
    got = {r.page_id: r for r in articles.articles(pages, known).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1].title, got[1].date, got[1].year, got[1].source) == ("Head\nline\n& more", "2024-01-02T03:04", 2024, "Site")
    moment = datetime.datetime.fromtimestamp(1700000000, tz=datetime.UTC).isoformat()
    assert (got[2].title, got[2].content, got[2].date, got[2].year, got[2].source) == ("From data", "Body\ntwo", moment, 2023, "Sub")
    assert (got[3].title, got[3].content, got[3].date, got[3].year) == ("T", "\n".join(long), "no_date", 2022)
    assert got[3].text == "Source: Site\nRegion: Here\nTitle: T\nURL: http://example.com/2022/01/02/\nDate: no_date\nYear: 2022\n\n" + "\n".join(long) + "\n"


def test_links_of_search_answers(spark):
    bodies = spark.createDataFrame(
        [
            (1, '{"items": [{"link": " https://a.site.com/1 "}, {"other": 1}, {"link": "https://x.org/2"}, {"link": "https://a.site.com/3"}, {"link": "https://a.site.com/1"}]}', "queryly", "site.com"),
            (2, '{"hits": [{"canonical_url": "/b"}, {"canonical_url": "https://www.site.com/a"}, {"canonical_url": null}, {"canonical_url": ""}]}', "algolia", "site.com"),
            (3, "<a class=x href='/news/2'>b</a><a href=\"https://site.com/news/1\">a</a><a href='/news/2'>b</a><a href='/other'>c</a><a href='mailto:x'>m</a>", "page", "site.com"),
            (4, "no json", "queryly", "site.com"),
            (5, '{"items": 3}', "queryly", "site.com"),
            (6, None, "algolia", "site.com"),
        ],
        "answer_id long, body string, mode string, domain string",
    )
    known = spark.createDataFrame([("site.com", "https://www.site.com/", ["/news/"], r"\d$")], "domain string, base string, must array<string>, pattern string")
    got = {r.answer_id: r.links for r in articles.search_links(bodies, known).collect()}
    assert got == {1: ["https://a.site.com/1", "https://a.site.com/3"], 2: ["https://www.site.com/b", "https://www.site.com/a"], 3: ["https://www.site.com/news/2", "https://site.com/news/1"], 4: [], 5: [], 6: []}


def test_report(spark):
    texts = spark.createDataFrame([(3, "c3", "neutral_news", "en", "none"), (1, "c1", "crisis_report", "en", "upper_anchor"), (2, "c2", "neutral_news", "ms", "extreme_anchor"), (4, "c4", None, "en", None)], "seq long, calibration_id string, calibration_type string, language string, anchor_status string")
    contexts = spark.createDataFrame([(i, "China" if i % 3 else "USA", "neutral_news" if i % 2 else "crisis_report", i / 10, i / 100, 0.0, float(i)) for i in range(6)], "seq long, ref_country string, calibration_type string, IDI_raw double, EMI_raw double, MTI_raw double, IP_abs_context double")
    dists = percentile.distributions(contexts, list(calibration_report.METRICS), {calibration_report.WHOLE: [], calibration_report.BY_TYPE: ["calibration_type"]})
    candidates = spark.range(7)
    flags = spark.createDataFrame([(1, "too_short"), (2, "outlier"), (3, "outlier")], "seq long, issue_type string")
    want = """# Calibration Report

## 1. Corpus size and category distribution
- Total texts: **4**
- Total referent contexts: **6**

## 2. Text counts by calibration_type
- neutral_news: 2
- crisis_report: 1
- nan: 1

## 3. Language distribution
- en: 3
- ms: 1

## 4. Ref_country distribution
- China: 4
- USA: 2

## 5. Indicator distributions
- median IDI_raw: `0.250000`
- median EMI_raw: `0.025000`
- median MTI_raw: `0.000000`
- median IP_abs_context: `2.500000`

## 6. Percentile thresholds
- IDI_raw: p75=0.375000, p90=0.450000, p95=0.475000
- EMI_raw: p75=0.037500, p90=0.045000, p95=0.047500
- MTI_raw: p75=0.000000, p90=0.000000, p95=0.000000
- IP_abs_context: p75=3.750000, p90=4.500000, p95=4.750000

## 7. Anchor texts
- c1 | crisis_report | upper_anchor
- c2 | neutral_news | extreme_anchor

## 8. Dictionary expansion summary
- candidate terms extracted: **7**

## 9. Quality flags
- total flags: **3**
- outlier: 2
- too_short: 1

## 10. Recommended next steps
- Reach 100+ texts in core categories for dissertation-grade stability.
- Approve/reject candidate terms and reload lexicons.
- Recompute baseline and compare indicator deltas.

Current neutral_news subset has median EMI_raw = 0.0300.

Current crisis_report subset has median EMI_raw = 0.0200."""
    assert calibration_report.report(texts, contexts, dists, candidates, flags) == want
    empty = calibration_report.report(texts.limit(0), contexts.limit(0), dists.limit(0), candidates.limit(0), flags.limit(0))
    assert "- Total texts: **0**" in empty and "- no anchors yet" in empty and "median" not in empty


def test_distributions_do_not_depend_on_the_order_of_rows(spark):
    rnd = random.Random(9)
    df = spark.createDataFrame([(f"g{i % 3}", round(rnd.random(), 6), rnd.gauss(0, 1) * 10) for i in range(2000)], "g string, a double, b double")
    got = [sorted(map(tuple, percentile.distributions(df.repartition(n), ["a", "b"], {"all": [], "g": ["g"]}).collect())) for n in (1, 4, 16)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 8
    half = percentile.distributions(spark.createDataFrame([(0.152269,), (0.15227,), (-0.5,), (-0.500001,)], "a double"), ["a"], {"all": []})
    assert half.first()["mean"] == -0.173865  # exactly half: -0.1738655 goes up


def test_baseline_of_any_number_of_referents(spark):
    base = spark.range(3000).select(F.col("id").cast("string").alias("ref_country"), F.lit("x").alias("calibration_type"))
    scored = spark.range(1500).select(F.col("id").cast("string").alias("ref_country"))
    assert interpret.baseline_filter(base, scored, "same_ref_country_only").count() == 1500


def test_blocks_of_terms(spark):
    text = "First one. The Threat here! Nothing? A threat, a support. Last"
    rows = [(1, text), (2, None), (3, "  "), (4, "threat. " * 40), (5, "no such word: threats")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.b for r in df.select("id", interpret.context_blocks(F.col("text"), ["threat", "support", " ", "threat"]).alias("b")).collect()}
    assert [tuple(b) for b in got[1]] == [("The Threat here!", "First one. The Threat here! Nothing?", "threat"), ("A threat, a support.", "Nothing? A threat, a support. Last", "support, threat")]
    assert got[2] == [] and got[3] == [] and got[5] == [] and len(got[4]) == interpret.MOST_BLOCKS
    assert df.select(interpret.context_blocks(F.col("text"), []).alias("b")).first().b == []


def test_lists_of_several_places(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    given = {
        "ideological_markers": table([(2, "b "), (1, "A"), (3, "")], "place int, term string"),
        "emotional_markers": table([(1, "fear", "Low"), (2, "rage", "high"), (3, "hm", "none")], "place int, marker string, intensity_level string"),
        "evi_lexicon": table([(1, "good", "+", "lex"), (2, "helps", "pos", "Actor_Action"), (3, "ruin", "negative", "consequence"), (4, "x", "", "")], "place int, term string, polarity_hint string, category string"),
        "actor_actions": table([(1, "attacks", "neg")], "place int, verb_or_phrase string, polarity string"),
        "metaphor_markers": table([(1, "wave")], "place int, nothing string"),
    }
    rows = dictionaries.overrides(given).collect()
    assert sorted((r.list, r.term) for r in rows) == [("emotional_strong", "rage"), ("emotional_weak", "fear"), ("ideological", "A"), ("ideological", "b"), ("rubric_neg_action", "attacks"), ("rubric_neg_consequence", "ruin"), ("rubric_pos_action", "helps"), ("rubric_pos_lex", "good")]
    schema = "list string, term string, place long"
    base = table([("l", "Zeta", 1), ("l", "alpha", 2), ("m", "ALPHA", 1)], schema)
    more = table([("l", "zeta", 1), ("l", "Beta", 3), ("l", "beta", 2), ("l", " Alpha ", 4)], schema)
    last = table([("l", "BETA", 1), ("l", "gamma", 2), ("l", " ", 3), ("l", None, 4)], schema)
    got = sorted((r.list, r.n, r.term) for r in dictionaries.united([base, more, last]).collect())
    assert got == [("l", 1, "Zeta"), ("l", 2, "alpha"), ("l", 3, "beta"), ("l", 4, "gamma"), ("m", 1, "ALPHA")]


LISTING = """# a comment
sources:
  - source_name: "First Set"
    mode: "local"
    language: ms   # of the texts
    path: "texts/"
    enabled: true
    notes: 'n'
  - source_name: Off
    mode: local
    path: texts
    enabled: false
  - source_name: "List"
    mode: url_list
    url_csv_path: urls.csv
  - source_name: "First Set"
    mode: local
    language: en
    path: texts
  - source_name: Nowhere
    mode: local
  - mode: rss
    rss_url: http://example.com/feed
"""


def test_sources(spark, tmp_path):
    (tmp_path / "texts" / "sub").mkdir(parents=True)
    (tmp_path / "texts" / "b.txt").write_text(" Text of b \n")
    (tmp_path / "texts" / "a.md").write_text("Text of a, with words")
    (tmp_path / "texts" / "blank.txt").write_text("  ")
    (tmp_path / "texts" / "sub" / "c.csv").write_text("text,title\nrow one,\nrow two,t2\n")
    (tmp_path / "urls.csv").write_text("url,source_name,calibration_type,expected_indicator_focus,language,ref_country,notes\nhttp://x/1,S,neutral_news,IDI,en,China,\n,S,,,,,\nhttp://x/2,S,neutral_news,IDI,en,,own\nhttp://x/3,S,neutral_news,IDI,en,,\n")
    sources = calibration_sources.read_sources(LISTING)
    assert [(s.source_name, s.mode, s.enabled, s.language, s.notes) for s in sources[:3]] == [("First Set", "local", True, "ms", "n"), ("Off", "local", False, "en", ""), ("List", "url_list", True, "en", "")]
    fetched = spark.createDataFrame([("http://x/1", "<html><p>Page  one</p><script>no</script></html>"), ("http://x/2", "please Subscribe")], "url string, body string")
    manual = spark.createDataFrame([(2, "typed", "crisis_report", None), (1, " ", "x", None), (3, "typed too", None, "own_id")], "place int, text string, calibration_type string, calibration_id string")
    got = {r.calibration_id: r for r in calibration_sources.collected(spark, sources, str(tmp_path), manual, fetched).collect()}
    assert len(got) == 4 + 3 + 2 and all(tuple(r.asDict()) == calibration_sources.COLUMNS for r in got.values())
    first = {i: r for i, r in got.items() if i.startswith("cal_local_first_set_")}
    assert sorted((i[-13:], r.text.split("\n")[-1]) for i, r in first.items()) == [("000001_000001", "Text of a, with words"), ("000002_000002", "Text of b"), ("000003_000003", "row one"), ("000003_000004", "row two")]
    assert got["cal_url_000001"].text == "Page one" and got["cal_url_000001"].text_length_words == 2 and got["cal_url_000001"].ref_country == "China"
    assert (got["cal_url_000003"].fetch_status, got["cal_url_000003"].notes) == ("fetch_failed", "own") and got["cal_url_000004"].notes == "not_fetched"
    assert got["cal_manual_000002"].calibration_type == "crisis_report" and got["own_id"].calibration_type == "standard_political_news"
    assert calibration_sources.collected(spark, [], str(tmp_path)).columns == list(calibration_sources.COLUMNS)
    (tmp_path / "urls.csv").write_text("url\nx\n")
    with pytest.raises(ValueError):
        calibration_sources.collected(spark, sources[2:3], str(tmp_path))


def test_tables_for_readers(spark):
    columns = "doc_id string, media_country string, ref_country string, IDI double, EMI double, MTI double, EVI_raw int, EVI_norm double, referent_salience double, positive_score int, negative_score int, IP_context double, IP_context_abs double, discursive_energy double, aggregation_weight double, is_technical_mention boolean"
    rows = [
        ("a", "M", "X", 0.1, 0.2, 0.0, 2, 0.2, 1.0, 2, 0, 0.26, 0.26, 0.3, 1.0, False),
        ("a", "M", "X", 0.3, None, 0.0, -2, -0.2, 0.5, 0, 2, -0.26, 0.26, 0.3, 0.5, None),
        ("b", "M", "X", 0.9, 0.9, 0.9, 9, 0.9, 0.0, 9, 0, 3.33, 3.33, 2.7, 1.0, True),
        ("c", "M", None, 0.0, 0.0, 0.0, 0, 0.0, 0.25, 0, 0, 0.0, 0.0, 0.0, 0.0, False),
    ]
    read = app_tables.reader_columns(spark.createDataFrame(rows, columns), "v1")
    first = read.where("IDI = 0.1").first()
    assert (first.IDI_raw, first.IDI_percent_value, first.IDI_percentile, first.IP_percentile, first.S_r, first.lexicon_version_used) == (0.1, 10.0, 50.0, 75.0, 1.0, "v1")
    assert first.percentile_explanation == "IDI pctl=50.0, EMI pctl=75.0, MTI pctl=50.0, IP_abs pctl=62.5" and first.interpretation_summary == "EVI=2.0, IP_i=0.260000, S_r=1.00"
    assert read.where("IDI = 0.3").first().EMI_raw == 0.0
    got = {r.ref_country: r for r in app_tables.matrix(read).collect()}
    x, none = got["X"], got[None]
    assert (x.number_of_contexts, x.number_of_articles, x.contexts_analyzed, x.contexts_excluded, x.technical_mentions_excluded) == (3, 2, 2, 1, 1)
    assert x.mean_IDI_raw == pytest.approx(0.2) and x.mean_EMI_percent_value == pytest.approx(10.0) and x.IP_final == pytest.approx((0.26 - 0.13) / 1.5) and x.IP_abs_final == pytest.approx(0.26) and x.mean_abs_IP == x.IP_abs_final
    assert (x.positive_context_share, x.central_context_share, x.warning) == (0.5, 0.5, "")
    assert x.interpretation_summary == "IDI pctl=62.5; EMI pctl=56.3; MTI pctl=50.0; IP_abs pctl=62.5" or x.interpretation_summary.startswith("IDI pctl=62.5; EMI pctl=56.")
    assert (none.contexts_analyzed, none.mean_IDI_raw, none.IP_final, none.warning) == (0, 0.0, 0.0, app_tables.NOTHING_LEFT)
    assert app_tables.matrix(read, exclude_technical=False).where("ref_country = 'X'").first().contexts_analyzed == 3


def test_texts_keep_their_own_where_nothing_is_said(spark):
    texts = spark.createDataFrame([("1", "own", "none", "old", "t"), ("2", "own", None, "old", "t"), ("3", "", "none", None, "t")], "calibration_id string, ref_country string, anchor_status string, quality_flags string, _flags string")
    texts = texts.withColumnRenamed("_flags", "title")
    rollup = spark.createDataFrame([("1", "China;USA", ""), ("2", "", "upper_anchor")], "doc_id string, ref_country string, anchor_status string")
    flags = spark.createDataFrame([("1", "too_short"), ("1", "outlier"), ("1", "outlier"), ("GLOBAL", "x")], "calibration_id string, issue_type string")
    got = calibration.summarised(texts, rollup, flags)
    assert got.columns == texts.columns
    assert {r.calibration_id: tuple(r)[1:4] for r in got.collect()} == {"1": ("China;USA", "none", "outlier;too_short"), "2": ("own", "upper_anchor", "old"), "3": ("", "none", None)}


def test_similar_sets_meet_by_hashes_of_few_words(spark):
    """All words travelled twice before, which took 19 times the input of disk."""
    rnd = random.Random(5)
    base = [[f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(1, 80))] for _ in range(12)]
    rows = [(0, None), (1, " \n "), (2, "A  b"), (3, "b\ta a")]
    for i in range(4, 90):
        words = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = f"w{rnd.randint(0, 300)}"
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
    sets = {i: set((t or "").lower().split()) for i, t in rows}
    near = {j for j in sets for i in sets if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.92 * len(sets[i] | sets[j])}
    texts = spark.createDataFrame(rows, "seq int, text string")
    found = [r.seq for r in calibration.similar_sets(texts).collect()]
    assert sorted(found) == sorted(near) and {3} < near
    wide = spark.createDataFrame([(1, "\n".join(f"x{i:03}" for i in range(200)))], "seq int, t string")
    told = calibration.prefixes(wide, {}, 0.92).first()
    assert told.n == 200 and len(told.prefix) == 17


def test_texts_travel_only_where_parities_leave_a_pair(spark, monkeypatch):
    """Sets of words travelled for every pair that shares a rare word, within a family for all its pairs, which took five times the input of disk."""
    rnd = random.Random(6)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join([*base, f"own{i}"])) for i in range(60)]
    rows += [(100 + i, " ".join(["zz-rare", *(f"w{rnd.randrange(4000)}" for _ in range(150))])) for i in range(40)]
    compared, counts = calibration.of_similar_words, []
    monkeypatch.setattr(calibration, "of_similar_words", lambda p, *a: (counts.append(p.count()), compared(p, *a))[1])
    found = calibration.similar_sets(spark.createDataFrame(rows, "seq int, text string"))
    assert sorted(r.seq for r in found.collect()) == list(range(1, 60))
    assert sum(counts) < 2 * len(rows)


def test_report_facts_count_near_duplicates_by_both_rules(spark, tmp_path):
    """Flags of the report were told by sets of words alone; the other facts are those of the SQL."""
    from difflib import SequenceMatcher

    from compare import connection, rows_of
    from corpusloom.plans import calibration_queries, oracles

    small = "/root/testdata/sf0.001"
    words = [f"word{i}" for i in range(24)]
    typos = [(9_000_001, " ".join(words)), (9_000_002, " ".join(w if i % 12 else w.replace("o", "0") for i, w in enumerate(words)))]
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 3000").limit(60)
    docs.unionByName(spark.createDataFrame(typos, "doc_id long, text string"), allowMissingColumns=True).coalesce(1).write.parquet(f"{tmp_path}/t/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").coalesce(1).write.parquet(f"{tmp_path}/t/labels.parquet")
    facts = calibration_queries.report_facts(spark, f"{tmp_path}/t")
    names, found = rows_of(facts.columns, [tuple(r) for r in facts.collect()])
    con = connection("/nothing")
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/t/{table}.parquet/*.parquet'")
    sql = oracles.all_sql()
    got = con.execute(calibration_queries.part_of_facts_sql(oracles.scored(), sql["candidate_terms"], sql["text_rollup"], sql["quality_flags"], oracles.half_up))
    theirs = rows_of([d[0] for d in got.description], got.fetchall())
    assert theirs[0] == names
    of = lambda r: dict(zip(names, r, strict=True))
    told = lambda rows: {of(r)["name"]: of(r)["n"] for r in rows if of(r)["section"] == 9 and of(r)["name"] in ("", "near_duplicate")}
    others = lambda rows: [r for r in rows if of(r)["section"] != 9 or of(r)["name"] not in ("", "near_duplicate")]
    assert others(found) == others(theirs[1])
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{tmp_path}/t/documents.parquet").collect())
    near, by_sets = set(), set()
    for j, (_, y) in enumerate(rows):
        m = SequenceMatcher(None, "", y)
        for _, x in rows[:j]:
            s, t = {*x.lower().split()}, {*y.lower().split()}
            m.set_seq1(x)
            if s and t and len(s & t) >= 0.92 * len(s | t):
                by_sets.add(j)
            elif s and t and m.real_quick_ratio() >= 0.98 and m.quick_ratio() >= 0.98 and m.ratio() >= 0.98:
                near.add(j)
    more = len(near - by_sets)
    assert more > 0 and told(found) == {"": told(theirs[1])[""] + more, "near_duplicate": len(near | by_sets)}
