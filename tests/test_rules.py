"""Rules of operators on hand-worked cases: what each input must give, written down apart from the code and its SQL."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import layout, urls
from tallyforge.functions.html import visible_text
from tallyforge.functions.text import tag_terms
from tallyforge.operators import cache, candidates, dossier, evidence, matching, profile, search, tables, vectors


def values(spark, column, rows, schema):
    """The column over rows, in their order."""
    names = [f"_{i}" for i in range(len(schema.split(",")))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    assert names
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_site_activity_has_its_own_terms(spark):
    # "round", "led" and "backed" are scoring terms, not terms of site activity; "careers", "news" and "launch" are
    texts = [("round led backed", 10), ("careers", 10), ("careers", None), ("news launch careers", None), ("fund news careers", None), ("news", 366)]
    got = values(spark, profile.recently_active(F.col("t"), F.col("age")), texts, "t string, age int")
    assert got == [False, True, False, True, False, False]


def test_pdf_counts_at_the_end_only(spark):
    rows = [("https://a.com/x.pdf",), ("https://a.com/x.pdf?page=2",)]
    got = values(spark, urls.candidate_score(F.col("u"), F.lit(""), F.lit(""), F.lit("acme"), F.lit("")), rows, "u string")
    assert got == [8 + 2 - 80, 8 + 2]


def test_item_types(spark):
    rows = [("TableItem",), ("chart",), ("section",), ("SectionHeaderItem",), ("page_header",), ("title",), ("ListItem list_item",), ("paragraph",), ("heading",), (None,), ("picture table",)]
    assert values(spark, layout.item_type(F.col("t")), rows, "t string") == ["table", "picture", "section_header", "section_header", "section_header", "section_header", "list_item", "text", "text", "text", "table"]


def test_signals_from_metadata(spark):
    none = F.lit(None).cast("string")
    meta = dict.fromkeys(("last_company", "last_date", "last_type", "last_size", "total", "five_years", "two_years", "active", "fundraising", "url"), none)
    rows = [("Acme", "2024-01-02", "Seed", "5", 0), (None, None, None, None, 3), ("nan", "null", "x", "y", 0)]
    own = meta | {"last_company": F.col("a"), "last_date": F.col("b"), "last_type": F.col("c"), "last_size": F.col("d"), "total": F.when(F.col("n") == 3, "12")}
    got = values(spark, tables.metadata_signals(own, F.col("n"), "2024-05-05"), rows, "a string, b string, c string, d string, n int")
    assert [(s.source_type, s.text, s.date, s.confidence, s.visibility) for s in got[0]] == [("pitchbook_activity", "Most recent PitchBook investment | company: Acme | date: 2024-01-02 | type: Seed | size: 5", "2024-01-02", 0.85, "public")]
    assert [(s.source_type, s.text, s.date) for s in got[1]] == [("pitchbook_activity_count", "PitchBook activity counts | total investments: 12 | investments past 12 months: 3", "2024-05-05")]
    assert got[2] == []


def test_positions_have_no_gaps(spark):
    left = spark.createDataFrame([(i,) for i in (5, 90, 7, 1000, 12)], "a long")
    right = spark.createDataFrame([(i,) for i in (3, 400, 31)], "b long")
    got = {r.a: r.b for r in profile.positional_join(left, right, "a", "b").collect()}
    assert got == {5: 3, 7: 31, 12: 400, 90: None, 1000: None}


EVIDENCE = "name string, website string, site_text string, site_urls array<string>, found_news string, found_official_urls array<string>, found_news_urls array<string>, recent_deal_text string, site_errors array<string>, site_warnings array<string>, query_errors array<string>, query_warnings array<string>, scrape_errors array<string>, scrape_warnings array<string>, notes array<string>"


def test_reliability(spark):
    def row(**given):
        return tuple(given.get(n.split()[0]) for n in EVIDENCE.split(", "))

    rows = [
        row(website="a.com", site_urls=["u"]), row(), row(website="a.com", site_errors=["e"]), row(website="a.com", site_errors=["e"], recent_deal_text="x", query_errors=["q"], scrape_errors=["s"]),
        row(site_text="x" * 120, notes=["scoring failed: x"]), row(website="a.com", query_warnings=["w"], scrape_warnings=["w"], site_warnings=["w"], found_news="n" * 119, notes=["merge failed", "fit breakdown does not sum to Fit Score"]),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + EVIDENCE)
    for n in ("new_fund_text", "hiring_text", "public_signal_text", "outreach_text"):
        df = df.withColumn(n, F.lit(None).cast("string"))
    got = {r.i: (r.status, r.failure_reason, r.failure_reasons, r.warning_reasons) for r in evidence.reliability(df).collect()}
    assert got[0] == ("success", "", [], [])
    assert got[1] == ("partial_failure", "no_web_evidence", ["no_web_evidence"], ["website_missing_input"])
    assert got[2] == ("partial_failure", "no_web_evidence", ["no_web_evidence", "website_unreachable"], [])
    assert got[3] == ("success", "", [], ["ddgs_query_degraded_but_partial_results_available", "search_scrape_partially_failed", "website_unreachable_but_search_available"])
    assert got[4] == ("partial_failure", "scoring_failed", ["scoring_failed"], ["website_missing_input"])
    assert got[5][2] == ["merge_failed", "no_web_evidence", "validation_failed"] and got[5][3] == ["ddgs_optional_scrape_blocked", "ddgs_query_fallback_used", "website_fetch_degraded", "website_present_but_weak_evidence"]


def test_merged_texts(spark):
    sheet = sorted({n for names in evidence.SHEET.values() for n in names})
    df = spark.range(1).select(*[F.lit({"description": "Retail Fund", "latest_note": "Note", "hq_city": "Dallas"}.get(n, "")).alias(n) for n in sheet])
    df = df.withColumns({"site_text": F.lit("Our Portfolio"), "found_official": F.lit(None).cast("string"), "found_news": F.lit("Raised"), "site_urls": F.array(F.lit("u")), "found_official_urls": F.array(F.lit("u"), F.lit("v")), "found_news_urls": F.lit(None).cast("array<string>")})
    df = df.withColumns({"recent_deal_text": F.lit("payments"), "new_fund_text": F.lit(""), "hiring_text": F.lit("Hiring now"), "public_signal_text": F.lit(None).cast("string"), "site_by": F.create_map(F.lit("careers"), F.lit("Jobs")), "found_by": F.create_map(F.lit("careers"), F.lit("More"))})
    r = evidence.merged_evidence(df).first()
    # snippets come in for the sector, of which nothing else speaks
    assert r.merged_sector == "retail fund       our portfolio raised payments  hiring now".replace("retail fund       ", "retail fund ")
    assert r.merged_hiring == "our portfolio raised hiring now jobs more" and r.merged_public == "note our portfolio raised payments  hiring now "
    assert r.merge_debug.official_urls == ["u", "v"] and r.merge_debug.lengths.official == 13 and not r.merge_debug.present.sheet is None


def test_boxes(spark):
    rows = [(0.1, 0.2, 0.3, 0.4, "BOTTOMLEFT"), (10.0, 20.0, 30.0, 40.0, "BOTTOMRIGHT"), (-2.0, 0.5, 1.0, 1.0, None), (5.0, 5.0, 5.0, 9.0, None)]
    got = values(spark, layout.page_box(F.col("l"), F.col("t"), F.col("r"), F.col("b"), F.col("o"), F.lit(100.0), F.lit(200.0)), rows, "l double, t double, r double, b double, o string")
    assert [None if g is None else tuple(round(x, 6) for x in g) for g in got] == [(10.0, 120.0, 30.0, 160.0), (10.0, 20.0, 30.0, 40.0), (0.0, 0.5, 1.0, 1.0), None]


def test_tables_in_pipes(spark):
    rows = [(["b", "gone"], [{"a": "x", "b": "10"}, {"a": "longer", "b": "7"}]), (None, [{"k": "v"}, {"m": "w"}]), ([], [])]
    got = values(spark, layout.table_markdown(F.col("c"), F.col("r")), rows, "c array<string>, r array<map<string,string>>")
    assert got[0] == "|   b | a      |\n|----:|:-------|\n|  10 | x      |\n|   7 | longer |"
    assert got[1] == "| k   | m   |\n|:----|:----|\n| v   | nan |\n| nan | w   |" and got[2] == "(No cleaned table rows available.)"


def test_visible_text():
    page = "<html><head><title>T</title><meta name='description' content=' About Us '></head><body><nav>Menu</nav><header>Top</header>{}<footer>End</footer></body></html>"
    assert visible_text(page.format("<p>Hello <b>World</b></p><script>x()</script>")) == "about us t hello world"
    assert visible_text(page.format("<div id='content'><form>f</form><p>Main<aside>s</aside> part</p></div><main>second</main>")) == "about us main part"
    assert visible_text(page.format("<article>One<nav>n</nav></article><article>Two</article>")) == "about us one" and visible_text(None) == ""


PROFILE = matching.Profile(industry="AI Health", stage="series_a", geography=("Texas",), raise_amount=5_000_000.0)
MATCH = {
    "semantic_fit": 0.6, "stage_fit": 1.0, "check_fit": 1.0, "portfolio_adjacency": 0.6, "recent_activity": 0.8, "geography_fit": 1.0, "data_quality_confidence": 0.8, "check_min": 250_000, "check_max": 2_000_000, "count_12m": 0, "email": "a@b", "linkedin_url": None,
    "investment_thesis": "Short. We back health companies that use data well. More", "industry_focus": ["Health"], "stage_focus": ["seed", "series_a"], "geography": ["Ohio", "Texas, US"], "companies": ["Health Co", "Other"], "warm": ["A path"],
}


def test_explanations(spark):
    kinds = "semantic_fit double, stage_fit double, check_fit double, portfolio_adjacency double, recent_activity double, geography_fit double, data_quality_confidence double, check_min long, check_max long, count_12m long, email string, linkedin_url string, investment_thesis string, industry_focus array<string>, stage_focus array<string>, geography array<string>, companies array<string>, warm array<string>"
    signals = "signals array<struct<source_type:string,text:string,source_url:string,date:string,confidence:double>>"
    deal = [("google_news", "x", "", "", 0.5), ("pitchbook_activity", "Most | company: Acme | y", "u", "2024-03-04", 0.8)]

    def told(**given):
        return tuple((MATCH | given).values())

    rows = [
        (*told(), deal), (*told(investment_thesis="Nothing about that industry here at all", count_12m=3, semantic_fit=0.5), deal), (*told(semantic_fit=0.3, companies=["x"], warm=[], recent_activity=0.1), deal), (*told(semantic_fit=0.1, stage_fit=0.7, check_fit=0.8, portfolio_adjacency=0.2, recent_activity=0.1, geography_fit=0.5, warm=[], email="", data_quality_confidence=0.5, investment_thesis="saas"), []),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kinds}, {signals}")
    got = {r.i: r.e for r in df.select("i", matching.explanation(PROFILE).alias("e")).collect()}
    check = "Cheque range $250K–$2.0M fits a $$5.0M raise"
    assert got[0].reasons == ['Thesis: "We back health companies that use data well"', "Invests at series a stage (seed, series a)", check, "Portfolio includes adjacent bets: Health Co", "Recent investment: Acme (2024-03)"]
    assert got[1].reasons[0] == "Fund sector focus: Health" and got[1].reasons[4] == "Actively deploying: 3 deals in last 12 months"
    assert got[2].reasons == ["Sector overlap: Health", "Invests at series a stage (seed, series a)", check, "Portfolio of 1 companies shows sector exposure", "Geographic focus includes Texas, US"]
    assert got[3].reasons == ["Passed eligibility filters; borderline fit — review manually"] and len(got[3].warnings) == 3 and got[3].match_segment == "ai_apps"
    assert got[0].warnings == ["No LinkedIn URL — verify identity before contacting"] and got[0].match_segment == "warm_network" and [p.source_type for p in got[0].source_provenance] == ["google_news", "pitchbook_activity"]


def test_activity_falls_back_on_signals(spark):
    kind = "array<struct<source_type:string,date:string>>"
    rows = [("2024-01-02", [("pitchbook_activity", "2024-05-05")]), (None, [("pitchbook_activity", "03-Jun-2024"), ("pitchbook_activity", "2024-02-01"), ("news", "2025-01-01")]), ("junk", []), ("", [("pitchbook_activity", "")])]
    assert [str(d) for d in values(spark, matching.last_activity(F.col("d"), F.col("s")), rows, f"d string, s {kind}")] == ["2024-01-02", "2024-06-03", "None", "None"]


def test_raw_rows_become_candidates(spark):
    raw = spark.createDataFrame([(1, "Ann", "Sequoia Securities", None, "a@b", "in/a", "ML and Banking at series a", "", ["X", "Y"], "$250K - $2M"), (2, None, None, "GP", "", None, None, None, None, "open")], "idx int, full_name string, firm string, title string, email string, linkedin_url string, investment_thesis string, why_good_fit string, portfolio_companies array<string>, check_size_range string")
    raw = raw.withColumns({n: F.lit(None).cast("string") for n in ("phone", "twitter_handle", "website")})
    a, b = candidates.from_raw(raw, "tag").orderBy("investor_id").collect()
    assert (a.investor_id, a.title, a.fund.industry_focus, a.fund.stage_focus, a.fund.check_size_min, a.fund.check_size_max, a.fund.recent_investment_count_12m, a.data_quality_confidence, len(a.warm_intro_paths)) == ("seed_1", "Partner", ["Artificial Intelligence", "Fintech"], ["series_a"], 250_000, 2_000_000, 7, 0.9, 2)
    assert [s.text for s in a.signals] == ["", "X; Y"] and a.source_tags == ["tag"]
    assert (b.full_name, b.firm, b.fund.name, b.fund.industry_focus, b.fund.stage_focus, b.fund.check_size_max, b.data_quality_confidence) == ("Investor 2", "Unknown Firm", "Unknown Fund", ["Technology"], ["seed", "series_a"], 3_000_000, 0.7)


def test_people_become_candidates(spark):
    rows = [("https://www.north-star capital.com",), ("",), (None,), ("ACME",)]
    assert values(spark, candidates.firm_name(F.col("t")), rows, "t string") == ["North Star Capital", "Unknown VC", "Unknown VC", "Acme"]
    low, high = candidates.check_by_title(F.col("t"))
    assert values(spark, F.struct(low, high), [("Principal",), ("Managing Partner",), (None,)], "t string") == [(250_000, 3_000_000), (500_000, 10_000_000), (250_000, 5_000_000)]


def test_cache_file_of_both_formats(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"model": "m", "embeddings": {"a": {"fund_thesis": {"v": [1.0, 2.0], "h": "x"}, "activity": [3.0]}, "b": {"portfolio": {"v": [4.0], "h": ""}}}}))
    got = {(r.investor_id, r.namespace): (r.vector, r.text_hash) for r in cache.read(spark, f"{tmp_path}/c.json", "m").collect()}
    assert got == {("a", "fund_thesis"): ([1.0, 2.0], "x"), ("a", "activity"): ([3.0], ""), ("b", "portfolio"): ([4.0], "")}
    assert cache.read(spark, f"{tmp_path}/c.json", "other").count() == 0


def test_feed_of_all_kinds(spark):
    items = spark.createDataFrame(
        [("d", "f.pdf", 1, "i1", "section_header", "keep", " Title ", ""), ("d", "f.pdf", 2, "i2", "text", "discard", "gone", ""), ("d", "f.pdf", 3, "i3", "table", "keep", "", ""), ("d", "f.pdf", 4, "i4", "table", None, "", ""), ("d", "f.pdf", 5, "i5", "picture", "keep", "", "see\t here"), ("d", "f.pdf", 6, "i6", "picture", "keep", "", ""), ("d", "f.pdf", 7, "i7", "list_item", "keep", "one", ""), ("e", None, 1, "j1", "text", "discard", "x", "")],
        "doc_id string, file_name string, reading_order int, item_id string, kind string, human_status string, text string, human_note string",
    )
    cleaned = spark.createDataFrame([("i3", "t1", "", ["a"], [{"a": "x"}], 2), ("i3", "t0", "old", ["a"], [{"a": "y"}], 1)], "item_id string, table_id string, caption string, columns array<string>, rows array<map<string,string>>, pos int")
    raw = spark.createDataFrame([("i3", "r", "| r |", 1)], "item_id string, table_id string, raw_markdown string, pos int")
    seen = spark.createDataFrame([("i6", "v1", "chart", "bars", ["a", "b"], 1)], "item_id string, visual_id string, visual_type string, summary string, visible_text array<string>, pos int")
    feeds = {r.doc_id: r.feed for r in dossier.whole_feed(items, cleaned, raw, seen).collect()}
    parts = ["\n# Document: f.pdf\n", "\n## Title\n", "\n### Cleaned Table: t1\n", "| a   |\n|:----|\n| x   |", "\n### Raw Docling Table: i4\n", "(No raw table text available.)", "\n### Visual Reviewer Note\nsee here\n", "\n### Visual Summary: v1\n", "Type: chart\n", "Summary: bars\n", "Visible text: a; b", "- one"]
    assert feeds == {"d": "\n\n".join(parts), "e": "\n# Document: None\n"}
    assert dossier.run_feed(spark.createDataFrame(list(feeds.items()), "doc_id string, feed string")).first().feed == "\n\n".join([feeds["d"], feeds["e"]])


def test_split_documents(spark):
    df = spark.createDataFrame([("before\n# Document:  one.pdf \n\nbody\n\n# Document:two\n# Document: \n",)], "feed string")
    got = [(r.name, r.body) for r in dossier.split_feed(df, "feed").orderBy("part").collect()]
    assert got == [("before", "before"), ("one.pdf", "body"), ("two", "two")]


def test_upsert_of_one_column(spark):
    old = spark.createDataFrame([("a", [1.0], None, "m"), ("b", None, [2.0], "m")], "id string, x array<double>, y array<double>, meta string")
    new = spark.createDataFrame([("a", [9.0], "other"), ("c", [8.0], "first")], "id string, x array<double>, meta string")
    got = {r.id: (r.x, r.y, r.meta) for r in vectors.upsert_columns(old, new, "id", "x").collect()}
    assert got == {"a": ([9.0], None, "m"), "b": (None, [2.0], "m"), "c": ([8.0], None, "first")}


def test_labels_by_plain_search(spark):
    from tallyforge.functions.fixed import INDUSTRY_NEEDLES

    texts = [("AI", ), ("an air hotel",), ("other financial services",), ("m-health devices",), (None,), ("maid",)]
    want = [[k for k, words in INDUSTRY_NEEDLES.items() if any(w in f" {(t or '').lower()} " for w in words)] for (t,) in texts]
    assert values(spark, tag_terms(F.col("t"), INDUSTRY_NEEDLES), texts, "t string") == want and want[0] == ["ai"]


def test_links_are_resolved(spark):
    rows = [("/a", "https://x.com/d/e?q#f"), ("b/c", "https://x.com/d/e"), ("//y.com/z", "http://x.com"), ("mailto:q", "https://x.com"), ("k", "https://x.com"), ("k", "https://x.com/")]
    assert values(spark, urls.joined(F.col("b"), F.col("h")), rows, "h string, b string") == ["https://x.com/a", "https://x.com/d/b/c", "http://y.com/z", "mailto:q", "https://x.com/k", "https://x.com/k"]


@pytest.mark.parametrize("force", [False, True])
def test_requirements(spark, force):
    texts = spark.createDataFrame([("a", "activity", "t"), ("a", "portfolio", "u"), ("b", "activity", "t")], "investor_id string, namespace string, text string")
    import hashlib

    h = {t: hashlib.md5(t.encode()).hexdigest() for t in "tu"}
    store = spark.createDataFrame([("a", "activity", h["t"]), ("a", "portfolio", h["u"]), ("b", "activity", "")], "investor_id string, namespace string, text_hash string")
    todo, counts = cache.requirements(texts, store, force)
    assert {(r.investor_id, r.namespace, r.reason) for r in todo.collect()} == ({("a", "activity", "force"), ("a", "portfolio", "force"), ("b", "activity", "force")} if force else {("b", "activity", "v1_no_hash")})
    assert {r.fully_cached for r in counts.collect()} == {0 if force else 1}


def test_deals_with_defaults(spark, tmp_path):
    from tallyforge.sources import readers

    deal = {n: "v" for n in readers.DEAL_REQUIRED} | {"raise_amount": 2.0, "documents": {"nda": "draft"}, "wire_verifications": [{"investor_name": "A", "wire_amount": 5}], "nda_signed_by": ["x"]}
    (tmp_path / "d.json").write_text(json.dumps(deal))
    d = readers.read_deals(spark, f"{tmp_path}/d.json").first()
    assert d.documents["nda"] == "draft" and d.documents["ppm"] == "missing" and len(d.documents) == 8 and d.stage == "onboarded" and d.errors == [] and d.outreach_week == 0
    assert (d.wire_verifications[0].status, d.wire_verifications[0].wire_amount, d.wire_verifications[0].notes) == ("pending", 5.0, "")
    (tmp_path / "e.json").write_text(json.dumps(deal | {"documents": {"nda": "lost"}}))
    with pytest.raises(Exception, match="not a document status: lost"):
        readers.read_deals(spark, f"{tmp_path}/e.json").collect()


def test_samples_and_templates(spark, tmp_path):
    from tallyforge.sources import readers

    (tmp_path / "s.json").write_text(json.dumps({"investors": [{"full_name": "A", "firm": "F", "email": "a@b"}, {"full_name": "B", "firm": "F"}]}))
    sample = readers.read_sample(spark, f"{tmp_path}/s.json")
    assert [(r.investor_id, r.full_name, r.source_tags) for r in sample.orderBy("investor_id").collect()] == [("seed_1", "A", ["mock_seed_dataset"]), ("seed_2", "B", ["mock_seed_dataset"])]
    own = spark.createDataFrame([("i1", "X", "Y", " A@B "), ("i2", "b", "f", "")], "investor_id string, full_name string, firm string, email string")
    assert readers.load_all(own, sample).count() == 4 and {r.investor_id for r in readers.load_all(own, sample, True).collect()} == {"i1", "i2"} and readers.load_all(own).count() == 2
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.json").write_text(json.dumps({"template_name": "n", "fields": [{"name": "a", "description": "b"}]}))
    found = readers.read_templates(spark, f"{tmp_path}/t/*.json")
    assert [(r.template, r.fields[0].name) for r in readers.template(found, "one").collect()] == [("one", "a")]
    with pytest.raises(Exception, match="template not found: two"):
        readers.template(found, "two").collect()


def test_ten_sheets(spark, tmp_path):
    from tallyforge.sources import writers

    docs = spark.createDataFrame([("d1", "f.pdf")], "doc_id string, file_name string")
    cleaned = spark.createDataFrame([("t1", "f.pdf", 1, "cap", ["a", "b"], [{"a": "1"}, {"a": "2"}], ["odd"])], "table_id string, file_name string, page_no int, caption string, columns array<string>, rows array<map<string,string>>, issues array<string>")
    raw = spark.createDataFrame([("t1", "m", "h")], "table_id string, raw_markdown string, raw_html string")
    dossier = spark.createDataFrame([({"arr": ("5", "said")}, [("d1", "s")])], "final_fields map<string,struct<value:string,answer:string>>, documents array<struct<doc_id:string,short_summary:string>>")
    sheets = writers.dossier_sheets(docs, docs, raw, cleaned, docs, docs, dossier, "run_1")
    assert len(sheets) == 10 and sheets["raw_tables"].columns == ["table_id"] and tuple(sheets["cleaned_tables"].first()) == ("t1", "f.pdf", 1, "cap", 2, "a, b", "odd")
    assert [tuple(r) for r in sheets["cleaned_table_rows"].collect()] == [("t1", 1, {"a": "1"}), ("t1", 2, {"a": "2"})] and tuple(sheets["dossier_fields"].first()) == ("arr", "5", "said", 0) and tuple(sheets["overview"].first()) == ("run_1", 1)
    writers.write_sheets(sheets, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 10


def test_records_have_every_field_and_no_other(spark):
    row = json.loads(spark.range(1).select(candidates.as_json(candidates.deal_record(deal_id=F.lit("d"), documents=F.lit(None).cast("map<string,string>"))).alias("r")).first().r)
    assert len(row) == 36 and row["deal_id"] == "d" and set(row["documents"].values()) == {"missing"} and len(row["documents"]) == 8 and row["valuation"] is None
    with pytest.raises(ValueError, match="nme"):
        candidates.company_record(nme=F.lit("x"))
