"""Pages to text: hand-made pages, budgets, hints; malformed pages don't break."""

from __future__ import annotations

import json

from prospectrum.operators import documents
from prospectrum.operators.relational import budgeted_prefix
from pyspark.sql import functions as F

ABOUT = """<!doctype html><html lang="en"><head><title>Harbour Works</title><meta name="description" content="Cranes and more.">
<script>window.tracking = 1;</script><script type="application/ld+json">{"@context":"https://schema.org","@type":"Organization","name":"Harbour Works","url":"https://harbour.fi"}</script>
<script type="application/ld+json">{bad json</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav><div class="cookie-banner">We use cookies</div>
<main><h1>About Harbour Works</h1><p>We employ 150 people in Turku and serve customers across the Baltic.</p><p>Contact: hello@harbour.fi</p></main>
<footer>All rights reserved</footer></body></html>"""


def cleaned(spark, *pages):
    rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
    return {r.page_id: r for r in documents.clean_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_a_page_keeps_its_content_and_loses_the_rest(spark):
    p = cleaned(spark, ("https://harbour.fi/about", ABOUT))[0]
    assert "window.tracking" not in p.body and "cookies" not in p.body.lower()
    assert "hello@harbour.fi" in p.body and "150 people" in p.body
    assert len(p.json_ld) == 1 and p.language == "en" and p.title == "Harbour Works" and p.description == "Cranes and more."
    assert [(h.level, h.text) for h in p.headings] == [(1, "About Harbour Works")]
    assert p.body.startswith("--- PAGE: /about ---\nURL: https://harbour.fi/about") and "\nCONTENT:\n" in p.body
    assert p.input_bytes == len(ABOUT.encode()) and p.output_chars == len(p.body) and p.blocks_removed > 0


def test_empty_and_malformed_pages(spark):
    got = cleaned(spark, ("https://a.fi", "<html><body></body></html>"), ("https://a.fi", "<p>one<p>two<b>three"), ("https://a.fi", "</div></p><<>&& <li>"), ("https://a.fi", ""), (None, "<p>x</p>"), ("https://a.fi", None))
    assert set(got) == {0, 1, 2} and got[0].low_quality
    assert "one" in got[1].body and "three" in got[1].body


def test_structured_data_without_a_name_goes_by_its_address(spark):
    of = lambda **x: f'<script type="application/ld+json">{json.dumps({"@type": "Organization"} | x)}</script>'
    html = of(name=None, url="https://a.fi") + of(name=None, url="https://b.fi") + of(url="https://a.fi") + of(name="", url="https://c.fi") + of(name="", url="https://d.fi") + of(name="A") + of(name="A", url="x")
    kept = [json.loads(x) for x in cleaned(spark, ("https://a.fi", html))[0].json_ld]
    assert [(x.get("name"), x.get("url")) for x in kept] == [(None, "https://a.fi"), (None, "https://b.fi"), ("", "https://c.fi"), ("A", None)]


def test_deep_and_long_pages_end(spark):
    got = cleaned(spark, ("https://a.fi", "<div>" * 300 + "deep text" + "</div>" * 300), ("https://a.fi", "<main>" + "word " * 60_000 + "</main>"))
    assert "deep text" in got[0].body and len(got[1].body) == documents.PAGE_CHARS


def test_a_budget_cuts_after_the_content_mark(spark):
    df = spark.createDataFrame([("head\nCONTENT:\n" + "x" * 50, "y" * 40)], "a string, b string")
    assert df.select(documents.within_budget(F.col("a"), 30)).first()[0] == "head\nCONTENT:\n" + "x" * 16
    assert df.select(documents.within_budget(F.col("a"), 5)).first()[0] == "head\nCONTENT:\n"
    assert df.select(documents.within_budget(F.col("b"), 30)).first()[0] == "y" * 30


def test_pages_of_a_company_within_a_budget(spark):
    rows = [("c", 0, "/team", "t" * 20), ("c", 1, "/", "h" * 20), ("d", 0, "/x", "x" * 20), ("d", 1, "/", "y" * 20)]
    pages = spark.createDataFrame(rows, "company string, place int, path string, body string")
    whole = {r.company: r.document for r in documents.company_documents(pages, "company", "place", 42).collect()}
    assert whole["c"] == "t" * 20 + "\n\n" + "h" * 20  # fits: the given order
    cut = {r.company: r.document for r in documents.company_documents(pages, "company", "place", 41).collect()}
    assert cut["c"] == "h" * 20 and cut["d"] == "y" * 20  # the home page first


def test_budgeted_prefix_against_a_model(spark):
    import random

    rng = random.Random(2)
    rows = [(k, i, rng.randrange(30)) for k in range(20) for i in range(12)]
    want = set()
    for k in range(20):
        total, first = 0, True
        for key, i, n in rows:
            if key != k:
                continue
            joined = total if first else total
            if joined + n + 2 > 100:
                break
            total = n if first else total + 2 + n
            first = False
            want.add((k, i))
    df = spark.createDataFrame(rows, "k int, i int, n int")
    assert {(r.k, r.i) for r in budgeted_prefix(df, "k", [F.col("i")], "n", 100).collect()} == want


def test_hints_follow_the_name(spark):
    html = "<h3>John Smith, CTO</h3><a href='mailto:john@acme.fi'>m</a><a href='https://linkedin.com/in/johnsmith'>l</a>" + "." * 400
    html += "<h3>Jane Doe, CEO</h3><a href='mailto:info@acme.fi'>i</a><a href='mailto:Jane.Doe@acme.fi'>m</a><a href='https://linkedin.com/in/janedoe'>l</a>"
    rows = [(1, html, "Jane Doe, CEO"), (2, html, "unknown"), (3, None, "Jane Doe"), (4, html, None)]
    got = {r.page_id: (r.email, r.linkedin_url) for r in documents.contact_hints(spark.createDataFrame(rows, "page_id long, html string, decision_maker string"), "page_id").collect()}
    assert got[1] == ("jane.doe@acme.fi", "https://linkedin.com/in/janedoe") and got[2] == got[3] == got[4] == (None, None)


def test_rejected_and_cleaned_pages_come_from_one_pass(spark, sf_dir):
    from prospectrum.queries import QUERIES

    plan = QUERIES["h13_rejected_pages"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Relation [") == 1


def test_references_without_a_semicolon_are_read(spark):
    pages = spark.createDataFrame([(1, "https://acme.fi/", "<title>A &amp; B&amp</title><main><h1>C&amp</h1><p>D&ampE &am</p></main>")], "page_id long, url string, html string")
    row = documents.clean_pages(pages).first()
    assert (row.title, row.headings[0].text) == ("A & B&", "C&") and "D&E &am" in row.body
