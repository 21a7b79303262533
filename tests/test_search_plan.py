"""Ports, commits and the search plan with recorded answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prospectrum.operators import entity
from prospectrum.plans import search
from prospectrum.sources import ports

GOOD = {"companyName": "A", "description": "x" * 30, "industry": "logistics", "city": "Oulu", "country": "Finland", "decisionMaker": "Jane Doe", "services": ["a"], "email": "info@acme.fi", "phone": "+358401234567"}


def jobs(spark, *limits):
    return spark.createDataFrame([(i, "q", "{}", n) for i, n in enumerate(limits)], "job_id long, query string, criteria string, company_limit long")


def run(spark, discover, enrich, *limits):
    results, summaries = search.run_searches(jobs(spark, *limits), search.Ports(discover, enrich))
    return results.collect(), {r.job_id: r for r in summaries.collect()}


def fresh(row, n=2):
    seen = set(filter(None, row["excluded"].split("\n")))
    sites = [f"https://c{i}-{row['job_id']}.fi" for i in range(40)]
    return [{"companyName": s, "website": s, "confidence": 0.5} for s in sites if s not in seen][:n]


def test_a_limit_is_met_over_rounds(spark):
    results, s = run(spark, fresh, lambda row: GOOD, 5, 1)
    assert (s[0].enriched, s[0].final_status, s[0].message) == (5, "COMPLETED", None)
    assert (s[1].enriched, s[1].discovered) == (1, 1)  # never more than is wanted
    assert sorted(r["rank"] for r in results if r.job_id == 0) == [1, 2, 3, 4, 5]


def test_attempts_are_bounded(spark):
    _, s = run(spark, fresh, lambda row: None, 4)
    assert (s[0].discovered, s[0].enriched, s[0].failed, s[0].final_status, s[0].message) == (12, 0, 12, "FAILED", "No leads were fully processed")


def test_a_round_without_news_ends_the_job(spark):
    _, s = run(spark, lambda row: [{"companyName": "A", "website": "acme.fi", "confidence": 1.0}], lambda row: GOOD, 3, None)
    assert (s[0].discovered, s[0].enriched) == (1, 1) and "Only 1 of 3" in s[0].message
    assert (s[1].discovered, s[1].enriched, s[1].message) == (1, 1, None)


def test_errors_and_thin_profiles(spark):
    def enrich(row):
        if row["company_id"].startswith("c0"):
            raise ValueError("timeout")
        if row["company_id"].startswith("c1"):
            return {"companyName": "A", "email": "info@acme.fi"}
        if row["company_id"].startswith("c2"):
            return {"companyName": "A", "description": "x" * 30}
        return GOOD

    results, s = run(spark, lambda row: fresh(row, 4), enrich, 4)
    assert s[0].enriched == 4 and s[0].removed == 2 and s[0].failed == 1
    assert {r.company_id[:2]: r.stage for r in results}["c0"] == "ENRICH_FAILED" and not {"c1", "c2"} & {r.company_id[:2] for r in results}
    assert [r.stage_error for r in results if r.stage == "ENRICH_FAILED"] == ["timeout"]
    assert "2 companies could not be enriched" in s[0].message


def test_blocked_and_invalid_sites_are_skipped(spark):
    answers = [("A", "https://fi.linkedin.com/a", 0.9), ("B", "nodomain", 0.9), ("C", "http://www.acme.fi/x", 0.3), ("D", "acme.fi", 0.8)]
    results, _ = run(spark, lambda row: [{"companyName": n, "website": w, "confidence": c} for n, w, c in answers], lambda row: GOOD, 9)
    assert [(r.name, r.company_id) for r in results] == [("D", "acme.fi")]


def test_discovery_errors_end_a_job_as_failed(spark):
    def broken(row):
        raise RuntimeError("down")

    _, s = run(spark, broken, lambda row: GOOD, 2)
    assert (s[0].discovered, s[0].final_status) == (0, "FAILED")


def test_no_jobs(spark):
    results, summaries = search.run_searches(spark.createDataFrame([], "job_id long, query string, criteria string, company_limit long"), search.Ports(fresh, lambda row: GOOD))
    assert results.count() == summaries.count() == 0


def pool(row):
    """Four sites from a pool that all jobs share, two of them seen if the job has some; the second twice."""
    seen = len(set(filter(None, row["excluded"].split("\n"))))
    first = row["job_id"] % 3 + max(0, seen - 2)
    sites = [(f"https://c{i}.fi", 0.9 - i % 4 / 10) for i in range(first, min(first + 4, 14))]
    return [{"companyName": w, "website": w, "confidence": c} for w, c in [*sites, *[(f"{w}/x", 0.65) for w, _ in sites[1:2]]]]


def by_number(row):
    n = int(row["company_id"][1:].split(".")[0]) % 6
    if n == 0:
        raise ValueError("timeout")
    return {"companyName": "A", "description": "x" * 30} if n == 1 else {"companyName": "A", "email": "info@acme.fi"} if n == 2 else GOOD


def plain_search(job_id, limit):
    """The rounds of one job over ``pool`` and ``by_number``: company_id to (rank, stage, website)."""
    stages, rows, tried = ["ENRICH_FAILED", "REMOVED_COMPANY", "REMOVED", "ENRICHED", "ENRICHED", "ENRICHED"], {}, 0
    for _ in range(search.OPEN_ROUNDS if limit is None else search.TARGET_ROUNDS):
        deficit = None if limit is None else max(0, limit - sum(s == "ENRICHED" for _, s, _ in rows.values()))
        wanted = None if limit is None else min(deficit, search.ATTEMPTS_PER_LEAD * limit - tried)
        if wanted is not None and wanted <= 0:
            break
        best, greatest = {}, max((r for r, _, _ in rows.values()), default=0)
        for i, x in enumerate(pool({"job_id": job_id, "excluded": "\n".join(w for _, _, w in rows.values())})):
            domain, place = x["website"].split("/")[2], (-x["confidence"], i, x["website"])
            best[domain] = min(place, best.get(domain, place))
        found = sorted((place, domain) for domain, place in best.items())[:wanted]
        new = {d: (greatest + n, stages[int(d[1:-3]) % 6], w) for n, ((_, _, w), d) in enumerate(found, 1) if d not in rows}
        rows, tried = rows | new, tried + len(found)
        if not new:
            break
    return rows


def test_rounds_are_those_of_a_plain_loop(spark):
    limits = [1, 2, 3, 5, 8, 20, None, 0, None, 4]
    results, s = run(spark, pool, by_number, *limits)
    want = {i: plain_search(i, limit) for i, limit in enumerate(limits)}
    gone = {c for rows in want.values() for c, (_, stage, _) in rows.items() if stage == "REMOVED_COMPANY"}
    assert {(r.job_id, r.company_id, r["rank"], r.stage, r.website) for r in results} == {(i, c, *row) for i, rows in want.items() for c, row in rows.items() if not row[1].startswith("REMOVED") and c not in gone}
    for i, rows in want.items():
        stages = [stage for _, stage, _ in rows.values()]
        assert (s[i].discovered, s[i].enriched, s[i].removed, s[i].failed) == (len(rows), stages.count("ENRICHED"), sum(x.startswith("REMOVED") for x in stages), stages.count("ENRICH_FAILED"))


def test_no_round_writes_the_results_of_those_before(spark, monkeypatch):
    rows, plain = {}, search.written

    def counted(df, name):
        table = plain(df, name)
        rows[name] = [*rows.get(name, []), table.count()]
        return table

    monkeypatch.setattr(search, "written", counted)
    _, s = run(spark, fresh, lambda row: None, 4, 2, None)
    assert len(rows["results"]) > 3 and sum(rows["results"]) == sum(x.discovered for x in s.values())


def test_retries_double_or_step():
    for growth, delays in (("exponential", [0.1, 0.2, 0.4]), ("linear", [0.1, 0.2, 0.3])):
        calls, waits = [], []

        def fails(x, calls=calls):
            calls.append(x)
            if len(calls) < 4:
                raise ValueError("no")
            return x

        assert ports.retried(fails, 4, 100, growth, sleep=waits.append)(7) == 7
        assert [round(w, 6) for w in waits] == delays
    with pytest.raises(ValueError):
        ports.retried(lambda: int("x"), 3, 1, again=lambda e: False, sleep=lambda s: pytest.fail("slept"))()


def test_crawl_asks_only_for_allowed_pages(spark):
    rows = spark.createDataFrame([(1,)], "company_id long")
    targets = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(f"https://a.fi{p}").alias("url")) for p in ("/", "/about", "/careers")])

    def get(url):
        if url.endswith("about"):
            raise OSError("timeout")
        return f"<p>{url}</p>"

    got = {r.path: (r.html, r.error) for r in ports.crawled(rows, targets, get, F.col("path") != "/careers").collect()}
    assert got == {"/": ("<p>https://a.fi/</p>", None), "/about": (None, "timeout")}


def test_queries_are_parsed_or_unknown(spark):
    answers = {"a": {"industry": "SaaS", "location": " Finland ", "employeeRange": "50-200"}, "b": {"industry": "", "employeeRange": "lots of people"}}
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "query string")
    got = {r["query"]: tuple(r.criteria) for r in ports.parsed_queries(rows, lambda row: answers[row["query"]]).collect()}
    assert got == {"a": ("saas", "Finland", "50-200"), "b": ("unknown",) * 3, "c": ("unknown",) * 3}


def test_prompts_escape_values(spark):
    row = spark.createDataFrame([('say """x"""',)], "v string").select(ports.prompt("A {{v}} and {{v}}.", v="v").alias("p")).first().p
    assert '"""' not in row and row.count("say") == 2


def test_invalid_upserts_fail_the_batch(spark):
    rows = spark.createDataFrame([("A", "acme.fi", 1), (None, "linkedin.com", 2)], "name string, website string, ordinal int")
    with pytest.raises(Exception, match="invalid or blocked"):
        entity.dedup_upserts(rows).collect()
    assert entity.dedup_candidates(rows.withColumn("confidence", F.lit(1.0))).count() == 1



def test_a_cancelled_job_keeps_what_it_has(spark):
    rounds = []

    def cancelled():
        rounds.append(1)
        return spark.createDataFrame([(0,)] if len(rounds) > 1 else [], "job_id long")

    results, summaries = search.run_searches(jobs(spark, 5, 3), search.Ports(fresh, lambda row: GOOD), cancelled=cancelled)
    s = {r.job_id: r for r in summaries.collect()}
    assert (s[0].enriched, s[0].final_status, s[0].message) == (2, "CANCELLED", None)
    assert (s[1].enriched, s[1].final_status) == (3, "COMPLETED")
    assert results.where("job_id = 0").count() == 2


def test_a_crawl_that_takes_too_long_is_given_up(spark):
    companies = spark.createDataFrame([(1, "a.fi"), (2, "slow.fi"), (3, "half.fi"), (4, "down.fi")], "company_id long, domain string")
    targets = F.array(*[F.struct(F.lit(p).alias("path"), F.concat(F.lit("https://"), "domain", F.lit(p)).alias("url")) for p in ("/", "/about")])

    class Clock:  # a slow company's pages take a minute each
        now = 0.0

    def get(url):
        Clock.now += 61 if "slow" in url else 1
        if "down" in url or url.endswith("half.fi/about"):
            raise OSError("no answer")
        return "<p>text</p>"

    got = {r.company_id: r for r in ports.company_crawls(companies, targets, get, 120_000, lambda: Clock.now).collect()}
    assert [(got[i].status, got[i].pages_succeeded, got[i].pages_attempted) for i in (1, 2, 3, 4)] == [("success", 2, 2), ("failed", 0, 0), ("partial", 1, 2), ("failed", 0, 2)]
    assert got[2].error == "Company crawl exceeded 120000ms" and got[1].error is None
    assert [(p.path, p.error) for p in got[3].pages] == [("/", None), ("/about", "no answer")]


def test_answers_are_checked(spark):
    good = {"companyName": " Acme ", "description": "Cranes", "industry": "LOGISTICS", "estimatedCompanySize": "50-200", "products": ["a", "A"]}
    rows = spark.createDataFrame([(i, "EMAIL") for i in range(4)], "id long, channel string")

    def by_id(*answers):
        def port(row):
            if isinstance(answers[row["id"]], Exception):
                raise answers[row["id"]]
            return answers[row["id"]]

        return port

    found = {r.id: r for r in ports.extracted(rows, by_id(good, good | {"companyName": " ", "estimatedCompanySize": "many"}, None, OSError("down"))).collect()}
    assert (found[0].value.companyName, found[0].value.industry, found[0].value.products, found[0].code) == ("Acme", "logistics", ["a"], None)
    assert [found[i].code for i in (1, 2, 3)] == ["VALIDATION_ERROR", "EMPTY_RESPONSE", "PROVIDER_ERROR"]
    assert found[1].broken == ["companyName", "estimatedCompanySize"] and found[1].value is None and found[3].error == "down"
    signal = {"type": "FUNDING", "title": "t", "summary": "s", "confidence": 0.5}
    found = {r.id: r for r in ports.detected_signals(rows, by_id({"signals": [signal]}, {"signals": [signal | {"confidence": 2}]}, {"signals": [signal] * 11}, {"signals": []})).collect()}
    assert [found[i].code for i in range(4)] == [None, "VALIDATION_ERROR", "VALIDATION_ERROR", None] and found[0].value.signals[0].type == "FUNDING"
    found = {r.id: r for r in ports.written_messages(rows, by_id({"subject": "Hi", "bodyText": "x"}, {"subject": " ", "bodyText": "x"}, "", {"bodyText": "x"})).collect()}
    assert [found[i].code for i in range(4)] == [None, "VALIDATION_ERROR", "EMPTY_RESPONSE", "VALIDATION_ERROR"]


def test_senders_by_channel():
    from prospectrum.streaming import delivery

    send = delivery.by_channel({"EMAIL": lambda row: f"e{row['id']}", "WHATSAPP": lambda row: f"w{row['id']}"})
    assert [send({"id": 1, "channel": c}) for c in ("EMAIL", "WHATSAPP")] == ["e1", "w1"]
    with pytest.raises(ValueError, match="LINKEDIN"):
        send({"id": 1, "channel": "LINKEDIN"})
