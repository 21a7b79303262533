"""Slugs of a batch against one-by-one insertion; campaigns from ids."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from prospectrum.operators import allocation


def slug_of(name: str) -> str:
    return re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", name.lower().strip()))[:100] or "organization"


def one_by_one(names: list[str], taken: set[str]) -> list[str | None]:
    used, out = set(taken), []
    for name in names:
        base = slug_of(name)
        candidates = [base] + [base[: 100 - len(f"-{i}")] + f"-{i}" for i in range(2, 51)]
        out.append(next((c for c in candidates if c not in used), None))
        used.add(out[-1])
    return out


def test_slugs_of_a_batch_are_those_of_one_by_one(spark):
    rng = random.Random(5)
    pool = ["Acme", "ACME!", "acme 2", "Acme-2-3", "acme 50", "acme 51", "Ünï", "***", "", "漢字", "x" * 120, "x" * 99 + " 7", "x" * 97 + "-2", "x" * 98, "y-" * 60, "q-7" * 40, "Harbour Works", "harbour works 2", "organization 3"]
    names = [rng.choice(pool) if rng.random() < 0.2 else f"Firm {rng.randrange(4000)}" for _ in range(10_000)]
    taken = {"acme", "acme-3", "acme-2-2", "organization-2", "x" * 98 + "-2", "free", "firm-7", "firm-7-2"}
    rows = spark.createDataFrame([(i, n, "own") for i, n in enumerate(names)], "ordinal long, name string, slug_of string").repartition(6)
    found = allocation.allocated_slugs(rows, spark.createDataFrame([(t,) for t in taken], "slug string"))
    assert found.columns == ["ordinal", "name", "slug_of", "slug"]
    got = {r.ordinal: r.slug for r in found.collect()}
    want = one_by_one(names, taken)
    assert got == dict(enumerate(want)) and None in want
    assert allocation.allocated_slugs(rows.limit(0), rows.select(F.col("name").alias("slug"))).collect() == []


def test_campaigns_fail_for_the_first_reason(spark):
    make = spark.createDataFrame
    campaigns = make([(i, 1, "EMAIL") for i in range(1, 9)], "campaign_id long, user_id long, channel string")
    results = make([("r1", 10, 1), ("r2", 10, 2), ("r3", 11, 3), ("r4", 10, 4), ("r5", 10, 5)], "result_id string, job_id long, company_id long")
    jobs = make([(10, 1), (11, 2)], "job_id long, user_id long")
    companies = make([(i, f"d{i}.fi") for i in range(1, 7)], "company_id long, domain string")
    newest = make([(1, "a@d1.fi"), (2, "a@d2.fi"), (3, "a@d3.fi"), (4, None), (5, "a@d1.fi")], "company_id long, profile string")
    ids = make([(1, 0, "r1"), (1, 1, "r3"), (1, 2, "nothing"), (2, 0, "r3"), (3, 0, "r4"), (3, 1, "r1"), (4, 0, "r1"), (5, 0, "r1"), (5, 1, "r5"), (7, 0, "r4")], "campaign_id long, ordinal int, result_id string")
    named = make([(1, 0, 2), (4, 0, 3), (6, 0, 99), (7, 0, 99), (8, 0, 2)], "campaign_id long, ordinal int, company_id long")
    resolve = lambda p, channel: F.when(p.isNotNull(), F.struct(p.alias("toAddress"), F.lit("A").alias("toName"), p.alias("toEmail")))
    good, bad = allocation.campaigns_from_ids(campaigns, ids, named, results, jobs, companies, newest, resolve)
    assert {(r.campaign_id, r.company_id, r.result_id, r.to_address) for r in good.collect()} == {(1, 1, "r1", "a@d1.fi"), (1, 2, None, "a@d2.fi"), (8, 2, None, "a@d2.fi")}
    assert {r.campaign_id: (r.code, r.message) for r in bad.collect()} == {
        2: ("INVALID_INPUT", "At least one recipient is required"), 3: ("VALIDATION_ERROR", "No contact for EMAIL: d4.fi"), 4: ("NOT_FOUND", "Company not found: 3"),
        5: ("CONFLICT", "Repeated address: a@d1.fi"), 6: ("NOT_FOUND", "Company not found: 99"), 7: ("VALIDATION_ERROR", "No contact for EMAIL: d4.fi"),
    }
