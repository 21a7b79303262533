"""Batches that a loop would handle one by one: slugs, campaigns from ids."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospectrum.functions.text import organization_slug, slug_candidates

CANDIDATES = 50


def _family(slug: Column) -> Column:
    """What a slug shares with all its candidates: the part before the first
    number, up to where a long slug is cut."""
    return F.left(F.regexp_replace(slug, "-[0-9].*$", ""), F.lit(90))


def allocated_slugs(organizations: DataFrame, taken: DataFrame, name: str = "name", order: str = "ordinal") -> DataFrame:
    """organizations with their ``slug``, as if each in turn took its first
    candidate that is free; null where all 50 are taken.

    taken: (slug). Only candidates of the same family can meet, so families are
    settled side by side. Of the organizations with one base slug only the
    first 50 can get any, so the others fail before that, and a family holds
    no more than 50 rows for each base slug however often a name comes.
    """
    asked = organizations.withColumn("__base", organization_slug(name))
    place = F.row_number().over(Window.partitionBy("__base").orderBy(order))
    first = asked.select(F.col(order).alias("ordinal"), F.col("__base").alias("base")).withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("ordinal"))).where(f"n <= {CANDIDATES}")
    wanted = first.select("base").distinct().select(F.explode(slug_candidates("base")).alias("slug")).distinct()
    held = taken.select("slug").distinct().join(wanted, "slug", "left_semi").select(_family(F.col("slug")).alias("family"), F.lit(None).cast(first.schema["ordinal"].dataType).alias("ordinal"), "slug", F.lit(None).cast("array<string>").alias("candidates"))
    rows = first.select(_family(F.col("base")).alias("family"), "ordinal", F.lit(None).cast("string").alias("slug"), slug_candidates("base").alias("candidates")).unionByName(held)
    kind = first.schema["ordinal"].dataType.simpleString()

    def settled(group: pd.DataFrame) -> pd.DataFrame:
        used = set(group.slug[group.slug.notna()])
        own = group[group.slug.isna()].sort_values("ordinal")
        slugs = []
        for candidates in own.candidates:
            slugs.append(next((c for c in candidates if c not in used), None))
            used.add(slugs[-1])
        return pd.DataFrame({"__order": own.ordinal, "slug": pd.Series(slugs, own.index, dtype=object)})

    given = rows.groupBy("family").applyInPandas(settled, f"__order {kind}, slug string")
    numbered = asked.withColumn("__n", place)
    early, late = numbered.where(f"__n <= {CANDIDATES}"), numbered.where(f"__n > {CANDIDATES}")
    settled_rows = early.join(given, early[order] == given["__order"])
    return settled_rows.select(*organizations.columns, "slug").unionByName(late.select(*organizations.columns, F.lit(None).cast("string").alias("slug")))


def campaigns_from_ids(
    campaigns: DataFrame, result_ids: DataFrame, company_ids: DataFrame, results: DataFrame, jobs: DataFrame, companies: DataFrame, newest: DataFrame, resolve: Callable[[Column, Column], Column], profile: str = "profile"
) -> tuple[DataFrame, DataFrame]:
    """(recipients, failures) of new campaigns.

    campaigns: campaign_id, user_id, channel. result_ids: campaign_id, ordinal,
    result_id; company_ids: campaign_id, ordinal, company_id. results: result_id,
    job_id, company_id; jobs: job_id, user_id; companies: company_id, domain;
    newest: company_id and the latest profile. resolve: F35, (profile, channel)
    to (toAddress, toName, toEmail) or null.

    A result id of another user or without a profile is skipped (J5). A company
    that the user can't see (J4) or that has no profile fails its campaign, and so does
    a missing contact, an address that comes twice, and a campaign without recipients;
    failures has the first reason: code and message.
    """
    known = companies.select("company_id", "domain").join(newest.select("company_id", F.col(profile).alias("profile")), "company_id")
    mine = results.join(jobs.select("job_id", "user_id"), "job_id")
    by_result = result_ids.join(campaigns, "campaign_id").join(mine.select("result_id", "user_id", "company_id"), ["result_id", "user_id"]).join(known, "company_id")
    seen = mine.select("user_id", "company_id").distinct().join(known, "company_id")
    by_company = company_ids.join(campaigns, "campaign_id").join(seen, ["user_id", "company_id"], "left").withColumn("result_id", F.lit(None).cast(results.schema["result_id"].dataType))
    names = ["campaign_id", "channel", "company_id", "result_id", "ordinal", "domain", "profile"]
    asked = by_result.select(F.lit(0).alias("part"), *names).unionByName(by_company.select(F.lit(1).alias("part"), *names))
    rows = asked.withColumn("r", F.when(F.col("domain").isNotNull(), resolve(F.col("profile"), F.col("channel"))))
    reason = lambda code, message: F.struct(F.lit(code).alias("code"), message.alias("message"))
    wrong = F.when(F.col("domain").isNull(), reason("NOT_FOUND", F.concat(F.lit("Company not found: "), F.col("company_id").cast("string"))))
    wrong = wrong.when(F.col("r").isNull(), reason("VALIDATION_ERROR", F.concat(F.lit("No contact for "), "channel", F.lit(": "), "domain")))
    rows = rows.withColumn("wrong", wrong).withColumn("address", F.col("r.toAddress"))
    twice = rows.where("address is not null").groupBy("campaign_id", "address").agg(F.count("*").alias("n")).where("n > 1").groupBy("campaign_id").agg(F.min("address").alias("twice"))
    state = rows.groupBy("campaign_id").agg(F.min_by("wrong", F.when(F.col("wrong").isNotNull(), F.struct("part", "ordinal"))).alias("wrong"), F.count("*").alias("n"))
    state = campaigns.select("campaign_id").join(state, "campaign_id", "left").join(twice, "campaign_id", "left")
    failed = F.coalesce("wrong", F.when(F.col("n").isNull(), reason("INVALID_INPUT", F.lit("At least one recipient is required"))), F.when(F.col("twice").isNotNull(), reason("CONFLICT", F.concat(F.lit("Repeated address: "), "twice"))))
    failures = state.select("campaign_id", failed.alias("f")).where("f is not null").select("campaign_id", "f.code", "f.message")
    good = rows.join(failures.select("campaign_id"), "campaign_id", "left_anti")
    return good.select("campaign_id", "company_id", "result_id", "channel", F.col("address").alias("to_address"), F.col("r.toName").alias("to_name"), F.col("r.toEmail").alias("to_email")), failures
