"""Entity resolution and writes, as functions from old tables to new ones.

Plain Parquet has no MERGE: a write takes the table and a batch and returns
the new table, with the counts where the operation reports some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospectrum.functions.urls import is_blocked_domain, site


def _first(rows: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The first row of each key; pruned before the shuffle as well."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def _with_site(rows: DataFrame, website: str) -> DataFrame:
    """rows with the normalized website and its domain."""
    return rows.withColumn("__site", site(website)).withColumns({"website": F.col("__site.website"), "domain": F.col("__site.site_domain")}).drop("__site")


def dedup_candidates(candidates: DataFrame, website: str = "website", confidence: str = "confidence", ordinal: str = "ordinal") -> DataFrame:
    """By domain the most confident, the first seen on ties; invalid and
    blocked sites are skipped. The first row of each spelling of a website is
    found before any is parsed."""
    order = [F.col(confidence).desc(), ordinal]
    named = _with_site(_first(candidates, website, order), website)
    return _first(named.where(F.col("domain").isNotNull() & ~is_blocked_domain("domain")), "domain", order)


def dedup_upserts(inputs: DataFrame, website: str = "website", name: str = "name", ordinal: str = "ordinal") -> DataFrame:
    """By domain the first with a name, else the first. An invalid or
    blocked site fails the whole batch."""
    order = [(F.coalesce(F.col(name), F.lit("")) == "").cast("int"), ordinal]
    named = _with_site(_first(inputs, website, order), website)
    bad = F.col("domain").isNull() | is_blocked_domain("domain")
    checked = named.withColumn("domain", F.when(bad, F.raise_error(F.lit("invalid or blocked website"))).otherwise(F.col("domain")))
    return _first(checked, "domain", order)


def first_by_domain(rounds: DataFrame, round_no: str = "round", ordinal: str = "ordinal") -> DataFrame:
    """Across discovery rounds, each domain where it came first."""
    return _first(rounds, "domain", [round_no, ordinal])


def upsert_companies(companies: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M1, M2: (new table, counts). A name only if given, the website always.

    companies: domain, name, website. batch: one row for each domain.
    Existing rows count as updated even if nothing changes.
    """
    old, new = companies.alias("o"), batch.alias("n")
    both = old.join(new, F.col("o.domain") == F.col("n.domain"), "full_outer")
    table = both.select(F.coalesce("o.domain", "n.domain").alias("domain"), F.coalesce("n.name", "o.name").alias("name"), F.coalesce("n.website", "o.website").alias("website"))
    seen = F.col("o.domain").isNotNull()
    counts = new.join(old, F.col("o.domain") == F.col("n.domain"), "left").agg(F.count_if(~seen).alias("inserted"), F.count_if(seen).alias("updated"))
    return table, counts


def add_discovered(results: DataFrame, found: DataFrame, job: str = "job_id", company: str = "company_id", ordinal: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(results that are new, skipped). Companies already in the
    job are skipped, as are repeats in the batch; a missing rank is the place
    among all inputs, after the job's greatest."""
    seen = results.groupBy(job).agg(F.max(F.coalesce("rank", F.lit(0))).alias("__most"))
    place = F.row_number().over(Window.partitionBy(job).orderBy(ordinal))
    placed = found.withColumn("__place", place).join(seen, job, "left")
    placed = placed.withColumn("rank", F.coalesce("rank", F.col("__place") + F.coalesce("__most", F.lit(0))))
    first = placed.withColumn("__n", F.row_number().over(Window.partitionBy(job, company).orderBy(ordinal))).where("__n = 1")
    new = first.join(results.select(job, company), [job, company], "left_anti").drop("__place", "__most", "__n")
    skipped = found.groupBy(job).agg(F.count("*").alias("given")).join(new.groupBy(job).agg(F.count("*").alias("added")), job, "left")
    return new, skipped.select(job, (F.col("given") - F.coalesce("added", F.lit(0))).alias("skipped"))


def save_profiles(profiles: DataFrame, batch: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Rows to append. A hash that the company has is no new version;
    others follow its greatest version in the batch's order."""
    once = batch.withColumn("__n", F.row_number().over(Window.partitionBy("company_id", "content_hash").orderBy(ordinal))).where("__n = 1").drop("__n")
    new = once.join(profiles.select("company_id", "content_hash"), ["company_id", "content_hash"], "left_anti")
    most = profiles.groupBy("company_id").agg(F.max("version").alias("__most"))
    place = F.row_number().over(Window.partitionBy("company_id").orderBy(ordinal))
    return new.join(most, "company_id", "left").withColumn("version", (F.coalesce("__most", F.lit(0)) + place).cast("int")).drop("__most")


def replace_signals(signals: DataFrame, batch: DataFrame, key: str = "company_id") -> DataFrame:
    """M5: the batch's companies have just the batch's signals."""
    return signals.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch.select(signals.columns))


def insert_missing(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """M6: rows whose keys are new are added; nothing is updated."""
    fresh = batch.dropDuplicates(keys).join(table.select(keys), keys, "left_anti")
    return table.unionByName(fresh.select(table.columns))


def upsert_schedules(schedules: DataFrame, batch: DataFrame, now: str) -> DataFrame:
    """M7: interval and enabled change; the next run moves only when enabled."""
    keys = ["user_id", "company_id"]
    old, new = schedules.alias("o"), batch.alias("n")
    both = old.join(new, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    given, after = F.col("n.user_id").isNotNull(), F.date_add(F.lit(now).cast("date"), F.col("n.interval_days"))
    run = F.when(given & (F.col("n.enabled") | F.col("o.user_id").isNull()), after).otherwise(F.col("o.next_run"))
    pick = lambda c: F.when(given, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select(*[pick(c) for c in [*keys, "interval_days", "enabled"]], run.alias("next_run"))


def fail_jobs(jobs: DataFrame, stale: Column, message: str) -> DataFrame:
    """M8: stale jobs become FAILED, with a message."""
    return jobs.withColumns({"error_message": F.when(stale, F.lit(message)), "status": F.when(stale, "FAILED").otherwise(F.col("status"))})


def delete_company(companies: DataFrame, results: DataFrame, recipients: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M9: (companies, results, not found). A company with a campaign recipient
    stays; of the others the results go first."""
    free = gone.join(recipients.select("company_id"), "company_id", "left_anti").join(companies.select("company_id"), "company_id", "left_semi")
    kept = lambda rows: rows.join(free, "company_id", "left_anti")
    return kept(companies), kept(results), gone.join(free, "company_id", "left_anti")


def delete_campaigns(campaigns: DataFrame, gone: DataFrame) -> DataFrame:
    """M9: all but the running ones of those named go."""
    return campaigns.join(gone.join(campaigns.where("status <> 'RUNNING'").select("campaign_id"), "campaign_id", "left_semi"), "campaign_id", "left_anti")


def delete_owned(rows: DataFrame, asked: DataFrame, key: str = "id", user: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """M9: (rows that stay, asked with the number that went). A row goes only
    for its own user; a wrong one deletes nothing."""
    once = asked.select(key, user).distinct()
    counts = rows.join(once, [key, user]).groupBy(key, user).agg(F.count("*").alias("deleted"))
    return rows.join(once, [key, user], "left_anti"), asked.join(counts, [key, user], "left").fillna(0, ["deleted"])


def prunable(companies: DataFrame, newest: DataFrame, has_contact: Column) -> DataFrame:
    """Companies whose latest profile has no contact, or that have none."""
    return companies.join(newest.where(has_contact).select("company_id"), "company_id", "left_anti")
