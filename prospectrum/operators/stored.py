"""The writes M1 to M10 on stored tables: only the buckets of a batch's keys
are read and written, and writers at the same time lose nothing.

What each write does to rows is in ``entity``; here it meets a ``Store``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectrum.operators import entity
from prospectrum.sources.store import Store, Transaction
from prospectrum.sources.tables import written

#: Key columns of the tables, by which they are dealt into buckets.
KEYS = {
    "companies": ["domain"], "results": ["job_id"], "profiles": ["company_id"], "signals": ["company_id"], "schedules": ["user_id", "company_id"],
    "saved_searches": ["user_id", "job_id"], "jobs": ["job_id"], "recipients": ["company_id"],
}


def created(store: Store, buckets: int, **tables: DataFrame) -> None:
    """First states of tables, in one commit."""

    def make(t: Transaction) -> None:
        for name, rows in tables.items():
            t.create(name, rows, KEYS[name], buckets)

    store.run(make)


def upsert_companies(store: Store, batch: DataFrame) -> dict[str, int]:
    """M1, M2: counts of the rows that were new and that were there."""
    batch = written(batch, "batch")

    def change(t: Transaction) -> dict[str, int]:
        old = t.read("companies", like=batch)
        t.change("companies", batch, lambda rows, new: entity.upsert_companies(rows, new)[0])
        return entity.upsert_companies(old, batch)[1].first().asDict()

    return store.run(change)


def add_discovered(store: Store, found: DataFrame) -> DataFrame:
    """M3: (job_id, skipped). Companies are upserted and results added in one
    commit. found: job_id, company_id (a domain), name, website, rank, ordinal."""
    found = written(found, "found")
    once = entity.first_by_domain(found.withColumn("domain", F.col("company_id")), "job_id", "ordinal")

    def change(t: Transaction) -> DataFrame:
        t.change("companies", once.select("domain", "name", "website"), lambda rows, new: entity.upsert_companies(rows, new)[0])
        old = t.read("results", like=found)
        new, skipped = entity.add_discovered(old, found)
        t.change("results", found, lambda rows, _: rows.unionByName(new.select(rows.columns)))
        return skipped

    return store.run(change)


def save_profiles(store: Store, batch: DataFrame) -> DataFrame:
    """M4: for each row of the batch the stored row of its content, made now or
    there before; of two writers of one content both get the same row."""
    batch = written(batch, "batch")
    same = ["company_id", "content_hash"]

    def change(t: Transaction) -> DataFrame:
        t.change("profiles", batch, lambda rows, new: rows.unionByName(entity.save_profiles(rows, new).select(rows.columns)))
        return t.read("profiles", like=batch).join(batch.select(same).distinct(), same, "left_semi")

    return store.run(change)


def replace_signals(store: Store, batch: DataFrame) -> list[int]:
    """M5; the buckets that changed."""
    batch = written(batch, "batch")
    return store.run(lambda t: t.change("signals", batch, entity.replace_signals))


def save_searches(store: Store, batch: DataFrame) -> list[int]:
    """M6; the buckets that were looked at."""
    batch = written(batch, "batch")
    return store.run(lambda t: t.change("saved_searches", batch, lambda rows, new: entity.insert_missing(rows, new, KEYS["saved_searches"])))


def upsert_schedules(store: Store, batch: DataFrame, now: str) -> list[int]:
    """M7; the buckets that changed."""
    batch = written(batch, "batch")
    return store.run(lambda t: t.change("schedules", batch, lambda rows, new: entity.upsert_schedules(rows, new, now)))


def fail_jobs(store: Store, stale: Column, message: str) -> list[int]:
    """M8; the buckets that have stale jobs."""

    def change(t: Transaction) -> list[int]:
        keys = t.read("jobs").where(stale).select("job_id")
        return t.change("jobs", keys, lambda rows, _: entity.fail_jobs(rows, stale, message))

    return store.run(change)


def delete_companies(store: Store, gone: DataFrame) -> DataFrame:
    """M9: (domain) of those that were not found or have a recipient; of the
    others the results go with the company, in one commit. gone: domain."""
    gone = written(gone.distinct(), "gone")

    def change(t: Transaction) -> DataFrame:
        held = t.read("recipients", like=gone.withColumnRenamed("domain", "company_id"))
        there = t.read("companies", like=gone)
        free = written(gone.join(held.select(F.col("company_id").alias("domain")), "domain", "left_anti").join(there, "domain", "left_semi"), "free")
        named = F.col("company_id") == F.col("domain")
        theirs = written(t.read("results").join(free, named, "left_semi").select("job_id").distinct(), "jobs-of-deleted")
        t.change("results", theirs, lambda rows, _: rows.join(free, named, "left_anti"))
        t.change("companies", free, lambda rows, new: rows.join(new, "domain", "left_anti"))
        return gone.join(free, "domain", "left_anti")

    return store.run(change)
