"""A search from discovery to enriched leads, for many jobs at once.

The driver runs rounds; each round is a few set operations over the jobs that
still want companies, and its tables are written, once, so a lost executor
costs a re-read and no round pays for those before it. Outside
answers come from ports. Jobs with a limit ask for what they lack, at most
three times the limit in all; jobs without one ask until a round adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospectrum.functions import profiles
from prospectrum.functions.urls import is_blocked_domain, site
from prospectrum.operators.analytics import job_outcome
from prospectrum.sources.ports import answered
from prospectrum.sources.tables import written

# Rounds, attempts for each wanted lead, least completeness.
TARGET_ROUNDS, OPEN_ROUNDS, ATTEMPTS_PER_LEAD, MIN_COMPLETENESS = 10, 5, 3, 0.35

RESULT = "job_id long, company_id string, name string, website string, rank long, stage string, stage_error string, profile string, completeness double"


@dataclass(frozen=True)
class Ports:
    """discover: job row (query, criteria, wanted, excluded) to a list of
    {companyName, website, confidence}; enrich: a result row to a profile's
    fields (an error or None is a failure); stop: asked with each result row
    before its turn, whether its job has been cancelled."""

    discover: Callable[[dict], list[dict]]
    enrich: Callable[[dict], dict | None]
    stop: Callable[[dict], bool] | None = None


def requests(jobs: DataFrame, limited: bool) -> DataFrame:
    """The jobs with what they have so far: nothing."""
    return wanting(jobs.select("job_id", "query", "criteria", F.col("company_limit").cast("long").alias("company_limit"), *[F.lit(0).cast("long").alias(c) for c in ("enriched", "tried", "greatest")], F.array().cast("array<string>").alias("excluded")), limited)


def wanting(x: DataFrame, limited: bool) -> DataFrame:
    """The jobs that still want companies, and how many."""
    if not limited:
        return x.withColumns({c: F.lit(None).cast("long") for c in ("wanted", "deficit")})
    deficit = F.greatest(F.lit(0), F.col("company_limit") - F.col("enriched"))
    wanted = F.least(deficit, F.col("company_limit") * ATTEMPTS_PER_LEAD - F.col("tried"))
    return x.withColumns({"wanted": wanted.cast("long"), "deficit": deficit.cast("long")}).where("wanted > 0")


def continued(asked: DataFrame, found: DataFrame, results: DataFrame, limited: bool) -> DataFrame:
    """The requests of the next round: those of this one with what it brought.

    A job that is not asked in a round, or to which a round adds nothing, is
    never asked again: what it has tried only grows and its deficit only
    shrinks. So a request holds all that a later round needs of its job, and no
    round reads the results of the rounds before it again for that."""
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("stage", "string"), ("website", "string"), ("rank", "long"))]
    each = results.select("job_id", "stage", "website", "rank").unionByName(found.where("known").select("job_id", *nothing))
    brought = each.groupBy("job_id").agg(F.count("*").alias("__given"), F.count_if(F.col("stage") == "ENRICHED").alias("__enriched"), F.max("rank").alias("__rank"), F.collect_set("website").alias("__sites"))
    more = asked.join(brought.where("__rank IS NOT NULL"), "job_id")
    now = {"enriched": F.col("enriched") + F.col("__enriched"), "tried": F.col("tried") + F.col("__given"), "greatest": F.greatest("greatest", "__rank"), "excluded": F.array_sort(F.array_union("excluded", "__sites"))}
    return wanting(more.withColumns(now).select(asked.columns).drop("wanted", "deficit"), limited)


def discovered(asked: DataFrame, ports: Ports, earlier: DataFrame | None = None) -> DataFrame:
    """Candidates of each job, one for each domain, best first.
    known: the job has the company already (earlier: job_id, company_id); n: the
    place of a new one among the job's new ones."""
    shown = ["job_id", "query", "criteria", "wanted", "excluded"]
    carried = ["job_id", "wanted", "deficit", "greatest"]
    found = answered(asked.select(*shown[:4], F.array_join("excluded", "\n").alias("excluded"), *carried[2:]), lambda row: ports.discover({c: row[c] for c in shown}))
    each = found.select(*carried, F.posexplode(F.from_json("answer", "array<struct<companyName:string,website:string,confidence:double>>")).alias("ordinal", "x"))
    sites = each.select(*carried, "ordinal", F.col("x.companyName").alias("name"), F.coalesce("x.confidence", F.lit(0.0)).alias("confidence"), site("x.website").alias("s"))
    usable = sites.select(*carried, "ordinal", "name", "confidence", F.col("s.website").alias("website"), F.col("s.site_domain").alias("company_id")).where(F.col("company_id").isNotNull() & ~is_blocked_domain("company_id"))
    # Dealt by job once, which serves every window of a job's rows.
    once = usable.repartition("job_id").withColumn("n", F.row_number().over(Window.partitionBy("job_id", "company_id").orderBy(F.desc("confidence"), "ordinal"))).where("n = 1")
    placed = once.withColumn("n", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("confidence"), "ordinal"))).where("wanted IS NULL OR n <= wanted")
    ranked = placed.select("job_id", "deficit", "company_id", "name", "website", (F.col("greatest") + F.col("n")).alias("rank"), "n")
    if earlier is None:
        return ranked.withColumn("known", F.lit(False))
    marked = ranked.join(earlier.withColumn("__known", F.lit(True)), ["job_id", "company_id"], "left").withColumn("known", F.coalesce("__known", F.lit(False))).drop("__known")
    return marked.withColumn("n", F.row_number().over(Window.partitionBy("job_id", "known").orderBy("rank")))


def enriched(leads: DataFrame, ports: Ports, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage that each lead ends in. One whose job is cancelled when its
    turn comes (``ports.stop``) is left as it was discovered."""

    def enrich(row: dict) -> object:
        if ports.stop is not None and ports.stop(row):
            return {"__stopped": True}
        return ports.enrich(row)

    asked = answered(leads, enrich)
    stopped = F.coalesce(F.get_json_object("answer", "$.__stopped") == "true", F.lit(False))
    return judge(asked.withColumn("started", ~stopped))


def judging(min_completeness: float = MIN_COMPLETENESS) -> Callable[[DataFrame], DataFrame]:
    """leads with the port's answer and the stage it ends in. No
    contact: the company goes (REMOVED_COMPANY); too thin a profile: the result
    goes (REMOVED); not started: DISCOVERED. The expressions are long and made
    once for all rounds."""
    p = F.col("p")
    profile = profiles.sanitized(profiles.whole(profiles.parsed(F.col("answer"))))
    failed = F.col("error").isNotNull() | F.coalesce(F.col("answer") == "null", F.lit(True))
    score, reachable = profiles.completeness(p), profiles.has_any_contact(p)
    stage = F.when(~F.col("started"), "DISCOVERED").when(failed, "ENRICH_FAILED").when(~reachable, "REMOVED_COMPANY").when(F.col("score") < min_completeness, "REMOVED").otherwise("ENRICHED")
    good = F.col("started") & ~failed
    error = F.when(F.col("started") & failed, F.coalesce("error", F.lit("no profile")))
    shown = [stage.alias("stage"), error.alias("stage_error"), F.when(F.col("started"), F.to_json(p)).alias("profile"), F.when(good, F.col("score")).alias("completeness")]
    return lambda leads: leads.withColumn("p", profile).withColumn("score", score).select("job_id", "company_id", "name", "website", "rank", *shown)


def judged(leads: DataFrame, min_completeness: float = MIN_COMPLETENESS) -> DataFrame:
    """``judging`` of one table of leads."""
    return judging(min_completeness)(leads)


def run_searches(jobs: DataFrame, ports: Ports, target_rounds: int = TARGET_ROUNDS, open_rounds: int = OPEN_ROUNDS, min_completeness: float = MIN_COMPLETENESS, cancelled: Callable[[], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, summaries). jobs: job_id, query, criteria, company_limit
    (null: no limit). Results are the leads that stay; summaries count all,
    with the final status and message of each job (A13, A16).

    cancelled: asked before each round; the jobs (job_id) that it names take no
    further part, keep what they have, and end CANCELLED."""
    spark = jobs.sparkSession
    every, judge = spark.createDataFrame([], RESULT), judging(min_completeness)
    stopped = spark.createDataFrame([], "job_id long")
    lead = ["job_id", "company_id", "name", "website", "rank"]
    unasked = [F.lit("DISCOVERED").alias("stage"), *[F.lit(None).cast(t).alias(c) for c, t in (("stage_error", "string"), ("profile", "string"), ("completeness", "double"))]]
    for limited, rounds in ((True, target_rounds), (False, open_rounds)):
        mine = jobs.where(F.col("company_limit").isNotNull() if limited else F.col("company_limit").isNull())
        asked, earlier = requests(mine, limited), None
        for _ in range(rounds):
            if cancelled is not None:
                stopped = written(cancelled().select(F.col("job_id").cast("long")).unionByName(stopped).distinct(), "cancelled")
                asked = asked.join(stopped, "job_id", "left_anti")
            asked = written(asked, "requests")
            if asked.isEmpty():
                break
            found = written(discovered(asked, ports, earlier), "found")
            new, now = found.where("NOT known"), F.col("deficit").isNull() | (F.col("n") <= F.col("deficit"))
            # Each round's results are a table of their own, written once.
            results = written(enriched(new.where(now).select(lead), ports, judge).unionByName(new.where(~now).select(*lead, *unasked)), "results")
            every = every.unionByName(results)
            earlier = results.select("job_id", "company_id") if earlier is None else earlier.unionByName(results.select("job_id", "company_id"))
            asked = continued(asked, found, results, limited)
    removed = F.col("stage").isin("REMOVED", "REMOVED_COMPANY")
    counts = every.groupBy("job_id").agg(F.count("*").alias("discovered"), F.count_if(F.col("stage") == "ENRICHED").alias("enriched"), F.count_if(removed).alias("removed"), F.count_if(F.col("stage") == "ENRICH_FAILED").alias("failed"))
    summaries = job_outcome(jobs.select("job_id", "company_limit").join(counts, "job_id", "left").fillna(0, ["discovered", "enriched", "removed", "failed"]))
    if cancelled is not None:
        ended = summaries.join(stopped.withColumn("__stopped", F.lit(True)), "job_id", "left")
        status, message = F.when(F.col("__stopped"), "CANCELLED").otherwise(F.col("final_status")), F.when(F.col("__stopped").isNull(), F.col("message"))
        summaries = ended.withColumns({"final_status": status, "message": message}).drop("__stopped")
    gone = every.where("stage = 'REMOVED_COMPANY'").select("company_id").distinct()
    return every.where(~removed).join(gone, "company_id", "left_anti").select(every.columns), summaries
