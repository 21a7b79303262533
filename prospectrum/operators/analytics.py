"""Campaign, search and intent analytics: one aggregation for each grain."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectrum.constants import (
    ACTIVE_CAMPAIGN,
    CHANNEL_LABEL,
    CHANNELS,
    CRAWLED_STAGES,
    EXTRACTED_STAGES,
    FAILED_STAGES,
    HALF_LIFE_DAYS,
    SIGNAL_WEIGHT,
    TERMINAL_STATUS,
)

MEASURES = {
    "sent": ["SENT", "DELIVERED", "OPENED", "CLICKED", "REPLIED"],
    "delivered": ["DELIVERED", "OPENED", "CLICKED", "REPLIED"],
    "opened": ["OPENED", "CLICKED", "REPLIED"],
    "clicked": ["CLICKED", "REPLIED"],
    "replied": ["REPLIED"],
    "bounced": ["BOUNCED"],
    "failed": ["FAILED"],
}
RATES = {
    "sent_rate": ("sent", "total"),
    "delivered_rate": ("delivered", "sent"),
    "open_rate": ("opened", "delivered"),
    "click_rate": ("clicked", "opened"),
    "reply_rate": ("replied", "delivered"),
    "bounce_rate": ("bounced", "sent"),
}


def rate(numerator: str, denominator: str) -> Column:
    """A5: a percentage to one place; 0 of nothing. It may exceed 100."""
    return F.when(F.col(denominator) == 0, 0.0).otherwise(F.round(F.col(numerator) / F.col(denominator) * 100, 1))


def funnel(recipients: DataFrame, *by: str, status: str = "status") -> DataFrame:
    """A4, A5: counts and rates of recipients for each group.

    A null status (a group without recipients) counts nowhere.
    """
    counts = [F.count(F.col(status)).alias("total"), *[F.count_if(F.col(status).isin(s)).alias(n) for n, s in MEASURES.items()]]
    return recipients.groupBy(*by).agg(*counts).withColumns({n: rate(*x) for n, x in RATES.items()})


def visible_campaigns(campaigns: DataFrame, role: str, user_id: int, organization_id: int) -> DataFrame:
    """A sales representative sees their own, others the organization's."""
    return campaigns.where(F.col("user_id") == user_id if role == "SALES_REP" else F.col("organization_id") == organization_id)


def created_between(rows: DataFrame, start: str | None, end: str | None, column: str = "created_on") -> DataFrame:
    """Both ends inclusive, either open."""
    for value, test in ((start, F.col(column) >= F.lit(start)), (end, F.col(column) <= F.lit(end))):
        if value is not None:
            rows = rows.where(test)
    return rows


def campaign_recipients(campaigns: DataFrame, recipients: DataFrame) -> DataFrame:
    """Each campaign with its recipients' states; null where there are none."""
    return campaigns.join(recipients.select("campaign_id", F.col("status").alias("recipient_status")), "campaign_id", "left")


def campaign_details(asked: DataFrame, campaigns: DataFrame, recipients: DataFrame) -> DataFrame:
    """The funnel of single campaigns, each behind its guard. asked: request
    (any key), campaign_id, role, user_id, organization_id. outcome is ok, not
    found, or forbidden: a sales representative sees their own campaigns,
    others their organization's. Only ok has numbers."""
    own = campaigns.select("campaign_id", "name", "channel", F.col("user_id").alias("__user"), F.col("organization_id").alias("__organization"))
    met = asked.join(own, "campaign_id", "left")
    may = F.when(F.col("role") == "SALES_REP", F.col("__user") == F.col("user_id")).otherwise(F.col("__organization") == F.col("organization_id"))
    outcome = F.when(F.col("name").isNull(), "not found").when(may, "ok").otherwise("forbidden")
    judged = met.withColumn("outcome", outcome)
    granted = judged.where("outcome = 'ok'").select("campaign_id").distinct()
    counts = funnel(recipients.join(granted, "campaign_id", "left_semi"), "campaign_id")
    numbers = ["total", *MEASURES, *RATES]
    shown = lambda c: F.when(F.col("outcome") == "ok", F.coalesce(F.col(c), F.lit(0))).alias(c)
    named = [F.when(F.col("outcome") == "ok", F.col(c)).alias(c) for c in ("name", "channel")]
    return judged.join(counts, "campaign_id", "left").select("request", "campaign_id", "outcome", *named, *map(shown, numbers))


def funnel_by_channel(campaigns: DataFrame, recipients: DataFrame) -> DataFrame:
    """A row for each channel, zero-filled, with its label and campaigns."""
    spark = campaigns.sparkSession
    channels = spark.createDataFrame([(i, c, CHANNEL_LABEL[c]) for i, c in enumerate(CHANNELS)], "position int, channel string, label string")
    counts = funnel(campaign_recipients(campaigns, recipients), "channel", status="recipient_status")
    n = campaigns.groupBy("channel").agg(F.count("*").alias("campaign_count"))
    joined = channels.join(counts, "channel", "left").join(n, "channel", "left")
    numbers = ["total", *MEASURES, *RATES, "campaign_count"]
    return joined.select("position", "channel", "label", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])


def funnel_levels(campaigns: DataFrame, recipients: DataFrame) -> DataFrame:
    """Total, by channel and by campaign, as grouping sets in one pass."""
    rows = campaign_recipients(campaigns, recipients)
    counts = ", ".join(["count(recipient_status) AS total"] + [f"count_if(recipient_status IN ({', '.join(map(repr, s))})) AS {n}" for n, s in MEASURES.items()])
    sets = campaigns.sparkSession.sql(
        f"SELECT CASE WHEN grouping(campaign_id) = 0 THEN 'campaign' WHEN grouping(channel) = 0 THEN 'channel' ELSE 'total' END AS level, channel, campaign_id, {counts} "
        "FROM {rows} GROUP BY GROUPING SETS ((channel), (campaign_id), ())",
        rows=rows,
    )
    return sets.withColumns({n: rate(*x) for n, x in RATES.items()})


def campaign_cards(recipients: DataFrame) -> DataFrame:
    """The four numbers of a campaign's cards."""
    s = F.col("recipient_status")
    fourth = F.when(F.col("channel") == "EMAIL", F.count_if(s == "CLICKED")).otherwise(F.count_if(s == "REPLIED"))
    label = F.when(F.col("channel") == "WHATSAPP", "Read").otherwise("Opened")
    return recipients.groupBy("campaign_id", "channel").agg(
        F.count(s).alias("recipients"), F.count_if(s.isin(MEASURES["sent"])).alias("sent"), F.count_if(s.isin(MEASURES["opened"])).alias("engaged"),
        label.alias("engaged_label"), fourth.alias("clicked_or_replied"),
    )


def search_summary(results: DataFrame, *by: str) -> DataFrame:
    """Nested stage counts of a search."""
    stage = F.col("stage")
    sets = {"crawled": CRAWLED_STAGES, "extracted": EXTRACTED_STAGES, "enriched": ["ENRICHED"], "failed": FAILED_STAGES}
    return results.groupBy(*by).agg(F.count("*").alias("discovered"), *[F.count_if(stage.isin(s)).alias(n) for n, s in sets.items()])


def job_outcome(summary: DataFrame, limit: str = "company_limit", removed: str = "removed") -> DataFrame:
    """Final state and message from a search's counts."""
    enriched, target, gone = F.col("enriched"), F.col(limit), F.col(removed)
    short = F.when(enriched < target, F.concat(F.lit("Only "), enriched.cast("string"), F.lit(" of "), target.cast("string"), F.lit(" target leads were enriched; no more matching companies could be found.")))
    excluded = F.when(gone > 0, F.concat(gone.cast("string"), F.when(gone == 1, F.lit(" company")).otherwise(" companies"), F.lit(" could not be enriched and were excluded from results")))
    text = F.concat_ws(" ", short, excluded)
    message = F.when(enriched == 0, "No leads were fully processed").when(text != "", text)
    return summary.withColumns({"final_status": F.when(enriched > 0, "COMPLETED").otherwise("FAILED"), "message": message})


def failures(results: DataFrame) -> DataFrame:
    """Failed stages and non-empty errors, with a message."""
    error = F.col("stage_error")
    failed = F.col("stage").isin(FAILED_STAGES) | (F.coalesce(error, F.lit("")) != "")
    return results.where(failed).withColumn("message", F.coalesce(error, F.concat(F.lit("Stage failed: "), "stage")))


def outreach_status(searches: DataFrame, recipients: DataFrame, key: str) -> DataFrame:
    """A10: NOT_STARTED, IN_PROGRESS or COMPLETED for each search.

    recipients: key, status, campaign_status.
    """
    state = recipients.groupBy(key).agg(
        F.bool_and(F.col("status").isin(TERMINAL_STATUS)).alias("ended"), F.bool_or(F.col("campaign_status").isin(ACTIVE_CAMPAIGN)).alias("active")
    )
    status = F.when(F.col("ended").isNull(), "NOT_STARTED").when(F.col("ended") & ~F.col("active"), "COMPLETED").otherwise("IN_PROGRESS")
    return searches.join(state, key, "left").withColumn("outreach_status", status).drop("ended", "active")


@F.pandas_udf(T.DoubleType())
def _three_places(x: pd.Series) -> pd.Series:
    """Rounds the exact binary value half up to three places."""
    unit = Decimal("0.001")
    return x.map(lambda v: float(Decimal(v).quantize(unit, ROUND_HALF_UP)), na_action="ignore")


def intent_scores(signals: DataFrame, now: str, *by: str, places: bool = True) -> DataFrame:
    """Recency-decayed weighted mean of confidence, at most 1.

    The denominator holds the weights without decay. ``places`` rounds as
    toFixed(3) does; without it the mean is left as it is.
    """
    weight = F.create_map(*[F.lit(x) for pair in SIGNAL_WEIGHT.items() for x in pair])[F.col("type")]
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("detected_at").cast("timestamp"))) / 86_400_000_000)
    mean = F.sum(weight * F.col("confidence") * F.pow(F.lit(0.5), age / HALF_LIFE_DAYS)) / F.sum(weight)
    scored = signals.groupBy(*by).agg(mean.alias("mean"), F.count("*").alias("n_signals"))
    score = _three_places("mean") if places else F.col("mean")
    return scored.withColumn("score", F.least(F.lit(1.0), score)).drop("mean")


def campaign_final_status(sends: DataFrame, *by: str) -> DataFrame:
    """FAILED only if something failed and nothing was sent."""
    sent, failed = F.count_if(F.col("outcome") == "sent"), F.count_if(F.col("outcome") == "failed")
    return sends.groupBy(*by).agg(F.when((failed > 0) & (sent == 0), "FAILED").otherwise("COMPLETED").alias("final_status"))


def crawl_status(pages: DataFrame, *by: str) -> DataFrame:
    """Pages that came with text, and success, partial or failed."""
    ok = F.count_if(F.col("error").isNull() & (F.length("content_text") > 0))
    status = F.when(ok == 0, "failed").when(ok == F.count("*"), "success").otherwise("partial")
    return pages.groupBy(*by).agg(F.count("*").alias("attempted"), ok.alias("succeeded"), status.alias("status"))


def outcome_totals(results: DataFrame, *by: str) -> DataFrame:
    """Sums of the leads' outcomes and the failures that they report.

    A lead that failed counts as removed, and then neither as crawled nor as
    extracted, whatever was done to it before.
    """
    stage, error = F.col("stage"), F.coalesce("stage_error", F.lit(""))
    through = lambda stages: F.count_if(stage.isin([s for s in stages if s not in FAILED_STAGES]))
    said = F.collect_set(F.when(error != "", F.concat_ws(":", F.col("company_id").cast("string"), error)))
    return results.groupBy(*by).agg(through(CRAWLED_STAGES).alias("crawled"), through(EXTRACTED_STAGES).alias("extracted"), through(["ENRICHED"]).alias("enriched"), F.count_if(stage.isin(FAILED_STAGES)).alias("removed"), F.sort_array(said).alias("failures"))


def channel_label(channel: Column | str) -> Column:
    """the channel's name; an unknown one stays."""
    names = F.create_map(*[F.lit(x) for pair in CHANNEL_LABEL.items() for x in pair])
    return F.coalesce(names[F.col(channel)], F.col(channel))


def engagement_label(channel: Column | str) -> Column:
    """what an opened message is called."""
    return F.when(F.col(channel) == "WHATSAPP", "Read").otherwise("Opened")
