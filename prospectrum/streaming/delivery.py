"""Delivery events: decoding, the monotone status fold, windows, schedules.

Each operator has a batch form on tables; the fold and the rate limiter have
a keyed stateful form for streams too. Order is arrival order, given by a
sequence column; there is no watermark, as no event is ever too late.
"""

from __future__ import annotations

import hashlib
import hmac
from base64 import b64decode, b64encode
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from prospectrum.constants import PROVIDER_EVENTS, SEND_RATE_PER_MINUTE, STATUS_RANK
from prospectrum.streaming.machines import batch_sink


def rank_of(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in STATUS_RANK.items() for x in pair])[status]


def provider_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVIDER_EVENTS, "provider string, event_type string, status string, field string")


def decode_email(raw: DataFrame, body: str = "body") -> DataFrame:
    """(provider, provider_id, event_type, occurred_at) of e-mail callbacks."""
    x = F.from_json(body, "type string, data struct<email_id:string, created_at:string>")
    return raw.select(F.lit("email").alias("provider"), x["data"]["email_id"].alias("provider_id"), x["type"].alias("event_type"), F.try_to_timestamp(x["data"]["created_at"]).alias("occurred_at"), *raw.columns)


def decode_whatsapp(raw: DataFrame, body: str = "body") -> DataFrame:
    """Nested entries, changes and statuses, a row each."""
    x = F.from_json(body, "entry array<struct<changes:array<struct<value:struct<statuses:array<struct<id:string,status:string,timestamp:string>>>>>>>")
    entries = raw.select(*raw.columns, F.explode(x["entry"]).alias("e")).select(*raw.columns, F.explode("e.changes").alias("c"))
    each = entries.select(*raw.columns, F.explode("c.value.statuses").alias("s"))
    return each.select(F.lit("whatsapp").alias("provider"), F.col("s.id").alias("provider_id"), F.col("s.status").alias("event_type"), F.timestamp_seconds(F.col("s.timestamp").cast("long")).alias("occurred_at"), *raw.columns)


def decode_linkedin(raw: DataFrame, body: str = "body") -> DataFrame:
    """Message id or id, event or status."""
    x = F.from_json(body, "event string, data struct<message_id:string, id:string, status:string, timestamp:string>")
    d = x["data"]
    return raw.select(F.lit("linkedin").alias("provider"), F.coalesce(d["message_id"], d["id"]).alias("provider_id"), F.coalesce(x["event"], d["status"], F.lit("unknown")).alias("event_type"), F.try_to_timestamp(d["timestamp"]).alias("occurred_at"), *raw.columns)


def known_events(decoded: DataFrame) -> DataFrame:
    """Unknown types and missing ids go; the rest get state and time field."""
    kinds = F.broadcast(provider_events(decoded.sparkSession))  # a fixed table of 15 rows
    return decoded.where(F.coalesce("provider_id", F.lit("")) != "").join(kinds, ["provider", "event_type"])


def is_authentic(secret: str, scheme: str) -> Callable[..., Column]:
    """HMAC-SHA256 over the body. Schemes: 'svix' (base64 in a 'v1,' list
    over id.timestamp.body), 'hex', and 'sha256=' before hex."""

    @F.pandas_udf("boolean")
    def check(body: pd.Series, signature: pd.Series, message_id: pd.Series, timestamp: pd.Series) -> pd.Series:
        def one(b: str | None, s: str | None, i: str | None, t: str | None) -> bool:
            if b is None or s is None:
                return False
            if scheme == "svix":
                key = b64decode(secret.removeprefix("whsec_"))
                expected = b64encode(hmac.new(key, f"{i}.{t}.{b}".encode(), hashlib.sha256).digest()).decode()
                return any(hmac.compare_digest(p[3:], expected) for p in s.split(" ") if p.startswith("v1,"))
            expected = ("sha256=" if scheme == "sha256=" else "") + hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest()
            return hmac.compare_digest(s, expected)

        return pd.Series([one(*x) for x in zip(body, signature, message_id, timestamp, strict=True)])

    return check


def fold_status(events: DataFrame, recipients: DataFrame | None = None, key: str = "recipient_id", order: str = "event_id") -> DataFrame:
    """Events with ``applied``: the rank is above every earlier one's and
    the recipient's own. recipients: (key, status); without it all are PENDING.
    Events of unknown recipients go (T3); all others are returned (T2)."""
    if recipients is not None:
        events = events.join(recipients.select(key, F.col("status").alias("initial")), key)
    else:
        events = events.withColumn("initial", F.lit("PENDING"))
    ranked = events.withColumn("rank", rank_of(F.col("status")))
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.greatest(F.coalesce(rank_of(F.col("initial")), F.lit(0)), F.coalesce(F.max("rank").over(before), F.lit(0)))
    return ranked.withColumn("applied", F.col("rank") > so_far).drop("rank", "initial")


def final_status(events: DataFrame, key: str = "recipient_id", order: str = "event_id") -> DataFrame:
    """T1 in closed form: the earliest event of the greatest rank above PENDING.
    An aggregation, so that a hot recipient is combined before the shuffle."""
    ranked = events.withColumn("rank", rank_of(F.col("status"))).where("rank > 0")
    best = F.max_by(F.struct("status", "occurred_at"), F.struct("rank", (-F.col(order)).alias("o")))
    return ranked.groupBy(key).agg(best.alias("x")).select(key, F.col("x.status").alias("status"), F.col("x.occurred_at").alias("since"))


class StatusFold(StatefulProcessor):
    """T1 on a stream: the greatest rank so far is a recipient's state; it
    starts from the rank that the recipient had when it was first met."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rank = handle.getValueState("rank", "rank int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("event_id")  # one micro-batch of one recipient
        most = self.rank.get()[0] if self.rank.exists() else STATUS_RANK.get(batch.initial.iloc[0], 0)
        applied = []
        for status in batch.status:
            rank = STATUS_RANK.get(status)
            applied.append(None if rank is None else rank > most)
            most = max(most, rank or 0)
        self.rank.update((most,))
        yield pd.DataFrame({"recipient_id": key[0], "event_id": batch.event_id, "status": batch.status, "applied": pd.Series(applied, batch.index, dtype="boolean")})

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, recipients: DataFrame | None = None) -> DataFrame:
    """The stream of events with ``applied``, as ``fold_status`` has
    it; needs the RocksDB state store.

    recipients: a table of (recipient_id, status), read anew for each
    micro-batch: events of others go, and a recipient's status counts when its
    first event comes. An unknown or null status is never applied (null) and
    changes nothing; ``odd_events`` has these for themselves.
    """
    if recipients is None:
        events = events.withColumn("initial", F.lit("PENDING"))
    else:
        events = events.join(recipients.select("recipient_id", F.col("status").alias("initial")), "recipient_id")
    return events.groupBy("recipient_id").transformWithStateInPandas(
        StatusFold(), "recipient_id long, event_id long, status string, applied boolean", outputMode="Append", timeMode="None"
    )


def odd_events(events: DataFrame) -> DataFrame:
    """Events with an unknown or null status, of a table or a stream."""
    return events.where(~F.coalesce(F.col("status").isin(list(STATUS_RANK)), F.lit(False)))


def limited(requests: DataFrame, most: int, window_ms: int, key: str = "key", at: str = "at_ms", order: str = "request_id") -> DataFrame:
    """T4: (key, order, at, allowed, remaining, reset_at_ms,
    retry_after_seconds). A window opens with a key's first request and reopens
    with the first one after it ends.

    A request without a time is not counted: its results are null.

    Rows stream past in key and arrival order; two numbers are held for a key,
    and the end of each window is found by binary search in a batch's times.
    """
    kind = lambda c: requests.schema[c].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened, used = object(), 0, 0
        for batch in batches:
            keys, times = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            place, starts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for i, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                while i < end:
                    if keys[i] != now or times[i] - opened >= window_ms:
                        now, opened, used = keys[i], int(times[i]), 0
                    until = i + int(np.searchsorted(times[i:end], opened + window_ms))
                    place[i:until], starts[i:until] = used + np.arange(until - i), opened
                    used, i = used + until - i, until
            allowed, reset = place < most, starts + window_ms
            wait = np.where(allowed, 0, np.maximum(1, -(-(reset - times) // 1000)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed), pa.array(np.maximum(most - place - 1, 0).astype(np.int32)), pa.array(reset), pa.array(wait)], names=[key, order, at, "allowed", "remaining", "reset_at_ms", "retry_after_seconds"])

    timed = F.col(at).isNotNull()
    dealt = requests.where(timed).select(key, order, at).repartition(key).sortWithinPartitions(key, at, order)
    results = "allowed boolean, remaining int, reset_at_ms long, retry_after_seconds long"
    counted = dealt.mapInArrow(scan, f"{key} {kind(key)}, {order} {kind(order)}, {at} {kind(at)}, {results}")
    return counted.unionByName(_untimed(requests.where(~timed).select(key, order, at), results))


def _untimed(requests: DataFrame, results: str) -> DataFrame:
    kinds = [x.split() for x in results.split(", ")]
    return requests.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in kinds])


class RateWindow(StatefulProcessor):
    """T4 on a stream: when a key's window opened and how much of it is used."""

    def __init__(self, most: int, window_ms: int):
        self.most, self.window_ms = most, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "opened long, used int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened, used = self.window.get() if self.window.exists() else (None, 0)
        batch = pd.concat(list(rows)).sort_values(["at_ms", "request_id"])  # one micro-batch of one key
        allowed, remaining, reset = [], [], []
        for at in batch.at_ms.tolist():
            if opened is None or at - opened >= self.window_ms:
                opened, used = at, 0
            allowed.append(used < self.most)
            used += allowed[-1]
            remaining.append(self.most - used)
            reset.append(opened + self.window_ms)
        self.window.update((opened, used))
        wait = np.where(allowed, 0, np.maximum(1, -(-(np.array(reset) - batch.at_ms) // 1000)))
        yield pd.DataFrame({"key": key[0], "request_id": batch.request_id, "at_ms": batch.at_ms, "allowed": allowed, "remaining": remaining, "reset_at_ms": reset, "retry_after_seconds": wait})

    def close(self) -> None:
        pass


def limit_stream(requests: DataFrame, most: int, window_ms: int) -> DataFrame:
    """T4 on a stream of (key string, request_id, at_ms); needs the RocksDB state store."""
    results = "allowed boolean, remaining int, reset_at_ms long, retry_after_seconds long"
    timed = requests.where("at_ms is not null").groupBy("key").transformWithStateInPandas(
        RateWindow(most, window_ms), f"key string, request_id long, at_ms long, {results}", outputMode="Append", timeMode="None"
    )
    return timed.unionByName(_untimed(requests.where("at_ms is null").select("key", "request_id", "at_ms"), results))


def due(rows: DataFrame, when: str, now: str, order: list[Column], most: int, test: Column | None = None) -> DataFrame:
    """What is due by now, in order, a batch at most."""
    ready = rows.where(F.col(when) <= F.lit(now))
    return (ready if test is None else ready.where(test)).orderBy(*order).limit(most)


def rescheduled(schedules: DataFrame, succeeded: Column, now: str) -> DataFrame:
    """The next run moves by the interval, on success only."""
    return schedules.withColumn("next_run", F.when(succeeded, F.date_add(F.lit(now).cast("date"), F.col("interval_days"))).otherwise(F.col("next_run")))


def started(campaigns: DataFrame, when: str, now: str, channels: list[str], waiting: str = "SCHEDULED") -> DataFrame:
    """Due campaigns run, if their channel is configured."""
    ready = (F.col("status") == waiting) & (F.col(when) <= F.lit(now)) & F.col("channel").isin(channels)
    return campaigns.withColumn("status", F.when(ready, "RUNNING").otherwise(F.col("status")))


def send_times(recipients: DataFrame, channel: str = "channel", by: str = "campaign_id", order: str = "line") -> DataFrame:
    """The delay in ms at which each pending message of a campaign goes."""
    rates = F.create_map(*[F.lit(x) for pair in SEND_RATE_PER_MINUTE.items() for x in pair])
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return recipients.where("status = 'PENDING'").withColumn("delay_ms", (place * F.ceil(F.lit(60000) / rates[F.col(channel)])).cast("long"))


def by_channel(senders: dict[str, Callable[[dict], str]], channel: str = "channel") -> Callable[[dict], str]:
    """One sender out of one for each channel; any other channel is an error."""

    def send(row: dict) -> str:
        if row[channel] not in senders:
            raise ValueError(f"unsupported outreach channel: {row[channel]}")
        return senders[row[channel]](row)

    return send


def deliver(stream: DataFrame, send: Callable[[dict], str], checkpoint: str, key: str = "id"):
    """Hands each row of a micro-batch to ``send`` (see ``by_channel``) on
    the executors and keeps what it returns, once for each message, whatever is
    retried (``machines.batch_sink``). A run that is lost between a send and its commit
    sends again, so ``send`` should take the key for an idempotency key."""
    return stream.writeStream.foreachBatch(batch_sink(send, f"{checkpoint}/sent", key)).option("checkpointLocation", f"{checkpoint}/state")
