"""Keyed state machines on streams: paced sending, leads of a search, robots rules.

Each takes two kinds of input in one stream of tagged rows; the order of rows
of a key in a micro-batch is their ``seq``. All need the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from prospectrum.constants import SEND_RATE_PER_MINUTE

MINUTE_MS, RULES_MS = 60_000, 3_600_000
NO_PROFILE = "Company profile not found"


def _records(rows: Iterator[pd.DataFrame]) -> list[dict]:
    """The rows of one key in one micro-batch, by seq; nulls are None."""
    every = pd.concat(list(rows)).sort_values("seq", kind="stable")
    return every.astype(object).where(every.notna(), None).to_dict("records")


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)


SEND_INPUT = "campaign_id long, seq long, kind string, channel string, message_id long, address string, body string"
SENT = "campaign_id long, message_id long, channel string, address string, body string, outcome string, error string, at_ms long"


class PacedSend(StatefulProcessor):
    """A campaign's messages one after another, a channel's delay apart.

    A message waits in the state until the processing-time timer of its campaign; PAUSED takes
    the timer away before the next message, RUNNING starts it again. A message without an address
    (its company has no profile) fails at once and takes no time of the channel.
    Messages are held by place, so that one more takes the same work however many wait.
    """

    def __init__(self, rates: dict[str, float] | None = None):
        self.rates = rates or SEND_RATE_PER_MINUTE

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "place long", "message string")
        self.pace = handle.getValueState("pace", "first long, end long, next_ms long, paused boolean, timer_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, end, next_ms, paused, timer = self.pace.get() if self.pace.exists() else (0, 0, 0, False, None)
        for row in _records(rows):
            if row["kind"] == "message":
                self.waiting.updateValue((end,), (json.dumps([row["message_id"], row["channel"], row["address"], row["body"]]),))
                end += 1
            else:
                paused = row["kind"] == "PAUSED"
        yield from self._go(key, (first, end, next_ms, paused, timer), timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, end, next_ms, paused, timer = self.pace.get()
        expired = expiredTimerInfo.getExpiryTimeInMs()
        yield from self._go(key, (first, end, next_ms, paused, None if timer == expired else timer), timerValues.getCurrentProcessingTimeInMs())

    def _go(self, key, state: tuple, now: int) -> Iterator[pd.DataFrame]:
        """Sends what is due now and sets the timer of what comes next."""
        first, end, next_ms, paused, timer = state
        out = []
        while not paused and first < end and now >= next_ms:
            message_id, channel, address, body = json.loads(self.waiting.getValue((first,))[0])
            self.waiting.removeKey((first,))
            first += 1
            known = channel in self.rates
            error = NO_PROFILE if address is None else None if known else f"unsupported outreach channel: {channel}"
            out.append({"campaign_id": key[0], "message_id": message_id, "channel": channel, "address": address, "body": body, "outcome": "failed" if error else "due", "error": error, "at_ms": now})
            if not error:
                next_ms = now + int(-(-MINUTE_MS // max(1, self.rates[channel])))
        wanted = None if paused or first == end else next_ms
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.pace.update((first, end, next_ms, paused, wanted))
        if out:
            yield _frame(out, SENT)

    def close(self) -> None:
        pass


def paced(events: DataFrame, rates: dict[str, float] | None = None) -> DataFrame:
    """A stream of messages to send now (due) or that can't be (failed).

    events: ``SEND_INPUT``; kind is message, PAUSED or RUNNING. rates: messages
    a minute for each channel. A micro-batch sends one message of a campaign at most, so it
    should be triggered more often than messages are due.
    """
    return events.groupBy("campaign_id").transformWithStateInPandas(PacedSend(rates), SENT, outputMode="Append", timeMode="ProcessingTime")


LEAD_INPUT = "job_id long, seq long, kind string, company_id string, name string, website string, rank long"
LEAD = "job_id long, company_id string, name string, website string, rank long, answer string, error string, started boolean"


class LeadMachine(StatefulProcessor):
    """The leads of a job, one after another; a cancel signal leaves every
    lead after it untouched."""

    def __init__(self, enrich: Callable[[dict], object]):
        self.enrich = enrich

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cancelled = handle.getValueState("cancelled", "cancelled boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stopped, out = self.cancelled.exists(), []
        for row in _records(rows):
            if row["kind"] == "cancel":
                stopped = True
                self.cancelled.update((True,))
                continue
            lead = {c: row[c] for c in ("company_id", "name", "website", "rank")}
            answer = error = None
            if not stopped:
                try:
                    answer = json.dumps(self.enrich({"job_id": key[0]} | lead))
                except Exception as failure:
                    error = str(failure) or type(failure).__name__
            out.append({"job_id": key[0]} | lead | {"answer": answer, "error": error, "started": not stopped})
        if out:
            yield _frame(out, LEAD)

    def close(self) -> None:
        pass


def leads_enriched(events: DataFrame, enrich: Callable[[dict], object]) -> DataFrame:
    """A stream of leads with the port's answer, or started = false.

    events: ``LEAD_INPUT``; kind is lead or cancel. ``plans.search.judged``
    gives the stage that each answer ends in.
    """
    return events.groupBy("job_id").transformWithStateInPandas(LeadMachine(enrich), LEAD, outputMode="Append", timeMode="None")


ROBOTS_INPUT = "origin string, seq long, path string"
ROBOTS = "origin string, seq long, path string, allowed boolean"


def disallowed(rules: str, agent: str) -> list[str]:
    """path prefixes that the groups for * or the agent (lower case) forbid."""
    found, applies = [], False
    for line in rules.split("\n"):
        name, _, value = line.strip().partition(":")
        value = value.split(":")[0].strip()
        if name.lower() == "user-agent":
            applies = value == "*" or agent in value.lower()
        elif name.lower() == "disallow" and applies and value:
            found.append(value)
    return found


class RobotsCache:
    """rules by origin for an hour of ``clock``, in one process.

    fetch: an origin to (status, text). An answer that is no success forbids
    the path that asked and, for the hour, allows all others; a failure
    forbids and is asked again.
    """

    def __init__(self, fetch: Callable[[str], tuple[int, str]], agent: str, clock: Callable[[], float]):
        self.fetch, self.agent, self.clock = fetch, agent, clock
        self.known: dict[str, tuple[float, list[str]]] = {}

    def allows(self, origin: str, path: str) -> bool:
        now, (since, rules) = self.clock(), self.known.get(origin, (None, []))
        if since is None or now - since >= RULES_MS / 1000:
            good, rules = asked(self.fetch, origin, self.agent)
            if rules is None:
                return False
            self.known[origin] = now, rules
            if not good:
                return False
        return not any(path.startswith(p) for p in rules)


def asked(fetch: Callable[[str], tuple[int, str]], origin: str, agent: str) -> tuple[bool, list[str] | None]:
    """Whether the answer is a success, and its rules; None for a failure."""
    try:
        status, text = fetch(origin)
        return 200 <= status < 300, disallowed(text, agent) if 200 <= status < 300 else []
    except Exception:
        return False, None


class RobotsRules(StatefulProcessor):
    """F6 on a stream: an origin's rules are state that lives for an hour."""

    def __init__(self, fetch: Callable[[str], tuple[int, str]], agent: str):
        self.fetch, self.agent = fetch, agent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rules = handle.getValueState("rules", "prefixes string", RULES_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, rules = [], json.loads(self.rules.get()[0]) if self.rules.exists() else None
        for row in _records(rows):
            good = True
            if rules is None:
                good, rules = asked(self.fetch, key[0], self.agent)
                if rules is not None:
                    self.rules.update((json.dumps(rules),))
            out.append({"origin": key[0], "seq": row["seq"], "path": row["path"], "allowed": good and not any(row["path"].startswith(p) for p in rules or [])})
        yield _frame(out, ROBOTS)

    def close(self) -> None:
        pass


def robots_stream(requests: DataFrame, fetch: Callable[[str], tuple[int, str]], agent: str) -> DataFrame:
    """a stream of requests (``ROBOTS_INPUT``) with ``allowed``."""
    return requests.groupBy("origin").transformWithStateInPandas(RobotsRules(fetch, agent), ROBOTS, outputMode="Append", timeMode="ProcessingTime")


def batch_sink(send: Callable[[dict], str], out: str, key: str = "message_id") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that hands each row to ``send`` on the
    executors and keeps the outcome (sent or failed, provider_id, error), as A15 takes it.

    A micro-batch has a folder of its own, which counts once its job has
    committed. One that comes again after that is left as it is; one that did
    not get so far is written anew, without the messages that earlier batches
    hold. A message that comes twice in a batch is sent once.
    """

    def sink(rows: DataFrame, batch_id: int) -> None:
        spark, path = rows.sparkSession, f"{out}/batch_id={batch_id}"
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        files = mark.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(mark):
            return
        once = rows.dropDuplicates([key])
        if files.exists(mark.getParent().getParent()):
            before = spark.read.schema(f"{key} {rows.schema[key].dataType.simpleString()}, batch_id long").parquet(out)
            once = once.join(before.where(F.col("batch_id") < batch_id).select(key), key, "left_anti")
        names = [c for c in rows.columns if c not in ("outcome", "provider_id", "error")]
        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)

        def sent(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                found = []
                for row in part.astype(object).where(part.notna(), None).to_dict("records"):
                    try:
                        if row.get("outcome") == "failed":
                            found.append(("failed", None, row.get("error")))
                        else:
                            found.append(("sent", send(row), None))
                    except Exception as failure:
                        found.append(("failed", None, str(failure) or "Send failed"))
                yield part[names].assign(**{c: pd.Series(v, part.index, dtype=object) for c, v in zip(("outcome", "provider_id", "error"), zip(*found, strict=True), strict=True)}) if found else part[names].assign(outcome=None, provider_id=None, error=None)

        once.mapInPandas(sent, f"{kinds}, outcome string, provider_id string, error string").write.mode("overwrite").parquet(path)

    return sink

