"""State machines under a test clock, on streams, and after failures."""

from __future__ import annotations

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_streaming import SCHEMA, events, folded

from prospectrum.constants import SEND_RATE_PER_MINUTE
from prospectrum.operators import analytics
from prospectrum.plans import search
from prospectrum.sources import ports, tables
from prospectrum.streaming import delivery, machines


class Value:
    """A value, or a map of values, that a state holds."""

    def __init__(self, clock, ttl_ms=None):
        self.clock, self.ttl_ms, self.value, self.map, self.since = clock, ttl_ms, None, {}, 0

    def exists(self):
        return self.value is not None and (self.ttl_ms is None or self.clock() < self.since + self.ttl_ms)

    def get(self):
        return self.value if self.exists() else None

    def update(self, value):
        self.value, self.since = value, self.clock()

    def updateValue(self, key, value):
        self.map[key] = value

    def getValue(self, key):
        return self.map[key]

    def removeKey(self, key):
        del self.map[key]


class Bench:
    """Runs a processor for one key with a clock of its own."""

    def __init__(self, processor, key):
        self.now, self.timers, self.key, self.processor = 0, set(), key, processor
        processor.init(self)

    def getValueState(self, name, schema, ttl_ms=None):
        return Value(lambda: self.now, ttl_ms)

    def getMapState(self, name, key, value, ttl_ms=None):
        return Value(lambda: self.now, ttl_ms)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def rows(self, *rows):
        return self._all(self.processor.handleInputRows((self.key,), iter([pd.DataFrame(list(rows))]), self))

    def until(self, end, step=100):
        """Micro-batches up to a time; the timers that each finds expired."""
        out = []
        while self.now < end:
            self.now += step
            for at in sorted(t for t in self.timers if t <= self.now):
                self.timers.discard(at)
                info = type("Info", (), {"getExpiryTimeInMs": staticmethod(lambda at=at: at)})
                out += self._all(self.processor.handleExpiredTimer((self.key,), self, info))
        return out

    @staticmethod
    def _all(frames):
        return [row for frame in frames for row in frame.to_dict("records")]


def message(seq, channel="EMAIL", address="a@b.fi"):
    return {"campaign_id": 7, "seq": seq, "kind": "message", "channel": channel, "message_id": 100 + seq, "address": address, "body": "hi"}


def signal(seq, kind):
    return {"campaign_id": 7, "seq": seq, "kind": kind, "channel": None, "message_id": None, "address": None, "body": None}


@pytest.mark.parametrize("channel", sorted(SEND_RATE_PER_MINUTE))
@pytest.mark.parametrize("step", [50, 700])
def test_no_rate_is_exceeded(channel, step):
    bench = Bench(machines.PacedSend(), 7)
    sent = bench.rows(*[message(i, channel) for i in range(40)])
    assert [r["message_id"] for r in sent] == [100]
    sent += bench.until(400_000, step)
    delay = -(-60_000 // SEND_RATE_PER_MINUTE[channel])
    times = [r["at_ms"] for r in sent]
    assert [r["message_id"] for r in sent] == [100 + i for i in range(40)] and not bench.timers
    assert all(delay <= b - a < delay + step for a, b in zip(times, times[1:], strict=False))


def test_a_pause_stops_before_the_next_message():
    bench = Bench(machines.PacedSend(), 7)
    sent = bench.rows(*[message(i) for i in range(10)]) + bench.until(3000)
    assert [r["message_id"] for r in sent] == [100, 101, 102]
    assert bench.rows(signal(20, "PAUSED")) == [] and bench.until(60_000) == [] and not bench.timers
    assert bench.rows(message(30)) == []
    again = bench.rows(signal(40, "RUNNING"))
    assert [r["message_id"] for r in again] == [103] and [r["message_id"] for r in bench.until(120_000)] == [*range(104, 110), 130]
    # pause and resume within one delay lose no time and send nothing early
    bench.rows(message(50), message(51))
    assert bench.rows(signal(60, "PAUSED"), signal(61, "RUNNING")) == [] and len(bench.timers) == 1


def test_failures_take_no_time():
    bench = Bench(machines.PacedSend(), 7)
    out = bench.rows(message(0, address=None), message(1, "FAX"), message(2), message(3))
    assert [(r["message_id"], r["outcome"], r["error"]) for r in out] == [(100, "failed", machines.NO_PROFILE), (101, "failed", "unsupported outreach channel: FAX"), (102, "due", None)]
    assert [r["message_id"] for r in bench.until(5000)] == [103]


def test_rules_of_robots_live_an_hour():
    answers, asked = [(500, ""), (200, "User-agent: *\nDisallow: /careers"), (200, "")], []

    def fetch(origin):
        asked.append(origin)
        if len(asked) == 1:
            raise TimeoutError
        return answers[min(len(asked) - 2, 2)]

    bench = Bench(machines.RobotsRules(fetch, "bot"), "https://a.fi")
    go = lambda seq, path: bench.rows({"origin": "https://a.fi", "seq": seq, "path": path})[0]["allowed"]
    assert not go(0, "/") and len(asked) == 1  # a failure forbids and is not kept
    assert not go(1, "/about") and go(2, "/about") and go(3, "/careers") and len(asked) == 2  # a bad answer forbids once
    bench.now = machines.RULES_MS - 1
    assert go(4, "/careers") and len(asked) == 2
    bench.now = machines.RULES_MS
    assert not go(5, "/careers") and go(6, "/") and len(asked) == 3
    cache, asked[:] = machines.RobotsCache(fetch, "bot", lambda: bench.now / 1000), []
    bench.now = 0
    got = [cache.allows("https://a.fi", p) for p in ("/", "/about", "/about", "/careers")]
    bench.now = machines.RULES_MS
    assert got + [cache.allows("https://a.fi", "/careers")] == [False, False, True, True, False] and len(asked) == 3


def test_rules_name_agents():
    text = "User-Agent: other\nDisallow: /a\nuser-agent: MyBot\nDISALLOW: /b\nDisallow:\nAllow: /b/c\nUser-agent: *\nDisallow: /d:e"
    assert machines.disallowed(text, "mybot") == ["/b", "/d"]


def files(spark, tmp_path, schema, *parts):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(0.01)
    return tables.event_files(spark, str(tmp_path / "in"), schema, per_batch=1)


def collected(spark, stream, tmp_path, seconds=120, **trigger):
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    run.awaitTermination(seconds)
    if trigger:
        run.stop()
    assert run.exception() is None
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_the_stream_fold_starts_from_the_stored_status(spark, tmp_path):
    """Several micro-batches, unknown recipients and odd statuses: as in batch."""
    rng = random.Random(3)
    rows = [(k, i, rng.choice([s, s, s, "WHAT", None])) for k, i, s in events(300)]
    known = spark.createDataFrame([(k, rng.choice(["PENDING", "SENT", "OPENED", None])) for k in range(0, 25, 2)], "recipient_id long, status string")
    known.write.parquet(str(tmp_path / "known"))
    known = spark.read.parquet(str(tmp_path / "known"))
    stream = files(spark, tmp_path, SCHEMA, rows[:100], rows[100:101], rows[101:])
    got = {(r.recipient_id, r.event_id, r.status, r.applied) for r in collected(spark, delivery.fold_stream(stream, known), tmp_path)}
    table = spark.createDataFrame(rows, SCHEMA)
    want = {(r.recipient_id, r.event_id, r.status, r.applied) for r in delivery.fold_status(table, known).collect()}
    assert got == want and any(x[3] is None for x in got) and any(x[3] for x in got)
    assert {r.event_id for r in delivery.odd_events(table).collect()} == {i for _, i, s in rows if s in ("WHAT", None)}
    assert folded(events(5)).keys() == {0, 1, 2, 3, 4}


def test_paced_messages_on_a_stream(spark, tmp_path):
    rows = [(c, i, "message", "EMAIL", 10 * c + i, None if i == 2 else "a@b.fi", "hi") for c in (1, 2) for i in range(5)]
    stream = files(spark, tmp_path, machines.SEND_INPUT, rows, [(2, 9, "PAUSED", None, None, None, None)])
    found = collected(spark, machines.paced(stream, {"EMAIL": 40}), tmp_path, 20, processingTime="200 milliseconds")
    ones = sorted((r.at_ms, r.message_id) for r in found if r.campaign_id == 1 and r.outcome == "due")
    assert [m for _, m in ones] == [10, 11, 13, 14] and all(b - a >= 1500 for (a, _), (b, _) in zip(ones, ones[1:], strict=False))
    assert [r.message_id for r in found if r.outcome == "failed" and r.campaign_id == 1] == [12]
    assert {r.message_id for r in found if r.campaign_id == 2} <= {20, 21}


def test_a_cancel_leaves_the_next_lead_untouched(spark, tmp_path):
    lead = lambda job, i: (job, i, "lead", f"c{i}", None, "w", i)
    first = [lead(1, 0), lead(1, 1), (1, 2, "cancel", None, None, None, None), lead(1, 3), lead(2, 0)]
    stream = files(spark, tmp_path, machines.LEAD_INPUT, first, [lead(1, 4), lead(2, 1)])

    def enrich(row):
        if row["rank"] == 1 and row["job_id"] == 2:
            raise ValueError("no answer")
        return {"companyName": "A", "email": f"x{row['rank']}@acme.fi", "description": "d", "industry": "saas"}

    found = machines.leads_enriched(stream, enrich)
    rows = spark.createDataFrame(collected(spark, found, tmp_path), machines.LEAD)
    stages = {(r.job_id, r.company_id): (r.stage, r.stage_error) for r in search.judged(rows, 0.0).collect()}
    assert stages == {(1, "c0"): ("ENRICHED", None), (1, "c1"): ("ENRICHED", None), (1, "c3"): ("DISCOVERED", None), (1, "c4"): ("DISCOVERED", None), (2, "c0"): ("ENRICHED", None), (2, "c1"): ("ENRICH_FAILED", "no answer")}


def test_a_retried_batch_adds_nothing(spark, tmp_path):
    """The first run fails after its batch is written; the second sends no message again."""
    out, log = str(tmp_path / "sent"), tmp_path / "log"
    log.mkdir()

    def send(row):
        (log / f"{row['message_id']}-{time.time_ns()}").touch()
        if row["message_id"] == 3:
            raise ValueError("mailbox full")
        return f"p{row['message_id']}"

    stream = files(spark, tmp_path, "message_id long, campaign_id long", [(1, 1), (2, 1), (2, 1)], [(2, 1), (3, 2)])
    sink, calls = machines.batch_sink(send, out), []

    def failing(rows, batch_id):
        sink(rows, batch_id)
        calls.append(batch_id)
        if len(calls) == 1:
            raise RuntimeError("lost after the write")

    for attempt in range(2):
        run = stream.writeStream.foreachBatch(failing).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        try:
            run.awaitTermination(60)
        except Exception as error:
            assert attempt == 0 and "lost after the write" in str(error)
    assert calls == [0, 0, 1]
    got = spark.read.parquet(out)
    assert sorted((r.message_id, r.outcome, r.provider_id, r.error) for r in got.collect()) == [(1, "sent", "p1", None), (2, "sent", "p2", None), (3, "failed", None, "mailbox full")]
    assert sorted(p.name.split("-")[0] for p in log.iterdir()) == ["1", "2", "3"]
    assert {r.campaign_id: r.final_status for r in analytics.campaign_final_status(got, "campaign_id").collect()} == {1: "COMPLETED", 2: "FAILED"}


def test_a_batch_that_was_half_written_is_written_anew(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "message_id long, body string")
    out = str(tmp_path / "sent")
    rows.limit(1).write.parquet(f"{out}/batch_id=5")
    (tmp_path / "sent/batch_id=5/_SUCCESS").unlink()
    machines.batch_sink(lambda row: "p", out)(rows, 5)
    assert sorted(r.message_id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_requests_without_a_time_are_not_counted(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), (None, 3, 7), ("a", 4, 6)], "key string, request_id long, at_ms long")
    assert {r.request_id: (r.allowed, r.remaining) for r in delivery.limited(df, 1, 100).collect()} == {1: (True, 0), 2: (None, None), 3: (True, 0), 4: (False, 0)}


def test_a_company_crawl_keeps_to_the_rules(spark):
    rows = spark.createDataFrame([(1, "https://a.fi"), (2, "https://bad.fi"), (3, "https://down.fi")], "company_id long, site string")
    targets = F.array(*[F.struct(F.lit(p).alias("path"), F.concat("site", F.lit(p)).alias("url")) for p in ("/", "/careers", "/about")])

    def robots(origin):
        if origin == "https://down.fi":
            raise TimeoutError
        return (404, "") if origin == "https://bad.fi" else (200, "User-agent: *\nDisallow: /careers")

    found = {r.company_id: r for r in ports.company_crawls(rows, targets, lambda url: "<p>x</p>", robots=robots, agent="bot").collect()}
    blocked = {k: [p.path for p in r.pages if p.error == "Blocked by robots.txt"] for k, r in found.items()}
    assert blocked == {1: ["/careers"], 2: ["/"], 3: ["/", "/careers", "/about"]}
    assert {k: r.status for k, r in found.items()} == {1: "partial", 2: "partial", 3: "failed"}
