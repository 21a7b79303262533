"""Event streams against their batch forms, and callbacks."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from prospectrum.constants import STATUS_RANK
from prospectrum.sources import tables
from prospectrum.streaming import delivery

SCHEMA = "recipient_id long, event_id long, status string"


def events(n=400, seed=2):
    rng = random.Random(seed)
    return [(rng.randrange(25), i, rng.choice(list(STATUS_RANK))) for i in range(n)]


def folded(rows, initial="PENDING"):
    most, out = {}, {}
    for key, i, status in rows:
        rank = STATUS_RANK[status]
        out[i] = rank > most.get(key, STATUS_RANK[initial])
        most[key] = max(most.get(key, STATUS_RANK[initial]), rank)
    return out


def test_batch_fold_against_a_model(spark):
    rows = events()
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.event_id: r.applied for r in delivery.fold_status(df).collect()} == folded(rows)
    sent = spark.createDataFrame([(k, "SENT") for k in range(25)], "recipient_id long, status string")
    assert {r.event_id: r.applied for r in delivery.fold_status(df, sent).collect()} == folded(rows, "SENT")


def test_stream_fold_equals_the_batch_fold(spark, tmp_path):
    rows = events()
    for part in range(4):  # four files, a micro-batch each
        spark.createDataFrame(rows[part * 100 : (part + 1) * 100], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = tables.event_files(spark, str(tmp_path / "in"), SCHEMA, per_batch=1)
    run = delivery.fold_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert run.exception() is None
    got = {r.event_id: r.applied for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == folded(rows)


def test_bounces_and_failures_never_displace_sent(spark):
    rows = [(1, 0, "SENT"), (1, 1, "BOUNCED"), (1, 2, "FAILED"), (1, 3, "UNSUBSCRIBED"), (1, 4, "DELIVERED"), (1, 5, "SENT")]
    assert folded(rows) == {0: True, 1: False, 2: False, 3: False, 4: True, 5: False}
    got = delivery.final_status(spark.createDataFrame(rows, SCHEMA).withColumn("occurred_at", F.current_timestamp())).first()
    assert got.status == "DELIVERED"


def test_windows_reopen_after_they_end(spark):
    rows = [("a", i, at) for i, at in enumerate([0, 10, 20, 99, 100, 150, 199, 200])] + [("b", 100, 5)]
    df = spark.createDataFrame(rows, "key string, request_id long, at_ms long")
    got = {(r.key, r.request_id): r.allowed for r in delivery.limited(df, 2, 100).collect()}
    assert [got["a", i] for i in range(8)] == [True, True, False, False, True, True, False, True] and got["b", 100]


def test_windows_against_a_model(spark):
    rng = random.Random(6)
    rows = [(str(rng.randrange(9)), i, rng.randrange(5000)) for i in range(600)]
    want, state = {}, {}
    for key, i, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        opened, used = state.get(key, (None, 0))
        if opened is None or at - opened >= 300:
            opened, used = at, 0
        want[i] = used < 3
        state[key] = opened, used + want[i]
    df = spark.createDataFrame(rows, "key string, request_id long, at_ms long")
    assert {r.request_id: r.allowed for r in delivery.limited(df, 3, 300).collect()} == want


def test_window_stream_equals_the_batch_form(spark, tmp_path):
    rng = random.Random(7)
    rows = [(str(rng.randrange(6)), i, 10 * i) for i in range(300)]
    kinds = "key string, request_id long, at_ms long"
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : (part + 1) * 100], kinds).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = delivery.limit_stream(tables.event_files(spark, str(tmp_path / "in"), kinds, per_batch=1), 3, 250)
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert run.exception() is None
    want = delivery.limited(spark.createDataFrame(rows, kinds), 3, 250)
    pick = lambda df: sorted((r.request_id, r.allowed, r.remaining) for r in df.collect())
    assert pick(spark.read.parquet(str(tmp_path / "out"))) == pick(want)


def test_callbacks_of_three_providers(spark):
    bodies = [json.dumps({"type": "email.opened", "data": {"email_id": "e1", "created_at": "2024-01-02T03:04:05Z"}}), json.dumps({"type": "email.other", "data": {"email_id": "e1"}}), json.dumps({"type": "email.opened", "data": {}}), "no json"]
    email = delivery.known_events(delivery.decode_email(spark.createDataFrame([(b,) for b in bodies], "body string"))).collect()
    assert [(r.provider_id, r.status, r.field) for r in email] == [("e1", "OPENED", "openedAt")]
    nested = json.dumps({"entry": [{"changes": [{"value": {"statuses": [{"id": "w1", "status": "read", "timestamp": "1700000000"}, {"id": "w2", "status": "failed", "timestamp": "1"}], "messages": [{"id": "m"}]}}]}]})
    whatsapp = delivery.known_events(delivery.decode_whatsapp(spark.createDataFrame([(nested,)], "body string"))).collect()
    assert {(r.provider_id, r.status, r.field) for r in whatsapp} == {("w1", "OPENED", "readAt"), ("w2", "FAILED", None)}
    linked = json.dumps({"event": "message.replied", "data": {"id": "l1"}})
    assert delivery.known_events(delivery.decode_linkedin(spark.createDataFrame([(linked,)], "body string"))).first().status == "REPLIED"


@pytest.mark.parametrize("scheme", ["svix", "hex", "sha256="])
def test_signatures(spark, scheme):
    body, secret = '{"a":1}', "whsec_" + base64.b64encode(b"key").decode() if scheme == "svix" else "key"
    if scheme == "svix":
        good = "v1,bad v1," + base64.b64encode(hmac.new(b"key", f"id.7.{body}".encode(), hashlib.sha256).digest()).decode()
    else:
        good = ("sha256=" if scheme == "sha256=" else "") + hmac.new(b"key", body.encode(), hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([(body, good, "id", "7"), (body + " ", good, "id", "7"), (body, "x", "id", "7"), (None, good, "id", "7"), (body, None, "id", "7")], "b string, s string, i string, t string")
    assert [r.x for r in rows.select(delivery.is_authentic(secret, scheme)("b", "s", "i", "t").alias("x")).collect()] == [True, False, False, False, False]


def test_delivery_sink_sends_each_row(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, body string").write.json(str(tmp_path / "in"))
    stream = tables.event_files(spark, str(tmp_path / "in"), "id long, body string")
    run = delivery.deliver(stream, lambda row: f"sent-{row['id']}", str(tmp_path / "out")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert run.exception() is None
    assert {(r.id, r.provider_id) for r in spark.read.parquet(str(tmp_path / "out/sent")).collect()} == {(1, "sent-1"), (2, "sent-2")}
