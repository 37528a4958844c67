from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from shieldframe.operators import shield, vault
from shieldframe.policy import uniform
from shieldframe.streaming import restore as streams
from shieldframe.streaming import webhooks

KEY = bytes(range(32))
SECRET, FORGED = b"s" * 32, b"f" * 32
COLUMNS = "n int, body string, timestamp string, delivery string, signature string, at long"
A, B = (str(uuid.UUID(int=i)) for i in (1, 2))
#: (number, body, sent, id, key, in at, outcome): in order of arrival.
DELIVERIES = [
    (0, "{}", 10_000, A, FORGED, 10_000, "bad_signature"),
    (1, "{}", 10_000, A, SECRET, 10_001, "accepted"),  # the forged one before it doesn't block it
    (2, "{}", 10_000, A.upper(), SECRET, 10_002, "replayed"),
    (3, "{}", 10_000, "{" + A.replace("-", "") + "}", FORGED, 10_003, "replayed"),
    (4, "[1]", 10_000, B, SECRET, 10_003, "body_not_an_object"),
    (5, '{"a":1} {}', 10_000, B, SECRET, 10_003, "body_not_an_object"),
    (6, '{"a":1}, {"b":2}', 10_000, B, SECRET, 10_003, "body_not_an_object"),
    (7, None, 10_000, B, SECRET, 10_003, "body_not_an_object"),
    (8, "{}", 10_000, "no-id", SECRET, 10_003, "bad_headers"),
    (9, "{}", None, B, SECRET, 10_003, "bad_headers"),
    (10, "{}", 9_702, B, SECRET, 10_003, "out_of_tolerance"),
    (11, "{}", 10_303, B, SECRET, 10_003, "accepted"),
    (12, "{}", 10_600, B, SECRET, 10_602, "replayed"),
    (13, "{}", 10_600, B, SECRET, 10_603, "accepted"),  # just when it is forgotten
    (14, "{}", 10_600, A, SECRET, 10_700, "accepted"),
]


def deliveries(spark):
    rows = spark.createDataFrame([(*d[:2], str(d[2]) if d[2] is not None else None, d[3], d[4], d[5]) for d in DELIVERIES], "n int, body string, timestamp string, delivery string, k binary, at long")
    signed = [webhooks.signature(k, F.col("timestamp"), F.coalesce(webhooks.delivery_id(F.col("delivery")), F.lit("")), F.coalesce("body", F.lit(""))) for k in (SECRET, FORGED)]
    return rows.select("n", "body", "timestamp", "delivery", F.coalesce(F.when(F.col("k") == SECRET, signed[0]).otherwise(signed[1]), F.lit("")).alias("signature"), "at")


def test_deliveries_are_judged_in_order(spark):
    got = {r.n: r.outcome for r in webhooks.verified(deliveries(spark), SECRET).collect()}
    assert got == {d[0]: d[6] for d in DELIVERIES} and set(got.values()) == set(webhooks.OUTCOMES)
    assert webhooks.verified(deliveries(spark).limit(0), SECRET).count() == 0


def state_rows(query):
    return query.recentProgress[-1].stateOperators[0].numRowsTotal


def test_deliveries_in_a_stream_over_restarts_and_their_state_expires(spark, tmp_path):
    rows, schema = deliveries(spark).collect(), "n int, body string, timestamp string, delivery string, signature string, at long"
    late = [(50 + i, "{}", str(t), str(uuid.UUID(int=50 + i)), "none", t) for i, t in enumerate((20_000, 20_001))]

    def run(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = webhooks.verified_stream(stream, SECRET, late=60).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert q.awaitTermination(60)
        return q

    for part in (rows[:3], rows[3:9], rows[9:]):
        last = run(part)
    got = {r.n: r.outcome for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {d[0]: d[6] for d in DELIVERIES}
    assert state_rows(last) >= 2
    run(late[:1])
    assert state_rows(run(late[1:])) == 0
    assert spark.read.parquet(f"{tmp_path}/out").where("n >= 50 and outcome = 'bad_signature'").count() == 2


def test_two_sessions_in_one_stream_over_restarts(spark, tmp_path):
    s = shield.Shield(spark, uniform("tokenize", ("EMAIL_ADDRESS",)), KEY, vault.VaultStore(spark, f"file://{tmp_path}/vault"))
    ids = [s.create_session(now=0) for _ in range(2)]
    df = spark.createDataFrame([(i, ids[i], f"from {m}@post.example, once") for i, m in enumerate(("ann", "bob"))], "id int, session_id string, t string")
    shown = {r.id: r.protected_text for r in s.protect(df, "t", "id", now=1)[0].collect()}
    schema = "stream_id string, session_id string, seq long, chunk string, is_last boolean"
    chunks = [(f"s{i}", ids[i], k, c, False) for i, text in shown.items() for k, c in enumerate(text)]
    stolen = [("s2", ids[1], k, c, False) for k, c in enumerate(shown[0])]  # another session's token stays a token
    every = chunks + stolen
    halves = [[c for c in every if c[2] % 100 < 40 and c[2] < 40], [c for c in every if c[2] >= 40]]
    ends = [(f"s{i}", ids[min(i, 1)], 9999, "", True) for i in range(3)]
    for part in (halves[0], halves[1] + ends):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        assert streams.restore_sessions(stream, s, f"{tmp_path}/out", f"{tmp_path}/ck", now=lambda: 2, lead=8).awaitTermination(60)
    got = {}
    for r in sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: (r.stream_id, r.seq)):
        got[r.stream_id] = got.get(r.stream_id, "") + r.restored
    assert got == {"s0": "from ann@post.example, once", "s1": "from bob@post.example, once", "s2": shown[0]}
    spark.createDataFrame([("s0", ids[0], 10_000, "more", False)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="finished"):
        streams.restore_sessions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), s, f"{tmp_path}/out", f"{tmp_path}/ck", now=lambda: 2, lead=8).awaitTermination(60)


def test_streams_without_new_chunks_are_forgotten(spark, tmp_path):
    import time

    schema = "stream_id string, seq long, chunk string, is_last boolean"
    for part in ([("s1", 0, "hello [[PG", False), ("s2", 0, "done", True)], [("s3", 0, "x", False)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = streams.restore_streams(stream, {}, idle_seconds=1).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert q.awaitTermination(60)
        time.sleep(3)
    held = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/ck").select("key.stream_id").collect()
    assert {r.stream_id for r in held} == {"s3"}
