from __future__ import annotations

import hashlib
import hmac
import math

import duckdb
import pytest
from conftest import DATA, table
from pyspark.sql import functions as F

import __spark_entry__ as driver
from shieldframe.operators import payloads, protect, reports, synthesis, vault, vault_jdbc
from shieldframe.plans import catalog
from shieldframe.policy import preset, uniform
from shieldframe.sources import tables
from shieldframe.streaming import restore as streams
from shieldframe.streaming import webhooks


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    df = catalog.queries()[name](spark, f"{DATA}/sf0.001")
    cols = sorted(df.columns)
    rel = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str) == want


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_privacy_report(spark):
    real = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id int, segment string, active boolean")
    made = spark.createDataFrame([(9, "a", True), (8, "c", True)], "id int, segment string, active boolean")
    row = reports.privacy_report(real, made, ["segment"], ["active"], ["id"]).first()
    assert (row.status, row.exact_row_match_rate, row.non_key_cell_copy_rate, row.k_anonymity, row.l_diversity) == ("evaluated", 0.5, 0.75, 1, {"active": 1}) and len(row.warnings) == 4
    assert reports.privacy_report(real, made.limit(0), ["segment"]).first().status == "not_evaluable"
    assert reports.privacy_report(real, made, ["nope"]).first().reason == "a quasi-identifier column is missing"


@pytest.mark.parametrize(("text", "kind"), [("", "null"), ("True", "boolean"), ("a@b.co", "email"), ("2024-02-30", "phone"), ("2024-02-29", "date"), ("20240229", "date"), ("1234567", "phone"), ("12", "integer"), ("1e5", "float"), ("nan", "float"), ("x", "text")])
def test_scalar_kind(spark, text, kind):
    assert spark.createDataFrame([(text,)], "v string").select(reports.scalar_kind(F.col("v")).alias("k")).first().k == kind


def test_inference_and_synthesis(spark):
    rows = [(i, f"p{i}@x.test", float(i % 7), "ab"[i % 2], None if i % 5 else "note") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, email string, score double, segment string, note string")
    spec = synthesis.infer(df, "people")
    kinds = {c.name: c.kind for c in spec.columns}
    assert kinds == {"id": "integer", "email": "email", "score": "float", "segment": "category", "note": "category"}
    assert spec.columns[0].primary_key and spec.columns[4].null_rate == 0.8
    made = synthesis.table(spark, spec, 500, "s")
    assert made.collect() == synthesis.table(spark, spec, 500, "s", partitions=3).orderBy("id").collect()
    stats = made.agg(F.count_distinct("id").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg(F.col("note").isNull().cast("int")).alias("nulls")).first()
    assert stats.n == 500 and stats.lo >= 0 and stats.hi <= 6 and 0.7 < stats.nulls < 0.9
    mixed = synthesis.infer(spark.createDataFrame([("1",), ("x",), ("y",)], "field string"), "t")
    assert mixed.columns[0].kind == "text" and len(mixed.diagnostics) == 1


def test_foreign_keys(spark):
    c, k = synthesis.ColumnSpec, synthesis.ForeignKey
    accounts = synthesis.TableSpec("accounts", (c("id", "integer", primary_key=True),))
    orders = synthesis.TableSpec("orders", (c("id", "integer", primary_key=True), c("account_id", "integer")), (k("account_id", "accounts", "id"),))
    made = synthesis.tables(spark, [orders, accounts], {"accounts": 3, "orders": 20}, "s")
    assert made["orders"].count() == 20 and synthesis.orphans(made["orders"], "account_id", made["accounts"], "id").isEmpty()
    profile = synthesis.TableSpec("profiles", (c("account_id", "integer", primary_key=True),), (k("account_id", "accounts", "id"),))
    one = synthesis.tables(spark, [profile, accounts], {"accounts": 3, "profiles": 3}, "s")["profiles"]
    assert one.distinct().count() == 3
    with pytest.raises(ValueError):
        synthesis.tables(spark, [profile, accounts], {"accounts": 3, "profiles": 4}, "s")
    with pytest.raises(ValueError):
        synthesis.order_of([synthesis.TableSpec("a", (c("x", "text"),), (k("x", "b", "y"),)), synthesis.TableSpec("b", (c("y", "text"),), (k("y", "a", "x"),))])
    with pytest.raises(ValueError):
        synthesis.table(spark, synthesis.TableSpec("t", (c("b", "boolean", primary_key=True),)), 3, "s")


def test_vault_lifecycle(spark, tmp_path):
    store = vault.open_vault(spark, f"file://{tmp_path}/vault")
    assert store.read("sessions").count() == 0
    store.append("sessions", spark.createDataFrame([("s1", "{}", None, 1, 10), ("s2", "{}", None, 1, 99)], vault.SCHEMAS["sessions"]))
    store.append("mappings", spark.createDataFrame([("m1", "s1", "URL", "h", b"x", "r", "tokenize", 1, 99), ("m2", "s2", "URL", "h", b"x", "r", "tokenize", 1, 10)], vault.SCHEMAS["mappings"]))
    store.append("detections", spark.createDataFrame([("d1", "s2", "m2", "URL", "x", 1, "redact", "p", 1, "h", 0, 1, 1, 99)], vault.SCHEMAS["detections"]))
    store.append("audit_events", spark.createDataFrame([("a1", "s1", "e", "ok", "{}", 1, 99)], vault.SCHEMAS["audit_events"]))
    counts = {r.table: r.purged for r in vault.purge_counts(store.tables(), 10).collect()}
    assert counts == {"sessions": 1, "mappings": 1, "detections": 0, "audit_events": 0}
    assert store.purge(10) == counts
    assert [r.id for r in store.read("sessions").collect()] == ["s2"] and store.read("mappings").count() == 0
    assert store.read("detections").first().mapping_id is None and store.read("audit_events").first().session_id is None
    assert store.delete("s2")
    assert store.read("sessions").count() == 0 and store.read("detections").count() == 0
    assert isinstance(vault.open_vault(spark, "postgresql://h/db"), vault_jdbc.JdbcVault)


def test_sessions_mappings_and_audit(spark, tmp_path):
    key, other = b"k" * 32, b"o" * 32
    store = vault.open_vault(spark, f"file://{tmp_path}/vault")
    policy = preset("healthcare")
    session = store.create_session(policy, 100, {"b": "2", "a": "é"}, key)
    assert store.policy_for(session, 101) == policy
    row = store.read("sessions").first()
    detail = store.read("sessions").select(F.try_aes_decrypt("metadata_encrypted", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(f"session-metadata:{session}").cast("binary")).cast("string")).first()[0]
    assert detail == '{"a":"2"}'.replace("2", "é").replace("}", ',"b":"2"}') and row.expires_at == 100 + policy.audit_retention_seconds
    with pytest.raises(ValueError):
        store.create_session(policy, 100, {"a": "b"})
    made = spark.createDataFrame([(session, "PERSON", "Ann", "T1"), (session, "PERSON", "Bob", "T2")], "session_id string, entity string, value string, replacement string")
    ids = {r.replacement: r.mapping_id for r in store.store_mappings(made, policy, "tokenize", key, 100).collect()}
    assert set(ids) == {"T1", "T2"} and store.read("mappings").count() == 2
    again = spark.createDataFrame([(session, "PERSON", "Ann", "T9")], made.schema)
    assert [(r.mapping_id, r.replacement) for r in store.store_mappings(again, policy, "tokenize", key, 101).collect()] == [(ids["T1"], "T1")] and store.read("mappings").count() == 2
    with pytest.raises(vault.MappingCollision):
        store.store_mappings(spark.createDataFrame([(session, "PERSON", "Eve", "T1")], made.schema), policy, "tokenize", key, 101)
    want = hmac.new(key, f"mapping-match\0{session}\0PERSON\0Ann".encode(), hashlib.sha256).hexdigest()
    assert want in {r.original_hmac for r in store.read("mappings").collect()} and b"Ann" not in b"".join(bytes(r.original_encrypted) for r in store.read("mappings").collect())
    opened = vault.reverse_mappings(store.read("sessions"), store.read("mappings"), key, 101)
    assert {(r.replacement, r.value) for r in opened.collect()} == {("T1", "Ann"), ("T2", "Bob")}
    assert vault.reverse_mappings(store.read("sessions"), store.read("mappings"), other, 101).count() == 0
    late = 100 + policy.mapping_retention_seconds
    assert vault.reverse_mappings(store.read("sessions"), store.read("mappings"), key, late).count() == 0
    fresh = store.store_mappings(spark.createDataFrame([(session, "PERSON", "Eve", "T1")], made.schema), policy, "tokenize", key, late).collect()
    assert [r.replacement for r in fresh] == ["T1"] and {r.replacement for r in vault.live(store.read("mappings"), late).collect()} == {"T1"}
    with pytest.raises(KeyError):
        store.policy_for(session, 10**9)
    assert store.read("sessions").count() == 0 and store.read("mappings").count() == 0 and not store.delete(session)


def test_restoring_from_the_vault_takes_live_mappings_and_is_audited(spark, tmp_path):
    key, policy = b"k" * 32, uniform("tokenize", ("EMAIL_ADDRESS",))
    store = vault.open_vault(spark, f"file://{tmp_path}/vault")
    session = store.create_session(policy, 0)
    docs = spark.createDataFrame([(1, session, "to ann@post.example"), (2, session, "nothing"), (3, "none", "x")], "id int, session_id string, t string")
    marked = protect.marked(docs, "t", policy)
    mappings = protect.allocate(protect.spans_of(marked, ["session_id"]), policy, key)
    store.store_mappings(mappings, policy, "tokenize", key, 0)
    shown = protect.render_marked(marked, "t", policy, mappings, key, row="id").drop("t").checkpoint()
    assert {r.id: r.restored for r in store.restore(shown, "protected_text", key, 1, "id").collect()} == {1: "to ann@post.example", 2: "nothing", 3: "x"}
    event = store.read("audit_events").collect()
    texts = {r.protected_text for r in shown.collect() if r.id < 3}
    hashes = {f'{{"input_hash":"{hmac.new(key, b"restore" + bytes(1) + t.encode(), hashlib.sha256).hexdigest()}"}}' for t in texts}
    assert {(e.session_id, e.event_type, e.outcome) for e in event} == {(session, "restore", "restored")} and {e.detail_json for e in event} == hashes and len(event) == 2
    expired = {r.id: r.restored for r in store.restore(shown, "protected_text", key, policy.mapping_retention_seconds, "id").collect()}
    assert expired[1].startswith("to [[PG1|") and store.purge(policy.mapping_retention_seconds)["mappings"] == 1
    spans = protect.spans_of(marked, ["session_id", "t"]).select("session_id", F.col("t").alias("text"), "entity", "detector", "confidence_ppm", F.lit("tokenize").alias("action"), "start", "end", F.lit(None).cast("string").alias("mapping_id"))
    store.append("detections", vault.detection_rows(spans, policy, key, 5))
    row = store.read("detections").first()
    assert (row.start_offset, row.end_offset, row.source_hash) == (3, 19, hmac.new(key, b"source\0to ann@post.example", hashlib.sha256).hexdigest())


def test_a_second_writer_fails_and_changes_nothing(spark, tmp_path):
    store, other = (vault.VaultStore(spark, f"file://{tmp_path}/vault") for _ in range(2))
    rows = spark.createDataFrame([("s1", "{}", None, 1, 10)], vault.SCHEMAS["sessions"])
    store.append("sessions", rows)
    seen = other._manifest()
    other._manifest = lambda: seen
    store.append("sessions", rows)
    with pytest.raises(RuntimeError):
        other.append("sessions", rows)
    assert store.read("sessions").count() == 2


TOKEN = "[[PG1|PERSON|" + "A" * 26 + "|" + "B" * 16 + "]]"


def test_stream_restoration_at_every_split():
    reverse = {TOKEN: "Ann", f"X. Y {TOKEN.replace('A' * 26, 'C' * 26)}": "Bob"}
    text = f"hi {TOKEN}, x. y {TOKEN.replace('A' * 26, 'C' * 26)} [[PG1|PERSON|" + "D" * 26 + "|" + "B" * 16 + "]] [x"
    want = "hi Ann, Bob [[PG1|PERSON|" + "D" * 26 + "|" + "B" * 16 + "]] [x"
    for i in range(len(text) + 1):
        r = streams.Restorer(reverse)
        assert r.feed(text[:i]) + r.feed(text[i:]) + r.finish() == want
    r = streams.Restorer(reverse)
    assert "".join(map(r.feed, text)) + r.finish() == want
    with pytest.raises(RuntimeError):
        r.feed("x")
    r = streams.Restorer(reverse)
    assert r.feed("[[" + "a" * 1000) and len(r.held) <= streams.MOST_HELD


def test_structured_stream_restoration(spark, tmp_path):
    text = f"a {TOKEN} b"
    rows = [("s1", i, c, i == len(text) - 1) for i, c in enumerate(text)] + [("s2", 0, "plain", True)]
    schema = "stream_id string, seq long, chunk string, is_last boolean"
    for part in (rows[:20], rows[20:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.restore_streams(chunks, {TOKEN: "Ann"}).writeStream.format("memory").queryName("restored").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.table("restored").orderBy("stream_id", "seq").collect():
        got[r.stream_id] = got.get(r.stream_id, "") + r.text
    assert got == {"s1": "a Ann b", "s2": "plain"}


def test_webhooks(spark):
    df = spark.createDataFrame([("d", 0), ("d", 300), ("d", 301), ("e", 5)], "id string, t long")
    assert sorted(r.t for r in webhooks.first_deliveries(df, "id", "t").collect()) == [0, 5, 300]
    assert [r[0] for r in spark.createDataFrame([(0, 300), (0, 301), (301, 0)], "a long, b long").select(webhooks.on_time(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_known_shapes(spark):
    df = spark.createDataFrame([({"display": "x", "tool": "y"}, ["p"])], "m map<string,string>, l array<string>").select(F.struct(F.struct(F.lit("a").alias("b"), F.lit(1).alias("n")).alias("o"), "l").alias("v"))
    change = lambda s, path: F.concat(s, F.lit(path))
    row = df.select(payloads.transform_strings(F.col("v"), df.schema["v"].dataType, change, blocked=["/l"]).alias("v")).first().v
    assert row.o.b == "a/o/b" and row.o.n == 1 and row.l == ["p"]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("1", None), ("", "é")], "a string, b string")
    for kind in ("jsonl", "json"):
        tables.write(df, str(tmp_path / f"x.{kind}"))
        assert tables.read(spark, str(tmp_path / f"x.{kind}"), "jsonl").count() == 2
    tables.write(df, str(tmp_path / "x.csv"))
    assert sorted(tables.read(spark, str(tmp_path / "x.csv")).dtypes) == [("a", "string"), ("b", "string")]
    with pytest.raises(ValueError):
        tables.format_of("x.xml")
    (tmp_path / "c.jsonl").write_text('{"id":"1","text":"é a","expected":[{"entity":"URL","start":0,"end":2}]}\n')
    assert tables.read_cases(spark, str(tmp_path / "c.jsonl")).count() == 1
    (tmp_path / "d.jsonl").write_text('{"id":"1","text":"é a","expected":[{"entity":"URL","start":0,"end":1}]}\n')
    with pytest.raises(ValueError):
        tables.read_cases(spark, str(tmp_path / "d.jsonl"))


def test_plan_prunes_columns(spark):
    plan = catalog.k_anonymity(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan and table(spark, "customer").count() > 0


def test_replays_are_judged_by_the_last_accepted_delivery(spark):
    times = [("d", t) for t in (0, 10, 15, 22, 33, 33, 34)] + [("e", 5), ("e", 16)] + [(None, 1), (None, 2), ("f", None), ("f", 3), ("f", 4)]
    got = [tuple(r) for r in webhooks.first_deliveries(spark.createDataFrame(times, "id string, t long"), "id", "t", ttl=10).collect()]
    assert sorted(got, key=str) == sorted([("d", 0), ("d", 10), ("d", 22), ("d", 33), ("e", 5), ("e", 16), (None, 1), ("f", None), ("f", 3)], key=str)


def test_replays_of_events_at_the_real_ttl(spark):
    rows = table(spark, "events").select(F.col("event_type").alias("id"), F.unix_timestamp("ts").alias("t"))
    last, want = {}, []
    for r in sorted(rows.collect()):
        if r.id not in last or r.t - last[r.id] >= 300:
            last[r.id] = r.t
            want.append(tuple(r))
    assert sorted(map(tuple, webhooks.first_deliveries(rows, "id", "t").collect())) == want


def test_replays_in_a_stream_over_batches(spark, tmp_path):
    times = [[("d", 1000), ("d", 1010), ("e", 1005)], [("d", 1015), ("d", 1022), ("e", 1016)], [("d", 1033), ("d", 1026)]]
    for part in times:
        spark.createDataFrame(part, "id string, t long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, t long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = webhooks.without_replays(stream, "id", "t", ttl=10).writeStream.format("memory").queryName("accepted").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("accepted").collect())) == [("d", 1000), ("d", 1010), ("d", 1022), ("d", 1033), ("e", 1005), ("e", 1016)]


def test_leaves_of_deep_trees(spark):
    deep = lambda n: '{"a":[' * n + '"x"' + "]}" * n
    df = spark.createDataFrame([(n, deep(n)) for n in (0, 1, 4, 5, 9)] + [(-1, None), (-2, "{}"), (-3, "[null, 1]"), (-4, "no")], "id int, j string")
    got = {r.id: (r.pointer, r.value) for r in payloads.leaves(df, ["id"], "j").collect()}
    assert got == {n: ("/a/0" * n or "/", "x") for n in (0, 1, 4, 5, 9)}


def test_timing_by_ranks(spark):
    rows = [("a", float(i * 37 % 1000)) for i in range(2000)] + [("b", 1.0), ("b", 4.0), ("b", None), (None, 2.0), (None, 7.5), (None, 2.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    want = {}
    for g in ("a", "b", "c", None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        n = len(v)
        want[g] = (n, (v[(n - 1) // 2] + v[n // 2]) / 2, v[max(1, math.ceil(n * 0.95)) - 1], v[0]) if v else (0, None, None, None)
    made = reports.timing(df, ["g"], "v")
    assert {r.g: (r.n, r["median"], r.p95, r.least) for r in made.collect()} == want
    assert not any(f in made._jdf.queryExecution().toString() for f in ("collect_list(", "percentile(", "median("))


def test_precedence_first_goes_through_resolution(spark):
    assert "overlap_suppressed" in catalog.queries()["precedence_first"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
