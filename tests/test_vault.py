from __future__ import annotations

import glob
import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from shieldframe.functions.recognizers import ModelDetector, RegexDetector
from shieldframe.operators import protect, shield, vault, vault_jdbc
from shieldframe.policy import DAY, Policy, Rule, uniform

KEY = bytes(range(32))
MAIL = uniform("tokenize", ("EMAIL_ADDRESS",))
DOCS = "id int, session_id string, t string"


def store_at(spark, tmp_path, name="vault"):
    return vault.VaultStore(spark, f"file://{tmp_path}/{name}")


def opened(spark, folder):
    """Every original that any file below the vault gives away to the key."""
    files = glob.glob(f"{folder}/mappings/**/*.parquet", recursive=True)
    if not files:
        return set()
    rows = spark.read.parquet(*files)
    value = F.try_aes_decrypt("original_encrypted", F.lit(KEY), F.lit("GCM"), F.lit("DEFAULT"), F.concat_ws(":", F.lit("mapping"), "session_id", "id").cast("binary")).cast("string")
    return {r[0] for r in rows.select(value).collect()}


def protect_one(s, session, mail, now):
    df = s.spark.createDataFrame([(1, session, f"to {mail}")], DOCS)
    return s.protect(df, "t", "id", now=now)[0].collect()[0]


def test_deleted_and_purged_values_are_on_no_file(spark, tmp_path):
    s = shield.Shield(spark, MAIL, KEY, store_at(spark, tmp_path))
    one, two = s.create_session(now=0), s.create_session(now=0)
    protect_one(s, one, "ann@post.example", 1)
    protect_one(s, two, "bob@post.example", 2)
    protect_one(s, two, "late@post.example", DAY)
    folder = f"{tmp_path}/vault"
    assert opened(spark, folder) == {"ann@post.example", "bob@post.example", "late@post.example"}
    assert s.vault.delete(one) and not s.vault.delete(one)
    assert opened(spark, folder) == {"bob@post.example", "late@post.example"}
    assert {r.session_id for r in s.vault.read("detections").collect()} == {two}
    assert sorted(str(r.session_id) for r in s.vault.read("audit_events").collect()) == sorted(["None", two, two])
    counts = s.vault.purge(2 + DAY)
    assert counts == {"sessions": 0, "mappings": 1, "detections": 0, "audit_events": 0} and opened(spark, folder) == {"late@post.example"}
    assert sorted(r.mapping_id is None for r in s.vault.read("detections").collect()) == [False, True]
    assert s.vault.purge(31 * DAY)["sessions"] == 1 and opened(spark, folder) == set()
    assert all(s.vault.read(n).count() == 0 for n in vault.SCHEMAS) and len(glob.glob(f"{folder}/_manifests/*.json")) == 1
    assert glob.glob(f"{folder}/*/p-*") == []


def test_an_erasure_takes_only_the_parts_it_has_to(spark, tmp_path):
    store = store_at(spark, tmp_path)
    rows = [(f"m{i}", f"s{i % 2}", "URL", f"h{i}", b"x", f"r{i}", "tokenize", 0, e) for i, e in enumerate((5, 50, 5, 50))]
    for part in (rows[:1], rows[1:2], rows[2:]):
        store.append("mappings", spark.createDataFrame(part, vault.SCHEMAS["mappings"]))
    store.append("sessions", spark.createDataFrame([("s0", "{}", None, 0, 90), ("s1", "{}", None, 0, 90)], vault.SCHEMAS["sessions"]))
    before = [p["path"] for p in store._manifest()[1]["tables"]["mappings"]]
    assert store.purge(10)["mappings"] == 2
    after = [p["path"] for p in store._manifest()[1]["tables"]["mappings"]]
    assert after[0] == before[1] and len(after) == 2 and after[1] not in before and {r.id for r in store.read("mappings").collect()} == {"m1", "m3"}
    assert store.delete("s0") and [p["path"] for p in store._manifest()[1]["tables"]["mappings"]] == after


def test_many_appends_leave_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vault, "MERGED", 4)
    store, rows = store_at(spark, tmp_path), []
    for i in range(26):
        rows.append((f"a{i}", "s", "e", "ok", "{}", i, 9 * DAY + i))
        store.append("audit_events", spark.createDataFrame(rows[-1:], vault.SCHEMAS["audit_events"]).coalesce(1))
    assert sorted(tuple(r) for r in store.read("audit_events").collect()) == sorted(rows)
    assert len(store._manifest()[1]["tables"]["audit_events"]) < 4
    assert len(glob.glob(f"{tmp_path}/vault/audit_events/p-*")) <= 4 + 4 + vault.KEPT and len(glob.glob(f"{tmp_path}/vault/_manifests/*.json")) <= vault.KEPT + 1
    stray = f"{tmp_path}/vault/audit_events/p-{uuid.uuid4().hex}"
    os.makedirs(stray)
    assert store.vacuum(3600) == 0 and store.vacuum(-10) >= 1 and not os.path.exists(stray) and store.read("audit_events").count() == 26
    store.append("sessions", spark.createDataFrame([], vault.SCHEMAS["sessions"]))
    assert store.read("sessions").count() == 0


def test_one_commit_holds_mappings_detections_and_audit(spark, tmp_path, monkeypatch):
    policy = uniform("tokenize", ("EMAIL_ADDRESS", "IP_ADDRESS"))
    s = shield.Shield(spark, policy, KEY, store_at(spark, tmp_path), found=[RegexDetector(), ModelDetector("m", lambda t: [][1] if "boom" in t else [], {})])
    session = s.create_session(now=0)
    df = spark.createDataFrame([(1, session, "a@post.example, a@post.example and 10.1.2.3"), (2, session, None), (3, session, "boom"), (4, "nobody", "b@post.example")], DOCS)
    number = s.vault._manifest()[0]
    shown = {r.id: r.protected_text for r in s.protect(df, "t", "id", now=5)[0].collect()}
    assert s.vault._manifest()[0] == number + 1 and shown[2] is None and shown[3] is None and shown[4] is None and "post.example" not in shown[1]
    found = s.vault.read("detections").collect()
    ids = {r.id: r.replacement for r in s.vault.read("mappings").collect()}
    assert sorted((r.entity_type, r.start_offset, r.end_offset, r.action) for r in found) == [("EMAIL_ADDRESS", 0, 14, "tokenize"), ("EMAIL_ADDRESS", 16, 30, "tokenize"), ("IP_ADDRESS", 35, 43, "tokenize")]
    assert {r.mapping_id for r in found} == set(ids) and all(t in shown[1] for t in ids.values()) and {r.expires_at for r in found} == {5 + policy.audit_retention_seconds}
    events = sorted((r.outcome, str(r.session_id), json.loads(r.detail_json).get("detections"), json.loads(r.detail_json).get("reason")) for r in s.vault.read("audit_events").collect())
    assert set(events) == {("blocked", "None", None, "unknown or expired session"), ("blocked", session, None, "protection failed"), ("protected", session, 0, None), ("protected", session, 3, None)} and len(events) == 4
    assert {(r.entity_type, r.n) for r in s.summary(session, now=6).collect()} == {("EMAIL_ADDRESS", 2), ("IP_ADDRESS", 1)}
    with pytest.raises(KeyError):
        s.summary("nobody", now=6)

    def fail(*_):
        raise OSError("disk")

    monkeypatch.setattr(s.vault, "_commit", fail)
    with pytest.raises(OSError):
        s.protect(df, "t", "id", now=6)
    monkeypatch.undo()
    assert s.vault.read("mappings").count() == 2 and s.vault.read("detections").count() == 3 and s.vault.vacuum(-10) == 0


def test_rules_that_cannot_be_reversed_are_recorded_too(spark, tmp_path):
    s = shield.Shield(spark, uniform("redact", ("EMAIL_ADDRESS",)), None, store_at(spark, tmp_path))
    session = s.create_session(now=0)
    shown, mappings = s.protect(spark.createDataFrame([(1, session, "to a@post.example")], DOCS), "t", "id", now=1)
    assert mappings is None and [r.protected_text for r in shown.collect()] == ["to [REDACTED:EMAIL_ADDRESS]"]
    row = s.vault.read("detections").first()
    assert (row.action, row.mapping_id, row.start_offset) == ("redact", None, 3) and s.vault.read("audit_events").first().outcome == "protected"


def test_sessions_are_kept_apart(spark, tmp_path):
    s = shield.Shield(spark, MAIL, KEY, store_at(spark, tmp_path))
    one, two = s.create_session(now=0), s.create_session(now=0)
    protect_one(s, one, "ann@post.example", 1)
    spans = spark.createDataFrame([(two, "EMAIL_ADDRESS", "bob@post.example")], "session_id string, entity string, value string")
    given = s.vault.allocate(spans, MAIL, KEY, 2)
    assert [(r.session_id, r.value) for r in given.collect()] == [(two, "bob@post.example")]
    plan = given._jdf.queryExecution().optimizedPlan().toString()
    assert "decrypt" not in plan.lower()
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    held = [open(f, "rb").read() for f in glob.glob(f"{folder}/**/part-*", recursive=True)]
    assert not any(b"bob@post.example" in h for h in held)  # the span table is given here: what is checkpointed is the vault's own
    asked = spark.createDataFrame([(one, "EMAIL_ADDRESS", "ann@post.example"), (two, "EMAIL_ADDRESS", "ann@post.example"), (two, "EMAIL_ADDRESS", "bob@post.example")], spans.schema)
    assert {(r.session_id, r.value): r.mapping_id is not None for r in s.vault.find(asked, KEY, 3).collect()} == {(one, "ann@post.example"): True, (two, "ann@post.example"): False, (two, "bob@post.example"): True}
    token = given.first().replacement
    other = spark.createDataFrame([(1, one, token), (2, two, token.lower())], DOCS)
    back = s.restore(other, "t", "id", now=4)
    assert {r.id: r.restored for r in back.collect()} == {1: token, 2: "bob@post.example"}
    lines = back._jdf.queryExecution().optimizedPlan().toString().lower().splitlines()
    assert any("decrypt" in line for line in lines) and not any("parquet" in line for line in lines)  # opened: only what the tokens hit


def test_a_writer_that_was_second_tries_again(spark, tmp_path):
    store, other = store_at(spark, tmp_path), store_at(spark, tmp_path)
    rows = spark.createDataFrame([("s1", "{}", None, 1, 10)], vault.SCHEMAS["sessions"])
    store.append("sessions", rows)
    seen, real, asked = other._manifest(), other._manifest, []
    other._manifest = lambda: asked.append(1) or (seen if len(asked) == 1 else real())
    store.append("sessions", rows)
    other.append("sessions", rows)
    assert store.read("sessions").count() == 3
    s = shield.Shield(spark, MAIL, KEY, store)
    session = s.create_session(now=0)
    mark = store.mark()
    protect_one(s, session, "ann@post.example", 1)
    with pytest.raises(vault.Conflict):
        store.append_all({"audit_events": store.read("audit_events")}, mark)
    assert store.read("audit_events").count() == 1


@pytest.fixture
def database(spark, tmp_path):
    url = f"jdbc:derby:memory:v{uuid.uuid4().hex}"
    store = vault_jdbc.JdbcVault(spark, url + ";create=true", driver="org.apache.derby.jdbc.EmbeddedDriver")
    store.create()
    return store


def test_a_database_allocates_purges_and_deletes(spark, database):
    s = shield.Shield(spark, MAIL, KEY, database)
    one, two = s.create_session({"a": "b"}, now=0), s.create_session(now=0)
    first = protect_one(s, one, "ann@post.example", 1).protected_text
    assert protect_one(s, one, "ann@post.example", 2).protected_text == first and database.read("mappings").count() == 1
    protect_one(s, two, "ann@post.example", 3)
    assert database.read("mappings").count() == 2 and database.read("detections").count() == 3 and database.read("audit_events").count() == 3
    shown = spark.createDataFrame([(1, one, first)], DOCS)
    assert [r.restored for r in s.restore(shown, "t", "id", now=4).collect()] == ["to ann@post.example"]
    assert database.delete(one) and not database.delete(one)
    assert {r.session_id for r in database.read("detections").collect()} == {two} and sorted(str(r.session_id) for r in database.read("audit_events").collect()) == sorted(["None"] * 3 + [two])
    again = protect_one(s, two, "ann@post.example", 3 + DAY).protected_text
    assert database.read("mappings").count() == 1 and again != first and [r.mapping_id is None for r in database.read("detections").orderBy("created_at").collect()] == [True, False]
    assert database.purge(3 + 2 * DAY) == {"audit_events": 0, "detections": 0, "mappings": 1, "sessions": 0}
    assert database.purge(31 * DAY)["sessions"] == 1 and all(database.read(n).count() == 0 for n in ("sessions", "mappings"))


def test_a_failure_in_between_loses_nothing(spark, database, monkeypatch):
    s = shield.Shield(spark, MAIL, KEY, database)
    session = s.create_session(now=0)
    protect_one(s, session, "ann@post.example", 1)
    before = {n: sorted(map(repr, database.read(n).collect())) for n in vault.SCHEMAS}
    real = database._transaction

    def broken(work):
        def stop(run):
            def some(statement, values=()):
                if statement.startswith(("INSERT INTO audit_events", "DELETE FROM sessions")):
                    raise OSError("lost")
                return run(statement, values)

            return work(some)

        return real(stop)

    monkeypatch.setattr(database, "_transaction", broken)
    for change in (lambda: protect_one(s, session, "bob@post.example", 2), lambda: database.purge(99 * DAY), lambda: database.delete(session)):
        with pytest.raises(OSError):
            change()
    monkeypatch.undo()
    assert {n: sorted(map(repr, database.read(n).collect())) for n in vault.SCHEMAS} == before
    rows = spark.createDataFrame([("x", session, "EMAIL_ADDRESS", r.original_hmac, b"x", "other", "tokenize", 2, 99 * DAY) for r in database.read("mappings").collect()], vault.SCHEMAS["mappings"])
    with pytest.raises(vault.Conflict):
        database.append("mappings", rows)
    assert database.read("mappings").count() == 1


def test_each_row_is_under_its_own_sessions_policy(spark, tmp_path):
    policies = {"a": uniform("tokenize", ("EMAIL_ADDRESS",)), "b": uniform("label"), "c": Policy("own", (Rule("ORGANIZATION", "redact"), Rule("EMAIL_ADDRESS", "synthetic", reversible=True, priority=-1)), 3, ("IGNORE@post.example",), {"a.b|c\\E(": "ORGANIZATION", "ne": "ORGANIZATION"}), "d": uniform("redact", required_detectors=("absent",)), "e": uniform("keep")}
    s = shield.Shield(spark, None, KEY, store_at(spark, tmp_path))
    ids = {n: s.create_session(now=0, policy=p) for n, p in policies.items()}
    text = "Ann ne A.B|c\\e( x@post.example ignore@post.example 10.1.2.3"
    df = spark.createDataFrame([(i, ids.get(n, "nobody"), text) for i, n in enumerate("abcdef")] + [(9, ids["a"], None)], DOCS)
    shown = {r.id: r.protected_text for r in s.protect(df, "t", "id", now=1)[0].collect()}
    alone = {n: [r.protected.text for r in protect.protect(df.where("id = 0"), "t", p, key=KEY).collect()][0] for n, p in policies.items() if n in "be"}
    assert shown[1] == alone["b"] and shown[4] == text == alone["e"] and (shown[3], shown[5], shown[9]) == (None, None, None)
    assert shown[0].startswith("Ann ne A.B|c\\e( [[PG1|EMAIL_ADDRESS|") and shown[0].endswith("]] 10.1.2.3")
    one, two, three, rest = shown[2].split(" ", 3)
    assert (one, two, three) == ("Ann", "[REDACTED:ORGANIZATION]", "[REDACTED:ORGANIZATION]") and rest.endswith(" ignore@post.example 10.1.2.3") and rest.startswith("person") and "[[PG1|" in rest
    kept = {(r.policy_name, r.policy_version, r.entity_type, r.action, r.mapping_id is None) for r in s.vault.read("detections").collect()}
    assert ("own", 3, "EMAIL_ADDRESS", "synthetic", False) in kept and ("own", 3, "ORGANIZATION", "redact", True) in kept and ("uniform-label", 1, "IP_ADDRESS", "label", True) in kept
    back = s.restore(spark.createDataFrame([(i, ids[n], shown[i]) for i, n in ((0, "a"), (2, "c"))], DOCS), "t", "id", now=2)
    assert {r.id: r.restored for r in back.collect()} == {0: text, 2: text.replace(" ne A.B|c\\e(", " [REDACTED:ORGANIZATION] [REDACTED:ORGANIZATION]")}
    keyless = shield.Shield(spark, None, None, s.vault)
    assert {r.id: r.protected_text is None for r in keyless.protect(df, "t", "id", now=3)[0].collect()} == {0: True, 1: False, 2: True, 3: True, 4: False, 5: True, 9: True}
