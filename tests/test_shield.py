from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from shieldframe.functions import actions
from shieldframe.functions.recognizers import ModelDetector, RegexDetector
from shieldframe.operators import protect, reports, restore, shield, synthesis, vault
from shieldframe.policy import Blocked, uniform
from shieldframe.sources import tables
from shieldframe.streaming import protect as streams

KEY = bytes(range(32))
MAIL = "ann@post.example"


def test_plain_surfaces_tokens_and_shown_values_in_one_pass(spark):
    token = "[[PG1|PERSON|" + "A" * 26 + "|" + "B" * 16 + "]]"
    reverse = {token: "Ann", "Bo": "Robert", "Bob": "Rob [", "x.y\\E": "dots", f"Mr Z {token.replace('A' * 26, 'C' * 26)}": "Zoe"}
    text = f"Bob and Bo met {token.lower()}, x.y\\E; mr z {token.replace('A' * 26, 'C' * 26)} Bob"
    df = spark.createDataFrame([(text, reverse), ("Bob", reverse), ("none", reverse), ("Bob", None), (None, reverse), ("Bob", {})], "t string, m map<string,string>")
    got = [r[0] for r in df.select(restore.restore(F.col("t"), F.col("m"))).collect()]
    assert got == ["Rob [ and Robert met Ann, dots; Zoe Rob [", "Rob [", "none", "Bob", None, "Bob"]


def test_a_failing_detector_blocks_its_rows_only(spark):
    def model(text):
        if "boom" in text:
            raise RuntimeError("no")
        return [(text.index("Zoë"), text.index("Zoë") + 3, "PER", 0.9)] if "Zoë" in text else []

    df = spark.createDataFrame([(1, f"é Zoë {MAIL}"), (2, f"boom {MAIL}"), (3, None), (4, "plain")], "id int, t string")
    found = [RegexDetector(), ModelDetector("model", model, {"PER": "PERSON"})]
    got = {r.id: r.protected for r in protect.protect(df, "t", uniform("label"), found=found).collect()}
    assert got[1].text == "é <PERSON> <EMAIL_ADDRESS>" and (got[3].state, got[3].text, got[4].text) == ("protected", None, "plain")
    assert (got[2].state, got[2].text, got[2].reason) == ("blocked", None, "protection failed")


def test_hashes_without_a_key_agree_within_a_call_and_cannot_be_looked_up(spark):
    df = spark.createDataFrame([(1, MAIL), (2, MAIL)], "id int, t string")
    one = protect.protect(df, "t", uniform("hash"))
    texts = {r.protected.text for r in one.collect()}
    other = protect.protect(df, "t", uniform("hash")).first().protected.text
    assert len(texts) == 1 and other not in texts
    with pytest.raises(ValueError):
        actions.keyed_digest(None, "PERSON", F.lit("x"))


def test_shield_with_a_vault_reuses_replacements(spark, tmp_path):
    policy = uniform("tokenize", ("EMAIL_ADDRESS",))
    s = shield.Shield(spark, policy, KEY, vault.open_vault(spark, f"file://{tmp_path}/vault"))
    session = s.create_session(now=0)
    df = spark.createDataFrame([(1, session, f"a {MAIL}"), (2, session, f"{MAIL} b")], "id int, session_id string, t string")
    first = {r.id: r.protected_text for r in s.protect(df, "t", "id", now=1)[0].collect()}
    shown, _ = s.protect(df, "t", "id", now=2)
    assert {r.id: r.protected_text for r in shown.collect()} == first and first[1][2:] == first[2][:-2] and MAIL not in first[1]
    assert {r.id: r.restored for r in s.restore(shown, "protected_text", "id", now=3).collect()} == {1: f"a {MAIL}", 2: f"{MAIL} b"}
    sealed = shown.withColumn("c", restore.seal(F.create_map(F.regexp_extract("protected_text", actions.TOKEN, 0), F.lit(MAIL)), KEY, F.col("session_id")))
    assert {r.restored for r in s.restore_capsule(sealed, "protected_text", "c", F.col("session_id")).collect()} == {f"a {MAIL}", f"{MAIL} b"}
    with pytest.raises(Blocked):
        shield.Shield(spark, policy).protect(df, "t", "id")
    row = shield.probes(spark, KEY).first()
    assert all(row) and len(row) == 5


def test_allocation_gives_up_after_collisions(spark, tmp_path, monkeypatch):
    policy, store = uniform("tokenize", ("EMAIL_ADDRESS",)), vault.open_vault(spark, f"file://{tmp_path}/vault")
    tries = []

    def collide(*_):
        tries.append(1)
        raise vault.MappingCollision("taken")

    monkeypatch.setattr(store, "store", collide)
    spans = spark.createDataFrame([("s", "EMAIL_ADDRESS", MAIL)], "session_id string, entity string, value string")
    with pytest.raises(Blocked):
        store.allocate(spans, policy, KEY, 0)
    assert len(tries) == vault.MOST_TRIES


def test_streams_by_micro_batch_keep_their_mappings(spark, tmp_path):
    policy = uniform("tokenize", ("EMAIL_ADDRESS",))
    s = shield.Shield(spark, policy, KEY, vault.open_vault(spark, f"file://{tmp_path}/vault"))
    session = s.create_session(now=0)
    schema = "id int, session_id string, t string"
    for i in range(2):
        spark.createDataFrame([(i, session, f"{i} {MAIL}")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.protect_stream(stream, "t", "id", s, f"{tmp_path}/out", f"{tmp_path}/ck", purge=True, now=lambda: 5).awaitTermination(120)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.id for r in rows) == [0, 1] and len({r.protected_text[2:] for r in rows}) == 1 and len({r.batch for r in rows}) == 2
    assert s.vault.read("mappings").count() == 1
    plain = streams.protected(stream, "t", uniform("label"))
    q = plain.select("id", "protected.text").writeStream.format("memory").queryName("labels").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck2").start()
    q.awaitTermination(120)
    assert sorted(r.text for r in spark.table("labels").collect()) == ["0 <EMAIL_ADDRESS>", "1 <EMAIL_ADDRESS>"]


def test_quality_report(spark):
    c = synthesis.ColumnSpec
    spec = synthesis.TableSpec("t", (c("n", "float"), c("seg", "category", nullable=True, categories=("a", "b"), weights={"a": 0.5, "b": 0.5}), c("gone", "text")))
    real = spark.createDataFrame([(1.5, "a"), (3.5, "b")], "n double, seg string")
    made = spark.createDataFrame([("2", "a"), ("x", "c"), ("", ""), ("4", "a")], "n string, seg string")
    rows = {r.column: r for r in synthesis.quality_report(real, made, spec).collect()}
    assert (rows["n"].synthetic_null_rate, rows["n"].synthetic_type_valid_rate, rows["n"].normalized_mean_delta) == (0.25, 0.5, 0.25)
    seg = rows["seg"]
    assert (seg.synthetic_type_valid_rate, seg.category_coverage, seg.category_total_variation) == (0.75, 0.5, round((abs(0.5 - 2 / 3) + 0.5 + 1 / 3) / 2, 6))
    assert rows["gone"].source_null_rate == 1.0 and rows["gone"].synthetic_type_valid_rate == 0.0
    assert synthesis.quality_report(real, made.limit(0), spec).first().status == "not_evaluable"


def test_reports_and_arrays(spark, tmp_path):
    df = spark.createDataFrame([("é<", 1, None)], "a string, b int, c string")
    tables.write_report(df, f"{tmp_path}/r", "scores")
    assert json.loads((tmp_path / "r" / "scores.json").read_text()) == [{"a": "é<", "b": 1, "c": None}]
    assert (tmp_path / "r" / "scores.csv").read_text().splitlines() == ["a,b,c", "é<,1,"] and "é&lt;" in (tmp_path / "r" / "scores.html").read_text()
    with pytest.raises(FileExistsError):
        tables.write_report(df, f"{tmp_path}/r", "scores")
    with pytest.raises(ValueError):
        tables.write_report(df.union(df), f"{tmp_path}/r2", "scores", most_rows=1)
    (tmp_path / "ok.json").write_text('[{"a": 1}, {"b": "x"}]')
    assert tables.read(spark, str(tmp_path / "ok.json")).count() == 2
    for i, bad in enumerate(['{"a": 1}', "[1]", "[{}, 2]", "nope"]):
        (tmp_path / f"bad{i}.json").write_text(bad)
        with pytest.raises(ValueError):
            tables.read(spark, str(tmp_path / f"bad{i}.json"))
    rows = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "a"), ("y", "b")], "case string, outcome string")
    assert {r.case: r.stable for r in reports.stability(rows, "case", "outcome").collect()} == {"x": True, "y": False}
    assert reports.default_quasi(["id", "a", "b", "c", "d"], ["id"]) == ["a", "b", "c"]


def test_keys_from_the_environment(monkeypatch):
    monkeypatch.setenv("A_TEST_KEY", actions.encode_key(KEY))
    assert actions.key_from_environment("A_TEST_KEY") == KEY and actions.key_from_environment("NO_SUCH_KEY") is None
