from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from shieldframe.functions import recognizers
from shieldframe.functions.recognizers import DenyListDetector
from shieldframe.operators import protect, resolve
from shieldframe.policy import ENTITIES, Policy, Rule, preset, uniform


def found(spark, texts, policy, **options):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    spans = protect.detect(F.col("t"), policy, **options)
    got = {r.i: [(s.entity, s.start, s.end, s.value) for s in r.s] for r in rows.select("i", spans.alias("s")).collect()}
    return [got[i] for i in range(len(texts))]


def test_goldens(spark):
    got = found(
        spark,
        ["Zoë: zoe@example.com / 4111 1111 1111 1111", "4111 1111 1111 1112 then 123456789", "DE89370400440532013000 2001:db8::1 https://example.com/a", "http://user:pw@example.com/", None, ""],
        uniform("redact"),
    )
    assert got[0] == [("EMAIL_ADDRESS", 6, 21, "zoe@example.com"), ("CREDIT_CARD", 24, 43, "4111 1111 1111 1111")]
    assert got[1] == [("PHONE_NUMBER", 0, 14, "4111 1111 1111"), ("US_SSN", 25, 34, "123456789")]
    assert got[2] == [("IBAN_CODE", 0, 22, "DE89370400440532013000"), ("IP_ADDRESS", 23, 34, "2001:db8::1"), ("URL", 35, 56, "https://example.com/a")]
    assert not [s for s in got[3] if s[0] == "URL"]
    assert got[4] == got[5] == []


#: The same languages in Python's dialect.
PYTHON = {
    "PHONE_NUMBER": r"(?<!\d)(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{4}(?!\d)",
    "US_SSN": r"(?<!\d)(?!000|666|9\d\d)\d{3}([- ]?)(?!00)\d{2}\1(?!0000)\d{4}(?!\d)",
    "DATE_TIME": r"(?<!\d)(?:20\d{2}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]20\d{2})(?!\d)",
    "MONEY": r"(?i)(?<!\w)(?:[$€£]\s?\d[\d ,.]*\d|[$€£]\s?\d|\d[\d ,.]*\d\s?(?:USD|EUR|GBP)|\d\s?(?:USD|EUR|GBP))(?!\w)",
    "URL": r"(?i)(?<!\w)https?://[^\s<>\"']+",
}


def test_patterns_agree_with_python_on_random_texts(spark):
    rng = random.Random(7)
    parts = ["+1 202 555 0123", "123-45-6789", "2024-05-06", "$1,234.50", "5 EUR", "https://a.b/c", "é", " ", "²", "_", " ", "-", ".", "9", "٣", "x", "́", "\n", "\x1c", "€", "漢", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in recognizers.RECOGNIZERS:
        if r.entity not in PYTHON:
            continue
        spans = recognizers.matches(F.col("t"), r.pattern, r.entity, 1, "x")
        if r.gate:
            spans = F.when(recognizers.GATES[r.gate](F.col("t")), spans).otherwise(F.array().cast(recognizers.SPANS))
        got = {row.i: [(s.start, s.end) for s in row.s] for row in df.select("i", spans.alias("s")).collect()}
        for i, t in enumerate(texts):
            want = [(len(t[: m.start()].encode()), len(t[: m.end()].encode())) for m in re.finditer(PYTHON[r.entity], t)]
            assert got[i] == want, (r.entity, t)


def test_precedence_scopes_allow_and_deny(spark):
    base = Policy("p", (Rule("EMAIL_ADDRESS", "redact"), Rule("PERSON", "label", priority=5)), allow_terms=("OK@Example.com",), deny_terms={"bob": "PERSON"})
    got = found(spark, ["bob@example.com and ok@example.com, Bob"], base)
    assert got == [[("PERSON", 0, 3, "bob"), ("PERSON", 36, 39, "Bob")]]
    scoped = Policy("p", (Rule("EMAIL_ADDRESS", "redact", scopes=("body",)),))
    assert found(spark, ["a@example.com"], scoped, scope="body")[0] and not found(spark, ["a@example.com"], scoped, scope="json:/x")[0]
    rows = spark.createDataFrame([("a@example.com",)], "t string").select(protect.trace(F.col("t"), scoped, "other").alias("d")).first()
    assert [d.outcome for d in rows.d] == ["scope_not_claimed"]
    low = Policy("p", (Rule("EMAIL_ADDRESS", "redact", minimum_confidence_ppm=995_000),), allow_terms=("a@example.com",))
    rows = spark.createDataFrame([("a@example.com",)], "t string").select(protect.trace(F.col("t"), low).alias("d")).first()
    assert [d.outcome for d in rows.d] == ["below_confidence"]


def test_accepted_spans_are_disjoint_and_the_rest_is_unchanged(spark):
    rng = random.Random(3)
    parts = ["4111 1111 1111 1111", "123-45-6789", "a@b.example", "192.0.2.7", "+1 202 555 0123", " ", "é", "12", "word", "2024-01-02", "$5", "😀"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in protect.protect(df, "t", uniform("label")).select("t", "protected").collect():
        raw, at, out = r.t.encode(), 0, b""
        for s in r.protected.detections:
            assert s.start >= at and s.end > s.start and raw[s.start : s.end].decode() == s.value
            out += raw[at : s.start] + s.replacement.encode()
            at = s.end
        assert (out + raw[at:]).decode() == r.protected.text


def test_policies():
    assert {p: len(preset(p).rules) for p in ("balanced", "STRICT")} == {"balanced": len(ENTITIES), "STRICT": len(ENTITIES)}
    assert preset("balanced").rule("URL").action == "keep" and not preset("balanced").rule("URL").active
    assert preset("healthcare").rule("PERSON").reversible and preset("strict").rule("PERSON").minimum_confidence_ppm == 650_000
    for bad in (lambda: Rule("EMAIL_ADDRESS", "redact", reversible=True), lambda: Rule("X"), lambda: preset("none"), lambda: Policy("p", (Rule("URL"), Rule("URL"))), lambda: Policy("p", (), deny_terms={"": "URL"})):
        with pytest.raises(ValueError):
            bad()


def test_missing_detector_or_key_blocks(spark):
    df = spark.createDataFrame([("a@example.com",)], "t string")
    strict = Policy("p", (Rule("EMAIL_ADDRESS", "redact", required_detectors=("model",)),))
    row = protect.protect(df, "t", strict).first().protected
    assert row.state == "blocked" and row.text is None and "model" in row.reason
    assert protect.protect(df, "t", preset("balanced")).first().protected.state == "blocked"


def test_many_terms_by_automaton_are_what_patterns_find(spark):
    import random

    rng = random.Random(4)
    parts = ["a", "A", "b", "é", "É", "ß", "ſ", "K", "k", "İ", "i", ".", "|", "\\E", " ", "ab", "😀", "σ", "ς", "Σ"]
    terms = {"".join(rng.choice(parts) for _ in range(rng.randint(1, 4))): rng.choice(("PERSON", "URL")) for _ in range(60)}
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    many, names = DenyListDetector(terms), list(terms)
    got = {r.id: sorted(map(tuple, r.s)) for r in df.select("id", many.spans(F.coalesce("t", F.lit("")), ["PERSON", "URL"]).alias("s")).collect()}
    want = {i: [] for i in got}
    for k in range(0, len(names), 12):
        few = DenyListDetector({n: terms[n] for n in names[k : k + 12]})
        for r in df.select("id", few.spans(F.coalesce("t", F.lit("")), ["PERSON", "URL"]).alias("s")).collect():
            want[r.id] += map(tuple, r.s)
    assert got == {i: sorted(v) for i, v in want.items()}


def test_allowed_terms_fold_as_unicode_does(spark):
    odd = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and c.casefold() != c.lower()]
    values = [*odd, "Straße", "STRASSE", "ΣΊΣΥΦΟΣ", "ﬁsh", "İstanbul", "plain ASCII", "", "a\nÉ😀"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r.v: r.f for r in df.select("v", resolve.fold_case(F.col("v")).alias("f")).collect()} == {v: v.casefold() for v in values}


def test_many_terms_are_looked_for_once(spark):
    terms = {f"w{i}": ("PERSON", "URL")[i % 2] for i in range(40)}
    df = spark.createDataFrame([(1, "é W1w2 " * 20_000), (2, ""), (3, None)], "id int, t string")
    found = df.select("id", DenyListDetector(terms).spans(F.coalesce("t", F.lit("")), ["PERSON", "URL"]).alias("s")).where("size(s) > 0")
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("EvalPython") == 1  # a filter on the spans must not find them again
    row = found.collect()
    assert [r.id for r in row] == [1] and len(row[0].s) == 40_000
    assert [tuple(x) for x in row[0].s[-2:]] == [(159_995, 159_997, "URL", 1_000_000, "deny-list", "W1"), (159_997, 159_999, "PERSON", 1_000_000, "deny-list", "w2")]


def test_one_pass_of_a_pattern_finds_what_two_do(spark):
    import random

    rng = random.Random(9)
    parts = ["\0", "\x01", "12", "3", "٣", " ", "-", ".", ":", "a@b.co", "é", "😀", "$", "1,2", "EUR", "http://x.y/\0z", "DE", "89 3704 0044 0532 0130 00", "4111 1111 1111 1111", "::1", "127.0.0.1", "sk-" + "a" * 16, "2024-01-02", "021000021", "ſ", "x", "_", "(202) 555-0100", "219-09-9999"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for r in recognizers.RECOGNIZERS:
        old = re.sub(r"\(\?=(?:\[(?:\\.|[^\]\\])*\]|\\d|h)\)", "", r.pattern).replace("}+@", "}@")
        two = recognizers._checked(recognizers.matches(F.col("t"), old, r.entity, recognizers.REGEX_CONFIDENCE, "regex-v1"), r)
        one = recognizers.RegexDetector().spans(F.col("t"), [r.entity])
        assert old != r.pattern and df.where(~two.eqNullSafe(one)).count() == 0, r.entity


def test_made_records_are_dealt_to_all_cores(spark):
    from shieldframe.plans import catalog

    cores = spark.sparkContext.defaultParallelism
    assert catalog.queries()["detect_records"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * cores


def test_policies_go_to_the_rows(spark):
    rows = spark.range(100).withColumn("preset", F.when(F.col("id") < 99, "strict").otherwise("none"))
    joined = protect.with_policies(rows, {"strict": preset("strict"), "balanced": preset("balanced")}, "preset")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert joined.groupBy(F.col("policy.name").alias("n")).count().orderBy("n").collect() == [(None, 1), ("strict", 99)]


def test_folded_names_are_dealt_and_long_texts_fold(spark):
    from shieldframe.plans import catalog

    names = catalog.queries()["folded_names"](spark, "/root/testdata/sf0.001")
    assert names.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert "from_json" not in names._jdf.queryExecution().toString()  # the table is not read again for each character
    text = "Éa😀ẞﬃİ\n" * 2_000
    assert spark.createDataFrame([(text,)], "t string").select(resolve.fold_case(F.col("t"))).first()[0] == text.casefold()


@pytest.mark.parametrize("name", ["capsules", "synthetic_checks", "synthetic_keys", "iban_valid"])
def test_short_rows_that_take_long_are_dealt(spark, name):
    from shieldframe.plans import catalog

    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_responses_are_not_sent_to_a_task_by_event_type(spark, monkeypatch):
    from shieldframe.plans import catalog

    given = []
    monkeypatch.setattr(catalog.providers, "restore_responses", lambda df, *a: given.append(df) or df.select("event_id", F.lit("").alias("state"), F.lit("").alias("reason"), "body"))
    catalog.queries()["provider_responses"](spark, "/root/testdata/sf0.001")
    plan = given[0]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and given[0].rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
