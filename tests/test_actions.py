from __future__ import annotations

import base64
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from shieldframe.functions import actions, checks
from shieldframe.operators import protect, restore
from shieldframe.policy import uniform

KEY = bytes(32)


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


def test_goldens(spark):
    e = F.lit("EMAIL_ADDRESS")
    assert one(spark, "alice@example.com", lambda v: actions.replacement("hash", e, v, KEY)) == "sha256:ab9ad7beed0b75ed6760ab307e6ba6d39a307501933493d0"
    assert one(spark, "alice@example.com", lambda v: actions.replacement("synthetic", e, v, KEY)) == "person27437@example.test"
    assert one(spark, "alice@example.com", lambda v: actions.generalize(e, v)) == "***@example.com"


def test_hmac_matches_python(spark):
    for key, text in ((b"k" * 32, "aé"), (bytes(range(32)), "")):
        got = one(spark, text, lambda v, key=key: actions.keyed_digest(key, "PERSON", v))
        assert got == hmac.new(key, b"PERSON\0" + text.encode(), hashlib.sha256).hexdigest()


@pytest.mark.parametrize(
    ("text", "power"),
    [("$1,284", 3), ("€1.284", 3), ("1,234,567 USD", 6), ("$0.99", 0), ("12,5 GBP", 1), ("€1.284,50", 3), ("€1 284,50", 3), ("1.284,50 EUR", 3), ("$007", 0), ("$5", 0), ("$12.345.678", 7)],
)
def test_money_magnitude(spark, text, power):
    assert one(spark, text, actions.money_magnitude) == power


def test_base32(spark):
    for n in (10, 16, 32):
        raw = hashlib.sha256(str(n).encode()).digest()[:n]
        assert one(spark, raw.hex(), lambda v, n=n: actions.base32(v, n)) == base64.b32encode(raw).decode().rstrip("=")


def test_digit_stream(spark):
    seed = 12345678901234567890
    more = int(hashlib.sha256(str(seed).encode()).hexdigest()[:16], 16)
    got = one(spark, str(seed), lambda v: actions.digit_stream(v.cast("decimal(38,0)"), 23))
    assert got == (f"{seed:020d}" + f"{more:020d}")[:23]


@pytest.mark.parametrize(("value", "ok"), [("2001:db8::1", True), ("::", True), ("1:2:3:4:5:6:7:8", True), ("1::2::3", False), (":1:2:3:4:5:6:7", False), ("1:2:3:4:5:6:7::", True), ("12345::", False), ("192.0.2.1", True), ("192.0.02.1", False), ("256.1.1.1", False)])
def test_ip(spark, value, ok):
    assert one(spark, value, checks.ip) is ok


@pytest.mark.parametrize(("value", "ok"), [("DE89370400440532013000", True), ("DE89 3704 0044 0532 0130 00", True), ("DE88370400440532013000", False), ("GB82WEST12345698765432", True), ("XX00", False)])
def test_iban(spark, value, ok):
    assert one(spark, value, checks.iban) is ok


@pytest.mark.parametrize(("value", "ok"), [("https://example.com/a", True), ("http://u@example.com", False), ("https:///x", False), ("http://[2001:db8::1]:80/", True), ("https://exämple.com", False), ("https://h:99/x@y", True)])
def test_url(spark, value, ok):
    assert one(spark, value, checks.url) is ok


def test_keys():
    assert actions.decode_key(actions.encode_key(KEY)) == KEY and len(actions.decode_key(actions.new_key())) == 32
    with pytest.raises(ValueError):
        actions.decode_key("AAAA")


def test_tokens_round_trip_and_are_tolerant(spark):
    df = spark.createDataFrame([(1, "s", "call a@example.com or a@example.com"), (2, "s", None), (3, "t", "a@example.com")], "id int, session_id string, t string")
    policy = uniform("tokenize", ("EMAIL_ADDRESS",))
    maps = protect.allocate(protect.span_table(df, ["session_id"], "t", policy), policy, KEY)
    assert maps.count() == 2
    again = protect.allocate(protect.span_table(df, ["session_id"], "t", policy), policy, KEY, known=maps)
    assert again.exceptAll(maps).count() == 0
    shown = protect.render(df, "t", policy, maps, KEY, row="id").cache()
    texts = {r.id: r.protected_text for r in shown.collect()}
    assert "example.com" not in texts[1] + texts[3] and texts[2] is None and texts[1][5:60] == texts[1].split(" or ")[1][:55]
    back = {r.id: r.restored for r in restore.restore_found(shown, "protected_text", maps, row="id").collect()}
    assert back == {1: "call a@example.com or a@example.com", 2: None, 3: "a@example.com"}
    loose = spark.createDataFrame([("t", texts[3].lower().replace("|", " | ").replace("[[", "[[ ").replace("]]", " ]]")), ("t", texts[3].replace("|", "  |")), ("t", "[[PG1|PERSON|" + "A" * 26 + "|" + "B" * 16 + "]]")], "session_id string, x string")
    got = {r.x: r.restored for r in restore.restore_found(loose, "x", maps, row="x").collect()}
    assert list(got.values()).count("a@example.com") == 1 and sum(k == v for k, v in got.items()) == 2


def test_capsule(spark):
    df = spark.createDataFrame([("s", {"t": "v"})], "s string, m map<string,string>").withColumn("c", restore.seal(F.col("m"), KEY, F.col("s")))
    row = df.select(restore.open_capsule(F.col("c"), KEY, F.col("s")).alias("a"), restore.open_capsule(F.col("c"), KEY, F.lit("x")).alias("b")).first()
    assert row.a == {"t": "v"} and row.b is None
