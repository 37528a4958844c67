from __future__ import annotations

import hashlib
import zlib

from conftest import table
from pyspark.sql import functions as F

from shieldframe.llm import media


def feature(p):
    x = [b - 128 for b in p]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
    return f"mean={round(1000 * sum(x) / len(x))};rms={round(1000 * (sum(v * v for v in x) / len(x)) ** 0.5)};crossings={crossings};peak={max(map(abs, x))}"


def check(df):
    got = media.store_and_describe(df).collect()
    src = df.select("doc_id", "text").collect()
    want = []
    for r in src:
        b = (r.text or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        want.append((r.doc_id or -1, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p) + 60, hashlib.sha256(media.wav(p, len(b))).hexdigest(), feature(p)))
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in got) == sorted(want)


def test_documents_come_back(spark):
    check(table(spark, "documents"))


def test_odd_rows(spark):
    long = "word " * 40_000
    check(spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x" * 64, 1), (4, "é" * 33, 1), (5, long, 1), (6, long + "tail", 1), (6, long + "tail", 1), (None, "q", 1)], "doc_id long, text string, n_bytes int"))
    assert media.store_and_describe(table(spark, "documents").where(F.lit(False))).count() == 0


def test_shared_chunks_are_stored_once(spark):
    import random

    rng = random.Random(1)
    common = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    df = spark.createDataFrame([(i, f"head {i} " + common) for i in range(20)], "doc_id long, text string")
    clips, store = media.write_clips(df)
    assert store.count() == store.select("digest").distinct().count()
    inline = clips.select(F.explode("chunks").alias("c")).agg(F.sum(F.octet_length("c.data"))).first()[0] or 0
    assert inline + store.agg(F.sum(F.octet_length("data"))).first()[0] < 4 * len(common)


def test_a_chunk_that_half_of_all_places_name(spark, monkeypatch):
    monkeypatch.setattr(media, "HOT_REFS", 7)
    check(spark.createDataFrame([(i, ("same " * 8000 if i % 2 else f"own {i} " * 300)) for i in range(60)], "doc_id long, text string"))


def test_cuts_follow_content():
    import random

    rng = random.Random(2)
    body = bytes(rng.randrange(256) for _ in range(60_000))
    a, b = media.cuts([body, b"prefix" + body])
    assert a[-1] == len(body) and {x + 6 for x in a[3:]} <= set(b) and max(y - x for x, y in zip([0, *a], a, strict=False)) <= media.MOST_CHUNK
