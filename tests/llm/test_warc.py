from __future__ import annotations

import hashlib

from conftest import table
from pyspark.sql import functions as F

from shieldframe.llm import warc
from shieldframe.llm.scratch import new_path


def want(rows):
    digest = {}
    for p, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and p is not None:
            digest[b] = max(digest.get(b, p), p)
    out = []
    for p, h in rows:
        b = (h or "").encode()
        last = digest.get(b)
        again = last is not None and last != p
        out.append((-1 if p is None else p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


def read(df):
    return sorted(((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_and_read(df).collect()), key=str)


def test_pages(spark):
    pages = table(spark, "pages")
    assert read(pages) == want([(r.page_id, r.html) for r in pages.collect()])


def test_long_payloads_and_tied_keys(spark):
    big = "<p>é word</p>" * 200_000
    rows = [(i, "http://same.example/x", big if i < 3 else f"{i}") for i in range(6)] + [(4, "http://same.example/x", "4")] * 2
    assert read(spark.createDataFrame(rows, "page_id long, url string, html string")) == want([(r[0], r[2]) for r in rows])


def test_revisits_and_odd_rows(spark):
    big = "<p>é</p>" * 200
    rows = [(1, "http://A.example:80/x", big), (2, None, big), (9, "https://b.example/\n q?x=1", big), (3, "no host", "small"), (4, "", "small"), (5, "http://u@c.example:8080", None), (6, "http://a.example/x", big + "x"), (6, "http://a.example/x", big + "x"), (None, "http://z", big)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    assert read(df) == want([(r[0], r[2]) for r in rows])
    assert read(df.limit(0)) == []


def test_a_payload_that_half_of_all_pages_share(spark):
    rows = [(i, f"http://h{i % 9}.example/{i}", "<p>same</p>" * 200 if i % 2 else f"<p>{i}</p>" * 200) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert read(df) == want([(r[0], r[2]) for r in rows])


def test_keys_and_lookups(spark):
    assert warc.url_key("https://Blog.Example.com:443/a b#c") == "com,example,blog)/a%20b#c"
    assert warc.url_key("http://h:81") == "h:81)/" and warc.url_key(None) == ")/"
    pages = table(spark, "pages").limit(60)
    folder = new_path(spark, "warc-test")
    parts = warc.write_index(warc.write_archives(pages, folder), folder)
    some = pages.where("page_id % 7 = 0")
    got = {r.page_id: bytes(r.payload).decode() for r in warc.lookup(warc.request_keys(some), folder, parts).collect()}
    assert got == {r.page_id: r.html for r in some.collect()}
    none = spark.createDataFrame([("zz,none)/ 1",)], "key string")
    assert warc.lookup(none, folder, parts).count() == 0 and parts.agg(F.sum("blocks")).first()[0] >= 1
