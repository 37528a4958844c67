from __future__ import annotations

import hashlib
import random
import re
import string

import pytest

from conftest import table
from shieldframe.llm import secret_scan

BASE = {
    "assign": (re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


@pytest.fixture(scope="module")
def tokens():
    with open(secret_scan.VOCABULARY, "rb") as f:
        return secret_scan.vocabulary(f.read())


def slow_base(text):
    found = [(m.start(), i, m.end(), kind) for i, (kind, (p, g, n)) in enumerate(BASE.items()) for m in p.finditer(text or "") if len(m[g]) >= n]
    return sorted(found)


def slow_random(text, tokens, base):
    """Random runs the plain way: maximal runs by characters, each against all base spans."""
    alphabet, out, i = set(string.ascii_letters + string.digits + "+/_-"), [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in alphabet:
            j += 1
        if j - i >= secret_scan.LEAST_CHARS:
            end = j
            while end < len(text) and end < j + 2 and text[end] == "=":
                end += 1
            run = text[i:end]
            free = all(e <= i or s >= end for s, _, e, _ in base)
            if free and not secret_scan.excluded(run, text[max(0, i - 16) : i]):
                n = sum(len(tokens.encode_ordinary(run[k : k + secret_scan.PIECE])) for k in range(0, len(run), secret_scan.PIECE))
                if len(run) / n < secret_scan.MOST_RATIO:
                    out.append((i, 3, end, "random", len(run) * 1000 // n))
        i = max(j, i + 1)
    return out


def slow_row(doc_id, text, tokens):
    base = slow_base(text)
    drawn = slow_random(text or "", tokens, base)
    joined = lambda spans: ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)
    counts = [sum(s[3] == k for s in base) for k in BASE]
    return (doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + drawn, key=lambda s: s[:3])), len(drawn))


def test_query_equals_brute_force(spark, tokens):
    docs = table(spark, "documents", "sf0.01")
    got = sorted(tuple(r)[:7] for r in secret_scan.digests(secret_scan.find(docs)).collect())
    want = sorted(slow_row(r["doc_id"], r["text"], tokens) for r in docs.select("doc_id", "text").collect())
    assert got == want and sum(r[1] for r in got) > 3


def drawn(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_patterns_on_made_texts(spark, tokens):
    rng = random.Random(3)
    pieces = ["password", "PASSWD", "Secret", "tOKEN", "api_key", "APIKEY", "ſecret", "toKen", "=", ":", " ", "  ", '"', "'", "hunter2hunter2", "short", "AKIA", "AKIAABCDEFGH1234", "a.b=c-d/e", "é", "\n", "\t", "0" * 31, "f" * 32, "F", "x"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))) for i in range(600)]
    got = sorted(tuple(r)[:7] for r in secret_scan.digests(secret_scan.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    assert got == sorted(slow_row(*r, tokens) for r in rows)


def test_random_strings_against_what_people_write(tokens):
    rng = random.Random(7)
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567")
    secrets = [drawn(rng, a, n) for a in alphabets for n in (24, 40, 64) for _ in range(100)]
    hits = sum(bool(secret_scan.random_spans(f"see {s} here", tokens, [])) for s in secrets)
    assert hits >= 0.99 * len(secrets)
    plain = [
        "getUserAccountNameByIdentifier", "spark_sql_shuffle_partitions", "application_configuration_file", "node_modules/react-dom/server", "AbstractSingletonProxyFactoryBean",
        "2024-01-15T10-30-00Z-backup-file", "kubernetes-dashboard-deployment-v2", "12345678901234567890123", "internationalization", "com/example/project/service/impl", "a" * 60, "-" * 40,
        "123e4567-e89b-12d3-a456-426614174000", hashlib.sha1(b"x").hexdigest().upper(), "sha256-" + drawn(rng, alphabets[1], 43) + "=", "HTTPServerConnectionTimeoutException",
    ]
    assert [p for p in plain if secret_scan.random_spans(f"see {p} here", tokens, [])] == []
    assert not secret_scan.excluded("1" * 31 + "!-" + "a" * 31 + "!", "")  # and in no time
    digest = drawn(rng, alphabets[1], 43) + "="
    assert not secret_scan.random_spans(f"sha256:{digest}", tokens, []) and secret_scan.random_spans(f"bearer {digest}", tokens, [])


def test_odd_rows(spark, tokens):
    key = drawn(random.Random(1), string.ascii_letters + string.digits, 32)
    long = ("word " * 200_000) + key + " " + "Zq9" * 20_000
    rows = [(None, f"token = {key}"), (None, None), (1, ""), (1, ""), (2, key), (3, long), (4, "é" * 5 + key + "=="), (5, "f" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as n_hex")
    got = sorted((tuple(r)[:7] for r in secret_scan.digests(secret_scan.find(docs)).collect()), key=repr)
    assert got == sorted((slow_row(*r, tokens) for r in rows), key=repr)
    assert secret_scan.digests(secret_scan.find(docs.limit(0))).count() == 0
