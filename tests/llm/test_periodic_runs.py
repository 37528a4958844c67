from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import table
from shieldframe.llm import periodic_runs


def slow_runs(words, least=6, times=4):
    """Runs by trying every period: maximal stretches of places that agree with the place one period on."""
    found, seen = [], set()
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and (i, j + q) not in seen:
                seen.add((i, j + q))  # the least period comes first: a multiple of it has the same ends
                found.append((i, j + q - i, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = None
    for r in runs:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def slow_next_smaller(x):
    n = len(x)
    after = [next((j for j in range(i + 1, n) if x[j:] < x[i:]), n) for i in range(n)]
    same = lambda a, b: next((k for k in range(n - b) if x[a + k] != x[b + k]), n - b)
    return after, [same(i, j) if j < n else 0 for i, j in enumerate(after)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 6))
def test_next_smaller_and_runs(x, times):
    x = x * times
    assert periodic_runs.next_smaller(x) == slow_next_smaller(x)
    for least, exponent in ((6, 4), (2, 2), (3, 3)):
        assert periodic_runs.runs_of(x, least, exponent) == slow_runs(x, least, exponent)


def test_words_of_every_shape():
    rng = random.Random(5)
    for _ in range(300):
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))]
        for _ in range(rng.randint(0, 4)):
            words += unit * rng.randint(1, 6) + [rng.choice("abcxyz") for _ in range(rng.randint(0, 5))]
        coded = [w.encode() for w in words]
        assert periodic_runs.word_runs(coded) == slow_runs(words)
        runs = slow_runs(words)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        assert [i for i, k in enumerate(periodic_runs.kept(len(words), runs)) if k] == [i for i in range(len(words)) if i not in gone]


class Counted(int):
    """A number that counts how often it is compared."""

    seen = 0

    def __eq__(self, other):
        Counted.seen += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


@pytest.mark.parametrize("kind", ["one", "fibonacci", "thue-morse", "powers", "random"])
def test_comparisons_grow_with_the_length(kind):
    n = 20_000
    if kind == "fibonacci":
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        x = b[:n]
    elif kind == "powers":
        x = [0] * 50 + [1]
        while len(x) < n:
            x = x * 5 + [2]
        x = x[:n]
    else:
        x = {"one": [0] * n, "thue-morse": [i.bit_count() % 2 for i in range(n)], "random": random.Random(1).choices(range(2), k=n)}[kind]
    for y in (x, [2 - v for v in x]):
        Counted.seen = 0
        periodic_runs.next_smaller([Counted(v) for v in y])
        assert Counted.seen <= 4 * n


def test_query_equals_brute_force(spark):
    docs = table(spark, "documents")
    got = sorted(tuple(r) for r in periodic_runs.digests(periodic_runs.find(periodic_runs.with_repeats(docs))).collect())
    want = sorted(slow_row(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    assert got == want and sum(r[1] > 0 for r in got) > 5


def test_odd_rows(spark):
    long = "a b " * 60_000 + "end"
    rows = [(None, "x x x x x x x"), (None, None), (0, None), (1, ""), (1, " \t\n "), (2, "a b " * 7), (2, "a b " * 7), (3, long), (4, "é\x85 " * 5), (19, "u v w x y z " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as runs")
    got = sorted((tuple(r) for r in periodic_runs.digests(periodic_runs.find(periodic_runs.with_repeats(docs))).collect()), key=repr)
    small = [r for r in rows if r[1] != long]
    want = sorted([slow_row(*r) for r in small], key=repr)
    assert [g for g in got if g[0] != 3] == want
    text = " ".join(["a", "b"])
    assert [g[1:6] for g in got if g[0] == 3] == [(1, 0, 120_000, 2, 60_000_000)]
    assert periodic_runs.find(docs.where("doc_id = 3")).first()["collapsed"] == text + " end"
    assert periodic_runs.digests(periodic_runs.find(docs.limit(0))).count() == 0
