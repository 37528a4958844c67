from __future__ import annotations

import random
import re

from conftest import table

from shieldframe.llm import decontam


def tokens(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(docs, items):
    """Every (document, item) pair with a window that agrees, by trying all alignments."""
    out = set()
    for d, t in docs:
        w = tokens(t)
        at = {}
        for i, x in enumerate(w):
            at.setdefault(x, []).append(i)
        for k, it in items:
            v = tokens(it)
            if len(v) < decontam.LEAST_TOKENS:
                continue
            for shift in {p - i for i, x in enumerate(v) for p in at.get(x, ())}:
                same = [0 <= shift + i < len(w) and w[shift + i] == x for i, x in enumerate(v)]
                n = min(13, len(v))
                if max(sum(same[i : i + n]) for i in range(len(v) - n + 1)) >= decontam.needed(len(v)):
                    out.add((d, k))
                    break
    return out


def pairs(spark, docs, items):
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, doc_id string")
    return {(r.doc_id, r.item_id) for r in decontam.find(d, b).collect()}


def test_substitutions_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["the", "of", "É"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 5, 6, 8, 9, 12, 13, 14, 20, 40])))) for i in range(40)]
    docs = []
    for d in range(120):
        v = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 4)):
            v[rng.randrange(len(v))] = "zz"
        lo = rng.randint(0, max(0, len(v) - 13)) if rng.random() < 0.3 else 0
        body = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        docs.append((d, " ".join(body) + ", " + "  ".join(v[lo:]).upper() + ". " + " ".join(reversed(body))))
    got = pairs(spark, docs, items)
    assert got == brute(docs, items) and len(got) > 30


def test_documents(spark):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    found = decontam.find(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and want
    assert all(r.matched_words <= r.item_words and r.best_window <= 13 for r in found)
    left = decontam.drop_contaminated(docs, items)
    assert left.count() == docs.count() - len({d for d, _ in want}) and left.columns == docs.columns


def test_odd_rows(spark):
    item = "a b c d e f g h i j k l m n o p"
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, "x " + item), (4, item * 500), (5, "a " * 20_000)]
    assert pairs(spark, docs, [(1, item), (1, item), (2, None), (3, ""), (None, item)]) == {(d, i) for d in (3, None, 4) for i in (1, None)}
    assert pairs(spark, docs[:2], [(1, item)]) == set()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontam.find(d.limit(0), b).count() == 0 and decontam.find(d, b.limit(0)).count() == 0


def test_rows_without_an_id_are_judged_each_by_itself(spark):
    item = "a b c d e f g h i j k l m n o p"
    rows = [(None, "x " + item, 1), (None, "clean text", 2), (None, None, 3), (3, item, 4), (3, "rest of three", 5), (4, "fine", 6), (None, "clean text", 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, text_hash int")
    left = decontam.drop_contaminated(d, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.text_hash for r in left.collect()) == [2, 3, 6, 7] and left.columns == d.columns


def test_without_any_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    test_odd_rows(spark)
    test_documents(spark)
