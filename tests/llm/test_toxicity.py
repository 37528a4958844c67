from __future__ import annotations

import math
import zlib

from conftest import table

from shieldframe.llm import toxicity


def grams(text):
    """Counts of a text's hashed n-grams, by loops."""
    found = {}
    for w in set((text or "").lower().split()):
        chars = [32, *map(ord, w), 32]
        for n in toxicity.ORDERS:
            for k in range(len(chars) - n + 1):
                h = n * 0x9E3779B1 & 0xFFFFFFFF
                for c in chars[k : k + n]:
                    h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
                h ^= h >> 15
                h = h * 0x2C1B3C6D & 0xFFFFFFFF
                h ^= h >> 12
                h &= (1 << toxicity.BITS) - 1
                found[h] = found.get(h, 0) + 1
    return found


def plain_score(model, text):
    import numpy as np

    w = np.frombuffer(model.weights, dtype="<f4")
    found = grams(text)
    n = sum(found.values())
    z = model.bias + (sum(float(w[h]) * k for h, k in found.items()) / n**0.5 if n else 0.0)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def test_held_out_accuracy(spark):
    """The fold whose labels were never seen, on the larger table."""
    docs, labels = table(spark, "documents", "sf0.1"), table(spark, "labels", "sf0.1")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(g.held_out for g, _ in held) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g, _ in held)
    right = sum(g.predicted == y for g, y in held) / len(held)
    toxic = [g.score for g, y in held if y == 1]
    clean = [g.score for g, y in held if y == 0]
    auc = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / len(toxic) / len(clean)
    assert right > 0.93 and auc > 0.93


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.1), (2, "x" * 50_000, 0.2), (None, "a b", None), (3, "you idiot", 1.0), (3, "you idiot", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1), (3, 1), (2, 0), (9, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    for empty in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.predicted for r in toxicity.classify(docs, empty).collect()} == {0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_scores_do_not_depend_on_order():
    import numpy as np

    rng = np.random.default_rng(0)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype("<f4").tobytes(), 0.1)
    texts = ["one two three", None, "two", "y" * 100, "three one two"]
    a = model.scorer()(texts)
    b = model.scorer()(texts[::-1])[::-1]
    assert (a == b).all() and a[0] == a[4]


def test_fit_and_scores_against_a_plain_implementation():
    """The same model worked out with dense vectors and a loop over texts."""
    import numpy as np

    rng = np.random.default_rng(3)
    good, bad = ["calm", "green", "river", "stone", "café"], ["idiot", "trash", "stupid"]
    texts = [" ".join(rng.choice(good, 6)) + (" " + rng.choice(bad) if i % 3 == 0 else "") for i in range(60)]
    y = np.array([i % 3 == 0 for i in range(60)], dtype=int)

    every = [grams(t) for t in texts]
    names = sorted(set().union(*every))
    x = np.array([[g.get(n, 0) for n in names] for g in every], dtype=float)
    x /= np.sqrt(x.sum(axis=1, keepdims=True))
    p, q = (np.array([sum(n in g for g, t in zip(every, y, strict=True) if t == k) + 1.0 for n in names]) for k in (1, 0))
    ratio = np.log((p / (y.sum() + 1)) / (q / ((1 - y).sum() + 1)))
    x *= ratio
    w, m, s, b, mb = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for step in range(1, toxicity.STEPS + 1):
        g = (1 / (1 + np.exp(-(x @ w + b))) - y) * weight
        gw = x.T @ g + toxicity.RIDGE * w
        m, s = 0.9 * m + 0.1 * gw, 0.99 * s + 0.01 * gw * gw
        w -= 0.1 * min(1, 2 * (toxicity.STEPS - step) / toxicity.STEPS) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
        mb = 0.9 * mb + 0.1 * g.sum()
        b -= 0.5 * mb
    b += np.log(5 / 55)
    z = x @ w + b
    low, high = np.quantile(z[y == 0], 0.999), np.quantile(z[y == 1], 0.02)
    if low < high and not low < 0 < high:
        z -= (low + high) / 2
    pairs = [np.unique(toxicity._hashes(toxicity._distinct_words(t))[0], return_counts=True) for t in texts]
    model = toxicity._fit(y, [a for a, _ in pairs], [n for _, n in pairs], 5, 55)
    assert np.abs(model.scorer()(texts) - 1 / (1 + np.exp(-z))).max() < 1e-3


def test_ids_of_any_type_and_columns_of_its_own_name(spark):
    docs = spark.createDataFrame([(f"d{i}", "you idiot" if i % 2 else "calm river", 0.25) for i in range(60)], "doc_id string, text string, toxic_score double")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(60)], "doc_id string, toxic int")
    left = toxicity.reject(docs, labels)
    assert left.columns == docs.columns and {(r.text, r.toxic_score) for r in left.collect()} == {("calm river", 0.25)} and left.count() == 30
