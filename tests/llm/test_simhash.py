from __future__ import annotations

import re

import numpy as np
import xxhash
from conftest import table

from shieldframe.llm import components, simhash


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, ids):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    arr = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 4):
            parent[root(i)] = root(int(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(fps))]


def check(df):
    src = df.select("doc_id", "text").collect()
    fps = [fingerprint(r.text) for r in src]
    want = sorted(((r.doc_id, f"{f:016x}", c) for r, f, c in zip(src, fps, groups(fps, [r.doc_id for r in src]), strict=True)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str) == want


def test_documents(spark):
    check(table(spark, "documents"))


def test_odd_rows(spark):
    text = "The quick brown fox jumps over the lazy dog " * 30
    rows = [(1, None), (2, ""), (3, "  "), (4, "One"), (5, "one"), (6, text), (7, text + "end"), (7, text), (None, text), (8, "É a b"), (9, "w " * 30_000)]
    check(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int"))
    assert simhash.near_duplicates(table(spark, "documents").limit(0)).count() == 0
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {1, 4, 6, 8, 9}


def test_buckets_and_their_division(spark, monkeypatch):
    """Six groups of near fingerprints, in one bucket, in buckets of any size, and in buckets divided down to the last bits."""
    rng = np.random.default_rng(1)
    seed = rng.integers(0, 1 << 62, 6, dtype=np.uint64)
    fps = set()
    for s in seed.tolist():
        for _ in range(30):
            f = s
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                f ^= 1 << int(b)
            fps.add(f)
    fps = sorted(fps)
    want = groups(fps, list(range(len(fps))))
    label = simhash.bucket_links(np.array(fps, dtype=np.uint64), np.zeros(len(fps), dtype=np.int64), entries=64)
    first = {}
    for i, r in enumerate(label.tolist()):
        first.setdefault(r, i)
    assert [first[r] for r in label.tolist()] == want
    df = spark.createDataFrame([(simhash._signed(f), (False, i)) for i, f in enumerate(fps)], f"fp long, node {simhash.NODE}").repartition(3)
    for most, marks in ((50_000, 100_000), (10, 100_000), (3, 0)):
        monkeypatch.setattr(simhash, "BUCKET_ROWS", most)
        monkeypatch.setattr(simhash, "BROADCAST_BUCKETS", marks)
        found = {r.node.id: r.label.id for r in components.connected_components(simhash.links(df, 4)).collect()}
        assert [found.get(i, i) for i in range(len(fps))] == want, most


def test_divided_masks_lose_no_pair():
    """Of any two values that agree on a mask and differ in at most the radius elsewhere, some finer mask has no difference."""
    rng = np.random.default_rng(2)
    mask = 0
    while bin(mask).count("1") <= 64 - simhash.SPLIT_BITS:
        finer = simhash._masks(mask)
        assert all(m & mask == mask and m != mask for m in finer)
        free = [b for b in range(64) if not mask >> b & 1]
        for _ in range(500):
            differ = sum(1 << int(b) for b in rng.choice(free, 4, replace=False))
            assert any(not differ & m for m in finer)
        mask = finer[int(rng.integers(len(finer)))]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (102, 102), (None, 5)], "u long, v long")
    got = {r.node: r.label for r in components.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 102}


def test_hubs_and_null_ids(spark, monkeypatch):
    """A third of all rows in one group; groups that only null ids have; and the same with most buckets over the bound."""
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(i, base + f" end{i % 40}") for i in range(300)] + [(1000 + i, f"text {i} " * (i % 9 + 1)) for i in range(300)]
    rows += [(None, base + " end3"), (None, "only null has this one text here"), (None, "only null has this one text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df)
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 8)
    check(df.limit(400))
