from __future__ import annotations

import os

import numpy as np
import pytest
from conftest import ROOT, table

from shieldframe.llm import suffix_dedup as sd


def brute(docs):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        out[d] = (len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


def same(df):
    want = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_repeats(df).collect()}
    assert got == want


def test_odd_texts(spark):
    rng = np.random.default_rng(0)
    w = ["".join(rng.choice(list("abcde"), 3)) for _ in range(6)]
    rows = [(0, "a" * 3000), (1, "a" * 99), (2, "a" * 100), (3, "ab" * 300), (4, "abc" * 300 + "x" + "abc" * 200), (5, None), (6, ""), (7, "é" * 300), (None, "a" * 150)]
    rows += [(10 + i, " ".join(rng.choice(w, 200))) for i in range(25)] + [(60 + i, "x" * int(rng.integers(0, 300)) + " ".join(rng.choice(w, 60))) for i in range(20)]
    same(spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, kind int"))


def test_documents(spark):
    same(table(spark, "documents"))


@pytest.mark.parametrize("most", [0, 5])
def test_large_groups_are_split_into_strings(spark, monkeypatch, most):
    """A line in many contexts, and a passage whose ends run into different texts; all groups are over the bound, or some."""
    monkeypatch.setattr(sd, "GROUP_RUNS", most)
    rng = np.random.default_rng(4)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    line, passage = noise(60), noise(300)
    rows = [(i, f"{noise(int(rng.integers(0, 80)))}{passage if i % 3 else line}{noise(60)}{line}{noise(50)}") for i in range(80)]
    rows += [(200 + i, t) for i, (_, t) in enumerate(rows[:5])] + [(300, None), (301, "")]
    same(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    same(table(spark, "documents"))


def test_repeated_rows_and_empty_table(spark):
    text = "".join(map(chr, np.random.default_rng(1).integers(97, 123, 400)))
    df = spark.createDataFrame([(1, text), (1, text), (1, text[50:] + "z"), (2, text)], "doc_id long, text string")
    rows = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in sd.remove_repeats(df).collect())
    assert len(rows) == 4 and rows[3] == (2, 400, 400)
    assert sd.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("tasks", [1, 7])
def test_groups_over_the_ends_of_ranges(spark, tasks):
    """One anchor in most documents, so that its group is spread over ranges, and copies over batches and tasks."""
    rng = np.random.default_rng(8)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    line = noise(40)
    rows = [(i, f"{noise(70)}{line}{noise(70)}") for i in range(120)]
    rows += [(500 + i, t + noise(30)) for i, (_, t) in enumerate(rows[:60])] + [(900 + i, noise(20) + rows[3][1] * 2) for i in range(30)]
    same(spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks))


@pytest.mark.parametrize("shared", [0, 1])
def test_colliding_hashes_are_found_out(spark, tmp_path, shared):
    """Runs of one anchor with one hash for all bytes: the bytes show it, and all is done without settling by hashes."""
    import subprocess
    import sys

    code = f"""
import sys; sys.path[:0] = [{ROOT!r}, {ROOT + "/tests/llm"!r}, {ROOT + "/tests"!r}]
import numpy as np
from pyspark.sql import SparkSession
from shieldframe.llm import suffix_dedup as sd
import test_suffix_dedup as t
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
spark.sparkContext.setCheckpointDir("file://{tmp_path}")
before, calls = sd._spans, []
def weak(sent, source, by_hash):
    calls.append(by_hash)
    return before(sent.withColumn("x", sent.n.cast("long")) if by_hash else sent, source, by_hash)
sd._spans = weak
rng = np.random.default_rng(1)
noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
line = noise(50)
rows = [(i, noise(60) + line + noise(60)) for i in range(20)] + [(100, noise(400))] + [(200 + i, line * 4) for i in range(3)]
rows += [(1, "other " + noise(200))] * {shared}
df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
if {shared}:
    assert sd.remove_repeats(df).count() == len(rows)
else:
    t.same(df)
assert calls == [True, False], calls
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": ROOT})
    assert done.returncode == 0, done.stderr[-3000:]


def test_nearest_extensions():
    rng = np.random.default_rng(5)
    data = np.r_[rng.integers(97, 99, 400).astype(np.uint8), np.zeros(100, dtype=np.uint8)]
    suffix, group = np.sort(rng.integers(0, 300, 60)), np.repeat(np.arange(6), 10)
    limit = rng.integers(1, 101, 60)
    got = sd.nearest(data, suffix, group, limit)
    for i in range(60):
        best = 0
        for j in range(60):
            if i != j and group[i] == group[j]:
                n, most = 0, min(limit[i], limit[j])
                while n < most and data[suffix[i] + n] == data[suffix[j] + n]:
                    n += 1
                best = max(best, n)
        assert got[i] == best


def test_suffix_sort_and_collisions(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    suffix = np.arange(0, 2900)
    group = np.zeros(len(suffix), dtype=np.int64)
    order = sd.suffix_sort(data, sd.prefix_hashes(data), suffix, group)
    raw = data.tobytes()
    assert [raw[s : s + 100] for s in order] == sorted(raw[s : s + 100] for s in suffix)
    want = sd._repeats_by_bytes(data, suffix, group)
    assert (sd.repeats(data, suffix, group) == want).all() and want.sum() >= 300
    # with a hash that collides everywhere, verification falls back to the bytes
    monkeypatch.setattr(sd, "stretch", lambda sums, start, length: np.full(len(start), 7, dtype=np.uint64))
    assert (sd.repeats(data, suffix, group) == want).all()


def test_long_texts_go_in_pieces(monkeypatch, spark):
    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, 4000).astype(np.uint8).tobytes().decode()
    at = np.array([0, 4000])
    monkeypatch.setattr(sd, "_PIECE", 700)
    pieces = list(sd._pieces(at))
    windows = [p for _, _, lo, hi in pieces for p in range(lo, hi - 99)]
    assert sorted(set(windows)) == list(range(3901)) and len(text) == 4000
