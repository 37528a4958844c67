from __future__ import annotations

import re

from conftest import table
from pyspark.sql import functions as F

from shieldframe.llm import mixing


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest, weight = total - sum(3 * sizes[s] for s in capped), sum(w[s] for s in order if s not in capped)
        t = {s: 3 * sizes[s] if s in capped else rest * w[s] / weight for s in order}
        new = {s for s in order if s not in capped and t[s] > 3 * sizes[s]}
        if not new:
            return t
        capped |= new


def check(df, near):
    src = df.select("doc_id", "text", "source").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in src}
    source = {r.doc_id: r.source for r in src}
    by = {}
    for d, s in source.items():
        by[s] = by.get(s, 0) + size[d]
    want, rows, took = targets(by), mixing.mix(df).collect(), {}
    assert len(rows) == len(src)
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], by[s]) and abs(r.target - want[s]) < 1e-3 and 0 <= r.taken <= 3 * r.size
        took[s] = took.get(s, 0) + r.taken
    for s, t in want.items():
        assert abs(took[s] - t) <= near(t), (s, took[s], t)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(df).collect()))


def test_documents(spark):
    check(table(spark, "documents", "sf0.01"), lambda t: 0.5)


def test_skew_caps_and_odd_rows(spark):
    rows = [(i, "w " * (i % 7 * 10 + 1), f"s{i % 3}" if i % 40 else None, 0) for i in range(300)]
    rows += [(1000, "a b c d e f", "tiny", 0), (1001, None, "zz", 0), (1002, "  ", "zz", 0), (1003, "x " * 50_000, "big", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    check(df, lambda t: 0.5)
    assert mixing.mix(df.limit(0)).count() == 0
    kept = mixing.mixed_documents(df)
    assert kept.where("taken = 0").count() == 0 and kept.count() > 200


def test_small_sources_take_their_targets_to_the_word(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(70, "a"), (10_000, "b"), (10_000, "c"), (1, "d"), (3, "e"), (64, "f"), (2, None), (129, "g")])]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), lambda t: 0.5)


def test_points_of_late_slots_are_whole_numbers(spark):
    slots = [0, 1, 2, 12345, 1 << 24, (1 << 24) + 1, 10**12, 10**12 + 1, (1 << 47) + 3]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in slots], "s long").select(mixing.point(F.col("s"))).collect()]
    assert got == [s * mixing.GOLDEN % (1 << mixing.POINT_BITS) for s in slots]
    assert abs(mixing.GOLDEN / (1 << mixing.POINT_BITS) - 0.6180339887498949) < 1e-14 and mixing.GOLDEN % 2


def test_schedule_stays_near_the_weights(spark):
    df = table(spark, "documents", "sf0.01")
    t = mixing.source_targets(mixing.sized(df).groupBy("source").agg({"size": "sum"}).withColumnRenamed("sum(size)", "source_size")).cache()
    share = {r.source: r.hi - r.lo for r in t.collect()}
    first = mixing.schedule(t).where("slot < 2000").groupBy("source").count().collect()
    assert all(abs(r["count"] - 2000 * share[r.source]) < 20 for r in first)


def test_repeated_rows_and_null_ids_are_mixed_each_by_itself(spark):
    rows = [(i % 50, "w " * (i % 5 * 30 + 1), f"s{i % 2}", i) for i in range(100)] + [(7, "same words here", "s0", 0)] * 3
    rows += [(None, "a b c d", "s1", 1), (None, "a b c d", "s1", 2), (None, "e f", None, 3), (None, None, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    want = [(r.doc_id, r.size, r.taken) for r in mixing.mix(df).collect() if r.taken]
    kept = mixing.mixed_documents(df).collect()
    assert sorted(((r.doc_id, r.size, r.taken) for r in kept), key=str) == sorted(want, key=str)
    assert all(r.size == len((r.text or "").split()) for r in kept) and sum(r.doc_id is None for r in kept) > 1
    assert kept[0].__fields__ == [*df.columns, "size", "source_size", "target", "taken"]
