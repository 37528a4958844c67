"""Periodic runs of words: stretches that repeat with a smallest period and that no neighbour extends.

Every run has, in one of the two orders of its words (as numbered, or the other way round), a Lyndon root: a stretch whose
suffix is followed, one period on, by its next smaller suffix. So the runs are read off the Lyndon arrays of both orders,
with the extension that each suffix has in common with its next smaller one. `next_smaller` computes both from left to
right in linear time: the last match that reaches furthest says what was found one shift before, and is extended from
where it ended. No word is compared twice within a match; there are no suffix structures and no hashes of stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shieldframe.llm.scratch import small_batches

WORD = r"[^\x20\x09-\x0D]+"
LEAST_LENGTH = 6
LEAST_EXPONENT = 4
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def next_smaller(x: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix of `x` (numbers from 0) where its next smaller suffix starts (the length, if there is none), and how
    many places the two have in common. A suffix that is the beginning of another is the smaller one.

    A step goes along the previous smaller suffixes of the place at hand, as far as they are larger than its own. `start`,
    `reach` and `shift` hold the match that reaches furthest: x[t] == x[t - shift] for start <= t < reach. A step whose
    comparisons were all decided before the match's end one shift before is copied; any other starts its comparison
    at the end of the match, which it then moves. So equal places are met at most once each.
    """
    n = len(x)
    x = [*x, -1]
    before, common = [-1] * n, [0] * n  # the previous smaller suffix and the extension in common with it
    after, shared = [n] * n, [0] * n
    most = [0] * n
    start = reach = shift = 0
    for k in range(1, n):
        c, e, limit = k - 1, 0, 0
        if start < k < reach:
            m, limit = k - shift, reach - k
            if most[m] < limit:
                stop = before[m] + shift
                while c != stop:
                    after[c], shared[c] = k, shared[c - shift]
                    c = before[c]
                before[k], common[k], most[k] = stop, common[m], most[m]
                continue
        best, at = -1, c
        while True:
            if e < limit and c >= start:  # one shift before, this pair has been compared
                there = c - shift
                e = min(limit, shared[there] if after[there] == m else common[m])
            while x[c + e] == x[k + e]:
                e += 1
            if e > best:
                best, at = e, c
            if x[c + e] < x[k + e]:
                before[k], common[k] = c, e
                break
            after[c], shared[c] = k, e
            e_up, c = common[c], before[c]
            if c < 0:
                break
            if e > e_up:  # the one above is smaller than the popped one where that still agrees with this one
                before[k], common[k] = c, e_up
                break
        most[k] = best
        if k + best >= reach:
            start, reach, shift = k, k + best, k - at
    return after, shared


def runs_of(x: list[int], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of `x` (numbers from 0) that are at least so long, and so many periods long (2 or
    more), by start and period."""
    top, found = max(x, default=0), set()
    for y in (x, [top - v for v in x]):
        after, shared = next_smaller(y)
        n = len(y)
        for i, (j, r) in enumerate(zip(after, shared, strict=True)):
            p = j - i
            if j == n or r + 2 * p <= max(least_length, least_exponent * p) or (i >= p and after[i - p] == i and shared[i - p] >= p):
                continue  # too short, as less than a period is on the left; or the root before this one, which is equal, says it
            left = 0
            while left < i and y[i - left - 1] == y[j - left - 1]:
                left += 1
            if left + p + r >= max(least_length, least_exponent * p):
                found.add((i - left, left + p + r, p))
    return sorted(found, key=lambda q: (q[0], q[2]))


def word_runs(words: list[bytes], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """The runs of a text's words. Words are numbered as they first appear. One that is there less often than a run repeats is
    in no run, so the runs of the stretches between such words are all runs."""
    if len(words) < least_length:
        return []
    number: dict[bytes, int] = {}
    x = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    often = np.concatenate(([False], np.bincount(x)[x] >= least_exponent, [False]))
    edges = np.flatnonzero(often[1:] != often[:-1])
    found = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a >= least_length:
            found += [(a + s, length, p) for s, length, p in runs_of(x[a:b].tolist(), least_length, least_exponent)]
    return found


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of `n` words stay: those that no run contains after its first period."""
    drops = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        drops[start + period] += 1
        drops[start + length] -= 1
    return np.cumsum(drops)[:n] == 0


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, runs (array of start, length and period in words, by start and period) and
    collapsed, the text without the words that only repeat a run's first period, joined by one blank.

    Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows stay, null ids too; other
    columns are ignored. A text's words are held by one task, whatever its length; nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, every, texts = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().split()
                runs = word_runs(words, least_length, least_exponent)
                if runs:
                    words_left = [w for w, k in zip(words, kept(len(words), runs).tolist(), strict=True) if k]
                else:
                    words_left = words
                n_words.append(len(words))
                every.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                texts.append(b" ".join(words_left).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(every, pa.list_(_RUN)), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _longest(runs: Column) -> Column:
    """The run with the greatest length by period, then the least start, then the least period; null without runs."""

    def better(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, better)


def digests(found: DataFrame) -> DataFrame:
    """Rows of `find` as counts and digests: doc_id, n_runs, the run with the greatest exponent (start, length, period,
    exponent_milli; null without runs), runs_sha256 and collapsed_sha256."""
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.withColumn("_top", _longest(F.col("runs")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_top.start", "_top.length", "_top.period", F.expr("1000 * _top.length div _top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` (doc_id, text) with about every tenth text made periodic from some word on, by the CRC-32 of its id: what the
    registered query looks at. Rows without an id stay as they are."""
    n, a, p, g = F.size("_w"), F.col("_a"), F.col("_p"), F.col("_g")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.when(F.col("_h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("_w", words).withColumn("_g", F.expr("_h div 10"))
    rows = rows.withColumn("_a", F.when(n > 0, g % n).cast("int"))
    rows = rows.withColumn("_p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    again = F.concat(F.slice("_w", 1, a), F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(F.col("_w"), a + i % p)))
    return rows.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
