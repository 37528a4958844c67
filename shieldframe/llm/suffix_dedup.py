"""Exact removal of repeated 100-byte strings with a hash-compared suffix sort.

A string of `LENGTH` bytes that also starts earlier in the corpus is removed wherever it isn't the first. To find them
without sorting every suffix in one place, each string goes to the group of its least-hashed `ANCHOR`-byte part: equal
strings have the same anchor at the same place in them. Consecutive strings with one anchor form a run, which is one
row. In a group, runs with equal hashes of all their bytes are settled by their first; the first runs of different bytes
may still share strings. Those get their bytes, and all their suffixes are sorted by a mergesort that compares two
suffixes by the longest common extension: a binary search over prefix polynomial hashes. Neighbours with a common
extension of `LENGTH` are verified byte by byte. The sort is stable over (document, place), so the first of each class
of equal strings is the one that stays. Groups of over `GROUP_RUNS` such runs (a line in a great many contexts) are
first split into their strings, by the strings' own hashes, and copies inside a batch are settled there.

Whatever a hash settles is verified by bytes. Copies inside a batch are compared in the batch, before the shuffle, so a
passage that a third of all documents hold is sent once per batch. Runs settled by one of another batch are put together
to the longest stretches that two documents share, both documents' bytes of each stretch are fetched with those of the
open runs, and compared. If any differ, everything is done again without settling runs by their hashes.

Runs are dealt by ranges of (anchor, hash of the run), so that even an anchor that a third of all documents hold is
spread over many tasks. A range can't know whether the groups at its two ends go on elsewhere; they count as if.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shieldframe.llm.buffers import Powers, joined, mixed
from shieldframe.llm.scratch import attach, small_batches, stored

LENGTH = 100
ANCHOR = 24
#: Groups of more open runs are split into their strings.
GROUP_RUNS = 1000
#: A list of at most so many large groups may be broadcast; a longer one is joined by shuffling.
BROADCAST_ROWS = 100_000
_WIDTH = LENGTH - ANCHOR + 1
_PIECE = 1 << 21  # bytes worked on at once; longer texts go in overlapping pieces
_LOW = np.uint64((1 << 24) - 1)
_POWERS = Powers(0x9E3779B97F4A7C15)
#: Open runs worked on at once, groups kept whole.
SETTLE_RUNS = 8000
SENT, SETTLED, OPEN = 0, 1, 2


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes modulo 2**64; differences give the hash of any stretch (see `stretch`)."""
    _POWERS.need(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS.up[: len(data)], out=sums[1:])
    return sums


def stretch(sums: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    """The hash of data[start : start + length]."""
    return (sums[start + length] - sums[start]) * _POWERS.down[start]


def common_extension(sums: np.ndarray, u: np.ndarray, v: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """How many bytes, up to `most`, the suffixes at u and v have in common: a binary search over hashes."""
    low, high = np.zeros(len(u), dtype=np.int64), np.full(len(u), most, dtype=np.int64)
    for _ in range(most.bit_length()):
        mid = (low + high + 1) // 2
        same = stretch(sums, u, mid) == stretch(sums, v, mid)
        low = np.where(same, mid, low)
        high = np.where(same, high, mid - 1)
    return low


def _before(data: np.ndarray, sums: np.ndarray, u: np.ndarray, v: np.ndarray, lu: np.ndarray, lv: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
    """Whether the first lu bytes at u come before the first lv at v (or, where or_equal, are the same); a beginning goes first."""
    n = common_extension(sums, u, v)
    over = n >= np.minimum(lu, lv)
    cut = np.minimum(n, LENGTH - 1)
    return np.where(over, (lu < lv) | (or_equal & (lu == lv)), data[u + cut] < data[v + cut])


def suffix_sort(data: np.ndarray, sums: np.ndarray, suffix: np.ndarray, group: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
    """The order that sorts suffixes by their first LENGTH bytes (or `limit`, at most that many) within each group; equal
    ones stay in their order. LENGTH bytes from each suffix on must be there, whatever its limit.

    Groups are contiguous. All groups are merged side by side, bottom up: each element finds its place among the
    sibling run's by binary search, so a level of the mergesort takes a logarithmic number of comparisons an element.
    """
    n = len(suffix)
    order = np.arange(n)
    if not n:
        return order
    if limit is None:
        limit = np.full(n, LENGTH)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    start, length = np.repeat(first, size), np.repeat(size, size)
    width = 1
    while (active := np.flatnonzero(length > width)).size:
        s, m = start[active], length[active]
        k = active - s
        run = k // width
        left = run % 2 == 0
        pair = (run - run % 2) * width
        sibling = np.where(left, pair + width, pair)
        low = np.minimum(sibling, m)
        base, high = low.copy(), np.minimum(np.where(left, sibling + width, pair + width), m)
        mine, own = suffix[order[active]], limit[order[active]]
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            other = order[s[open_] + mid]
            # an element of the left run goes before equal ones of the right run, and the other way round
            ahead = _before(data, sums, suffix[other], mine[open_], limit[other], own[open_], ~left[open_])
            low[open_] = np.where(ahead, mid + 1, low[open_])
            high[open_] = np.where(ahead, high[open_], mid)
        place = s + pair + (k - run * width) + (low - base)
        merged = order.copy()
        merged[place] = order[active]
        order = merged
        width *= 2
    return order


def nearest(data: np.ndarray, suffix: np.ndarray, group: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The longest extension, up to both limits, that each suffix has in common with any other of its group: suffixes are
    sorted, and the longest is that with a neighbour."""
    sums = prefix_hashes(data)
    order = suffix_sort(data, sums, suffix, group, limit)
    u, v = order[:-1], order[1:]
    common = np.where(group[u] == group[v], np.minimum(common_extension(sums, suffix[u], suffix[v]), np.minimum(limit[u], limit[v])), 0)
    out = np.zeros(len(suffix), dtype=np.int64)
    np.maximum.at(out, u, common)
    np.maximum.at(out, v, common)
    return out


def same_bytes(data: np.ndarray, u: np.ndarray, v: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether data[u : u + length] and data[v : v + length] are the same, for each triple."""
    out = np.ones(len(u), dtype=bool)
    ends = np.cumsum(length)
    lo = 0
    while lo < len(u):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), side="right")))
        n = length[lo:hi]
        pair = np.repeat(np.arange(hi - lo), n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        differ = pair[data[u[lo:hi][pair] + k] != data[v[lo:hi][pair] + k]]
        out[lo + differ] = False
        lo = hi
    return out


def repeats(data: np.ndarray, suffix: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which suffixes' first LENGTH bytes also are those of an earlier suffix of their (contiguous) group."""
    out = np.zeros(len(suffix), dtype=bool)
    if not len(suffix):
        return out
    change = group[1:] != group[:-1]
    some = np.flatnonzero(~(np.r_[True, change] & np.r_[change, True]))  # a suffix alone in its group needs no sort
    own, of = suffix[some], group[some]
    sums = prefix_hashes(data)
    order = suffix_sort(data, sums, own, of)
    u, v = order[:-1], order[1:]
    near = np.flatnonzero(of[u] == of[v])
    near = near[common_extension(sums, own[u[near]], own[v[near]]) == LENGTH]
    if not same_bytes(data, own[u[near]], own[v[near]], np.full(len(near), LENGTH)).all():
        return _repeats_by_bytes(data, suffix, group)  # a hash collision: compare the bytes themselves
    out[some[v[near]]] = True
    return out


def _repeats_by_bytes(data: np.ndarray, suffix: np.ndarray, group: np.ndarray) -> np.ndarray:
    whole, seen, out = data.tobytes(), set(), np.zeros(len(suffix), dtype=bool)
    for i, (at, g) in enumerate(zip(suffix.tolist(), group.tolist(), strict=True)):
        key = (g, whole[at : at + LENGTH])
        out[i] = key in seen
        seen.add(key)
    return out


def runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs of texts (bytes end to end, offsets `at`): anchor hash, hash of the run's bytes, text, first string's
    place in the text, number of strings, the anchor's place after the first string's start, and that start in the bytes."""
    n, none = len(data), np.zeros(0, dtype=np.int64)
    if n < LENGTH:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none, none
    sums = prefix_hashes(data)
    anchors = mixed(stretch(sums, np.arange(n - ANCHOR + 1), ANCHOR))
    least = (anchors & ~_LOW) | np.arange(len(anchors), dtype=np.uint64)  # the leftmost of the least
    span = 1
    while span * 2 <= _WIDTH:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < _WIDTH:
        least = np.minimum(least[: len(least) - (_WIDTH - span)], least[_WIDTH - span :])
    anchor = (least & _LOW).astype(np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = np.flatnonzero(text[: len(anchor)] == text[LENGTH - 1 : LENGTH - 1 + len(anchor)])
    if not len(inside):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none, none
    anchor, text = anchor[inside], text[inside]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    start, end = inside[first], inside[np.r_[first[1:] - 1, len(inside) - 1]]
    anchor, text = anchor[first], text[first]
    size = end - start + 1
    return anchors[anchor], mixed(stretch(sums, start, size + LENGTH - 1) + size.astype(np.uint64)), text, start - at[text], size, anchor - start, start


_ROW = "kind int, h long, x long, d long, tie long, s long, n int, a int"
#: Rows that are settled or open: those settled by a run of another batch say which (fs is -1 elsewhere).
_FOUND = "kind int, h long, d long, tie long, s long, n int, a int, fd long, ft long, fs long"
_TYPES = {"int": np.int32, "long": np.int64}


def _batch(schema: str, *columns) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).astype(_TYPES[t], copy=False)) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _pieces(at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of the texts at `at` to work on at once: first text, end text, and start and end of the bytes."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + _PIECE, side="right")) - 1)
        for lo in range(int(at[i]), max(int(at[j]), int(at[i]) + 1), _PIECE):
            yield i, j, lo, min(int(at[j]), lo + _PIECE + LENGTH - 1)
        i = j


def _map_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (d, tie, text) to rows: runs to be sent, and strings that an earlier text of the batch has already."""
    for batch in batches:
        order = np.lexsort((batch.column(1).to_numpy(), batch.column(0).to_numpy()))
        batch = batch.take(pa.array(order))
        ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, at = joined(batch.column(2))
        for i, j, lo, hi in _pieces(at):
            offsets = np.clip(at[i : j + 1], lo, hi) - lo
            h, x, text, s, n, a, start = runs(data[lo:hi], offsets)
            s = s + np.maximum(0, lo - at[i : j + 1][text])
            text = text + i
            key = mixed(h ^ mixed(x))
            by = np.argsort(key, kind="stable")
            later = np.zeros(len(key), dtype=bool)
            u, v = by[:-1], by[1:]
            equal = np.flatnonzero((key[u] == key[v]) & (n[u] == n[v]))
            u, v = u[equal], v[equal]
            later[v[same_bytes(data[lo:hi], start[u], start[v], n[v] + (LENGTH - 1))]] = True
            kind = np.where(later, SETTLED, SENT)
            # settled rows only pass through: spread them
            yield _batch(_ROW, kind, np.where(later, mixed(s.astype(np.uint64) ^ mixed(ids[text].view(np.uint64))), h).view(np.int64), x.view(np.int64), ids[text], ties[text], s, n, a)


def _reduce_runs(by_hash: bool):
    """Streams rows in order of (h, x, d, tie, s): settles runs with the hash of an earlier one; the first of each hash stay open
    if their group has several, or may have in another range. Without `by_hash` all runs of such groups stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held = first = None  # (h, x) of the row before; the group's only first so far; (d, tie, s) of that x's first
        several_before, begun = False, False
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            done = cols[0] == SETTLED
            if done.any():
                k, h, _, d, tie, s, n, a = (c[done] for c in cols)
                none = np.full(len(k), -1)
                yield _batch(_FOUND, k, h, d, tie, s, n, a, none, none, none)
                cols = [c[~done] for c in cols]
            kind, h, x, d, tie, s, n, a = cols
            if not len(h):
                continue
            new_h = np.r_[last is None or h[0] != last[0], h[1:] != h[:-1]]
            new_x = new_h | np.r_[last is None or x[0] != last[1], x[1:] != x[:-1]]
            at = np.maximum.accumulate(np.where(new_x, np.arange(len(h)), -1))
            fd, ft, fs = (np.where(at >= 0, c[at], 0 if first is None else first[i]) for i, c in enumerate((d, tie, s)))
            if not by_hash:
                new_x = np.ones(len(h), dtype=bool)
            settled = ~new_x
            if new_h[0]:
                held, several_before = None, False
            group = np.cumsum(new_h)  # 0: the group that the batch before ended with
            firsts = np.bincount(group[new_x], minlength=int(group[-1]) + 1)
            firsts[0] += 2 if several_before else held is not None
            if not begun:
                firsts[1] += 1  # the range before may end with this group
                begun = True
            if held is not None and firsts[0] > 1:
                yield _batch(_FOUND, *([v] for v in held))
                held, several_before = None, True
            rows = (np.where(new_x, OPEN, SETTLED), h, d, tie, s, n, a, *(np.where(settled, c, -1) for c in (fd, ft, fs)))
            alone = new_x & (firsts[group] == 1)
            yield _batch(_FOUND, *(c[~alone] for c in rows))
            if group[-1] > 0:
                several_before = bool(firsts[-1] > 1)
                tail = np.flatnonzero(new_x)[-1]
                held = None if several_before else [c[tail] for c in rows]
            last, first = (h[-1], x[-1]), (fd[-1], ft[-1], fs[-1])
        if held is not None:
            yield _batch(_FOUND, *([v] for v in held))  # the next range may begin with this group

    return run


_SHARED = "d long, tie long, s long, n int, fd long, ft long, fs long"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settled runs in order of (d, tie, fd, ft, fs - s, s) to the longest stretches of strings that two documents share."""
    held = None
    for batch in batches:
        d, tie, s, n, fd, ft, fs = (c.to_numpy() for c in batch.columns)
        if not len(d):
            continue
        if held is not None:
            d, tie, s, n, fd, ft, fs = (np.r_[x, y] for x, y in zip(held, (d, tie, s, n, fd, ft, fs), strict=True))
        goes_on = (d[1:] == d[:-1]) & (tie[1:] == tie[:-1]) & (fd[1:] == fd[:-1]) & (ft[1:] == ft[:-1]) & (fs[1:] - s[1:] == fs[:-1] - s[:-1]) & (s[1:] == s[:-1] + n[:-1])
        first = np.flatnonzero(np.r_[True, ~goes_on])
        total = np.add.reduceat(n.astype(np.int64), first)
        rows = [d[first], tie[first], s[first], total, fd[first], ft[first], fs[first]]
        yield _batch(_SHARED, *(c[:-1] for c in rows))
        held = [c[-1:] for c in rows]
    if held is not None:
        yield _batch(_SHARED, *held)


_OPEN = ["h", "d", "tie", "s", "n", "a", "bytes"]
_SPAN = "d long, tie long, s long, n int"


def _split_large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open runs with their bytes and whether their group is large. Runs of large groups become single strings under keys
    made of the strings themselves, so that no group holds all contexts of a frequent passage; strings that are in the
    batch before, compared byte by byte, go on without bytes, as settled, under keys that spread them."""
    for batch in batches:
        large = batch.column("large").to_numpy(zero_copy_only=False).astype(bool)
        plain = batch.select(_OPEN)
        yield plain.filter(pa.array(~large))
        if not large.any():
            continue
        part = plain.filter(pa.array(large))
        h, d, tie, s, n, a = (part.column(c).to_numpy() for c in _OPEN[:-1])
        data, at = joined(part.column("bytes"))
        row = np.repeat(np.arange(len(h)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        place = (a[row] - k).astype(np.uint64)
        key = mixed(h[row].view(np.uint64) ^ mixed(stretch(prefix_hashes(data), at[row] + k, LENGTH) + place))
        order = np.lexsort((s[row] + k, tie[row], d[row], key))
        row, k, key = row[order], k[order], key[order]
        start, p = at[row] + k, s[row] + k
        windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
        again = np.zeros(len(row), dtype=bool)
        equal = np.flatnonzero(key[1:] == key[:-1])
        for i in range(0, len(equal), 20_000):
            u = equal[i : i + 20_000]
            again[u + 1] = (windows[start[u]] == windows[start[u + 1]]).all(axis=1)
        spread = np.where(again, mixed(p.astype(np.uint64) ^ mixed(d[row].view(np.uint64))), key).view(np.int64)
        raw = data.tobytes()
        strings = [None if settled else raw[b : b + LENGTH] for settled, b in zip(again.tolist(), start.tolist(), strict=True)]
        columns = [spread, d[row], tie[row], p.astype(np.int64), np.ones(len(row), dtype=np.int32), (a[row] - k).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(strings, pa.binary())], names=_OPEN)


def _settle_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open runs with their bytes, in order of h: settles the strings that earlier runs of the group have. Strings that
    are settled already have no bytes."""
    held: list[pa.RecordBatch] = []
    size = 0

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.sort_by([("h", "ascending"), ("d", "ascending"), ("tie", "ascending"), ("s", "ascending")])
        h, d, tie, s, n, a = (table.column(c).to_numpy() for c in ("h", "d", "tie", "s", "n", "a"))
        n, a = n.astype(np.int64), a.astype(np.int64)
        data, at = joined(table.column("bytes").combine_chunks())
        # equal strings have the anchor at the same place. How far runs agree from their anchors on, and back from them,
        # bounds the places of the strings that can have an equal: only those are sorted as strings
        data = np.r_[np.zeros(LENGTH, dtype=np.uint8), data, np.zeros(LENGTH, dtype=np.uint8)]
        at = at + LENGTH
        of = np.cumsum(np.r_[False, h[1:] != h[:-1]])
        ahead = nearest(data, at[:-1] + a, of, np.minimum(LENGTH, n - 1 + LENGTH - a))
        back = nearest(data[::-1], len(data) - (at[:-1] + a), of, np.minimum(LENGTH, a))
        low, high = np.maximum(LENGTH - ahead, a - (n - 1)), np.minimum(back, a)
        some = np.maximum(0, high - low + 1)
        row = np.repeat(np.arange(len(h)), some)
        k = (a - high)[row] + np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some)
        order = np.lexsort((s[row] + k, tie[row], d[row], a[row] - k, of[row]))
        row, k = row[order], k[order]
        place = a[row] - k
        group = np.cumsum(np.r_[False, (h[row][1:] != h[row][:-1]) | (place[1:] != place[:-1])])
        again = repeats(data, at[row] + k, group)
        row, p = row[again], (s[row] + k)[again]
        order = np.lexsort((p, row))
        row, p = row[order], p[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (p[1:] != p[:-1] + 1)]) if len(row) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.r_[first, len(row)])
        yield _batch(_SPAN, d[row[first]], tie[row[first]], p[first], count)

    for batch in batches:
        done = batch.column("bytes").is_null().to_numpy(zero_copy_only=False)
        if done.any():
            yield _batch(_SPAN, *(batch.column(c).to_numpy()[done] for c in ("d", "tie", "s", "n")))
            batch = batch.filter(pa.array(~done))
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < SETTLE_RUNS:
            continue
        table = pa.Table.from_batches(held)
        h = table.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1], side="left"))
        if cut:
            yield from settle(table.slice(0, cut))
        held, size = table.slice(cut).combine_chunks().to_batches(), len(h) - cut
    if size:
        yield from settle(pa.Table.from_batches(held))


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (id, text, spans of strings to remove: s, n) to the texts that are left and what was removed."""
    for batch in batches:
        out, numbers = [], []
        spans = batch.column(2)
        for i, text in enumerate(batch.column(1).to_pylist()):
            text = text or b""
            if not spans[i].is_valid:
                out.append(text)
                numbers.append((len(text), 0, 0))
                continue
            s, n = (np.asarray(spans[i].values.field(f).to_numpy(zero_copy_only=False), dtype=np.int64) for f in (0, 1))
            order = np.argsort(s, kind="stable")
            s, e = s[order], (s + n + LENGTH - 1)[order]
            reach = np.maximum.accumulate(e)
            first = np.flatnonzero(np.r_[True, s[1:] > reach[:-1]])
            begin, end = s[first], reach[np.r_[first[1:] - 1, len(s) - 1]]
            out.append(b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True)))
            numbers.append((len(text), int((end - begin).sum()), len(first)))
        columns = list(zip(*numbers, strict=True)) if numbers else [[], [], []]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])


def _marked(open_: DataFrame) -> DataFrame:
    """Open runs with `large`: whether their group has over GROUP_RUNS of them."""
    large = stored(open_.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > GROUP_RUNS).select("h", F.lit(True).alias("large")), "large")
    n = large.count()
    if not n:
        return open_.withColumn("large", F.lit(False))
    return open_.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, "h", "left").withColumn("large", F.coalesce("large", F.lit(False)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, kept (the bytes that are left), n_bytes, n_removed, n_spans (removed runs).

    Texts are UTF-8 bytes, null is empty; a cut may fall inside a character. Strings are judged on the input. Earlier
    means a smaller id, null first, or the same document and an earlier start. Rows that share an id go by a hash of
    their texts; rows equal in id and text count as one document and get the same result. Texts of under 100 bytes stay
    whole; extra columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    shared_ids = not rows.groupBy("id").count().where("count > 1").isEmpty()
    tie = F.xxhash64("text") if shared_ids else F.lit(0).cast("long")
    texts = rows.select("id", F.coalesce("id", F.lit(-(1 << 63))).alias("d"), tie.alias("tie"), "text")
    sent = texts.where(F.octet_length("text") >= LENGTH).select("d", "tie", "text").mapInArrow(_map_runs, _ROW)
    source = texts.select("d", "tie", "text")
    if shared_ids:
        source = source.dropDuplicates(["d", "tie"])
    spans, verified = _spans(sent, source, True)
    if not verified:
        spans, _ = _spans(sent, source, False)
    every = spans.groupBy("d", "tie").agg(F.collect_list(F.struct("s", "n")).alias("spans"))
    cut = texts.join(every, ["d", "tie"], "left").select("id", "text", "spans")
    return cut.mapInArrow(_cut_texts, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def _spans(sent: DataFrame, source: DataFrame, by_hash: bool) -> tuple[DataFrame, bool]:
    """The strings to remove (d, tie, s, n), and whether all that hashes settled is the same in bytes too."""
    dealt = sent.repartitionByRange("h", "x").sortWithinPartitions("h", "x", "d", "tie", "s")
    found = stored(dealt.mapInArrow(_reduce_runs(by_hash), _FOUND), "runs")
    open_ = _marked(found.where(F.col("kind") == OPEN).select("h", "d", "tie", "s", "n", "a"))
    claims = found.where("fs >= 0").select("d", "tie", "s", "n", "fd", "ft", "fs")
    claims = claims.repartition("d", "tie").sortWithinPartitions("d", "tie", "fd", "ft", F.col("fs") - F.col("s"), "s").mapInArrow(_stretches, _SHARED)
    claims = stored(claims.withColumn("claim", F.monotonically_increasing_id()), "claims")
    # the bytes of open runs, of stretches, and of what these repeat (once, however many repeat it), all by one join
    none = F.lit(None)
    wanted = open_.select("h", "d", "tie", "s", "n", "a", "large", none.cast("long").alias("claim"), F.lit(0).alias("use"))
    wanted = wanted.union(claims.select(none.cast("long"), "d", "tie", "s", "n", none.cast("int"), none.cast("boolean"), "claim", F.lit(1)))
    wanted = wanted.union(claims.select("fd", "ft", "fs", "n").distinct().select(none.cast("long"), "fd", "ft", "fs", "n", none.cast("int"), none.cast("boolean"), none.cast("long"), F.lit(2)))
    raw = F.substring("text", (F.col("s") + 1).cast("int"), F.col("n") + (LENGTH - 1))
    fetched = stored(wanted.join(source, ["d", "tie"]).select("h", "d", "tie", "s", "n", "a", "large", "claim", "use", raw.alias("bytes")), "bytes")
    verified = not by_hash or _differing(claims, fetched).isEmpty()
    with_bytes = fetched.where("use = 0").select(*_OPEN, "large")
    groups = with_bytes.mapInArrow(_split_large, "h long, d long, tie long, s long, n int, a int, bytes binary").repartition("h").sortWithinPartitions("h")
    settled = stored(groups.mapInArrow(_settle_open, _SPAN), "settled")
    return found.where(F.col("kind") == SETTLED).select("d", "tie", "s", "n").union(settled), verified


def _differing(claims: DataFrame, fetched: DataFrame) -> DataFrame:
    """Stretches whose bytes aren't those of what they are said to repeat. A passage that very many repeat is dealt to many tasks."""
    place = F.struct(*(F.col(a).alias(b) for a, b in zip(("fd", "ft", "fs", "n"), ("d", "tie", "s", "n"), strict=True)))
    own = claims.select("claim", place.alias("place")).join(fetched.where("use = 1").select("claim", F.col("bytes").alias("own")), "claim")
    first = fetched.where("use = 2").select(F.struct("d", "tie", "s", "n").alias("place"), F.col("bytes").alias("first"))
    return attach(own, first, "place", F.col("claim")).where("own != first").select("claim")
