"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of ASCII letters and digits (lower-cased) and bytes beyond ASCII. A seed is a fixed mask over
consecutive tokens that ignores some positions; the hash of the tokens under the mask is the key on which test items and
training documents are joined. Every hit fixes an alignment (document, item, difference of token places), and each
alignment is verified token by token: an item is found where some `WINDOW` consecutive tokens of it agree with the
document's in at least `MATCHES` places. The masks hit every such window, whichever places are substituted, so nothing
is missed; items of fewer tokens count when whole with at most one substitution (from 8 tokens) or none (5 to 7), which
the plain mask of four tokens always hits. Items of under 5 tokens are no evidence and never found.

A bitmap of fixed size with the items' hashes goes to every task and lets only likely hits into the join. Documents then
give, for each alignment, the hashes of the tokens that face the item, and these are compared with the item's. Tables
are broadcast only where their bytes, summed up first, are at most `BROADCAST_BYTES`; beyond that they are shuffled, and
the alignments of a frequent item or document are dealt to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shieldframe.llm.buffers import Powers, joined, mixed
from shieldframe.llm.scratch import attach, checkpoint, small_batches, unused

WINDOW = 13
MATCHES = 11
LEAST_TOKENS = 5
#: Any two substitutions in 13 tokens leave one of the first two masks whole; the last is for items under 13 tokens.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7), (0, 1, 2, 3))
SHORT = 2
BITMAP_BITS = 26
#: Tables of at most so many bytes may be broadcast; larger ones are joined by shuffling.
BROADCAST_BYTES = 32 << 20
_KEEP = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64)
_POWERS = Powers(0x9E3779B97F4A7C15)
_PLACE = mixed(np.arange(1, 17, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a column of texts, and for each text the offsets of its tokens."""
    data, at = joined(column)
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    keep = _KEEP[data]
    before, after = np.empty_like(keep), np.empty_like(keep)
    before[0], before[1:], after[-1], after[:-1] = False, keep[:-1], False, keep[1:]
    edge = at[(at > 0) & (at < len(data))]
    before[edge] = False
    after[edge - 1] = False
    start, end = np.flatnonzero(keep & ~before), np.flatnonzero(keep & ~after) + 1
    _POWERS.need(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_FOLD[data] + np.uint64(1)) * _POWERS.up[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * _POWERS.down[start] + (end - start).astype(np.uint64)), np.searchsorted(start, at)


def seeds(hashes: np.ndarray, offsets: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed hashes under a mask at every place where it fits into a text: hash, text's index, place in the text."""
    span = MASKS[mask][-1] + 1
    n = len(hashes) - span + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return none.astype(np.uint64), none, none
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    h = np.full(n, mask + 1, dtype=np.uint64)
    for i, o in enumerate(MASKS[mask]):
        h += hashes[o : o + n] * _PLACE[i]
    fits = np.flatnonzero(text[:n] == text[span - 1 :])
    return mixed(h[fits]), text[fits], fits - offsets[text[fits]]


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, offsets = tokens(batch.column(1))
        sizes = np.diff(offsets)
        for mask in range(len(MASKS)):
            h, text, place = seeds(hashes, offsets, mask)
            ok = sizes[text] < WINDOW if mask == SHORT else sizes[text] >= WINDOW
            ok &= sizes[text] >= LEAST_TOKENS
            yield pa.RecordBatch.from_arrays([pa.array(h[ok].view(np.int64)), batch.column(0).take(pa.array(text[ok])), pa.array(place[ok])], names=["h", "item_id", "place"])


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, offsets = tokens(batch.column(1))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["item_id", "item"])


def best_window(same: np.ndarray, size: int) -> tuple[int, int]:
    """The most agreements in any window of an item of `size` tokens (13, or the whole of a shorter one), and its start."""
    sums = np.concatenate([[0], np.cumsum(same)])
    w = min(WINDOW, size)
    found = sums[w:] - sums[:-w]
    k = int(found.argmax())
    return int(found[k]), k


def needed(size: int) -> int:
    """Agreements that a window of an item of `size` tokens needs."""
    return MATCHES if size >= WINDOW else size - 1 if size >= 8 else size


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, item_words, matched_words, overlap, best_window, first_word): every item found in a document,
    at the alignment with most agreements (then the first). first_word is the document's token where the item's window begins.

    Null and empty texts hold nothing; rows that share an id count as parts of one document, null ids included. Repeated
    items of one id likewise. Extra columns are ignored. Without documents or items the result is empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    tests = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    keys = checkpoint(tests.mapInArrow(_item_seeds, "h long, item_id long, place long").distinct())
    n_keys = keys.count()
    cell = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    words = keys.withColumn("c", cell).groupBy(F.shiftright("c", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(c % 64 as int)))").alias("b"))
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    for w, b in words.collect():  # at most a million words, whatever the items
        bitmap[w] = b
    shared = spark.sparkContext.broadcast(bitmap.tobytes())  # 8 MB

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, dtype=np.uint64)
        for batch in batches:
            hashes, offsets = tokens(batch.column(1))
            for mask in range(len(MASKS)):
                h, text, place = seeds(hashes, offsets, mask)
                at = h >> np.uint64(64 - BITMAP_BITS)
                hit = np.flatnonzero((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
                if len(hit):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text[hit])), pa.array(h[hit].view(np.int64)), pa.array(place[hit])], names=["doc_id", "h", "place"])

    likely = own.mapInArrow(candidates, "doc_id long, h long, place long")
    named = keys.select("h", "item_id", F.col("place").alias("item_place"))
    hits = likely.join(F.broadcast(named), "h") if n_keys * 32 <= BROADCAST_BYTES else attach(likely, named, "h", F.struct("doc_id", "place"))
    hits = hits.select("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    lists = checkpoint(tests.mapInArrow(_item_tokens, "item_id long, item array<long>").distinct().withColumn("row", F.monotonically_increasing_id()))
    rows = lists.select(F.col("item_id").alias("own"), "row", F.size("item").alias("n"))
    n_lists, list_bytes = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("item") * 8 + 32), F.lit(0))).first()
    if n_lists * 32 <= BROADCAST_BYTES:
        rows = F.broadcast(rows)
    # ids are replaced by the numbers of item texts: repeated ids, and the null one, are items of their own from here on
    hits = checkpoint(hits.join(rows, F.col("item_id").eqNullSafe(F.col("own"))).select("doc_id", "row", "shift", "n"))
    per_doc = hits.groupBy("doc_id").agg(F.collect_list(F.struct("row", "shift", "n")).alias("alignments"))  # 24 bytes each
    n_hits, n_docs = hits.agg(F.count("*"), F.approx_count_distinct("doc_id")).first()
    if n_hits * 24 + n_docs * 64 <= BROADCAST_BYTES:
        per_doc = F.broadcast(per_doc)
    texts = own.alias("o").join(per_doc.alias("p"), F.col("o.doc_id").eqNullSafe(F.col("p.doc_id"))).select("o.doc_id", "o.text", "p.alignments")

    def facing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each alignment: the document's tokens from where the item begins (or the document), to where it ends."""
        for batch in batches:
            hashes, offsets = tokens(batch.column(1))
            hashes = hashes.view(np.int64)
            for i, (doc_id, found) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                doc = hashes[offsets[i] : offsets[i + 1]]
                row, shift, n = (found.values.field(k).to_numpy() for k in range(3))
                for k in range(0, len(row), 1000):
                    parts = [doc[max(0, s) : max(0, s + m)] for s, m in zip(shift[k : k + 1000].tolist(), n[k : k + 1000].tolist(), strict=True)]
                    at = np.cumsum([0] + [len(p) for p in parts])
                    part = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts)))
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(parts), pa.int64()), pa.array(row[k : k + 1000]), pa.array(shift[k : k + 1000]), part], names=["doc_id", "row", "shift", "part"])

    faced = checkpoint(texts.mapInArrow(facing, "doc_id long, row long, shift long, part array<long>"))  # one Python worker a task
    both = faced.join(F.broadcast(lists), "row") if list_bytes <= BROADCAST_BYTES else attach(faced, lists, "row", F.struct("doc_id", "shift"))
    texts = both.select("doc_id", "item_id", "shift", "part", "item")
    schema = "doc_id long, item_id long, item_words long, matched_words long, best_window long, first_word long"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            doc_ids, item_ids, shifts = (batch.column(k).to_pylist() for k in range(3))
            for doc_id, item_id, shift, part, item in zip(doc_ids, item_ids, shifts, batch.column(3), batch.column(4), strict=True):
                doc, item = (np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.int64) for x in (part, item))
                lo = max(0, -shift)
                same = np.zeros(len(item), dtype=np.int64)
                same[lo : lo + len(doc)] = doc == item[lo : lo + len(doc)]
                best, k = best_window(same, len(item))
                if best >= needed(len(item)):
                    out.append((doc_id, item_id, len(item), int(same.sum()), best, shift + k))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["doc_id", "item_id", "item_words", "matched_words", "best_window", "first_word"]).astype({"item_words": "int64", "matched_words": "int64", "best_window": "int64", "first_word": "int64", "doc_id": "Int64", "item_id": "Int64"}), preserve_index=False)

    found = texts.mapInArrow(verify, schema)
    best = F.max(F.struct("matched_words", "best_window", (-F.col("first_word")).alias("before"), "item_words"))
    one = found.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return one.select(
        "doc_id",
        "item_id",
        "b.item_words",
        "b.matched_words",
        F.round(F.col("b.matched_words") / F.col("b.item_words"), 6).alias("overlap"),
        "b.best_window",
        (-F.col("b.before")).alias("first_word"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents in which a benchmark item is found; the columns stay as they are.

    Rows that share an id are one document. Rows without an id are each by itself, known by their text.
    """
    bad = find(docs.where("doc_id is not null"), benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    named = docs.where("doc_id is not null")
    kept = named.join(bad, named["doc_id"] == bad["_bad"], "left_anti")
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return kept
    own = unused("text_hash", docs.columns)
    nameless = nameless.withColumn(own, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    leaks = find(nameless.select(own, "text"), benchmark, id_col=own).select(F.col("doc_id").alias(own)).distinct()
    return kept.unionByName(nameless.join(leaks, own, "left_anti").select(*docs.columns))
