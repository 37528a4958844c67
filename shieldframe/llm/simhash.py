"""SimHash near-duplicate groups with bit-sliced comparison of fingerprints.

Fingerprints are made from hashed word shingles. Equal fingerprints collapse to one row before any comparison.
Candidates come from every choice of `KEPT` of `BLOCKS` bit blocks: two fingerprints that differ in at most
BLOCKS - KEPT bits agree on at least one choice, so the search is exact for the radius. Within a bucket, bit planes
are stored vertically (one 64-bit word holds one bit of 64 fingerprints), distances of 64 fingerprints at a time are
counted with carry-save bitwise counters, and words of which all lanes exceed the radius are abandoned early. No pairs
leave a bucket: only a star of links for each of its connected groups. Links are between nodes, one per fingerprint,
made of the least id that has it; so the least node of a component is the answer, and no step gathers a component or
the copies of a text under one key. A bucket of over `BUCKET_ROWS` fingerprints is divided by the same rule on the bits
that its fingerprints needn't share, as often as it takes: after four times at most 14 bits are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shieldframe.llm.components import connected_components
from shieldframe.llm.scratch import attach, checkpoint, small_batches

SEED = 42
RADIUS = 4
SHINGLE_WORDS = 4
BLOCKS = 6
KEPT = 2
BUCKET_ROWS = 50_000
#: Buckets with fewer bits left aren't divided: they hold at most 2 ** 11 different fingerprints.
SPLIT_BITS = 12
#: Marks of divided buckets are broadcast up to so many, 24 bytes each; beyond it they are joined by a shuffle.
BROADCAST_BUCKETS = 100_000
_LANES = np.arange(64, dtype=np.uint64)
_ONE = np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Majority bits over the XXH64 of all word shingles, repeats included; 0 without words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    n = len(found) - words + 1
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65536):
        counts += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """Rows (id, fp): the 64-bit fingerprint, as a signed long, of each whole text. Null texts are empty: fingerprint 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t, words) for t in pdf["text"]], dtype=np.uint64)
            yield pd.DataFrame({"id": pdf["id"], "fp": fps.view(np.int64)})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "id long, fp long")


def _planes(fps: np.ndarray, words: np.ndarray, lanes: np.ndarray, n_words: int) -> np.ndarray:
    """Bit plane j holds, in lane l of word w, bit j of the fingerprint that sits there. Rows are in order of their word."""
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    planes = np.zeros((64, n_words), dtype=np.uint64)
    for j in range(64):
        planes[j] = np.bitwise_or.reduceat(((fps >> np.uint64(j)) & _ONE) << lanes, first)
    return planes


def _within(planes: np.ndarray, valid: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which entries (query fingerprint, word of 64 lanes) have lanes within the radius, and those lanes.

    Three bit counters and a sticky overflow hold each lane's distance; they start at 7 - radius, so a lane overflows
    when its distance passes the radius. Entries without lanes left are dropped after each 8 planes.
    """
    start = 7 - radius
    c0, c1, c2 = (np.full(len(word), _ALL if start >> i & 1 else 0, dtype=np.uint64) for i in range(3))
    over, at = ~valid[word], np.arange(len(word))
    for j in range(64):
        x = planes[j][word] ^ (np.uint64(0) - ((query >> np.uint64(j)) & _ONE))
        carry = c0 & x
        c0 ^= x
        x = c1 & carry
        c1 ^= carry
        carry = c2 & x
        c2 ^= x
        over |= carry
        if j % 8 == 7:
            live = over != _ALL
            if not live.all():
                c0, c1, c2, over, at, query, word = (a[live] for a in (c0, c1, c2, over, at, query, word))
                if not len(at):
                    break
    return at, ~over


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the groups of u[i] and v[i]; label[i] ends as the least index of i's group."""
    while len(u):
        a, b = label[u], label[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        keep = low != high
        if not keep.any():
            return
        u, v = u[keep], v[keep]
        np.minimum.at(label, high[keep], low[keep])
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label[:] = nxt


def bucket_links(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS, entries: int = 1 << 16) -> np.ndarray:
    """For each fingerprint (uint64, in order of its group), the least index of those that links within its group reach."""
    n = len(fps)
    label = np.arange(n)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, n])
    place = np.arange(n) - np.repeat(start, size)
    words_in = (size + 63) // 64
    base = np.cumsum(words_in) - words_in
    word = np.repeat(base, size) + place // 64
    lane = (place % 64).astype(np.uint64)
    n_words = int(words_in.sum())
    if not n:
        return label
    first_row = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    planes = _planes(fps, word, lane, n_words)
    valid = np.bitwise_or.reduceat(_ONE << lane, first_row)
    last = np.repeat(base + words_in, size)
    todo = last - word
    todo[np.repeat(size, size) < 2] = 0
    ends = np.cumsum(todo)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + entries, side="right")))
        count = todo[lo:hi]
        row = np.repeat(np.arange(lo, hi), count)
        w = word[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
        at, lanes = _within(planes, valid, fps[row], w, radius)
        row, w = row[at], w[at]
        for i in range(0, len(row), 2048):
            least, most = np.minimum.reduceat(label, first_row), np.maximum.reduceat(label, first_row)
            r, v = row[i : i + 2048], w[i : i + 2048]
            new = (least[v] != label[r]) | (most[v] != label[r])  # a word that is all of the query's group has nothing to add
            r, v = r[new], v[new]
            e, bit = np.nonzero((lanes[i : i + 2048][new, None] >> _LANES) & _ONE)
            _merge(label, r[e], first_row[v[e]] + bit)
        lo = hi
    return label


def _masks(within: int = 0) -> list[int]:
    """Each choice of KEPT of BLOCKS runs of the bits that `within` lacks, together with the bits of `within`."""
    free = [b for b in range(64) if not within >> b & 1]
    edge = [round(i * len(free) / BLOCKS) for i in range(BLOCKS + 1)]
    block = [sum(1 << b for b in free[edge[i] : edge[i + 1]]) for i in range(BLOCKS)]
    return [within | sum(block[i] for i in chosen) for chosen in combinations(range(BLOCKS), KEPT)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: A fingerprint's node: the least id that has it; fingerprints that only null ids have come after all others, by themselves.
NODE = "struct<none:boolean,id:long>"
_LINK = "un boolean, u long, vn boolean, v long"


def _bucketed(radius: int):
    """Streams rows (mask, key, fp, none, id) in order of (mask, key) and gives links between nodes: whole buckets at a time,
    gathered to batches of tens of thousands."""

    def links(part: pd.DataFrame) -> pd.DataFrame:
        fps, none, ids = (part[c].to_numpy() for c in ("fp", "none", "id"))
        group = np.cumsum(np.r_[0, (np.diff(part["key"].to_numpy()) != 0) | (np.diff(part["mask"].to_numpy()) != 0)])
        label = bucket_links(fps.view(np.uint64), group, radius)
        u = np.flatnonzero(label != np.arange(len(fps)))
        v = label[u]
        return pd.DataFrame({"un": none[u], "u": ids[u], "vn": none[v], "v": ids[v]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows < 40_000:
                continue
            part = pd.concat(held, ignore_index=True)
            open_ = ((part["mask"] == part["mask"].iloc[-1]) & (part["key"] == part["key"].iloc[-1])).to_numpy()
            if not open_.all():
                yield links(part[~open_])
            held, rows = [part[open_]], int(open_.sum())
        if rows:
            yield links(pd.concat(held, ignore_index=True))

    return run


def _compared(keyed: DataFrame, radius: int) -> DataFrame:
    dealt = keyed.select("bucket.mask", "bucket.key", "fp", "node.none", "node.id").repartition("mask", "key").sortWithinPartitions("mask", "key")
    node = lambda n, i: F.struct(F.col(n).alias("none"), F.col(i).alias("id")).cast(NODE)
    return dealt.mapInPandas(_bucketed(radius), _LINK).select(node("un", "u").alias("u"), node("vn", "v").alias("v"))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) between the nodes of distinct fingerprints (fp, node) whose components are those of all pairs within the
    radius.

    Buckets are counted first, which combines before the shuffle. Those of over `BUCKET_ROWS` rows go to no task as a whole:
    their fingerprints agree on the bucket's bits, so they are dealt again by choices of blocks of the other bits.
    """
    if not 0 <= radius <= BLOCKS - KEPT:
        raise ValueError(f"the radius can be 0 to {BLOCKS - KEPT}")
    spark, out = fps.sparkSession, None
    rows = fps.select("fp", "node", F.explode(F.lit([_signed(m) for m in _masks()])).alias("mask"))
    while True:
        keyed = rows.select("fp", "node", F.struct("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")).alias("bucket"))
        over = checkpoint(keyed.where(F.bit_count("bucket.mask") <= 64 - SPLIT_BITS).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS).select("bucket"))
        n_over = over.count()
        if n_over:
            flag = over.withColumn("over", F.lit(True))
            keyed = keyed.join(F.broadcast(flag), "bucket", "left") if n_over <= BROADCAST_BUCKETS else attach(keyed, flag, "bucket", F.col("fp"), how="left")
        found = checkpoint(_compared(keyed.where("over is null") if n_over else keyed, radius))
        out = found if out is None else out.union(found)
        if not n_over:
            return out
        again = checkpoint(keyed.where("over").select("fp", "node", "bucket.mask"))
        masks = [r[0] for r in over.select("bucket.mask").distinct().collect()]  # at most 15 for each step, whatever the input
        finer = spark.createDataFrame([(m, _signed(f)) for m in masks for f in _masks(m & int(_ALL))], "mask long, finer long")
        rows = again.join(F.broadcast(finer), "mask").select("fp", "node", F.col("finer").alias("mask"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id) for every row of `docs`: one row in, one row out.

    Words are split at ASCII white space after lower-casing A-Z; null and empty texts have fingerprint zero and link
    like any other. component_id is the least id that links of at most `radius` differing bits reach, the row's own
    included (null ids are not counted; null where a group has no other). Repeated rows stay. Extra columns are ignored.
    """
    fps = checkpoint(fingerprints(docs, id_col, text_col, words).withColumn("row", F.monotonically_increasing_id()))
    least = F.min("id")
    node = F.struct(least.isNull().alias("none"), F.coalesce(least, F.col("fp")).alias("id")).cast(NODE)
    each = checkpoint(fps.groupBy("fp").agg(node.alias("node")))
    groups = connected_components(links(each, radius))
    named = each.join(groups, "node", "left").select("fp", F.coalesce("label", "node").alias("label"))
    named = named.select("fp", F.when(~F.col("label.none"), F.col("label.id")).alias("component_id"))
    out = attach(fps, named, "fp", F.col("row"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` whose id is the least of their near-duplicate group; the columns stay as they are.

    Rows that share an id stay or go together; rows with a null id stay if their group has no other ids.
    """
    groups = near_duplicates(docs, id_col, text_col, radius)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept"]), "left_semi")
