"""Media columns stored as content-defined chunks.

Every text becomes a WAV clip: its UTF-8 bytes, padded with zeros to a positive multiple of 64, are the 8-bit samples.
A rolling gear hash over the clip's bytes sets the chunk borders, so clips with common stretches have common chunks.
Chunk digests are counted over all clips; a bitmap of fixed size with the digests that occur again goes to the writers.
They pack each clip's other chunks into its row and send out those that may be shared, which Spark deduplicates by
digest into the chunk store. Reading back joins ordered chunk lists with the store by digest, puts the clips together
and verifies them before anything is computed from them. A false hit in the bitmap only sends a chunk to the store.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shieldframe.llm.buffers import mixed
from shieldframe.llm.scratch import attach, small_batches, stored

PAD = 64
LEAST_CHUNK, MEAN_BITS, MOST_CHUNK = 512, 11, 16384
BITMAP_BITS = 26
HOT_REFS = 1000
SENT_DIGESTS = 50_000
_RATE = 8000
_GEAR = mixed(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
_GAP = 32  # zeros before each clip: the hash's window never reaches the clip before


def wav(payload: bytes, length: int) -> bytes:
    """A mono WAV clip with one unsigned 8-bit sample per byte, and the unpadded length in a chunk of its own at the end."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 52 + n, b"WAVE", b"fmt ", 16, 1, 1, _RATE, _RATE, 1, 8, b"data", n)
    return head + payload + struct.pack("<4sIQ", b"blen", 8, length)


def samples(clip: bytes) -> tuple[bytes, int]:
    """The samples of such a clip and their unpadded length; raises if it isn't one."""
    riff, size, wave, fmt, _, pcm, channels, _, _, align, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", clip)
    mono = (riff, wave, fmt, data) == (b"RIFF", b"WAVE", b"fmt ", b"data") and (pcm, channels, align, bits) == (1, 1, 1, 8)
    if not mono or n != len(clip) - 60 or size != n + 52 or clip[-16:-8] != struct.pack("<4sI", b"blen", 8):
        raise ValueError("no 8-bit mono WAV clip")
    return clip[44:-16], struct.unpack("<Q", clip[-8:])[0]


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % PAD or (0 if text else PAD))


def gear(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash after each byte: of the last 32 bytes, each shifted by its age; by doubling, without a loop over bytes."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cuts(clips: list[bytes]) -> list[list[int]]:
    """For each clip the ends of its chunks: where the hash's top bits are zero, at least LEAST_CHUNK and at most MOST_CHUNK apart."""
    whole = np.frombuffer(b"".join(bytes(_GAP) + c for c in clips), dtype=np.uint8)
    if not len(whole):
        return []
    marks = np.flatnonzero(gear(whole) >> np.uint32(32 - MEAN_BITS) == 0) + 1
    starts = np.cumsum([0] + [len(c) + _GAP for c in clips])
    bounds = np.searchsorted(marks, starts)
    found = []
    for i, clip in enumerate(clips):
        ends, last = [], 0
        for m in (marks[bounds[i] : bounds[i + 1]] - starts[i] - _GAP).tolist():
            while m - last > MOST_CHUNK:
                last += MOST_CHUNK
                ends.append(last)
            if m - last >= LEAST_CHUNK and m < len(clip):
                ends.append(m)
                last = m
        while len(clip) - last > MOST_CHUNK:
            last += MOST_CHUNK
            ends.append(last)
        found.append([*ends, len(clip)])
    return found


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _clips(column: pa.Array) -> list[bytes]:
    return [wav(padded(t := text or b""), len(t)) for text in column.to_pylist()]


def _pieces(clips: list[bytes]) -> Iterator[list[bytes]]:
    for clip, ends in zip(clips, cuts(clips), strict=True):
        yield [clip[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def write_clips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stores a clip per row. Returns the clip table (rid, id, chunks: digest and, unless it may be shared, data; n_shared) and the chunk store (digest, data), both as stored."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digest(p) for ps in _pieces(_clips(batch.column(1))) for p in ps]
            names, counts = np.unique(np.array(found, dtype="S16").view("V16") if found else np.zeros(0, "V16"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([n.tobytes() for n in names], pa.binary()), pa.array(counts)], names=["digest", "n"])

    again = texts.mapInArrow(digests, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1")
    cell = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    words = again.select(F.shiftright(cell, 32 - BITMAP_BITS).alias("c")).groupBy(F.shiftright("c", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(c % 64 as int)))").alias("b"))
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    for w, b in words.collect():  # at most a million words, however many chunks
        bitmap[w] = b
    shared = spark.sparkContext.broadcast(bitmap.tobytes())  # 8 MB

    part = pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sent = np.frombuffer(shared.value, dtype=np.uint64), set()
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc_id, pieces in zip(batch.column(0).to_pylist(), _pieces(_clips(batch.column(1))), strict=True):
                chunks, n_shared = [], 0
                for p in pieces:
                    d = _digest(p)
                    c = int.from_bytes(d[:4], "big") >> (32 - BITMAP_BITS)
                    if int(bits[c >> 6]) >> (c & 63) & 1:
                        n_shared += 1
                        chunks.append({"digest": d, "data": None})
                        if d not in sent:
                            if len(sent) >= SENT_DIGESTS:
                                sent.clear()
                            sent.add(d)
                            rows.append((1, None, None, None, None, d, p))
                    else:
                        chunks.append({"digest": d, "data": p})
                rows.append((0, rid, doc_id, chunks, n_shared, None, None))
                rid += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), part, pa.int64(), pa.binary(), pa.binary())
            names = ["kind", "rid", "id", "chunks", "n_shared", "digest", "data"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)

    packed = stored(texts.mapInArrow(pack, "kind int, rid long, id long, chunks array<struct<digest:binary,data:binary>>, n_shared long, digest binary, data binary"), "clips")
    store = stored(packed.where("kind = 1").select("digest", "data").dropDuplicates(["digest"]), "chunks")
    return packed.where("kind = 0").select("rid", "id", "chunks", "n_shared"), store


def read_clips(clips: DataFrame, store: DataFrame) -> DataFrame:
    """(id, clip): every clip, put together from its ordered chunk list. Raises where a chunk is missing or isn't
    what its digest says. A chunk that more than `HOT_REFS` places name is there as often as it takes for no task to send
    it to more places than that."""
    refs = clips.where("n_shared > 0").select("rid", F.posexplode("chunks").alias("pos", "c")).where("c.data is null").select("rid", "pos", F.col("c.digest").alias("digest"))
    hot = refs.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > HOT_REFS).select("digest", F.ceil(F.col("n") / HOT_REFS).cast("int").alias("copies"))
    hot = stored(hot, "hot-chunks")
    refs = attach(refs, hot, "digest", F.col("rid"), how="left").withColumn("copy", F.pmod(F.xxhash64("rid", "pos"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    copies = store.join(hot, "digest", "left").select("digest", "data", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    got = refs.join(copies, ["digest", "copy"]).groupBy("rid").agg(F.collect_list(F.struct("pos", "data")).alias("got"))
    whole = clips.where("n_shared = 0").select("id", "chunks", F.lit(None).cast("array<struct<pos:int,data:binary>>").alias("got"))
    mended = clips.where("n_shared > 0").join(got, "rid", "left").select("id", "chunks", "got")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunks, got in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                fetched = {g["pos"]: g["data"] for g in got or ()}
                pieces = [fetched[i] if c["data"] is None else c["data"] for i, c in enumerate(chunks)]
                if any(_digest(p) != c["digest"] for p, c in zip(pieces, chunks, strict=True)):
                    raise OSError("a chunk doesn't have its digest")
                out.append(b"".join(pieces))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "clip"])

    return whole.union(mended).mapInArrow(build, "id long, clip binary")


def feature(payload: bytes) -> str:
    """Mean and root mean square of the samples about their middle in thousandths, crossings of the middle, and peak."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    rms = round(1000 * float(x @ x / len(x)) ** 0.5)
    return f"mean={round(1000 * int(x.sum()) / len(x))};rms={rms};crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))};peak={int(np.abs(x).max())}"


def store_and_describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`, computed from the clips read back: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature.

    Null and empty texts are 64 zero bytes. Repeated rows stay, null ids too; equal texts get equal values; extra
    columns are ignored.
    """
    clips = read_clips(*write_clips(docs, id_col, text_col))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for clip in batch.column(1).to_pylist():
                p, n = samples(clip)
                rows.append((n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(clip), hashlib.sha256(clip).hexdigest(), feature(p)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True))], names=names)

    return clips.mapInArrow(describe, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
