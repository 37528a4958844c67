"""WARC archives of web pages with a two-level capture index.

Each task writes its pages as one archive of compressed records. The capture index holds, in order of reversed-host URL
key and page id, where each record is: range-partitioned, in compressed blocks of `BLOCK_LINES` lines, with a sparse
directory that has each block's first key. A lookup goes by binary search from the first keys of the index's parts to
the part's directory, to a block, to a line, and only then reads the record's range of its archive.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shieldframe.llm.files import Output, open_fs, read_range
from shieldframe.llm.scratch import attach, new_path, small_batches, stored

BLOCK_LINES = 512
REVISIT_BYTES = 1000
BROADCAST_ROWS = 100_000
_DATE = "2000-01-01T00:00:00Z"  # records are the same whenever they are written
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """A URL with its host's labels reversed, lower-case and without scheme: `com,example,blog)/path?query`.

    White space and control characters are escaped; without a host the key is the escaped text behind a bracket.
    """
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", (url or "").strip())
    cut = re.search(r"[/?#]", rest)
    host, path = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "/")
    name, colon, port = host.rpartition("@")[2].lower().partition(":")
    key = ",".join(reversed(name.split("."))) + (colon + port if port not in ("", "80", "443") else "") + ")" + path
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", key)


def _key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)} {'-' if page_id is None else page_id}"


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, compressed by itself: a response with its payload, or a revisit that names the response it repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'-' if page_id is None else page_id}>"),
        ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url or "")),
        ("WARC-Date", _DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", _PROFILE)] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields of a compressed record and its payload (empty for revisits)."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to names the response that a page repeats, else null.

    Of pages with equal payloads of at least `REVISIT_BYTES` bytes those with the largest page_id are responses.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    keys = rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    last = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = stored(attach(keys, last, "digest", F.col("page_id")).where("page_id is null or page_id != refers_to").where("refers_to is not null").distinct(), "revisits")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    same = rows["page_id"].eqNullSafe(again["page_id"]) & (rows["digest"] == again["digest"])
    return rows.join(again, same, "left").select(rows["page_id"], "url", "payload", rows["digest"], "refers_to")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and returns their captures (key, archive, start, length), stored so that they're written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        # an attempt has files of its own: captures name the one whose rows count, whatever other attempts write later
        name = f"archive-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out = None
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or Output(f"{folder}/{name}", task.taskAttemptId())
                data = _record(page_id, url, payload, digest, refers_to)
                rows.append((_key(url, page_id), name, out.write(data), len(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "archive", "start", "length"])
        if out:
            out.close()

    return stored(with_revisits(pages).mapInArrow(run, "key string, archive string, start long, length long"), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes the sorted index in parts; returns a row (part, first_key, blocks) per part, which is all a lookup starts from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name = f"index-{task.partitionId():06d}-{task.taskAttemptId()}"
        out, lines, directory = None, [], []

        def flush() -> None:
            first = lines[0].split("\t", 1)[0]
            data = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
            directory.append((first, out.write(data), len(data)))
            lines.clear()

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                out = out or Output(f"{folder}/{name}.cdxz", task.taskAttemptId())
                lines.append(f"{row.key}\t{row.archive}\t{row.start}\t{row.length}")
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out:
            out.close()
            listing = Output(f"{folder}/{name}.dir", task.taskAttemptId())
            listing.write("\n".join(f"{k}\t{s}\t{n}" for k, s, n in directory).encode("utf-8", "surrogatepass"))
            listing.close()
            yield pd.DataFrame({"part": [name], "first_key": [directory[0][0]], "blocks": [len(directory)]})

    order = ["key", "archive", "start"]
    return stored(captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, "part string, first_key string, blocks long"), "parts")


class Index:
    """Lookups by key in an index's parts. Keeps the last part's directory, the last block and the last archive."""

    def __init__(self, folder: str, parts: list[tuple[str, str]]):
        self.folder = folder
        self.parts = sorted((k.encode("utf-8", "surrogatepass"), p) for k, p in parts)
        self.firsts = [k for k, _ in self.parts]
        self.part = self.block = self.archive = None

    def _open(self, name: str):
        fs, path = open_fs(f"{self.folder}/{name}")
        return fs.open_input_file(path)

    def _directory(self, i: int) -> None:
        if self.part != i:
            if self.part is not None:
                self.index.close()
            with self._open(f"{self.parts[i][1]}.dir") as f:
                rows = [line.split(b"\t") for line in f.read().split(b"\n")]
            self.keys, self.spans = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
            self.part, self.block, self.index = i, None, self._open(f"{self.parts[i][1]}.cdxz")

    def _lines(self, b: int) -> None:
        if self.block != b:
            rows = zlib.decompress(read_range(self.index, *self.spans[b])).split(b"\n")
            self.block, self.lines = b, [r.split(b"\t") for r in rows]
            self.line_keys = [r[0] for r in self.lines]

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """Archive, start and length of every capture of a key."""
        wanted = key.encode("utf-8", "surrogatepass")
        i = max(0, bisect_left(self.firsts, wanted) - 1)
        while i < len(self.parts) and self.firsts[i] <= wanted:
            self._directory(i)
            b = max(0, bisect_left(self.keys, wanted) - 1)
            while b < len(self.keys) and self.keys[b] <= wanted:
                self._lines(b)
                k = bisect_left(self.line_keys, wanted)
                while k < len(self.lines) and self.line_keys[k] == wanted:
                    yield self.lines[k][1].decode(), int(self.lines[k][2]), int(self.lines[k][3])
                    k += 1
                b += 1
            i += 1

    def read(self, archive: str, start: int, length: int) -> bytes:
        if self.archive != archive:
            if self.archive is not None:
                self.file.close()
            self.archive, self.file = archive, self._open(archive)
        return read_range(self.file, start, length)


def request_keys(pages: DataFrame) -> DataFrame:
    """The distinct lookup keys (key) of pages (page_id, url)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": [_key(u, None if pd.isna(p) else int(p)) for p, u in zip(pdf["page_id"], pdf["url"], strict=True)]})

    return pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url")).mapInPandas(run, "key string").distinct()


def lookup(keys: DataFrame, folder: str, parts: DataFrame) -> DataFrame:
    """The records of `keys`, by binary search and range reads: page_id, url, record_type, refers_to, payload_digest, payload."""
    first = [(r["first_key"], r["part"]) for r in parts.collect()]  # a row per index part
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, first)
        for batch in batches:
            wanted = sorted({hit for key in batch.column(0).to_pylist() for hit in index.find(key)})
            for i in range(0, len(wanted), 256):
                rows = []
                for hit in wanted[i : i + 256]:
                    fields, payload = parse_record(index.read(*hit))
                    number = lambda name: None if (x := fields.get(name, "")[10:-1]) in ("", "-") else int(x)
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise OSError(f"a payload in {hit[0]} at {hit[1]} doesn't have its digest")
                    rows.append((number("WARC-Record-ID"), fields["WARC-Target-URI"], fields["WARC-Type"], number("WARC-Refers-To"), digest, None if revisit else payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    dealt = keys.repartitionByRange("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html), from what is read back out of the archives: page_id, payload_bytes,
    payload_digest, record_type, refers_to. A revisit's payload is that of the response it names.

    Null html is empty and null urls have an empty host; payloads under `REVISIT_BYTES` bytes are always responses, as
    are pages with a null page_id, which only revisit others. Repeated rows are written and returned each.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = new_path(spark, "warc")
    captures = write_archives(pages, folder)
    parts = write_index(captures, folder)
    read = lookup(request_keys(pages), folder, parts)
    rows = stored(read.select("page_id", "record_type", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("n")), "read")
    name = lambda page: F.concat_ws(":", page, "payload_digest").alias("response")
    full = rows.where("record_type = 'response'").select(name(F.col("page_id")), F.col("n").alias("full_n")).distinct()
    plain = rows.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    revisits = rows.where("record_type = 'revisit'").select("*", name(F.col("refers_to")))
    again = attach(revisits, full, "response", F.col("page_id")).select("page_id", F.col("full_n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return plain.union(again)
