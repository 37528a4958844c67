"""Secrets: assignments, access keys and long hexadecimal strings by pattern, and random strings by token efficiency.

A byte-pair vocabulary has learnt what people write: words, names and identifiers take few tokens, random strings many.
So a run of letters and digits that takes under `MOST_RATIO` characters a token is random. What is random by design and
no secret is excluded first: digests (by their length, or named in front), UUIDs, and identifiers made of words and
numbers.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shieldframe.llm.scratch import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary's text was split before its pairs were merged.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_RATIO = 2.1
LEAST_CHARS = 20
MOST_VOCABULARY_BYTES = 1 << 24
#: Characters that are handed to the tokenizer at once: a longer run is counted piece by piece, as a whole.
PIECE = 4096
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
_LEAST = {"assign": 8, "access": 16, "hex": 32}

_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_WORDS = ("passw", "secret", "token", "api")  # one of them is in every assignment
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("(?<![0-9a-f])[0-9a-f]{32,}+")  # runs, of which those under 32 characters would be dropped
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+={0,2}" % LEAST_CHARS)
#: Hexadecimal digits of digests in wide use: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
_DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
_HEXADECIMAL = re.compile("[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile("[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
_NAMED_DIGEST = re.compile("(?:sha(?:1|224|256|384|512)|md5)[-_].+", re.IGNORECASE | re.ASCII)
_DIGEST_BEFORE = re.compile("(?:sha-?(?:1|224|256|384|512)|md5|digest|checksum)[\"']?[:=-]\x20?[\"']?$", re.IGNORECASE | re.ASCII)
_PARTS = re.compile("[+/_-]+")
_PART = re.compile("(?:[A-Z]?[a-z]{3,}+|[A-Z]{2,}+(?![a-z])|v?[0-9]++)++|[0-9]{2}(?:T[0-9]{2,6})?Z?")  # words and numbers, or a part of a time


def vocabulary(data: bytes) -> tiktoken.Encoding:
    """A tokenizer from the lines of a vocabulary file: each token's bytes in base 64, a blank, its rank."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("secrets", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def ratio(run: str, tokens: tiktoken.Encoding) -> float:
    """Characters a token of the whole run."""
    return len(run) / sum(len(tokens.encode_ordinary(run[i : i + PIECE])) for i in range(0, len(run), PIECE))


def excluded(run: str, before: str) -> bool:
    """Whether a run is a known form of what looks random and is no secret: a digest, a UUID, a number or an identifier."""
    if run.isdigit() or _UUID.fullmatch(run) or _NAMED_DIGEST.fullmatch(run) or _DIGEST_BEFORE.search(before):
        return True
    if len(run) in _DIGEST_CHARS and _HEXADECIMAL.fullmatch(run):
        return True
    parts = [p for p in _PARTS.split(run.rstrip("=")) if p]
    return len(parts) > 1 and all(len(p) <= 32 and _PART.fullmatch(p) for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base kinds: each kind's matches from left to right, without those too short."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= _LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, tokens: tiktoken.Encoding, taken: list[tuple[int, int, int]], most: float = MOST_RATIO) -> list[tuple[int, int, int, int]]:
    """(start, kind's number, end, characters a thousand tokens) of random runs that touch no base span."""
    found, ends, reach = [], [], 0
    starts = [s for s, _, _ in taken]
    for _, _, e in taken:
        reach = max(reach, e)
        ends.append(reach)
    for m in _RUN.finditer(text):
        i = bisect_right(starts, m.end() - 1)
        if (i and ends[i - 1] > m.start()) or excluded(m[0], text[max(0, m.start() - 16) : m.start()]):
            continue
        r = ratio(m[0], tokens)
        if r < most:
            found.append((m.start(), 3, m.end(), int(1000 * r)))
    return found


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, most_ratio: float = MOST_RATIO) -> DataFrame:
    """One row per row of `docs`: doc_id and spans, an array of kind, start, end (code points, end exclusive) and ratio_milli
    (a random run's characters a thousand tokens, null for base kinds), by start and kind as listed in `KINDS`.

    `path` is the vocabulary file, read on the driver only and sent to the tasks (some 800 KB; over 16 MB is an error). Null
    and empty texts have no spans. Repeated rows stay, null ids too; other columns are ignored. Nothing is shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(path, "rb") as f:
        data = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError("that is no vocabulary: it is too large to send to every task")
    shared = spark.sparkContext.broadcast(data)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("ratio_milli", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(shared.value)
        for batch in batches:
            out = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                every = sorted([(*s, None) for s in base] + random_spans(text, tokens, base, most_ratio), key=lambda s: s[:3])
                out.append([{"kind": KINDS[k], "start": a, "end": b, "ratio_milli": r} for a, k, b, r in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], names=["doc_id", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,ratio_milli:int>>")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Rows of `find` as doc_id, counts of the base kinds, base_sha256, spans (all, joined), n_random and their ratios."""
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long").alias(f"n_{n}")
    return found.select(
        "doc_id", *(count(n) for n in BASE), F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count("random"),
        F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] == "random"), lambda s: s["ratio_milli"].cast("string")), ",").alias("ratios_milli"),
    )
