"""Readers and writers of structured files: CSV, JSON arrays, JSON lines, reports, and labelled span corpora."""

from __future__ import annotations

import csv
import html
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("csv", "json", "jsonl", "ndjson", "parquet")
MOST_BYTES = 20_000_000
MOST_CASES = 10_000
MOST_TEXT_BYTES = 200_000
CASES = "id string, text string, expected array<struct<entity:string,start:int,end:int>>, allow_terms array<string>"


def format_of(path: str, given: str | None = None) -> str:
    name = (given or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if name not in FORMATS:
        raise ValueError(f"no such structured format: {name}")
    return name


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A table. CSV cells are texts, as written; malformed JSON fails."""
    kind = format_of(path, kind)
    if kind == "csv":
        return spark.read.option("header", True).option("inferSchema", False).option("emptyValue", "").option("mode", "FAILFAST").csv(path)
    if kind == "json":
        shape = F.coalesce(F.schema_of_variant(F.try_parse_json("value")), F.lit(""))
        if not spark.read.text(path, wholetext=True).where(~shape.rlike("^ARRAY<(?:OBJECT<|VOID>)")).isEmpty():
            raise ValueError("a JSON file must be an array of objects")
        return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    return spark.read.option("mode", "FAILFAST").json(path)


def write(df: DataFrame, path: str, kind: str | None = None) -> None:
    """A table as a folder of files of the format; nulls are kept in JSON. Existing targets are an error."""
    kind = format_of(path, kind)
    if kind == "csv":
        df.write.option("header", True).csv(path)
    elif kind == "parquet":
        df.write.parquet(path)
    else:  # JSON arrays are written as lines too: one array would have to go through one task
        df.write.option("ignoreNullFields", False).json(path)


def write_report(df: DataFrame, folder: str, name: str, most_rows: int = 10_000) -> None:
    """A small table as one JSON array, one CSV file and one HTML page in a new folder. For reports: beyond `most_rows` it raises,
    as one file is written by the driver. Existing folders are an error."""
    rows = [r.asDict(recursive=True) for r in df.limit(most_rows + 1).collect()]
    if len(rows) > most_rows:
        raise ValueError("too many rows for a report; use write")
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(folder)):
        raise FileExistsError(folder)
    cell = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str)
    lines = io.StringIO()
    writer = csv.writer(lines)
    writer.writerows([df.columns, *([cell(r[c]) for c in df.columns] for r in rows)])
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(cell(r[c]))}</td>" for c in df.columns) + "</tr>" for r in rows)
    page = f"<!doctype html><meta charset=utf-8><title>{html.escape(name)}</title><table><tr>{head}</tr>{body}</table>"
    files = {"json": json.dumps(rows, indent=2, ensure_ascii=False, default=str) + "\n", "csv": lines.getvalue(), "html": page}
    for kind, text in files.items():
        stream = fs.create(path(f"{folder}/{name}.{kind}"), False)
        stream.write(bytearray(text.encode()))
        stream.close()


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A labelled corpus in JSON lines. Fails on too many cases, long texts, spans out of order, out of the text, inside a
    character, or repeated."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength() > MOST_BYTES:
        raise ValueError("the corpus is too large")
    cases = spark.read.schema(CASES).option("mode", "FAILFAST").json(path)
    raw = F.col("text").cast("binary")
    inside = lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.octet_length("text")) & F.is_valid_utf8(F.substring(raw, s["start"] + 1, s["end"] - s["start"]))
    ordered = F.forall(F.sequence(F.lit(1), F.size("expected")), lambda i: (i == F.size("expected")) | (F.element_at("expected", i)["start"] <= F.get("expected", i)["start"]))
    ok = F.when(F.size("expected") <= 0, True).otherwise(F.forall("expected", inside) & ordered & (F.size(F.array_distinct("expected")) == F.size("expected")))
    bad = cases.where(F.col("text").isNull() | (F.octet_length("text") > MOST_TEXT_BYTES) | ~ok)
    if not bad.isEmpty() or cases.limit(MOST_CASES + 1).count() > MOST_CASES:
        raise ValueError("the corpus has invalid cases or too many")
    return cases


def joined_chunks(chunks: DataFrame, key: str, seq: str, chunk: str) -> DataFrame:
    """Bodies put together from numbered chunks: (key, body)."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(chunk).alias("c"))))
    return chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["c"]), "").alias("body"))
