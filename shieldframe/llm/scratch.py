"""Tables that cut lineage, in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the one set on the context. Where neither is set, a local master (tests on
    one machine) gets one of our own; a cluster, whose executors wouldn't see it, gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext.getCheckpointDir()
        if own is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            own = "file://" + tempfile.mkdtemp(prefix="shieldframe-")
            spark.sparkContext.setCheckpointDir(own)
        found = own
    return found.rstrip("/")


def unused(name: str, columns: Iterable[str]) -> str:
    """`name`, with as many underscores in front as make it differ from all of `columns` (Spark ignores their case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def attach(rows: DataFrame, found: DataFrame, key: str, spread: Column, parts: int = 64, how: str = "inner") -> DataFrame:
    """`rows` joined (`inner` or `left`) with `found` (one row per key) on `key`, the rows of one key dealt to `parts` tasks.

    Rows get a part by the hash of `spread`; the distinct (key, part) pairs, of which a key has at most `parts`, are
    joined with `found` first, and the rows then with those. So no task gets more than a part of a hot key's rows,
    whichever keys are hot. Null keys match nothing.
    """
    part = unused("key_part", [*rows.columns, *found.columns])
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))
    return dealt.join(dealt.select(key, part).distinct().join(found, key), [key, part], how).drop(part)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder: survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as Parquet to the shared folder and read again."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 1) -> None:
    """Has Spark hand rows to Python tasks in batches of at most so many rows and bytes, so that long texts don't add up.

    The settings are read when the plan runs, so they stay for the session. Smaller settings of the user's stand.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
