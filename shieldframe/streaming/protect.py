"""Protection of streams: stateless rules in the plan itself, reversible ones by micro-batch with the vault's mappings."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shieldframe.operators import protect
from shieldframe.operators.shield import Shield
from shieldframe.policy import Policy


def protected(stream: DataFrame, text: str, policy: Policy, **options) -> DataFrame:
    """A stream under a policy without reversible rules: the same expressions as at rest, without state."""
    return protect.protect(stream, text, policy, **options)


def protect_stream(stream: DataFrame, text: str, row: str, shield: Shield, folder: str, checkpoint: str, *, purge: bool = False, now: Callable[[], int] = lambda: int(time.time()), **trigger) -> StreamingQuery:
    """Starts a query that writes the protected rows as Parquet, a folder per micro-batch.

    A batch's mappings are stored in the vault before its rows are rendered; values that have a live mapping keep it, over
    batches and restarts. A batch that is done again replaces its folder, so each row is there once. With `purge`, what
    has expired is deleted before each batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        at = now()
        if purge:
            shield.vault.purge(at)
        shown, _ = shield.protect(batch, text, row, now=at)
        shown.drop(text).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
