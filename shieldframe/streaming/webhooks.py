"""Webhook deliveries: signatures, clock skew, and rejection of replays within a time to live.

`verified` and `verified_stream` judge a delivery as a whole, in a fixed order, and remember an id only once its signature
was right: a forged delivery can't block the real one. `first_deliveries` and `without_replays` judge replays alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shieldframe.functions.actions import hmac_sha256

TOLERANCE_SECONDS = 300
#: How far a stream's rows may be behind the latest one; Spark drops those that are later still, so they are never accepted.
LATE_SECONDS = 600
#: What can come of a delivery, in the order in which it is looked at; replays come before signatures.
OUTCOMES = ("body_not_an_object", "bad_headers", "out_of_tolerance", "replayed", "bad_signature", "accepted")


def signature(secret: bytes, ts: Column, delivery: Column, body: Column) -> Column:
    """`sha256=` and the HMAC of timestamp, delivery id and body, joined by dots."""
    message = F.concat(ts.cast("string").cast("binary"), F.lit(".").cast("binary"), delivery.cast("binary"), F.lit(".").cast("binary"), body.cast("binary"))
    return F.concat(F.lit("sha256="), hmac_sha256(secret, message))


def on_time(ts: Column, now: Column, tolerance: int = TOLERANCE_SECONDS) -> Column:
    """Whether a timestamp is at most `tolerance` seconds old or ahead (inclusive)."""
    return F.abs(now - ts) <= tolerance


def delivery_id(text: Column) -> Column:
    """A UUID in its usual form, from any of the forms in which it may be written; null for others."""
    hexed = F.regexp_replace(F.regexp_replace(F.lower(text), "urn:|uuid:", ""), r"^\{+|\}+$", "")
    hexed = F.regexp_replace(hexed, "-", "")
    return F.when(hexed.rlike("^[0-9a-f]{32}$"), F.regexp_replace(hexed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def _claims(body: Column, ts: Column, delivery: Column, supplied: Column, at: Column, secret: bytes, tolerance: int) -> dict[str, Column]:
    """What can be said of a delivery by itself: its id, its time, whether it is signed, and why it is refused, if it is."""
    text = body.cast("binary").cast("string")
    whole = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    is_object = F.coalesce(F.is_valid_utf8(text) & whole & F.json_object_keys(text).isNotNull(), F.lit(False))
    seconds, named = F.trim(ts.cast("string")).try_cast("long"), delivery_id(delivery)
    signed = F.coalesce(supplied == signature(secret, seconds, named, body), F.lit(False))
    why = (
        F.when(~is_object, "body_not_an_object")
        .when(seconds.isNull() | named.isNull() | supplied.isNull(), "bad_headers")
        .when(~F.coalesce(on_time(seconds, at, tolerance), F.lit(False)), "out_of_tolerance")
    )
    return {"_id": named, "_sent": seconds, "_signed": signed, "_why": why}


def _judge(until: int | None, at: int, sent: int, signed: bool, tolerance: int) -> tuple[str, int | None]:
    """The outcome of a delivery that is refused for nothing of its own, and until when its id is remembered."""
    if until is not None and until > at:
        return "replayed", until
    if not signed:
        return "bad_signature", until
    return "accepted", max(at, sent) + tolerance


def verified(df: DataFrame, secret: bytes, *, body: str = "body", ts: str = "timestamp", delivery: str = "delivery", supplied: str = "signature", at: str = "at", tolerance: int = TOLERANCE_SECONDS) -> DataFrame:
    """`df` with its `outcome` (see OUTCOMES) for deliveries at rest; `at` is when one came in, in whole seconds.

    An id is remembered from an accepted delivery on, until `tolerance` seconds after the later of its two times; a delivery at
    just that time counts as new. Deliveries of one id go in order of `at`, those of one time with the signed ones last. What is
    refused by itself is judged where it is; only the rest is shuffled, and a task holds one id's time.
    """
    marks = _claims(F.col(body), F.col(ts), F.col(delivery), F.col(supplied), F.col(at), secret, tolerance)
    rows = df.withColumns(marks)
    refused = rows.where("_why is not null").select(*df.columns, F.col("_why").alias("outcome"))
    rest = rows.where("_why is null").withColumn("_at", F.col(at).cast("long"))
    schema, columns = rest.select(*df.columns, F.lit("").alias("outcome")).schema, df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = until = None
        for batch in batches:
            out = []
            for key, now, sent, signed in zip(*(batch.column(c).to_pylist() for c in ("_id", "_at", "_sent", "_signed")), strict=True):
                if key != current:
                    current, until = key, None
                outcome, until = _judge(until, now, sent, signed, tolerance)
                out.append(outcome)
            yield pa.RecordBatch.from_arrays([*batch.select(columns).columns, pa.array(out, pa.string())], names=[*columns, "outcome"])

    judged = rest.repartition("_id").sortWithinPartitions("_id", "_at", "_signed", "_sent").mapInArrow(run, schema)
    return refused.unionByName(judged)


class VerifyProcessor(StatefulProcessor):
    """State per delivery id: until when it is remembered. A timer at that time clears it, so the state is no larger than what
    was accepted within the tolerance and the lateness."""

    def __init__(self, names: list[str], columns: list[str], tolerance: int):
        self.names, self.columns, self.tolerance = names, columns, tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = self.state.get()[0] if self.state.exists() else None
        before = until
        pdf = pd.concat(rows)
        pdf.columns = self.names  # names that aren't Python's come as numbers
        pdf = pdf.sort_values(["_at", "_signed", "_sent"], kind="stable")
        out = []
        for now, sent, signed, why in zip(pdf["_at"], pdf["_sent"], pdf["_signed"], pdf["_why"], strict=True):
            if isinstance(why, str):
                out.append(why)
            else:
                outcome, until = _judge(until, int(now), int(sent), bool(signed), self.tolerance)
                out.append(outcome)
        if until is not None and until != before:
            if before is not None:
                self.handle.deleteTimer(before * 1000)
            self.state.update((until,))
            self.handle.registerTimer(until * 1000)
        yield pdf.assign(outcome=out)[[*self.columns, "outcome"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def verified_stream(
    stream: DataFrame, secret: bytes, *, body: str = "body", ts: str = "timestamp", delivery: str = "delivery", supplied: str = "signature", at: str = "at", tolerance: int = TOLERANCE_SECONDS, late: int = LATE_SECONDS
) -> DataFrame:
    """The same for a stream, over micro-batches and restarts. Ids are forgotten by timers in the stream's own time (`at`), so the
    state doesn't grow with the ids ever seen. A row goes through in the batch in which it comes. Needs the RocksDB state
    store. Rows without an id, or without a time, are refused by themselves and share no state: they are dealt by their body."""
    marks = _claims(F.col(body), F.col(ts), F.col(delivery), F.col(supplied), F.col(at), secret, tolerance)
    rows = stream.withColumns(marks).withColumn("_at", F.coalesce(F.col(at).cast("long"), F.lit(0)))
    own = F.coalesce(F.when(F.col("_why").isNull(), F.col("_id")), F.concat(F.lit("refused:"), F.md5(F.coalesce(F.col(body).cast("binary"), F.lit(b"")))))
    timed = rows.withColumns({"_key": own, "_time": F.timestamp_seconds(F.coalesce(F.col(at), F.unix_timestamp()))}).withWatermark("_time", f"{late} seconds")
    schema = stream.select("*", F.lit("").alias("outcome")).schema
    return timed.groupBy("_key").transformWithStateInPandas(VerifyProcessor(timed.columns, stream.columns, tolerance), schema, "Append", "EventTime")


def first_deliveries(df: DataFrame, delivery: str, ts: str, ttl: int = TOLERANCE_SECONDS) -> DataFrame:
    """Rows at rest that aren't replays: an id counts again once `ttl` seconds have passed since it was last accepted.

    Rows go through in order of id and time, and a task holds nothing but the time at which the id at hand was last
    accepted. Rows without a time can't be judged and go through; rows without an id count as one id's.
    """

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = last = None
        for batch in batches:
            keep = []
            for key, at in zip(batch.column(delivery).to_pylist(), batch.column(ts).to_pylist()):
                if key != current:
                    current, last = key, None
                keep.append(at is None or last is None or at - last >= ttl)
                if keep[-1] and at is not None:
                    last = at
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.repartition(delivery).sortWithinPartitions(delivery, ts).mapInArrow(accepted, df.schema)


class ReplayProcessor(StatefulProcessor):
    """State per delivery id: the time at which it was last accepted, cleared by a timer once that no longer counts. Rows of a
    micro-batch go in order of time."""

    def __init__(self, names: list[str], columns: list[str], ts: str, ttl: int):
        self.names, self.columns, self.ts, self.ttl = names, columns, ts, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = last = self.state.get()[0] if self.state.exists() else None
        pdf, keep = pd.concat(rows), []
        pdf.columns = self.names
        pdf = pdf.sort_values(self.ts, kind="stable")
        for at in pdf[self.ts]:
            keep.append(bool(pd.isna(at) or last is None or at - last >= self.ttl))
            if keep[-1] and not pd.isna(at):
                last = int(at)
        if last is not None and last != before:
            if before is not None:
                self.handle.deleteTimer((before + self.ttl) * 1000)
            self.state.update((last,))
            self.handle.registerTimer((last + self.ttl) * 1000)
        yield pdf[keep][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def without_replays(stream: DataFrame, delivery: str, ts: str, ttl: int = TOLERANCE_SECONDS, late: int = LATE_SECONDS) -> DataFrame:
    """The same for a stream, over micro-batches and restarts; `ts` is in whole seconds. Rows that come late, with a time before
    the last accepted one, count as replays; those over `late` seconds behind the latest row are dropped. A row goes through in
    the batch in which it comes, and an id's state goes once its time is over. Needs the RocksDB state store."""
    timed = stream.withColumn("_time", F.timestamp_seconds(F.coalesce(F.col(ts), F.unix_timestamp()))).withWatermark("_time", f"{late} seconds")
    return timed.groupBy(delivery).transformWithStateInPandas(ReplayProcessor(timed.columns, stream.columns, ts, ttl), stream.schema, "Append", "EventTime")
