"""Helpers for nested Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Running sums inside an array go in blocks of this many elements, so that appending stays cheap in long arrays.
BLOCK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, step: Callable[[Column], Column], kept: Callable[[Column, Column], Column], kind: str) -> Column:
    """kept(sum of step() over the earlier items, item) for each item; `kind` is the SQL type of what kept() returns."""

    def inner(part: Column, start: Column) -> Column:
        zero = F.struct(start.cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(
            part, zero, lambda a, x: F.struct((a["at"] + step(x)).cast("long").alias("at"), F.array_append(a["out"], kept(a["at"], x).cast(kind)).alias("out"))
        )

    def outer(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(all_) - 1, F.lit(BLOCK)), lambda b: F.slice(all_, b + 1, F.lit(BLOCK)))
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        done = F.aggregate(
            blocks,
            zero,
            lambda a, part: let(inner(part, a["at"]), lambda r: F.struct(r["at"].alias("at"), F.array_append(a["out"], r["out"]).alias("out"))),
        )
        return F.flatten(done["out"])

    return let(items, lambda all_: F.when(F.size(all_) > 0, outer(all_)).otherwise(F.array().cast(f"array<{kind}>")))
