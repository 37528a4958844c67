"""JSON trees and chat payloads: protection and restoration of their texts, with everything else left as it is.

Known shapes are walked at planning time (`transform_strings`); JSON texts are taken apart into a leaf table in one pass
(`leaves`). Scopes of leaves are `json:/a/b`, by raw keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shieldframe.functions.actions import LOOSE_TOKEN

ROLES = ("system", "developer", "user", "assistant", "tool", "function")
TEXT_TYPES = ("text", "input_text", "output_text")
ENDPOINTS = ("chat/completions", "responses", "messages")  # fixed values
#: Headers that go through to a provider (fixed values).
HEADERS = ("accept", "anthropic-beta", "anthropic-version", "authorization", "content-type", "openai-organization", "openai-project", "user-agent", "x-api-key")


def transform_strings(value: Column, kind: T.DataType, change: Callable[[Column, str], Column], path: str = "", blocked: Iterable[str] = ()) -> Column:
    """`value` with change(text, path) on every string in it; keys stay. Paths below a blocked pointer are left alone."""
    if any(path == b or path.startswith(b + "/") for b in blocked if b):
        return value
    if isinstance(kind, T.StringType):
        return change(value, path or "/")
    if isinstance(kind, T.StructType):
        fields = [transform_strings(value[f.name], f.dataType, change, f"{path}/{f.name}", blocked).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: transform_strings(x, kind.elementType, change, f"{path}/*", blocked))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: transform_strings(v, kind.valueType, change, f"{path}/*", blocked))
    return value


def escape_pointer(key: Column) -> Column:
    """A key as a part of a JSON pointer."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def leaves(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """A row per string leaf of the JSON text column, of whatever depth: the keys, pointer (RFC 6901, `/` for the root) and value. Null
    and malformed texts have no leaves."""
    from shieldframe.operators import json_trees

    found = json_trees.nodes_of(df, keys, json).where("kind = 'STRING'")
    return found.select(*keys, F.when(F.col("pointer") == "", "/").otherwise(F.col("pointer")).alias("pointer"), F.col("text").alias("value"))


def content_ok(content: Column) -> Column:
    """Whether a message's content (variant) is a text or a list of text blocks."""
    kind = F.schema_of_variant(content)
    return (kind == "STRING") | kind.rlike(r"^ARRAY<OBJECT<.*text: STRING.*>>$")


def valid_messages(df: DataFrame, key: str, role: str, text: str) -> DataFrame:
    """A row per conversation: whether every message has an allowed role and a text, and how many are blocked."""
    bad = ~F.coalesce(F.col(role).isin(*ROLES), F.lit(False)) | F.col(text).isNull()
    return df.groupBy(key).agg(F.count("*").alias("messages"), F.sum(bad.cast("long")).alias("blocked")).withColumn("state", F.when(F.col("blocked") > 0, "blocked").otherwise("protected"))


def endpoint(path: Column) -> Column:
    """A provider path without slashes at its ends and its version; null if it isn't one of those allowed."""
    bare = F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "^v1/", "")
    return F.when(bare.isin(*ENDPOINTS), bare)


def streaming_refused(request: Column) -> Column:
    """Whether a request (variant) asks for a stream in any way but false."""
    flag = F.try_variant_get(request, "$.stream", "string")
    return F.coalesce(flag, F.lit("false")) != "false"


def allowed_headers(headers: Column) -> Column:
    """The headers (map) that may go on, by lower-case name."""
    return F.map_filter(headers, lambda k, _: F.lower(k).isin(*HEADERS))


def holds_token(value: Column) -> Column:
    """Whether any token is in a text or in a nested value's JSON: such values must not reach side effects."""
    return value.cast("string").rlike(LOOSE_TOKEN)
