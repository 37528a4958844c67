"""JSON texts of any shape: their strings as a table of nodes, protected or restored, and put back where they were.

One pass over a text gives a row per node with the bytes it takes. Strings are then plain rows: detection, mappings
and restoration are those of any text column. What has changed is spliced into the text, so all bytes outside of changed
strings stay: the order of keys, numbers as they are written, blanks. Keys never change.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shieldframe.functions import json_lexer
from shieldframe.functions.actions import LOOSE_TOKEN
from shieldframe.functions.recognizers import Detector
from shieldframe.operators import protect, restore
from shieldframe.policy import Policy

_NODE = "depth int, pointer string, path string, parent string, pos int, key string, kind string, text string, json string, holds_token boolean, start int, end int"
_ARROW = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32())
#: Nodes that go to Spark at once.
ROWS = 4096


def nodes_of(df: DataFrame, keys: Sequence[str], json: str) -> DataFrame:
    """A row per JSON node: the keys, and what `json_lexer.nodes` tells of it. Tokens are looked for as loosely as they are
    restored. Texts are read one at a time; a text's nodes are held together."""
    rows = df.select(*keys, F.col(json).cast("string").alias("_json"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keys).dtypes) + ", " + _NODE
    n, names = len(keys), [*keys, *json_lexer.FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = re.compile(LOOSE_TOKEN, re.ASCII)

        def made(batch: pa.RecordBatch, at: list[int], out: list[tuple]) -> pa.RecordBatch:
            own = [batch.column(i).take(pa.array(at, pa.int32())) for i in range(n)]
            columns = zip(*out, strict=True) if out else [[]] * len(_ARROW)
            return pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, _ARROW, strict=True))], names=names)

        for batch in batches:
            at: list[int] = []
            out: list[tuple] = []
            for i, text in enumerate(batch.column(n)):
                found = json_lexer.nodes(text.as_py(), token)
                for k in range(0, len(found), ROWS):
                    out += found[k : k + ROWS]
                    at += [i] * (len(out) - len(at))
                    if len(out) >= ROWS:
                        yield made(batch, at, out)
                        at, out = [], []
            yield made(batch, at, out)

    return rows.mapInArrow(run, schema)


def walk(df: DataFrame, row: str, json: str) -> DataFrame:
    """`nodes_of` with the one key `row`, a unique column: row, depth, pointer (RFC 6901, empty for the root), path (raw keys, `/` for
    the root), parent (pointer), pos, key, kind (OBJECT, ARRAY, STRING, VOID, ... or INVALID), text (of strings), json (of other
    leaves, as written), holds_token (a token anywhere in the node), start and end (bytes). Null and malformed texts are one
    INVALID node."""
    return nodes_of(df, [row], json)


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def rebuild(nodes: DataFrame, df: DataFrame, row: str, json: str = "json") -> DataFrame:
    """The JSON texts of `df` (row, json) with the changed strings of `nodes` (see `protect_nodes`) in place of what was there.
    Rows that have no nodes are left out; INVALID roots, and rows with a string that couldn't be protected, give null."""
    state = nodes.groupBy(row).agg(
        F.array_sort(F.collect_list(F.when(F.col("changed"), F.struct("start", "end", _quoted(F.col("text")).alias("new"))))).alias("_edits"),
        F.bool_or((F.col("kind") == "INVALID") | (F.col("changed") & F.col("text").isNull())).alias("_bad"),
    )
    spliced = protect.rewrite(F.col(json), F.col("_edits"), lambda e: e["new"])
    return df.select(row, json).join(state, row).select(row, F.when(~F.col("_bad"), spliced).alias(json))


def protect_nodes(nodes: DataFrame, row: str, policy: Policy, chosen: Column, scope: Column, *, key: bytes | None = None, session: DataFrame | None = None, known: DataFrame | None = None, found: Sequence[Detector] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The nodes with the strings that `chosen` picks protected, each under its `scope`, and the mappings (null without
    reversible rules). `session` (row, session_id) names the rows' sessions, where values share replacements.

    Raises Blocked where the policy needs a detector or key that isn't there.
    """
    reversible = any(r.reversible for r in policy.active().values())
    names = [d.name for d in found] if found is not None else ["regex-v1"]
    policy.gate(names, has_key=key is not None)
    texts = nodes.where((F.col("kind") == "STRING") & F.coalesce(chosen, F.lit(False))).select(row, "start", F.col("text").alias("_t"), scope.alias("_scope"))
    options = {} if found is None else {"found": found}
    if not reversible:
        done = protect.protect(texts, "_t", policy, scope=F.col("_scope"), key=key, **options).select(row, "start", F.col("protected.text").alias("_new"))
        mappings = None
    else:
        own = texts.join(session, row) if session is not None else texts.withColumn("session_id", F.col(row).cast("string"))
        own = own.withColumn("_id", F.concat_ws("\x00", F.col(row).cast("string"), F.col("start").cast("string")))
        marked = protect.marked(own, "_t", policy, F.col("_scope"), **options)
        mappings = protect.allocate(protect.spans_of(marked, ["session_id"]), policy, key, known)
        done = protect.render_marked(marked, "_t", policy, mappings, key, row="_id").select(row, "start", F.col("protected_text").alias("_new"))
    return _with_texts(nodes, row, done), mappings


def _with_texts(nodes: DataFrame, row: str, texts: DataFrame) -> DataFrame:
    """The nodes with the texts of `texts` (row, start, _new) in place of theirs, and whether that `changed` them."""
    out = nodes.join(texts.withColumn("_there", F.lit(True)), [row, "start"], "left")
    changed = F.coalesce(F.col("_there"), F.lit(False)) & ~F.col("_new").eqNullSafe(F.col("text"))
    return out.withColumn("changed", changed).withColumn("text", F.when(F.col("changed"), F.col("_new")).otherwise(F.col("text"))).drop("_new", "_there")


def protect_trees(df: DataFrame, row: str, json: str, policy: Policy, **options) -> tuple[DataFrame, DataFrame | None]:
    """JSON texts with all their strings protected: (row, json, state), and the mappings. Scopes are `json:` and the raw path.
    Malformed texts are blocked: json is null."""
    nodes, mappings = protect_nodes(walk(df, row, json), row, policy, F.lit(True), F.concat(F.lit("json:"), "path"), **options)
    made = rebuild(nodes, df, row, json)
    return made.withColumn("state", F.when(F.col(json).isNull(), "blocked").otherwise("protected")), mappings


def below(pointer: Column, prefixes: Iterable[str]) -> Column:
    """Whether a pointer is one of the prefixes or below one."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | (pointer == p) | F.startswith(pointer, F.lit(p.rstrip("/") + "/"))
    return hit


def restore_nodes(nodes: DataFrame, row: str, mappings: DataFrame, chosen: Column, session: DataFrame | None = None) -> DataFrame:
    """The nodes with the tokens in the strings that `chosen` picks put back from their session's mappings."""
    texts = nodes.where((F.col("kind") == "STRING") & F.coalesce(chosen, F.lit(False))).select(row, "start", F.col("text").alias("_t"))
    own = texts.join(session, row) if session is not None else texts.withColumn("session_id", F.col(row).cast("string"))
    own = own.withColumn("_id", F.concat_ws("\x00", F.col(row).cast("string"), F.col("start").cast("string")))
    done = restore.restore_found(own, "_t", mappings, row="_id").select(row, "start", F.col("restored").alias("_new"))
    return _with_texts(nodes, row, done)


def restore_trees(df: DataFrame, row: str, json: str, mappings: DataFrame, blocked: Iterable[str] = (), session: DataFrame | None = None) -> DataFrame:
    """JSON texts with their strings restored, but for those at or below a blocked pointer (RFC 6901): (row, json)."""
    nodes = walk(df, row, json)
    return rebuild(restore_nodes(nodes, row, mappings, ~below(F.col("pointer"), blocked), session), df, row, json)
