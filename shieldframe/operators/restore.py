"""Restoration: tokens and other stored surfaces in a text back to their originals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shieldframe.functions.actions import LOOSE_TOKEN
from shieldframe.functions.nested import let

CAPSULE_CONTEXT = "shieldframe:"


def canonical(token: Column) -> Column:
    """A token as it was written: ASCII upper case, without the blanks that are tolerated around its bars and brackets."""
    return F.upper(F.regexp_replace(token, " ?(\\[\\[|\\||\\]\\]) ?", "$1"))


def restore(text: Column, reverse: Column) -> Column:
    """`text` with every surface that `reverse` (map of surface to original) holds replaced by its original, in one pass.

    Surfaces are tokens, a shown value, a blank and a token, or plain texts. Tokens are found in any ASCII case and with at
    most one blank around their delimiters; a shown value before one is matched in any case. Plain surfaces are found as
    they are, in what lies between tokens, the longest first. Other tokens stay as they are.
    """

    def literal(part: Column, plain: Column) -> Column:
        quoted = F.transform(plain, lambda e: F.concat(F.lit("\\Q"), F.replace(e["shown"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))

        def replaced(pattern: Column) -> Column:
            def pieces(hits: Column) -> Column:
                original = lambda v: F.filter(plain, lambda e: e["shown"] == v)[0]["original"]
                return let(F.split(part, pattern, -1), lambda gaps: F.concat(F.array_join(F.transform(hits, lambda v, i: F.concat(gaps[i], original(v))), ""), F.element_at(gaps, -1)))

            return let(F.regexp_extract_all(part, pattern, F.lit(0)), lambda hits: F.when(F.size(hits) > 0, pieces(hits)).otherwise(part))

        return F.when(F.size(plain) > 0, let(F.array_join(quoted, "|"), replaced)).otherwise(part)

    def build(entries: Column, tokens: Column, plain: Column) -> Column:
        gaps = F.split(text, LOOSE_TOKEN, -1)

        def pieces(gs: Column) -> Column:
            def one(t: Column, i: Column) -> Column:
                hit = F.filter(entries, lambda e: e["token"] == canonical(t))
                return let(
                    F.get(hit, F.lit(0)),
                    lambda e: F.when(e.isNull(), F.concat(literal(gs[i], plain), t))
                    .when(e["shown"] == "", F.concat(literal(gs[i], plain), e["original"]))
                    .when(F.endswith(F.lower(gs[i]), F.lower(e["shown"])), F.concat(literal(F.left(gs[i], F.length(gs[i]) - F.length(e["shown"])), plain), e["original"]))
                    .otherwise(F.concat(literal(gs[i], plain), t)),
                )

            return F.concat(F.array_join(F.transform(tokens, one), ""), literal(F.element_at(gs, -1), plain))

        return let(gaps, pieces)

    entries = F.transform(
        F.map_entries(reverse),
        lambda e: F.struct(
            canonical(F.regexp_extract(e["key"], LOOSE_TOKEN, 0)).alias("token"),
            F.regexp_replace(e["key"], LOOSE_TOKEN + "$", "").alias("shown"),
            e["value"].alias("original"),
        ),
    )
    found = F.regexp_extract_all(text, F.lit(LOOSE_TOKEN), F.lit(0))
    longest = lambda a, b: F.length(b["shown"]) - F.length(a["shown"])
    plain = lambda es: F.array_sort(F.filter(es, lambda e: (e["token"] == "") & (e["shown"] != "")), longest)
    some = lambda ts: (F.size(ts) > 0) | F.exists(F.map_keys(reverse), lambda k: ~k.rlike(LOOSE_TOKEN))
    whole = lambda ts: let(entries, lambda es: let(plain(es), lambda ps: build(es, ts, ps)))
    return let(found, lambda ts: F.when(reverse.isNotNull() & text.isNotNull() & some(ts), whole(ts)).otherwise(text))


def token_pairs(df: DataFrame, text: str, mappings: DataFrame, *, row: str, group: str = "session_id", columns: Sequence[str] = ()) -> DataFrame:
    """(row, replacement, *columns): the mappings (group, replacement, *columns) whose token is in a row's text. `row` names a
    unique column. Nothing but tokens is looked at, so originals can stay sealed until a pair is found."""
    token = lambda c: F.regexp_extract_all(c, F.lit(LOOSE_TOKEN), F.lit(0))
    own = df.select(row, F.col(group).alias("_g"), F.explode(F.array_distinct(F.transform(token(F.col(text)), canonical))).alias("_t"))
    known = mappings.select(F.col(group).alias("_g"), "replacement", *columns, F.explode(F.transform(token(F.col("replacement")), canonical)).alias("_t"))
    return own.join(known, ["_g", "_t"]).select(row, "replacement", *columns)


def with_pairs(df: DataFrame, text: str, pairs: DataFrame, *, row: str, into: str = "restored") -> DataFrame:
    """`df` with its texts restored from a row's own pairs (row, replacement, value); texts without any stay."""
    maps = pairs.groupBy(row).agg(F.map_from_entries(F.collect_set(F.struct("replacement", "value"))).alias("_reverse"))
    return df.join(maps, row, "left").withColumn(into, F.coalesce(restore(F.col(text), F.col("_reverse")), F.col(text))).drop("_reverse")


def restore_found(df: DataFrame, text: str, mappings: DataFrame, *, row: str, group: str = "session_id", into: str = "restored") -> DataFrame:
    """`df` with the texts restored from their group's mappings (group, value, replacement), with no more than a row's own
    mappings in its map: the tokens in its text are joined with the mappings."""
    return with_pairs(df, text, token_pairs(df, text, mappings, row=row, group=group, columns=["value"]), row=row, into=into)


def seal(reverse: Column, key: bytes, session: Column) -> Column:
    """A reverse map as a capsule: AES-256-GCM over its JSON, bound to the session, base64url without padding."""
    sealed = F.aes_encrypt(F.to_json(reverse).cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), F.concat(F.lit(CAPSULE_CONTEXT), session))
    return F.rtrim(F.translate(F.translate(F.base64(sealed), "+/", "-_"), "\r\n", ""), F.lit("="))


def open_capsule(capsule: Column, key: bytes, session: Column) -> Column:
    """The reverse map of a capsule, or null if the key, the session or the capsule is wrong."""
    padded = F.rpad(capsule, (F.ceil(F.length(capsule) / 4) * 4).cast("int"), F.lit("="))
    raw = F.try_aes_decrypt(F.unbase64(F.translate(padded, "-_", "+/")), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.concat(F.lit(CAPSULE_CONTEXT), session))
    return F.from_json(raw.cast("string"), "map<string,string>")
