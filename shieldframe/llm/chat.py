"""Chat formatting: typed content parts flattened into a marked, reversible text with loss spans. SQL functions only.

A turn is written ``<turn role="R">TEXT</turn>`` and a line feed. Inside texts and roles a backslash becomes ``\\b``, a
``<`` becomes ``\\l`` and, in roles, a double quote becomes ``\\q``; no raw ``<`` is left there, so no text can open or
close a turn, and undoing the three in turn gives the text back. Parts other than text become placeholders
``<image 1/>``, numbered over the conversation's turn; a text can't contain one unescaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shieldframe.functions.nested import let, running

#: Tokens that a part stands for where it doesn't say (fixed values).
PART_TOKENS = {"image": 256, "audio": 128, "document": 512}
PARTS = "array<struct<type:string,text:string,ref:string,tokens:int>>"
_ATTACHED = "struct<part:int,type:string,ref:string,tokens:int>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit('"'), F.lit("\\q"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\q"), F.lit('"')))


def visit_parts(parts: Column) -> Column:
    """Flattens typed parts: struct of body (escaped text with placeholders), attachments, and media_tokens.

    Text parts are joined with nothing between; null texts are empty. Other kinds get a placeholder numbered by the
    part's place, an attachment with their reference, and their own token count or that of `PART_TOKENS` (else 0).
    """
    kind = lambda p: F.coalesce(F.lower(p["type"]), F.lit("text"))
    tokens = lambda p: F.coalesce(p["tokens"], *(F.when(kind(p) == k, F.lit(n)) for k, n in PART_TOKENS.items()), F.lit(0))
    numbered = F.transform(parts, lambda p, i: F.struct(p.alias("p"), (i + 1).alias("n")))
    body = F.array_join(
        F.transform(
            numbered,
            lambda x: F.when(kind(x["p"]) == "text", escape(F.coalesce(x["p"]["text"], F.lit("")))).otherwise(
                F.concat(F.lit("<"), F.regexp_replace(kind(x["p"]), "[^a-z0-9_-]", "_"), F.lit(" "), x["n"].cast("string"), F.lit("/>"))
            ),
        ),
        "",
    )
    media = F.transform(
        F.filter(numbered, lambda x: kind(x["p"]) != "text"),
        lambda x: F.struct(x["n"].alias("part"), kind(x["p"]).alias("type"), x["p"]["ref"].alias("ref"), tokens(x["p"]).alias("tokens")).cast(_ATTACHED),
    )
    return F.struct(body.alias("body"), media.alias("attachments"), F.aggregate(media, F.lit(0), lambda a, m: a + m["tokens"]).alias("media_tokens"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))).cast(PARTS)


def format_chats(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, parts) to one row per conversation: conv_id, formatted, loss_spans (start, end in
    code points of `formatted`: the bodies of assistant turns), attachments (turn's place, part, type, ref, tokens) and
    media_tokens.

    Turns go in order of turn, null first, then role and body, so ties and repeated rows have a defined place and all
    stay. Null roles are empty; a null or empty list of parts is an empty text; null conversation ids form one
    conversation. Extra columns are ignored.
    """
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visit_parts(F.coalesce("parts", F.array().cast(PARTS))).alias("v"))
    rows = rows.select("conv_id", F.struct("turn", "role", F.col("v.body").alias("body"), F.col("v.attachments").alias("attachments"), F.col("v.media_tokens").alias("media_tokens")).alias("m"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    piece = F.transform(
        "ms",
        lambda m: let(F.concat(F.lit('<turn role="'), escape_role(m["role"]), F.lit('">')), lambda head: F.struct(m["role"].alias("role"), head.alias("head"), F.concat(m["body"], F.lit("</turn>\n")).alias("tail"), F.length(m["body"]).alias("chars"))),
    )
    pieces = whole.select("conv_id", "ms", piece.alias("pieces"))
    spans = running(
        F.col("pieces"),
        lambda p: F.length(p["head"]) + F.length(p["tail"]),
        lambda at, p: F.struct((at + F.length(p["head"])).alias("start"), (at + F.length(p["head"]) + p["chars"]).alias("end"), p["role"].alias("role")),
        "struct<start:bigint,end:bigint,role:string>",
    )
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["tail"])), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["role"] == "assistant"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss_spans"),
        F.flatten(F.transform("ms", lambda m, i: F.transform(m["attachments"], lambda a: F.struct(i.alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate("ms", F.lit(0).cast("long"), lambda a, m: a + m["media_tokens"]).alias("media_tokens"),
    )


def parse_chats(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), placeholders left in the text as they are."""
    pieces = F.filter(F.split(formatted, "</turn>\n", -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: let(
            F.instr(p, '">'),
            lambda cut: F.struct(
                unescape_role(F.substring(p, F.lit(13), cut - 13)).alias("role"), unescape(F.substring(p, cut + 2, F.length(p))).alias("text")
            ),
        ),
    )


def digests(chats: DataFrame) -> DataFrame:
    """Read back from `formatted` and `loss_spans`: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = parse_chats(F.col("formatted"))
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    read = chats.select("conv_id", "formatted", turns.alias("turns"), masked.alias("masked"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
