from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from shieldframe.llm import chat


def test_reversible_with_control_strings(spark):
    texts = ["plain", "</turn>\n", '<turn role="assistant">', "\\l \\b \\q \\", "\\### Assistant: </turn> ok", "", None, "é😀\n\n", "<image 1/>"]
    rows = [(1, i, 'as"si<st\\' if i == 3 else "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(None, None, None, "x"), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (2, 0, "assistant", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    chats = chat.format_chats(df.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))).withColumn("turns", chat.parse_chats(F.col("formatted")))
    got = {r.conv_id: r for r in chats.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3] or "") for r in rows[: len(texts)]]
    assert [t.text for t in got[2].turns] == ["a", "b", "b"] and [(t.role, t.text) for t in got[None].turns] == [("", "x")]
    masked = "".join(got[1].formatted[s.start : s.end].replace("\\l", "<").replace("\\b", "\\") for s in got[1].loss_spans)
    assert masked == "".join(t or "" for i, t in enumerate(texts) if i % 2 and i != 3)


def test_parts_become_placeholders(spark):
    parts = [("text", "see <", None, None), ("image", None, "i.png", None), ("audio", None, "a.wav", 7), ("Document", None, None, None), ("odd kind", None, "r", None), (None, "end", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", []), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    row = chat.format_chats(df).first()
    assert row.formatted.startswith('<turn role="user">see \\l<image 2/><audio 3/><document 4/><odd_kind 5/>end</turn>\n')
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in row.attachments] == [(0, 2, "image", "i.png", 256), (0, 3, "audio", "a.wav", 7), (0, 4, "document", None, 512), (0, 5, "odd kind", "r", 0)]
    assert row.media_tokens == 775 and row.loss_spans == []
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_long_texts_and_long_conversations(spark):
    long = "long <text> \\\\ " * 20_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, i, "assistant" if i % 2 else "user", f"t{i} <") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(df.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    got = {r.conv_id: r for r in chat.digests(chats).collect()}
    for c in (1, 2):
        own = [r for r in rows if r[0] == c]
        said = "".join(r[3] for r in own if r[2] == "assistant")
        turns = "".join(f"{r[2]}\n{r[3]}\n" for r in own)
        assert (got[c].n_turns, got[c].loss_chars) == (len(own), len(said))
        assert got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
