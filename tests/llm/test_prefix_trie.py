from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

from conftest import table
from shieldframe.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    """The turns of each conversation as (role, text), in order of turn (null first), ties by hash."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            found[conv].append((turn is not None, turn or 0, key, (role, text)))
    return {c: [t[3] for t in sorted(ts)] for c, ts in found.items()}


def slow_trie(convs):
    """Every node by its whole sequence of turns."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        kids = children[path]
        leaves[path] = sum(leaves[k] for k in kids) if kids else 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0) + sum(saved[k] for k in kids)
    out = []
    for path, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(convs[c]) == len(path)))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(cs), len(path), parent, len(cs), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def slow_rebuilt(rows):
    own = ordered(rows)
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def result(df):
    assert df.columns == COLUMNS and {t for _, t in df.dtypes} == {"bigint", "string"}
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    conversations = table(spark, "conversations", "sf0.01")
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    got = result(prefix_trie.of_rebuilt(conversations))
    assert got == slow_trie(slow_rebuilt(rows)) and sum(r[3] > 1 for r in got) > 3


def made(seed, n_convs, most_turns, words):
    rng = random.Random(seed)
    return [(c, t, rng.choice(("user", "assistant")), rng.choice(words)) for c in rng.sample(range(400), n_convs) for t in range(rng.randint(1, most_turns))]


def test_shared_beginnings(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", 3)
    monkeypatch.setattr(prefix_trie, "IDS_A_ROW", 4)
    rows = made(1, 120, 9, ["a", "bb", "é" * 3]) + [(c, t, "user", "same" * t) for c in range(1000, 1060) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert result(prefix_trie.of_rebuilt(df)) == slow_trie(slow_rebuilt(rows))
    convs, turns = prefix_trie.plain_turns(prefix_trie.numbered(df))
    assert result(prefix_trie.trie(convs, turns)) == slow_trie(ordered(rows))


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "nobody"), (5, None, "user", "first"), (5, 0, None, None), (5, 0, None, None), (5, -3, "user", ""), (100, 2, "", "x"), (100, 2, "x", ""), (101, 1, "a", "b" * 100_000),
        (205, 0, "user", "only"), (-7, 0, "user", "minus"), (-107, 4, "user", "minus"),
    ]
    rows += [(300, t, "user", str(t % 7)) for t in range(3000)] + [(301, t, "user", str(t % 7)) for t in range(2500)]
    rows = [r for r in rows if r[0] is None or r[0] >= 0] + [(c, t, r, x) for c, t, r, x in rows if c is not None and c < 0]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "2 as node", "3 as key_part")
    own = ordered(rows)
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = c - (abs(c) % 100) * (1 if c >= 0 else -1)  # remainders have the sign of the id
        want[c] = own.get(family, [])[:h] + turns[h:]
    assert result(prefix_trie.of_rebuilt(df)) == slow_trie(want)
    assert result(prefix_trie.of_rebuilt(df.limit(0))) == []
