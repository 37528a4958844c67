from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from shieldframe.functions import checks
from shieldframe.functions.actions import TOKEN
from shieldframe.operators import json_trees, payloads, protect, providers
from shieldframe.policy import Blocked, Policy, Rule, uniform
from shieldframe.sources import tables

KEY = bytes(32)
MAIL = "ann@post.example"
RED = "[REDACTED:EMAIL_ADDRESS]"


def trees(spark, values):
    return spark.createDataFrame([(i, v if isinstance(v, str) or v is None else json.dumps(v)) for i, v in enumerate(values)], "id int, body string")


def deep(n):
    return {"a/b": [deep(n - 1)]} if n else {"~x": MAIL, "n": [1, 2.5, None, True, ""], "ü": "é\n\"q\""}


def test_trees_of_any_shape_and_depth(spark):
    values = [deep(0), deep(11), [], {}, [[MAIL], MAIL], f'"{MAIL}"', "7", "nope", None, {MAIL: {"k": f"x {MAIL} y"}}]
    made, _ = json_trees.protect_trees(trees(spark, values), "id", "body", uniform("redact", ("EMAIL_ADDRESS",)))
    got = {r.id: (r.state, None if r.body is None else json.loads(r.body)) for r in made.collect()}

    def change(v):
        if isinstance(v, str):
            return v.replace(MAIL, RED)
        return [change(x) for x in v] if isinstance(v, list) else {k: change(x) for k, x in v.items()} if isinstance(v, dict) else v

    for i, v in enumerate(values):
        want = ("blocked", None) if v in ("nope", None) else ("protected", change(json.loads(v) if isinstance(v, str) else v))
        assert got[i] == want, i


def test_bytes_outside_of_changed_strings_stay(spark):
    red = '"' + RED + '"'
    texts = [
        (' {"b" : 1.10,\t"a":[' + "9" * 47 + ', 1E5,-0.0],"t":"\\u00e9\\/\\n" , "m": "' + MAIL + '","é":"ü","n":null}\n', lambda t: t.replace(f'"{MAIL}"', red)),
        ('{"m":"\\u0061nn@post.example","x":"' + MAIL.replace("@", "\\u0040") + '"}', lambda _: '{"m":' + red + ',"x":' + red + "}"),
        ('{"a":1,"a":2}', lambda _: None), ('["\\ud800"]', lambda _: None), ("[NaN]", lambda _: None), ("[1] [2]", lambda _: None), ("[" * 100_000, lambda _: None), ('"' + MAIL + '"', lambda _: red),
        ("[" * 300 + f'"{MAIL}"' + "]" * 300, lambda t: t.replace(f'"{MAIL}"', red)),
    ]
    df = trees(spark, [t for t, _ in texts])
    made, _ = json_trees.protect_trees(df, "id", "body", uniform("redact", ("EMAIL_ADDRESS",)))
    assert {r.id: r.body for r in made.collect()} == {i: want(t) for i, (t, want) in enumerate(texts)}
    leaves = payloads.leaves(trees(spark, [{"a/b": "x", "a": {"b": "y", "~": ["z"]}}]), ["id"], "body")
    assert {r.pointer: r.value for r in leaves.collect()} == {"/a~1b": "x", "/a/b": "y", "/a/~0/0": "z"}


def test_scopes_are_raw_paths_and_pointers_are_escaped(spark):
    df = trees(spark, [{"a/b": MAIL, "c": [MAIL]}])
    nodes = {r.pointer: r.path for r in json_trees.walk(df, "id", "body").collect()}
    assert nodes == {"": "/", "/a~1b": "/a/b", "/c": "/c", "/c/0": "/c/0"}
    policy = Policy("p", (Rule("EMAIL_ADDRESS", "redact", scopes=("json:/a/b",)),))
    made, _ = json_trees.protect_trees(df, "id", "body", policy)
    assert json.loads(made.first().body) == {"a/b": RED, "c": [MAIL]}


def test_tokens_in_trees_come_back_but_for_blocked_pointers(spark):
    df = trees(spark, [{"show": f"to {MAIL}", "tool": {"arg": MAIL}}, [MAIL]])
    session = spark.createDataFrame([(0, "s"), (1, "s")], "id int, session_id string")
    made, mappings = json_trees.protect_trees(df, "id", "body", uniform("tokenize", ("EMAIL_ADDRESS",)), key=KEY, session=session)
    made = made.select("id", "body").checkpoint()
    assert mappings.count() == 1 and MAIL not in "".join(r.body for r in made.collect())
    back = {r.id: json.loads(r.body) for r in json_trees.restore_trees(made, "id", "body", mappings, ["/tool"], session).collect()}
    assert back[1] == [MAIL] and back[0]["show"] == f"to {MAIL}" and back[0]["tool"]["arg"].startswith("[[PG1|")
    with pytest.raises(Blocked):
        json_trees.protect_trees(df, "id", "body", uniform("tokenize", ("EMAIL_ADDRESS",)))


REQUESTS = [
    ("chat/completions", {"messages": [{"role": "user", "content": MAIL}, {"role": "assistant", "content": None, "function_call": {"name": MAIL, "arguments": MAIL}, "tool_calls": [{"function": {"arguments": MAIL}}]}, {"role": "tool", "content": [{"type": "text", "text": MAIL}, {"type": "tool_result", "content": [{"type": "input_text", "text": MAIL}]}]}], "tools": [{"function": {"description": MAIL}}, {"description": MAIL}], "user": MAIL, "stream": False}, 7),
    ("responses", {"input": MAIL, "instructions": MAIL}, 2),
    ("responses", {"input": [{"type": "message", "role": "user", "content": [{"type": "input_text", "text": MAIL}]}, {"type": "function_call_output", "output": MAIL}]}, 2),
    ("messages", {"system": [{"type": "text", "text": MAIL}], "messages": [{"role": "user", "content": [{"type": "tool_result", "content": MAIL}]}]}, 2),
    ("messages", {"system": MAIL, "messages": []}, 1),
    ("chat/completions", {"messages": []}, "no prompt field"),
    ("chat/completions", {"messages": [{"role": "function", "content": "x"}]}, "unsupported role"),
    ("chat/completions", {"messages": [{"role": "user", "content": [{"type": "image_url"}]}]}, "unsupported content block"),
    ("chat/completions", {"messages": [{"role": "user", "content": [{"type": "text", "text": 5}]}]}, "unsupported content block"),
    ("chat/completions", {"messages": [{"role": "user", "content": {"a": 1}}]}, "unsupported content"),
    ("chat/completions", {"messages": ["x"]}, "messages must be objects"),
    ("chat/completions", {"messages": [{"role": "user", "content": "x", "tool_calls": [{"id": 1}]}]}, "tool calls need function objects"),
    ("chat/completions", {"messages": [{"role": "user", "content": "x", "function_call": {"arguments": {}}}]}, "arguments must be a text"),
    ("chat/completions", {"messages": [{"role": "user", "content": "x"}], "stream": True}, "streams are not supported"),
    ("chat/completions", {"messages": [{"role": "user", "content": "x"}], "tools": [{"description": 4}]}, "descriptions must be texts"),
    ("chat/completions", {"messages": [{"role": "user", "content": "x"}], "tools": {}}, "tools must be an array"),
    ("responses", {"input": [{"type": "reasoning"}]}, "unsupported input type"),
    ("responses", {"input": 5}, "input must be a text or an array"),
    ("responses", {"input": "x", "instructions": 5}, "instructions must be a text"),
    ("messages", {"messages": [{"role": "system", "content": "x"}]}, "unsupported role"),
    ("messages", {"messages": [{"role": "user"}]}, "messages need content"),
    ("messages", {"system": 5, "messages": []}, "system must be a text or text blocks"),
    ("messages", [1], "the body must be a JSON object"),
    (None, {"messages": []}, "unknown endpoint"),
]


def test_requests(spark):
    df = spark.createDataFrame([(i, e, json.dumps(b)) for i, (e, b, _) in enumerate(REQUESTS)], "id int, endpoint string, body string")
    made, _ = providers.protect_requests(df, "id", "body", "endpoint", uniform("redact", ("EMAIL_ADDRESS",)))
    got = {r.id: r for r in made.collect()}
    for i, (_, body, want) in enumerate(REQUESTS):
        if isinstance(want, str):
            assert (got[i].state, got[i].body, got[i].reason) == ("blocked", None, want), i
        else:
            assert got[i].state == "protected" and got[i].body.count(RED) == want, (i, got[i].body)
            assert json.loads(got[i].body.replace(RED, MAIL)) == body
    assert json.loads(got[0].body)["user"] == MAIL and json.loads(got[0].body)["messages"][1]["function_call"]["name"] == MAIL


def test_request_scopes(spark):
    policy = Policy("p", (Rule("EMAIL_ADDRESS", "redact", scopes=("openai.messages/1/tool_calls/0/arguments", "openai.tools/0/description", "anthropic.system/0/text", "openai.responses/instructions")),))
    df = spark.createDataFrame([(i, e, json.dumps(b)) for i, (e, b, _) in enumerate(REQUESTS[:4])], "id int, endpoint string, body string")
    made, _ = providers.protect_requests(df, "id", "body", "endpoint", policy)
    assert {r.id: r.body.count(RED) for r in made.collect()} == {0: 2, 1: 1, 2: 0, 3: 1}


def test_responses(spark):
    base = spark.createDataFrame([(0, "s", MAIL)], "id int, session_id string, t string")
    policy = uniform("tokenize", ("EMAIL_ADDRESS",))
    mappings = protect.allocate(protect.span_table(base, ["session_id"], "t", policy), policy, KEY)
    token = mappings.first().replacement
    bodies = [
        ("chat/completions", {"choices": [{"message": {"content": token, "refusal": None, "tool_calls": []}, "note": token}]}, 1),
        ("chat/completions", {"choices": [{"message": {"content": None, "tool_calls": [{"function": {"arguments": token}}]}}]}, "a token would reach a tool or side effect"),
        ("chat/completions", {"choices": [{"message": {"role": "assistant"}}]}, "a message has no supported field"),
        ("chat/completions", {"choices": [{"message": {"content": []}}]}, "message texts must be text or null"),
        ("responses", {"output": [{"type": "message", "content": [{"type": "output_text", "text": token}, {"type": "refusal", "refusal": token}]}, {"type": "function_call", "arguments": "{}"}]}, 2),
        ("responses", {"output": [{"type": "mcp_call", "arguments": {"x": [token]}}]}, "a token would reach a tool or side effect"),
        ("responses", {"output": [{"type": "reasoning"}]}, "unsupported output"),
        ("messages", {"content": [{"type": "text", "text": token}, {"type": "thinking", "thinking": token}, {"type": "tool_use", "text": "x"}]}, 2),
        ("messages", {"content": [{"type": "tool_use", "input": {token: 1}}]}, "a token would reach a tool or side effect"),
        ("messages", {"content": [{"type": "tool_use", "input": {"a": [token.lower()]}}]}, "a token would reach a tool or side effect"),
        ("messages", {"content": [{"type": "tool_use", "input": {"a": token.replace("|", " | ").replace("[[", "[[ ")}}]}, "a token would reach a tool or side effect"),
        ("messages", {"content": [{"type": "image"}]}, "unsupported content block"),
        ("messages", {"content": "x"}, "content must be an array"),
    ]
    df = spark.createDataFrame([(i, e, json.dumps(b)) for i, (e, b, _) in enumerate(bodies)], "id int, endpoint string, body string")
    session = df.select("id", F.lit("s").alias("session_id"))
    got = {r.id: r for r in providers.restore_responses(df, "id", "body", "endpoint", mappings, session).collect()}
    for i, (_, body, want) in enumerate(bodies):
        if isinstance(want, str):
            assert (got[i].state, got[i].body, got[i].reason) == ("blocked", None, want), i
        else:
            assert got[i].state == "restored" and got[i].body.count(MAIL) == want, (i, got[i].body)
    assert TOKEN and payloads.endpoint is not None


def test_forwarding_rules(spark):
    urls = ["https://api.example", "https://api.example/v1", "http://localhost:80/x", "http://127.0.0.1", "http://[::1]:9/", "http://api.example", "https://u:p@api.example", "https://api.example/?q", "https://api.example#f", "ftp://x", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    got = {r.i: r.ok for r in df.select("i", checks.upstream_url(F.col("u")).alias("ok")).collect()}
    assert [got[i] for i in range(len(urls))] == [True] * 5 + [False] * 5 + [None]
    heads = spark.createDataFrame([({"Authorization": "a", "X-API-Key": "b", "Cookie": "c", "content-type": "d"},)], "h map<string,string>")
    assert heads.select(payloads.allowed_headers(F.col("h")).alias("h")).first().h == {"Authorization": "a", "X-API-Key": "b", "content-type": "d"}
    bodies = ['{"stream":true}', '{"stream":false}', "{}", '{"stream":null}', '{"stream":1}', '{"stream":"no"}']
    asked = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").select("i", payloads.streaming_refused(F.parse_json("b")).alias("no"))
    assert [r.no for r in asked.orderBy("i").collect()] == [True, False, False, False, True, True]
    chunks = spark.createDataFrame([("a", 2, "c"), ("a", 0, "a"), ("a", 1, None), ("b", 5, "x")], "k string, n int, c string")
    assert {r.k: r.body for r in tables.joined_chunks(chunks, "k", "n", "c").collect()} == {"a": "ac", "b": "x"}


def test_traces_have_rules_and_gates(spark):
    df = spark.createDataFrame([(1, f"to {MAIL} or http://a.example/"), (2, None)], "id int, t string")
    policy = Policy("p", (Rule("EMAIL_ADDRESS", "label", priority=3), Rule("URL", "keep")), 7)
    got = {r.id: r.trace for r in protect.explained(df, "t", policy).collect()}
    assert [(d.entity, d.outcome, d.rule and (d.rule.action, d.rule.priority)) for d in got[1].decisions] == [("EMAIL_ADDRESS", "applied", ("label", 3))]
    assert (got[1].applied_count, got[1].state, got[1].gate.passed, got[1].version, got[2].applied_count) == (1, "protected", True, 7, 0)
    none = protect.explained(df, "t", uniform("redact", ("EMAIL_ADDRESS",), required_detectors=("absent",))).first().trace
    assert (none.state, none.decisions, none.gate.passed, none.gate.missing) == ("blocked", None, False, ["absent"])
    assert not protect.explained(df, "t", uniform("tokenize")).first().trace.gate.passed
