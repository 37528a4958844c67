"""Requests to and responses from model providers: which strings of a body are protected or restored, and what blocks it.

A body's shape is checked on its nodes (see `json_trees`): every object knows the kinds and texts of its few children
that matter, and a body is blocked by the first rule, in order, that one of its nodes breaks. Unknown shapes are blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shieldframe.operators import json_trees
from shieldframe.operators.payloads import ENDPOINTS, TEXT_TYPES
from shieldframe.policy import Policy

CHAT, RESPONSES, MESSAGES = ENDPOINTS
#: Roles that requests may have (fixed values).
ROLES = {CHAT: ("system", "developer", "user", "assistant", "tool"), RESPONSES: ("system", "developer", "user", "assistant"), MESSAGES: ("user", "assistant")}
#: Kinds of output that act on something (fixed values).
ACTS = (
    "apply_patch_call", "code_interpreter_call", "computer_call", "custom_tool_call", "file_search_call", "function_call",
    "image_generation_call", "local_shell_call", "mcp_call", "web_search_call",
)
TOOL_USES = ("mcp_tool_use", "server_tool_use", "tool_use")
_NESTED = r"(?:/[0-9]+/content)*"
_KEYS = ("role", "type", "text", "content", "arguments", "function", "description", "output", "refusal", "thinking", "message", "tool_calls", "function_call", "messages", "input", "instructions", "system", "tools", "stream", "choices")
_KID = "struct<kind:string,text:string,json:string>"


def _with_kids(nodes: DataFrame, row: str) -> DataFrame:
    """Nodes with `kids`: the children of objects under the names that rules ask for."""
    one = F.struct("key", F.struct("kind", F.when(F.col("key").isin("role", "type"), F.col("text")).alias("text"), F.when(F.col("key") == "stream", F.col("json")).alias("json")).alias("v"))
    kids = nodes.where(F.col("key").isin(*_KEYS)).groupBy(F.col(row).alias("_row"), F.col("parent").alias("_at")).agg(F.map_from_entries(F.collect_list(one)).alias("kids"))
    out = nodes.join(kids, (F.col(row) == F.col("_row")) & (F.col("pointer") == F.col("_at")), "left").drop("_row", "_at")
    return out.withColumn("kids", F.coalesce("kids", F.create_map().cast(f"map<string,{_KID}>")))


def _kind(key: str) -> Column:
    return F.coalesce(F.col("kids")[key]["kind"], F.lit("none"))


def _word(key: str) -> Column:
    return F.coalesce(F.col("kids")[key]["text"], F.lit(""))


def _at(pattern: str) -> Column:
    return F.col("pointer").rlike(f"^{pattern}$")


def _request_rules(endpoint: Column) -> list[tuple[str, Column]]:
    """(reason, condition on a node) in order."""
    chat, responses, messages = (endpoint == e for e in ENDPOINTS)
    kind, root = F.col("kind"), F.col("pointer") == ""
    item, message = _at("/(?:messages|input)/[0-9]+"), _at("/messages/[0-9]+")
    content = _at(f"/(?:messages|input)/[0-9]+/content{_NESTED}") | (messages & _at(f"/system{_NESTED}"))
    block = _at(f"/(?:messages|input)/[0-9]+/content{_NESTED}/[0-9]+") | (messages & _at(f"/system{_NESTED}/[0-9]+"))
    roles = F.lit(False)
    for e, names in ROLES.items():
        roles = roles | ((endpoint == e) & _word("role").isin(*names))
    text_block = _word("type").isin(*TEXT_TYPES) & (_kind("text") == "STRING")
    is_list = lambda key: _kind(key) == "ARRAY"
    tool = _at("/tools/[0-9]+")
    return [
        ("unknown endpoint", root & endpoint.isNull()),
        ("the body must be a JSON object", root & (kind != "OBJECT")),
        ("streams are not supported", root & ~_kind("stream").isin("none", "VOID") & (F.coalesce(F.col("kids")["stream"]["json"], F.lit("")) != "false")),
        ("messages must be an array", root & (chat | messages) & ~is_list("messages")),
        ("input must be a text or an array", root & responses & ~_kind("input").isin("STRING", "ARRAY")),
        ("instructions must be a text", root & responses & ~_kind("instructions").isin("none", "STRING")),
        ("system must be a text or text blocks", root & messages & ~_kind("system").isin("none", "VOID", "STRING", "ARRAY")),
        ("tools must be an array", root & ~_kind("tools").isin("none", "ARRAY")),
        ("messages must be objects", item & (kind != "OBJECT")),
        ("unsupported role", message & (chat | messages) & ~roles),
        ("unsupported role", responses & _at("/input/[0-9]+") & (_word("type") == "message") & ~roles),
        ("messages need content", ((messages & message) | (responses & _at("/input/[0-9]+") & (_word("type") == "message"))) & (_kind("content") == "none")),
        ("output must be a text", responses & _at("/input/[0-9]+") & (_word("type") == "function_call_output") & (_kind("output") != "STRING")),
        ("unsupported input type", responses & _at("/input/[0-9]+") & ~_word("type").isin("message", "function_call_output")),
        ("unsupported content", content & ~kind.isin("STRING", "ARRAY") & ~(chat & _at("/messages/[0-9]+/content") & (kind == "VOID"))),
        ("unsupported content block", block & ~((kind == "OBJECT") & (text_block | (_word("type") == "tool_result")))),
        ("arguments must be a text", chat & _at("/messages/[0-9]+/function_call") & (kind == "OBJECT") & (_kind("arguments") != "STRING")),
        ("tool calls need function objects", chat & _at("/messages/[0-9]+/tool_calls/[0-9]+") & ((kind != "OBJECT") | (_kind("function") != "OBJECT"))),
        ("arguments must be a text", chat & _at("/messages/[0-9]+/tool_calls/[0-9]+/function") & (_kind("arguments") != "STRING")),
        ("tools must be objects", tool & (kind != "OBJECT")),
        ("descriptions must be texts", (tool | _at("/tools/[0-9]+/function")) & ~_kind("description").isin("none", "STRING")),
    ]


def _request_texts(endpoint: Column) -> Column:
    """Whether a node's string is prompt text."""
    chat, responses, messages = (endpoint == e for e in ENDPOINTS)
    tools = _at("/tools/[0-9]+/(?:function/)?description")
    walked = lambda base: _at(f"{base}{_NESTED}") | _at(f"{base}{_NESTED}/[0-9]+/text")
    called = _at("/messages/[0-9]+/(?:function_call|tool_calls/[0-9]+/function)/arguments")
    return (
        tools
        | (chat & (walked("/messages/[0-9]+/content") | called))
        | (responses & (_at("/input|/instructions|/input/[0-9]+/output") | walked("/input/[0-9]+/content")))
        | (messages & (walked("/messages/[0-9]+/content") | walked("/system")))
    )


def _scope(endpoint: Column) -> Column:
    """A string's scope: the provider and the place, such as openai.messages/0/content (fixed values)."""
    short = F.regexp_replace(F.substring("pointer", 2, 1 << 30), "/function/", "/")
    provider = F.when(endpoint == MESSAGES, "anthropic.").when((endpoint == RESPONSES) & ~F.startswith("pointer", F.lit("/tools/")), "openai.responses/").otherwise("openai.")
    return F.concat(provider, short)


def _first(nodes: DataFrame, row: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(row, reason): the first rule that a node of the row breaks; null if none does."""
    broken = F.coalesce(*(F.when(c, F.lit(i)) for i, (_, c) in enumerate(rules)), F.lit(None))
    found = nodes.groupBy(row).agg(F.min(broken).alias("_i"))
    return found.select(row, F.get(F.array(*(F.lit(r) for r, _ in rules)), F.col("_i")).alias("reason"))


def _nodes(df: DataFrame, row: str, body: str, endpoint: str) -> DataFrame:
    return _with_kids(json_trees.walk(df, row, body), row).join(df.select(row, F.col(endpoint).alias("_endpoint")), row).checkpoint()


def protect_requests(df: DataFrame, row: str, body: str, endpoint: str, policy: Policy, **options) -> tuple[DataFrame, DataFrame | None]:
    """Request bodies (JSON texts) with their prompt texts, tool arguments and descriptions protected: (row, body, state,
    reason), and the mappings. `endpoint` names a column made by `payloads.endpoint`. A body that breaks a rule is blocked:
    body null, with the reason. Options are those of `json_trees.protect_nodes`."""
    nodes = _nodes(df, row, body, endpoint)
    where = F.col("_endpoint")
    texts = _request_texts(where)
    reasons = _first(nodes, row, _request_rules(where))
    touched = F.max((F.col("kind") == "STRING") & texts | _at("/messages/[0-9]+/(?:content|tool_calls)") & (F.col("kind") == "ARRAY"))
    prompt = nodes.groupBy(row).agg(touched.alias("_touched"))
    reasons = reasons.join(prompt, row).select(row, F.coalesce("reason", F.when((~F.coalesce("_touched", F.lit(False))), "no prompt field")).alias("reason")).checkpoint()
    fine = nodes.join(reasons.where("reason is null").select(row), row, "left_semi")
    done, mappings = json_trees.protect_nodes(fine.drop("kids"), row, policy, texts, _scope(where), **options)
    made = json_trees.rebuild(done, df, row, body)
    out = reasons.join(made, row, "left")
    return out.select(row, body, F.when(F.col(body).isNull(), "blocked").otherwise("protected").alias("state"), "reason"), mappings


def _response_rules(endpoint: Column) -> list[tuple[str, Column]]:
    chat, responses, messages = (endpoint == e for e in ENDPOINTS)
    kind, root = F.col("kind"), F.col("pointer") == ""
    message, choice = _at("/choices/[0-9]+/message"), _at("/choices/[0-9]+")
    out, part, block = _at("/output/[0-9]+"), _at("/output/[0-9]+/content/[0-9]+"), _at("/content/[0-9]+")
    text_or_null = lambda key: _kind(key).isin("none", "VOID", "STRING")
    fields = _kind("content").isin("none") & _kind("refusal").isin("none") & _kind("tool_calls").isin("none") & _kind("function_call").isin("none")
    acts = (responses & out & _word("type").isin(*ACTS)) | (messages & block & _word("type").isin(*TOOL_USES)) | (chat & _at("/choices/[0-9]+/message/(?:tool_calls|function_call)"))
    spoken = (_word("type").isin("output_text", "text") & (_kind("text") == "STRING")) | ((_word("type") == "refusal") & (_kind("refusal") == "STRING"))
    said = ((_word("type") == "text") & (_kind("text") == "STRING")) | ((_word("type") == "thinking") & (_kind("thinking") == "STRING")) | _word("type").isin(*TOOL_USES)
    return [
        ("unknown endpoint", root & endpoint.isNull()),
        ("the body must be a JSON object", root & (kind != "OBJECT")),
        ("choices must be an array", root & chat & (_kind("choices") != "ARRAY")),
        ("output must be an array", root & responses & (_kind("output") != "ARRAY")),
        ("content must be an array", root & messages & (_kind("content") != "ARRAY")),
        ("choices need message objects", chat & choice & ((kind != "OBJECT") | (_kind("message") != "OBJECT"))),
        ("message texts must be text or null", chat & message & ~(text_or_null("content") & text_or_null("refusal"))),
        ("a message has no supported field", chat & message & fields),
        ("unsupported output", responses & out & ~((kind == "OBJECT") & (_word("type").isin(*ACTS) | ((_word("type") == "message") & (_kind("content") == "ARRAY"))))),
        ("unsupported content block", responses & part & ~((kind == "OBJECT") & spoken)),
        ("unsupported content block", messages & block & ~((kind == "OBJECT") & said)),
        ("a token would reach a tool or side effect", acts & F.col("holds_token")),
    ]


def restore_responses(df: DataFrame, row: str, body: str, endpoint: str, mappings: DataFrame, session: DataFrame | None = None) -> DataFrame:
    """Response bodies with the tokens in their texts restored: (row, body, state, reason). Unknown shapes, and tokens in
    anything that acts, block a body. Parts of acting outputs stay as they are."""
    nodes = _nodes(df, row, body, endpoint)
    where = F.col("_endpoint")
    reasons = _first(nodes, row, _response_rules(where)).checkpoint()
    acting = nodes.where(_at("/output/[0-9]+|/content/[0-9]+") & _word("type").isin(*ACTS, *TOOL_USES)).select(F.col(row).alias("_row"), F.col("pointer").alias("_acts"))
    texts = (
        ((where == CHAT) & _at("/choices/[0-9]+/message/(?:content|refusal)"))
        | ((where == RESPONSES) & _at("/output/[0-9]+/content/[0-9]+/(?:text|refusal)"))
        | ((where == MESSAGES) & _at("/content/[0-9]+/(?:text|thinking)"))
    )
    top = F.regexp_extract("pointer", "^/(?:output|content)/[0-9]+", 0)
    fine = nodes.drop("kids").join(reasons.where("reason is null").select(row), row, "left_semi")
    fine = fine.join(acting, (F.col(row) == F.col("_row")) & (top == F.col("_acts")), "left")
    done = json_trees.restore_nodes(fine.withColumn("_text", texts & F.col("_acts").isNull()).drop("_row", "_acts"), row, mappings, F.col("_text"), session)
    out = reasons.join(json_trees.rebuild(done, df, row, body), row, "left")
    return out.select(row, body, F.when(F.col(body).isNull(), "blocked").otherwise("restored").alias("state"), "reason")
