"""Where the values of a JSON text are: one pass from left to right, whatever its depth."""

from __future__ import annotations

import json
import re

_PIECE = re.compile(r'[ \t\n\r]*([{}\[\],:]|"[^"\\]*(?:\\.[^"\\]*)*"|[^ \t\n\r{}\[\],:"]+)', re.DOTALL)
_LITERALS = {"t": "BOOLEAN", "f": "BOOLEAN", "n": "VOID"}
#: What a node is told as, in this order.
FIELDS = ("depth", "pointer", "path", "parent", "pos", "key", "kind", "text", "json", "holds_token", "start", "end")
INVALID = (0, "", "/", None, 0, None, "INVALID", None, None, False, 0, 0)


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _once(pairs: list[tuple]) -> None:
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError("a key is there twice")


def nodes(text: str | None, token: re.Pattern[str]) -> list[tuple]:
    """The nodes of a JSON text, parents before children, as tuples of FIELDS: depth, pointer (RFC 6901), path (raw keys), the
    parent's pointer, place among its siblings, key, kind (OBJECT, ARRAY, STRING, NUMBER, BOOLEAN, VOID), text (of strings),
    json (other leaves as written), whether `token` is in a string or key of it, and the bytes it takes. Null and malformed texts,
    those with a key twice or half a surrogate pair, and those nested too deeply for Python's parser are one INVALID node."""
    try:
        json.loads(text, parse_constant=_no_constant, object_pairs_hook=_once)
    except (TypeError, ValueError, RecursionError):
        return [INVALID]
    out: list[list] = []
    stack: list[list] = []  # open containers: node's number, next place, key of the value to come (null between members)
    at_char = at_byte = 0
    for m in _PIECE.finditer(text):
        piece, start = m[1], m.start(1)
        at_byte += (start - at_char) if text.isascii() else len(text[at_char:start].encode())
        at_char = start
        if piece in ",:":
            continue
        size = len(piece.encode())
        if piece in "}]":
            number = stack.pop()[0]
            out[number][11] = at_byte + 1
            if stack and out[number][9]:
                out[stack[-1][0]][9] = True
            continue
        value = json.loads(piece) if piece[0] == '"' else None
        if value is not None and not value.isascii() and any("\ud800" <= c <= "\udfff" for c in value):
            return [INVALID]
        above = stack[-1] if stack else None
        if above is not None and out[above[0]][6] == "OBJECT" and above[2] is None:
            above[2] = value
            if token.search(value):
                out[above[0]][9] = True
            continue
        depth, pointer, path, parent, pos, key = 0, "", "/", None, 0, None
        if above is not None:
            holder = out[above[0]]
            pos, key = above[1], above[2]
            name = str(pos) if key is None else key
            depth, parent = holder[0] + 1, holder[1]
            pointer = f"{parent}/{name.replace('~', '~0').replace('/', '~1')}"
            path = f"{'' if holder[2] == '/' and holder[0] == 0 else holder[2]}/{name}"
            above[1], above[2] = pos + 1, None
        node = [depth, pointer, path, parent, pos, key, "", None, None, False, at_byte, at_byte + size]
        if piece in "{[":
            node[6] = "OBJECT" if piece == "{" else "ARRAY"
            stack.append([len(out), 0, None])
        elif value is not None:
            node[6:10] = "STRING", value, None, token.search(value) is not None
        else:
            node[6], node[8] = _LITERALS.get(piece[0], "NUMBER"), piece
        if above is not None and node[9]:
            out[above[0]][9] = True
        out.append(node)
    return [tuple(n) for n in out]
