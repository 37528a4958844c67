"""DuckDB SQL for detection and resolution, worked out another way than the engine's.

DuckDB's expressions have no look-around. So a text is cut into maximal runs of the characters that a recognizer's
matches consist of; every place of a run is tried by itself, with the character before it checked apart and the one
after the match consumed; then the leftmost matches that don't overlap are chosen by a fold. The values' checks and the
choice among overlapping candidates are folds too.
"""

from __future__ import annotations

from dataclasses import dataclass

_D, _W, _S = r"\p{Nd}", r"[\p{L}\p{N}_]", r"[\t-\r\x1c-\x20\x85\p{Z}]"
_ATOM = "[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?"
_AREA = "(?:00[1-9]|0[1-9][0-9]|[1-578][0-9][0-9]|6[0-57-9][0-9]|66[0-57-9])"
_GROUP = "(?:0[1-9]|[1-9][0-9])"
_SERIAL = "(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})"
_HEX = "[0-9A-Fa-f]"


@dataclass(frozen=True)
class Scan:
    """How a recognizer's language is found: characters of its matches, what a run must hold, where a match may begin, and
    alternatives of (not before, pattern, not after)."""

    entity: str
    chars: str
    holds: str
    begins: str
    ways: tuple[tuple[str, str, str], ...]
    check: str = "true"
    longest: int = 400  # characters that are looked at from a place on


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"length({_DIGITS}) between 13 and 19 and list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: case when k % 2 = 1 then substr(reverse({_DIGITS}), k, 1)::int when substr(reverse({_DIGITS}), k, 1)::int > 4 then substr(reverse({_DIGITS}), k, 1)::int * 2 - 9 else substr(reverse({_DIGITS}), k, 1)::int * 2 end)) % 10 = 0"
_ABA = f"length({_DIGITS}) = 9 and list_sum(list_transform(range(1, 10), lambda k: substr({_DIGITS}, k, 1)::int * [3, 7, 1][(k - 1) % 3 + 1])) % 10 = 0"
_PART = "(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IP = f"""regexp_matches(v, '^{_PART}(?:[.]{_PART}){{3}}$') or (contains(v, ':') and not contains(v, ':::') and not regexp_matches(v, '[0-9A-Fa-f]{{5}}|[^0-9A-Fa-f:]')
 and not regexp_matches(v, '^:[^:]|[^:]:$') and v != ':' and case len(string_split(v, '::')) when 1 then len(string_split(v, ':')) = 8
 when 2 then len(list_filter(string_split(v, ':'), lambda x: x != '')) <= 7 else false end)"""
_COMPACT = "upper(replace(v, ' ', ''))"
_IBAN = f"""length({_COMPACT}) = case left({_COMPACT}, 2) when 'ES' then 24 when 'FR' then 27 else 22 end and list_reduce(list_transform(string_split(substr({_COMPACT}, 5) || left({_COMPACT}, 4), ''),
 lambda c: case when c >= 'A' then ascii(c) - 55 else ascii(c) - 48 end), lambda a, x: case when x > 9 then (a * 100 + x) % 97 else (a * 10 + x) % 97 end) = 1"""
_URL = r"regexp_matches(v, '^[\x00-\x7f]+$') and regexp_matches(v, '(?i)^https?://(?:[^/?#:@\[\]]+(?::[^/?#@\[\]]*)?|\[[0-9A-Fa-f:.]+\](?::[0-9]*)?)(?:[/?#]|$)')"

_MAIL = r"A-Za-z0-9.!#$%&'*+=?^_`{|}~-"
SCANS = (
    Scan("EMAIL_ADDRESS", f"[@{_MAIL}]", "@", f"[{_MAIL}]", ((rf"[\p{{L}}\p{{N}}{_MAIL}]", rf"[{_MAIL}]{{1,64}}@{_ATOM}(?:\.{_ATOM})+", r"[\p{L}\p{N}_-]"),)),
    Scan("PHONE_NUMBER", rf"[+{_D}() .-]", f"{_D}.*{_D}", rf"[+({_D}]", ((_D, rf"(?:\+?{_D}{{1,3}}[ .-]?)?(?:\({_D}{{2,4}}\)|{_D}{{2,4}})[ .-]{_D}{{3,4}}[ .-]{_D}{{4}}", _D),)),
    Scan("US_SSN", "[0-9 -]", "[0-9].*[0-9]", "[0-9]", ((_D, f"(?:{_AREA}-{_GROUP}-{_SERIAL}|{_AREA} {_GROUP} {_SERIAL}|{_AREA}{_GROUP}{_SERIAL})", _D),)),
    Scan("CREDIT_CARD", f"[{_D} -]", f"{_D}.*{_D}", _D, ((_D, f"(?:{_D}[ -]*?){{13,19}}", _D),), _LUHN),
    Scan("IP_ADDRESS", f"[{_D}A-Fa-f:.]", f":|{_D}[.]", f"[{_D}A-Fa-f:]", (("[0-9A-Fa-f:.]", f"(?:{_HEX}{{0,4}}:){{2,7}}{_HEX}{{0,4}}", "[0-9A-Fa-f:.]"), (f"[{_D}.]", rf"(?:{_D}{{1,3}}\.){{3}}{_D}{{1,3}}", f"[{_D}.]")), _IP),
    Scan("API_KEY", "[A-Za-z0-9_-]", "sk-|gh[pousr]_|AKIA", "[sgA]", (("[A-Za-z0-9]", "(?:sk-[A-Za-z0-9_-]{16,200}|gh[pousr]_[A-Za-z0-9]{20,255}|AKIA[A-Z0-9]{16})", "[A-Za-z0-9]"),)),
    Scan("DATE_TIME", f"[{_D}/.-]", "20", _D, ((_D, f"(?:20{_D}{{2}}[-/]{_D}{{1,2}}[-/]{_D}{{1,2}}|{_D}{{1,2}}[-/.]{_D}{{1,2}}[-/.]20{_D}{{2}})", _D),)),
    Scan("MONEY", rf"[$€£{_D},.USDERGBPusderg bp\t-\r\x1c-\x20\x85\p{{Z}}]", f"(?i){_D}.*(?:usd|eur|gbp)|[$€£].*{_D}", f"[$€£{_D}]", ((_W, f"(?i)(?:[$€£]{_S}?{_D}[{_D} ,.]*{_D}|[$€£]{_S}?{_D}|{_D}[{_D} ,.]*{_D}{_S}?(?:USD|EUR|GBP)|{_D}{_S}?(?:USD|EUR|GBP))", _W),), "strlen(v) <= 128"),
    Scan("URL", f"[^{_S[1:-1]}<>\"']", "://", "[hH]", ((_W, f"(?i)https?://[^{_S[1:-1]}<>\"']+", ""),), _URL),
    Scan("IBAN_CODE", "[A-Za-z0-9 ]", "(?i)de|es|fr|gb", "(?i)de|es|fr|gb", (("[A-Za-z0-9]", "(?i)(?:DE(?: ?[A-Z0-9]){20}|ES(?: ?[A-Z0-9]){22}|FR(?: ?[A-Z0-9]){25}|GB(?: ?[A-Z0-9]){20})", "[A-Za-z0-9]"),), _IBAN, 60),
    Scan("US_BANK_NUMBER", f"[{_D} -]", f"{_D}.*{_D}", _D, ((_D, f"{_D}{{3}}(?:[ -]?{_D}{{3}}){{2}}", _D),), _ABA),
)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _one(scan: Scan) -> str:
    """Rows (r, entity, s, e, v): the recognizer's checked matches of the texts d(r, t), as bytes."""
    found = []
    for before, pattern, after in scan.ways:
        flags = "(?is)" if pattern.startswith("(?i)") or scan.entity == "EMAIL_ADDRESS" else "(?s)"
        body = pattern.removeprefix("(?i)")
        rest = f"(?:[^{after[1:-1] if after.startswith('[') else after}]|$)" if after else ""
        ahead = _quoted(f"{flags}^({body}){rest}")
        found.append(f"case when not regexp_matches(b, {_quoted(before)}) then nullif(regexp_extract(rest, {ahead}, 1), '') end")
    runs = f"select r, i, h[i] run, coalesce(right(g[i], 1), '') prev, coalesce(left(g[i + 1], 1), '') nxt, sum(strlen(g[i]) + strlen(h[i])) over (partition by r order by i) - strlen(h[i]) b0 from (select r, h, g, unnest(range(1, len(h) + 1)) i from (select r, regexp_extract_all(t, {_quoted(scan.chars + '+')}) h, string_split_regex(t, {_quoted(scan.chars + '+')}) g from d where regexp_matches(t, {_quoted(scan.holds)})))"
    places = f"select r, i, b0, run, p, case when p = 1 then prev else substr(run, p - 1, 1) end b, substr(run, p, {scan.longest}) || case when length(run) - p < {scan.longest} then nxt else '' end rest from (select *, unnest(range(1, length(run) + 1)) p from ({runs}) where regexp_matches(run, {_quoted('(?s)' + scan.holds)})) where regexp_matches(substr(run, p, 2), {_quoted('^(?:' + scan.begins + ')')})"
    hits = f"select r, i, b0, run, p, coalesce({', '.join(found)}) v from ({places})"
    chosen = f"select r, list_reduce(list({{'p': p, 'e': p + length(v), 's': b0 + strlen(left(run, p - 1)), 'v': v}} order by p), lambda a, x: case when x.p >= a.e then {{'e': x.e, 'found': list_append(a.found, {{'s': x.s, 'v': x.v}})}} else a end, {{'e': 0::bigint, 'found': []::struct(s hugeint, v varchar)[]}}).found found from ({hits}) where v is not null group by r, i"
    return f"select r, '{scan.entity}' entity, s::int s, (s + strlen(v))::int e, v from (select r, x.s, x.v from (select r, unnest(found) x from ({chosen}))) where {scan.check}"


def candidates(table: str, text: str, key: str) -> str:
    """`with` clauses: d(r, key, t) and c(r, entity, s, e, v), all candidates of all recognizers."""
    parts = ", ".join(f"c_{s.entity.lower()} as materialized ({_one(s)})" for s in SCANS)
    union = " union all ".join(f"select * from c_{s.entity.lower()}" for s in SCANS)
    return f"with d as materialized (select row_number() over () r, {key}, coalesce({text}, '') t from {table}), {parts}, c as materialized ({union})"


def resolved(table: str, text: str, key: str, deny: dict[str, str] | None = None, verdict: str = "null", claimed: str = "true") -> str:
    """The same, and a(r, entity, s, e, v, outcome, ok): every candidate's outcome. `deny` adds terms by entity; `verdict` is SQL
    for the outcome of candidates that aren't eligible, `claimed` for whether the scope claims them. Priorities are equal
    here, so claimed ones go first, then denied ones, longer ones, earlier ones, and by entity."""
    more = ""
    for term, entity in (deny or {}).items():
        cut = f"select r, h[i] v, sum(strlen(g[i]) + strlen(h[i])) over (partition by r order by i) - strlen(h[i]) s from (select r, h, g, unnest(range(1, len(h) + 1)) i from (select r, regexp_extract_all(t, '(?i){term}') h, string_split_regex(t, '(?i){term}') g from d))"
        more += f" union all select r, '{entity}', s::int, (s + strlen(v))::int, v, true from ({cut})"
    every = f"select *, {verdict} verdict, {claimed} claimed from (select *, false denied from c{more})"
    item = "'entity': {0}entity, 's': {0}s, 'e': {0}e, 'v': {0}v, 'claimed': {0}claimed"
    clash = "len(list_filter(done, lambda o: o.ok and x.s < o.e and o.s < x.e)) = 0"
    kind = "struct(entity varchar, s int, e int, v varchar, claimed boolean, ok boolean)[]"
    fold = f"list_reduce(list({{{item.format('')}, 'ok': true}} order by claimed desc, denied desc, s - e, s, entity), lambda done, x: list_append(done, {{{item.format('x.')}, 'ok': {clash}}}), []::{kind})"
    return candidates(table, text, key) + f""", q as materialized ({every}), a as materialized (select r, entity, s, e, v, verdict outcome, false ok from q where verdict is not null
 union all select r, x.entity, x.s, x.e, x.v, case when not x.ok then 'overlap_suppressed' when x.claimed then 'applied' else 'scope_not_claimed' end, x.ok and x.claimed from (select r, unnest({fold}) x from q where verdict is null group by r))"""


def rewritten(replacement: str) -> str:
    """The text of d with the accepted spans of a replaced: a clause p(r, n, t) after `resolved`. `replacement` is SQL over
    a's columns."""
    pieces = f"list({{'s': s, 'e': e, 'x': {replacement}}} order by s) filter (ok)"
    fold = "list_reduce(spans, lambda done, x: {'at': x.e::bigint, 'out': done.out || decode(array_slice(raw, done.at + 1, x.s)) || x.x}, {'at': 0::bigint, 'out': ''})"
    return f"p as (select d.r, coalesce(len(spans), 0) n, case when spans is null then t else f.out || decode(array_slice(raw, f.at + 1, octet_length(raw))) end t from (select d.r, t, raw, spans, {fold} f from (select r, t, encode(t) raw from d) d left join (select r, {pieces} spans from a group by r) x using (r)) d)"
