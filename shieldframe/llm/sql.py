"""DuckDB SQL for the rows of the registered queries of this subpackage."""

from __future__ import annotations

from shieldframe.llm import license_scan, mixing, pii, warc

_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "iban": pii.IBAN,
    "secret": r"[A-Za-z0-9_+/-]{20,}",
}


def _pii() -> str:
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda k: case when k % 2 = 1 then substr(reverse({digits}), k, 1)::int when substr(reverse({digits}), k, 1)::int > 4 then substr(reverse({digits}), k, 1)::int * 2 - 9 else substr(reverse({digits}), k, 1)::int * 2 end)) % 10 = 0"
    moved = "substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4)"
    codes = f"list_transform(string_split({moved}, ''), lambda c: case when c >= 'A' then ascii(c) - 55 else ascii(c) - 48 end)"
    checks = {
        "email": "true",
        "ip": rf"regexp_matches(v, '^{part}(?:\.{part}){{3}}$')",
        "card": f"case when length({digits}) between 12 and 19 then {luhn} else false end",
        "phone": f"length({digits}) between 9 and 15",
        "iban": f"list_reduce({codes}, lambda a, x: case when x > 9 then (a * 100 + x) % 97 else (a * 10 + x) % 97 end) = 1",
        "ssn": "not regexp_matches(before, '[0-9-]$') and not regexp_matches(after, '^[0-9-]') and not (i > 1 and gap = '') and not regexp_matches(v, '^(?:000|666|9)') and substr(v, 5, 2) != '00' and substr(v, 8, 4) != '0000'",
        "key": "not regexp_matches(before, '[A-Za-z0-9]$') and not regexp_matches(after, '^[A-Za-z0-9]')",
        "secret": "regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')",
    }
    found, base = [], ", ".join(f"'{k.name}'" for k in pii.KINDS if k.base)
    for n, k in enumerate(pii.KINDS):
        p = _PLAIN.get(k.name, k.pattern).replace("'", "''")
        found.append(
            f"""select doc_id, {n} kind_no, '{k.name}' kind, i, h[i] v, g[i] gap, right(g[i], {pii.CONTEXT_CHARS}) before, left(g[i + 1], {pii.CONTEXT_CHARS}) after,
  {k.points} + case when regexp_matches(lower(right(g[i], {pii.CONTEXT_CHARS})), '(?:^|[^a-z])(?:{k.context})') or regexp_matches(lower(left(g[i + 1], {pii.CONTEXT_CHARS})), '(?:^|[^a-z])(?:{k.context})') then {pii.CONTEXT_POINTS} else 0 end score,
  list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) s
 from (select doc_id, h, g, unnest(range(1, len(h) + 1)) i from (select doc_id, regexp_extract_all(t, '{p}') h, string_split_regex(t, '{p}') g from d))"""
        )
    counts = ", ".join(f"(count(*) filter (kind = '{k.name}'))::bigint n_{k.name}" for k in pii.KINDS)
    one = "kind || ':' || s || ':' || (s + length(v))"
    order = "order by s, kind_no, length(v)"
    return f"""with d as (select row_number() over () r, doc_id id, coalesce(text, '') t from documents),
d2 as (select r doc_id, t from d),
found as ({" union all ".join(x.replace(" from d)", " from d2)") for x in found)}),
kept as (select * from found where case kind {" ".join(f"when '{k}' then {c}" for k, c in checks.items())} end and (kind in ({base}) or score >= {pii.THRESHOLD})),
g as (select doc_id, {counts},
 string_agg({one}, ',' {order}) filter (kind in ({base})) b, string_agg({one}, ',' {order}) a, string_agg(score::varchar, ',' {order}) c from kept group by doc_id)
select d.id doc_id, {", ".join(f"coalesce(n_{k.name}, 0)::bigint n_{k.name}" for k in pii.KINDS)},
 sha256(coalesce(b, '')) base_sha256, coalesce(a, '') spans, coalesce(c, '') scores from d left join g on d.r = g.doc_id"""


def _mix() -> str:
    m = mixing.MOST_REPEATS
    weight = " ".join(f"when {i} then {w}" for i, w in enumerate(mixing.WEIGHTS))
    return rf"""with r as (select row_number() over () rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}'))::bigint size,
  md5(concat_ws(':', '{mixing.SEED}', coalesce(doc_id::varchar, ''), md5(coalesce(text, '')))) k from documents),
t as (select source, sum(size)::bigint source_size from r group by source),
w as (select *, case (row_number() over (order by source is null, source) - 1) % {len(mixing.WEIGHTS)} {weight} end weight,
  row_number() over (order by source is null, source) place, sum(source_size) over () total from t),
l as (select *, {m} * source_size cap, (total - coalesce(sum({m} * source_size) over o, 0))::double / (sum(weight) over () - coalesce(sum(weight) over o, 0)) lev
  from w window o as (order by {m} * source_size / weight::double, place rows between unbounded preceding and 1 preceding)),
f as (select *, case when cap <= weight * lev then cap::double else weight * max(case when cap > weight * lev then lev end) over () end target from l),
o as (select r.*, f.place, f.source_size, f.target, floor(f.target + 0.5)::bigint take, sum(size) over (partition by f.place order by k, doc_id, rid) stop from r join f on r.source is not distinct from f.source)
select doc_id, size, source_size, round(target, 6) target, (case when size = 0 then 0 else list_sum(list_transform(range({m}), lambda c: greatest(0, least(c * source_size + stop, take) - c * source_size - stop + size))) end)::bigint taken from o"""



_CHATS = r"""with m as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
 union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*)::bigint n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, r, t)) turns_sha256,
 coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(t, '' order by turn nulls first, r, t) filter (r = 'assistant'), '')) loss_sha256,
 sum(length('<turn role="') + length(replace(replace(replace(r, '\', '\b'), '<', '\l'), '"', '\q')) + 2 + length(replace(replace(t, '\', '\b'), '<', '\l')) + length('</turn>') + 1)::bigint formatted_chars
from m group by conv_id"""

_WARC = f"""with p as (select page_id, strlen(coalesce(html, ''))::bigint payload_bytes, sha1(coalesce(html, '')) payload_digest from pages),
m as (select payload_digest d, max(page_id) last from p where payload_bytes >= {warc.REVISIT_BYTES} group by 1)
select page_id, payload_bytes, payload_digest, case when last != page_id then 'revisit' else 'response' end record_type, case when last != page_id then last end refers_to
from p left join m on d = payload_digest and payload_bytes >= {warc.REVISIT_BYTES}"""

def _license() -> str:
    x = license_scan
    values = ", ".join(f"({t}, '{n}', '{w}', {k}, {'true' if m else 'false'}, {c})" for t, n, w, k, m, c in x.template_words())
    words = lambda c: f"list_filter(string_split_regex({c}, '{x.BETWEEN}'), lambda w: w != '')"
    return f"""with t(template, license, word, times, must, n_must) as (values {values}),
d as (select row_number() over () rid, doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || (doc_id // 100) dir, lower(coalesce(text, '')) x from documents),
df as (select word, ln({1 + x.RARE} / (count(*) / (select count(*) from d) + {x.RARE})) idf from (select rid, unnest(list_distinct({words("x")})) word from d) group by 1),
k as (select t.*, case when times > 0 then (1 + ln(times)) * coalesce(idf, ln({1 + x.RARE} / {x.RARE})) else 0.0 end y from t left join df using (word)),
s as (select rid, doc_words, unnest(u) unit, unnest(range(1, len(u) + 1)) pos from (select rid, len({words("x")}) doc_words, list_concat(list_concat(string_split_regex(x, '{x.CUT}'), string_split_regex(x, '{x.PARAGRAPH}')), [x]) u from d)),
u as (select rid, doc_words, pos, md5(unit) k, {words("unit")} ws from s),
c as (select k, word, count(*) tf from (select k, unnest(ws) word from (select distinct k, ws from u)) group by 1, 2),
w as (select k, word, tf, (1 + ln(tf)) * idf x from c join df using (word)),
l as (select k, sqrt(sum(x * x)) length, sum(tf) n_words from w group by 1),
tl as (select template, sqrt(sum(y * y)) t_length from k group by 1),
sc as (select w.k, template, license, sum(x * y) dot, count(*) filter (must) have, any_value(n_must) n_must from w join k on k.word = w.word group by 1, 2, 3),
ps as (select k, license, template, n_words, round(dot / (length * t_length), 6) score from sc join l using (k) join tl using (template) where have = n_must and length > 0 and t_length > 0),
b as (select k, arg_max(license, (score, -template)) license, arg_max(template, (score, -template)) template, max(score) score, any_value(n_words) n_words from ps where score >= {x.LEAST_COSINE} group by 1),
pd as (select rid, first(license order by score desc, pos, template) own_license, max(score) own_score, round(max(n_words) / any_value(doc_words), 6) share, count(distinct k) n_matches from u join b using (k) group by 1),
f as (select d.rid, doc_id, dir, dir || '/' || doc_id || '.txt' path, own_license, coalesce(own_score, 0.0) own_score, coalesce(n_matches, 0)::bigint n_matches, coalesce(share >= {x.LEAST_SHARE}, false) speaks from d left join pd using (rid)),
o as (select dir above, first(own_license order by own_score desc, own_license) dir_license from f where speaks group by 1),
a as (select dir, unnest(range(0, len(string_split(dir, '/')) + 1)) depth from (select distinct dir from f)),
nr as (select dir, arg_max(above, depth) from_dir, arg_max(dir_license, depth) dir_license from (select dir, depth, above, dir_license from a join o on above = array_to_string(string_split(dir, '/')[1:depth], '/')) group by 1)
select doc_id, path, own_license, own_score, n_matches, speaks, coalesce(own_license, dir_license) license, case when own_license is null then from_dir end inherited_from from f left join nr using (dir)"""


PII, MIX, LICENSE, WARC, CHATS = _pii(), _mix(), _license(), _WARC, _CHATS

#: The trie of rebuilt conversations: paths are strings of turn digests, CRC-32 goes bit by bit, subtrees come from shared paths.
TRIE = """with recursive w as (select conv_id::bigint conv_id, turn::bigint turn, coalesce(role, '') role, coalesce(text, '') txt from conversations where conv_id is not null),
o as (select conv_id, length(txt)::bigint tokens, sha256(length(role) || ':' || role || txt) turn, row_number() over (partition by conv_id order by turn nulls first, md5(length(role) || ':' || role || txt)) place from w),
x as (select conv_id, conv_id - conv_id % 100 family, conv_id::varchar id, 1 i, 4294967295::bigint crc, 0 bit from (select distinct conv_id from w)
 union all select conv_id, family, id, case when bit = 8 then i + 1 else i end,
  case when bit = 0 then xor(crc, ascii(substr(id, i, 1))::bigint) else xor(crc >> 1, case when crc % 2 = 1 then 3988292384 else 0 end) end, case when bit = 8 then 0 else bit + 1 end from x where i <= length(id)),
h as (select conv_id, family, xor(crc, 4294967295) % 6 head from x where i > length(id)),
t as (select h.conv_id, place depth, turn, tokens from h join o on o.conv_id = h.family and place <= head
 union all select h.conv_id, place - head + least(head, (select count(*) from o f where f.conv_id = h.family)), turn, tokens from h join o on o.conv_id = h.conv_id and place > head),
p as (select conv_id, 0::bigint depth, '' path, '' parent, 0::bigint tokens from h
 union all select conv_id, depth, string_agg(turn, '') over r, coalesce(string_agg(turn, '') over (partition by conv_id order by depth rows between unbounded preceding and 1 preceding), ''), tokens
  from t window r as (partition by conv_id order by depth rows between unbounded preceding and current row)),
e as (select *, depth = max(depth) over (partition by conv_id) last from p),
n as (select path, depth, min(parent) parent, min(conv_id) conv_id, count(*) n_convs, min(tokens) tokens, bool_and(last) leaf,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (last), '')) ends_sha256 from e group by path, depth),
s as (select n.path, sum((m.n_convs - 1) * m.tokens)::bigint saved_tokens, count(*) filter (m.leaf) n_leaves, count(*) filter (m.depth = n.depth + 1) n_children
  from n join (select distinct a.path node, e.path below from e a join e on a.conv_id = e.conv_id and a.depth <= e.depth) b on b.node = n.path join n m on m.path = b.below group by n.path)
select n.conv_id, n.depth, q.conv_id parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
 from n join s on s.path = n.path left join n q on n.depth > 0 and q.path = n.parent and q.depth = n.depth - 1"""
