"""More registered queries: requests of all providers, reversible and tolerant round trips, many denied terms, traces, made families."""

from __future__ import annotations

from pyspark.sql import functions as F

from shieldframe.functions import actions
from shieldframe.functions.recognizers import DenyListDetector
from shieldframe.operators import payloads, protect, providers, reports, resolve, restore, synthesis
from shieldframe.plans import detection_sql
from shieldframe.plans.catalog import KEY, _checkpoints, _dealt, _seed_sql, _spread, _table, query
from shieldframe.policy import Policy, Rule, uniform

#: By turn modulo 3: the endpoint, and where a body of it has the turn's text.
_PLACES = {
    0: ("responses", ("/instructions", "/input/0/content/0/text", "/input/1/output", "/tools/0/description")),
    1: ("messages", ("/system/0/text", "/messages/0/content", "/messages/1/content/0/content", "/tools/0/description")),
    2: ("chat/completions", ("/messages/0/tool_calls/0/function/arguments", "/messages/1/content", "/tools/0/function/description")),
}
_PLACES_SQL = ", ".join(f"({k}, '{e}', '{p}')" for k, (e, ps) in _PLACES.items() for p in ps)


@query(
    detection_sql.resolved("(select * from conversations where text is not null)", "text", "conv_id, turn") + ", " + detection_sql.rewritten("'[REDACTED:' || entity || ']'")
    + f" select conv_id, turn, endpoint, pointer, md5(p.t) text_md5 from p join d using (r) join (values {_PLACES_SQL}) q(k, endpoint, pointer) on q.k = turn % 3"
)
def provider_requests(spark, sf_dir):
    """Requests of every provider around each turn's text: inputs, instructions, system texts, tool results, arguments and tool
    descriptions are protected."""
    _checkpoints(spark)
    t = F.expr("substr(to_json(array(text)), 2, length(to_json(array(text))) - 2)")
    bodies = {
        0: '{"instructions":@,"input":[{"type":"message","role":"user","content":[{"type":"input_text","text":@}]},{"type":"function_call_output","call_id":"c","output":@}],"tools":[{"type":"function","name":"f","description":@',
        1: '{"system":[{"type":"text","text":@}],"messages":[{"role":"user","content":@},{"role":"user","content":[{"type":"tool_result","content":@}]}],"tools":[{"name":"f","description":@',
        2: '{"messages":[{"role":"assistant","content":null,"tool_calls":[{"function":{"name":"f","arguments":@}}]},{"role":"user","content":@}],"tools":[{"type":"function","function":{"name":"f","description":@',
    }
    ends = {0: "}]}", 1: "}]}", 2: "}}]}"}
    k, made, path = F.col("turn") % 3, None, None
    for i, form in bodies.items():
        body = F.concat(*(x for part in form.split("@")[:-1] for x in (F.lit(part), t)), F.lit(ends[i]))
        made = F.when(k == i, body) if made is None else made.when(k == i, body)
        path = F.when(k == i, _PLACES[i][0]) if path is None else path.when(k == i, _PLACES[i][0])
    turns = _table(spark, sf_dir, "conversations").where("text is not null")
    rows = turns.select(F.concat_ws("/", "conv_id", "turn").alias("id"), made.alias("body"), payloads.endpoint(path).alias("endpoint"))
    done, _ = providers.protect_requests(rows, "id", "body", "endpoint", uniform("redact"))
    wanted = spark.createDataFrame([(e, p) for e, ps in _PLACES.values() for p in ps], "endpoint string, pointer string")
    found = payloads.leaves(done.where("state = 'protected'").join(rows.select("id", "endpoint"), "id"), ["id", "endpoint"], "body").join(F.broadcast(wanted), ["endpoint", "pointer"], "left_semi")
    own = F.split("id", "/")
    return found.select(own[0].cast("long").alias("conv_id"), own[1].cast("long").alias("turn"), "endpoint", "pointer", F.md5("value").alias("text_md5"))


_KEY_SQL = "(case c_custkey % 4 when 0 then 'AKIA' when 1 then 'ghp_' when 2 then 'gho_' else 'sk-' end || upper(md5(c_name)))"
_HEXES = f"sha256({_seed_sql('API_KEY', _KEY_SQL)}::varchar)"
_BODY = f"list_reduce(list_transform(range(24), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, ((i // 4) * 5 + 1)::int, 5))::ubigint >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), lambda a, b: a || b)"


@query(
    f"with k as (select c_custkey, {_KEY_SQL} k, {_HEXES} x from customer) "
    f"select c_custkey, case when starts_with(k, 'AKIA') then 'AKIA' || left({_BODY}, 16) when starts_with(k, 'gh') then left(k, 4) || {_BODY} else 'sk-pg_' || {_BODY} end made from k"
)
def synthetic_keys(spark, sf_dir):
    """Made-up access keys that keep the family of the real one."""
    n = F.col("c_custkey") % 4
    value = F.concat(F.when(n == 0, "AKIA").when(n == 1, "ghp_").when(n == 2, "gho_").otherwise("sk-"), F.upper(F.md5(F.col("c_name").cast("binary"))))
    return _dealt(_table(spark, sf_dir, "customer")).select("c_custkey", actions.replacement("synthetic", F.lit("API_KEY"), value, KEY, ("API_KEY",)).alias("made"))


def _tokenized(spark, sf_dir, policy):
    _checkpoints(spark)
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("session_id"), "text"))
    marked = protect.marked(docs, "text", policy)
    mappings = protect.allocate(protect.spans_of(marked, ["session_id"]), policy, KEY)
    return protect.render_marked(marked, "text", policy, mappings, KEY, row="doc_id"), mappings


_MADE_MAIL = f"'person' || ({_seed_sql('EMAIL_ADDRESS', 'v')} % 100000) || '@example.test '"


@query(
    detection_sql.resolved("documents", "text", "doc_id, text original", verdict="case when entity != 'EMAIL_ADDRESS' then 'inactive_rule' end") + ", " + detection_sql.rewritten(_MADE_MAIL)
    + " select doc_id, md5(p.t) shown_md5, md5(coalesce(original, '')) restored_md5 from p join d using (r)"
)
def composite_round_trip(spark, sf_dir):
    """Made-up values with a token behind them, which bring the real ones back; what is shown is compared without the tokens."""
    shown, mappings = _tokenized(spark, sf_dir, Policy("p", (Rule("EMAIL_ADDRESS", "synthetic", reversible=True),)))
    back = restore.restore_found(shown, "protected_text", mappings, row="doc_id")
    bare = F.regexp_replace(F.coalesce("protected_text", F.lit("")), actions.TOKEN, "")
    return back.select("doc_id", F.md5(bare.cast("binary")).alias("shown_md5"), F.md5(F.coalesce("restored", F.lit("")).cast("binary")).alias("restored_md5"))


@query("select doc_id, md5(coalesce(text, '')) restored_md5 from documents")
def tolerant_round_trip(spark, sf_dir):
    """Documents restored from tokens that were written in lower case and with blanks around their bars."""
    shown, mappings = _tokenized(spark, sf_dir, uniform("tokenize"))
    loose = F.transform(F.regexp_extract_all("protected_text", F.lit(actions.TOKEN), F.lit(0)), lambda t: F.replace(F.replace(F.lower(t), F.lit("|"), F.lit(" | ")), F.lit("[["), F.lit("[[ ")))
    gaps = F.split("protected_text", actions.TOKEN, -1)
    spread = shown.withColumn("loose", F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(loose, i), F.lit("")))), ""))
    back = restore.restore_found(spread.select("doc_id", "session_id", "loose"), "loose", mappings, row="doc_id")
    return back.select("doc_id", F.md5(F.coalesce("restored", F.lit("")).cast("binary")).alias("restored_md5"))


@query("with n as (select count(*) n from customer) select 'accounts' as \"table\", n as n, n as distinct_keys, 0::bigint orphans from n union all select 'cards', n, n, 0 from n union all select 'visits', 3 * n, null, 0 from n")
def synthetic_family(spark, sf_dir):
    """Made tables with keys: each card has an account of its own, drawn without replacement, visits share accounts."""
    n = _table(spark, sf_dir, "customer").count()
    c, k = synthesis.ColumnSpec, synthesis.ForeignKey
    specs = [
        synthesis.TableSpec("cards", (c("account", "integer", primary_key=True), c("note", "text")), (k("account", "accounts", "id"),)),
        synthesis.TableSpec("accounts", (c("id", "integer", primary_key=True), c("name", "text"))),
        synthesis.TableSpec("visits", (c("id", "integer", primary_key=True), c("account", "integer")), (k("account", "accounts", "id"),)),
    ]
    made, out = synthesis.tables(spark, specs, {"accounts": n, "cards": n, "visits": 3 * n}, "seed"), None
    for name, key in (("accounts", "id"), ("cards", "account"), ("visits", "account")):
        lost = synthesis.orphans(made[name], key, made["accounts"], "id").agg(F.count("*").alias("orphans"))
        keys = F.lit(None).cast("long") if name == "visits" else F.count_distinct(key)
        one = made[name].agg(F.count("*").alias("n"), keys.alias("distinct_keys")).join(lost).select(F.lit(name).alias("table"), "n", "distinct_keys", "orphans")
        out = one if out is None else out.union(one)
    return out


@query(
    """with m as (select l_returnflag a, l_linestatus b, l_linenumber::varchar c from lineitem where l_orderkey % 2 = 0), r as (select l_returnflag a, l_linestatus b, l_linenumber::varchar c from lineitem where l_orderkey % 2 = 1),
    v as (select a x from r union select b from r union select c from r),
    e as (select avg((exists (select 1 from r where r.a = m.a and r.b = m.b and r.c = m.c))::int) exact from m), y as (select avg((x in (select x from v))::int) copied from (select a x from m union all select b from m union all select c from m)),
    k as (select min(n) k, min(l) l from (select count(*) n, count(distinct b) l from m group by a, c))
    select 'evaluated' status, round(exact, 6) exact_row_match_rate, round(copied, 6) non_key_cell_copy_rate, k k_anonymity, l l_diversity,
     (exact > 0)::int + (copied > 0.2)::int + (k < 3)::int + (l < 2)::int n_warnings from e, y, k"""
)
def privacy_warnings(spark, sf_dir):
    """The privacy report of the even orders' lines against the odd ones', with the number of its warnings."""
    real, made = (_table(spark, sf_dir, "lineitem").where(f"l_orderkey % 2 = {h}").select("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string").alias("l_linenumber")) for h in (1, 0))
    row = reports.privacy_report(real, made, ["l_returnflag", "l_linenumber"], ["l_linestatus"])
    return row.select("status", F.round("exact_row_match_rate", 6).alias("exact_row_match_rate"), F.round("non_key_cell_copy_rate", 6).alias("non_key_cell_copy_rate"), "k_anonymity", F.col("l_diversity")["l_linestatus"].alias("l_diversity"), F.size("warnings").alias("n_warnings"))


@query(
    """with t as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) term from benchmark), d as (select doc_id, lower(text) t from documents where text is not null)
    select doc_id, sum((len(t) - len(replace(t, term, ''))) // len(term))::bigint n, count(*) terms from d join t on contains(t, term) group by 1"""
)
def deny_many_terms(spark, sf_dir):
    """Every word of the benchmark as a denied term, found in all documents by one automaton."""
    words = _table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("w")).distinct()
    detector = DenyListDetector({r["w"]: "ORGANIZATION" for r in words.collect()})  # a policy's terms: they are on the driver anyway
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = docs.select("doc_id", detector.spans(F.coalesce("text", F.lit("")), ["ORGANIZATION"]).alias("s")).where("size(s) > 0")
    return found.select("doc_id", F.size("s").cast("long").alias("n"), F.size(F.array_distinct(F.transform("s", lambda x: F.lower(x["value"])))).cast("long").alias("terms"))


@query(
    detection_sql.resolved("documents", "text", "doc_id", verdict="case when entity = 'URL' then 'inactive_rule' when entity = 'MONEY' then 'below_confidence' end")
    + """ select doc_id, entity, s as start, outcome, case when entity != 'URL' then case when entity = 'EMAIL_ADDRESS' then 'label' else 'redact' end end rule_action, case entity when 'URL' then null when 'MONEY' then 1000000 else 500000 end rule_floor,
    count(*) filter (outcome = 'applied') over (partition by r) applied_count, true gate_passed from a join d using (r)"""
)
def policy_traces(spark, sf_dir):
    """Every candidate with its outcome and the rule it was judged by, the gate and the number of applied spans."""
    rules = [*(Rule(e, "redact") for e in ("IP_ADDRESS", "CREDIT_CARD", "US_SSN", "PHONE_NUMBER", "IBAN_CODE", "API_KEY", "DATE_TIME", "US_BANK_NUMBER")), Rule("EMAIL_ADDRESS", "label"), Rule("MONEY", "redact", minimum_confidence_ppm=1_000_000), Rule("URL", "keep")]
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    traced = protect.explained(docs, "text", Policy("p", tuple(rules)))
    return traced.select("doc_id", "trace.applied_count", F.col("trace.gate.passed").alias("gate_passed"), F.explode("trace.decisions").alias("d")).select(
        "doc_id", "d.entity", "d.start", "d.outcome", F.col("d.rule.action").alias("rule_action"), F.col("d.rule.floor").alias("rule_floor"), F.col("applied_count").cast("long").alias("applied_count"), "gate_passed"
    )


@query(
    "select c_custkey, case c_custkey % 5 when 0 then 'STRASSE' when 1 then 'straße' when 2 then 'ﬁsch' when 3 then 'ΣΊΣΥΦΟΣ' else 'İx' end || c_name v, case c_custkey % 5 when 0 then 'strasse' when 1 then 'strasse' when 2 then 'fisch' when 3 then 'σίσυφοσ' else 'i' || chr(775) || 'x' end || lower(c_name) folded from customer"
)
def folded_names(spark, sf_dir):
    """Names in full case folding, as allowed terms are compared."""
    k = F.col("c_custkey") % 5
    head = F.when(k == 0, "STRASSE").when(k == 1, "straße").when(k == 2, "ﬁsch").when(k == 3, "ΣΊΣΥΦΟΣ").otherwise("İx")
    value = F.concat(head, "c_name")
    rows = _dealt(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    return rows.select("c_custkey", value.alias("v"), resolve.fold_case(value).alias("folded"))

