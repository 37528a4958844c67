"""Registry of the engine's queries over the standard tables, with their SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shieldframe.functions import actions, checks
from shieldframe.functions.recognizers import SPANS
from shieldframe.operators import json_trees, payloads, protect, providers, reports, resolve, restore, shield, synthesis, vault
from shieldframe.plans import detection_sql
from shieldframe.plans.cases import CASES
from shieldframe.policy import ENTITIES, PRESETS, Policy, Rule, preset, uniform
from shieldframe.streaming import restore as streams
from shieldframe.streaming import webhooks

KEY = bytes(32)  # a key for tests only
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its files give fewer partitions; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Stored mappings up to so many go to the rows, not the rows to them.
_FEW = 100_000


def _dealt(df: DataFrame) -> DataFrame:
    """`df` in four tasks a core at least, for rows that are short and take long: a file of a few megabytes has hours of work, and
    its splits say nothing of its rows, which lie in few row groups."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted spans of all entities, counted by language and entity."""
    return detect_entities(spark, sf_dir)


# detection and resolution

_DOCS = detection_sql.resolved("documents", "text", "doc_id, lang")


@query(_DOCS + " select lang, entity, count(*) n, count(distinct doc_id) docs from a join d using (r) where ok group by 1, 2")
def detect_entities(spark, sf_dir):
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    spans = protect.span_table(docs, ["doc_id", "lang"], "text", uniform("redact"))
    return spans.groupBy("lang", "entity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(_DOCS + " select doc_id, entity, s as start, e as \"end\", v as value from a join d using (r) where ok")
def detect_spans(spark, sf_dir):
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return protect.span_table(docs, ["doc_id"], "text", uniform("redact")).select("doc_id", "entity", "start", "end", "value")


@query(detection_sql.resolved("pages", "html", "page_id") + " select entity, count(*) n, count(distinct page_id) pages from a join d using (r) where ok group by 1")
def detect_pages(spark, sf_dir):
    pages = _spread(_table(spark, sf_dir, "pages").select("page_id", "html"))
    spans = protect.span_table(pages, ["page_id"], "html", uniform("redact"))
    return spans.groupBy("entity").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


#: A text per customer with a value of every kind that the tables lack, some of them broken: (expression, valid in 1 of n).
_RECORD = """concat('no ', c_custkey, ' of ', 1 + c_custkey % 12, case when c_custkey % 3 = 0 then '/' else '-' end, 1 + c_custkey % 28, '/20', 10 + c_custkey % 30,
 ' or 20', 10 + c_custkey % 89, '-', 1 + c_custkey % 13, '-', c_custkey % 40, case when c_custkey % 5 = 0 then '7' else '' end,
 ' for $', c_custkey % 9, ',', 100 + c_custkey % 900, '.', 10 + c_custkey % 90, case when c_custkey % 4 = 0 then 'x' else '' end, ' ', c_custkey % 700, ' eur; ',
 case c_custkey % 6 when 0 then 'sk-' when 1 then 'ghp_' when 2 then 'AKIA' when 3 then 'xsk-' when 4 then 'gh_' else 'sk_' end, {upper}({md5}(c_name)), ' ',
 case c_custkey % 5 when 0 then 'https://shop.example/a?b=' when 1 then 'http://u:p@shop.example/' when 2 then 'HTTP://[2001:db8::1]:80/' when 3 then 'https:///' else 'https://caf\u00e9.example/' end, c_custkey,
 ' acct ', {pad}({text}(c_custkey * 131), 9, '0'), ' ssn ', 100 + c_custkey % 900, case when c_custkey % 7 = 0 then ' ' else '-' end, {pad}({text}(c_custkey % 100), 2, '0'), '-', {pad}({text}(c_custkey % 10000), 4, '0'),
 ' DE', {pad}({text}(c_custkey % 97), 2, '0'), ' ', {pad}({text}(c_custkey * 7907), 18, '0'), ' card 4', {pad}({text}(c_custkey * 7919), 15, '1'), ' ip ', c_custkey % 300, '.1.2.', c_custkey % 260, ' fe80::', {hex}(c_custkey),
 ' tel +', 1 + c_custkey % 99, ' (', 100 + c_custkey % 900, ') 555-', {pad}({text}(c_custkey % 10000), 4, '0'), ' <a.b+', c_custkey, '@mail.shop.example>')"""
_RECORD_SQL = _RECORD.format(upper="upper", md5="md5", pad="lpad", text="concat", hex="lower(to_hex(c_custkey)) || left").replace("left(c_custkey)", "''").replace("\\u00e9", "é")
_RECORD_SPARK = _RECORD.format(upper="upper", md5="md5", pad="lpad", text="string", hex="lower(hex(c_custkey)) || left").replace("left(c_custkey)", "''").replace("\\u00e9", "é")
_RECORDS = f"(select c_custkey, {_RECORD_SQL} t from customer)"


@query(detection_sql.resolved(_RECORDS, "t", "c_custkey") + " select c_custkey, entity, s as start, e as \"end\", v as value from a join d using (r) where ok")
def detect_records(spark, sf_dir):
    """Spans of every recognizer in made texts, with values that its checks and boundaries refuse among them."""
    rows = _dealt(_table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select("c_custkey", F.expr(_RECORD_SPARK).alias("t"))
    return protect.span_table(rows, ["c_custkey"], "t", uniform("redact")).select("c_custkey", "entity", "start", "end", "value")


@query(detection_sql.candidates(_RECORDS, "t", "c_custkey") + " select c_custkey, list_aggregate(list(v order by s), 'string_agg', ' ') keys from c join d using (r) where entity = 'API_KEY' group by 1")
def detect_access_keys(spark, sf_dir):
    rows = _dealt(_table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select("c_custkey", F.expr(_RECORD_SPARK).alias("t"))
    spans = protect.detect(F.col("t"), uniform("redact", ("API_KEY",)))
    return rows.select("c_custkey", F.array_join(F.transform(spans, lambda s: s["value"]), " ").alias("keys")).where("keys != ''")


@query("select doc_id, (len(lower(text)) - len(replace(lower(text), 'trash', '')))::bigint // 5 n from documents where contains(lower(text), 'trash')")
def detect_deny_terms(spark, sf_dir):
    policy = Policy("deny", (Rule("ORGANIZATION", "label", minimum_confidence_ppm=650_000),), deny_terms={"trash": "ORGANIZATION"})
    spans = protect.span_table(_spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"], "text", policy, found=[])
    return spans.groupBy("doc_id").agg(F.count("*").alias("n"))


_DENY = {"trash": "PERSON", "idiot": "ORGANIZATION", "mail": "LOCATION"}


@query(
    detection_sql.resolved(
        "documents", "text", "doc_id", _DENY,
        "case when entity = 'IP_ADDRESS' then 'below_confidence' when lower(v) = 'idiot' then 'allowed_value' when entity = 'US_SSN' then 'inactive_rule' end", "entity != 'CREDIT_CARD'",
    ) + " select doc_id, entity, s as start, e as \"end\", outcome from a join d using (r) where entity != 'US_SSN'"
)
def decision_outcomes(spark, sf_dir):
    """Every candidate's outcome under a policy with a floor, an allowed term, denied terms and a rule of another scope."""
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    own = {"IP_ADDRESS": {"minimum_confidence_ppm": 995_000}, "CREDIT_CARD": {"scopes": ("json:/card",)}, "US_SSN": {"enabled": False}}
    policy = Policy("mixed", tuple(Rule(e, "redact", **own.get(e, {})) for e in ENTITIES), allow_terms=("IDIOT",), deny_terms=_DENY)
    traced = docs.select("doc_id", F.explode_outer(protect.trace(F.col("text"), policy, "body")).alias("d")).where("d is not null")
    return traced.select("doc_id", "d.entity", "d.start", "d.end", "d.outcome")


_MOST = "list_reduce(list({'s': s, 'e': e, 'p': p, 'ok': true} order by p desc, e - s desc, s), lambda done, x: list_append(done, {'s': x.s, 'e': x.e, 'p': x.p, 'ok': len(list_filter(done, lambda o: o.ok and x.s < o.e and o.s < x.e)) = 0}), []::struct(s int, e int, p int, ok boolean)[])"


@query(
    f"""with c as (select l_orderkey k, (l_partkey % 50)::int s, ((l_partkey % 50) + 5 + l_quantity % 7)::int e, (l_suppkey % 3)::int p from lineitem),
    g as (select k, {_MOST} x from c group by k)
    select k, x[1].s s, x[1].e e, x[1].p p, len(list_filter(x, lambda o: o.ok)) n_applied from g"""
)
def precedence_first(spark, sf_dir):
    """An order's lines as spans of one text: the one that precedence puts first, and how many are accepted."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 50).cast("int").alias("s"), ((F.col("l_partkey") % 50) + 5 + F.col("l_quantity") % 7).cast("int").alias("e"), (F.col("l_suppkey") % 3).cast("int").alias("p"))
    one = F.struct("s", "e", F.lit("PERSON").alias("entity"), (F.col("p") + 500_000).alias("confidence_ppm"), F.lit("l").alias("detector"), F.lit("").alias("value"))
    decided = rows.groupBy("k").agg(F.collect_list(one).cast(SPANS).alias("spans")).select("k", resolve.decisions(F.col("spans"), uniform("redact", ("PERSON",))).alias("d"))
    applied = F.size(F.filter("d", lambda x: x["outcome"] == "applied")).cast("long")
    return decided.select("k", F.col("d")[0]["start"].alias("s"), F.col("d")[0]["end"].alias("e"), (F.col("d")[0]["confidence_ppm"] - 500_000).alias("p"), applied.alias("n_applied"))


_CASES_SQL = "(select * from (values " + ", ".join(f"({i}, '{c.text.replace(chr(39), chr(39) * 2)}', {[t.lower() for t in c.allow]}::varchar[])" for i, c in enumerate(CASES)) + ") x(id, t, allow))"
_GOLD_SQL = "(select * from (values " + ", ".join(f"({i}, '{e}', {s}, {t})" for i, c in enumerate(CASES) for e, s, t in c.expected) + ") x(id, entity, s, e))"


@query(
    detection_sql.resolved(_CASES_SQL, "t", "id, allow", verdict="case when (select list_contains(d.allow, lower(v)) from d where d.r = c.r) then 'allowed_value' end").replace("false denied from c)", "false denied from c) c")
    + f""", f as (select id, entity, s, e from a join d using (r) where ok), m as (select coalesce(g.entity, f.entity) entity, g.id is not null x, f.id is not null y from {_GOLD_SQL} g full join f using (id, entity, s, e)),
    n as (select entity, count(*) filter (x and y) tp, count(*) filter (not x) fp, count(*) filter (not y) fn from m group by entity union all select 'ALL', count(*) filter (x and y), count(*) filter (not x), count(*) filter (not y) from m)
    select entity, tp, fp, fn, round(case when tp + fp > 0 then tp / (tp + fp) end, 6) as "precision", round(case when tp + fn > 0 then tp / (tp + fn) end, 6) recall, round(2 * tp / (2 * tp + fp + fn), 6) f1, 0::bigint blocked from n"""
)
def span_accuracy(spark, sf_dir):
    """The labelled cases: exact spans found, missed and made up, by entity and together, and blocked cases."""
    cases = spark.createDataFrame([(i, c.text, [{"entity": e, "start": s, "end": t} for e, s, t in c.expected], list(c.allow)) for i, c in enumerate(CASES)], "case_id int, text string, expected array<struct<entity:string,start:int,end:int>>, allow_terms array<string>")
    return reports.span_accuracy(cases, uniform("redact"))


# checks

_NUMBER = "lpad((o_orderkey * 7919 + o_custkey)::varchar, 16, '4')"


@query(
    f"""select o_orderkey, list_sum(list_transform(range(1, 17), lambda i: case when i % 2 = 0 then substr(v, i, 1)::int when substr(v, i, 1)::int > 4 then substr(v, i, 1)::int * 2 - 9 else substr(v, i, 1)::int * 2 end)) % 10 = 0 ok
    from (select o_orderkey, {_NUMBER} v from orders)"""
)
def luhn_valid(spark, sf_dir):
    v = F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 16, "4")
    return _dealt(_table(spark, sf_dir, "orders")).select("o_orderkey", checks.luhn(v).alias("ok"))


@query(
    """select o_orderkey, list_sum(list_transform(range(1, 10), lambda i: substr(v, i, 1)::int * [3, 7, 1][(i - 1) % 3 + 1])) % 10 = 0 ok
    from (select o_orderkey, lpad((o_orderkey * 131 + o_custkey)::varchar, 9, '0') v from orders)"""
)
def aba_valid(spark, sf_dir):
    v = F.lpad((F.col("o_orderkey") * 131 + F.col("o_custkey")).cast("string"), 9, "0")
    return _dealt(_table(spark, sf_dir, "orders")).select("o_orderkey", checks.aba(v).alias("ok"))


@query(
    """select c_custkey, (lpad((c_custkey * 7907)::varchar, 18, '0') || '1314' || lpad((c_custkey % 97)::varchar, 2, '0'))::hugeint % 97 = 1 ok from customer"""
)
def iban_valid(spark, sf_dir):
    v = F.concat(F.lit("DE"), F.lpad((F.col("c_custkey") % 97).cast("string"), 2, "0"), F.lpad((F.col("c_custkey") * 7907).cast("string"), 18, "0"))
    return _dealt(_table(spark, sf_dir, "customer")).select("c_custkey", checks.iban(v).alias("ok"))


@query(
    """select event_id, (event_id % 300) <= 255 and (user_id % 300) <= 255 and not (event_id % 7 = 0) ok from events"""
)
def ipv4_valid(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    v = F.concat((e % 300).cast("string"), F.lit(".1."), F.when(e % 7 == 0, "0").otherwise(""), (u % 300).cast("string"), F.lit(".9"))
    fixed = F.when(e % 7 == 0, F.regexp_replace(v, r"\.0([0-9]*)\.9$", ".00$1.9")).otherwise(v)
    return _table(spark, sf_dir, "events").select("event_id", checks.ipv4(fixed).alias("ok"))


@query(
    r"""select page_id, url is not null and regexp_matches(url, '(?i)^https?://[^/?#@:]+(:[^/?#@]*)?([/?#]|$)') ok from pages"""
)
def url_valid(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.coalesce(checks.url(F.col("url")), F.lit(False)).alias("ok"))


# actions

_IPAD, _OPAD = (bytes(b ^ p for b in KEY.ljust(64, b"\0")).hex() for p in (0x36, 0x5C))


def _hmac_sql(message: str) -> str:
    return f"sha256(unhex('{_OPAD}' || sha256(unhex('{_IPAD}' || hex(encode({message}))))))"


_DIGEST = "sha256(unhex('" + _OPAD + "' || sha256(unhex('" + _IPAD + "' || hex(encode('{e}')) || '00' || hex(encode({v}))))))"


@query(f"select c_custkey, 'sha256:' || left({_DIGEST.format(e='PERSON', v='c_name')}, 48) hashed from customer")
def hash_keyed(spark, sf_dir):
    return _dealt(_table(spark, sf_dir, "customer")).select("c_custkey", actions.replacement("hash", F.lit("PERSON"), F.col("c_name"), KEY).alias("hashed"))


def _seed_sql(e: str, v: str) -> str:
    return f"('0x' || left({_DIGEST.format(e=e, v=v)}, 16))::ubigint::hugeint"


@query(
    f"""select c_custkey, 'person' || ({_seed_sql("EMAIL_ADDRESS", "c_name")} % 100000) || '@example.test' email,
    '+1-202-555-' || lpad(({_seed_sql("PHONE_NUMBER", "c_name")} % 10000)::varchar, 4, '0') phone,
    '192.0.2.' || (1 + {_seed_sql("IP_ADDRESS", "c_name")} % 254) ip,
    '20' || (20 + {_seed_sql("DATE_TIME", "c_name")} % 7) || '-' || lpad((1 + ({_seed_sql("DATE_TIME", "c_name")} // 7) % 12)::varchar, 2, '0') || '-' || lpad((1 + ({_seed_sql("DATE_TIME", "c_name")} // 97) % 28)::varchar, 2, '0') made_on,
    ['Alex', 'Jordan', 'Morgan', 'Riley', 'Taylor', 'Casey'][({_seed_sql("PERSON", "c_name")} % 6 + 1)::int] || ' ' || ['Brooks', 'Chen', 'Diaz', 'Patel', 'Rivera', 'Singh'][(({_seed_sql("PERSON", "c_name")} // 7) % 6 + 1)::int] person
    from customer"""
)
def synthetic_values(spark, sf_dir):
    made = lambda e: actions.replacement("synthetic", F.lit(e), F.col("c_name"), KEY, (e,))
    return _dealt(_table(spark, sf_dir, "customer")).select("c_custkey", made("EMAIL_ADDRESS").alias("email"), made("PHONE_NUMBER").alias("phone"), made("IP_ADDRESS").alias("ip"), made("DATE_TIME").alias("made_on"), made("PERSON").alias("person"))


_STREAM = "(lpad({n}::varchar, 20, '0') || lpad(('0x' || left(sha256({n}::varchar), 16))::ubigint::varchar, 20, '0'))"


def _digits_sql(e: str, n: int) -> str:
    return f"left({_STREAM.format(n=_seed_sql(e, 'c_name'))}, {n})"


_LUHN_DIGIT = "((10 - list_sum(list_transform(range(1, length({p}) + 1), lambda k: case when k % 2 = 0 then substr(reverse({p}), k, 1)::int when substr(reverse({p}), k, 1)::int > 4 then substr(reverse({p}), k, 1)::int * 2 - 9 else substr(reverse({p}), k, 1)::int * 2 end)) % 10) % 10)::varchar"
_ABA_DIGIT = "((10 - list_sum(list_transform(range(1, 9), lambda k: substr({p}, k, 1)::int * [3, 7, 1][(k - 1) % 3 + 1])) % 10) % 10)::varchar"
_CARD, _BANK, _GB = "('4' || " + _digits_sql("CREDIT_CARD", 14) + ")", "('01' || " + _digits_sql("US_BANK_NUMBER", 6) + ")", _digits_sql("IBAN_CODE", 14)


@query(
    f"""select c_custkey, {_CARD} || {_LUHN_DIGIT.format(p=_CARD)} card, {_BANK} || {_ABA_DIGIT.format(p=_BANK)} bank,
    'GB' || lpad((98 - (('25161029' || {_GB} || '161100')::hugeint % 97))::varchar, 2, '0') || 'PGAT' || {_GB} iban,
    lpad((case when {_seed_sql("US_SSN", "c_name")} % 799 + 100 >= 666 then {_seed_sql("US_SSN", "c_name")} % 799 + 101 else {_seed_sql("US_SSN", "c_name")} % 799 + 100 end)::varchar, 3, '0') || '-' ||
     lpad((({_seed_sql("US_SSN", "c_name")} // 799) % 99 + 1)::varchar, 2, '0') || '-' || lpad((({_seed_sql("US_SSN", "c_name")} // (799 * 99)) % 9999 + 1)::varchar, 4, '0') ssn,
    ['Northstar Labs', 'Juniper Works', 'Atlas Harbor', 'Cinder Systems'][({_seed_sql("ORGANIZATION", "c_name")} % 4 + 1)::int] org,
    ['Madison, WI', 'Raleigh, NC', 'Boise, ID', 'Albany, NY'][({_seed_sql("LOCATION", "c_name")} % 4 + 1)::int] place,
    '$' || format('{{:,}}', ({_seed_sql("MONEY", "c_name")} % 9990 + 10)::bigint) || '.00' money, 'P' || {_digits_sql("PASSPORT", 8)} passport, 'D' || {_digits_sql("DRIVER_LICENSE", 8)} driver, 'M' || {_digits_sql("MEDICAL_LICENSE", 9)} medical,
    'https://service-' || ({_seed_sql("URL", "c_name")} % 10000) || '.example.test/resource/' || ({_seed_sql("URL", "c_name")} % 100000) url from customer"""
)
def synthetic_checks(spark, sf_dir):
    """Made-up values of the kinds with check digits or fixed forms, as they are."""
    made = lambda e, name: actions.replacement("synthetic", F.lit(e), F.col("c_name"), KEY, (e,)).alias(name)
    kinds = {"card": "CREDIT_CARD", "bank": "US_BANK_NUMBER", "iban": "IBAN_CODE", "ssn": "US_SSN", "org": "ORGANIZATION", "place": "LOCATION", "money": "MONEY", "passport": "PASSPORT", "driver": "DRIVER_LICENSE", "medical": "MEDICAL_LICENSE", "url": "URL"}
    return _dealt(_table(spark, sf_dir, "customer")).select("c_custkey", *(made(e, name) for name, e in kinds.items()))


@query("select o_orderkey, '$~10^' || greatest(0, length(ltrim(floor(o_totalprice)::bigint::varchar, '0')) - 1) money, left(strftime(o_orderdate, '%Y-%m-%d'), 4) y from orders")
def generalized(spark, sf_dir):
    price = F.concat(F.lit("$"), F.format_number(F.floor("o_totalprice"), 0), F.lit(".50"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", actions.generalize(F.lit("MONEY"), price).alias("money"), actions.generalize(F.lit("DATE_TIME"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("y"))


@query("select c_custkey, '***@' || c_mktsegment || '.test' email, '[PERSON]' person, '<PERSON>' label, '[REDACTED:PERSON]' redacted from customer")
def masks(spark, sf_dir):
    address = F.concat("c_name", F.lit("@"), "c_mktsegment", F.lit(".test"))
    p = F.lit("PERSON")
    return _table(spark, sf_dir, "customer").select("c_custkey", actions.generalize(F.lit("EMAIL_ADDRESS"), address).alias("email"), actions.generalize(p, F.col("c_name")).alias("person"), actions.replacement("label", p, F.col("c_name")).alias("label"), actions.replacement("redact", p, F.col("c_name")).alias("redacted"))


@query(_DOCS + ", " + detection_sql.rewritten("'[REDACTED:' || entity || ']'") + " select doc_id, 'protected' state, n, md5(p.t) text_md5 from p join d using (r)")
def redact_documents(spark, sf_dir):
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    done = protect.protect(docs, "text", uniform("redact"))
    return done.select("doc_id", "protected.state", F.size("protected.detections").alias("n"), F.md5("protected.text").alias("text_md5"))


@query("select doc_id, md5(text) text_md5, 'protected' state from documents")
def keep_documents(spark, sf_dir):
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    done = protect.protect(docs, "text", uniform("keep"))
    return done.select("doc_id", F.md5("protected.text").alias("text_md5"), "protected.state")


@query("select doc_id, 'blocked' state, null::varchar text, 'reversible rules need a key' reason from documents")
def blocked_without_key(spark, sf_dir):
    done = protect.protect(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", preset("balanced"))
    return done.select("doc_id", "protected.state", "protected.text", "protected.reason")


@query(_DOCS + " select doc_id, md5(text) text_md5, coalesce(n, 0) tokens from documents left join (select doc_id, count(*) n from a join d using (r) where ok group by 1) using (doc_id)")
def tokenize_round_trip(spark, sf_dir):
    """Tokens for all values, texts rendered with them, and the texts restored from the mappings."""
    _checkpoints(spark)
    policy = uniform("tokenize")
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("session_id"), "text"))
    marked = protect.marked(docs, "text", policy)
    mappings = protect.allocate(protect.spans_of(marked, ["session_id"]), policy, KEY)
    shown = protect.render_marked(marked, "text", policy, mappings, KEY, row="doc_id")
    back = restore.restore_found(shown, "protected_text", mappings, row="doc_id")
    tokens = F.regexp_count("protected_text", F.lit(actions.TOKEN)).cast("long")
    return back.select("doc_id", F.md5("restored").alias("text_md5"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


def _checkpoints(spark: SparkSession) -> None:
    """Names a folder for checkpoints on one machine where the user hasn't; a cluster has to name a shared one."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shieldframe-"))


@query("select c_custkey, c_name opened, null::varchar wrong_key, null::varchar wrong_session, null::varchar cut_short from customer")
def capsules(spark, sf_dir):
    """Reverse maps sealed and opened again; nothing comes out with another key or session, or from a part of a capsule."""
    one = _dealt(_table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select("c_custkey", F.create_map(F.concat(F.lit("t"), F.col("c_custkey").cast("string")), "c_name").alias("reverse"), F.col("c_name").alias("session"))
    sealed = one.withColumn("capsule", restore.seal(F.col("reverse"), KEY, F.col("session")))
    value = lambda capsule, key, session: F.map_values(restore.open_capsule(capsule, key, session))[0]
    c, session = F.col("capsule"), F.col("session")
    return sealed.select("c_custkey", value(c, KEY, session).alias("opened"), value(c, b"\x01" * 32, session).alias("wrong_key"), value(c, KEY, F.concat("session", F.lit("x"))).alias("wrong_session"), value(F.left(c, F.lit(20)), KEY, session).alias("cut_short"))


@query("select conv_id::varchar stream_id, string_agg(replace(coalesce(text, ''), ' the ', ' THE '), '' order by turn) as text from conversations group by 1")
def stream_restore_batch(spark, sf_dir):
    token = "[[PG1|PERSON|" + "A" * 26 + "|" + "B" * 16 + "]]"
    words = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("t"), F.replace(F.coalesce("text", F.lit("")), F.lit(" the "), F.lit(f" {token} ")).alias("text"))
    halves = F.array(F.struct((F.col("t") * 2).alias("seq"), F.expr("left(text, cast(length(text) / 2 as int))").alias("chunk")), F.struct((F.col("t") * 2 + 1).alias("seq"), F.expr("substr(text, cast(length(text) / 2 as int) + 1)").alias("chunk")))
    chunks = words.select("stream_id", F.explode(halves).alias("c")).select("stream_id", "c.seq", "c.chunk")
    return streams.restore_batch(chunks, {token: "THE"})


# vault

_DETECTIONS = """select event_id::varchar id, user_id, ['EMAIL_ADDRESS', 'PERSON', 'URL'][(event_id % 3 + 1)::int] entity_type, event_type, (event_id * 37 % 1000000)::int ppm, floor(epoch(ts))::bigint at_ from events"""


def _detections(spark, sf_dir):
    e = F.col("event_id")
    return _table(spark, sf_dir, "events").select(
        e.cast("string").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.lit(None).cast("string").alias("mapping_id"),
        F.element_at(F.array(F.lit("EMAIL_ADDRESS"), F.lit("PERSON"), F.lit("URL")), (e % 3 + 1).cast("int")).alias("entity_type"), F.col("event_type").alias("detector"),
        (e * 37 % 1_000_000).cast("int").alias("confidence_ppm"), F.lit("redact").alias("action"), F.lit("p").alias("policy_name"), F.lit(1).alias("policy_version"),
        F.unix_timestamp("ts").alias("created_at"), (F.unix_timestamp("ts") + (e % 30) * 86_400).alias("expires_at"),
    )


_NOW = 1_704_067_200 + 15 * 86_400


@query(f"select entity_type, event_type detector, 'redact' as action, 'p' policy_name, 1 policy_version, count(*) n, min(ppm) least_ppm, max(ppm) most_ppm from ({_DETECTIONS}) where at_ + (id::bigint % 30) * 86400 > {_NOW} group by 1, 2")
def session_summary(spark, sf_dir):
    return vault.session_summary(_detections(spark, sf_dir), _NOW)


@query(f"select 'detections' as \"table\", count(*) filter (at_ + (id::bigint % 30) * 86400 <= {_NOW}) purged from ({_DETECTIONS})")
def purge_counts(spark, sf_dir):
    return vault.purge_counts({"detections": _detections(spark, sf_dir)}, _NOW)


@query("select c_custkey, c_mktsegment from customer where not exists (select 1 from supplier where s_suppkey = c_custkey and s_suppkey % 5 != 0)")
def new_mappings(spark, sf_dir):
    offered = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("s").alias("session_id"), F.lit("PERSON").alias("entity_type"), F.col("c_custkey").cast("string").alias("original_hmac"), F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("replacement"), "c_custkey", "c_mktsegment")
    known = _table(spark, sf_dir, "supplier").select(F.lit("s").alias("session_id"), F.lit("PERSON").alias("entity_type"), F.col("s_suppkey").cast("string").alias("original_hmac"), F.concat(F.lit("q"), F.col("s_suppkey").cast("string")).alias("replacement"), F.when(F.col("s_suppkey") % 5 == 0, 0).otherwise(10).cast("long").alias("expires_at"))
    return vault.new_mappings(offered, known, 5).select("c_custkey", "c_mktsegment")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints."""
    _checkpoints(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    detection_sql.resolved("documents", "text", "coalesce(source, '') session_id")
    + """ select d.session_id, entity entity_type, 'regex-v1' detector, 'tokenize' as action, 'uniform-tokenize' policy_name, 1 policy_version, count(*) n, count(distinct v) mappings, min(x.texts) as events
    from a join d using (r) join (select coalesce(source, '') session_id, count(*) texts from documents group by 1) x on x.session_id = d.session_id where ok group by 1, 2"""
)
def vault_session_summary(spark, sf_dir):
    """All documents protected under sessions by source; what the vault then has of each session's live detections, mappings and
    audit events."""
    store = vault.VaultStore(spark, _folder(spark, "vault"))
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("session_id"), "text"))
    policy = uniform("tokenize")
    store.append("sessions", vault.session_rows(docs.select(F.col("session_id").alias("id")).distinct(), policy, 0))
    shield.Shield(spark, policy, KEY, store).protect(docs, "text", "doc_id", now=1)
    found = vault.session_summary(store.read("detections"), 2, by_session=True).drop("least_ppm", "most_ppm")
    mappings = vault.live(store.read("mappings"), 2).groupBy("session_id", "entity_type").agg(F.count("*").alias("mappings"))
    events = store.read("audit_events").where("outcome = 'protected'").groupBy("session_id").agg(F.count("*").alias("events"))
    return found.join(mappings, ["session_id", "entity_type"], "left").join(events, "session_id", "left")


@query(
    "with s as (select distinct user_id, user_id % 3 = 0 gone from events where user_id is not null), e as (select event_id, user_id, gone, 400 + (event_id % 5) * 300 m, 900 + (event_id % 3) * 100 d, 800 + (event_id % 4) * 100 a from events join s using (user_id)) "
    "select 'sessions' as \"table\", count(*) filter (gone) purged, count(*) filter (not gone) kept, count(*) filter (not gone) linked from s "
    "union all select 'mappings', count(*) filter (m <= 1000), count(*) filter (m > 1000 and not gone), count(*) filter (m > 1000 and not gone) from e "
    "union all select 'detections', count(*) filter (d <= 1000), count(*) filter (d > 1000 and not gone), count(*) filter (d > 1000 and not gone and m > 1000) from e "
    "union all select 'audit_events', count(*) filter (a <= 1000), count(*) filter (a > 1000), count(*) filter (a > 1000 and not gone) from e"
)
def vault_purge(spark, sf_dir):
    """Sessions by user with a mapping, a detection and an audit event for each of their events, purged: how many rows of each
    table had expired, how many are left, and how many of those still have the mapping or the session they name."""
    store, events = vault.VaultStore(spark, _folder(spark, "vault")), _table(spark, sf_dir, "events").where("user_id is not null")
    users, one = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    e = F.col("event_id")
    known = events.select("user_id").distinct().select(users.alias("id"), F.lit("{}").alias("policy_json"), F.lit(None).cast("binary").alias("metadata_encrypted"), F.lit(0).cast("long").alias("created_at"), F.when(F.col("user_id") % 3 == 0, 500).otherwise(2000).cast("long").alias("expires_at"))
    own = {"id": one, "session_id": users, "entity_type": F.lit("URL"), "created_at": F.lit(0).cast("long")}
    mappings = events.select(*(c.alias(n) for n, c in own.items()), one.alias("original_hmac"), F.lit(b"x").alias("original_encrypted"), one.alias("replacement"), F.lit("tokenize").alias("action"), (400 + e % 5 * 300).cast("long").alias("expires_at"))
    detections = events.select(
        *(c.alias(n) for n, c in own.items()), one.alias("mapping_id"), F.lit("x").alias("detector"), F.lit(1).alias("confidence_ppm"), F.lit("tokenize").alias("action"), F.lit("p").alias("policy_name"), F.lit(1).alias("policy_version"),
        F.lit("h").alias("source_hash"), F.lit(0).alias("start_offset"), F.lit(1).alias("end_offset"), (900 + e % 3 * 100).cast("long").alias("expires_at"),
    )
    audit = events.select(one.alias("id"), users.alias("session_id"), F.lit("e").alias("event_type"), F.lit("ok").alias("outcome"), F.lit("{}").alias("detail_json"), F.lit(0).cast("long").alias("created_at"), (800 + e % 4 * 100).cast("long").alias("expires_at"))
    store.append_all({"sessions": known, "mappings": mappings, "detections": detections, "audit_events": audit})
    purged = spark.createDataFrame(list(store.purge(1000).items()), "table string, purged long")
    left, linked = None, {"sessions": "id", "mappings": "session_id", "detections": "mapping_id", "audit_events": "session_id"}
    for name, column in linked.items():
        one_table = store.read(name).agg(F.count("*").alias("kept"), F.count(column).alias("linked")).select(F.lit(name).alias("table"), "kept", "linked")
        left = one_table if left is None else left.union(one_table)
    return purged.join(left, "table").select("table", "purged", "kept", "linked")


@query(
    "select c_custkey, case when c_custkey % 4 >= 2 and c_nationkey % 2 = 0 then 'm' || c_custkey end mapping_id, case when c_custkey % 4 >= 2 and c_nationkey % 2 = 0 then 'r' || c_custkey end replacement from customer"
)
def find_mappings(spark, sf_dir):
    """Mappings found by the fingerprint of a value: of the same session, live, and with the same key."""
    c = _table(spark, sf_dir, "customer").withColumns({"entity_type": F.lit("PERSON"), "session_id": F.col("c_nationkey").cast("string"), "key": F.col("c_custkey").cast("string")})
    print_of = lambda session: vault.fingerprint(KEY, session, F.col("entity_type"), F.col("c_name"))
    known = c.select("session_id", "entity_type", print_of(F.col("session_id")).alias("original_hmac"), F.concat(F.lit("m"), "key").alias("id"), F.concat(F.lit("r"), "key").alias("replacement"), (F.col("c_custkey") % 4 * 5).alias("expires_at"))
    asked_in = F.when(F.col("c_nationkey") % 2 == 0, F.col("session_id")).otherwise(F.concat("session_id", F.lit("x")))
    asked = c.select("c_custkey", asked_in.alias("session_id"), "entity_type", print_of(asked_in).alias("original_hmac"))
    return vault.find_mappings(asked, known, 5).select("c_custkey", "mapping_id", "replacement")


# profiles and reports

_PROFILED = ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linenumber")


def _profile_sql() -> str:
    one = []
    for c in _PROFILED:
        text = c == "l_returnflag"
        n = lambda f: "null::double" if text else f"round({f}, 6)"  # noqa: E731,B023
        one.append(f"""select '{c}' as "column", count(*) n, round(avg(({c} is null{" or " + c + " = ''" if text else ""})::int), 6) null_rate, count(distinct {c}) n_distinct, {n(f"min({c})::double")} minimum, {n(f"max({c})::double")} maximum, {n(f"avg({c})").replace(", 6)", ", 4)")} mean, {n(f"stddev_pop({c})").replace(", 6)", ", 4)")} deviation from lineitem""")
    return " union all ".join(one)


@query(_profile_sql())
def profile_lineitem(spark, sf_dir):
    rows = reports.profile(_table(spark, sf_dir, "lineitem").select(*_PROFILED), _PROFILED)
    return rows.withColumns({c: F.round(c, 4) for c in ("mean", "deviation")})


@query("select l_shipmode as category, n, round(n / sum(n) over (), 9) weight from (select l_returnflag l_shipmode, count(*) n from lineitem group by 1)")
def category_weights(spark, sf_dir):
    return reports.weights(_table(spark, sf_dir, "lineitem"), "l_returnflag").select("category", "n", F.round("weight", 9).alias("weight"))


def _halves(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    return rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1")


@query(
    """with p as (select l_returnflag c, count(*) / (select count(*) from lineitem where l_orderkey % 2 = 0) w from lineitem where l_orderkey % 2 = 0 group by 1),
    q as (select l_returnflag c, count(*) / (select count(*) from lineitem where l_orderkey % 2 = 1) w from lineitem where l_orderkey % 2 = 1 group by 1)
    select round(sum(abs(coalesce(p.w, 0) - coalesce(q.w, 0))) / 2, 6) total_variation from p full join q on p.c = q.c"""
)
def quality_variation(spark, sf_dir):
    return reports.total_variation(*_halves(spark, sf_dir), "l_returnflag")


@query(
    """select round(count(distinct p_brand) filter (p_partkey in (select p_partkey from part where p_size < 5)) / count(distinct p_brand), 6) category_coverage from part"""
)
def quality_coverage(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    return reports.category_coverage(part, part.where("p_size < 5"), "p_brand")


@query(
    """select round(abs(avg(l_extendedprice) filter (l_orderkey % 2 = 0) - avg(l_extendedprice) filter (l_orderkey % 2 = 1)) / greatest(max(l_extendedprice) filter (l_orderkey % 2 = 0) - min(l_extendedprice) filter (l_orderkey % 2 = 0), 1), 6) normalized_mean_delta from lineitem"""
)
def quality_mean_delta(spark, sf_dir):
    return reports.mean_delta(*_halves(spark, sf_dir), "l_extendedprice")


@query(
    """with c as (select case when o_custkey % 3 = 0 then null else o_orderpriority end p, o_orderkey % 2 h from orders)
    select 'p' as "column", round(avg((p is null)::int) filter (h = 0), 6) source_null_rate, round(avg((p is null)::int) filter (h = 1), 6) synthetic_null_rate, round(abs(avg((p is null)::int) filter (h = 0) - avg((p is null)::int) filter (h = 1)), 6) null_rate_delta from c"""
)
def quality_null_rates(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority")).alias("p"), (F.col("o_orderkey") % 2).alias("h"))
    return reports.null_rates(rows.where("h = 0"), rows.where("h = 1"), ["p"])


@query(
    """with r as (select distinct s_nationkey::varchar a, left(s_name, 9) b from supplier), s as (select c_nationkey::varchar a, 'Supplier#' b, c_mktsegment from customer)
    select round(avg((exists (select 1 from r where r.a = s.a and r.b = s.b))::int), 6) exact_row_match_rate from s"""
)
def exact_match(spark, sf_dir):
    """Customers whose nation some supplier has, as rows of two columns."""
    real = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.left("s_name", F.lit(9)).alias("kind"))
    made = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("Supplier#").alias("kind"))
    return reports.exact_match_rate(real, made, ["nation", "kind"])


@query(
    """with r as (select p_size::varchar v from part union select p_brand from part), s as (select l_quantity::bigint::varchar v from lineitem union all select l_returnflag from lineitem)
    select round(avg((v in (select v from r))::int), 6) non_key_cell_copy_rate from s"""
)
def cell_copy(spark, sf_dir):
    """Cells of `lineitem` that are some cell of `part`."""
    real = _table(spark, sf_dir, "part").select(F.col("p_size").alias("a"), F.col("p_brand").alias("b"))
    made = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("a"), F.col("l_returnflag").alias("b"))
    return reports.cell_copy_rate(real, made, ["a", "b"])


@query("select min(n) k_anonymity from (select count(*) n from customer group by c_nationkey, c_mktsegment)")
def k_anonymity(spark, sf_dir):
    return reports.k_anonymity(_table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


@query("select min(n) l_diversity from (select count(distinct c_mktsegment) n from customer group by c_nationkey)")
def l_diversity(spark, sf_dir):
    return reports.l_diversity(_table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")


@query("select doc_id, source from documents where not exists (select 1 from labels where labels.doc_id = documents.doc_id)")
def foreign_key_orphans(spark, sf_dir):
    """Documents without a label."""
    return synthesis.orphans(_table(spark, sf_dir, "documents"), "doc_id", _table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query(
    """with e as (select doc_id, toxic, quality from labels)
    select toxic, (count(*) filter (quality = 1 and n > 500))::bigint tp, (count(*) filter (quality != 1 and n > 500))::bigint fp, (count(*) filter (quality = 1 and n <= 500))::bigint fn from e join (select doc_id, n_chars n from documents) using (doc_id)
    where quality = 1 or n > 500 group by 1"""
)
def label_scores(spark, sf_dir):
    both = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    as_span = both.select(F.col("doc_id").alias("case_id"), F.col("toxic").alias("entity"), F.lit(0).alias("start"), F.lit(1).alias("end"), "quality", "n_chars")
    return reports.span_scores(as_span.where("quality = 1"), as_span.where("n_chars > 500")).select(F.col("entity").alias("toxic"), "tp", "fp", "fn")


@query(
    """select event_type, count(value) n, round(median(value), 6) median, round(list_sort(list(value))[greatest(1, ceil(count(value) * 0.95))::int], 6) p95, round(min(value), 6) least from events where value is not null group by 1"""
)
def timing_stats(spark, sf_dir):
    _checkpoints(spark)
    return reports.timing(_table(spark, sf_dir, "events").where("value is not null"), ["event_type"], "value")


# synthesis


def _spec() -> synthesis.TableSpec:
    c = synthesis.ColumnSpec
    return synthesis.TableSpec("people", (c("id", "integer", primary_key=True, minimum=10), c("age", "integer", minimum=18, maximum=90), c("score", "float", minimum=0.0, maximum=1.0, mean=0.5, deviation=0.2), c("segment", "category", categories=("a", "b"), weights={"a": 0.25, "b": 0.75}), c("joined", "date", nullable=True, null_rate=0.1), c("email", "email"), c("note", "text", locale="es-ES")))


def _draw_sql(table: str, column: str, draw: int = 0, row: str = "i", seed: str = "seed") -> str:
    """The number in [0, 1) that a cell draws."""
    head = f"shieldframe\0{seed}\0{table}\0{column}\0".encode().hex()
    return f"(('0x' || left(sha256(unhex('{head}' || hex(encode({row}::varchar)) || '00' || hex(encode('{draw}')))), 13))::ubigint / 4503599627370496.0)"


def _people_sql() -> str:
    u = lambda c, k=1: _draw_sql("people", c, k)
    normal = f"sqrt(-2 * ln(1 - {u('score')})) * cos(2 * pi() * {u('score', 2)})"
    names = list(synthesis.NAMES["es-ES"])
    return f"""select i + 10 id, 18 + floor({u("age")} * 73)::bigint age, round(least(1.0, greatest(0.0, 0.5 + {normal} * 0.2)), 4) score, case when {u("segment")} < 0.25 then 'a' else 'b' end segment,
    case when {u("joined", 0)} >= 0.1 then (date '2020-01-01' + floor({u("joined")} * 3653)::int)::varchar end joined, 'person' || (100000 + floor({u("email")} * 899999)::bigint) || '@example.test' email,
    {names}[floor({u("note")} * {len(names)})::int + 1] || ' note ' || (i + 1) note from range((select count(*) from customer)) x(i)"""


@query(_people_sql())
def synthetic_table(spark, sf_dir):
    """As many people as there are customers, every cell drawn from its place."""
    return synthesis.table(spark, _spec(), _table(spark, sf_dir, "customer").count(), "seed")


@query(
    f"""with p as (select c_custkey, row_number() over (order by sha256(unhex('{"seed".encode().hex()}00{"account".encode().hex()}00' || hex(encode(c_custkey::varchar)))), c_custkey) - 1 i, count(*) over () n from customer),
    r as (select i row, floor({_draw_sql("parents", "account")} * (select count(*) from customer))::bigint i from range((select count(*) from orders)) x(i))
    select row as "_row", c_custkey account from r join p using (i)"""
)
def synthetic_children(spark, sf_dir):
    """As many children as there are orders, each with a customer for a parent."""
    n = _table(spark, sf_dir, "orders").count()
    return synthesis.sample_parents(spark.range(n).withColumnRenamed("id", "_row"), "_row", _table(spark, sf_dir, "customer"), "c_custkey", "seed", "account")


def _kind_sql(value: str) -> str:
    v = f"({value})::varchar"
    return f"""case when {v} is null or {v} = '' then 'null' when lower({v}) in ('true', 'false') then 'boolean' when regexp_matches({v}, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') then 'email'
    when regexp_matches({v}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') and try_cast({v} as date) is not null then 'date' when regexp_matches({v}, '^[0-9]{{8}}$') and try_strptime({v}, '%Y%m%d') is not null then 'date'
    when regexp_matches({v}, '^\\+?[0-9][0-9 .()-]{{6,20}}$') then 'phone' when regexp_matches({v}, '^[+-]?[0-9]+$') then 'integer' when try_cast({v} as double) is not null then 'float' else 'text' end""".replace("\\\\", "\\")


_MIXED = {"key": "c_custkey", "half": "case when c_custkey % 2 = 0 then c_custkey end", "share": "(c_custkey % 7) * cast(0.5 as double)", "name": "c_name", "segment": "c_mktsegment", "mail": "concat(c_custkey, '@shop.example')", "joined": "case when c_custkey % 3 = 0 then '2024-02-29' else '20240101' end", "phone": "concat('+1 202 555 ', 1000 + c_custkey % 9000)", "flag": "case when c_custkey % 2 = 0 then 'True' else '' end", "odd": "case when c_custkey % 2 = 0 then 'x' else concat('1', '') end"}


def _mixed(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(*(F.expr(f"cast({e} as string)").alias(c) for c, e in _MIXED.items()))


_MIXED_SQL = " union all ".join(f"select '{c}' c, ({e})::varchar v from customer" for c, e in _MIXED.items())


@query(f"select c as \"column\", {_kind_sql('v')} kind, count(*) n from ({_MIXED_SQL}) group by 1, 2")
def kind_histogram(spark, sf_dir):
    return reports.kind_counts(_mixed(spark, sf_dir), list(_MIXED))


@query(
    f"""with k as (select c, v, {_kind_sql('v')} kind from ({_MIXED_SQL})),
    g as (select c, list(distinct kind) filter (kind != 'null') kinds, count(*) n, count(*) filter (kind != 'null') filled, count(distinct v) filter (kind != 'null') d from k group by 1),
    f as (select *, case when len(kinds) = 0 then 'null' when len(list_filter(kinds, lambda x: x not in ('integer', 'float'))) = 0 then case when list_contains(kinds, 'float') then 'float' else 'integer' end
     when len(kinds) = 1 then case when kinds[1] = 'text' and d <= least(50, greatest(4, (filled + 4) // 5)) then 'category' else kinds[1] end else 'text' end kind from g)
    select c as name, kind, filled < n nullable, (case when kind = 'category' then d else 0 end)::bigint categories, round((n - filled) / n, 6) null_rate,
     case when kind in ('integer', 'float') then (select min(try_cast(v as double)) from k where k.c = f.c) end minimum, case when kind in ('integer', 'float') then (select max(try_cast(v as double)) from k where k.c = f.c) end maximum from f"""
)
def inferred_kinds(spark, sf_dir):
    """The specification inferred from texts of every kind."""
    spec = synthesis.infer(_mixed(spark, sf_dir), "mixed")
    return synthesis.spec_table(spark, spec).select("name", "kind", "nullable", F.size("categories").cast("long").alias("categories"), "null_rate", "minimum", "maximum")


@query(
    """with b as (select *, l_orderkey % 2 h, case when l_orderkey % 2 = 1 and l_linenumber = 5 then 'Q' else l_returnflag end f from lineitem),
    a as (select h, avg(l_quantity) filter (h = 0 or l_linenumber not in (6, 7)) q, max(l_quantity) - min(l_quantity) r, avg((l_linenumber = 6)::int) empty, avg((l_linenumber not in (6, 7))::int) fine, avg((l_linenumber != 5)::int) known from b group by 1),
    w as (select f, count(*) filter (h = 0) / (select count(*) from b where h = 0) p, count(*) filter (h = 1) / (select count(*) from b where h = 1) q from b group by 1)
    select 'l_quantity' as "column", 'float' kind, 0.0::double source_null_rate, round((select empty from a where h = 1), 6) synthetic_null_rate, round((select fine from a where h = 1), 6) synthetic_type_valid_rate, null::double category_coverage, null::double category_total_variation,
     round(abs((select q from a where h = 0) - (select q from a where h = 1)) / greatest((select r from a where h = 0), 1), 6) normalized_mean_delta
    union all select 'l_returnflag', 'category', 0.0, 0.0, round((select known from a where h = 1), 6), (select count(*) filter (q > 0 and p > 0) / count(*) filter (p > 0) from w), (select round(sum(abs(p - q)) / 2, 6) from w), null"""
)
def quality_table(spark, sf_dir):
    """The quality report of the odd orders' lines against a specification of the even ones'; some of the cells are empty, no
    number or of no known category."""
    real, made = _halves(spark, sf_dir)
    n, line = F.col("l_quantity").cast("string"), F.col("l_linenumber")
    made = made.select(F.when(line == 7, "x").when(line == 6, "").otherwise(n).alias("l_quantity"), F.when(line == 5, "Q").otherwise(F.col("l_returnflag")).alias("l_returnflag"))
    real = real.select("l_quantity", "l_returnflag")
    report = synthesis.quality_report(real, made, synthesis.infer(real, "lines"))
    rates = {c: F.round(c, 6) for c in ("synthetic_null_rate", "synthetic_type_valid_rate")}
    return report.withColumns(rates).select("column", "kind", "source_null_rate", "synthetic_null_rate", "synthetic_type_valid_rate", "category_coverage", "category_total_variation", "normalized_mean_delta")


# payloads and deliveries


@query("select conv_id, count(*) messages, (count(*) filter (text is null or role not in ('system', 'developer', 'user', 'assistant', 'tool', 'function')))::bigint blocked, case when count(*) filter (text is null or role not in ('system', 'developer', 'user', 'assistant', 'tool', 'function')) > 0 then 'blocked' else 'protected' end state from conversations group by 1")
def chat_requests(spark, sf_dir):
    return payloads.valid_messages(_table(spark, sf_dir, "conversations"), "conv_id", "role", "text")


@query(
    """select pointer, count(*) n, count(distinct value) as "values" from (select '/role' pointer, role as value from conversations
    union all select '/content/0/text', text from conversations union all select repeat('/a', (turn % 12)::int) || '/0', left(text, 5) from conversations) group by 1"""
)
def json_leaves(spark, sf_dir):
    """String leaves of trees of up to a dozen levels and more."""
    _checkpoints(spark)
    quoted = lambda c: F.expr(f"substr(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    deep = F.concat(F.expr("repeat('{\"a\":', cast(turn % 12 as int))"), F.lit("["), quoted("left(text, 5)"), F.lit("]"), F.expr("repeat('}', cast(turn % 12 as int))"))
    plain = F.concat(F.lit('{"role":'), quoted("role"), F.lit(',"content":[{"text":'), quoted("text"), F.lit(',"size":3}]}'))
    turns = _table(spark, sf_dir, "conversations")
    rows = turns.select("conv_id", "turn", plain.alias("props")).union(turns.select("conv_id", "turn", deep.alias("props")))
    found = payloads.leaves(rows, ["conv_id", "turn"], "props")
    return found.groupBy("pointer").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"))


def _bodies(spark, sf_dir) -> DataFrame:
    """A request per conversation: its turns as messages of text blocks; odd turns are plain texts. Missing roles and texts are null."""
    turns = _table(spark, sf_dir, "conversations")
    quoted = lambda c: F.expr(f"coalesce(substr(to_json(array({c})), 2, length(to_json(array({c}))) - 2), 'null')")
    content = F.when(F.col("turn") % 2 == 1, quoted("text")).otherwise(F.concat(F.lit('[{"type":"text","text":'), quoted("text"), F.lit("}]")))
    message = F.concat(F.lit('{"role":'), quoted("role"), F.lit(',"content":'), content, F.lit("}"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]), ",")
    body = F.concat(F.lit('{"top": 1.10, "model" :"m","seed":12345678901234567890123456789012345678901234567,\t"messages":['), listed, F.lit('],"a":0e1 }'))
    return turns.groupBy("conv_id").agg(body.alias("body")).withColumn("endpoint", payloads.endpoint(F.lit("/v1/chat/completions")))


_TURNS = "(select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) - 1 i from conversations)"


@query(
    detection_sql.resolved(_TURNS, "text", "conv_id, turn, role, i, text is null missing") + ", " + detection_sql.rewritten("'[REDACTED:' || entity || ']'")
    + """, b as (select conv_id, bool_or(coalesce(role not in ('system', 'developer', 'user', 'assistant', 'tool'), true) or (missing and turn % 2 = 0)) bad from d group by 1)
    select conv_id, case when turn % 2 = 1 then '/messages/' || i || '/content' else '/messages/' || i || '/content/0/text' end pointer, md5(p.t) text_md5 from p join d using (r) join b using (conv_id) where not bad and not missing"""
)
def chat_bodies(spark, sf_dir):
    """Whole request bodies protected, and the texts in them."""
    _checkpoints(spark)
    done, _ = providers.protect_requests(_bodies(spark, sf_dir), "conv_id", "body", "endpoint", uniform("redact"))
    texts = payloads.leaves(done, ["conv_id"], "body").where(F.col("pointer").rlike("^/messages/[0-9]+/content(?:/0/text)?$"))
    return texts.select("conv_id", "pointer", F.md5("value").alias("text_md5"))


@query(
    """with m as (select conv_id, turn, coalesce(to_json(role)::varchar, 'null') role, coalesce(to_json(text)::varchar, 'null') t from conversations)
    select conv_id, md5('{"top": 1.10, "model" :"m","seed":12345678901234567890123456789012345678901234567,' || chr(9) || '"messages":[' || string_agg('{"role":' || role || ',"content":' || case when turn % 2 = 1 then t else '[{"type":"text","text":' || t || '}]' end || '}', ',' order by turn) || '],"a":0e1 }') body_md5, 'protected' state from m group by 1"""
)
def tree_round_trip(spark, sf_dir):
    """Whole JSON texts with their values made tokens, and restored: byte for byte what they were."""
    _checkpoints(spark)
    bodies = _bodies(spark, sf_dir).select("conv_id", "body")
    done, mappings = json_trees.protect_trees(bodies, "conv_id", "body", uniform("tokenize"), key=KEY)
    back = json_trees.restore_trees(done.select("conv_id", "body"), "conv_id", "body", mappings)
    return back.join(done.select("conv_id", "state"), "conv_id").select("conv_id", F.md5("body").alias("body_md5"), "state")


@query(
    """with e as (select event_id, event_id % 4 k, event_type from events)
    select event_id, case when k = 3 then 'blocked' else 'restored' end state, case when k = 3 then 'a token would reach a tool or side effect' end reason,
     case k when 0 then 'to ' || event_type when 1 then event_type when 2 then event_type end text from e"""
)
def provider_responses(spark, sf_dir):
    """Responses of all providers restored from the mappings; the ones with a token in a tool's input are blocked, however the
    token is written."""
    _checkpoints(spark)
    events = _dealt(_table(spark, sf_dir, "events").select("event_id", "event_type"))
    kinds = events.select("event_type").distinct().select(F.lit("s").alias("session_id"), F.lit("PERSON").alias("entity"), F.col("event_type").alias("value"))
    mappings = protect.allocate(kinds, uniform("tokenize", ("PERSON",)), KEY)
    k = F.col("event_id") % 4
    loose = F.replace(F.lower("replacement"), F.lit("|"), F.lit(" | "))
    written = F.when(F.col("event_id") % 8 < 4, F.col("replacement")).otherwise(loose)
    body = (
        F.when(k == 0, F.concat(F.lit('{"choices":[{"message":{"content":"to '), "replacement", F.lit('"}}]}')))
        .when(k == 1, F.concat(F.lit('{"output":[{"type":"message","content":[{"type":"output_text","text":"'), "replacement", F.lit('"}]}]}')))
        .when(k == 2, F.concat(F.lit('{"content":[{"type":"thinking","thinking":"'), "replacement", F.lit('"}]}')))
        .otherwise(F.concat(F.lit('{"content":[{"type":"tool_use","input":{"a":"'), written, F.lit('"}}]}')))
    )
    path = F.when(k == 0, "chat/completions").when(k == 1, "responses").otherwise("v1/messages")
    beside = F.broadcast(mappings) if mappings.limit(_FEW + 1).count() <= _FEW else mappings  # else each type's events would be one task
    rows = events.join(beside, events["event_type"] == mappings["value"]).select("event_id", body.alias("body"), payloads.endpoint(path).alias("endpoint"))
    done = providers.restore_responses(rows, "event_id", "body", "endpoint", mappings, rows.select("event_id", F.lit("s").alias("session_id")))
    paths = ("$.choices[0].message.content", "$.output[0].content[0].text", "$.content[0].thinking")
    return done.select("event_id", "state", "reason", F.coalesce(*(F.get_json_object("body", p) for p in paths)).alias("text"))


@query("select event_id, case event_id % 4 when 0 then 'chat/completions' when 1 then 'responses' when 2 then 'messages' end endpoint from events")
def provider_endpoints(spark, sf_dir):
    path = F.element_at(F.array(F.lit("/v1/chat/completions/"), F.lit("responses"), F.lit("v1/messages"), F.lit("v1/files")), (F.col("event_id") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", payloads.endpoint(path).alias("endpoint"))


@query(
    f"select event_id, 'sha256=' || {_hmac_sql('''floor(epoch(ts))::bigint::varchar || '.' || event_id::varchar || '.' || coalesce(props, '')''')} signature, abs(floor(epoch(ts))::bigint - {_NOW}) <= 86400 on_time from events"
)
def webhook_signatures(spark, sf_dir):
    ts = F.unix_timestamp("ts")
    return _table(spark, sf_dir, "events").select("event_id", webhooks.signature(KEY, ts, F.col("event_id").cast("string"), F.coalesce("props", F.lit(""))).alias("signature"), webhooks.on_time(ts, F.lit(_NOW), 86_400).alias("on_time"))


@query(
    """with t as (select user_id, event_type, floor(epoch(ts))::bigint t from events),
    f as (select user_id, list_reduce(list(t order by t), lambda a, x: case when x - a.last >= 300 then {'last': x, 'n': a.n + 1} else a end, {'last': -1000000::bigint, 'n': 0::bigint}) a from t group by user_id, event_type)
    select user_id, sum(a.n)::bigint n from f group by 1"""
)
def replay_first(spark, sf_dir):
    """Deliveries that are no replays within the real time to live, by user."""
    rows = _table(spark, sf_dir, "events").select("user_id", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("delivery"), F.unix_timestamp("ts").alias("t"))
    return webhooks.first_deliveries(rows, "delivery", "t").groupBy("user_id").agg(F.count("*").alias("n"))


_SIGNED = "event_id % 5 != 0"


@query(
    f"""with e as (select event_id, floor(epoch(ts))::bigint at_, user_id || '/' || event_type id, {_SIGNED} signed,
     case event_id % 7 when 0 then -301 when 1 then 301 when 2 then 300 when 3 then -300 else 0 end skew from events),
    w as (select *, at_ + skew sent, case when event_id % 13 = 0 then 'body_not_an_object' when event_id % 11 = 0 then 'bad_headers' when abs(skew) > 300 then 'out_of_tolerance' end why from e),
    f as (select list_reduce(list({{'at_': at_, 'sent': sent, 'signed': signed, 'event_id': event_id}} order by at_, signed, sent), lambda a, x: {{'until': case when a.until <= x.at_ and x.signed then greatest(x.at_, x.sent) + 300 else a.until end,
      'out': list_append(a.out, {{'event_id': x.event_id, 'outcome': case when a.until > x.at_ then 'replayed' when not x.signed then 'bad_signature' else 'accepted' end}})}},
      {{'until': 0::bigint, 'out': []::struct(event_id bigint, outcome varchar)[]}}).out o from w where why is null group by id)
    select event_id, why outcome from w where why is not null union all select u.event_id, u.outcome from (select unnest(o) u from f)"""
)
def webhook_outcomes(spark, sf_dir):
    """Every event as a delivery, some with broken bodies, ids, times or signatures; one user's events of a type share an id."""
    e = _table(spark, sf_dir, "events").withColumns({"at": F.unix_timestamp("ts"), "n": F.col("event_id")})
    hashed = F.md5(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").cast("binary"))
    named = F.when(F.col("n") % 3 == 0, F.upper(hashed)).otherwise(F.concat(F.lit("urn:uuid:"), hashed))
    skew = F.element_at(F.array(*map(F.lit, (-301, 301, 300, -300, 0, 0, 0))), (F.col("n") % 7 + 1).cast("int"))
    body = F.when(F.col("n") % 26 == 0, "[{}]").when(F.col("n") % 13 == 0, '{"k":1} {').otherwise(F.to_json(F.struct(F.col("n").alias("k"))))
    sent = e.select("event_id", "n", "at", body.alias("body"), (F.col("at") + skew).cast("string").alias("timestamp"), F.when(F.col("n") % 11 == 0, "no-id").otherwise(named).alias("delivery"))
    keys = F.when(F.expr(_SIGNED), F.lit(0)).otherwise(F.lit(1))
    signed = [webhooks.signature(k, F.col("timestamp"), webhooks.delivery_id(F.col("delivery")), F.col("body")) for k in (KEY, bytes([1]) * 32)]
    return webhooks.verified(sent.withColumn("signature", F.coalesce(F.when(keys == 0, signed[0]).otherwise(signed[1]), F.lit("none"))), KEY).select("event_id", "outcome")


#: What the presets are to do, entity by entity, as plain rows.
_PRESET_ROWS = """('balanced', 'API_KEY', 'redact'), ('balanced', 'DATE_TIME', 'generalize'), ('balanced', 'MONEY', 'generalize'), ('balanced', 'URL', 'keep'),
 ('strict', 'API_KEY', 'redact'), ('strict', 'CREDIT_CARD', 'redact'), ('strict', 'US_SSN', 'redact'), ('strict', 'IBAN_CODE', 'redact'), ('strict', 'US_BANK_NUMBER', 'redact'), ('strict', 'PASSPORT', 'redact'), ('strict', 'DRIVER_LICENSE', 'redact'), ('strict', 'MEDICAL_LICENSE', 'redact'),
 ('healthcare', 'API_KEY', 'redact'), ('healthcare', 'CREDIT_CARD', 'redact'), ('healthcare', 'US_SSN', 'redact'), ('healthcare', 'IBAN_CODE', 'redact'), ('healthcare', 'US_BANK_NUMBER', 'redact'), ('healthcare', 'PASSPORT', 'redact'), ('healthcare', 'DRIVER_LICENSE', 'redact'), ('healthcare', 'MEDICAL_LICENSE', 'redact'),
 ('healthcare', 'PERSON', 'synthetic'), ('healthcare', 'LOCATION', 'synthetic'), ('healthcare', 'DATE_TIME', 'synthetic'),
 ('finance', 'API_KEY', 'redact'), ('finance', 'US_SSN', 'redact'), ('finance', 'PASSPORT', 'redact'), ('finance', 'DRIVER_LICENSE', 'redact'), ('finance', 'MEDICAL_LICENSE', 'redact'), ('finance', 'MONEY', 'synthetic'),
 ('devsecops', 'API_KEY', 'redact'), ('devsecops', 'PERSON', 'keep'), ('devsecops', 'ORGANIZATION', 'keep'), ('devsecops', 'LOCATION', 'keep'), ('devsecops', 'DATE_TIME', 'keep'), ('devsecops', 'MONEY', 'keep'), ('devsecops', 'URL', 'keep')"""


@query(
    f"""with p(preset, entity, act) as (values {_PRESET_ROWS}), e as (select event_id, {list(PRESETS)}[(event_id % 5 + 1)::int] preset, {list(ENTITIES)}[(user_id % 17 + 1)::int] entity, (event_id * 37 % 1000000)::int ppm from events)
    select event_id, coalesce(act, 'tokenize') as action, coalesce(act, 'tokenize') = 'tokenize' or (preset = 'healthcare' and act = 'synthetic') reversible,
     case when coalesce(act, 'tokenize') = 'keep' then 'inactive_rule' when ppm < case when entity in ('PERSON', 'LOCATION', 'ORGANIZATION') then 650000 else 500000 end then 'below_confidence' else 'applied' end outcome from e left join p using (preset, entity)"""
)
def policy_lookup(spark, sf_dir):
    """Detections joined to their preset's rules: the action, whether it is reversible, and what comes of the detection."""
    rules = [(name, r.entity, r.action, r.reversible) for name in PRESETS for r in (preset(name).rule(e) for e in ENTITIES)]
    table = spark.createDataFrame(rules, "preset string, entity string, action string, reversible boolean")
    e = F.col("event_id")
    found = _table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, PRESETS)), (e % 5 + 1).cast("int")).alias("preset"), F.element_at(F.array(*map(F.lit, ENTITIES)), (F.col("user_id") % 17 + 1).cast("int")).alias("entity"), (e * 37 % 1_000_000).cast("int").alias("ppm"))
    one = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), "entity", F.col("ppm").alias("confidence_ppm"), F.lit("x").alias("detector"), F.lit("v").alias("value"))).cast(SPANS)
    outcome = F.coalesce(*(F.when(F.col("preset") == name, resolve.decisions(one, preset(name))[0]["outcome"]) for name in PRESETS))
    return found.join(F.broadcast(table), ["preset", "entity"], "left").select("event_id", "action", "reversible", outcome.alias("outcome"))


_FIVE = list(PRESETS)
_PRESET_OF = f"{_FIVE}[(ascii(coalesce(source, '')) % 5 + 1)::int]"


@query(
    detection_sql.resolved(
        f"(select *, {_PRESET_OF} preset from documents)", "text", "doc_id, preset",
        verdict=f"case when exists (select 1 from (values {_PRESET_ROWS}) p(preset, entity, act) where act = 'keep' and p.entity = z.entity and p.preset = z.preset) then 'inactive_rule' end",
    ).replace("false denied from c", "false denied from (select c.*, d.preset from c join d using (r))").replace("from (select *, false denied", "from (select *, false denied", 1).replace(") verdict", ") verdict")
    .replace("claimed from (select *, false denied from (select c.*, d.preset from c join d using (r)))", "claimed from (select *, false denied from (select c.*, d.preset from c join d using (r))) z")
    + f" select doc_id, d.preset, a.entity, s as start, e as \"end\", coalesce(act, 'tokenize') as action, outcome from a join d using (r) left join (values {_PRESET_ROWS}) p(preset, entity, act) on p.preset = d.preset and p.entity = a.entity"
)
def policies_by_source(spark, sf_dir):
    """Every candidate of all documents under the preset of its source: five policies as data in one plan."""
    named = F.element_at(F.array(*map(F.lit, _FIVE)), (F.ascii(F.coalesce("source", F.lit(""))) % 5 + 1).cast("int"))
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text", named.alias("preset")))
    rows = protect.with_policies(docs, {n: preset(n) for n in _FIVE}, "preset")
    traced = rows.select("doc_id", "preset", "policy", F.explode_outer(protect.trace_by(F.col("text"), F.col("policy"))).alias("d")).where("d is not null")
    action = F.coalesce(F.try_element_at(F.col("policy.rules"), F.col("d.entity"))["action"], F.lit("keep"))
    return traced.select("doc_id", "preset", "d.entity", "d.start", "d.end", action.alias("action"), "d.outcome")


def _all() -> None:
    from shieldframe.plans import round_trips  # noqa: F401 - registers its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
