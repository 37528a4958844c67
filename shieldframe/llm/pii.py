"""Personal data: patterns propose spans, checksums confirm them, context words adjust their scores. SQL functions only.

Each kind's pattern runs over the whole text, leftmost and without overlaps; matches that fail their check are dropped
and not retried. Email, IP address, card and phone number are the base kinds, of which every confirmed match is kept.
IBANs (mod-97), US social security numbers (allocation rules), access keys of known form and other secrets (long runs
of letters and digits) are added where their score reaches `THRESHOLD`; social security numbers and secrets need a
context word within `CONTEXT_CHARS` before or after them for that. Patterns use possessive quantifiers and look behind
for the start of a run, so that they take time in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shieldframe.functions.nested import let, running
from shieldframe.llm.scratch import unused

CONTEXT_CHARS = 40
THRESHOLD = 500
CONTEXT_POINTS = 150
#: Lengths of IBANs by country, from the public registry (fixed values).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_SPAN = "struct<kind_no:int,kind:string,start:int,end:int,byte_start:int,byte_end:int,score:int>"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    points: int
    context: str
    base: bool
    hint: str | None = None  # a character that every match holds


def _iban() -> str:
    """Countries by length, so that a place in the text is tried once a length."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    return "(?:" + "|".join(f"(?:{'|'.join(cs)})[0-9]{{2}}(?:[ ]?[A-Z0-9]){{{n - 4}}}" for n, cs in sorted(by_length.items())) + ")"


IBAN = _iban()
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 900, "mail|contact|correo|courriel", True, "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 600, "ip|host|server|address|adresse", True, "."),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", 800, "card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 700, "phone|tel|call|mobile|fax|mobil|handy", True, "+"),
    Kind("iban", "(?=[A-Z]{2}[0-9]{2})" + IBAN, 850, "iban|account|bank|konto|cuenta|compte", False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 400, "ssn|social|security", False, "-"),
    Kind("key", r"(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,255}|sk-[A-Za-z0-9_-]{16,200})", 850, "key|token|secret", False),
    Kind("secret", r"[A-Za-z0-9_+/-]{20,}+", 400, "token|secret|passw|api[ _-]?key|access[ _-]?key|auth|bearer|credential", False),
)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(let(d.cast("int") * 2, lambda x: F.when(x > 9, x - 9).otherwise(x))),
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def iban_ok(value: Column) -> Column:
    """Whether an IBAN's check digits are right: the value, moved round and with letters as numbers, is 1 modulo 97."""
    compact = F.regexp_replace(value, "[ ]", "")
    moved = F.concat(F.expr("substr('', 1)"), F.substring(compact, 5, 60), F.substring(compact, 1, 4))
    code = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    step = lambda a, c: let(code(c), lambda v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97))
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _confirmed(kind: Kind) -> Callable[[Column], Column]:
    def check(m: Column) -> Column:
        v = m["value"]
        if kind.name == "ip":
            part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
            return v.rlike(rf"^{part}(?:\.{part}){{3}}$")
        if kind.name == "card":
            digits = F.regexp_replace(v, "[ -]", "")
            return let(digits, lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
        if kind.name == "phone":
            return F.length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15)
        if kind.name == "iban":
            return iban_ok(v)
        if kind.name == "ssn":
            free = ~(m["before"].rlike("[0-9-]$") | m["after"].rlike("^[0-9-]")) & ~m["touching"]
            return free & ~v.rlike("^(?:000|666|9)") & (F.substring(v, 5, 2) != "00") & (F.substring(v, 8, 4) != "0000")
        if kind.name == "key":
            return ~(m["before"].rlike("[A-Za-z0-9]$") | m["after"].rlike("^[A-Za-z0-9]"))
        if kind.name == "secret":
            return v.rlike("[0-9]") & v.rlike("[A-Za-z]")
        return F.lit(True)

    return check


def _spans(text: Column, number: int, kind: Kind) -> Column:
    """The kind's confirmed spans of `text` (array of structs in order of start)."""
    pattern = F.lit(kind.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    if kind.hint:
        hits = F.when(F.contains(text, F.lit(kind.hint)), hits).otherwise(F.array().cast("array<string>"))

    def placed(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            items = F.transform(
                found,
                lambda v, i: F.struct(
                    v.alias("value"),
                    F.length(gaps[i]).alias("gap"),
                    F.length(v).alias("chars"),
                    F.octet_length(gaps[i]).alias("gap_bytes"),
                    F.octet_length(v).alias("bytes"),
                    F.right(gaps[i], F.lit(CONTEXT_CHARS)).alias("before"),
                    F.left(gaps[i + 1], F.lit(CONTEXT_CHARS)).alias("after"),
                    ((i > 0) & (gaps[i] == "")).alias("touching"),
                ),
            )
            # code points and bytes run together: both sums in one long, bytes above bit 31
            wide = lambda a, b: a.cast("long") + b.cast("long") * (1 << 31)
            item = "struct<at:bigint,m:struct<value:string,gap:int,chars:int,gap_bytes:int,bytes:int,before:string,after:string,touching:boolean>>"
            run = running(
                items,
                lambda m: wide(m["gap"] + m["chars"], m["gap_bytes"] + m["bytes"]),
                lambda at, m: F.struct((at + wide(m["gap"], m["gap_bytes"])).alias("at"), m.alias("m")),
                item,
            )
            near = rf"(?:^|[^a-z])(?:{kind.context})"
            low = lambda x: x["at"].bitwiseAND((1 << 31) - 1).cast("int")
            high = lambda x: F.shiftright(x["at"], 31).cast("int")
            scored = F.transform(
                F.filter(run, lambda x: _confirmed(kind)(x["m"])),
                lambda x: F.struct(
                    F.lit(number).alias("kind_no"),
                    F.lit(kind.name).alias("kind"),
                    low(x).alias("start"),
                    (low(x) + x["m"]["chars"]).alias("end"),
                    high(x).alias("byte_start"),
                    (high(x) + x["m"]["bytes"]).alias("byte_end"),
                    (F.lit(kind.points) + F.when(F.lower(x["m"]["before"]).rlike(near) | F.lower(x["m"]["after"]).rlike(near), CONTEXT_POINTS).otherwise(0)).alias("score"),
                ).cast(_SPAN),
            )
            return scored if kind.base else F.filter(scored, lambda s: s["score"] >= THRESHOLD)

        none = F.array().cast(f"array<{_SPAN}>")
        return F.when(F.size(found) > 0, let(F.split(text, kind.pattern, -1), with_gaps)).otherwise(none)

    return let(hits, placed)


def with_spans(docs: DataFrame, text_col: str = "text", name: str = "pii_spans") -> DataFrame:
    """`docs` with a column of all spans: structs of kind_no, kind, start, end (code points, end exclusive), byte_start,
    byte_end and score (0 to 1000), in order of start, kind and end. Null and empty texts have none."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order = lambda s: F.struct(s["start"], s["kind_no"], s["end"], s["kind"], s["byte_start"], s["byte_end"], s["score"])
    every = F.concat(*(_spans(text, i, k) for i, k in enumerate(KINDS)))
    return docs.withColumn(name, F.array_sort(F.transform(every, order)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, counts of the base kinds, base_sha256, spans, then counts of the added kinds
    and all scores in the spans' order. Repeated rows stay; null ids stay null; other columns are ignored."""
    rows = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    count = lambda n: F.size(F.filter("pii_spans", lambda s: s["kind"] == n)).cast("long").alias(f"n_{n}")
    base = [k.name for k in KINDS if k.base]
    return rows.select(
        "doc_id",
        *(count(n) for n in base),
        F.sha2(_joined(F.filter("pii_spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _joined(F.col("pii_spans")).alias("spans"),
        *(count(k.name) for k in KINDS if not k.base),
        F.array_join(F.transform("pii_spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with each span of its text replaced by its kind in brackets, such as [EMAIL]; the columns stay as they are.

    Of overlapping spans the one that starts first gives the label, of those the longest, then the first kind listed; what
    the others have beyond its end is removed too.
    Null texts stay null; texts without spans stay as they are.
    """
    spans = unused("pii_spans", docs.columns)
    first = "struct<byte_start:int,length:int,kind_no:int,kind:string,byte_end:int>"
    piece = "struct<at:int,out:array<string>>"
    order = lambda s: F.struct(s["byte_start"], (s["byte_start"] - s["byte_end"]).alias("length"), s["kind_no"], s["kind"], s["byte_end"]).cast(first)
    raw = F.col(text_col).cast("binary")
    cut = lambda a, b: F.substring(raw, a + 1, b - a).cast("string")

    def add(acc: Column, s: Column) -> Column:
        more = F.struct(
            s["byte_end"].alias("at"),
            F.concat(acc["out"], F.array(cut(acc["at"], s["byte_start"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"),
        )
        longer = F.struct(F.greatest(acc["at"], s["byte_end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["byte_start"] >= acc["at"], more.cast(piece)).otherwise(longer.cast(piece))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(piece)
    folded = F.aggregate(F.array_sort(F.transform(spans, order)), zero, add)
    new = let(folded, lambda a: F.concat(F.array_join(a["out"], ""), cut(a["at"], F.octet_length(raw))))
    return with_spans(docs, text_col, spans).withColumn(text_col, F.when(F.size(spans) > 0, new).otherwise(F.col(text_col))).select(*docs.columns)
