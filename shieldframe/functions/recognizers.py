"""Recognizers: text to typed candidate spans with UTF-8 byte offsets, as Column expressions."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from shieldframe.functions import checks
from shieldframe.functions.nested import let, running

try:  # only for many denied terms; without it each is a pattern
    import ahocorasick
except ModuleNotFoundError:
    ahocorasick = None

#: Denied terms up to so many are patterns of their own.
FEW_TERMS = 16
SPAN = "struct<start:int,end:int,entity:string,confidence_ppm:int,detector:string,value:string>"
SPANS = f"array<{SPAN}>"
_HITS = "array<struct<start:int,end:int,which:int>>"
REGEX_CONFIDENCE = 990_000
MONEY_BYTES = 128

_ATOM = r"[A-Zİ0-9](?:[A-Zİ0-9-]{0,61}[A-Zİ0-9])?"
_WORD = r"\p{L}\p{N}_"
_SPACE = r"\s\x1c-\x1f"


@dataclass(frozen=True)
class Recognizer:
    entity: str
    pattern: str
    valid: Callable[[Column], Column] | None = None
    gate: str | None = None  # name of a cheap test (see GATES) that is never false where the pattern matches


def _has(*parts: str) -> Callable[[Column], Column]:
    def test(text: Column) -> Column:
        found = F.lit(False)
        for p in parts:
            found = found | F.contains(text, F.lit(p))
        return found

    return test


#: Recognizers with one gate are behind one test, which most texts fail.
GATES: dict[str, Callable[[Column], Column]] = {
    "at": _has("@"),
    "key": _has("sk-", "gh", "AKIA"),
    "scheme": _has("://"),
    "digit": lambda t: t.rlike(r"\p{Nd}"),
    "digits": lambda t: t.rlike(r"\p{Nd}{3}"),
    "address": lambda t: F.contains(t, F.lit(":")) | t.rlike(r"\p{Nd}\."),
    "money": lambda t: (_has("$", "€", "£")(t) | t.rlike("(?i)(?:usd|eur|gbp)")) & t.rlike(r"\p{Nd}"),
}
#: The accepted languages, in Java's dialect with Unicode classes. Each looks first at whether its first character
#: is there, which is cheaper than what may not stand before it, and takes a zero byte wherever it takes the byte 1 (see `_found`).
RECOGNIZERS = (
    Recognizer(
        "EMAIL_ADDRESS",
        rf"(?Ui)(?<![{_WORD}.!#$%&'*+=?^`{{|}}~-])[A-Zİ0-9.!#$%&'*+=?^_`{{|}}~-]{{1,64}}+@{_ATOM}(?:\.{_ATOM})+(?![{_WORD}-])",
        gate="at",
    ),
    Recognizer("PHONE_NUMBER", r"(?U)(?=[+(\d])(?<!\d)(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{4}(?!\d)", gate="digits"),
    Recognizer("US_SSN", r"(?U)(?=\d)(?<!\d)(?!000|666|9\d\d)\d{3}([- ]?)(?!00)\d{2}\1(?!0000)\d{4}(?!\d)", gate="digits"),
    Recognizer("CREDIT_CARD", r"(?U)(?=\d)(?<!\d)(?:\d[ -]*?){13,19}(?!\d)", checks.luhn, "digit"),
    Recognizer(
        "IP_ADDRESS",
        r"(?U)(?=[0-9A-Fa-f:])(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Fa-f:.])|(?=\d)(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])",
        checks.ip,
        "address",
    ),
    Recognizer(
        "API_KEY",
        r"(?U)(?=[sgA])(?<![A-Za-z0-9])(?:sk-[A-Za-z0-9_-]{16,200}|gh[pousr]_[A-Za-z0-9]{20,255}|AKIA[A-Z0-9]{16})(?![A-Za-z0-9])",
        gate="key",
    ),
    Recognizer("DATE_TIME", r"(?U)(?=\d)(?<!\d)(?:20\d{2}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]20\d{2})(?!\d)", gate="digits"),
    Recognizer(
        "MONEY",
        rf"(?Ui)(?=[$€£\d])(?<![{_WORD}])(?:[$€£][{_SPACE}]?\d[\d ,.]*\d|[$€£][{_SPACE}]?\d|\d[\d ,.]*\d[{_SPACE}]?(?:USD|EUR|GBP)|\d[{_SPACE}]?(?:USD|EUR|GBP))(?![{_WORD}])",
        lambda v: F.octet_length(v) <= MONEY_BYTES,
        "money",
    ),
    Recognizer("URL", rf"(?Ui)(?=h)(?<![{_WORD}])https?://[^{_SPACE}<>\"']+", checks.url, "scheme"),
    Recognizer(
        "IBAN_CODE",
        r"(?Ui)(?=[DEFG])(?<![A-Zİ0-9])(?:DE(?: ?[A-Zİ0-9]){20}|ES(?: ?[A-Zİ0-9]){22}|FR(?: ?[A-Zİ0-9]){25}|GB(?: ?[A-Zİ0-9]){20})(?![A-Zİ0-9])",
        checks.iban,
    ),
    Recognizer("US_BANK_NUMBER", r"(?U)(?=\d)(?<!\d)\d{3}(?:[ -]?\d{3}){2}(?!\d)", checks.aba, "digits"),
)


def matches(text: Column, pattern: Column | str, entity: Column | str, confidence_ppm: int, detector: str) -> Column:
    """Every leftmost, non-overlapping match as a span. The pattern must consume at least one character."""
    none = F.array().cast(SPANS)
    of, regex = (F.lit(x) if isinstance(x, str) else x for x in (entity, pattern))

    def spans(found: Column) -> Column:
        def placed(gaps: Column) -> Column:
            items = F.transform(found, lambda v, i: F.struct(v.alias("value"), F.octet_length(gaps[i]).alias("gap"), F.octet_length(v).alias("bytes")))
            return running(
                items,
                lambda m: m["gap"] + m["bytes"],
                lambda at, m: F.struct(
                    (at + m["gap"]).cast("int").alias("start"),
                    (at + m["gap"] + m["bytes"]).cast("int").alias("end"),
                    of.alias("entity"),
                    F.lit(confidence_ppm).alias("confidence_ppm"),
                    F.lit(detector).alias("detector"),
                    m["value"].alias("value"),
                ),
                SPAN,
            )

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), placed)).otherwise(none)

    hits = F.regexp_extract_all(text, regex, F.lit(0))
    return let(hits, spans)


def _found(text: Column, r: Recognizer, detector: str) -> Column:
    """`matches` of a recognizer that are valid, with one pass of its pattern: zero bytes are put around what it matches, and the
    text is cut there. A text's own zero bytes are the byte 1 meanwhile."""
    zero, raw = F.contains(text, F.lit("\0")), text.cast("binary")
    marked = F.regexp_replace(F.replace(text, F.lit("\0"), F.lit("\x01")), r.pattern, "\0$0\0")

    def placed(parts: Column) -> Column:
        items = F.transform(F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)), lambda i: F.struct(F.get(parts, i).alias("value"), F.octet_length(F.get(parts, i - 1)).alias("gap"), F.octet_length(F.get(parts, i)).alias("bytes")))
        return running(
            items,
            lambda m: m["gap"] + m["bytes"],
            lambda at, m: F.struct(
                (at + m["gap"]).cast("int").alias("start"),
                (at + m["gap"] + m["bytes"]).cast("int").alias("end"),
                F.lit(r.entity).alias("entity"),
                F.lit(REGEX_CONFIDENCE).alias("confidence_ppm"),
                F.lit(detector).alias("detector"),
                F.when(zero, F.substring(raw, (at + m["gap"] + 1).cast("int"), m["bytes"]).cast("string")).otherwise(m["value"]).alias("value"),
            ),
            SPAN,
        )

    spans = let(F.split(marked, "\0", -1), lambda parts: F.when(F.size(parts) > 1, placed(parts)).otherwise(F.array().cast(SPANS)))
    return _checked(spans, r)


class Detector:
    """A source of candidate spans: a name, and spans(text, entities) as an array Column. Subclass to plug in others, for
    instance one that wraps a pandas UDF around a model."""

    name = "detector"

    def spans(self, text: Column, entities: Iterable[str]) -> Column:
        raise NotImplementedError

    def parts(self, text: Column, entities: Iterable[str]) -> list[Column]:
        """The same spans in several columns, where they can be told apart."""
        return [self.spans(text, entities)]


class RegexDetector(Detector):
    """Patterns with checksum validators. Recognizers of entities that aren't asked for are not in the plan at all."""

    name = "regex-v1"

    def spans(self, text: Column, entities: Iterable[str]) -> Column:
        wanted = set(entities)
        by_gate: dict[str | None, list[Column]] = {}
        for r in RECOGNIZERS:
            if r.entity in wanted:
                by_gate.setdefault(r.gate, []).append(_found(text, r, self.name))
        none = F.array().cast(SPANS)
        found = [F.concat(*spans) if gate is None else F.when(GATES[gate](text), F.concat(*spans)).otherwise(none) for gate, spans in by_gate.items()]
        return F.concat(*found) if found else none


    def parts(self, text: Column, entities: Iterable[str]) -> list[Column]:
        wanted, none = set(entities), F.array().cast(SPANS)
        out = []
        for r in RECOGNIZERS:
            if r.entity in wanted:
                found = _found(text, r, self.name)
                out.append(found if r.gate is None else F.when(GATES[r.gate](text), found).otherwise(none))
        return out


def _checked(spans: Column, recognizer: Recognizer) -> Column:
    if recognizer.valid is None:
        return spans
    return F.filter(spans, lambda s: recognizer.valid(s["value"]))


def deny_spans(text: Column, term: Column, entity: Column) -> Column:
    """A row's own denied term in its text, in any case, with full confidence."""
    quoted = F.concat(F.lit("(?Ui)\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return matches(text, quoted, entity, 1_000_000, DenyListDetector.name)


class DenyListDetector(Detector):
    """Literal terms, found in any case, with full confidence. Each term's matches go from left to right without overlaps.

    Up to `FEW_TERMS` are patterns in the plan, a pass over the text each. More go through one automaton over all terms, in
    Arrow batches: its time is that of the text and its matches, however many terms there are.
    """

    name = "deny-list"

    def __init__(self, terms: Mapping[str, str]):
        self.terms = dict(terms)

    def spans(self, text: Column, entities: Iterable[str]) -> Column:
        wanted = set(entities)
        terms = {t: e for t, e in self.terms.items() if e in wanted}
        if len(terms) > FEW_TERMS and ahocorasick is not None:
            return _by_automaton(terms)(text)
        quoted = lambda t: "".join(c if c.isalnum() or c in " _" else re.escape(c) if c.isascii() else c for c in t)
        found = [matches(text, f"(?Ui){quoted(t)}", e, 1_000_000, self.name) for t, e in terms.items()]
        return F.concat(*found) if found else F.array().cast(SPANS)


class _Folds(dict):
    """Characters by what they are compared as, as far as asked for: single ones, so that places stay."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        up = c.upper() if len(c.upper()) == 1 else c
        self[code] = up.lower()[0]  # one character has two in lower case: I with a dot, which is an i here
        return self[code]


def _by_automaton(terms: Mapping[str, str]) -> Callable[[Column], Column]:
    """Spans of all terms. Python gives three whole numbers a hit, as Arrow arrays; Spark makes the spans of them, row by row,
    so a batch of texts full of hits stays small."""
    made: dict[str, object] = {}
    entities = sorted(set(terms.values()))

    def build() -> tuple:
        folds, automaton, named = _Folds(), ahocorasick.Automaton(), {}
        for term, entity in terms.items():
            named.setdefault(term.translate(folds), []).append(entities.index(entity))
        for folded, of in named.items():
            automaton.add_word(folded, (folded, of))
        automaton.make_automaton()
        return folds, automaton

    def hits_of(text: str, folds: _Folds, automaton) -> list[tuple]:
        ends: dict[str, int] = {}
        hits = []
        for last, (folded, of) in automaton.iter(text.translate(folds)):
            start = last + 1 - len(folded)
            if start >= ends.get(folded, 0):
                ends[folded] = last + 1
                hits.append((start, last + 1, of))
        return sorted(hits, key=lambda h: h[:2])

    @F.arrow_udf(_HITS)
    def run(texts: pa.Array) -> pa.Array:
        if not made:
            made["it"] = build()
        offsets, starts, ends, which = array("i", [0]), array("i"), array("i"), array("i")
        for one in texts:
            text = one.as_py() or ""
            plain, at, size = text.isascii(), 0, 0
            for start, end, of in hits_of(text, *made["it"]):
                if not plain:
                    size += len(text[at:start].encode())
                    at, end = start, size + len(text[start:end].encode())
                    start = size
                for e in of:
                    starts.append(start)
                    ends.append(end)
                    which.append(e)
            offsets.append(len(starts))
        columns = [pa.array(np.frombuffer(c, np.int32)) if len(c) else pa.array([], pa.int32()) for c in (starts, ends, which)]
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), pa.StructArray.from_arrays(columns, ["start", "end", "which"]))

    once = run.asNondeterministic()  # so that no filter on the spans is put below them, where they would be found a second time

    def spans(text: Column) -> Column:
        named = F.array(*map(F.lit, entities))

        def one(raw: Column, h: Column) -> Column:
            value = F.substring(raw, h["start"] + 1, h["end"] - h["start"]).cast("string")
            return F.struct(h["start"].alias("start"), h["end"].alias("end"), F.get(named, h["which"]).alias("entity"), F.lit(1_000_000).alias("confidence_ppm"), F.lit(DenyListDetector.name).alias("detector"), value.alias("value"))

        both = F.struct(once(text).alias("hits"), text.cast("binary").alias("raw"))
        return let(both, lambda x: F.transform(x["hits"], lambda h: one(x["raw"], h))).cast(SPANS)

    return spans


class ModelDetector(Detector):
    """A detector around a function from a text to (start, end, entity, confidence in 0 to 1) with places in code points, such
    as a model's. It runs in Arrow batches; a text for which it raises gets null spans, which block the row.

    `names` maps the function's labels to entities; others are dropped."""

    def __init__(self, name: str, function: Callable[[str], Iterable[tuple[int, int, str, float]]], names: Mapping[str, str]):
        self.name, self.function, self.names = name, function, dict(names)

    def spans(self, text: Column, entities: Iterable[str]) -> Column:
        wanted, name, function, names = set(entities), self.name, self.function, self.names

        def one(text: str | None):
            try:
                out = []
                for start, end, label, score in function(text or ""):
                    entity = names.get(label)
                    if entity in wanted and end > start:
                        at = len(text[:start].encode())
                        value = text[start:end]
                        out.append({"start": at, "end": at + len(value.encode()), "entity": entity, "confidence_ppm": round(score * 1_000_000), "detector": name, "value": value})
                return out
            except Exception:  # noqa: BLE001 - whatever it is, the row must not pass
                return None

        @F.pandas_udf(SPANS)
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([one(t) for t in texts], dtype=object)

        return run(text)


def detectors(mode: str = "regex", plugins: Iterable[Detector] = ()) -> list[Detector]:
    """The detectors of a mode: `regex`, or `plugins` for the ones given; a mode never falls back to another silently."""
    if mode == "regex":
        return [RegexDetector(), *plugins]
    chosen = list(plugins)
    if mode != "plugins" or not chosen:
        raise ValueError(f"no detector for mode {mode!r}")
    return chosen
