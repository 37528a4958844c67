"""Resolution: candidate spans to accepted, non-overlapping spans under a policy, with a decision for every candidate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shieldframe.functions.nested import BLOCK, let
from shieldframe.functions.recognizers import SPANS, DenyListDetector, Detector, detectors
from shieldframe.policy import Policy

_FIELDS = "start:int,end:int,entity:string,confidence_ppm:int,detector:string,value:string"
#: Candidates in order of precedence: the rank first, so that sorting the structs sorts by precedence.
RANKED = f"struct<unclaimed:int,not_denied:int,minus_priority:int,minus_confidence:int,minus_bytes:int,{_FIELDS},claimed:boolean,verdict:string>"
DECISION = f"struct<{_FIELDS},outcome:string>"
#: Up to so many spans are decided as they are; more are put into clusters first.
FEW = 32
_STATE = f"struct<taken:array<struct<start:int,end:int>>,out:array<{DECISION}>>"


#: What full case folding makes of characters, by Unicode's own table, where it changes them: single ones, and those that
#: become several.
_FOLDS = {c: c.casefold() for c in map(chr, range(0x110000)) if c.casefold() != c}
_SINGLE = {c: f for c, f in _FOLDS.items() if len(f) == 1}
_SEVERAL = {c: f for c, f in _FOLDS.items() if len(f) > 1}
_ANY_OF_SEVERAL = "[" + "".join(_SEVERAL) + "]"


def fold_case(text: Column) -> Column:
    """Full Unicode case folding: sharp s is ss, ligatures are their letters, all sigmas are one.

    Single characters are translated; only those that become several are looked up, one by one."""
    ascii_only = text.rlike(r"^[\x00-\x7F]*$")
    table = F.create_map(*(F.lit(x) for pair in _SEVERAL.items() for x in pair))
    single = F.translate(text, "".join(_SINGLE), "".join(_SINGLE.values()))

    def spread(t: Column) -> Column:
        hits = F.regexp_extract_all(t, F.lit(_ANY_OF_SEVERAL), F.lit(0))
        return let(hits, lambda hs: F.array_join(F.transform(F.split(t, _ANY_OF_SEVERAL, -1), lambda gap, i: F.concat(gap, F.coalesce(F.try_element_at(table, F.get(hs, i)), F.lit("")))), ""))

    whole = let(single, lambda t: F.when(t.rlike(_ANY_OF_SEVERAL), spread(t)).otherwise(t))
    return F.when(ascii_only, F.lower(text)).otherwise(whole)


def candidates(text: Column, policy: Policy, found: Sequence[Detector] | None = None) -> Column:
    """All candidates of the policy's active entities: every detector's spans, then the deny list's."""
    active = list(policy.active())
    every = [d.spans(text, active) for d in (detectors() if found is None else found)]
    if policy.deny_terms:
        every.append(DenyListDetector(policy.deny_terms).spans(text, active))
    return F.concat(*every) if every else F.array().cast(SPANS)


#: The rules of a row's own policy, by entity; only active ones are there.
RULES = "map<string,struct<action:string,reversible:boolean,floor:int,priority:int,scopes:array<string>>>"


def decisions(spans: Column, policy: Policy | None, scope: Column | str = "*", allow: Column | None = None, rules: Column | None = None) -> Column:
    """Every candidate with its outcome, in order of precedence among those eligible, the others first. `allow` is a column of
    terms (array) that the row allows besides the policy's. Null where a detector failed (gave null spans). The rules are
    those of `policy`, in the plan, or those of a column `rules` (of type RULES), a row's own; without rules nothing applies.

    Outcomes: inactive_rule, below_confidence, allowed_value, overlap_suppressed, scope_not_claimed, applied. Confidence
    is checked before the allow list. Precedence: claimed by the scope, deny list, priority, confidence, byte length,
    then start, entity and detector. A span that no rule of the scope claims still shadows those after it.
    """
    scope = F.lit(scope) if isinstance(scope, str) else scope
    listed, active = rules, policy.active() if policy else {}
    more, allow = allow, F.array(*(fold_case(F.lit(t)) for t in (policy.allow_terms if policy else ()))).cast("array<string>")
    if more is not None:
        allow = F.concat(allow, F.transform(F.coalesce(more, F.array().cast("array<string>")), fold_case))

    def look(entity: Column, value, field: str) -> Column:
        if listed is not None:
            return F.try_element_at(listed, entity)[field]
        return F.coalesce(*(F.when(entity == e, value(r)) for e, r in active.items()), F.lit(None)) if active else F.lit(None)

    def ranked(s: Column) -> Column:
        floor = look(s["entity"], lambda r: F.lit(r.minimum_confidence_ppm), "floor").cast("int")
        if listed is None:
            claimed = look(s["entity"], lambda r: F.lit(True) if "*" in r.scopes else scope.isin(*r.scopes), "scopes").cast("boolean")
        else:
            claimed = let(look(s["entity"], None, "scopes"), lambda scopes: F.array_contains(scopes, "*") | F.array_contains(scopes, scope))
        claimed = F.coalesce(claimed, F.lit(False))
        verdict = (
            F.when(floor.isNull(), "inactive_rule")
            .when(s["confidence_ppm"] < floor, "below_confidence")
            .when(F.array_contains(allow, fold_case(s["value"])), "allowed_value")
        )
        return F.struct(
            F.when(claimed, 0).otherwise(1).alias("unclaimed"),
            F.when(s["detector"] == DenyListDetector.name, 0).otherwise(1).alias("not_denied"),
            (-F.coalesce(look(s["entity"], lambda r: F.lit(r.priority), "priority").cast("int"), F.lit(0))).alias("minus_priority"),
            (-s["confidence_ppm"]).alias("minus_confidence"),
            (s["start"] - s["end"]).alias("minus_bytes"),
            *(s[f.split(":")[0]].alias(f.split(":")[0]) for f in _FIELDS.split(",")),
            claimed.alias("claimed"),
            verdict.alias("verdict"),
        ).cast(RANKED)

    def decided(c: Column, outcome: Column) -> Column:
        return F.struct(*(c[f.split(":")[0]].alias(f.split(":")[0]) for f in _FIELDS.split(",")), outcome.alias("outcome")).cast(DECISION)

    def step(state: Column, c: Column) -> Column:
        clash = F.exists(state["taken"], lambda t: (c["start"] < t["end"]) & (t["start"] < c["end"]))
        outcome = F.when(clash, "overlap_suppressed").when(c["claimed"], "applied").otherwise("scope_not_claimed")
        taken = F.when(clash, state["taken"]).otherwise(F.array_append(state["taken"], F.struct(c["start"].alias("start"), c["end"].alias("end"))))
        return F.struct(taken.alias("taken"), F.array_append(state["out"], decided(c, outcome)).alias("out")).cast(_STATE)

    def fold(eligible: Column) -> Column:
        zero = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("taken"), F.array().cast(f"array<{DECISION}>").alias("out")).cast(_STATE)
        return F.aggregate(eligible, zero, step)["out"]

    def many(eligible: Column) -> Column:
        beside = lambda cs: let(fold(cs), lambda out: F.transform(cs, lambda c, i: F.struct(c.alias("rank"), F.get(out, i).alias("out"))))
        every = F.flatten(F.transform(clusters(eligible), lambda part: let(F.array_sort(part), beside)))
        return F.transform(F.array_sort(every), lambda x: x["out"])

    def decide(all_: Column) -> Column:
        out = F.transform(F.filter(all_, lambda c: c["verdict"].isNotNull()), lambda c: decided(c, c["verdict"]))
        eligible = F.filter(all_, lambda c: c["verdict"].isNull())
        return F.concat(out, let(eligible, lambda es: F.when(F.size(es) <= FEW, fold(F.array_sort(es))).otherwise(many(es))))

    none = F.array().cast(f"array<{DECISION}>")
    return let(spans, lambda s: F.when(s.isNull(), None).when(F.size(s) > 0, let(F.transform(s, ranked), decide)).otherwise(none))


def clusters(spans: Column) -> Column:
    """The spans in groups that don't overlap each other's: sorted by start, and cut where all that began before has ended.

    The greatest end so far is carried over the sorted spans in blocks, so the cost is that of sorting; what is chosen in one
    cluster says nothing about another, so each is decided by itself.
    """

    def ends(block: Column, at: Column) -> Column:
        zero = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, zero, lambda a, x: F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))

    def cut(by: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(by) - 1, F.lit(BLOCK)), lambda b: F.transform(F.slice(by, b + 1, F.lit(BLOCK)), lambda x: F.struct(x["end"].alias("end"))))
        zero = F.struct(F.lit(-1).alias("at"), F.array().cast("array<array<int>>").alias("out"))
        done = F.aggregate(blocks, zero, lambda a, part: let(ends(part, a["at"]), lambda r: F.struct(r["at"].alias("at"), F.array_append(a["out"], r["out"]).alias("out"))))
        return let(F.flatten(done["out"]), lambda reach: pieces(by, reach))

    def pieces(by: Column, reach: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(by) - 1), lambda i: F.get(by, i)["start"] >= F.get(reach, i))
        return let(heads, lambda hs: F.transform(hs, lambda h, i: F.transform(F.slice(by, h + 1, F.coalesce(F.get(hs, i + 1), F.size(by)) - h), lambda x: x["span"])))

    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s.alias("span")))
    return let(F.array_sort(keyed), cut)


def applied(decided: Column) -> Column:
    """The accepted spans of decisions, in order of start."""
    kept = F.filter(decided, lambda d: d["outcome"] == "applied")
    order = F.transform(kept, lambda d: F.struct(*(d[f.split(":")[0]].alias(f.split(":")[0]) for f in _FIELDS.split(","))).cast(f"struct<{_FIELDS}>"))
    return F.array_sort(order)


def resolve(spans: Column, policy: Policy | None, scope: Column | str = "*", allow: Column | None = None, rules: Column | None = None) -> Column:
    """Accepted spans: disjoint, in order of start."""
    return applied(decisions(spans, policy, scope, allow, rules))
