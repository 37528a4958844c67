"""Protection of a text column: detect, resolve, replace. One row in, one row out, without a shuffle.

Reversible rules need a mapping that is stored before any text is rendered: `allocate` gives the distinct values, makes
a token for each once and checkpoints them; `render` then joins nothing but a document's own mappings.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shieldframe.functions import actions
from shieldframe.functions.nested import let
from shieldframe.functions.recognizers import SPANS, DenyListDetector, Detector, deny_spans, detectors
from shieldframe.operators import resolve
from shieldframe.policy import ACTIONS, ENTITIES, Blocked, Policy

APPLIED = "struct<start:int,end:int,entity:string,confidence_ppm:int,detector:string,value:string,action:string,replacement:string>"


def detect(text: Column, policy: Policy, scope: Column | str = "*", found: Sequence[Detector] | None = None) -> Column:
    """Accepted spans of a text, disjoint and in order of start. Null text has none."""
    return resolve.resolve(resolve.candidates(F.coalesce(text, F.lit("")), policy, found), policy, scope)


def trace(text: Column, policy: Policy, scope: Column | str = "*", found: Sequence[Detector] | None = None) -> Column:
    """Every candidate with its outcome."""
    return resolve.decisions(resolve.candidates(F.coalesce(text, F.lit("")), policy, found), policy, scope)


def with_spans(df: DataFrame, text: str, policy: Policy, scope: Column | str = "*", found: Sequence[Detector] | None = None, into: str = "spans", only: Sequence[str] | None = None) -> DataFrame:
    """`df` (its columns `only`) with a column of the accepted spans, as `detect` gives them.

    Each recognizer has a column of its own first. They are read twice in the next step, so Spark keeps the two apart: one
    expression with all recognizers runs at half the speed.
    """
    kept = list(df.columns if only is None else only)
    whole, active = F.coalesce(F.col(text), F.lit("")), list(policy.active())
    parts = [p for d in (detectors() if found is None else found) for p in d.parts(whole, active)]
    if policy.deny_terms:
        parts.append(DenyListDetector(policy.deny_terms).spans(whole, active))
    taken = {c.lower() for c in df.columns}
    names = [f"_part_{i}" for i in range(len(taken) + len(parts)) if f"_part_{i}" not in taken][: len(parts)]
    wide = df.select(*dict.fromkeys([*kept, *([] if isinstance(scope, str) else df.columns)]), *(p.alias(n) for n, p in zip(names, parts, strict=True)))
    none = F.array().cast(SPANS)
    every = [F.when(F.col(n).isNull(), None).when(F.size(n) > 0, F.col(n)).otherwise(none) for n in names]
    spans = resolve.resolve(F.concat(*every) if every else none, policy, scope)
    return wide.select(*(c for c in kept if c.lower() != into.lower()), spans.alias(into))


def span_table(df: DataFrame, keys: Sequence[str], text: str, policy: Policy, **options) -> DataFrame:
    """One row per accepted span: the keys, entity, start, end, confidence_ppm, detector, value.

    The outer explode keeps Spark from putting a filter on the spans below it, which would find them all a second time.
    """
    spans = with_spans(df, text, policy, into="_spans", only=keys, **options).select(*keys, F.explode_outer("_spans").alias("s")).where("s is not null")
    return spans.select(*keys, "s.entity", "s.start", "s.end", "s.confidence_ppm", "s.detector", "s.value")


def rewrite(text: Column, spans: Column, replacement) -> Column:
    """The text with replacement(span) in the place of each of its disjoint, ordered spans; null where they are null."""
    raw = text.cast("binary")
    cut = lambda r, a, b: F.substring(r, a + 1, b - a).cast("string")

    def build(r: Column, all_: Column) -> Column:
        pieces = F.transform(all_, lambda s, i: F.concat(cut(r, F.when(i == 0, 0).otherwise(F.get(all_, i - 1)["end"]), s["start"]), replacement(s)))
        return F.concat(F.array_join(pieces, ""), cut(r, F.element_at(all_, -1)["end"], F.octet_length(r)))

    return let(spans, lambda all_: F.when(all_.isNull(), None).when(F.size(all_) > 0, let(raw, lambda r: build(r, all_))).otherwise(text))


def choose(policy: Policy, s: Column, key: bytes | None, mapped) -> Column:
    """The replacement of one span, by its entity's rule."""
    by_action: dict[tuple[str, bool], list[str]] = {}
    for e, r in policy.active().items():
        by_action.setdefault((r.action, bool(r.reversible)), []).append(e)
    out = []
    for (action, reversible), entities in by_action.items():
        ours = s["entity"].isin(*entities)
        value = mapped(s) if reversible else actions.replacement(action, s["entity"], s["value"], key, tuple(entities))
        out.append(F.when(ours, value))
    return F.coalesce(*out, F.lit("[BLOCKED]"))


def action_of(policy: Policy, entity: Column) -> Column:
    return F.coalesce(*(F.when(entity == e, F.lit(r.action)) for e, r in policy.active().items()), F.lit("keep"))


def protect(df: DataFrame, text: str, policy: Policy, *, scope: Column | str = "*", key: bytes | None = None, found: Sequence[Detector] | None = None, into: str = "protected") -> DataFrame:
    """`df` with a struct column: text, state and detections. For policies without reversible rules in the scope.

    Fails closed: a missing detector or key blocks the whole batch (text null, state blocked, reason), and a row for which a
    detector failed (its spans are null) or whose result would be null is blocked, never passed through. Null text stays null and protected. Hashes and synthetic values
    without a key come from a random one that is drawn for the call: they agree within it and can't be looked up.
    """
    found = detectors() if found is None else list(found)
    try:
        policy.gate([d.name for d in found], scope if isinstance(scope, str) else None, has_key=False)
    except Blocked as e:
        blocked = F.struct(F.lit(None).cast("string").alias("text"), F.lit("blocked").alias("state"), F.array().cast(f"array<{APPLIED}>").alias("detections"), F.lit(str(e)).alias("reason"))
        return df.withColumn(into, blocked)

    def with_replacement(s: Column) -> Column:
        fields = [s[f].alias(f) for f in ("start", "end", "entity", "confidence_ppm", "detector", "value")]
        return F.struct(*fields, action_of(policy, s["entity"]).alias("action"), choose(policy, s, key, lambda x: x["value"]).alias("replacement")).cast(APPLIED)

    key = key or secrets.token_bytes(actions.KEY_BYTES)  # without a key, one for this call that nobody keeps
    body = lambda all_: F.struct(all_.alias("detections"), rewrite(F.col(text), all_, lambda s: s["replacement"]).alias("text"))
    done = with_spans(df, text, policy, scope, found, "_p").withColumn("_p", let(F.transform("_p", with_replacement), body))
    state = F.when(F.col("_p.text").isNull() & F.col(text).isNotNull(), "blocked").otherwise("protected")
    reason = F.when(state == "blocked", "protection failed").otherwise(F.lit(None).cast("string"))
    return done.withColumn(into, F.struct(F.col("_p.text").alias("text"), state.alias("state"), F.col("_p.detections").alias("detections"), reason.alias("reason"))).drop("_p")


def allocate(spans: DataFrame, policy: Policy, key: bytes, known: DataFrame | None = None, group: str = "session_id") -> DataFrame:
    """Mappings (group, entity, value, replacement) for the reversible values of a span table (group, entity, value).

    Values that `known` has already keep their replacement. New ones get a token each around 16 random bytes; irreversible
    surfaces that stay reversible carry their token behind them. The result is checkpointed: tokens are drawn once.
    """
    rules = [e for e, r in policy.active().items() if r.reversible]
    values = spans.where(F.col("entity").isin(*rules)).select(group, "entity", "value").distinct()
    if known is not None:
        values = values.join(known.select(group, "entity", "value"), [group, "entity", "value"], "left_anti")
    new = with_replacements(values.withColumn("action", action_of(policy, F.col("entity"))), key).select(group, "entity", "value", "replacement")
    return (new if known is None else known.select(group, "entity", "value", "replacement").unionByName(new)).checkpoint()


def with_replacements(values: DataFrame, key: bytes) -> DataFrame:
    """`values` (entity, value, action, ...) of reversible rules with a `replacement` for each, around 16 random bytes. Each run
    draws anew: whoever reads it twice stores it first."""
    drawn = values.withColumn("_hex", F.substring(F.sha2(F.concat(F.uuid(), F.uuid()).cast("binary"), 256), 1, 32))
    made = actions.token(F.col("entity"), key, F.col("_hex"))
    shown = F.coalesce(*(F.when(F.col("action") == a, actions.replacement(a, F.col("entity"), F.col("value"), key, ENTITIES)) for a in ("generalize", "synthetic")), F.lit(""))
    return drawn.withColumn("replacement", F.when(F.col("action") == "tokenize", made).otherwise(F.concat(shown, F.lit(" "), made))).drop("_hex")


#: A row's own policy: what `rules_of` reads from its JSON.
_JSON = "struct<name:string,version:int,rules:array<struct<entity:string,action:string,enabled:boolean,reversible:boolean,minimum_confidence_ppm:int,priority:int,scopes:array<string>,required_detectors:array<string>>>,allow_terms:array<string>,deny_terms:map<string,string>,mapping_retention_seconds:bigint,audit_retention_seconds:bigint>"


def rules_of(policy_json: Column) -> Column:
    """A policy (see `Policy.to_json`) as a struct: name, version, rules (active ones by entity), allow, deny, required (names of
    detectors), mapping_retention, audit_retention. Null where there is none."""

    def read(p: Column) -> Column:
        active = F.filter(p["rules"], lambda r: r["enabled"] & (r["action"] != "keep"))
        entry = lambda r: F.struct(r["entity"], F.struct(r["action"], r["reversible"], r["minimum_confidence_ppm"], r["priority"], r["scopes"]))
        out = F.struct(
            p["name"].alias("name"), p["version"].alias("version"), F.map_from_entries(F.transform(active, entry)).cast(resolve.RULES).alias("rules"), p["allow_terms"].alias("allow"), p["deny_terms"].alias("deny"),
            F.array_distinct(F.flatten(F.transform(active, lambda r: r["required_detectors"]))).alias("required"),
            p["mapping_retention_seconds"].alias("mapping_retention"), p["audit_retention_seconds"].alias("audit_retention"),
        )
        return F.when(p["rules"].isNotNull(), out)

    return let(F.from_json(policy_json, _JSON), read)


def with_policies(df: DataFrame, policies: Mapping[str, Policy], by: str, into: str = "policy") -> DataFrame:
    """`df` with the policy that its column `by` names, as `rules_of` gives it; null where there is none of that name. The
    policies are on the driver as they are, so they go to the rows, which a join by name would send to as few tasks as there
    are names."""
    table = df.sparkSession.createDataFrame([(n, p.to_json()) for n, p in policies.items()], "_name string, _json string")
    parsed = table.select("_name", rules_of(F.col("_json")).alias(into))
    return df.join(F.broadcast(parsed), F.col(by) == F.col("_name"), "left").drop("_name")


def trace_by(text: Column, policy: Column, scope: Column | str = "*", found: Sequence[Detector] | None = None) -> Column:
    """Every candidate of a text with its outcome under the row's own policy (see `rules_of`)."""
    whole = F.coalesce(text, F.lit(""))
    every = [d.spans(whole, ENTITIES) for d in (detectors() if found is None else found)]
    return resolve.decisions(F.concat(*every, _denied(whole, policy)), None, scope, policy["allow"], policy["rules"])


def explained(df: DataFrame, text: str, policy: Policy, scope: str = "*", key: bytes | None = None, found: Sequence[Detector] | None = None, into: str = "trace") -> DataFrame:
    """`df` with how its policy came to its result: every candidate with its outcome and a snapshot of the rule it was judged by
    (null where no rule is active), the gate (what is required, what is missing, whether it passed), the number of applied
    spans, and the state. Blocked rows, and rows for which a detector failed, have no decisions."""
    own = detectors() if found is None else list(found)
    names, required = [d.name for d in own], sorted({d for r in policy.active().values() for d in r.required_detectors})
    try:
        policy.gate(names, scope, has_key=key is not None)
        reason = None
    except Blocked as e:
        reason = str(e)
    rules = rules_of(F.lit(policy.to_json()))["rules"]
    made = trace(F.col(text), policy, scope, own) if reason is None else F.lit(None).cast(f"array<{resolve.DECISION}>")
    names_of = [f.split(":")[0] for f in resolve.DECISION.removeprefix("struct<").removesuffix(">").split(",")]
    with_rule = F.transform(made, lambda d: F.struct(*(d[n].alias(n) for n in names_of), F.try_element_at(rules, d["entity"]).alias("rule")))
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    gate = F.struct(strings(required).alias("required"), strings(sorted(set(required) - set(names))).alias("missing"), F.lit(reason is None).alias("passed"), F.lit(reason).cast("string").alias("reason"))
    body = lambda ds: F.struct(
        ds.alias("decisions"), gate.alias("gate"), F.when(ds.isNotNull(), F.size(F.filter(ds, lambda d: d["outcome"] == "applied"))).alias("applied_count"),
        F.when(ds.isNull(), "blocked").otherwise("protected").alias("state"), F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"),
    )
    return df.withColumn(into, let(with_rule, body))


def _denied(text: Column, policy: Column) -> Column:
    terms = F.coalesce(policy["deny"], F.create_map().cast("map<string,string>"))
    return F.flatten(F.transform(F.map_entries(terms), lambda e: deny_spans(text, e["key"], e["value"])))


def with_spans_by(df: DataFrame, text: str, policy: str, scope: Column | str = "*", found: Sequence[Detector] | None = None, into: str = "spans") -> DataFrame:
    """`df` with the accepted spans of each row under its own policy (a column of `rules_of`): one plan for any number of
    policies, whose rules are data. All recognizers run; what a row's policy has no active rule for is left out. Null where a
    detector failed, or the row has no policy, or its policy requires a detector that isn't there."""
    found = detectors() if found is None else list(found)
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = [p for d in found for p in d.parts(whole, ENTITIES)]
    taken = {c.lower() for c in df.columns}
    names = [f"_part_{i}" for i in range(len(taken) + len(parts) + 1) if f"_part_{i}" not in taken][: len(parts) + 1]
    wide = df.select("*", *(p.alias(n) for n, p in zip(names, [*parts, _denied(whole, F.col(policy))], strict=True)))
    none = F.array().cast(SPANS)
    every = [F.when(F.col(n).isNull(), None).when(F.size(n) > 0, F.col(n)).otherwise(none) for n in names]
    there = F.size(F.array_except(F.col(policy)["required"], F.array(*(F.lit(d.name) for d in found)).cast("array<string>"))) == 0
    spans = F.when(F.coalesce(there, F.lit(False)), resolve.resolve(F.concat(*every), None, scope, F.col(policy)["allow"], F.col(policy)["rules"]))
    return wide.select(*(c for c in df.columns if c.lower() != into.lower()), spans.alias(into))


def choose_by(rules: Column, s: Column, key: bytes | None, mapped) -> Column:
    """The replacement of one span under a row's own rules."""

    def chosen(r: Column) -> Column:
        by_action = (F.when(r["action"] == a, actions.replacement(a, s["entity"], s["value"], key, ENTITIES)) for a in ACTIONS if a not in ("keep", "tokenize"))
        return F.when(r["reversible"], mapped(s)).otherwise(F.coalesce(*by_action))

    return F.coalesce(let(F.try_element_at(rules, s["entity"]), chosen), F.lit("[BLOCKED]"))


def marked(df: DataFrame, text: str, policy: Policy, scope: str = "*", into: str = "spans", **options) -> DataFrame:
    """`df` with a column of the accepted spans, checkpointed: what is allocated and rendered from it detects only once."""
    return with_spans(df, text, policy, scope, into=into, **options).checkpoint()


def spans_of(rows: DataFrame, keys: Sequence[str], spans: str = "spans") -> DataFrame:
    """A span table (keys, entity, value, ...) of a table that `marked` made."""
    return rows.select(*keys, F.explode_outer(spans).alias("s")).where("s is not null").select(*keys, "s.entity", "s.start", "s.end", "s.confidence_ppm", "s.detector", "s.value")


def render_marked(df: DataFrame, text: str, policy: Policy, mappings: DataFrame, key: bytes, *, row: str, group: str = "session_id", spans: str = "spans", into: str = "protected_text") -> DataFrame:
    """`df` (see `marked`) with its text protected under `policy`, reversible values by `mappings` (see `allocate`). `row` names
    a unique column. A row whose value has no mapping gets [BLOCKED] in its place."""
    joined, mapped = with_map(df, mappings, row=row, group=group, spans=spans)
    return joined.withColumn(into, rewrite(F.col(text), F.col(spans), lambda s: choose(policy, s, key, mapped))).drop(spans, "_map")


def with_map(df: DataFrame, mappings: DataFrame, *, row: str, group: str = "session_id", spans: str = "spans") -> tuple[DataFrame, Callable[[Column], Column]]:
    """`df` with a map of each row's own mappings, and what finds a span's replacement in it."""
    own = df.select(row, group, F.explode(spans).alias("s")).select(row, group, "s.entity", "s.value").distinct()
    pairs = own.join(mappings, [group, "entity", "value"]).groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x00", "entity", "value"), "replacement"))).alias("_map"))
    return df.join(pairs, row, "left"), lambda s: F.element_at(F.col("_map"), F.concat_ws("\x00", s["entity"], s["value"]))


def render(df: DataFrame, text: str, policy: Policy, mappings: DataFrame, key: bytes, *, row: str, group: str = "session_id", scope: str = "*", into: str = "protected_text") -> DataFrame:
    """The same for a table whose spans aren't marked yet."""
    return render_marked(marked(df, text, policy, scope, "_spans"), text, policy, mappings, key, row=row, group=group, spans="_spans", into=into)
