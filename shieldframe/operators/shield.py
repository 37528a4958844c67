"""One object for the usual calls: a policy, a key and a vault, and what is done with them."""

from __future__ import annotations

import secrets
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shieldframe.functions import actions
from shieldframe.functions.recognizers import Detector
from shieldframe.operators import json_trees, protect, restore
from shieldframe.operators.vault import Vault, audit_rows, detection_rows, fingerprint, live, source_digest
from shieldframe.policy import DAY, Blocked, Policy, uniform


class Shield:
    """Protects and restores tables. With a vault, reversible values share their replacements over all calls of a session; without
    one, each call has its own mappings, which it gives back. Without a policy, each row is under its own session's, as the
    vault has it."""

    def __init__(self, spark: SparkSession, policy: Policy | None, key: bytes | None = None, vault: Vault | None = None, found: Sequence[Detector] | None = None):
        self.spark, self.policy, self.key, self.vault = spark, policy, key, vault
        self.options = {} if found is None else {"found": list(found)}
        self._digests = key or secrets.token_bytes(actions.KEY_BYTES)  # without a key, hashes of one call agree and can't be looked up

    def _reversible(self, scope: str) -> bool:
        return any(r.reversible and r.claims(scope) for r in self.policy.active().values())

    def create_session(self, metadata: dict[str, str] | None = None, now: int | None = None, policy: Policy | None = None) -> str:
        return self.vault.create_session(policy or self.policy, int(time.time()) if now is None else now, metadata, self.key)

    def protect(self, df: DataFrame, text: str, row: str, scope: str = "*", now: int | None = None) -> tuple[DataFrame, DataFrame | None]:
        """`df` (session_id where values are to be reversible, or with a vault) with `protected_text`, and the mappings (null
        without any). Blocked where a key or detector is missing.

        With a vault, one commit stores the mappings, a detection per applied span and an audit event per row, before any text
        can be read. Rows of unknown or expired sessions, and those for which a detector failed, get a null text; their
        audit events say `blocked`.
        """
        names = [d.name for d in self.options["found"]] if self.options else ["regex-v1"]
        if self.policy is not None:
            self.policy.gate(names, scope, has_key=self.key is not None)
        elif self.vault is None:
            raise Blocked("sessions have policies only in a vault")
        if self.vault is None and not self._reversible(scope):
            done = protect.protect(df, text, self.policy, scope=scope, key=self.key, into="_done", **self.options)
            return done.withColumn("protected_text", F.col("_done.text")).drop("_done"), None
        now = int(time.time()) if now is None else now
        if self.vault is None:
            marked = protect.marked(df, text, self.policy, scope, "_spans", **self.options)
            mappings = protect.allocate(protect.spans_of(marked, ["session_id"], "_spans"), self.policy, self.key)
            return protect.render_marked(marked, text, self.policy, mappings, self.key, row=row, spans="_spans"), mappings
        own = protect.rules_of(F.col("policy_json") if self.policy is None else F.lit(self.policy.to_json()))
        alive = live(self.vault.read("sessions"), now).select(F.col("id").alias("session_id"), own.alias("_policy"))
        df = df.join(alive, "session_id", "left")
        if self.policy is None:
            found = protect.with_spans_by(df, text, "_policy", scope, into="_spans", **self.options)
            keyless = F.exists(F.map_values("_policy.rules"), lambda r: r["reversible"] & (F.array_contains(r["scopes"], "*") | F.array_contains(r["scopes"], scope)))
            ready = F.lit(True) if self.key else ~keyless
        else:
            found, ready = protect.with_spans(df, text, self.policy, scope, into="_spans", **self.options), F.lit(True)
        marked = found.withColumn("_spans", F.when(F.col("_policy").isNotNull() & ready, F.col("_spans"))).checkpoint()
        applied = self._applied(marked, text)
        if self.policy is None and self.key or self.policy is not None and self._reversible(scope):
            mappings = self.vault.allocate(applied.where("reversible"), None, self.key, now, lambda placed: self._records(marked, text, applied, placed, now))
            joined, mapped = protect.with_map(marked, mappings, row=row, spans="_spans")
        else:
            self.vault.append_all(self._records(marked, text, applied, None, now))
            mappings, joined, mapped = None, marked, lambda s: F.lit(None).cast("string")
        if self.policy is None:
            chosen = lambda s: protect.choose_by(F.col("_policy.rules"), s, self._digests, mapped)
        else:
            chosen = lambda s: protect.choose(self.policy, s, self._digests, mapped)
        return joined.withColumn("protected_text", protect.rewrite(F.col(text), F.col("_spans"), chosen)).drop("_spans", "_map", "_policy"), mappings

    def _applied(self, marked: DataFrame, text: str) -> DataFrame:
        """A row per applied span, with its rule and its policy's name and retentions, and the keyed hash of its text."""
        rows = marked.select("session_id", "_policy", source_digest(self._digests, F.coalesce(F.col(text), F.lit(""))).alias("source_hash"), F.explode("_spans").alias("s"))
        rule = F.try_element_at(F.col("_policy.rules"), F.col("s.entity"))
        return rows.select(
            "session_id", "source_hash", "s.entity", "s.detector", "s.confidence_ppm", rule["action"].alias("action"), rule["reversible"].alias("reversible"), "s.start", "s.end", "s.value",
            F.col("_policy.name").alias("policy_name"), F.col("_policy.version").alias("policy_version"), "_policy.mapping_retention", "_policy.audit_retention",
        )

    def _records(self, marked: DataFrame, text: str, applied: DataFrame, placed: DataFrame | None, now: int) -> dict[str, DataFrame]:
        """Rows of `detections` and `audit_events` for rows with their spans; `placed` are the mappings as stored."""
        if placed is None:
            applied = applied.withColumn("mapping_id", F.lit(None).cast("string"))
        else:
            known = placed.select("session_id", F.col("entity_type").alias("entity"), "original_hmac", "mapping_id")
            hashed = applied.withColumn("original_hmac", F.when(F.col("reversible"), fingerprint(self.key, F.col("session_id"), F.col("entity"), F.col("value"))))
            applied = hashed.join(known, ["session_id", "entity", "original_hmac"], "left")
        done, known = F.col("_spans").isNotNull(), F.col("_policy").isNotNull()
        facts = [F.col("_policy.name").alias("policy"), F.col("_policy.version").alias("policy_version")]
        digest = source_digest(self._digests, F.coalesce(F.col(text), F.lit(""))).alias("source_hash")
        reason = F.when(known, "protection failed").otherwise("unknown or expired session").alias("reason")
        detail = F.when(done, F.to_json(F.struct(F.size("_spans").alias("detections"), *facts, digest))).otherwise(F.to_json(F.struct(*facts, reason, digest)))
        keep = F.coalesce(F.col("_policy.audit_retention"), F.lit(30 * DAY))
        events = marked.select(F.when(known, F.col("session_id")).alias("session_id"), F.lit("transform").alias("event_type"), F.when(done, "protected").otherwise("blocked").alias("outcome"), detail.alias("detail"), keep.alias("_keep"))
        return {"detections": detection_rows(applied, None, self._digests, now), "audit_events": audit_rows(events, now, F.col("_keep"))}

    def summary(self, session: str, now: int | None = None) -> DataFrame:
        """A session's live detections, counted."""
        return self.vault.summary(session, int(time.time()) if now is None else now)

    def protect_json(self, df: DataFrame, row: str, json: str, session: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
        return json_trees.protect_trees(df, row, json, self.policy, key=self.key, session=session, **self.options)

    def restore(self, df: DataFrame, text: str, row: str, mappings: DataFrame | None = None, now: int | None = None) -> DataFrame:
        """`df` with `restored`, from `mappings` or from the vault's live ones."""
        if mappings is not None:
            return restore.restore_found(df, text, mappings, row=row)
        return self.vault.restore(df, text, self.key, int(time.time()) if now is None else now, row)

    def restore_capsule(self, df: DataFrame, text: str, capsule: str, session: Column, into: str = "restored") -> DataFrame:
        """`df` with its texts restored from the capsule that each row carries; null where the capsule can't be opened."""
        opened = df.withColumn("_reverse", restore.open_capsule(F.col(capsule), self.key, session))
        return opened.withColumn(into, F.when(F.col("_reverse").isNotNull(), restore.restore(F.col(text), F.col("_reverse")))).drop("_reverse")


def probes(spark: SparkSession, key: bytes, text: str = "Write to probe@post.example about it.") -> DataFrame:
    """One row of booleans: whether a text comes back from its tokens, also from loosely written ones; whether reversible rules
    without a key block; whether the value is out of the protected text; whether the key has its length."""
    df = spark.createDataFrame([(0, "probe", text)], "id int, session_id string, t string")
    policy = uniform("tokenize", ("EMAIL_ADDRESS",))
    shown, mappings = Shield(spark, policy, key).protect(df, "t", "id")
    loose = shown.withColumn("loose", F.lower(F.replace("protected_text", F.lit("|"), F.lit(" | "))))
    back = restore.restore_found(restore.restore_found(loose, "protected_text", mappings, row="id"), "loose", mappings, row="id", into="restored_loose")
    keyless = protect.protect(df, "t", policy).select(F.col("protected.state").alias("state"), "id")
    value = F.lit("probe@post.example")
    return back.join(keyless, "id").select(
        (F.col("restored") == F.col("t")).alias("round_trip"),
        F.contains("restored_loose", value).alias("tolerant_token"),
        (F.col("state") == "blocked").alias("keyless_blocks"),
        (~F.contains("protected_text", value)).alias("value_is_out"),
        F.lit(len(key) == actions.KEY_BYTES).alias("key_valid"),
    )
