"""The mapping vault: sessions, mappings, detections and audit events as tables, with expiry, uniqueness and cascades.

Tables are DataFrames in, DataFrames out. `VaultStore` keeps them as Parquet in a folder, with numbered manifests that
name their parts; `vault_jdbc` keeps them in a database. Both do the same with sessions, mappings and audit events.
"""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shieldframe.functions.actions import hmac_sha256, joined_with_nul
from shieldframe.operators import protect, restore
from shieldframe.policy import DAY, Blocked, Policy

#: The tables' names and columns.
SCHEMAS = {
    "sessions": "id string, policy_json string, metadata_encrypted binary, created_at long, expires_at long",
    "mappings": "id string, session_id string, entity_type string, original_hmac string, original_encrypted binary, replacement string, action string, created_at long, expires_at long",
    "detections": "id string, session_id string, mapping_id string, entity_type string, detector string, confidence_ppm int, action string, policy_name string, policy_version int, source_hash string, start_offset int, end_offset int, created_at long, expires_at long",
    "audit_events": "id string, session_id string, event_type string, outcome string, detail_json string, created_at long, expires_at long",
}
MOST_TRIES = 8
#: Parts under SMALL_BYTES are merged, MERGED at a time; what that replaces stays for KEPT more commits.
SMALL_BYTES, MERGED, KEPT = 64 << 20, 16, 4
PURGE_ORDER = ("audit_events", "detections", "mappings", "sessions")


def live(df: DataFrame, now: int) -> DataFrame:
    """Rows that haven't expired."""
    return df.where(F.col("expires_at") > now)


def find_mappings(requests: DataFrame, mappings: DataFrame, now: int) -> DataFrame:
    """Requests (session_id, entity_type, original_hmac, ...) with the live mapping's id and replacement, or nulls."""
    on = ["session_id", "entity_type", "original_hmac"]
    return requests.join(live(mappings, now).select(*on, F.col("id").alias("mapping_id"), "replacement"), on, "left")


def new_mappings(offered: DataFrame, mappings: DataFrame, now: int) -> DataFrame:
    """The offered mappings that may be stored: one per (session, entity, fingerprint) without a live one yet, and one per
    (session, replacement). Of several the least replacement, then the least id, stays. Expired rows count as absent."""
    alive = live(mappings, now)
    one = W.partitionBy("session_id", "entity_type", "original_hmac").orderBy("replacement", "id")
    first = offered.withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r")
    fresh = first.join(alive, ["session_id", "entity_type", "original_hmac"], "left_anti").join(alive, ["session_id", "replacement"], "left_anti")
    by_surface = W.partitionBy("session_id", "replacement").orderBy("entity_type", "original_hmac", "id")
    return fresh.withColumn("_r", F.row_number().over(by_surface)).where("_r = 1").drop("_r").select(*offered.columns)


def session_summary(detections: DataFrame, now: int, session: str | None = None, by_session: bool = False) -> DataFrame:
    """Live detections counted by entity, detector, action and policy (and session), with the least and most confidence."""
    rows = live(detections, now)
    keys = [*(["session_id"] if by_session else []), "entity_type", "detector", "action", "policy_name", "policy_version"]
    rows = rows.where(F.col("session_id") == session) if session else rows
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("confidence_ppm").alias("least_ppm"), F.max("confidence_ppm").alias("most_ppm"))


def purge_counts(tables: Mapping[str, DataFrame], now: int) -> DataFrame:
    """A row per table: its expired rows. Rows that only go with their session aren't counted."""
    out = None
    for name in PURGE_ORDER:
        if name in tables:
            one = tables[name].agg(F.count(F.when(F.col("expires_at") <= now, 1)).alias("purged")).select(F.lit(name).alias("table"), "purged")
            out = one if out is None else out.union(one)
    return out


def purge(tables: Mapping[str, DataFrame], now: int) -> dict[str, DataFrame]:
    """The tables without expired rows; mappings and detections of expired sessions go too, audit events lose their session."""
    gone = tables["sessions"].where(F.col("expires_at") <= now).select(F.col("id").alias("session_id"))
    return _without({k: live(v, now) for k, v in tables.items()}, gone)


def delete_session(tables: Mapping[str, DataFrame], session: str) -> dict[str, DataFrame]:
    gone = tables["sessions"].where(F.col("id") == session).select(F.col("id").alias("session_id"))
    return _without(tables, gone)


def _without(tables: Mapping[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    kept = {"sessions": tables["sessions"].join(gone, F.col("id") == gone["session_id"], "left_anti")}
    for name in ("mappings", "detections"):
        kept[name] = tables[name].join(gone, "session_id", "left_anti")
    maps = kept["mappings"].select(F.col("id").alias("_mid"))
    kept["detections"] = kept["detections"].join(maps, F.col("mapping_id") == F.col("_mid"), "left").withColumn("mapping_id", F.col("_mid")).drop("_mid")
    marked = tables["audit_events"].join(gone.withColumn("_gone", F.lit(True)), "session_id", "left")
    kept["audit_events"] = marked.withColumn("session_id", F.when(F.col("_gone"), None).otherwise(F.col("session_id"))).drop("_gone").select(*tables["audit_events"].columns)
    return kept


def fingerprint(key: bytes, session: Column, entity: Column, value: Column) -> Column:
    """What a value is found by again without being stored in clear: a keyed hash that differs from session to session."""
    return hmac_sha256(key, joined_with_nul("mapping-match", session, entity, value))


def source_digest(key: bytes, text: Column) -> Column:
    """A keyed hash of a whole source text."""
    return hmac_sha256(key, joined_with_nul("source", text))


def _sealed(value: Column, key: bytes, context: Column) -> Column:
    return F.aes_encrypt(value.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), context)


def _opened(sealed: Column, key: bytes, context: Column) -> Column:
    return F.try_aes_decrypt(sealed, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), context).cast("string")


def canonical_json(detail: Column) -> Column:
    """A flat map as JSON with its keys in order and no blanks."""
    entries = F.array_sort(F.map_entries(detail))
    quoted = lambda t: F.substring(F.to_json(F.array(t)), F.lit(2), F.length(F.to_json(F.array(t))) - 2)
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), quoted(e["value"]))), ","), F.lit("}"))


def session_rows(requests: DataFrame, policy: Policy, now: int, key: bytes | None = None, ttl: int | None = None) -> DataFrame:
    """Rows of `sessions` for requests (id, metadata: map or absent). Metadata is sealed, bound to the session, and needs the key.
    Sessions live as long as the longer of the policy's retentions unless `ttl` says otherwise."""
    sealed = F.lit(None).cast("binary")
    if "metadata" in requests.columns:
        if key is None:
            raise ValueError("session metadata needs a key")
        filled = F.coalesce(F.size("metadata"), F.lit(0)) > 0
        sealed = F.when(filled, _sealed(canonical_json(F.col("metadata")), key, F.concat(F.lit("session-metadata:"), "id")))
    lives = ttl or max(policy.mapping_retention_seconds, policy.audit_retention_seconds)
    return requests.select("id", F.lit(policy.to_json()).alias("policy_json"), sealed.alias("metadata_encrypted"), F.lit(now).cast("long").alias("created_at"), F.lit(now + lives).cast("long").alias("expires_at"))


def detection_rows(applied: DataFrame, policy: Policy | None, key: bytes, now: int) -> DataFrame:
    """Rows of `detections` for accepted spans (session_id, text or source_hash, entity, detector, confidence_ppm, action, start, end,
    mapping_id; without a policy also policy_name, policy_version and audit_retention)."""
    if policy is not None:
        applied = applied.withColumns({"policy_name": F.lit(policy.name), "policy_version": F.lit(policy.version), "audit_retention": F.lit(policy.audit_retention_seconds)})
    hashed = F.col("source_hash") if "source_hash" in applied.columns else source_digest(key, F.col("text"))
    return applied.select(
        F.uuid().alias("id"), "session_id", "mapping_id", F.col("entity").alias("entity_type"), "detector", "confidence_ppm", "action", "policy_name", "policy_version",
        hashed.alias("source_hash"), F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), F.lit(now).cast("long").alias("created_at"), (F.lit(now) + F.col("audit_retention")).cast("long").alias("expires_at"),
    )


def audit_rows(events: DataFrame, now: int, retention: int | Column = 30 * DAY) -> DataFrame:
    """Rows of `audit_events` for (session_id, event_type, outcome, detail): a map as canonical JSON, or JSON as it is."""
    detail = F.col("detail") if dict(events.dtypes)["detail"] == "string" else canonical_json(F.col("detail"))
    until = F.lit(now) + (F.lit(retention) if isinstance(retention, int) else retention)
    return events.select(F.uuid().alias("id"), "session_id", "event_type", "outcome", detail.alias("detail_json"), F.lit(now).cast("long").alias("created_at"), until.cast("long").alias("expires_at"))


def _columns(name: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[name].split(", ")]


def reverse_mappings(sessions: DataFrame, mappings: DataFrame, key: bytes, now: int) -> DataFrame:
    """(session_id, entity, value, replacement) of the live mappings of live sessions, originals opened; those that another key
    sealed, or that were moved, are left out."""
    alive = live(sessions, now).select(F.col("id").alias("session_id"))
    value = _opened(F.col("original_encrypted"), key, F.concat_ws(":", F.lit("mapping"), "session_id", "id"))
    own = live(mappings, now).join(alive, "session_id", "left_semi")
    return own.select("session_id", F.col("entity_type").alias("entity"), value.alias("value"), "replacement").where("value is not null")


class MappingCollision(Exception):
    """A replacement already stands for another value of the session."""


class Conflict(RuntimeError):
    """Another writer changed the vault in between."""


#: From mappings as stored to rows of other tables that go into the same commit.
Also = Callable[[DataFrame], Mapping[str, DataFrame]]


class Vault:
    """What both kinds of vault do with their tables. Subclasses read, append several tables in one commit, and erase.

    Values are found by their fingerprints. Nothing of a session is opened for another one, and what is checkpointed on the way
    holds fingerprints, replacements and sealed originals only.
    """

    spark: SparkSession

    def read(self, name: str) -> DataFrame:
        raise NotImplementedError

    def mark(self) -> object:
        """What `append_all` compares to see whether mappings were added since."""
        raise NotImplementedError

    def append_all(self, tables: Mapping[str, DataFrame], unchanged: object = None) -> None:
        """Adds rows to several tables: all of them or none. With `unchanged` (of `mark`) raises Conflict if mappings were added."""
        raise NotImplementedError

    def purge(self, now: int) -> dict[str, int]:
        """Erases what has expired, with what hangs on it; the numbers of expired rows by table."""
        raise NotImplementedError

    def delete(self, session: str) -> bool:
        """Erases a session with its mappings and detections, and its name from audit events; whether there was one."""
        raise NotImplementedError

    def append(self, name: str, rows: DataFrame) -> None:
        self.append_all({name: rows})

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.read(n) for n in SCHEMAS}

    def create_session(self, policy: Policy, now: int, metadata: Mapping[str, str] | None = None, key: bytes | None = None, ttl: int | None = None) -> str:
        session = str(uuid.uuid4())
        requests = self.spark.createDataFrame([(session, dict(metadata))], "id string, metadata map<string,string>") if metadata else self.spark.createDataFrame([(session,)], "id string")
        self.append("sessions", session_rows(requests, policy, now, key, ttl))
        return session

    def policy_for(self, session: str, now: int) -> Policy:
        """A live session's policy. An expired one is deleted with all that hangs on it; then, and for unknown ones, KeyError."""
        row = self.read("sessions").where(F.col("id") == session).first()
        if row is not None and row["expires_at"] > now:
            return Policy.from_json(row["policy_json"])
        if row is not None:
            self.delete(session)
        raise KeyError(f"unknown or expired session: {session}")

    def summary(self, session: str, now: int) -> DataFrame:
        """`session_summary` of a live session; KeyError for others."""
        self.policy_for(session, now)
        return session_summary(self.read("detections"), now, session)

    def find(self, requests: DataFrame, key: bytes, now: int) -> DataFrame:
        """`requests` (session_id, entity, value) with the mapping_id and replacement of the value's live mapping, or nulls."""
        asked = requests.withColumns({"entity_type": F.col("entity"), "original_hmac": fingerprint(key, F.col("session_id"), F.col("entity"), F.col("value"))})
        return find_mappings(asked, self.read("mappings"), now).select(*requests.columns, "mapping_id", "replacement")

    def store_mappings(self, made: DataFrame, policy: Policy, action: str, key: bytes, now: int, also: Also | None = None) -> DataFrame:
        """`store` for (session_id, entity, value, replacement) under one policy's retention."""
        return self.store(made.withColumns({"action": F.lit(action), "mapping_retention": F.lit(policy.mapping_retention_seconds)}), key, now, also)

    def store(self, made: DataFrame, key: bytes, now: int, also: Also | None = None) -> DataFrame:
        """Stores mappings for (session_id, entity, value, replacement, action, mapping_retention) and gives (session_id, entity_type,
        original_hmac, mapping_id, replacement): the one stored, or the live one that its value has already. `also` makes rows of
        other tables from those; all go into one commit. Raises MappingCollision where a replacement is another value's,
        Conflict where mappings were added meanwhile."""
        mark, on = self.mark(), ["session_id", "entity_type", "original_hmac"]
        known = live(self.read("mappings"), now)
        hashed = made.select("session_id", F.col("entity").alias("entity_type"), fingerprint(key, F.col("session_id"), F.col("entity"), F.col("value")).alias("original_hmac"), "value", "replacement", "action", "mapping_retention")
        offered = hashed.groupBy(*on).agg(F.min("replacement").alias("offered")).withColumn("id", F.uuid())
        placed = find_mappings(offered, known, now).select(*on, F.coalesce("mapping_id", "id").alias("mapping_id"), F.coalesce("replacement", "offered").alias("replacement"), F.col("mapping_id").isNull().alias("fresh")).checkpoint()
        fresh = placed.where("fresh")
        twice = fresh.groupBy("session_id", "replacement").count().where("count > 1").select("session_id", "replacement")
        if not fresh.join(known, ["session_id", "replacement"], "left_semi").select("session_id", "replacement").union(twice).isEmpty():
            raise MappingCollision("a replacement is taken by another value")
        values = hashed.select(*on, "value", "action", "mapping_retention").dropDuplicates(on)
        rows = values.join(fresh, on).select(
            F.col("mapping_id").alias("id"), *on, _sealed(F.col("value"), key, F.concat_ws(":", F.lit("mapping"), "session_id", "mapping_id")).alias("original_encrypted"), "replacement",
            "action", F.lit(now).cast("long").alias("created_at"), (F.lit(now) + F.col("mapping_retention")).cast("long").alias("expires_at"),
        )
        placed = placed.drop("fresh")
        self.append_all({"mappings": rows} | dict(also(placed) if also else {}), mark)
        return placed

    def allocate(self, spans: DataFrame, policy: Policy | None, key: bytes, now: int, also: Also | None = None) -> DataFrame:
        """Mappings (session_id, entity, value, replacement, mapping_id) for the reversible values of a span table, and of no others,
        stored before they are given: live ones are used again, new ones are drawn. Up to `MOST_TRIES` times where a draw
        collides or another writer was first; then Blocked. Without a policy all spans are reversible, and carry their action
        and mapping_retention."""
        if policy is not None:
            rules = [e for e, r in policy.active().items() if r.reversible]
            spans = spans.where(F.col("entity").isin(*rules)).withColumns({"action": protect.action_of(policy, F.col("entity")), "mapping_retention": F.lit(policy.mapping_retention_seconds)})
        values = spans.select("session_id", "entity", "value", "action", "mapping_retention").distinct()
        for _ in range(MOST_TRIES):
            try:
                placed = self.store(protect.with_replacements(values, key), key, now, also)
            except (MappingCollision, Conflict):
                continue
            mine = values.withColumns({"entity_type": F.col("entity"), "original_hmac": fingerprint(key, F.col("session_id"), F.col("entity"), F.col("value"))})
            return mine.join(placed, ["session_id", "entity_type", "original_hmac"]).select("session_id", "entity", "value", "replacement", "mapping_id")
        raise Blocked("no free replacement was found")

    def restore(self, df: DataFrame, text: str, key: bytes, now: int, row: str, into: str = "restored") -> DataFrame:
        """`df` (session_id, ...) with its texts restored from live mappings of their live sessions. Before anything is shown, an
        audit event with the keyed hash of its text is stored for each row of a live session.

        Mappings are joined by the tokens in a row's text first; only what they hit is opened, and only when the result is read.
        """
        sessions = live(self.read("sessions"), now).select(F.col("id").alias("session_id"), F.get_json_object("policy_json", "$.audit_retention_seconds").cast("long").alias("_keep"))
        mappings = live(self.read("mappings"), now).join(sessions, "session_id", "left_semi")
        known = mappings.select("session_id", "replacement", F.concat_ws(":", F.lit("mapping"), "session_id", "id").alias("_context"), F.col("original_encrypted").alias("_sealed"))
        hits = restore.token_pairs(df, text, known, row=row, columns=["_context", "_sealed"]).checkpoint()
        pairs = hits.select(row, "replacement", _opened(F.col("_sealed"), key, F.col("_context")).alias("value")).where("value is not null")
        hashed = hmac_sha256(key, joined_with_nul("restore", F.coalesce(F.col(text), F.lit(""))))
        events = df.select("session_id", hashed.alias("_h")).join(sessions, "session_id").select("session_id", F.lit("restore").alias("event_type"), F.lit("restored").alias("outcome"), F.to_json(F.struct(F.col("_h").alias("input_hash"))).alias("detail"), "_keep")
        self.append("audit_events", audit_rows(events, now, F.coalesce("_keep", F.lit(DAY * 30))))
        return restore.with_pairs(df, text, pairs, row=row, into=into)


class VaultStore(Vault):
    """The four tables in a folder. A table is the list of parts that the newest manifest names, each with its earliest and
    latest expiry.

    A change of several tables writes all new parts first and then one manifest, so readers see all of it or nothing.
    Manifests are numbered; the writer that is second to a number tries again on what the first one left. Small parts of
    one day's expiry are merged, and what merging replaces is removed `KEPT` commits later, as readers may still have it open.
    Erasing drops parts whose rows have all expired, rewrites those in which only some rows go, and then removes
    what it replaced and all older manifests at once: a reader that has those open fails rather than sees erased rows.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.folder}/_manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _load(self, number: int) -> str:
        stream = self._fs.open(self._path(f"{self.folder}/_manifests/{number:012d}.json"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _manifest(self) -> tuple[int, dict]:
        """The newest manifest's number, the parts of each table, and what waits for its removal."""
        for _ in range(MOST_TRIES):
            numbers = self._numbers()
            if not numbers:
                return 0, {"tables": {n: [] for n in SCHEMAS}, "retired": []}
            try:
                return numbers[-1], json.loads(self._load(numbers[-1]))
            except Exception:  # noqa: BLE001 - erased between the two steps: look again
                if numbers[-1] in self._numbers():
                    raise
        raise Conflict("the vault changes too fast to be read")

    def _commit(self, number: int, manifest: dict) -> None:
        """Writes a manifest that nobody else has written: by a hard link or a rename, which fail where the name is taken, or by
        a store's own creation of absent objects. What is there afterwards has to be ours."""
        body = json.dumps(manifest | {"writer": uuid.uuid4().hex}, sort_keys=True)
        target, draft = (self._path(f"{self.folder}/_manifests/{n}") for n in (f"{number:012d}.json", f".{uuid.uuid4().hex}"))
        scheme = self._fs.getUri().getScheme()
        direct = scheme not in ("file", "hdfs", "viewfs")
        try:
            if self._fs.exists(target):
                raise Conflict("another writer changed the vault")
            stream = self._fs.create(target if direct else draft, False)
            stream.write(bytearray(body.encode()))
            stream.close()
            if scheme == "file":
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            elif not direct and not self._fs.rename(draft, target):
                raise Conflict("another writer changed the vault")
        except (FileExistsError, Py4JJavaError) as e:
            if not self._fs.exists(target):
                raise
            raise Conflict("another writer changed the vault") from e
        finally:
            if not direct:
                self._fs.delete(draft, False)
        if self._load(number) != body:
            raise Conflict("another writer changed the vault")

    def _change(self, make: Callable[[dict[str, list[dict]]], dict[str, list[dict]]], written: list[dict], erase: bool = False) -> None:
        """Commits make(parts by table), tried again where another writer was first. Parts in `written` are removed if it fails."""
        try:
            for _ in range(MOST_TRIES):
                number, old = self._manifest()
                new = make({n: list(old["tables"].get(n, [])) for n in SCHEMAS})
                held = {p["path"] for ps in new.values() for p in ps}
                gone = [p["path"] for ps in old["tables"].values() for p in ps if p["path"] not in held]
                due = number + 1 if erase else number + 1 + KEPT
                waits = [[number + 1 if erase else at, p] for at, p in old["retired"] if at >= number]
                manifest = {"tables": new, "retired": waits + [[due, p] for p in gone]}
                try:
                    self._commit(number + 1, manifest)
                except Conflict:
                    continue
                written.clear()
                self._remove([p for at, p in manifest["retired"] if at <= number + 1])
                for n in self._numbers():
                    if n <= number + 1 - (1 if erase else KEPT):
                        self._fs.delete(self._path(f"{self.folder}/_manifests/{n:012d}.json"), False)
                return
            raise Conflict("other writers were always first")
        finally:
            self._remove([p["path"] for p in written])

    def _remove(self, paths: Iterable[str]) -> None:
        for p in paths:
            self._fs.delete(self._path(f"{self.folder}/{p}"), True)

    def _write(self, name: str, rows: DataFrame, written: list[dict]) -> list[dict]:
        """A new part with the rows, noted in `written`; none if there are no rows."""
        part, seen = {"path": f"{name}/p-{uuid.uuid4().hex}"}, Observation()
        written.append(part)
        counted = rows.select(*_columns(name)).observe(seen, F.count(F.lit(1)).alias("rows"), F.min("expires_at").alias("least"), F.max("expires_at").alias("most"))
        counted.write.parquet(f"{self.folder}/{part['path']}")
        part |= {"rows": 0} | seen.get
        part["bytes"] = self._fs.getContentSummary(self._path(f"{self.folder}/{part['path']}")).getLength()
        if part["rows"]:
            return [part]
        self._remove([part["path"]])
        return []

    def _frame(self, name: str, parts: Iterable[dict]) -> DataFrame:
        paths = [f"{self.folder}/{p['path']}" for p in parts]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def read(self, name: str) -> DataFrame:
        """A table as the newest manifest has it."""
        return self._frame(name, self._manifest()[1]["tables"].get(name, []))

    def mark(self) -> object:
        return self._manifest()[1]["tables"].get("mappings", [])

    def append_all(self, tables: Mapping[str, DataFrame], unchanged: object = None) -> None:
        written: list[dict] = []
        new = {name: self._write(name, rows, written) for name, rows in tables.items()}

        def make(parts: dict[str, list[dict]]) -> dict[str, list[dict]]:
            if unchanged is not None and {p["path"] for p in parts["mappings"]} - {p["path"] for p in unchanged}:
                raise Stale("mappings were added meanwhile")
            return {n: ps + new.get(n, []) for n, ps in parts.items()}

        try:
            self._change(make, written)
        except Stale as e:
            raise Conflict(str(e)) from e
        self._merge()

    def _merge(self) -> None:
        """Puts small parts of a table together where `MERGED` of them expire on one day."""
        for name, parts in self._manifest()[1]["tables"].items():
            days: dict[int, list[dict]] = {}
            for p in parts:
                if p["bytes"] < SMALL_BYTES:
                    days.setdefault(p["most"] // DAY, []).append(p)
            for small in days.values():
                if len(small) >= MERGED:
                    written: list[dict] = []
                    paths = {p["path"] for p in small}
                    whole = self._write(name, self._frame(name, small).hint("rebalance"), written)

                    def make(now: dict[str, list[dict]], name=name, paths=paths, whole=whole) -> dict[str, list[dict]]:
                        if not paths <= {p["path"] for p in now[name]}:
                            raise Stale("another writer merged them")
                        return now | {name: [p for p in now[name] if p["path"] not in paths] + whole}

                    with contextlib.suppress(Conflict, Stale):
                        self._change(make, written)

    def _holding(self, name: str, parts: list[dict], column: str, keys: DataFrame) -> set[str]:
        """The parts with rows whose `column` is in `keys` (of one column): as many as there are parts at most."""
        if not parts:
            return set()
        rows = self._frame(name, parts).select(F.col(column).alias("_key"), F.regexp_extract(F.col("_metadata.file_path"), f"{name}/p-[0-9a-f]{{32}}", 0).alias("_part"))
        return {r["_part"] for r in rows.join(keys.toDF("_key"), "_key", "left_semi").select("_part").distinct().collect()}

    def _erase(self, gone_of: Callable[[DataFrame], DataFrame], now: int | None) -> dict[str, int]:
        """Erases the sessions that gone_of(sessions) names, with what hangs on them, and what has expired at `now`."""
        written: list[dict] = []
        counts: dict[str, int] = {}

        def make(parts: dict[str, list[dict]]) -> dict[str, list[dict]]:
            self._remove([p["path"] for p in written])
            written.clear()
            alive = (lambda df: df) if now is None else (lambda df: live(df, now))
            dead = {n: [p for p in ps if now is not None and p["most"] <= now] for n, ps in parts.items()}
            mixed = {n: [p for p in ps if now is not None and p["least"] <= now < p["most"]] for n, ps in parts.items()}
            for n in parts:
                counts[n] = sum(p["rows"] for p in dead[n]) + (self._frame(n, mixed[n]).where(F.col("expires_at") <= now).count() if mixed[n] else 0)
            gone = gone_of(self._frame("sessions", parts["sessions"]))
            some = not gone.isEmpty()
            lost = self._frame("mappings", dead["mappings"] + mixed["mappings"]).where(F.col("expires_at") <= (now or 0)).select("id")
            out = {}
            for n, ps in parts.items():
                kept = [p for p in ps if p not in dead[n]]
                hit = {p["path"] for p in mixed[n]}
                if some:
                    hit |= self._holding(n, kept, "id" if n == "sessions" else "session_id", gone)
                if n == "detections" and counts["mappings"]:
                    hit |= self._holding(n, kept, "mapping_id", lost)
                rows = alive(self._frame(n, [p for p in kept if p["path"] in hit]))
                if n == "audit_events":
                    rows = rows.join(gone.toDF("_gone"), F.col("session_id") == F.col("_gone"), "left").withColumn("session_id", F.when(F.col("_gone").isNull(), F.col("session_id")))
                else:
                    rows = rows.join(gone.toDF("_gone"), F.col("id" if n == "sessions" else "session_id") == F.col("_gone"), "left_anti")
                if n == "detections":
                    rows = rows.join(lost.toDF("_lost"), F.col("mapping_id") == F.col("_lost"), "left").withColumn("mapping_id", F.when(F.col("_lost").isNull(), F.col("mapping_id")))
                out[n] = [p for p in kept if p["path"] not in hit] + (self._write(n, rows, written) if hit else [])
            return out

        self._change(make, written, erase=True)
        return counts

    def purge(self, now: int) -> dict[str, int]:
        counts = self._erase(lambda sessions: sessions.where(F.col("expires_at") <= now).select("id"), now)
        self.vacuum()
        return counts

    def delete(self, session: str) -> bool:
        if self.read("sessions").where(F.col("id") == session).isEmpty():
            return False
        self._erase(lambda sessions: self.spark.createDataFrame([(session,)], "id string"), None)
        return True

    def apply(self, tables: Mapping[str, DataFrame]) -> None:
        """Replaces whole tables; what was there is erased."""
        written: list[dict] = []
        new = {name: self._write(name, rows, written) for name, rows in tables.items()}
        self._change(lambda parts: parts | new, written, erase=True)

    def vacuum(self, seconds: int = DAY) -> int:
        """Removes parts that no manifest names and that are older than `seconds`: what writers that died have left. How many."""
        number, manifest = self._manifest()
        named = {p["path"] for ps in manifest["tables"].values() for p in ps} | {p for _, p in manifest["retired"]}
        before, found = (time.time() - seconds) * 1000, []
        for name in SCHEMAS:
            folder = self._path(f"{self.folder}/{name}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
                path = f"{name}/{s.getPath().getName()}"
                if path not in named and s.getModificationTime() <= before:
                    found.append(path)
        self._remove(found)
        return len(found)


class Stale(Exception):
    """A change no longer fits what is there; trying it again doesn't help."""


def open_vault(spark: SparkSession, target: str) -> Vault:
    """A vault by its address: a JDBC or PostgreSQL URL, or a folder."""
    from shieldframe.operators.vault_jdbc import JdbcVault

    if target.startswith(("postgres://", "postgresql://", "jdbc:")):
        return JdbcVault(spark, target)
    return VaultStore(spark, target)
