"""The vault's tables in a database: rows are staged by Spark's JDBC writer, and moved, purged or deleted by statements in one
transaction, so that a failure in between changes nothing."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from shieldframe.operators.vault import PURGE_ORDER, SCHEMAS, Conflict, Vault, _columns

#: Column types by the types of SCHEMAS, where keys need a length; policies and details are long texts.
_LONG = ("policy_json", "detail_json")
_KEYS = {
    "sessions": "PRIMARY KEY (id)",
    "mappings": "PRIMARY KEY (id), UNIQUE (session_id, entity_type, original_hmac), UNIQUE (session_id, replacement), FOREIGN KEY (session_id) REFERENCES sessions (id) ON DELETE CASCADE",
    "detections": "PRIMARY KEY (id), FOREIGN KEY (session_id) REFERENCES sessions (id) ON DELETE CASCADE",
    "audit_events": "PRIMARY KEY (id), FOREIGN KEY (session_id) REFERENCES sessions (id) ON DELETE SET NULL",
}
#: Not a foreign key, as some databases allow no second way of deletion from a session to its detections.
_UNLINK = "UPDATE detections SET mapping_id = NULL WHERE mapping_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mappings m WHERE m.id = detections.mapping_id)"
_REQUIRED = ("id", "entity_type", "original_hmac", "replacement", "expires_at")


class JdbcVault(Vault):
    """The tables in PostgreSQL or any database with a JDBC driver on the class path, with its own keys and cascades."""

    def __init__(self, spark: SparkSession, url: str, **options: str):
        self.spark, self.options = spark, options
        self.url = url if url.startswith("jdbc:") else "jdbc:postgresql://" + url.split("://", 1)[1]
        self.binary = "BYTEA" if self.url.startswith("jdbc:postgresql:") else "BLOB"

    def _types(self, name: str) -> list[tuple[str, str]]:
        kinds = {"long": "BIGINT", "int": "INTEGER", "binary": self.binary}
        parts = [c.split() for c in SCHEMAS[name].split(", ")]
        return [(c, ("VARCHAR(32000)" if c in _LONG else "VARCHAR(512)") if t == "string" else kinds[t]) for c, t in parts]

    def create(self) -> None:
        """Makes the four tables with their keys; an error if one is there."""
        made = []
        for name in reversed(PURGE_ORDER):
            columns = ", ".join(f"{c} {t}{' NOT NULL' if c in _REQUIRED or (c == 'session_id' and name in ('mappings', 'detections')) else ''}" for c, t in self._types(name))
            made.append((f"CREATE TABLE {name} ({columns}, {_KEYS[name]})", ()))
        self._transaction(lambda run: [run(*m) for m in made])

    def _transaction(self, work: Callable[[Callable[..., int]], object]) -> object:
        """work(run), where run(statement, values) gives the number of rows: committed if it returns, rolled back if it raises."""
        properties = self.spark._jvm.java.util.Properties()
        for k, v in self.options.items():
            properties.setProperty(k, v)
        connection = self.spark._jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            connection.setAutoCommit(False)

            def run(statement: str, values: tuple = ()) -> int:
                prepared = connection.prepareStatement(statement)
                try:
                    for i, v in enumerate(values):
                        prepared.setObject(i + 1, v)
                    return prepared.executeUpdate()
                finally:
                    prepared.close()

            out = work(run)
            connection.commit()
            return out
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def _drop(self, table: str) -> None:
        with contextlib.suppress(Py4JJavaError):
            self._transaction(lambda run: run(f"DROP TABLE {table}"))

    def read(self, name: str) -> DataFrame:
        columns = _columns(name)
        rows = self.spark.read.format("jdbc").options(url=self.url, dbtable=name, **self.options).load()
        return rows.toDF(*(c.lower() for c in rows.columns)).select(*columns)

    def mark(self) -> object:
        return None  # the database's unique keys say whether mappings were added meanwhile

    def append_all(self, tables: Mapping[str, DataFrame], unchanged: object = None) -> None:
        """Rows are staged in tables of their own first. Expired mappings give way to new ones of their keys. A key that is
        taken rolls everything back and raises Conflict."""
        staged = {n: f"stage_{n}_{uuid.uuid4().hex[:12]}" for n in reversed(PURGE_ORDER) if n in tables}
        try:
            for name, stage in staged.items():
                types = ", ".join(f"{c} {t}" for c, t in self._types(name))
                self._transaction(lambda run, stage=stage, types=types: run(f"CREATE TABLE {stage} ({types})"))
                rows = tables[name].select(*_columns(name))
                rows.write.format("jdbc").options(url=self.url, dbtable=stage, **self.options).mode("append").save()

            def move(run: Callable[..., int]) -> None:
                if "mappings" in staged:
                    same = "(s.entity_type = mappings.entity_type AND s.original_hmac = mappings.original_hmac) OR s.replacement = mappings.replacement"
                    run(f"DELETE FROM mappings WHERE EXISTS (SELECT 1 FROM {staged['mappings']} s WHERE s.session_id = mappings.session_id AND s.created_at >= mappings.expires_at AND ({same}))")
                    run(_UNLINK)
                for name, stage in staged.items():
                    columns = ", ".join(_columns(name))
                    run(f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {stage}")

            try:
                self._transaction(move)
            except Py4JJavaError as e:
                cause = e.java_exception
                if str(cause.getSQLState() if hasattr(cause, "getSQLState") else "").startswith("23505"):
                    raise Conflict("a key of the rows is taken") from e
                raise
        finally:
            for stage in staged.values():
                self._drop(stage)

    def purge(self, now: int) -> dict[str, int]:
        def work(run: Callable[..., int]) -> dict[str, int]:
            counts = {name: run(f"DELETE FROM {name} WHERE expires_at <= ?", (now,)) for name in PURGE_ORDER}
            run(_UNLINK)
            return counts

        return self._transaction(work)

    def delete(self, session: str) -> bool:
        return self._transaction(lambda run: run("DELETE FROM sessions WHERE id = ?", (session,))) == 1
