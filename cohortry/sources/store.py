"""An append-only store of resource versions on Parquet, changed by transactions.

Each transaction is one logical time t. Its commands are checked set-wise against the snapshot before it: if one fails
nothing is written. Versions live in <path>/versions (partitioned by type), transactions in <path>/transactions.

A transaction's row is written last, and names the attempt that wrote its versions: what a crash leaves behind belongs to
no transaction, and nobody sees it, even when its t is used again. There is one writer at a time."""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from cohortry.operators import snapshots
from cohortry.sources.resources import content_hash, references

VERSION = "id string, t long, op string, num_changes long, hash string, content string, attempt string, type string"
PURGE = "type string, id string, before_t long, at long, attempt string"
TRANSACTION = "t long, instant timestamp, success boolean, error string, attempt string"
COMMAND = "op string, type string, id string, content string, if_match array<long>, if_none_match string, hash string"
#: Resources that one conditional delete may take.
MAX_DELETES = 10_000
#: Versions that one deletion of a history may take.
MAX_HISTORY = 100_000


class Conflict(Exception):
    """A transaction's precondition does not hold."""


@dataclass
class Command:
    """op: create, put, keep, hold, delete, delete-history or patient-purge.

    if_match: the version (t) that the resource must have, or several. if_none_match: '*' if it must not have any version,
    or a version that it must not have. hash (keep): of the content that must still be there. if_none_exist (create):
    nothing is created if the Column matches exactly one resource of the type. where (delete): the resource of the type
    that matches; with allow_multiple all that do, MAX_DELETES at most."""

    op: str
    type: str
    id: str | None = None
    content: str | None = None
    if_match: int | tuple[int, ...] | None = None
    if_none_match: str | None = None
    if_none_exist: object = None
    where: object = None
    hash: str | None = None
    allow_multiple: bool = False


class Store:
    def __init__(self, spark: SparkSession, path: str, check_references: bool = True) -> None:
        self.spark, self.path, self.check_references = spark, path.rstrip("/"), check_references

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # anything else is no empty store
                raise
            # Empty to Catalyst too, so that a join with it is none: rows made in Python have no known size, and shuffle the other side.
            none = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)]
            return self.spark.range(1).select(*none).where(F.lit(False))

    def _committed(self, df: DataFrame, t: str) -> DataFrame:
        done = self.transactions().where("success").select(F.col("t").alias("__t"), F.col("attempt").alias("__a"))
        return df.join(done, (F.col(t) == F.col("__t")) & (F.col("attempt") == F.col("__a")), "left_semi").drop("attempt")

    def versions(self) -> DataFrame:
        """All versions of successful transactions; purges are applied as marks."""
        v = self._committed(self._read("versions", VERSION), "t")
        purges = self._committed(self._read("purges", PURGE), "at")
        marks = purges.groupBy("type", "id").agg(F.max("before_t").alias("before_t"), F.max("at").alias("at"))
        out = v.join(marks, ["type", "id"], "left").withColumn("purged_at", F.when(F.col("t") < F.col("before_t"), F.col("at")))
        return out.select("type", "id", "t", "op", "num_changes", "hash", "purged_at", "content")

    def changes(self, t: int) -> DataFrame:
        """The versions that a transaction made."""
        return snapshots.changes(self.versions(), t)

    def sync(self, t: int, timeout: float = 10.0, every: float = 0.1) -> DataFrame:
        """The snapshot of t, once its transaction is known."""
        until = time.monotonic() + timeout
        while self.basis_t() < t:
            if time.monotonic() > until:
                raise TimeoutError(f"t {t} has not been reached")
            time.sleep(every)
        return self.as_of(t)

    def read(self, type_: str, id_: str, t: int | None = None) -> DataFrame:
        """The newest version of a resource not later than t; no row if it is deleted or unknown."""
        return snapshots.snapshot(self.versions().where((F.col("type") == type_) & (F.col("id") == id_)), t)

    def vread(self, type_: str, id_: str, t: int) -> DataFrame:
        """The version that was made at t."""
        return snapshots.window(self.versions()).where((F.col("type") == type_) & (F.col("id") == id_) & (F.col("t") == t))

    def transactions(self) -> DataFrame:
        return self._read("transactions", TRANSACTION)

    def basis_t(self) -> int:
        return self.transactions().agg(F.coalesce(F.max("t"), F.lit(0))).first()[0]

    def as_of(self, t: int | None = None, since: int | None = None) -> DataFrame:
        return snapshots.snapshot(self.versions(), t, since)

    def t_at(self, instant) -> int:
        """The newest t not after an instant."""
        return self.transactions().where(F.col("success") & (F.col("instant") <= F.lit(instant))).agg(F.coalesce(F.max("t"), F.lit(0))).first()[0]

    def history(self, type_: str | None = None, id_: str | None = None, t: int | None = None, since: int | None = None) -> DataFrame:
        return snapshots.history(self.versions(), type_, id_, t, since)

    def totals(self, t: int | None = None) -> DataFrame:
        return snapshots.totals(self.versions(), t)

    def _expand(self, now: DataFrame, commands: list[Command]) -> tuple[list[Command], list[Command]]:
        """Conditional commands become plain ones; purges are returned apart."""
        plain, purges = [], []
        for c in commands:
            of_type = now.where(F.col("type") == c.type)
            if c.op == "create" and c.if_none_exist is not None:
                found = of_type.where(c.if_none_exist).limit(2).count()
                if found > 1:
                    raise Conflict(f"conditional create of {c.type} matches several resources")
                if found == 0:
                    plain.append(c)
            elif c.op == "delete" and c.where is not None:
                most = MAX_DELETES if c.allow_multiple else 1
                found = [r[0] for r in of_type.where(c.where).select("id").limit(most + 1).collect()]
                if len(found) > most:
                    raise Conflict(f"conditional delete of {c.type} matches " + (f"more than {most} resources" if c.allow_multiple else "several resources"))
                plain += [Command("delete", c.type, i) for i in found]
            elif c.op in ("delete-history", "patient-purge"):
                purges.append(c)
            else:
                plain.append(c)
        return plain, purges

    def _verified(self, commands: DataFrame) -> DataFrame:
        """commands with `cur`, the newest version of their resource (deleted ones too), and the `reason` why they conflict.

        Only versions of the commands' resources are aggregated, without their contents."""
        keys = commands.select("type", "id")
        rows = snapshots.window(self.versions().join(keys, ["type", "id"], "left_semi"))
        state = rows.groupBy("type", "id").agg(F.max_by(F.struct("t", "op", "hash", "num_changes"), "t").alias("cur"))
        j = commands.join(state, ["type", "id"], "left")
        name, known = F.concat_ws("/", "type", "id"), F.col("cur").isNotNull()
        yes = lambda c: F.coalesce(c, F.lit(False))
        alive = yes(F.col("cur.op") != "delete")
        reason = (
            F.when((F.col("op") == "create") & known, F.concat(name, F.lit(" exists")))  # deleted ones too: their ids are taken
            .when(F.col("if_match").isNotNull() & ~yes(F.array_contains("if_match", F.col("cur.t"))), F.concat(name, F.lit(" is not at version "), F.array_join(F.col("if_match").cast("array<string>"), ", ")))
            .when(known & yes((F.col("if_none_match") == "*") | (F.col("if_none_match") == F.col("cur.t").cast("string"))), F.concat(name, F.lit(" is at a version it must not have")))
            .when((F.col("op") == "keep") & ~(alive & yes(F.col("cur.hash") == F.col("hash"))), F.concat(name, F.lit(" is not what should be kept")))
        )
        return j.withColumn("alive", alive).withColumn("reason", reason)

    def apply(self, commands: DataFrame, instant) -> int:
        """Apply a table of commands (op, type, id, content; if_match, if_none_match and hash where needed) as one transaction;
        gives its t. Checks are joins and aggregations: the commands can be many."""
        for field in StructType.fromDDL(COMMAND):
            if field.name not in commands.columns:
                commands = commands.withColumn(field.name, F.lit(None).cast(field.dataType))
        return self._run(commands, [], self.as_of(), instant)

    def transact(self, commands: list[Command], instant) -> int:
        """Apply commands as one transaction; gives its t. This list fits the driver (a bundle)."""
        now = self.as_of()
        try:
            plain, purges = self._expand(now, commands)
        except Conflict as e:
            self._log(self.basis_t() + 1, instant, False, str(e), uuid.uuid4().hex)
            raise
        rows = [(c.op, c.type, c.id, c.content, [c.if_match] if isinstance(c.if_match, int) else c.if_match, c.if_none_match, c.hash) for c in plain]
        return self._run(self.spark.createDataFrame(rows, COMMAND), purges, now, instant)

    def _run(self, commands: DataFrame, purges: list[Command], now: DataFrame, instant) -> int:
        t, attempt = self.basis_t() + 1, uuid.uuid4().hex
        # Commands are evaluated once, and spread by what all checks join and group by.
        commands = commands.repartition("type", "id").persist()
        checked = self._verified(commands).persist()
        try:
            twice = commands.groupBy("type", "id").count().where("count > 1").orderBy("type", "id").limit(1).collect()
            if twice:
                raise Conflict(f"duplicate resource in a transaction: {twice[0]['type']}/{twice[0]['id']}")
            bad = checked.where("reason is not null").orderBy("type", "id").select("reason").limit(1).collect()
            if bad:
                raise Conflict(bad[0][0])
            commands.unpersist()  # all of checked is there by now
            # A put of what is there already makes no version, and nothing is deleted twice.
            digest = F.when(F.col("op") != "delete", content_hash(F.col("content")))
            gone = (F.col("op") == "delete") & (F.col("alive") | F.col("cur").isNull())
            put = (F.col("op") == "create") | (F.col("op") == "put") & ~(F.col("alive") & digest.eqNullSafe(F.col("cur.hash")))
            fresh = checked.where(gone | put).select(
                "id", F.lit(t).cast("long").alias("t"), "op", (F.coalesce("cur.num_changes", F.lit(0)) + 1).cast("long").alias("num_changes"), digest.alias("hash"),
                F.when(F.col("op") != "delete", F.col("content")).alias("content"), F.lit(attempt).alias("attempt"), "type",
            )
            if self.check_references:
                self._check(fresh)
            marks = [self._purge(c, t, now, attempt) for c in purges]
            fresh.write.mode("append").partitionBy("type").parquet(f"{self.path}/versions")
            for m in marks:
                m.write.mode("append").parquet(f"{self.path}/purges")
        except Conflict as e:
            self._log(t, instant, False, str(e), attempt)
            raise
        finally:
            commands.unpersist()
            checked.unpersist()
        self._log(t, instant, True, None, attempt)
        return t

    def _log(self, t: int, instant, success: bool, error: str | None, attempt: str) -> None:
        self.spark.createDataFrame([(t, instant, success, error, attempt)], TRANSACTION).coalesce(1).write.mode("append").parquet(f"{self.path}/transactions")

    def apply_bundle(self, bundle: str | dict, instant) -> int:
        """A transaction bundle: PUT, POST (create) and DELETE entries as one t."""
        data = json.loads(bundle) if isinstance(bundle, str) else bundle
        commands = []
        for e in data.get("entry", []):
            request, resource = e.get("request", {}), e.get("resource")
            method = request.get("method", "PUT")
            if method == "DELETE":
                type_, id_ = request["url"].split("/")
                commands.append(Command("delete", type_, id_))
                continue
            match = request.get("ifMatch")
            content = json.dumps(resource, sort_keys=True, separators=(",", ":"))
            commands.append(Command("create" if method == "POST" else "put", resource["resourceType"], resource["id"], content, int(re.sub(r"\D", "", match)) if match else None, request.get("ifNoneMatch")))
        return self.transact(commands, instant)

    def apply_batch(self, bundle: str | dict, instant) -> list[str | int]:
        """A batch bundle: every entry is a transaction of its own; the outcome is its t or the reason why it failed."""
        data = json.loads(bundle) if isinstance(bundle, str) else bundle
        out: list[str | int] = []
        for e in data.get("entry", []):
            try:
                out.append(self.apply_bundle({"entry": [e]}, instant))
            except Conflict as x:
                out.append(str(x))
        return out

    def _check(self, fresh: DataFrame) -> None:
        """Referential integrity once fresh versions are written. What no reference asks for is neither read nor joined,
        and references are taken from contents where they are read: contents are not shuffled."""
        versions = snapshots.window(self.versions())
        new, made, gone = fresh.select("type", "id"), fresh.where("op <> 'delete'"), fresh.where("op = 'delete'").select("type", "id")
        refs = references(made).select("ref_type", "ref_id").distinct()
        if not refs.isEmpty():
            targets = refs.withColumnsRenamed({"ref_type": "type", "ref_id": "id"})
            kept = snapshots.snapshot(versions.select("type", "id", "t", "op").join(targets, ["type", "id"], "left_semi")).join(new, ["type", "id"], "left_anti")
            missing = snapshots.dangling_references(refs, kept.select("type", "id").union(made.select("type", "id"))).limit(1).collect()
            if missing:
                raise Conflict(f"referential integrity: {missing[0]['ref_type']}/{missing[0]['ref_id']} does not exist")
        if gone.isEmpty():
            return
        # Versions that refer to what goes; they count if they are the newest of a resource that stays as it is.
        held = references(versions.where("op <> 'delete'"), "t").join(gone.withColumnsRenamed({"type": "ref_type", "id": "ref_id"}), ["ref_type", "ref_id"], "left_semi").join(new, ["type", "id"], "left_anti")
        if held.isEmpty():
            return
        newest = versions.join(held.select("type", "id"), ["type", "id"], "left_semi").groupBy("type", "id").agg(F.max("t").alias("t"))
        first = held.join(newest, ["type", "id", "t"], "left_semi").limit(1).collect()
        if first:
            raise Conflict(f"referential integrity: {first[0]['ref_type']}/{first[0]['ref_id']} is referenced")

    def _purge(self, c: Command, t: int, now: DataFrame, attempt: str) -> DataFrame:
        """Marks: older versions of a resource (delete-history), or all versions of a patient's compartment."""
        if c.op == "delete-history":
            newest, n = snapshots.window(self.versions().where((F.col("type") == c.type) & (F.col("id") == c.id))).agg(F.max("t"), F.count(F.lit(1))).first()
            if n > MAX_HISTORY:
                raise Conflict(f"{c.type}/{c.id} has more than {MAX_HISTORY} versions")
            marks = self.spark.createDataFrame([(c.type, c.id, newest or 0, t)], "type string, id string, before_t long, at long")
        else:
            own = self.spark.createDataFrame([("Patient", c.id)], "type string, id string")
            members = references(now).where((F.col("ref_type") == "Patient") & (F.col("ref_id") == c.id)).select("type", "id")
            marks = own.union(members).distinct().withColumn("before_t", F.lit(t)).withColumn("at", F.lit(t))
        return marks.select("type", "id", F.col("before_t").cast("long"), F.col("at").cast("long"), F.lit(attempt).alias("attempt"))
