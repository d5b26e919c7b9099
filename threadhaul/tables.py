"""The three tables of an export: creation, version, reset, and their merges.

Tables are plain Parquet in the session's catalog. An export only ever appends
messages and progress. Whatever changes rows (roster upserts, updates, deletes,
compaction) writes a new folder and commits it to the table's log of versions, so readers see the old or
the new version whole. Appends are committed there too, so that a rewriting that has not seen them starts again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas as S
from .operators.dedupe import dedupe_first_wins
from .operators.membership import BLOCKS, KEYS_PER_BLOCK, Membership, known_keys
from .operators.merge import dml_delete_by_key, dml_update_by_key, merge_insert_only, merge_upsert
from .operators.statistics import ColumnStatistics, estimated_anti_join
from .operators.worklist import progress_commit
from .plans.messages import MESSAGE_ORDER
from .runtime import drop_folder, scratch, stored
from .settings import ExportSettings
from .sources.roster import ROSTER_ORDER
from .versions import Version, VersionLog, WriteConflict

TABLES = {
    S.ROSTER_TABLE: S.ROSTER,
    S.PROGRESS_TABLE: S.PROGRESS,
    S.MESSAGE_TABLE: S.MESSAGE,
}

_VERSION = "schema_version"
_MEMBERSHIP, _BLOCKS = "membership_location", "membership_blocks"

# Columns that statistics are kept of.
_COUNTED = {
    S.ROSTER_TABLE: S.ROSTER_KEY,
    S.MESSAGE_TABLE: [*S.MESSAGE_KEY, "createdDateTime", "lastModifiedDateTime", "folderDate"],
}

# How often a change is made again because of other writers.
_TRIES = 5


class SchemaVersionError(RuntimeError):
    """The stored tables do not have the version this code works with."""


class ChatStore:
    """The tables of one database."""

    def __init__(self, spark: SparkSession, settings: ExportSettings):
        self.spark = spark
        self.settings = settings

    # --- administration

    def name(self, table: str) -> str:
        return f"`{self.settings.database}`.`{table}`"

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.settings.database}.{table}")

    def _database_location(self) -> str:
        return self.spark.catalog.getDatabase(self.settings.database).locationUri.rstrip("/")

    def _new_location(self, table: str) -> str:
        return f"{self._database_location()}/{table}-{uuid.uuid4().hex}"

    def _create(self, name: str, schema: T.StructType, location: str, clustering: str = "") -> None:
        columns = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}"
            for f in schema.fields
        )
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name(name)} ({columns}) USING parquet"
            f" {clustering} LOCATION '{location}'"
        )

    def ensure_tables(self) -> None:
        """Create the database and the tables that are missing.

        Messages are bucketed by their key: the merge then reads the keys it
        has to compare with in place, without shuffling the table. All three
        columns take part, so that a large mailbox spreads over the buckets.
        """
        place = self.settings.database_location
        at = f" LOCATION '{place}'" if place else ""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.settings.database}`{at}")
        for table, schema in TABLES.items():
            if self.exists(table):
                continue
            self._create(table, schema, self._new_location(table), self._clustering(table))
            if table == S.MESSAGE_TABLE:
                self._new_membership(BLOCKS).create()

    def _new_membership(self, blocks: int) -> Membership:
        """A membership filter of the messages in a folder of its own, which the table is then asked by."""
        place = f"{self._database_location()}/membership-{uuid.uuid4().hex}"
        self.spark.sql(
            f"ALTER TABLE {self.name(S.MESSAGE_TABLE)} SET TBLPROPERTIES ('{_MEMBERSHIP}' = '{place}', '{_BLOCKS}' = '{blocks}')"
        )
        return Membership(self.spark, place, tuple(S.MESSAGE_KEY), self._buckets(), blocks)

    def membership(self) -> Membership | None:
        """The filter of the keys that the message table may hold; tables of earlier days have none."""
        place = self._property(S.MESSAGE_TABLE, _MEMBERSHIP)
        if place is None:
            return None
        blocks = int(self._property(S.MESSAGE_TABLE, _BLOCKS))
        return Membership(self.spark, place, tuple(S.MESSAGE_KEY), self._buckets(), blocks)

    def rebuild_membership(self) -> None:
        """Learn the keys of the whole table anew, with as many blocks as they need. No writer may be at work."""
        keys, old = self.read(S.MESSAGE_TABLE).select(*S.MESSAGE_KEY), self._property(S.MESSAGE_TABLE, _MEMBERSHIP)
        wanted, blocks = keys.count() // (self._buckets() * KEYS_PER_BLOCK), BLOCKS
        while blocks < wanted:
            blocks *= 2
        place = f"{self._database_location()}/membership-{uuid.uuid4().hex}"
        fresh = Membership(self.spark, place, tuple(S.MESSAGE_KEY), self._buckets(), blocks)
        fresh.create()
        fresh.add(fresh.placed(keys))
        self.spark.sql(
            f"ALTER TABLE {self.name(S.MESSAGE_TABLE)} SET TBLPROPERTIES ('{_MEMBERSHIP}' = '{place}', '{_BLOCKS}' = '{blocks}')"
        )
        if old:
            self.drop_folder(old)

    def _clustering(self, table: str) -> str:
        """The buckets of a table: those that it has, or else those of the settings."""
        if table != S.MESSAGE_TABLE:
            return ""
        return f"CLUSTERED BY ({', '.join(S.MESSAGE_KEY)}) INTO {self._buckets()} BUCKETS"

    def _buckets(self) -> int:
        if not self.exists(S.MESSAGE_TABLE):
            return self.settings.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        detail = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name(S.MESSAGE_TABLE)}")
        return int(detail.where("col_name = 'Num Buckets'").first()["data_type"])

    def reset_tables(self) -> None:
        """Drop this export's tables with their data and version, and nothing else."""
        for table in TABLES:
            if not self.exists(table):
                continue
            log = self._log(table)
            latest = log.latest()
            folders = [self.location(table), latest and latest.location, latest and latest.previous, self._property(table, _MEMBERSHIP), log.folder]
            folders.append(self.column_statistics(table).place)
            self.spark.sql(f"DROP TABLE {self.name(table)}")
            for folder in folders:
                if folder:
                    self.drop_folder(folder)

    def analyze(self, table: str) -> None:
        """Refresh the statistics the optimizer uses."""
        self.spark.sql(f"ANALYZE TABLE {self.name(table)} COMPUTE STATISTICS")

    def column_statistics(self, table: str) -> ColumnStatistics:
        """Statistics of the keys and times of a table, as of their last `update`."""
        columns = {name: F.col(name) for name in _COUNTED.get(table, ())}
        if table == S.PROGRESS_TABLE:
            columns = {S.PROGRESS_TYPE_USER: F.when(F.col("type") == S.PROGRESS_TYPE_USER, F.col("value"))}
        return ColumnStatistics(self.spark, f"{self._database_location()}/statistics-{table}", columns)

    def refresh_statistics(self, table: str) -> int:
        """Bring the column statistics up to date; how many files had to be read for it. One writer at a time."""
        return len(self.column_statistics(table).update(self.read(table)))

    def pending_estimate(self) -> int:
        """About how many mailboxes are still to be exported (ids compared byte by byte), from statistics and added files alone."""
        for table in (S.ROSTER_TABLE, S.PROGRESS_TABLE):
            self.refresh_statistics(table)
        known, done = (self.column_statistics(table).merged() for table in (S.ROSTER_TABLE, S.PROGRESS_TABLE))
        return estimated_anti_join(known, S.ROSTER_KEY[0], done, S.PROGRESS_TYPE_USER).first()["missing"]

    def location(self, table: str) -> str:
        detail = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name(table)}")
        return detail.where("col_name = 'Location'").first()["data_type"]

    def _property(self, table: str, key: str) -> str | None:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self.name(table)}").collect()
        return next((row["value"] for row in rows if row["key"] == key), None)

    def drop_folder(self, path: str) -> None:
        drop_folder(self.spark, path)

    # --- schema version

    def version(self) -> str | None:
        """The version all tables carry; None when one is missing or differs."""
        if not all(self.exists(table) for table in TABLES):
            return None
        found = {self._property(table, _VERSION) for table in TABLES}
        return found.pop() if len(found) == 1 else None

    def set_version(self, version: str = S.SCHEMA_VERSION) -> None:
        for table in TABLES:
            self.spark.sql(
                f"ALTER TABLE {self.name(table)} SET TBLPROPERTIES ('{_VERSION}' = '{version}')"
            )

    def delete_version(self) -> None:
        for table in TABLES:
            if self.exists(table):
                self.spark.sql(
                    f"ALTER TABLE {self.name(table)} UNSET TBLPROPERTIES IF EXISTS ('{_VERSION}')"
                )

    def check_version(self) -> str:
        found = self.version()
        if found != S.SCHEMA_VERSION:
            raise SchemaVersionError(
                f"schema version {S.SCHEMA_VERSION} needed, found {found}; reset the tables"
            )
        return found

    # --- contents

    def _log(self, table: str) -> VersionLog:
        return VersionLog(self.spark, f"{self._database_location()}/versions-{table}")

    def _settled(self, table: str) -> Version:
        """The newest version, the catalog being brought in line with it."""
        log, here = self._log(table), self.location(table)
        latest = log.latest()
        if latest is None:
            log.commit(Version(0, here))
            latest = log.latest()
        # Folder names are unique, however their paths are spelled.
        if _folder_name(here) != _folder_name(latest.location):
            self.spark.sql(f"ALTER TABLE {self.name(table)} SET LOCATION '{latest.location}'")
        return latest

    def read(self, table: str) -> DataFrame:
        """The table as it is now: another session or writer may have changed it since the last listing."""
        self._settled(table)
        self.spark.catalog.refreshTable(self.name(table))
        return self.spark.table(self.name(table))

    def upsert_roster(self, rows: DataFrame) -> None:
        """Upsert roster rows (with `ROSTER_ORDER` beside them) and switch to the new version."""
        collation = self.settings.key_collation
        self._switch(S.ROSTER_TABLE, lambda old: merge_upsert(old, rows, S.ROSTER_KEY, ROSTER_ORDER, collation))

    def _switch(self, table: str, make: Callable[[DataFrame], DataFrame]) -> None:
        """Write what `make` makes of a table in a folder of its own, and commit it as the next version.

        If another writer has changed the table meanwhile, it is made anew from what is there then.
        The version before stays for readers that have begun with it; the one before that goes.
        """
        for _ in range(_TRIES):
            old = self._settled(table)
            rows = make(self.read(table))
            new = self._new_location(table)
            staging = f"{table}__{uuid.uuid4().hex}"
            self._create(staging, TABLES[table], new, self._clustering(table))
            try:
                rows.select(*TABLES[table].fieldNames()).write.insertInto(self.name(staging))
            finally:
                # External, so the data stay.
                self.spark.sql(f"DROP TABLE {self.name(staging)}")
            if self._log(table).commit(Version(old.number + 1, new, old.location)):
                self.read(table)
                if old.previous:
                    self.drop_folder(old.previous)
                return
            self.drop_folder(new)
        raise WriteConflict(f"{table} is changed by others all the time")

    def _appended(self, table: str, write: Callable[[], Any], again: bool = True) -> Any:
        """Do `write`, which adds files to a table, and commit that.

        If the table has moved to another folder meanwhile, the files may be in the one that it has left: `write` is done
        again, or refused where it would add rows twice.
        """
        log = self._log(table)
        for _ in range(_TRIES):
            before = self._settled(table)
            result = write()
            while _folder_name((latest := log.latest()).location) == _folder_name(before.location):
                if log.commit(Version(latest.number + 1, latest.location, latest.previous)):
                    return result
            if not again:
                break
        raise WriteConflict(f"{table} has been rewritten while rows were added")

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows as they are."""
        if table == S.MESSAGE_TABLE:
            self._learn(rows)
        rows = rows.select(*TABLES[table].fieldNames())
        self._appended(table, lambda: rows.write.insertInto(self.name(table)), again=False)

    def update(self, table: str, changes: DataFrame, keys: list[str], order: list[str]) -> None:
        """Replace the rows of known keys (the last change by `order` counts)."""
        self._switch(table, lambda old: dml_update_by_key(old, changes, keys, order))

    def delete(self, table: str, doomed: DataFrame, keys: list[str]) -> None:
        """Remove the rows of the given keys."""
        self._switch(table, lambda old: dml_delete_by_key(old, doomed, keys))

    def compact(self, table: str) -> None:
        """Rewrite a table with one file per bucket, after many small additions."""

        def packed(rows: DataFrame) -> DataFrame:
            if table != S.MESSAGE_TABLE:
                return rows
            # By bucket number: a partitioning by the keys themselves would be taken for granted and left out.
            buckets = self._buckets()
            return rows.repartition(buckets, F.pmod(F.hash(*S.MESSAGE_KEY), F.lit(buckets)))

        self._switch(table, packed)
        if table == S.MESSAGE_TABLE:
            self.rebuild_membership()

    def messages_to_insert(self, messages: DataFrame) -> DataFrame:
        """Messages (with `MESSAGE_ORDER` beside them) that the table does not have yet."""
        return merge_insert_only(
            self.read(S.MESSAGE_TABLE),
            messages,
            S.MESSAGE_KEY,
            MESSAGE_ORDER,
            self.settings.key_collation,
        )

    def append_messages(self, rows: DataFrame) -> int:
        """Add messages; how many, as the tasks that wrote them counted."""
        self._learn(rows)
        return self._appended(S.MESSAGE_TABLE, lambda: self._insert(rows), again=False)

    def _learn(self, rows: DataFrame) -> None:
        index = self.membership()
        if index is not None:
            index.add(index.placed(_keys(rows)))

    def _insert(self, rows: DataFrame) -> int:
        # Counted in the last stage, where a repeated task counts once.
        counted = Observation()
        rows = rows.select(*S.MESSAGE_COLUMNS).observe(counted, F.count(F.lit(1)).alias("rows"))
        rows.write.insertInto(self.name(S.MESSAGE_TABLE))
        return counted.get["rows"]

    def merge_messages(self, messages: DataFrame) -> int:
        """Insert those messages (with `MESSAGE_ORDER` beside them) that the table does not have; how many.

        The keys of the batch are held against the membership filter; those that it may know are looked
        up in the buckets they belong to, and nothing else of the table is read. The filter learns the
        other keys before the table gets their rows, so that a run that ends in between leaves
        keys that are looked up in vain, and never rows that nobody looks for.
        """
        return self._appended(S.MESSAGE_TABLE, lambda: self._merge(messages))

    def _merge(self, messages: DataFrame) -> int:
        index = self.membership()
        if index is None or self.settings.key_collation is not None:
            # Keys that are equal under a collation need not be of one bucket.
            if index is not None:
                index.add(index.placed(_keys(messages)))
            return self._insert(self.messages_to_insert(messages))
        work = scratch(self.spark, "merge")
        keys = stored(index.placed(_keys(messages).distinct()), f"{work}/keys")
        maybe = stored(index.may_hold(keys), f"{work}/maybe")
        known = stored(known_keys(self.read(S.MESSAGE_TABLE), maybe, S.MESSAGE_KEY), f"{work}/known")
        index.add(keys.join(known, S.MESSAGE_KEY, "left_anti"))
        first = dedupe_first_wins(messages, S.MESSAGE_KEY, MESSAGE_ORDER)
        inserted = self._insert(first.join(known, S.MESSAGE_KEY, "left_anti"))
        self.drop_folder(work)
        return inserted

    def commit_progress(self, users: DataFrame, key: str = "mailbox") -> None:
        def write() -> None:
            new = progress_commit(self.read(S.PROGRESS_TABLE), users, key, self.settings.key_collation)
            new.write.insertInto(self.name(S.PROGRESS_TABLE))

        self._appended(S.PROGRESS_TABLE, write)


def _folder_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _keys(rows: DataFrame) -> DataFrame:
    """The message keys of some rows, in the types of the table."""
    kinds = {f.name: "string" if isinstance(f.dataType, T.VarcharType) else f.dataType for f in S.MESSAGE}
    return rows.select(*(F.col(name).cast(kinds[name]).alias(name) for name in S.MESSAGE_KEY))
