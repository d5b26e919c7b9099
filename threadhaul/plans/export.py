"""The export from end to end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.chain import (
    ATTEMPT_KEY,
    FAILED,
    beyond_end,
    chain_outcomes,
    completed_users,
    user_outcomes,
    with_disposition,
    within_chain,
)
from ..operators.metrics import RUN_LOG, append_run_log, id_collisions, run_summary
from ..operators.worklist import resume_worklist
from ..runtime import configure, scratch, stored
from ..settings import ExportSettings
from ..sources.files import list_matching, scan_wildcard_files, scan_wildcard_lines
from ..sources.json_split import array_elements
from ..sources.paged import expected_sizes, write_worklist
from ..sources.pages import explode_pages
from ..sources.roster import roster_rows, roster_rows_from_elements, roster_rows_from_lines, split_roster
from ..tables import ChatStore
from .messages import MESSAGE_ORDER, checked_messages

PageReader = Callable[[DataFrame], DataFrame]
"""From the worklist (`mailbox`) to its landed pages."""


class ExportFailed(RuntimeError):
    """Some users failed or some messages were refused; everything good is stored."""


@dataclass(frozen=True)
class RunReport:
    """Counts of a run, and where its files lie."""

    run_id: str
    folder: str
    pending: int = 0
    pages: int = 0
    messages: int = 0
    inserted: int = 0
    refused: int = 0
    bad_urls: int = 0
    finished: int = 0
    failed: int = 0
    collisions: int = 0
    bytes_read: int = 0
    bytes_written: int = 0

    def summary(self, spark: SparkSession) -> DataFrame:
        """Processed messages, bytes and times of the run, from its log."""
        log = spark.read.parquet(f"{self.folder}/log")
        return run_summary(log.withColumn("items", F.when(F.col("event") == "messages", F.col("items"))))


def stage_pages(
    pages: DataFrame, first_model: str, path: str, window: tuple[datetime, datetime]
) -> DataFrame:
    """Parse every body once, and keep the rows in columns for the steps that follow.

    Messages outside the window go before anything is built from them; a page
    without messages inside it keeps one row.
    """
    if "fetched_at" not in pages.columns:
        pages = pages.withColumn("fetched_at", F.lit(None).cast("timestamp"))
    pages = pages.withColumn("bytes", F.octet_length("body").cast("bigint"))
    judged = with_disposition(explode_pages(pages, keep_empty=True, window=window), first_model)
    page = F.struct("fetched_at", "bytes", "held")
    rows = checked_messages(
        judged.withColumn("page", page),
        *ATTEMPT_KEY[1:],
        "page_no",
        "chain_pos",
        "position",
        "disposition",
        "terminal",
        "page",
    )
    return stored(rows, path)


def headers(staged: DataFrame) -> DataFrame:
    """One row per landed page, without its messages."""
    return staged.groupBy(*ATTEMPT_KEY, "page_no", "chain_pos", "disposition", "terminal").agg(
        F.max("page").alias("page")
    )


def store_outcomes(pages: DataFrame, path: str) -> DataFrame:
    """One small row per attempt at a chain, stored: its size is then known to the planner."""
    return stored(chain_outcomes(pages), path)


def messages_that_count(staged: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Messages of the pages that count; without pages beyond an end, which is usual, there is no join."""
    rows = staged.where(F.col("position").isNotNull())
    overlong = beyond_end(outcomes)
    return rows if overlong.isEmpty() else within_chain(rows, overlong)


def refused(messages: DataFrame) -> DataFrame:
    """Messages that must not be stored, with the reason."""
    return messages.where(F.col("problem").isNotNull()).select(
        "mailbox", "chatId", "message_id", "problem", *MESSAGE_ORDER
    )


class ChatExport:
    """Roster, worklist, pages, messages, progress, report: in this order.

    Each step is a few Spark jobs over whole tables, and ends in something
    stored: what a failed run leaves behind is found again and not repeated.
    """

    def __init__(self, spark: SparkSession, settings: ExportSettings):
        self.spark = configure(spark)
        self.settings = settings
        self.store = ChatStore(spark, settings)

    def run(self, roster_root: str | None, read_pages: PageReader) -> RunReport:
        if self.settings.reset:
            self.store.reset_tables()
            self.store.ensure_tables()
            self.store.set_version()
        self.store.check_version()
        self.settings.window(self.spark)
        folder = scratch(self.spark, "run")
        run_id = folder.rsplit("-", 1)[-1]
        self._log(run_id, f"{folder}/log", ("start", 0, 0, 0, ""))
        if roster_root is not None:
            self.load_roster(roster_root, folder, run_id)
        return self.load_messages(read_pages, run_id, folder)

    # --- roster

    def load_roster(self, root: str, folder: str, run_id: str) -> None:
        pattern, strict = self.settings.roster_pattern, self.settings.strict
        files = list_matching(self.spark, root, pattern)
        if self.settings.roster_lines:
            rows = roster_rows_from_lines(scan_wildcard_lines(self.spark, root, pattern, files), strict=strict)
        elif files.largest > self.settings.roster_split_bytes:
            rows = roster_rows_from_elements(array_elements(self.spark, root, pattern, files), strict=strict)
        else:
            rows = roster_rows(scan_wildcard_files(self.spark, root, pattern, files), strict=strict)
        # Roster texts are parsed once.
        roster = split_roster(stored(rows, f"{folder}/roster"))
        self.store.upsert_roster(roster.mailboxes)
        roster.quarantine.write.mode("overwrite").json(f"{folder}/quarantine")
        self._log(run_id, f"{folder}/log", ("roster", roster.mailboxes.count(), files.bytes, 0, ""))

    # --- messages

    def load_messages(self, read_pages: PageReader, run_id: str, folder: str) -> RunReport:
        """Work off the worklist group by group; each ends with its messages and then its users stored.

        What an interrupted run has finished is not on the next worklist.
        """
        store, log, groups = self.store, f"{folder}/log", max(1, self.settings.groups)
        users = resume_worklist(
            store.read(S.ROSTER_TABLE), store.read(S.PROGRESS_TABLE), collation=self.settings.key_collation
        ).select(
            F.col(S.ROSTER_KEY[0]).alias("mailbox")
        )
        group = F.pmod(F.xxhash64("mailbox"), F.lit(groups)).cast("int")
        worklist = stored(users.withColumn("part", group), f"{folder}/worklist")
        report = RunReport(run_id=run_id, folder=folder, pending=worklist.count())
        for number in range(groups) if report.pending else ():
            part = worklist.where(F.col("part") == number).select("mailbox")
            report = self._load_group(part, read_pages, report, f"{folder}/group={number}")
        note = f"{report.finished} users finished, {report.failed} failed" if report.pending else "nothing pending"
        self._log(run_id, log, ("finish", 0, 0, 0, note))
        if self.settings.strict and (report.failed or report.refused):
            raise ExportFailed(
                f"{report.failed} users failed, {report.refused} messages were refused"
            )
        return report

    def _load_group(
        self, worklist: DataFrame, read_pages: PageReader, report: RunReport, folder: str
    ) -> RunReport:
        settings, store = self.settings, self.store
        window = settings.window(self.spark)
        staged = stage_pages(read_pages(worklist), settings.model, f"{folder}/staged", window)
        pages = stored(headers(staged), f"{folder}/pages")
        outcomes = store_outcomes(pages, f"{folder}/outcomes")
        rows = messages_that_count(staged, outcomes)
        blamed = stored(refused(rows), f"{folder}/refused")
        valid = rows.where(F.col("problem").isNull())
        inserted = store.merge_messages(valid)
        done = stored(
            completed_users(outcomes).join(blamed.select("mailbox").distinct(), "mailbox", "left_anti"),
            f"{folder}/finished",
        )
        store.commit_progress(done)
        counted = valid.agg(
            F.count("*").alias("messages"),
            F.coalesce(F.sum("bad_urls"), F.lit(0)).alias("bad_urls"),
            F.coalesce(F.sum(F.octet_length("rawJson")), F.lit(0)).alias("bytes"),
        ).first()
        read = pages.agg(F.count("*").alias("pages"), F.coalesce(F.sum("page.bytes"), F.lit(0)).alias("bytes")).first()
        lost = id_collisions(valid, "mailbox", "chatId", "message_id").agg(F.coalesce(F.sum("lost"), F.lit(0))).first()[0]
        self._log(
            report.run_id,
            f"{report.folder}/log",
            ("messages", counted.messages, read.bytes, counted.bytes, f"{inserted} inserted"),
            users=self._user_log(report.run_id, pages, outcomes),
        )
        failed = user_outcomes(outcomes).where(F.col("outcome") == FAILED).count()
        # A second copy of every message: the table has them now.
        store.drop_folder(f"{folder}/staged")
        return replace(
            report,
            pages=report.pages + read.pages,
            messages=report.messages + counted.messages,
            inserted=report.inserted + inserted,
            refused=report.refused + blamed.count(),
            bad_urls=report.bad_urls + counted.bad_urls,
            finished=report.finished + done.count(),
            failed=report.failed + failed,
            collisions=report.collisions + lost,
            bytes_read=report.bytes_read + read.bytes,
            bytes_written=report.bytes_written + counted.bytes,
        )

    # --- log

    def _user_log(self, run_id: str, pages: DataFrame, outcomes: DataFrame) -> DataFrame:
        """Two rows per user, at its first and its last response: the messages held, and how its chains ended."""
        counts = pages.groupBy("mailbox").agg(
            F.sum("page.held").alias("held"),
            F.min("page.fetched_at").alias("first"),
            F.max("page.fetched_at").alias("last"),
        )
        times = F.explode(F.array("first", "last"))
        return counts.join(user_outcomes(outcomes), "mailbox").select("mailbox", "held", "outcome", times.alias("at")).select(
            F.lit(run_id).alias("run_id"),
            F.coalesce("at", F.current_timestamp()).alias("ts"),
            F.lit("user").alias("event"),
            "mailbox",
            F.lit(0).cast("bigint").alias("items"),
            F.lit(0).cast("bigint").alias("bytes_read"),
            F.lit(0).cast("bigint").alias("bytes_written"),
            F.concat_ws(" ", "held", F.lit("messages,"), "outcome").alias("note"),
        )

    def _log(
        self, run_id: str, path: str, *entries: tuple, users: DataFrame | None = None
    ) -> None:
        now = datetime.now(timezone.utc)
        rows = [
            (run_id, now, kind, None, items, read, written, note)
            for kind, items, read, written, note in entries
        ]
        log = self.spark.createDataFrame(rows, RUN_LOG)
        append_run_log(log if users is None else log.unionByName(users), path)


def landed_pages_reader(pages: DataFrame) -> PageReader:
    """Pages that have been landed already; those of other mailboxes are left out.

    Spark broadcasts the worklist when it is small. Otherwise both sides are
    shuffled by mailbox, and a large mailbox is split by adaptive execution.
    """

    def read(worklist: DataFrame) -> DataFrame:
        return pages.join(worklist, "mailbox", "left_semi")

    return read


def paged_source_reader(
    spark: SparkSession, source: str, settings: ExportSettings, groups: int | None = None, log: DataFrame | None = None
) -> PageReader:
    """Pages fetched from a registered paged source.

    The worklist is written in groups of users, one file and so one task each, dealt by the sizes that the
    `log` of earlier runs tells, if one is given;
    the responses are stored before anything is made of them, because a
    service must not be asked twice.
    """

    def read(worklist: DataFrame) -> DataFrame:
        start, end = settings.window(spark)
        folder = scratch(spark, "fetch")
        wanted = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
        sized = worklist if log is None else stored(expected_sizes(worklist, log), f"{folder}/sizes")
        write_worklist(sized, f"{folder}/worklist", wanted, settings.window_slices)
        pages = (
            spark.read.format(source)
            .option("worklist", f"{folder}/worklist")
            .option("start", start.isoformat())
            .option("end", end.isoformat())
            .option("model", settings.model)
            .option("pagesize", settings.page_size)
            .load()
        )
        return stored(pages.drop("window_start", "window_end"), f"{folder}/pages")

    return read
