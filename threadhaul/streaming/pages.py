"""Page files as a stream: every file once, every message once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .. import schemas as S
from ..operators.chain import completed_users
from ..operators.worklist import resume_worklist
from ..plans.export import headers, messages_that_count, refused, stage_pages, store_outcomes
from ..runtime import configure, folders, stored
from ..settings import ExportSettings
from ..tables import ChatStore


def page_stream(
    spark: SparkSession,
    landing: str,
    max_files: int | None = None,
    archive: str | None = None,
    delete: bool = False,
) -> DataFrame:
    """Landed pages (Parquet files) as a stream.

    Files of finished batches may be moved to `archive` (never over an existing
    file) or deleted.
    """
    reader = spark.readStream.schema(StructType(S.LANDED_PAGE.fields + S.LANDED_PAGE_MORE.fields))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    elif delete:
        reader = reader.option("cleanSource", "delete")
    return reader.parquet(landing)


def for_each_batch(
    stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Hand everything available to `handle`, batch by batch, and stop."""
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def for_each_round(
    stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Like `for_each_batch`, for a source where each batch says whether there is more: ends when nothing new comes."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


@dataclass(frozen=True)
class PageStreamExport:
    """Stores the messages of landed pages and marks their users done, like a batch run over the same pages.

    Only users of the roster who are not done yet take part; pages of others are passed over. State is
    kept in files below `state`: the headers of the pages seen (without any message) and the users with
    refused messages. They tell later batches where the chain of a mailbox ends, whether it is whole, and
    who must stay pending. Each batch writes the state of all users who are still pending after it, from that of the
    batch before, which is then the only other one kept: what is stored and read follows the open chains, not history.
    A replayed batch finds the state before it, and its messages are merged by key, so that it adds nothing.
    """

    spark: SparkSession
    settings: ExportSettings
    state: str

    def run(self, stream: DataFrame) -> StreamingQuery:
        configure(self.spark)
        query = for_each_batch(stream, f"{self.state}/checkpoint", self.handle)
        query.awaitTermination()
        return query

    def run_rounds(self, stream: DataFrame) -> StreamingQuery:
        """Fetch by a paged source (`readStream`), round by round, until all chains have ended; a restart goes on."""
        configure(self.spark)
        return for_each_round(stream, f"{self.state}/checkpoint", self.handle)

    def _earlier(self, spark: SparkSession, kind: str, schema: StructType, batch: int, pending: DataFrame) -> DataFrame:
        """What the batch before has left of these users."""
        before = self._versions(spark, kind, batch)
        if not before:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.state}/{kind}/batch={before[-1]}").join(pending, "mailbox", "left_semi")

    def _versions(self, spark: SparkSession, kind: str, batch: int) -> list[int]:
        """The batches before this one that have left a finished state."""
        found = folders(spark, f"{self.state}/{kind}")
        return sorted(n for n in (int(name.removeprefix("batch=")) for name in found if name.startswith("batch=")) if n < batch)

    def handle(self, pages: DataFrame, batch: int) -> None:
        spark, store = pages.sparkSession, ChatStore(pages.sparkSession, self.settings)
        work = f"{self.state}/work/batch={batch}"
        pending = resume_worklist(
            store.read(S.ROSTER_TABLE), store.read(S.PROGRESS_TABLE), collation=self.settings.key_collation
        ).select(
            F.col(S.ROSTER_KEY[0]).alias("mailbox")
        )
        pending = stored(pending, f"{work}/pending")
        # A batch is few files, which few tasks would parse: its pages are dealt to all.
        wanted = pages.join(pending, "mailbox", "left_semi").repartition("mailbox", "page_no")
        staged = stage_pages(wanted, self.settings.model, f"{work}/staged", self.settings.window(spark))
        seen = stored(headers(staged).drop("page"), f"{work}/headers")
        known = stored(
            seen.unionByName(self._earlier(spark, "headers", seen.schema, batch, pending)).distinct(), f"{work}/known"
        )
        touched = seen.select("mailbox").distinct()
        outcomes = store_outcomes(known.join(touched, "mailbox", "left_semi"), f"{work}/outcomes")
        rows = messages_that_count(staged, outcomes)
        bad = stored(refused(rows).select("mailbox").distinct(), f"{work}/refused")
        store.merge_messages(rows.where("problem IS NULL"))
        blamed = bad.unionByName(self._earlier(spark, "refused", bad.schema, batch, pending)).distinct()
        done = stored(completed_users(outcomes).join(blamed, "mailbox", "left_anti"), f"{work}/done")
        store.commit_progress(done)
        for kind, rows in (("refused", blamed), ("headers", known)):
            rows.join(done, "mailbox", "left_anti").write.mode("overwrite").parquet(f"{self.state}/{kind}/batch={batch}")
            for stale in self._versions(spark, kind, batch)[:-1]:
                store.drop_folder(f"{self.state}/{kind}/batch={stale}")
        store.drop_folder(work)
