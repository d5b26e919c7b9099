"""A paged message service as a Spark data source.

The worklist lies in Parquet files, one per group of users. A task takes one
group, walks the page chain of each of its users and yields one row per
response. The service itself is reached through a fetcher object, so that any
transport can be plugged in.

Within a chain pages can only be asked for one after another. So that a very
large mailbox does not hang on one task, the window may be cut into slices:
each user then has one chain per slice, and slices are spread over the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
)

from .. import schemas as S
from ..runtime import ship_package

PAGE_ROWS = (
    "mailbox string, slice int, page_no int, status int, model string, next_link string,"
    " body string, fetched_at timestamp, window_start timestamp, window_end timestamp"
)


@dataclass(frozen=True)
class PageRequest:
    """One request. With a `next_link` the other fields do not change the answer."""

    mailbox: str
    start: datetime
    end: datetime
    model: str
    page_size: int
    next_link: str | None = None


@dataclass(frozen=True)
class PageResponse:
    status: int
    body: str | None = None
    next_link: str | None = None


class PageFetcher(Protocol):
    """What the source needs from a service. It is pickled and used inside tasks."""

    def fetch(self, request: PageRequest) -> PageResponse: ...


@dataclass(frozen=True)
class ChainPosition:
    """The request that a chain goes on with."""

    page_no: int
    model: str
    next_link: str | None = None


def walk_from(
    fetcher: PageFetcher, mailbox: str, start: datetime, end: datetime, model: str, page_size: int, position: ChainPosition
) -> Iterator[tuple[int, str, PageResponse, ChainPosition | None]]:
    """`(page_no, model, response, next position)` from a position on until the chain ends; None ends it.

    The page is asked for again, once per user, with the other model when the
    service wants payment. The reader hands every response on; the chain
    operators judge them. A request that raises ends its chain, and no other, with a response of
    its own status, so that the user stays pending. `model` is the one that the chain began with.
    """
    while position is not None:
        page_no, asked, next_link = position.page_no, position.model, position.next_link
        try:
            response = fetcher.fetch(PageRequest(mailbox, start, end, asked, page_size, next_link))
        except Exception as error:  # whatever a fetcher raises concerns this chain only
            response = PageResponse(S.STATUS_NO_RESPONSE, f"{type(error).__name__}: {error}")
        if response.status == S.STATUS_SWITCH_MODEL and asked == model:
            position = ChainPosition(page_no, next(other for other in S.MODELS if other != model), next_link)
        elif response.status != S.STATUS_OK or response.next_link is None:
            position = None
        else:
            position = ChainPosition(page_no + 1, asked, response.next_link)
        yield page_no, asked, response, position


def walk_chain(
    fetcher: PageFetcher, mailbox: str, start: datetime, end: datetime, model: str, page_size: int
) -> Iterator[tuple[int, str, PageResponse]]:
    """`(page_no, model, response)` of one user from the first page until the chain ends."""
    for page_no, asked, response, _ in walk_from(fetcher, mailbox, start, end, model, page_size, ChainPosition(0, model)):
        yield page_no, asked, response


def deal_by_size(chains: DataFrame, tasks: int, slices: int = 1) -> DataFrame:
    """(mailbox, slice, slices, size, task): chains with an expected size, dealt so that no task gets a third above the mean.

    A mailbox is cut into so many slices that none is above a third of the mean. The slices are laid
    end to end, and each belongs to the task in whose equal share of the whole its middle lies. Sums run within
    hashed buckets first, and over the totals of the buckets then, so that no task sees all chains.
    """
    total = chains.agg(F.coalesce(F.sum("size"), F.lit(0.0)).alias("size")).first()[0] or 1.0
    mean = total / tasks
    wanted = F.greatest(F.lit(slices), F.ceil(F.col("size") * 3 * tasks / total).cast("int"))
    cut = chains.select("mailbox", "size", wanted.alias("slices"))
    cut = cut.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("size", F.col("size") / F.col("slices"))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("mailbox", "slice"), F.lit(tasks)).cast("int"))
    # One row per bucket.
    totals = cut.groupBy("bucket").agg(F.sum("size").alias("whole"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("bucket", F.coalesce(F.sum("whole").over(before), F.lit(0.0)).alias("start"))
    within = F.sum("size").over(Window.partitionBy("bucket").orderBy("mailbox", "slice").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("start") + F.col("within") - F.col("size") / 2
    task = F.least(F.floor(middle / mean), F.lit(tasks - 1)).cast("int")
    dealt = cut.withColumn("within", within).join(F.broadcast(starts), "bucket")
    return dealt.select("mailbox", "slice", "slices", "size", F.greatest(task, F.lit(0)).alias("task"))


def expected_sizes(worklist: DataFrame, log: DataFrame) -> DataFrame:
    """`worklist` with the `size` of each mailbox: the messages that its latest logged run held, else the mean of those known."""
    held = F.regexp_extract("note", r"^(\d+) messages", 1).cast("double")
    known = log.where((F.col("event") == "user") & F.col("note").rlike(r"^\d+ messages")).groupBy("mailbox").agg(F.max_by(held, "ts").alias("held"))
    usual = known.agg(F.coalesce(F.avg("held"), F.lit(1.0)).alias("usual"))
    # A request is needed even for a mailbox that had nothing.
    return worklist.join(known, "mailbox", "left").select("mailbox", F.greatest(F.coalesce("held", usual.scalar()), F.lit(1.0)).alias("size"))


def write_worklist(worklist: DataFrame, path: str, groups: int, slices: int = 1) -> None:
    """Store the chains to fetch in `groups` files, each fetched by one task.

    With a column `size` they are dealt by it; otherwise by a hash of their own, so that
    a partitioning the worklist may have already is not taken over with fewer, larger groups.
    """
    if "size" in worklist.columns:
        dealt = deal_by_size(worklist, groups, slices).repartitionById(groups, "task").drop("task", "size")
    else:
        chains = worklist.select(
            "mailbox",
            F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
            F.lit(slices).alias("slices"),
        )
        dealt = chains.repartition(groups, F.xxhash64("mailbox", "slice"))
    dealt.sortWithinPartitions("mailbox", "slice").write.parquet(path)


def slice_window(start: datetime, end: datetime, number: int, slices: int) -> tuple[datetime, datetime]:
    """The open window of one slice.

    A time on an inner bound lies in the slice before it: that slice ends one
    microsecond later than the next one starts. Finer times may then come twice,
    and are merged by key like every repeated message.
    """
    width = (end - start) / slices
    low = start + width * number
    high = end if number == slices - 1 else start + width * (number + 1) + timedelta(microseconds=1)
    return low, high


class _Group(InputPartition):
    """The users of one worklist file."""

    def __init__(self, path: str):
        self.path = path


@dataclass
class _Plan:
    worklist: str
    model: str
    page_size: int
    start: datetime | None = None
    end: datetime | None = None
    mailboxes: set[str] | None = None
    files: list[str] = field(default_factory=list)


def _instant(value) -> datetime:
    """A bound as an aware UTC datetime."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value


class _PageReader(DataSourceReader):
    def __init__(self, fetcher: PageFetcher, plan: _Plan):
        self.fetcher = fetcher
        self.plan = plan

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take the window and the mailboxes; leave every other predicate to Spark."""
        for one in filters:
            if isinstance(one, EqualTo) and one.attribute == ("window_start",):
                self.plan.start = _instant(one.value)
            elif isinstance(one, EqualTo) and one.attribute == ("window_end",):
                self.plan.end = _instant(one.value)
            elif isinstance(one, (EqualTo, In)) and one.attribute == ("mailbox",):
                wanted = {one.value} if isinstance(one, EqualTo) else set(one.value)
                known = self.plan.mailboxes
                self.plan.mailboxes = wanted if known is None else known & wanted
            else:
                yield one

    def partitions(self) -> list[InputPartition]:
        if self.plan.start is None or self.plan.end is None:
            raise ValueError("both ends of the export window are needed")
        return [_Group(path) for path in self.plan.files]

    def read(self, partition: _Group) -> Iterator[tuple]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        plan = self.plan
        filesystem, _ = fs.FileSystem.from_uri(_as_uri(plan.worklist))
        group = pq.ParquetFile(filesystem.open_input_file(partition.path))
        for batch in group.iter_batches():
            for row in batch.to_pylist():
                mailbox, number = row["mailbox"], row["slice"]
                if plan.mailboxes is not None and mailbox not in plan.mailboxes:
                    continue
                start, end = slice_window(plan.start, plan.end, number, row["slices"])
                chain = walk_chain(
                    self.fetcher, mailbox, start, end, plan.model, plan.page_size
                )
                for page_no, model, answer in chain:
                    yield (
                        mailbox,
                        number,
                        page_no,
                        answer.status,
                        model,
                        answer.next_link,
                        answer.body,
                        datetime.now(timezone.utc),
                        plan.start,
                        plan.end,
                    )


def register_paged_source(
    spark: SparkSession, fetcher: PageFetcher, name: str = "paged_messages"
) -> str:
    """Register the source for one fetcher and return its format name.

    Options: `worklist` (a folder written by `write_worklist`), `start`, `end`, `model`, `pagesize`. A batch read may
    take the window from predicates on `window_start` and `window_end` instead. As a stream (`readStream`) it also needs
    `state`, a shared folder of this query alone, and may be given `pagesperround` (see `paged_stream`).
    """

    class PagedMessages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGE_ROWS

        def reader(self, schema) -> DataSourceReader:
            return _PageReader(fetcher, _plan_of(self.options))

        def streamReader(self, schema) -> DataSourceStreamReader:
            from .paged_stream import PageStreamReader

            state, pages = self.options["state"], int(self.options.get("pagesperround", 16))
            return PageStreamReader(fetcher, _plan_of(self.options), state, pages)

    ship_package(spark)
    spark.dataSource.register(PagedMessages)
    return name


def _plan_of(options) -> _Plan:
    from pyarrow import fs

    filesystem, root = fs.FileSystem.from_uri(_as_uri(options["worklist"]))
    listing = filesystem.get_file_info(fs.FileSelector(root, recursive=True))
    plan = _Plan(
        worklist=options["worklist"],
        model=options.get("model", S.MODELS[0]),
        page_size=int(options.get("pagesize", S.DEFAULT_PAGE_SIZE)),
        files=sorted(one.path for one in listing if one.path.endswith(".parquet")),
    )
    if "start" in options:
        plan.start = _instant(options["start"])
    if "end" in options:
        plan.end = _instant(options["end"])
    return plan


def _as_uri(path: str) -> str:
    if "://" in path:
        return path
    if path.startswith("file:"):
        return "file://" + path[len("file:") :]
    return "file://" + path
