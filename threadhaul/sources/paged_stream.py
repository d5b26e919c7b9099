"""The paged source as a stream that goes on where it stopped.

A round asks every open chain for a bounded number of further pages. Its offset is the number of the
round alone: where each chain stands (last page, link, model) is kept by the tasks, in one folder per task and round below
`state`, beside the pages of that round.

    state/round=3/task=5/pages.parquet    what was answered in this round
    state/round=3/task=5/chains.parquet   the chains that are still open, and their next requests
    state/round=3/task=5/open=17          how many there are

A folder gets its name when it is complete, by a rename that fails if there is one already. A task that finds the folder of its
round hands out what is in it and asks for nothing; so a batch that Spark runs again after a restart
has the same rows, and no page is asked for twice. If several attempts of a task work at once, the first to finish counts for all.
Only a task that is stopped within a round asks for that round's pages of its own chains again.

The driver lists folder names, of which there are two rounds times tasks; it never sees a chain.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

from .paged import ChainPosition, PageFetcher, _as_uri, _Plan, slice_window, walk_from

_INSTANT = pa.timestamp("us", tz="UTC")
_PAGES = pa.schema(
    [("mailbox", pa.string()), ("slice", pa.int32()), ("page_no", pa.int32()), ("status", pa.int32()), ("model", pa.string())]
    + [("next_link", pa.string()), ("body", pa.string()), ("fetched_at", _INSTANT), ("window_start", _INSTANT), ("window_end", _INSTANT)]
)
_CHAINS = pa.schema(
    [("mailbox", pa.string()), ("slice", pa.int32()), ("slices", pa.int32())]
    + [("page_no", pa.int32()), ("model", pa.string()), ("next_link", pa.string())]
)
# Rows a task holds before it writes them.
_HELD = 256


class _Task(InputPartition):
    def __init__(self, round_: int, number: int):
        self.round = round_
        self.number = number


class _Rows:
    """A Parquet file that is written some rows at a time."""

    def __init__(self, filesystem: fs.FileSystem, path: str, schema: pa.Schema):
        self.schema, self.held, self.count = schema, [], 0
        self.sink = filesystem.open_output_stream(path)
        self.writer = pq.ParquetWriter(self.sink, schema)

    def add(self, row: tuple) -> None:
        self.held.append(row)
        self.count += 1
        if len(self.held) == _HELD:
            self._write()

    def _write(self) -> None:
        columns = zip(*self.held) if self.held else [()] * len(self.schema)
        arrays = [pa.array(list(values), one.type) for values, one in zip(columns, self.schema)]
        self.writer.write_table(pa.table(arrays, schema=self.schema))
        self.held = []

    def close(self) -> None:
        if self.held:
            self._write()
        self.writer.close()
        self.sink.close()


class PageStreamReader(DataSourceStreamReader):
    """Rounds over the chains of a worklist; both ends of the window must be options."""

    def __init__(self, fetcher: PageFetcher, plan: _Plan, state: str, pages_per_round: int):
        if plan.start is None or plan.end is None:
            raise ValueError("both ends of the export window are needed")
        if pages_per_round < 1:
            raise ValueError("a round needs at least one page of each chain")
        self.fetcher, self.plan, self.state, self.pages_per_round = fetcher, plan, state, pages_per_round

    # --- driver

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        """One round more than the last finished one, as long as a chain is open."""
        filesystem, root = self._place()
        finished = [n for n in self._rounds(filesystem, root) if self._is_finished(filesystem, root, n)]
        if not finished:
            return {"round": 1 if self.plan.files else 0}
        last = max(finished)
        return {"round": last + (sum(self._open(filesystem, root, last).values()) > 0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A task for each file of the worklist that has open chains; Spark asks for one round at a time."""
        filesystem, root = self._place()
        tasks = []
        for number in range(start["round"] + 1, end["round"] + 1):
            before = self._open(filesystem, root, number - 1)
            # Tasks without open chains take part too: their folders say that the round is whole.
            tasks += [_Task(number, task) for task in range(len(self.plan.files)) if number == 1 or task in before]
        return tasks

    def commit(self, end: dict) -> None:
        """Rounds before the committed one are needed by nobody."""
        filesystem, root = self._place()
        for number in self._rounds(filesystem, root):
            if number < end["round"]:
                filesystem.delete_dir(f"{root}/round={number}")

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(_as_uri(self.state.rstrip("/")))

    @staticmethod
    def _names(filesystem: fs.FileSystem, path: str, kind: str) -> list[int]:
        found = filesystem.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return [int(one.base_name.split("=")[1]) for one in found if one.base_name.startswith(f"{kind}=")]

    def _rounds(self, filesystem: fs.FileSystem, root: str) -> list[int]:
        return self._names(filesystem, root, "round")

    def _open(self, filesystem: fs.FileSystem, root: str, number: int) -> dict[int, int]:
        """Open chains of each task after a round."""
        folder = f"{root}/round={number}"
        return {task: self._names(filesystem, f"{folder}/task={task}", "open")[0] for task in self._names(filesystem, folder, "task")}

    def _is_finished(self, filesystem: fs.FileSystem, root: str, number: int) -> bool:
        return len(self._names(filesystem, f"{root}/round={number}", "task")) == len(self.plan.files)

    # --- tasks

    def read(self, partition: _Task) -> Iterator[tuple]:
        filesystem, root = self._place()
        folder = f"{root}/round={partition.round}/task={partition.number}"
        if not self._is_there(filesystem, folder):
            self._ask(filesystem, root, folder, partition)
        with filesystem.open_input_file(f"{folder}/pages.parquet") as source:
            for batch in pq.ParquetFile(source).iter_batches(_HELD):
                for row in batch.to_pylist():
                    yield tuple(row[name] for name in _PAGES.names)

    @staticmethod
    def _is_there(filesystem: fs.FileSystem, folder: str) -> bool:
        return filesystem.get_file_info(folder).type == fs.FileType.Directory

    def _chains(self, filesystem: fs.FileSystem, root: str, task: _Task) -> Iterator[tuple[dict, ChainPosition]]:
        """The open chains of a task: at first, all that the worklist has given it."""
        first = task.round == 1
        path = self.plan.files[task.number] if first else f"{root}/round={task.round - 1}/task={task.number}/chains.parquet"
        home = fs.FileSystem.from_uri(_as_uri(self.plan.worklist))[0] if first else filesystem
        with home.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(_HELD):
                for row in batch.to_pylist():
                    model = self.plan.model if first else row["model"]
                    yield row, ChainPosition(0 if first else row["page_no"], model, None if first else row["next_link"])

    def _ask(self, filesystem: fs.FileSystem, root: str, folder: str, task: _Task) -> None:
        """Ask for the pages of a round, and give the folder its name once all is written."""
        plan, attempt = self.plan, f"{root}/round={task.round}/.{task.number}-{uuid.uuid4().hex}"
        filesystem.create_dir(attempt)
        pages, chains = _Rows(filesystem, f"{attempt}/pages.parquet", _PAGES), _Rows(filesystem, f"{attempt}/chains.parquet", _CHAINS)
        for row, position in self._chains(filesystem, root, task):
            mailbox, number, slices = row["mailbox"], row["slice"], row["slices"]
            window = slice_window(plan.start, plan.end, number, slices)
            walk = walk_from(self.fetcher, mailbox, *window, plan.model, plan.page_size, position)
            for _, (page_no, model, answer, position) in zip(range(self.pages_per_round), walk):
                now = datetime.now(timezone.utc)
                pages.add((mailbox, number, page_no, answer.status, model, answer.next_link, answer.body, now, plan.start, plan.end))
            if position is not None:
                chains.add((mailbox, number, slices, position.page_no, position.model, position.next_link))
        pages.close()
        chains.close()
        filesystem.open_output_stream(f"{attempt}/open={chains.count}").close()
        try:
            filesystem.move(attempt, folder)
        except OSError:
            # Another attempt was first.
            if not self._is_there(filesystem, folder):
                raise
            filesystem.delete_dir(attempt)
