"""The paged source as a stream: rounds, restarts, and attempts at once."""

import json
import uuid
from collections import Counter
from pathlib import Path

import pytest

from threadhaul import schemas as S
from threadhaul.plans.export import ChatExport
from threadhaul.sources.paged import PageResponse, _instant, _Plan, register_paged_source, write_worklist
from threadhaul.sources.paged_stream import PageStreamReader, _Task
from threadhaul.streaming.pages import PageStreamExport, for_each_round

WINDOW = {"start": "2023-01-01T00:00:00Z", "end": "2025-01-01T00:00:00Z"}
# Pages of each mailbox; one costs money with the first model, one is not there, one breaks in the middle.
LENGTHS = {"long": 23, **{f"u{n}": n % 4 + 1 for n in range(12)}, "paid": 3, "gone": 0, "broken": 4}
SHOWN = ["mailbox", "slice", "page_no", "status", "model", "next_link", "body"]


def service(asked, stop_at=None):
    """A fetcher that notes every request in a file of its own, and may stop its task once."""

    class Stopped(BaseException):
        """What no fetcher raises: the task is stopped."""

    class Service:
        def fetch(self, request):
            page = int(request.next_link.split("#")[1]) if request.next_link else 0
            if stop_at == (request.mailbox, page) and not Path(asked, "stopped").exists():
                Path(asked, "stopped").touch()
                raise Stopped
            Path(asked, f"{request.mailbox} {page} {request.model} {uuid.uuid4().hex}").touch()
            if request.mailbox == "gone":
                return PageResponse(404)
            if request.mailbox == "paid" and request.model == "A":
                return PageResponse(402)
            if request.mailbox == "broken" and page == 2:
                raise OSError("connection reset")
            time = "2024-05-01T10:00:00Z"
            message = {"id": str(page + 1), "chatId": "c", "createdDateTime": time, "lastModifiedDateTime": time}
            link = f"{request.mailbox}#{page + 1}" if page + 1 < LENGTHS[request.mailbox] else None
            return PageResponse(200, json.dumps({"@odata.nextLink": link, "value": [message]}), link)

    return Service()


def requests(asked):
    return Counter(tuple(p.name.split(" ")[:3]) for p in Path(asked).iterdir() if " " in p.name)


@pytest.fixture
def place(spark, tmp_path):
    for name in ("asked", "asked_once"):
        (tmp_path / name).mkdir()
    users = spark.createDataFrame([(user,) for user in LENGTHS], "mailbox string")
    write_worklist(users, str(tmp_path / "worklist"), 3)
    return tmp_path


def stream(spark, source, place, pages=4):
    reader = spark.readStream.format(source).options(**WINDOW)
    return reader.options(worklist=str(place / "worklist"), state=str(place / "rounds"), pagesperround=pages).load()


def expected(spark, place, name):
    """The batch read, and the requests that it made."""
    source = register_paged_source(spark, service(str(place / "asked_once")), name)
    rows = spark.read.format(source).options(worklist=str(place / "worklist"), **WINDOW).load().select(SHOWN).collect()
    return Counter(rows), requests(place / "asked_once")


def gather(out):
    def handle(rows, batch):
        rows.select(SHOWN).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return handle


def gathered(spark, out):
    return Counter(spark.read.parquet(str(out)).select(SHOWN).collect())


@pytest.mark.parametrize("pages", [3, 100])
def test_a_stream_equals_the_batch_read(spark, place, pages):
    rows, asked = expected(spark, place, f"batch_{pages}")
    source = register_paged_source(spark, service(str(place / "asked")), f"rounds_{pages}")
    for_each_round(stream(spark, source, place, pages), str(place / "checkpoint"), gather(place / "out"))
    assert gathered(spark, place / "out") == rows
    assert requests(place / "asked") == asked and set(asked.values()) == {1}
    # Spark commits a round when it plans the next: two are left at most, and no chain is open in the last.
    last = -(-23 // pages)
    assert {p.name for p in (place / "rounds").iterdir()} <= {f"round={last - 1}", f"round={last}"}
    assert [p.name for p in (place / "rounds" / f"round={last}").glob("task=*/open=*")] == ["open=0"] * 3


def test_a_restart_asks_for_no_page_twice(spark, place):
    """Stopped after a round was fetched and before it was committed, twice."""
    rows, asked = expected(spark, place, "batch_restart")
    source = register_paged_source(spark, service(str(place / "asked")), "rounds_restart")
    for killed_in in (1, 3):
        keep = gather(place / "out")

        def handle(rows, batch):
            keep(rows, batch)
            if batch == killed_in:
                raise RuntimeError("killed")

        with pytest.raises(Exception, match="killed"):
            for_each_round(stream(spark, source, place), str(place / "checkpoint"), handle)
    for_each_round(stream(spark, source, place), str(place / "checkpoint"), gather(place / "out"))
    assert gathered(spark, place / "out") == rows
    assert requests(place / "asked") == asked


def test_a_task_stopped_within_a_round(spark, place):
    """Only the pages of that round of its own chains are asked for again."""
    rows, asked = expected(spark, place, "batch_stopped")
    source = register_paged_source(spark, service(str(place / "asked"), stop_at=("long", 7)), "rounds_stopped")
    with pytest.raises(Exception):
        for_each_round(stream(spark, source, place), str(place / "checkpoint"), gather(place / "out"))
    for_each_round(stream(spark, source, place), str(place / "checkpoint"), gather(place / "out"))
    assert gathered(spark, place / "out") == rows
    again = requests(place / "asked") - asked
    assert ("long", "6", "A") in again and {int(page) for _, page, _ in again} <= {4, 5, 6, 7}
    assert set(requests(place / "asked")) == set(asked)


def test_of_two_attempts_the_first_counts(place):
    """Both ask; what the first to finish has written is what both hand out."""
    files = sorted(str(p) for p in (place / "worklist").glob("*.parquet"))
    start, end = (_instant(WINDOW[name]) for name in ("start", "end"))
    plan = _Plan(str(place / "worklist"), "A", 50, start, end, files=files)
    reader = PageStreamReader(service(str(place / "asked")), plan, str(place / "rounds"), 2)
    assert reader.latestOffset() == {"round": 1}
    task, (filesystem, root) = _Task(1, 0), reader._place()
    first = list(reader.read(task))
    reader._ask(filesystem, root, f"{root}/round=1/task=0", task)
    assert list(reader.read(task)) == first and first
    assert set(requests(place / "asked").values()) == {2}
    assert [p.name for p in (place / "rounds" / "round=1").iterdir()] == ["task=0"]
    # The round is not whole before all its tasks are.
    assert reader.latestOffset() == {"round": 1}
    for number in (1, 2):
        list(reader.read(_Task(1, number)))
    assert reader.latestOffset() == {"round": 2}
    with pytest.raises(ValueError, match="both ends"):
        PageStreamReader(None, _Plan("", "A", 1), "", 1)
    with pytest.raises(ValueError, match="at least one page"):
        PageStreamReader(None, plan, "", 0)


def test_an_empty_worklist_has_no_rounds(place):
    start, end = (_instant(WINDOW[name]) for name in ("start", "end"))
    reader = PageStreamReader(None, _Plan(str(place), "A", 50, start, end), str(place / "none"), 2)
    assert reader.latestOffset() == reader.initialOffset() == {"round": 0}


def test_export_by_rounds(spark, store, settings, place, tmp_path, roster_folder):
    """Tables after fetching as a stream are those of a batch export of the same pages."""
    source = register_paged_source(spark, service(str(place / "asked")), "rounds_export")
    ChatExport(spark, settings).load_roster(roster_folder(*LENGTHS), str(tmp_path / "run"), "run")
    export = PageStreamExport(spark, settings, str(place / "state"))
    export.run_rounds(stream(spark, source, place, 12))
    held = Counter(r.mailbox for r in store.read(S.MESSAGE_TABLE).collect())
    assert held == {user: 2 if user == "broken" else n for user, n in LENGTHS.items() if n}
    done = {r.value for r in store.read(S.PROGRESS_TABLE).collect()}
    assert done == set(LENGTHS) - {"broken"}
