import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from threadhaul import schemas as S
from threadhaul.runtime import local_session
from threadhaul.settings import ExportSettings
from threadhaul.tables import ChatStore


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="8", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def settings(tmp_path, request):
    name = "t_" + "".join(c if c.isalnum() else "_" for c in request.node.name).lower()[:60]
    return ExportSettings(
        start="2023-01-01Z",
        end="2025-01-01Z",
        database=name,
        database_location=str(tmp_path / "database"),
    )


@pytest.fixture
def store(spark, settings):
    made = ChatStore(spark, settings)
    made.ensure_tables()
    made.set_version()
    return made


class Pages:
    """Builds landed pages from plain Python values."""

    @staticmethod
    def message(number, chat="c", ts="2024-05-01T10:00:00Z", **more):
        return {
            "id": number,
            "chatId": chat,
            "createdDateTime": ts,
            "lastModifiedDateTime": ts,
            **more,
        }

    @staticmethod
    def page(mailbox, page_no, messages=None, more=False, status=200, model="A", body=None):
        link = f"{mailbox}#{page_no + 1}" if more else None
        if body is None and messages is not None:
            body = json.dumps({"@odata.count": len(messages), "@odata.nextLink": link, "value": messages})
        return (mailbox, page_no, status, model, link, body)

    @staticmethod
    def frame(spark, rows):
        return spark.createDataFrame(rows, S.LANDED_PAGE)


@pytest.fixture
def pages():
    return Pages


@pytest.fixture
def roster_folder(tmp_path):
    def write(*mailboxes, name="AllMailBoxes 1.json"):
        folder = tmp_path / "roster"
        folder.mkdir(exist_ok=True)
        rows = [{"ExternalDirectoryObjectId": one, "DisplayName": one.upper()} for one in mailboxes]
        (folder / name).write_text(json.dumps(rows))
        return str(folder)

    return write
