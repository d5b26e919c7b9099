"""Binary files that tasks write to and read from the shared folder.

A task writes under a name of its own attempt and moves the finished file to its final
name; only files that a task has reported (in its rows) are read afterwards, so that a
lost or repeated task leaves nothing that counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder (local, HDFS, an object store) and the folder's path in it."""
    if folder.startswith("file:") and "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


@contextmanager
def new_file(folder: str, suffix: str) -> Iterator[tuple[pa.NativeFile, str]]:
    """A stream to a new file of this task, and the path that it has once it is complete."""
    store, root = file_system(folder)
    store.create_dir(root, recursive=True)
    task = TaskContext.get()
    name = f"{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}{suffix}"
    draft = f"{root}/.{name}.draft"
    stream = store.open_output_stream(draft, compression=None)
    try:
        yield stream, name
        stream.close()
        store.move(draft, f"{root}/{name}")
    except BaseException:
        if not stream.closed:
            stream.close()
        store.delete_file(draft)
        raise


def open_file(folder: str, name: str) -> pa.NativeFile:
    store, root = file_system(folder)
    return store.open_input_file(f"{root}/{name}")
