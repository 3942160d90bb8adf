"""Files of records: listing and opening them in tasks, and writing them so that only finished ones can be seen."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

ROLL_BYTES = 256 << 20  # a writer goes on to the next file beyond it
MOST_OPEN = 16  # files that a task has open


def file_system(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def files_under(path: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """Addresses and sizes of the files below a folder with one of the endings, sorted; or of the one file that the path is."""
    from pyarrow import fs

    system, root = file_system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return [(prefix + f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(endings)]


@dataclass
class Written(WriterCommitMessage):
    """The files that a task finished: name while written, and final name."""

    files: list[tuple[str, str]]


class CommittedWriter(DataSourceArrowWriter):
    """Writes files in tasks, each attempt under names of its own; the driver renames them once all tasks are done, and deletes them if the job fails.

    Subclasses give ``records``, the ``(name, bytes)`` of a batch, and ``opened``, the final name of a file for a name and its first bytes. A
    task has at most ``MOST_OPEN`` files open and closes the one used longest ago; a name whose file is closed, or is beyond ``roll`` bytes, gets a further file.
    """

    def __init__(self, path: str, roll: int | None = ROLL_BYTES):
        self.path, self.roll = path, roll

    def opened(self, name: str, number: str) -> tuple[str, bytes]:
        raise NotImplementedError

    def records(self, batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        done: list[tuple[str, str]] = []
        files: dict[str, list] = {}  # name to stream and size, the one used longest ago first
        try:
            for batch in batches:
                for name, data in self.records(batch):
                    file = files.pop(name, None)
                    if file is not None and self.roll is not None and file[1] > self.roll:
                        file[0].close()
                        file = None
                    if file is None:
                        if len(files) == MOST_OPEN:
                            files.pop(next(iter(files)))[0].close()
                        final, first = self.opened(name, f"{task}-{len(done)}")
                        done.append((f"{root}/_{attempt}-{len(done)}", f"{root}/{final}"))
                        file = [system.open_output_stream(done[-1][0], compression=None), len(first)]
                        file[0].write(first)
                    files[name] = file
                    file[0].write(data)
                    file[1] += len(data)
        finally:
            for stream, _ in files.values():
                stream.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.path)
        for message in messages:
            for written, final in message.files if message else ():
                system.move(written, final)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.path)
        for message in messages:
            for written, _ in message.files if message else ():
                system.delete_file(written)


def batched(rows: Iterator[tuple], made: Callable[[list[tuple]], pa.RecordBatch], weight: Callable[[tuple], int], most_rows: int = 4096, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of bounded size."""
    waiting, held = [], 0
    for row in rows:
        waiting.append(row)
        held += weight(row)
        if len(waiting) >= most_rows or held >= most_bytes:
            yield made(waiting)
            waiting, held = [], 0
    if waiting:
        yield made(waiting)
