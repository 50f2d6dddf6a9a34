"""Files that tasks read and write themselves: any place that pyarrow's file systems reach (local, HDFS, object stores).

FileWriter is the base of data source writers with a file per task. Tasks write into a folder of the job below
`_temporary`, each attempt under a name of its own; commit moves the files of the attempts that count into place and
removes the rest, abort removes everything, so that files of failed and repeated attempts are never seen.
"""

from __future__ import annotations

import uuid
from abc import abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage


def located(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path within it) of a URI or a local path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listing(path: str, *suffixes: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files below a folder that end with a suffix and aren't hidden, sorted."""
    store, inner = located(path)
    head = path.removesuffix(inner) if "://" in path and not path.startswith("file:") else ""
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(head + info.path, info.size)]
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    below = len(inner.rstrip("/")) + 1
    seen = [f for f in found if f.type == fs.FileType.File and f.path.endswith(suffixes) and not any(p.startswith(("_", ".")) for p in f.path[below:].split("/"))]
    return sorted((head + f.path, f.size) for f in seen)


def opened(path: str):
    """A file with read, seek and size."""
    store, inner = located(path)
    return store.open_input_file(inner)


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class FileWriter(DataSourceArrowWriter):
    """Writes folder/part-<partition>-<job><extension> for each task that has rows."""

    extension = ""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder.rstrip("/"), overwrite, uuid.uuid4().hex

    @abstractmethod
    def encode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes | memoryview]:
        """The bytes of a file, part by part."""

    @property
    def _temporary(self) -> str:
        return f"{self.folder}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written | None:
        task, rows = TaskContext.get(), 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            for batch in iterator:
                rows += len(batch)
                if len(batch):
                    yield batch

        store, folder = located(self._temporary)
        name = f"part-{task.partitionId():06d}-{self.job[:12]}{self.extension}"
        path = f"{folder}/{task.taskAttemptId()}/{name}"
        out = None
        try:
            for part in self.encode(counted()):
                if out is None:
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)
                out.write(part)
        finally:
            if out is not None:
                out.close()
        return None if out is None else Written(path, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = located(self.folder)
        store.create_dir(folder, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(folder)):
                if f.type == fs.FileType.File:
                    store.delete_file(f.path)
        for m in messages:
            if m is not None:
                store.move(m.path, f"{folder}/{m.path.rpartition('/')[2]}")
        self._clear()
        with store.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, folder = located(self._temporary)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)
        above = folder.rpartition("/")[0]
        if store.get_file_info(above).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(above)):
            store.delete_dir(above)
