"""Byte-range files in a folder that all executors share, from Python tasks."""

from __future__ import annotations

import uuid
from collections import OrderedDict

from pyspark import TaskContext


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Appender:
    """One new file of a task attempt; made at the first append.

    The name is new for each attempt. Readers learn it from rows that Spark has committed,
    so what a failed or repeated attempt leaves behind is never read.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.name = f"{stem}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}{suffix}"
        self.folder, self.size, self.stream = folder, 0, None

    def append(self, body: bytes) -> int:
        """Offset of body in the file."""
        if self.stream is None:
            system, path = _open(self.folder)
            system.create_dir(path, recursive=True)
            self.stream = system.open_output_stream(f"{path}/{self.name}", compression=None)
        at = self.size
        self.stream.write(body)
        self.size += len(body)
        return at

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()


class RangeReader:
    """Reads ranges of files in a folder, with a few of them open at a time."""

    def __init__(self, folder: str, most_open: int = 16):
        self.system, self.path = _open(folder)
        self.files: OrderedDict[str, object] = OrderedDict()
        self.most_open = most_open

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            self.files[name] = self.system.open_input_file(f"{self.path}/{name}")
            if len(self.files) > self.most_open:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(name)
        return self.files[name].read_at(length, offset)

    def close(self) -> None:
        for f in self.files.values():
            f.close()
        self.files.clear()
