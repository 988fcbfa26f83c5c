"""Files and byte ranges of local and remote folders, from the driver and from tasks."""

from __future__ import annotations

import fnmatch
import re
from urllib.parse import quote

CHUNK = 1 << 20


def open_system(path: str):
    """(file system, path in it) of a URI or a local path; blanks and other characters that no URI holds are escaped."""
    from pyarrow import fs

    path = quote(re.sub(r"^file:/(?!//)", "file:///", path), safe="%/:?=&@!$'()*+,;~[]")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def list_files(path: str) -> list[tuple[str, int]]:
    """(URI, size) of the files that a path, a folder or a pattern with * names, sorted."""
    from pyarrow import fs

    star = re.search(r"[*?\[]", path)
    folder = path[: star.start()].rpartition("/")[0] if star else path
    system, name = open_system(folder)
    scheme = folder[: len(folder) - len(name)] if folder.endswith(name) and "://" in folder else "file://"
    info = system.get_file_info(name)
    if info.type == fs.FileType.File:
        return [(scheme + name, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(name, recursive=True))
    wanted = name + path[len(folder) :] if star else None
    kept = [x for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]
    return sorted((scheme + x.path, x.size) for x in kept if wanted is None or fnmatch.fnmatch(x.path, wanted))


class Ranged:
    """A file read in chunks, each byte once when read in order. fetched: the bytes read so far."""

    def __init__(self, path: str):
        system, name = open_system(path)
        self.file = system.open_input_file(name)
        self.size, self.at, self.held, self.fetched = self.file.size(), 0, b"", 0

    def read(self, at: int, n: int) -> bytes:
        """The n bytes at a place; what is held of them is not read again."""
        skip = at - self.at
        if not 0 <= skip <= len(self.held):
            self.at, self.held, skip = at, b"", 0
        lack = n - (len(self.held) - skip)
        if lack > 0:
            self.held = self.held[skip:] + self._fetch(self.at + len(self.held), max(lack, CHUNK))
            self.at, skip = at, 0
        return self.held[skip : skip + n]

    def some(self, at: int) -> bytes:
        """What is held behind a place, or else the next chunk: b"" only at the file's end."""
        skip = at - self.at
        if not 0 <= skip < len(self.held):
            self.at, self.held, skip = at, self._fetch(at, CHUNK), 0
        return self.held[skip:] if skip else self.held

    def _fetch(self, at: int, n: int) -> bytes:
        body = self.file.read_at(max(0, min(n, self.size - at)), at) if at < self.size else b""
        self.fetched += len(body)
        return body

    def find(self, mark: bytes, at: int, end: int) -> int:
        """The first place of mark in [at, end), or -1."""
        while at < end:
            body = self.some(at)
            found = body.find(mark)
            if found >= 0:
                return at + found if at + found < end else -1
            if at + len(body) >= self.size:
                return -1
            if len(body) < len(mark):
                body = self.read(at, CHUNK)
                continue
            at += len(body) - len(mark) + 1
        return -1

    def close(self) -> None:
        self.file.close()
