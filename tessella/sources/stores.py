"""Files of any store, opened by the prefix of their path, read on after faults, and written whole or not at all."""

from __future__ import annotations

import importlib
import io
import random
import re
import time
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable

from pyarrow import fs

#: First and longest wait between tries in seconds, and tries without progress before an error is final.
FIRST_WAIT, LONGEST_WAIT, TRIES = 0.5, 30.0, 8


def uri_parts(path: str) -> tuple[str | None, str, str]:
    """(cluster, scheme, rest) of ``cluster:s3://bucket/key``; a plain path has the scheme ``file``."""
    m = re.match(r"^(?:(\w[\w-]*):)?(\w+)://(.*)$", path)
    return (m[1], m[2], m[3]) if m else (None, "file", path.removeprefix("file:"))


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path within it; a cluster's name before the scheme is left to its settings."""
    cluster, scheme, rest = uri_parts(path)
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    return fs.FileSystem.from_uri(path[len(cluster) + 1 :] if cluster else path)


def open_at(path: str, offset: int) -> io.RawIOBase:
    """A file open for reading from ``offset``: by range over HTTP, by seeking in other stores."""
    if uri_parts(path)[1] in ("http", "https"):
        request = urllib.request.Request(path, headers={"Range": f"bytes={offset}-"} if offset else {})
        return urllib.request.urlopen(request, timeout=60)
    store, inner = filesystem(path)
    file = store.open_input_file(inner)
    file.seek(offset)
    return file


def size_of(path: str) -> int:
    if uri_parts(path)[1] in ("http", "https"):
        with urllib.request.urlopen(urllib.request.Request(path, method="HEAD"), timeout=60) as r:
            return int(r.headers["Content-Length"])
    store, inner = filesystem(path)
    return store.get_file_info(inner).size


def opener(name: str | None) -> Callable[[str, int], io.RawIOBase]:
    """``open_at``, or another function (path, offset) by its dotted name."""
    if not name:
        return open_at
    module, _, attr = name.rpartition(".")
    return getattr(importlib.import_module(module), attr)


class Steady(io.RawIOBase):
    """A seekable file that opens itself again where it stopped when reading fails.

    The wait doubles with each try without progress, times a random half to one and a half, up to a longest; any bytes read begin
    a new count.  Seeking only notes the place, so what is skipped isn't read.
    """

    def __init__(self, path: str, size: int, tries: int = TRIES, wait: float = FIRST_WAIT, how: Callable = open_at):
        self.path, self.size, self.tries, self.wait, self.how = path, size, tries, wait, how
        self.at, self.file, self.file_at = 0, None, -1

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def readinto(self, buffer) -> int:
        want = min(len(buffer), max(0, self.size - self.at))
        if not want:
            return 0
        for k in range(self.tries):
            try:
                if self.file is not None and self.file_at != self.at:
                    if self.file.seekable():
                        self.file.seek(self.at)
                    else:
                        self.drop()
                if self.file is None:
                    self.file = self.how(self.path, self.at)
                self.file_at = self.at
                got = self.file.read(want)
                if not got:
                    raise OSError(f"{self.path} ended at {self.at} of {self.size}")
                buffer[: len(got)] = got
                self.at += len(got)
                self.file_at = self.at
                return len(got)
            except OSError:
                self.drop()
                if k + 1 == self.tries:
                    raise
                time.sleep(min(LONGEST_WAIT, self.wait * 2**k) * (0.5 + random.random()))
        raise AssertionError

    def drop(self) -> None:
        if self.file is not None:
            try:
                self.file.close()
            except OSError:
                pass
        self.file = None

    def close(self) -> None:
        self.drop()
        super().close()


def listed(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, size) of the files that a comma list of files and folders names, sorted; folders are searched whole."""
    out = []
    for one in filter(None, (p.strip() for p in path.split(","))):
        if uri_parts(one)[1] in ("http", "https"):
            out.append((one, size_of(one)))
            continue
        store, inner = filesystem(one)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(one)
        found = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(suffix)]
        prefix = one[: len(one) - len(inner)] if one.endswith(inner) else ("file://" if uri_parts(one)[1] == "file" and ":" in one else "")
        out += [(prefix + f.path, f.size) for f in found if not re.search(r"(^|/)[._][^/]*$", f.path)]
    return sorted(out)


class WholeFile:
    """A file that appears under its name only when it is complete: written beside it, moved by ``done``."""

    def __init__(self, path: str):
        self.store, self.inner = filesystem(path)
        folder, _, name = self.inner.rpartition("/")
        self.beside = f"{folder}/_{name}.{uuid.uuid4().hex}"
        self.store.create_dir(folder, recursive=True)
        self.file = self.store.open_output_stream(self.beside)

    def write(self, data: bytes) -> int:
        return self.file.write(data)

    def tell(self) -> int:
        return self.file.tell()

    def flush(self) -> None:
        self.file.flush()

    def done(self) -> None:
        self.file.close()
        self.store.move(self.beside, self.inner)

    def drop(self) -> None:
        self.file.close()
        if self.store.get_file_info(self.beside).type == fs.FileType.File:
            self.store.delete_file(self.beside)


def write_whole(path: str, data: bytes) -> None:
    """Write a small file at once; it replaces one of the same name."""
    f = WholeFile(path)
    try:
        f.write(data)
    except BaseException:
        f.drop()
        raise
    f.done()


def delete(path: str) -> None:
    """Delete a file; one that isn't there is fine."""
    store, inner = filesystem(path)
    if store.get_file_info(inner).type == fs.FileType.File:
        store.delete_file(inner)
