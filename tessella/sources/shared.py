"""Files on storage that driver and executors share, by path or URI.

Plain paths and `file:` URIs are local or mounted folders; others (`hdfs:`, `s3:`, `gs:`)
go to the file system of that scheme. Used where bytes must be streamed member by
member; tables go through Spark's own sources.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterable, Iterator

from pyarrow import fs

#: Bytes read or written at once.
BLOCK = 1 << 20


def opened(location: str) -> tuple[fs.FileSystem, str]:
    """The file system of a location, and the path in it."""
    scheme, colon, rest = location.partition(":")
    if not colon or "/" in scheme or not rest.startswith("/"):
        return fs.LocalFileSystem(), os.path.abspath(location)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(location.replace("s3a:", "s3:", 1))


def joined(folder: str, *names: str) -> str:
    return "/".join([folder.rstrip("/"), *names])


def exists(location: str) -> bool:
    system, path = opened(location)
    return system.get_file_info(path).type != fs.FileType.NotFound


def is_file(location: str) -> bool:
    system, path = opened(location)
    return system.get_file_info(path).type == fs.FileType.File


def seekable(location: str):
    """A file opened for reading at any place."""
    system, path = opened(location)
    return system.open_input_file(path)


def sized(folder: str) -> list[tuple[str, int]]:
    """Sorted (location, bytes) of the plain files right in a folder; none when there is no folder."""
    system, path = opened(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((joined(folder, f.base_name), f.size) for f in found if f.type == fs.FileType.File)


def listed(folder: str, suffix: str = "") -> list[str]:
    """The locations of `sized` that end so."""
    return [p for p, _ in sized(folder) if p.endswith(suffix)]


def listed_below(folder: str) -> list[str]:
    """Sorted locations of all plain files below a folder, found by one listing."""
    system, path = opened(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
    return sorted(joined(folder, f.path[len(path) :].lstrip("/")) for f in found if f.type == fs.FileType.File)


def make_folder(folder: str) -> None:
    system, path = opened(folder)
    system.create_dir(path, recursive=True)


def remove(location: str) -> None:
    """Delete a file or a folder with all it holds; nothing happens when it is not there."""
    system, path = opened(location)
    kind = system.get_file_info(path).type
    if kind == fs.FileType.Directory:
        system.delete_dir(path)
    elif kind != fs.FileType.NotFound:
        system.delete_file(path)


def rename(old: str, new: str) -> None:
    """Move a file or folder; an existing target folder is an error."""
    system, path = opened(old)
    target = opened(new)[1]
    if system.get_file_info(target).type == fs.FileType.Directory:
        raise FileExistsError(new)
    system.move(path, target)


def blocks(location: str) -> Iterator[bytes]:
    """The bytes of a file, a block at a time."""
    system, path = opened(location)
    with system.open_input_stream(path) as stream:
        while data := stream.read(BLOCK):
            yield data


def content(location: str) -> bytes:
    return b"".join(blocks(location))


def digest(location: str) -> str:
    """SHA-256 of a file."""
    value = hashlib.sha256()
    for data in blocks(location):
        value.update(data)
    return value.hexdigest()


class Draft:
    """A file that is written under a hidden name and appears whole or not at all.

    Bytes are hashed and counted as they go. `publish` puts the file in place, replacing
    an older one; leaving the `with` block without it deletes what was written.
    """

    def __init__(self, location: str):
        self.system, self.target = opened(location)
        folder, _, name = self.target.rpartition("/")
        self.system.create_dir(folder or "/", recursive=True)
        self.hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.hidden)
        self.sha256, self.length, self.published = hashlib.sha256(), 0, False

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        self.sha256.update(data)
        self.length += len(data)
        return len(data)

    def tell(self) -> int:
        return self.length

    def publish(self, expected: str | None = None) -> str:
        """Put the file in place and return its SHA-256, which must be `expected` if that is given."""
        self.stream.close()
        found = self.sha256.hexdigest()
        if expected is not None and found != expected:
            raise ValueError(f"{self.target}: digest {found} where {expected} was expected")
        if isinstance(self.system, fs.LocalFileSystem):
            handle = os.open(self.hidden, os.O_RDONLY)
            try:
                os.fsync(handle)
            finally:
                os.close(handle)
        self.system.move(self.hidden, self.target)
        self.published = True
        return found

    def __enter__(self) -> Draft:
        return self

    def __exit__(self, *_) -> None:
        if not self.published:
            self.stream.close()
            self.system.delete_file(self.hidden)


def put(location: str, parts: Iterable[bytes], expected: str | None = None) -> str:
    """Write a file from parts, whole or not at all; returns its SHA-256."""
    with Draft(location) as draft:
        for part in parts:
            draft.write(part)
        return draft.publish(expected)
