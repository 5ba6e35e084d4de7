"""ZIP and TAR archives as DataFrame sources, through the Python data source API.

`zip_inventory` reads central directories only. `zip_members` and `tar_members` give the
bytes, checked against their CRC or length. Small archives share a partition, and
members leave one by one. Unsafe names, repeated members and encrypted entries are errors.
"""

from __future__ import annotations

import fnmatch
import hashlib
import stat
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.sources import shared

#: Suffixes of image files (fixed values).
IMAGE_SUFFIXES = (".tif", ".tiff", ".png", ".jpg", ".jpeg")


def checked_member(name: str) -> str:
    """The name, if it is relative and canonical, without '..', ':' and '\\'."""
    parts = name.split("/")
    if not name or "\\" in name or ":" in name or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"unsafe member: {name!r}")
    return name


#: Archives read by one task: up to so many bytes, or so many archives.
TASK_BYTES, TASK_FILES = 134_217_728, 1_024


class _Archives(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def _tasks(files: list[tuple[str, int]]) -> list[_Archives]:
    """Archives (path, bytes) in order, small ones together."""
    out: list[list[str]] = []
    held = 0
    for path, size in files:
        if not out or held + size > TASK_BYTES or len(out[-1]) == TASK_FILES:
            out.append([])
            held = 0
        out[-1].append(path)
        held += size
    return [_Archives(paths) for paths in out]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.pattern = options.get("pattern", self.default_pattern)

    default_pattern = "*.zip"

    def partitions(self) -> list[InputPartition]:
        if fnmatch.fnmatch(self.folder.rpartition("/")[2], self.pattern) and shared.is_file(self.folder):
            return [_Archives([self.folder])]
        return _tasks([(p, n) for p, n in shared.sized(self.folder) if fnmatch.fnmatch(p.rpartition("/")[2], self.pattern)])

    def read(self, partition) -> Iterator[tuple]:
        for path in partition.paths if partition else []:  # without any archive there is one task without a partition
            with shared.seekable(path) as file:
                yield from self.rows(path, file)


def _entries(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    seen, out = set(), []
    for info in archive.infolist():
        if info.is_dir() or not info.filename.lower().endswith(IMAGE_SUFFIXES):
            continue
        name = checked_member(info.filename)
        if name in seen:
            raise ValueError(f"member twice: {name}")
        if info.flag_bits & 1:
            raise ValueError(f"encrypted member: {name}")
        if stat.S_ISLNK(info.external_attr >> 16):
            raise ValueError(f"link as member: {name}")
        seen.add(name)
        out.append(info)
    return sorted(out, key=lambda i: i.filename)


class ZipInventoryReader(_Reader):
    def rows(self, path: str, file) -> Iterator[tuple]:
        with zipfile.ZipFile(file) as archive:
            for info in _entries(archive):
                yield path, info.filename, info.filename.rpartition("/")[2], info.file_size, f"zip-crc32:{info.CRC:08x}"


class ZipMemberReader(_Reader):
    def rows(self, path: str, file) -> Iterator[tuple]:
        with zipfile.ZipFile(file) as archive:
            for info in _entries(archive):
                content = archive.read(info)  # compares the CRC
                if len(content) != info.file_size:
                    raise ValueError(f"{info.filename}: {len(content)} bytes of {info.file_size}")
                yield path, info.filename, len(content), f"{zlib.crc32(content):08x}", bytearray(content)


class TarMemberReader(_Reader):
    default_pattern = "*.tar"

    def rows(self, path: str, file) -> Iterator[tuple]:
        seen = set()
        with tarfile.open(fileobj=file, mode="r|") as archive:
            for info in archive:
                if not info.isreg():
                    raise ValueError(f"not a plain file: {info.name!r}")
                name = checked_member(info.name)
                if name in seen:
                    raise ValueError(f"member twice: {name}")
                seen.add(name)
                content = archive.extractfile(info).read()
                yield path, name, len(content), hashlib.sha256(content).hexdigest(), bytearray(content)


class ZipInventory(DataSource):
    """Images in ZIP files, by their directories alone."""

    @classmethod
    def name(cls) -> str:
        return "zip_inventory"

    def schema(self) -> str:
        return "archive string, source_member string, file_name string, byte_size long, source_signature string"

    def reader(self, schema) -> DataSourceReader:
        return ZipInventoryReader(self.options)


class ZipMembers(DataSource):
    """Images in ZIP files with their bytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, byte_size long, crc32 string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return ZipMemberReader(self.options)


class TarMembers(DataSource):
    """Members of TAR files with their digests and bytes."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "archive string, member string, byte_size long, sha256 string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return TarMemberReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the archive sources known to the session."""
    for source in (ZipInventory, ZipMembers, TarMembers):
        spark.dataSource.register(source)
