"""Sinks: deterministic TAR shards, atomic JSON, sorted JSON lines, verified copies."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import zipfile
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources import shared


def atomic_json(path: str, value) -> None:
    """A JSON file that appears whole or not at all; NaN is an error."""
    shared.put(path, [json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False).encode(), b"\n"])


digest = shared.digest


def verified_copy(source: str, target: str, sha256: str) -> None:
    """Copy a file that must have this digest, before it is in place and when it is read back."""
    shared.put(target, shared.blocks(source), expected=sha256)
    if shared.digest(target) != sha256:
        raise OSError(f"{target} does not read back as it was written")


def _add(archive: tarfile.TarFile, name: str, content: bytes) -> None:
    info = tarfile.TarInfo(name)
    info.size, info.mode = len(content), 0o644
    archive.addfile(info, io.BytesIO(content))


def tar_bytes(members: list[tuple[str, bytes]]) -> bytes:
    """An archive whose bytes depend on names and contents only."""
    stream = io.BytesIO()
    with tarfile.open(fileobj=stream, mode="w", format=tarfile.PAX_FORMAT) as archive:
        for name, content in members:
            _add(archive, name, content)
    return stream.getvalue()


def put_tar(location: str, members: Iterable[tuple[str, bytes]]) -> str:
    """Stream members into an archive that appears whole or not at all; returns its SHA-256."""
    with shared.Draft(location) as draft:
        with tarfile.open(fileobj=draft, mode="w", format=tarfile.PAX_FORMAT) as archive:
            for name, content in members:
                _add(archive, name, content)
                archive.members.clear()  # else it remembers every header
        return draft.publish()


def put_zip(location: str, members: Iterable[tuple[str, bytes]]) -> str:
    """A ZIP file whose bytes depend on names and contents only; returns its SHA-256."""
    stream = io.BytesIO()
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in sorted(members):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
            archive.writestr(info, content)
    return shared.put(location, [stream.getvalue()])


def put_arrays(location: str, **arrays: np.ndarray) -> str:
    """Named arrays, such as the weights of a model, in a file that appears whole or not at all; returns its SHA-256."""
    stream = io.BytesIO()
    np.savez(stream, **arrays)
    return shared.put(location, [stream.getvalue()])


def get_arrays(location: str, sha256: str | None = None) -> dict[str, np.ndarray]:
    """The arrays of `put_arrays`; another digest than the one asked for is an error."""
    data = shared.content(location)
    if sha256 is not None and hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError(f"{location} does not have the digest {sha256}")
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        return {name: held[name] for name in held.files}


def _streamed(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    """Write rows sorted by (shard_id, place) into one archive a shard, member by member."""
    rows = (r for batch in batches for r in batch[["shard_id", "member", "content"]].itertuples(index=False))
    for shard, members in groupby(rows, key=lambda r: r.shard_id):
        with shared.Draft(shared.joined(folder, f"{shard}.tar")) as draft:
            n = 0
            with tarfile.open(fileobj=draft, mode="w", format=tarfile.PAX_FORMAT) as archive:
                for r in members:
                    _add(archive, r.member, bytes(r.content))
                    archive.members.clear()  # else it remembers every header
                    n += 1
            found = draft.publish()
        yield pd.DataFrame({"shard_id": [shard], "tar_name": [f"{shard}.tar"], "tar_bytes": [draft.length], "tar_sha256": [found], "members": [n]})


def write_shards(records: DataFrame, folder: str) -> DataFrame:
    """Write one TAR for each shard_id and return (shard_id, tar_name, tar_bytes, tar_sha256, members).

    `records` has (shard_id, place, member, content). Members are streamed in order of
    place, so a task holds one Arrow batch at a time, whatever the size of a shard. A file
    appears whole under its name; a task that is run again replaces it with equal bytes.
    """
    shared.make_folder(folder)
    rows = records.select("shard_id", "place", "member", "content").repartition("shard_id").sortWithinPartitions("shard_id", "place")
    return rows.mapInPandas(lambda batches: _streamed(batches, folder), "shard_id string, tar_name string, tar_bytes long, tar_sha256 string, members long")


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines with keys in order and nulls kept."""
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def matches_manifest(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """(member, problem): what is missing, extra or different between an archive and its manifest."""
    a = members.select("member", F.col("sha256").alias("found"))
    b = manifest.select("member", F.col("sha256").alias("wanted"))
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("found") != F.col("wanted"), "different")
    return a.join(b, "member", "full").select("member", problem.alias("problem")).filter("problem IS NOT NULL")
