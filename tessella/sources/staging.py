"""Local copies of archives that are checked whenever they are used, and remote folders."""

from __future__ import annotations

import hashlib
import json
import shutil
import time
from collections.abc import Callable, Iterable, Iterator

from tessella.sources import shared, sinks

#: Bytes that must stay free beside a staged archive.
RESERVE = 268_435_456


def _marker(place: str) -> dict | None:
    """What a finished copy says of itself; None where there is none or it can't be read."""
    try:
        return json.loads(shared.content(shared.joined(place, "ready.json")))
    except (OSError, ValueError):
        return None


def staged(archive: str, cache: str, release: str, sha256: str, size: int, free: Callable[[str], int] | None = None) -> tuple[str, bool]:
    """(location, whether it was there already) of a checked copy of an archive in a cache folder.

    Copies are kept by release and digest. One counts only when its marker names this
    digest and the bytes still have it; anything else is deleted and copied again. Too
    little space is an error before anything is copied.
    """
    place = shared.joined(cache, release, sha256)
    copy = shared.joined(place, archive.rpartition("/")[2])
    if _marker(place) == {"sha256": sha256, "size": size} and shared.exists(copy) and shared.digest(copy) == sha256:
        return copy, True
    shared.remove(place)
    shared.make_folder(place)
    room = (free or (lambda folder: shutil.disk_usage(shared.opened(folder)[1]).free))(place)
    if room < size + RESERVE:
        shared.remove(place)
        raise OSError(f"{size} bytes and {RESERVE} in reserve are needed in {cache}, {room} are free")
    try:
        sinks.verified_copy(archive, copy, sha256)
        sinks.atomic_json(shared.joined(place, "ready.json"), {"sha256": sha256, "size": size})
    except BaseException:
        shared.remove(place)
        raise
    return copy, False


def unstage(cache: str, release: str, sha256: str) -> None:
    """Delete a staged copy."""
    shared.remove(shared.joined(cache, release, sha256))


def built_once(cache: str, fingerprint: str, members: Callable[[], Iterable[tuple[str, bytes]]]) -> tuple[str, bool]:
    """(location, whether it was there already) of an archive that is built once for a fingerprint.

    It is used again only if its marker names the fingerprint and its bytes have the
    digest of the marker; a stale or damaged one is built anew.
    """
    place = shared.joined(cache, fingerprint)
    archive, known = shared.joined(place, "members.tar"), _marker(place)
    if known and known.get("fingerprint") == fingerprint and shared.exists(archive) and shared.digest(archive) == known.get("sha256"):
        return archive, True
    shared.remove(place)
    digest = sinks.put_tar(archive, members())
    sinks.atomic_json(shared.joined(place, "ready.json"), {"fingerprint": fingerprint, "sha256": digest})
    return archive, False


def remote_files(pages: Callable[[str, str | None], tuple[list[dict], str | None]], root: str) -> Iterator[dict]:
    """The files below a remote folder, each with its path, folder by folder and page by page.

    `pages(folder, token)` gives entries (id, name, folder, size, md5) and the next
    token. A folder reached twice, a name that is unsafe or occurs twice in a folder, and
    a file without size or checksum are errors.
    """
    waiting, seen = [(root, "")], {root}
    while waiting:
        folder, path = waiting.pop()
        names: set[str] = set()
        token: str | None = None
        while True:
            entries, token = pages(folder, token)
            for entry in entries:
                name = entry["name"]
                if name in ("", ".", "..") or any(c in name for c in "/\\:"):
                    raise ValueError(f"unsafe name {name!r} in {path or '/'}")
                if name in names:
                    raise ValueError(f"{name!r} twice in {path or '/'}")
                names.add(name)
                if entry.get("folder"):
                    if entry["id"] in seen:
                        raise ValueError(f"folder {path}{name} is reached twice")
                    seen.add(entry["id"])
                    waiting.append((entry["id"], f"{path}{name}/"))
                elif entry.get("size") is None or not entry.get("md5"):
                    raise ValueError(f"{path}{name} has no size or checksum")
                else:
                    yield entry | {"path": f"{path}{name}"}
            if token is None:
                break


def retried(call: Callable, times: int = 5, wait: float = 0.2, errors: tuple = (OSError, ValueError)):
    """What `call()` returns; after an error it is tried again, each time after twice the wait."""
    for turn in range(times):
        try:
            return call()
        except errors:
            if turn == times - 1:
                raise
            time.sleep(wait * 2**turn)


def download(files: Iterable[dict], fetch: Callable[[str], Iterable[bytes]], folder: str, times: int = 5, wait: float = 0.2) -> dict[str, int]:
    """Fetch what is absent or differs in size or MD5, trying again after errors; counts of what was kept and fetched."""
    counts = {"kept": 0, "fetched": 0}
    for file in files:
        target = shared.joined(folder, file["path"])
        if shared.exists(target) and _md5(shared.blocks(target)) == (file["md5"], file["size"]):
            counts["kept"] += 1
            continue
        retried(lambda file=file, target=target: _fetched(file, fetch, target), times, wait)
        counts["fetched"] += 1
    return counts


def _fetched(file: dict, fetch: Callable[[str], Iterable[bytes]], target: str) -> None:
    with shared.Draft(target) as draft:
        found = _md5(draft.write(part) and part or b"" for part in fetch(file["id"]))
        if found != (file["md5"], file["size"]):
            raise ValueError(f"{file['path']}: {found} where {(file['md5'], file['size'])} was expected")
        draft.publish()


def _md5(parts: Iterable[bytes]) -> tuple[str, int]:
    value, length = hashlib.md5(usedforsecurity=False), 0
    for part in parts:
        value.update(part)
        length += len(part)
    return value.hexdigest(), length
