"""Files in any store: what a folder holds and byte ranges of a file, by path or URI.

Plain paths and ``file:`` are read from the machine's own file system; other schemes by the store's client
(object stores, and Hadoop's for ``hdfs:`` and ``viewfs:``), one for each store and process.
"""

from __future__ import annotations

import io
import os
import re
import shutil
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs

#: Bytes that one request reads; headers are read from the front.
BUFFER = 1 << 16
_URI = re.compile(r"([A-Za-z][A-Za-z0-9+.-]+):(?://([^/]*))?(?=/)")
_open: dict[str, fs.FileSystem] = {}


@dataclass(frozen=True)
class Entry:
    path: str
    is_folder: bool
    size: int
    modified: float
    created: float


def located(path: str) -> tuple[fs.FileSystem | None, str, str]:
    """The store of a path (None: the machine's own files), the path in it, and what the store's own paths lack in front."""
    m = _URI.match(path)
    if not m or m[1].lower() == "file":
        return None, path[m.end() :] if m else path, m[0] if m else ""
    start = m[0]
    if start not in _open:
        _open[start] = fs.FileSystem.from_uri(f"{start}/")[0]
    inner = fs.FileSystem.from_uri(path)[1]
    return _open[start], inner, path[: len(path) - len(inner)] if path.endswith(inner) else start


def entries(folder: str) -> Iterator[Entry]:
    """What a folder holds, in no set order; a folder that can't be read holds nothing. Links to folders aren't followed."""
    store, inner, front = located(folder)
    try:
        if store is None:
            with os.scandir(inner) as found:
                for e in found:
                    try:
                        s = e.stat(follow_symlinks=not e.is_dir())
                        if not (e.is_symlink() and e.is_dir()):
                            yield Entry(front + e.path, e.is_dir(follow_symlinks=False), s.st_size, s.st_mtime, s.st_ctime)
                    except OSError:
                        continue
        else:
            for i in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
                changed = (i.mtime_ns or 0) / 1e9
                yield Entry(front + i.path, i.type == fs.FileType.Directory, i.size or 0, changed, changed)
    except OSError:
        return


def opened(path: str) -> io.BufferedIOBase:
    """A file to read from the front; only what is asked for is fetched, ``BUFFER`` bytes at a time."""
    store, inner, _ = located(path)
    return open(inner, "rb", BUFFER) if store is None else io.BufferedReader(store.open_input_file(inner), BUFFER)


def file_state(path: str) -> tuple[int, float] | None:
    """Size and time of change of a file; None where there is none."""
    store, inner, _ = located(path)
    if store is None:
        try:
            s = os.stat(inner)
        except (FileNotFoundError, NotADirectoryError):
            return None
        return (s.st_size, s.st_ctime) if stat.S_ISREG(s.st_mode) else None
    i = store.get_file_info(inner)
    return (i.size, (i.mtime_ns or 0) / 1e9) if i.type == fs.FileType.File else None


def copy_named(path: str, staged: str, target: str, overwrite: bool, buffer: int) -> bool:
    """Copy a file to ``staged`` and then give it the name ``target``; False where that name was taken meanwhile."""
    store, inner, _ = located(target)
    staged_inner = located(staged)[1]
    if store is None:
        os.makedirs(os.path.dirname(staged_inner), exist_ok=True)
    else:
        store.create_dir(os.path.dirname(staged_inner))
    with opened(path) as a, open(staged_inner, "wb") if store is None else store.open_output_stream(staged_inner) as b:
        while data := a.read(buffer):
            b.write(data)
    if overwrite:
        os.replace(staged_inner, inner) if store is None else store.move(staged_inner, inner)
        return True
    if store is None:
        try:
            os.link(staged_inner, inner)  # unlike a rename, it fails where the name is taken
        except FileExistsError:
            return False
        except OSError:  # a file system without links
            if os.path.exists(inner):
                return False
            os.rename(staged_inner, inner)
            return True
        os.unlink(staged_inner)
        return True
    if file_state(target) is not None:
        return False
    store.move(staged_inner, inner)
    return True


def remove_folder(path: str) -> None:
    """Remove a folder with all it holds, if it is there."""
    store, inner, _ = located(path)
    if store is None:
        shutil.rmtree(inner, ignore_errors=True)
    elif store.get_file_info(inner).type == fs.FileType.Directory:
        store.delete_dir(inner)
