"""What is read of many files that grow, kept in a folder of any file system.

A listing is compared with what is known only for files that changed since a mark
of modification time; the mark stays `slack` seconds behind the clock at which the
listing began, as a file may grow while others are listed (and clocks differ). Each
listing that finds something writes a version: the spans of bytes that are new. An
offset is a version's number, and the batch between two is the spans of the versions
between them, so offsets do not grow with the files, and a batch that is tried again
reads the same bytes.

Bytes known of each file lie in BUCKETS files by a hash of its name, of which a
listing reads and writes those of changed files. A version is written first, the
buckets after it; what a crash leaves undone there is done at the next start.
"""

from __future__ import annotations

import json
import os
import time
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

from pyarrow import fs

BUCKETS = 256
#: Seconds by which the mark stays behind; versions that are kept after they are committed.
SLACK_S, KEPT = 60.0, 200


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), url.path
    return fs.FileSystem.from_uri(path)


def changed_files(path: str, since: float) -> Iterator[tuple[str, int, float]]:
    """(path, size, modification time) of the files of a folder, pattern or file that changed at `since` or later; hidden ones are none."""
    hidden = lambda name: name.startswith((".", "_"))
    url = urlparse(path)
    if url.scheme in ("", "file"):
        import glob

        pending = [url.path] if os.path.exists(url.path) else glob.glob(url.path)
        while pending:
            at = pending.pop()
            if not os.path.isdir(at):
                found = [(at, os.stat(at))]
            else:
                with os.scandir(at) as entries:
                    below = list(entries)
                pending += [e.path for e in below if e.is_dir()]
                found = [(e.path, e.stat()) for e in below if not e.is_dir()]
            yield from ((name, x.st_size, x.st_mtime) for name, x in found if x.st_mtime >= since and not hidden(os.path.basename(name)))
        return
    store, name = fs.FileSystem.from_uri(path)
    info = store.get_file_info(name)
    found = store.get_file_info(fs.FileSelector(name, recursive=True)) if info.type == fs.FileType.Directory else [info]
    prefix = path.removesuffix(name)
    for x in found:
        if x.is_file and not hidden(x.base_name) and (x.mtime_ns or 0) / 1e9 >= since:
            yield prefix + x.path, x.size, (x.mtime_ns or 0) / 1e9


class Manifest:
    """Versions and known sizes of the files under `path`, in `folder`; a version has `most` bytes or so at most (0: all)."""

    def __init__(self, folder: str, path: str, most: int = 0, slack_s: float = SLACK_S):
        self.folder, self.path, self.most, self.slack_s = folder, path, most, slack_s
        self.at: dict | None = None

    def _read(self, name: str) -> dict | None:
        store, root = store_of(self.folder)
        try:
            with store.open_input_stream(f"{root}/{name}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def _write(self, name: str, value: dict) -> None:
        """Replace a file at once."""
        store, root = store_of(self.folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_new-{name}") as f:
            f.write(json.dumps(value).encode())
        store.move(f"{root}/_new-{name}", f"{root}/{name}")

    def _begin(self) -> dict:
        """The last version's number and mark; its sizes are put into the buckets, as a crash may have come between."""
        if self.at is None:
            store, root = store_of(self.folder)
            names = [x.base_name for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.base_name.startswith("version-")]
            last = self._read(max(names)) if names else None
            self.at = {"version": last["version"], "mark": last["mark"]} if last else {"version": 0, "mark": 0.0}
            if last:
                self._know(last["spans"])
        return self.at

    @staticmethod
    def _bucket(path: str) -> str:
        return f"sizes-{zlib.crc32(path.encode('utf-8', 'surrogatepass')) % BUCKETS:03d}"

    def _know(self, spans: list) -> None:
        by: dict[str, dict] = {}
        for path, _, end in spans:
            by.setdefault(self._bucket(path), {})[path] = end
        for name, sizes in by.items():
            self._write(name, (self._read(name) or {}) | sizes)

    def advance(self) -> int:
        """The last version's number, after a new one if anything is new."""
        at, began = self._begin(), time.time()
        buckets: dict[str, dict] = {}
        new, newest, unread = [], at["mark"], None
        for path, size, changed in changed_files(self.path, at["mark"]):
            name = self._bucket(path)
            if name not in buckets:
                buckets[name] = self._read(name) or {}
            newest = max(newest, changed)
            if size > buckets[name].get(path, 0):
                new.append((changed, path, buckets[name].get(path, 0), size))
        spans, left = [], self.most or float("inf")
        for changed, path, start, size in sorted(new):
            end = start + int(min(left, size - start))
            left -= end - start
            if end > start:
                spans.append([path, start, end])
            if end < size and unread is None:
                unread = changed  # the first that is not read to its end: the mark may not pass it
        if spans:
            mark = max(at["mark"], min([newest, began - self.slack_s] + [unread] * (unread is not None)))
            self.at = {"version": at["version"] + 1, "mark": mark}
            self._write(f"version-{self.at['version']:012d}", self.at | {"spans": spans})
            self._know(spans)
        return self.at["version"]

    def between(self, start: int, end: int) -> list[tuple[str, int, int]]:
        """The spans of the versions after start up to end, those of a file that follow each other as one."""
        found: dict[str, list[int]] = {}
        for version in range(start + 1, end + 1):
            row = self._read(f"version-{version:012d}")
            if row is None:
                raise FileNotFoundError(f"version {version} of the manifest {self.folder} is gone")
            for path, a, b in row["spans"]:
                found.setdefault(path, [a, b])[1] = b
        return [(path, a, b) for path, (a, b) in sorted(found.items())]

    def forget(self, version: int) -> None:
        """Delete versions that are long committed; the sizes are in the buckets."""
        store, root = store_of(self.folder)
        old = version - KEPT
        while old > 0 and store.get_file_info(f"{root}/version-{old:012d}").type == fs.FileType.File:
            store.delete_file(f"{root}/version-{old:012d}")
            old -= 1
