"""Sink "committed": files on any file system that are there whole or not at all.

Tasks write into a hidden folder of their job; when all have ended well the driver
moves what they wrote to its place, and when one has failed it deletes all of it. A
stream moves a batch once: what it is about to move is noted first, and a batch that
is tried again after a crash takes away what its earlier try left.

Option kind: `pages` (the default) writes a file for each row (name, content), which
replaces one of that name; `named` writes the rows (name, value) of a name, which
follow each other in one task, as lines of a file of that name; `lines` writes the rows
(value) of each task to a file of their own. The driver moves the files, MOVERS at a
time, and holds their names, so pages and named files are for sessions by the million,
lines for rows of any number.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from runloom.sources.manifest import store_of

KINDS = {"pages": "name string, content string", "named": "name string, value string", "lines": "value string"}
#: Files that the driver moves at a time.
MOVERS = 16
#: Files that are handed to a mover at once.
HANDED = 256
#: Bytes of a file that are gathered before they are written.
BUFFER = 1 << 16
STAGING, LOG = "_staging", "_log"


@dataclass
class Staged(WriterCommitMessage):
    """What a task wrote: (file in the staging folder, name; none for lines)."""

    files: list[tuple[str, str | None]]


class _Writer:
    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.kind, self.overwrite, self.job = options["path"], options.get("kind", "pages"), overwrite, uuid.uuid4().hex
        if self.kind not in KINDS:
            raise ValueError(f"no such kind: {self.kind}")

    def _at(self) -> tuple[fs.FileSystem, str]:
        store, root = store_of(self.path)
        return store, root.rstrip("/")

    def write(self, iterator: Iterator) -> Staged:
        store, root = self._at()
        folder, files, rows = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}", [], iter(iterator)
        store.create_dir(folder, recursive=True)
        if self.kind == "lines":
            first = next(rows, None)
            if first is not None:
                with store.open_output_stream(f"{folder}/0") as f:
                    f.write((first[0] + "\n").encode("utf-8", "surrogatepass"))
                    for row in rows:
                        f.write((row[0] + "\n").encode("utf-8", "surrogatepass"))
                files.append((f"{folder}/0", None))
            return Staged(files)
        for i, (name, of_name) in enumerate(itertools.groupby(rows, lambda r: r["name"]) if self.kind == "named" else ((r["name"], [r]) for r in rows)):
            if not name or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"no name of a page: {name!r}")
            with store.open_output_stream(f"{folder}/{i}", buffer_size=BUFFER) as f:
                for row in of_name:
                    f.write(((row["value"] or "") + "\n" if self.kind == "named" else row["content"] or "").encode("utf-8", "surrogatepass"))
            files.append((f"{folder}/{i}", name))
        return Staged(files)

    def _drop(self, path: str) -> None:
        store, _ = self._at()
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)

    def _moves(self, messages: list, prefix: str) -> list[tuple[str, str]]:
        _, root = self._at()
        files = [f for m in messages if m is not None for f in m.files]
        named = [(at, f"{root}/{name}" if name else f"{root}/{prefix}-{i:06d}.jsonl") for i, (at, name) in enumerate(files)]
        if len({to for _, to in named}) < len(named):
            raise ValueError("two pages have one name")
        return named

    def _move(self, moves: list[tuple[str, str]]) -> None:
        store, _ = self._at()

        def some(part: tuple) -> None:
            for at, to in part:
                store.move(at, to)

        # Handing a file over to a thread takes longer than moving it within a local folder.
        with ThreadPoolExecutor(MOVERS) as movers:
            for _ in movers.map(some, itertools.batched(moves, max(1, min(HANDED, len(moves) // MOVERS)))):
                pass

    def _clean(self) -> None:
        _, root = self._at()
        self._drop(f"{root}/{STAGING}/{self.job}")


class _BatchWriter(_Writer, DataSourceWriter):
    def commit(self, messages: list) -> None:
        store, root = self._at()
        moves = self._moves(messages, f"part-{self.job}")
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if x.is_file:
                    store.delete_file(x.path)
        self._move(moves)
        self._clean()

    def abort(self, messages: list) -> None:
        self._clean()


class _StreamWriter(_Writer, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        store, root = self._at()
        done, begun = f"{root}/{LOG}/{batchId:012d}", f"{root}/{LOG}/{batchId:012d}-begun"
        if store.get_file_info(done).type != fs.FileType.File:
            store.create_dir(f"{root}/{LOG}", recursive=True)
            if self.kind == "lines" and store.get_file_info(begun).type == fs.FileType.File:
                with store.open_input_stream(begun) as f:
                    left = json.loads(f.read())
                for name in left:  # of a try that a crash cut off
                    if store.get_file_info(name).type == fs.FileType.File:
                        store.delete_file(name)
            moves = self._moves(messages, f"batch-{batchId:012d}")
            with store.open_output_stream(begun) as f:
                f.write(json.dumps([to for _, to in moves]).encode())
            self._move(moves)
            store.move(begun, done)
        self._clean()

    def abort(self, messages: list, batchId: int) -> None:
        self._clean()


class CommittedSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def schema(self) -> str:
        return KINDS[self.options.get("kind", "pages")]

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BatchWriter(self.options, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self.options)


def write_committed(rows: DataFrame, path: str, kind: str = "pages", mode: str = "append") -> None:
    """Write rows (name, content) as pages, (name, value) as named files, or (value) as lines, all or none of them."""
    rows.sparkSession.dataSource.register(CommittedSink)
    names = [x.split()[0] for x in KINDS[kind].split(", ")]
    rows.select(*names).write.format("committed").option("kind", kind).mode(mode).save(path)
