"""A folder tree as a Spark data source: folders pruned before they are listed, planned partitions, byte ranges, a second look.

    spark.dataSource.register(TreeSource)
    spark.read.format("stratalog_tree").options(exclude="^vendor/,^node_modules/", splitBytes="33554432").load(root)

The driver lists folders only until there are PARTITIONS of them; each task lists what lies below its own. A folder whose path
matches `exclude` (searched in the path with a slash behind it) or that is version control's is never listed. Files of more than
`splitBytes` come as several rows of byte ranges. A file is looked at before and after it is read: if its size or time of change
is another then, or it can't be read, its row is `read_failed` and has no content.

Columns: path (relative), start, length (of the range), size, modified (microseconds), state (`read`, `read_failed`), content.
Links are not followed. With the option `ranges` ("path:start:end" joined by newlines, end -1 for the whole file) only these are
read, and nothing is listed. Any store that pyarrow knows can be the root.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders of version control.
CONTROL = (".git", ".hg", ".svn", ".jj")
PARTITIONS, FILES_AT_ONCE, SPLIT = 64, 200, 32 << 20
SCHEMA = "path string, start long, length long, size long, modified long, state string, content binary"


def opened(uri: str):
    """(pyarrow file system, path) of a root."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class Part(InputPartition):
    """Folders to list and files (path, start, end; end -1: whole) to read."""

    folders: tuple[str, ...] = ()
    files: tuple[tuple[str, int, int], ...] = ()

    def __post_init__(self):
        super().__init__((self.folders, self.files))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self._root = options["path"].rstrip("/")
        self._exclude = tuple(p for p in options.get("exclude", "").split(",") if p)
        self._split = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))
        self._ranges = options.get("ranges")

    def _enters(self, folder: str) -> bool:
        return folder.rsplit("/", 1)[-1] not in CONTROL and not any(re.search(p, folder + "/") for p in self._exclude)

    def _list(self, store, base: str, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        """(inner folders to enter, files with their sizes) of one folder."""
        from pyarrow import fs

        found = store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, recursive=False))
        folders, files = [], []
        for f in sorted(found, key=lambda f: f.path):
            name = f"{folder}/{f.base_name}" if folder else f.base_name
            if self._link(store, f.path):
                continue
            if f.type == fs.FileType.Directory:
                if self._enters(name):
                    folders.append(name)
            elif f.type == fs.FileType.File:
                files.append((name, f.size or 0))
        return folders, files

    @staticmethod
    def _link(store, path: str) -> bool:
        import os

        return store.type_name == "local" and os.path.islink(path)

    def _cut(self, files: list[tuple[str, int]]) -> list[tuple[str, int, int]]:
        return [(name, a, min(a + self._split, size)) for name, size in files for a in range(0, max(size, 1), self._split)]

    def partitions(self) -> list[Part]:
        if self._ranges is not None:
            asked = [line.rsplit(":", 2) for line in self._ranges.split("\n") if line]
            pieces = [(p, int(a), int(b)) for p, a, b in asked]
            return [Part((), tuple(pieces[i : i + FILES_AT_ONCE])) for i in range(0, len(pieces), FILES_AT_ONCE)]
        store, base = opened(self._root)
        waiting, files = [""], []
        while waiting and len(waiting) < PARTITIONS:
            folders, own = self._list(store, base, waiting.pop(0))
            waiting += folders
            files += self._cut(own)
        return [Part((), tuple(files[i : i + FILES_AT_ONCE])) for i in range(0, len(files), FILES_AT_ONCE)] + [Part((f,), ()) for f in waiting]

    def read(self, partition: Part) -> Iterator[tuple]:
        store, base = opened(self._root)
        for piece in partition.files:
            yield self._one(store, base, *piece)
        waiting = list(partition.folders)
        while waiting:
            folders, files = self._list(store, base, waiting.pop())
            waiting += folders
            for piece in self._cut(files):
                yield self._one(store, base, *piece)

    def _look(self, store, path: str) -> tuple[int, int]:
        f = store.get_file_info(path)
        return f.size, f.mtime_ns // 1000 if f.mtime_ns is not None else 0

    def _one(self, store, base: str, name: str, start: int, end: int) -> tuple:
        path = f"{base}/{name}"
        size = changed = None
        try:
            if ".." in name.split("/") or self._link(store, path):
                raise OSError("outside")
            size, changed = self._look(store, path)
            if size is None:
                raise OSError("gone")
            last = size if end < 0 else min(end, size)
            start = min(start, last)
            with store.open_input_file(path) as f:
                content = f.read_at(last - start, start)
            if self._look(store, path) != (size, changed) or len(content) != last - start:
                raise OSError("changed while it was read")
            return name, start, len(content), size, changed, "read", content
        except OSError:
            return name, start, None, size, changed, "read_failed", None


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stratalog_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))
