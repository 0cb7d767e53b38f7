"""Workspace bookkeeping on the driver: walking, confinement, configuration, the writer lease, schema versions."""

from __future__ import annotations

import hashlib
import json
import os
import time
import tomllib
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..session import ship_package
from ..sources import tree

#: Folders of version control that a walk never enters.
CONTROL_FOLDERS = (".git", ".hg", ".svn", ".jj")


def relative_path(root: str, path: str) -> str:
    """The canonical path below the root; an error where it leads out of it (links included)."""
    base, full = Path(root).resolve(), (Path(root) / path).resolve()
    if full != base and base not in full.parents:
        raise ValueError(f"{path} leaves {root}")
    return PurePosixPath(full.relative_to(base)).as_posix()


def canonical_path(path: Column) -> Column:
    """The same for a path's text, by its parts: null where it is absolute or leads out."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    zero = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))

    def step(acc, part):
        up = part == ".."
        left = F.slice(acc["at"], F.lit(1), F.greatest(F.size(acc["at"]) - 1, F.lit(0)))
        return F.struct(F.when(up, left).otherwise(F.concat(acc["at"], F.array(part))).alias("at"), (acc["out"] | (up & (F.size(acc["at"]) == 0))).alias("out"))

    found = F.aggregate(parts, zero, step)
    return F.when(path.startswith("/") | found["out"], F.lit(None)).otherwise(F.array_join(found["at"], "/"))


def walk(root: str, prune: bool = True) -> list[str]:
    """Relative paths of the regular files below the root, sorted; links and version control are left out, and with
    `prune` folders that the path rules exclude are not entered."""
    import re

    from ..functions import vocab

    excluded = [re.compile(p) for code, _, patterns in vocab.PATH_RULES for p in patterns if p.endswith("/")]
    out = []
    for folder, inner, names in os.walk(root, followlinks=False):
        here = PurePosixPath(Path(folder).relative_to(root).as_posix())
        keep = [d for d in inner if d not in CONTROL_FOLDERS and not (Path(folder) / d).is_symlink()]
        if prune:
            keep = [d for d in keep if not any(p.search(f"{here / d}/") for p in excluded)]
        inner[:] = sorted(keep)
        out += [(here / n).as_posix() for n in names if not (Path(folder) / n).is_symlink()]
    return sorted(out)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content, content_hash, state of the files below a root that only Spark may be able to read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root), r"^[a-z]+:/*", "/")
    path = F.regexp_replace(F.replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), base, F.lit("")), "^/", "")
    rows = found.select(path.alias("path"), "content")
    rows = rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, CONTROL_FOLDERS))))
    return rows.select("path", "content", F.sha2("content", 256).alias("content_hash"), X.classify_path(F.col("path"))["state"].alias("state"))


@dataclass(frozen=True)
class Config:
    """What a workspace's TOML file may say; unknown sections are an error."""

    root: str = "."
    exclude: tuple[str, ...] = ()
    providers: dict[str, dict] = field(default_factory=dict)
    min_confidence: float = 0.0

    @classmethod
    def parse(cls, text: str) -> Config:
        raw = tomllib.loads(text)
        if unknown := set(raw) - {"workspace", "policy", "providers", "evidence"}:
            raise ValueError(f"unknown sections {sorted(unknown)}")
        return cls(raw.get("workspace", {}).get("root", "."), tuple(raw.get("policy", {}).get("exclude", ())), raw.get("providers", {}), float(raw.get("evidence", {}).get("min_confidence", 0.0)))


def read_tree(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """path, content, content_hash, modified, state of the files below a root: folders that the configuration excludes are not
    listed, and files are read by tasks (sources.tree)."""
    spark.dataSource.register(tree.TreeSource)
    config = config or Config()
    found = ship_package(spark).read.format("stratalog_tree").option("exclude", ",".join(config.exclude)).option("splitBytes", str(1 << 62)).load(root)
    state = F.when(F.col("state") == "read_failed", "read_failed").otherwise(X.classify_path(F.col("path"))["state"])
    rows = found.select("path", "content", F.sha2("content", 256).alias("content_hash"), "modified", state.alias("state"))
    for pattern in config.exclude:  # patterns that name files
        rows = rows.where(~F.col("path").rlike(pattern))
    return rows


def exact_ranges(spark: SparkSession, root: str, asked: DataFrame) -> DataFrame:
    """path, start_byte, end_byte, status, source of asked ranges (path, content_hash, start_byte, end_byte) of indexed files.

    A file is read whole once, looked at before and after, and its hash compared: `verified` with the range's bytes, else
    `hash_mismatch` or `read_failed` without. Ranges are cut to the file's size. Paths of a request: they go to the reader as
    a list.
    """
    spark.dataSource.register(tree.TreeSource)
    paths = [r.path for r in asked.select("path").distinct().toLocalIterator()]
    ranges = "\n".join(f"{p}:0:-1" for p in paths)
    files = ship_package(spark).read.format("stratalog_tree").option("ranges", ranges).load(root).select("path", F.col("content").alias("_content"), F.col("state").alias("_state"))
    rows = asked.join(files, "path", "left")
    status = F.when(F.col("_content").isNull(), "read_failed").when(F.sha2("_content", 256) == F.col("content_hash"), "verified").otherwise("hash_mismatch")
    source = F.when(status == "verified", F.substring("_content", (F.col("start_byte") + 1).cast("int"), F.greatest(F.col("end_byte") - F.col("start_byte"), F.lit(0)).cast("int")))
    return rows.select("path", "start_byte", "end_byte", status.alias("status"), source.alias("source"))


class WriterLease:
    """One writer at a time, by a lock file that is made exclusively."""

    def __init__(self, folder: str, stale_after: float = 60.0):
        self._file, self._stale = Path(folder) / "writer.lock", stale_after

    def holder(self) -> str | None:
        return json.loads(self._file.read_text())["holder"] if self._file.exists() else None

    def acquire(self, holder: str) -> None:
        """Taken where there is none, by the same holder again, or from one whose heartbeat is too old; else an error."""
        body = json.dumps({"holder": holder, "at": time.time()})
        try:
            fd = os.open(self._file, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            have = json.loads(self._file.read_text())
            if have["holder"] != holder and time.time() - have["at"] <= self._stale:
                raise PermissionError(f"{have['holder']} is writing") from None
            tmp = self._file.with_suffix(f".{holder}")
            tmp.write_text(body)
            os.replace(tmp, self._file)
            return
        with os.fdopen(fd, "w") as f:
            f.write(body)

    def heartbeat(self, holder: str) -> None:
        if self.holder() != holder:
            raise PermissionError("not the holder")
        self.acquire(holder)

    def release(self, holder: str) -> None:
        if self.holder() == holder:
            self._file.unlink()


class Schema:
    """Ordered migrations of a folder; each is applied once, and its checksum must not change after that."""

    def __init__(self, folder: str, migrations: list[tuple[str, str]]):
        self._file, self._migrations = Path(folder) / "schema.json", migrations

    def applied(self) -> dict[str, str]:
        return json.loads(self._file.read_text()) if self._file.exists() else {}

    def apply_all(self) -> list[str]:
        have, done = self.applied(), []
        if newer := [n for n in have if n not in dict(self._migrations)]:
            raise ValueError(f"written by a newer version: {newer}")
        for name, body in self._migrations:
            digest = hashlib.sha256(body.encode()).hexdigest()
            if have.get(name, digest) != digest:
                raise ValueError(f"{name} was changed after it was applied")
            if name not in have:
                have[name] = digest
                done.append(name)
        tmp = self._file.with_suffix(".tmp")
        tmp.write_text(json.dumps(have))
        os.replace(tmp, self._file)
        return done


def unregister_preview(folder: str) -> tuple[list[tuple[str, str, str]], str]:
    """[(kind, path, sha256)] of what a workspace's folder holds, sorted, and one digest of it; nothing is deleted."""
    rows = []
    for path in sorted(Path(folder).rglob("*")):
        kind = "link" if path.is_symlink() else "folder" if path.is_dir() else "file"
        rows.append((kind, path.relative_to(folder).as_posix(), hashlib.sha256(path.read_bytes()).hexdigest() if kind == "file" else ""))
    rows.sort()
    return rows, hashlib.sha256("\n".join("\x1f".join(r) for r in rows).encode()).hexdigest()
