"""A streaming source of file changes: what was written, changed or deleted below a folder since the offset before."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loomgrain.sources.files import DEFAULT_IGNORES, _located, ignore_rule

NAME = "folder_changes"
SCHEMA = "workspaceId string, path string, kind string, mtime double, size long, ts timestamp"


@dataclass
class Subtree(InputPartition):
    """A folder right below the root with all that it holds, or ('') the files of the root itself."""

    name: str
    start: int
    end: int


class FolderReader(DataSourceStreamReader):
    """Offsets are versions of the listing, one for each poll.

    A task lists one subtree, writes the listing as its part of the new version to
    the ``state`` folder and tells the difference from the version before. When a
    batch is run again, after a failure or a restart, its version is there
    already and gives the same rows. Versions that are committed go, but the last.
    """

    def __init__(self, options: dict) -> None:
        self.root, self.state = options["path"].rstrip("/"), options["state"].rstrip("/")
        self.existing = options.get("existing", "false").lower() == "true"
        lines = [*DEFAULT_IGNORES, *json.loads(options.get("patterns", "[]"))]
        self.rules = [(ignored, p.replace("\\z", r"\Z")) for ignored, p in filter(None, map(ignore_rule, lines))]

    def _versions(self) -> list[int]:
        fs, where = _located(self.state)
        found = fs.get_file_info(pafs.FileSelector(where, allow_not_found=True))
        return sorted(int(f.base_name) for f in found if f.base_name.isdigit())

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": max(self._versions(), default=0) + 1}

    def _parts(self, version: int) -> set[str]:
        fs, where = _located(f"{self.state}/{version}")
        found = fs.get_file_info(pafs.FileSelector(where, allow_not_found=True))
        return {unquote(f.base_name[:-5])[1:] for f in found if f.base_name.endswith(".json")}

    def _entered(self, relative: str) -> bool:
        hidden = relative.rsplit("/", 1)[-1].startswith(".")
        return not hidden and not (all(i for i, _ in self.rules) and any(re.search(p, f"{relative}/") for _, p in self.rules))

    def _children(self, relative: str) -> list[pafs.FileInfo]:
        fs, top = _located(self.root)
        return fs.get_file_info(pafs.FileSelector(f"{top.rstrip('/')}/{relative}".rstrip("/") or "/", allow_not_found=True))

    def partitions(self, start: dict, end: dict) -> list[Subtree]:
        names = {f.base_name for f in self._children("") if f.type == pafs.FileType.Directory and self._entered(f.base_name)}
        names |= self._parts(start["version"]) | self._parts(end["version"]) | {""}
        return [Subtree(n, start["version"], end["version"]) for n in sorted(names)]

    def _listed(self, subtree: str) -> dict[str, tuple[float, int]]:
        out: dict[str, tuple[float, int]] = {}
        waiting = [subtree]
        while waiting:
            at = waiting.pop()
            for f in self._children(at):
                path = f"{at}/{f.base_name}".lstrip("/")
                if f.type == pafs.FileType.Directory:
                    if subtree and self._entered(path):
                        waiting.append(path)
                elif not f.base_name.startswith("."):
                    out[path] = ((f.mtime_ns or 0) / 1e6, f.size or 0)
        return out

    def _part(self, version: int, subtree: str) -> str:
        return f"{self.state}/{version}/{quote('s' + subtree, safe='')}.json"

    def _saved(self, version: int, subtree: str) -> dict | None:
        fs, where = _located(self._part(version, subtree))
        try:
            with fs.open_input_stream(where) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def _save(self, version: int, subtree: str) -> None:
        """Write the listing beside its place and move it there, so that it is there whole or not at all."""
        fs, where = _located(self._part(version, subtree))
        fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
        aside = f"{where}.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(aside) as f:
            f.write(json.dumps({"ts": time.time(), "files": self._listed(subtree)}).encode())
        if self._saved(version, subtree) is None:
            fs.move(aside, where)
        else:
            fs.delete_file(aside)

    def read(self, partition: Subtree) -> Iterator[tuple]:
        if self._saved(partition.end, partition.name) is None:
            self._save(partition.end, partition.name)
        new = self._saved(partition.end, partition.name)
        old = self._saved(partition.start, partition.name) or {"files": {}}
        if partition.start == 0 and not self.existing:
            return  # what is there when the watch starts is no change
        at = datetime.fromtimestamp(new["ts"], timezone.utc)
        for path in sorted(new["files"].keys() | old["files"].keys()):
            before, after = old["files"].get(path), new["files"].get(path)
            if before != after:
                kind = "deleted" if after is None else "created" if before is None else "modified"
                yield (self.root, path, kind, *(after or before), at)

    def commit(self, end: dict) -> None:
        for version in self._versions():
            if version < end["version"]:
                fs, where = _located(f"{self.state}/{version}")
                fs.delete_dir(where)

    def stop(self) -> None:
        pass


class FolderChanges(DataSource):
    """Options: path (the folder), state (a folder that driver and executors share), patterns (JSON list of ignore rules), existing (tell of files that are there at the start)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))


def folder_changes(spark: SparkSession, folder: str, state: str, patterns: tuple[str, ...] = (), existing: bool = False) -> DataFrame:
    """A stream (workspaceId, path, kind, mtime, size, ts) of the changes below ``folder``: created, modified or deleted.

    Each trigger polls once. Hidden and ignored folders are not entered. ``state``
    belongs to one query, as its checkpoint does, and must last as long.
    """
    spark.dataSource.register(FolderChanges)
    reader = spark.readStream.format(NAME).option("path", folder).option("state", state).option("patterns", json.dumps(list(patterns)))
    return reader.option("existing", str(existing).lower()).load()
