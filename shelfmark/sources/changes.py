"""A stream of changes of a directory tree, by comparing its listings.

    spark.dataSource.register(TreeChanges)
    spark.readStream.format("tree_changes").option("state", "/shared/state").load("/some/folder")

Each micro-batch lists the tree again, in tasks: a folder so many levels below the root (option depth, by
default one) is a partition, and so are the files of each folder above those. A task compares its part with
what that was before, and writes what it is now in the state folder under the batch's number, so a batch
that is run again after a failure gives the same rows. The driver lists the levels above only, and holds no
files. The state folder is a path that all tasks share, or the URI of a file system that pyarrow knows.

A file that was written to within the last milliseconds (option debounce_ms, by default 200) is looked at
again until it has been left alone for so long, a hundred times at most, so that a burst of writes is one
change.
"""

import hashlib
import json
import os
import time
import uuid
from dataclasses import dataclass
from typing import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from shelfmark.sources.files import Subtree, facts, subtrees, walk


@dataclass
class Part(InputPartition):
    """A part of the tree, between two listings."""

    path: str
    whole: bool
    start: int
    end: int


class State:
    """Files of the state folder."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))

    def names(self) -> list[str]:
        from pyarrow import fs

        return [f.base_name for f in self.fs.get_file_info(fs.FileSelector(self.base, allow_not_found=True))]

    def read(self, name: str):
        """What a file holds, or None if it is not there."""
        try:
            with self.fs.open_input_stream(f"{self.base}/{name}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def write(self, name: str, content) -> None:
        """A file as a whole: nobody sees half of it."""
        self.fs.create_dir(self.base, recursive=True)
        spare = f"{self.base}/{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(spare) as f:
            f.write(json.dumps(content).encode())
        self.fs.move(spare, f"{self.base}/{name}")

    def remove(self, name: str) -> None:
        self.fs.delete_file(f"{self.base}/{name}")


class ChangesReader(DataSourceStreamReader):
    """Offsets number the listings; rows of an offset are what differs from the listing before."""

    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.bucket = options.get("bucket") or os.path.basename(self.root)
        self.state = options["state"]
        self.depth = int(options.get("depth") or 1)
        self.quiet = int(options.get("debounce_ms") or 200) * 1_000_000

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        """A new listing, whose parts are named now."""
        state = State(self.state)
        number = max((int(n.split(".")[0]) for n in state.names() if n.endswith(".parts")), default=0) + 1
        state.write(f"{number:012d}.parts", [[p.path, p.whole] for p in subtrees(self.root, self.depth)])
        return {"listing": number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """The parts of both listings: one of a folder that is gone finds its files deleted."""
        state = State(self.state)
        named = [tuple(p) for n in (start["listing"], end["listing"]) for p in state.read(f"{n:012d}.parts") or []]
        return [Part(path, whole, start["listing"], end["listing"]) for path, whole in sorted(set(named))]

    def _name(self, part: Part, number: int) -> str:
        text = f"{os.path.relpath(part.path, self.root)}/{part.whole}"
        return f"{number:012d}.{hashlib.sha256(text.encode()).hexdigest()}.json"

    def _listed(self, part: Part) -> dict:
        """Size and time of the part's files, once those that are being written are left alone."""
        found = {row[2]: [row[5], row[6]] for row in walk(self.root, Subtree(part.path, part.whole))}
        for _ in range(100):
            young = [k for k, at in found.items() if time.time_ns() - at[1] < self.quiet]
            if not young:
                break
            time.sleep(self.quiet / 1e9)
            for key in young:
                try:
                    row = facts(self.root, os.path.join(self.root, key))
                    found[key] = [row[5], row[6]]
                except FileNotFoundError:
                    del found[key]
        return found

    def read(self, partition: Part) -> Iterator[tuple]:
        state = State(self.state)
        name = self._name(partition, partition.end)
        new = state.read(name)
        if new is None:
            new = self._listed(partition)
            state.write(name, new)
        old = (state.read(self._name(partition, partition.start)) if partition.start else None) or {}
        for key, at in sorted(new.items()):
            if old.get(key) != at:
                yield self.bucket, key, "changed", at[0], at[1]
        for key in sorted(old.keys() - new.keys()):
            yield self.bucket, key, "deleted", None, None

    def commit(self, end: dict) -> None:
        state = State(self.state)
        for name in state.names():
            if name.split(".")[0].isdigit() and int(name.split(".")[0]) < end["listing"]:
                state.remove(name)


class TreeChanges(DataSource):
    """Changed and deleted files of a directory tree, as a stream."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return "bucket string, key string, op string, size long, mtime_ns long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangesReader(self.options)
