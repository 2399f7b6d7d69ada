"""Directory trees as tables: a batch source of file facts, and digests of file contents.

    spark.dataSource.register(FileTree)
    spark.read.format("file_tree").option("bucket", "b").load("/some/folder")

Each folder so many levels below the root (option depth, by default one) is a partition, and so are the
files of each folder above those, so a tree is walked by as many tasks as it has such folders. The driver
lists the levels above only.
"""

import os
import stat
from dataclasses import dataclass
from typing import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfmark.functions.digests import stream_digests

#: Folder in which a catalogue keeps its own state; walks leave it out.
STATE_FOLDER = ".shelfmark"

SCHEMA = "bucket string, prefix string, name string, key string, is_symlink boolean, symlink_target string, size long, mtime_ns long, ctime_ns long, inode long, device_id long"


@dataclass
class Subtree(InputPartition):
    """A folder to walk; whole says whether folders below it are too."""

    path: str
    whole: bool


def facts(root: str, path: str) -> tuple:
    """What a listing says of one file or link; the time is null-safe and links are not followed."""
    at = os.lstat(path)
    key = os.path.relpath(path, root).replace(os.sep, "/")
    name = key.rsplit("/", 1)[-1]
    link = stat.S_ISLNK(at.st_mode)
    born = getattr(at, "st_birthtime_ns", None)
    return key[: len(key) - len(name)], name, key, link, os.readlink(path) if link else None, at.st_size, at.st_mtime_ns, born, at.st_ino or None, at.st_dev or None


def walk(root: str, part: Subtree) -> Iterator[tuple]:
    """Facts of regular files and links; files that vanish meanwhile are left out."""
    folders = [part.path]
    while folders:
        try:
            inside = list(os.scandir(folders.pop()))
        except FileNotFoundError:
            continue
        for entry in inside:
            if entry.is_dir(follow_symlinks=False):
                if part.whole and not (entry.name == STATE_FOLDER and os.path.dirname(entry.path) == root):
                    folders.append(entry.path)
            elif entry.is_symlink() or entry.is_file(follow_symlinks=False):
                try:
                    yield facts(root, entry.path)
                except FileNotFoundError:
                    continue


def subtrees(root: str, depth: int) -> list[Subtree]:
    """The parts of a tree: folders so many levels below the root as a whole, and those above with their own files."""
    parts, level = [], [root]
    for n in range(depth):
        parts += [Subtree(p, False) for p in level]
        level = sorted(e.path for p in level for e in os.scandir(p) if e.is_dir(follow_symlinks=False) and not (n == 0 and e.name == STATE_FOLDER))
    return parts + [Subtree(p, True) for p in level]


class TreeReader(DataSourceReader):
    """Reads a tree by its top folders."""

    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.bucket = options.get("bucket") or os.path.basename(self.root)
        self.depth = int(options.get("depth") or 1)

    def partitions(self) -> list[InputPartition]:
        return list(subtrees(self.root, self.depth))

    def read(self, partition: Subtree) -> Iterator[tuple]:
        for row in walk(self.root, partition):
            yield (self.bucket, *row)


class FileTree(DataSource):
    """Facts of the files of a directory tree."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def valid_key(key, root: str = "/root") -> bool:
    """Whether a key may name a file: not empty, no '..' part, not absolute, not in the state folder."""
    parts = (key or "").split("/")
    return bool(key) and not key.startswith("/") and ".." not in parts and "\0" not in key and parts[0] != STATE_FOLDER


def place_of(key: str, root: str) -> str:
    """The path of a key's file under root; an error if the key may not name a file, or a link lies on the way."""
    if not valid_key(key):
        raise ValueError("invalid key")
    path = os.path.join(root, key)
    if os.path.realpath(os.path.dirname(path)) != os.path.normpath(os.path.join(os.path.realpath(root), os.path.dirname(key))):
        raise ValueError("a link on the way")
    return path


DIGEST_SCHEMA = "bucket string, key string, checksum_sha256 string, checksum_sha1 string, checksum_crc32 string, checksum_crc32c string, etag string, size long, mtime_ns long, readable boolean"


def hashed(files: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """Five digests of each file(bucket, key) under root, read in chunks, so no file need fit into memory.

    A file whose time or size changes while it is read has no digests. One that can't be read, or lies
    behind a link, is not readable; one that is gone has no row. Links get none.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for bucket, key in zip(batch["bucket"], batch["key"]):
                if not valid_key(key):
                    continue
                try:
                    path = place_of(key, root)
                    before = os.lstat(path)
                    if stat.S_ISLNK(before.st_mode):
                        continue
                    with open(path, "rb") as source:
                        found = stream_digests(source)
                    after = os.lstat(path)
                except FileNotFoundError:
                    continue
                except (OSError, ValueError):
                    out.append({"bucket": bucket, "key": key, "readable": False})
                    continue
                same = (before.st_mtime_ns, before.st_size) == (after.st_mtime_ns, after.st_size)
                row = found if same else {"size": after.st_size}
                out.append({"bucket": bucket, "key": key, **row, "mtime_ns": after.st_mtime_ns, "readable": True})
            kinds = {"long": "Int64", "boolean": "boolean"}
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in out], dtype=kinds.get(kind, "object")) for c, kind in map(str.split, DIGEST_SCHEMA.split(", "))})

    spread = files.select("bucket", "key").repartition(tasks or files.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(run, DIGEST_SCHEMA)


def written(uploads: DataFrame, root: str) -> DataFrame:
    """Write uploads(bucket, key, content) as files under root; (bucket, key, written, error) of each.

    A file is written beside its place and then moved there, so that nobody sees half of it and a task
    that runs again does no harm. Keys that may not name a file are refused. Nothing happens before the
    result is asked for.
    """

    def run(batches):
        import uuid

        import pandas as pd

        for batch in batches:
            out = []
            for bucket, key, content in zip(batch["bucket"], batch["key"], batch["content"]):
                error = None
                try:
                    path = place_of(key, root)
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    spare = f"{path}.{uuid.uuid4().hex}"
                    with open(spare, "wb") as f:
                        f.write(content)
                    os.replace(spare, path)
                except (OSError, ValueError) as e:
                    error = str(e)
                out.append((bucket, key, error is None, error))
            yield pd.DataFrame(out, columns=["bucket", "key", "written", "error"])

    return uploads.select("bucket", "key", "content").mapInPandas(run, "bucket string, key string, written boolean, error string")


def removed(plan: DataFrame, root: str) -> DataFrame:
    """Delete the files of plan(bucket, key) under root; (bucket, key, removed, error). A file that is gone already counts as removed.

    A key that may not name a file, or that leads through a link, is refused. Nothing happens before the
    result is asked for.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for bucket, key in zip(batch["bucket"], batch["key"]):
                error = None
                try:
                    os.remove(place_of(key, root))
                except FileNotFoundError:
                    pass
                except (OSError, ValueError) as e:
                    error = str(e)
                out.append((bucket, key, error is None, error))
            yield pd.DataFrame(out, columns=["bucket", "key", "removed", "error"])

    return plan.select("bucket", "key").distinct().mapInPandas(run, "bucket string, key string, removed boolean, error string")


def contents(spark, root: str, pattern: str = "*") -> DataFrame:
    """(key, size, content) of files small enough for a row, by Spark's own binary source."""
    base = os.path.abspath(root)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(base)
    return rows.select(F.regexp_replace(F.col("path"), f"^(file:)?/*{base.lstrip('/')}/", "").alias("key"), F.col("length").alias("size"), "content")


def fetched(rows: DataFrame, root: str) -> DataFrame:
    """Catalogue rows with content: that of the file, or the text of a link's target; null if it is gone, can't be read or may not be named.

    Content is read where the rows are, so only files of rows that are asked for are opened.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            found = []
            for key in batch["key"]:
                try:
                    path = place_of(key, root)
                    if os.path.islink(path):
                        found.append(os.readlink(path).encode())
                    else:
                        with open(path, "rb") as source:
                            found.append(source.read())
                except (OSError, ValueError):
                    found.append(None)
            yield pd.DataFrame({"bucket": batch["bucket"], "key": batch["key"], "content": pd.Series(found, dtype="object")})

    read = rows.select("bucket", "key").distinct().mapInPandas(run, "bucket string, key string, content binary")
    return rows.join(read, ["bucket", "key"])


def slice_of(content, header, size):
    """The bytes of binary content that a range header asks for; all of it if the header is none."""
    from shelfmark.functions.scalars import byte_range

    r = byte_range(header, size)
    return F.when(r.isNotNull(), F.substring(content, (r["first"] + 1).cast("int"), (r["last"] - r["first"] + 1).cast("int"))).otherwise(content)
