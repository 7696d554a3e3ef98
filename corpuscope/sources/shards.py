"""Files of raw bytes as a data source: one file for each row, committed together.

Tasks write under names of their own beside the target and tell the driver what they wrote; a commit gives the files their
names and an abort deletes them, so a task that runs twice leaves one file and a job that fails leaves none. Paths may be of
any file system that Arrow knows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

_NAME = re.compile(r"(?P<part>[A-Za-z0-9_]+)\.(?P<shard>[0-9]+)\.bin")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ShardWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = _open(self.path)
        done = []
        for row in iterator:
            name, held = f"{row.part}.{row.shard:08d}.bin", f".{uuid.uuid4().hex}.part"
            if not _NAME.fullmatch(name):
                raise ValueError(f"a part's name has letters, digits and underscores only: {row.part}")
            files.create_dir(root, recursive=True)
            with files.open_output_stream(f"{root}/{held}") as out:
                out.write(row.data or b"")
            done.append((held, name))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(root)):
                if _NAME.fullmatch(old.base_name):
                    files.delete_file(old.path)
        for held, name in (f for m in messages if m is not None for f in m.files):
            files.move(f"{root}/{held}", f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        for held, _ in (f for m in messages if m is not None for f in m.files):
            if files.get_file_info(f"{root}/{held}").type != fs.FileType.NotFound:
                files.delete_file(f"{root}/{held}")


@dataclass
class ShardFile(InputPartition):
    path: str
    part: str
    shard: int


class ShardReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[ShardFile]:
        files, root = _open(self.path)
        found = [(x.path, _NAME.fullmatch(x.base_name)) for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True))]
        return [ShardFile(path, m["part"], int(m["shard"])) for path, m in sorted(found, key=lambda f: f[0]) if m]

    def read(self, partition: ShardFile | None) -> Iterator[tuple[str, int, bytes]]:
        if partition is None:  # Spark reads a source without partitions once
            return
        files, _ = _open(self.path)
        with files.open_input_stream(partition.path) as data:
            yield partition.part, partition.shard, data.read()


class Shards(DataSource):
    """Rows of part, shard and data are files `<part>.<shard>.bin` in a folder."""

    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> str:
        return "part string, shard bigint, data binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShardReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ShardWriter(self.options["path"], overwrite)
