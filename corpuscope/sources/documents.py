"""Documents of JSON as a data source: files with a manifest that a commit writes, read in ranges of a key.

A write's tasks leave a file each, under a name of their own; the manifest, written once all are done, says which files
count, with the least and largest key of each. An abort deletes what tasks wrote and leaves the manifest as it was. Rows
that can't be written stop the write, or are left out and counted if `failures` is `swallow`. Reads take the files of the manifest side by
side; comparisons of the key are pushed down and leave out files whose keys don't fit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from corpuscope.sources.shards import _open

MANIFEST = "manifest.json"


@dataclass
class Part(WriterCommitMessage):
    file: str
    rows: int
    failed: int
    least: object
    largest: object


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.key, self.swallow, self.overwrite = options["path"], options["key"], options.get("failures") == "swallow", overwrite

    def write(self, iterator: Iterator[Row]) -> Part:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        name, keys, rows, failed = f"{uuid.uuid4().hex}.jsonl", None, 0, 0
        with files.open_output_stream(f"{root}/{name}") as out:
            for row in iterator:
                try:
                    said = json.dumps(row.asDict(recursive=True), allow_nan=False, ensure_ascii=False) + "\n"
                except (TypeError, ValueError):
                    if not self.swallow:
                        raise
                    failed += 1
                    continue
                out.write(said.encode())
                rows += 1
                if (k := row[self.key]) is not None:
                    keys = (k, k) if keys is None else (min(keys[0], k), max(keys[1], k))
        return Part(name, rows, failed, *(keys or (None, None)))

    def commit(self, messages: list[Part | None]) -> None:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        parts = [vars(m) for m in messages if m is not None]
        old = _manifest(files, root)
        with files.open_output_stream(f"{root}/{MANIFEST}.new") as out:
            out.write(json.dumps(parts if self.overwrite else [*old, *parts]).encode())
        files.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")
        for part in old if self.overwrite else ():
            files.delete_file(f"{root}/{part['file']}")

    def abort(self, messages: list[Part | None]) -> None:
        files, root = _open(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(f"{root}/{m.file}")


def _manifest(files: fs.FileSystem, root: str) -> list[dict]:
    if files.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
        return []
    with files.open_input_stream(f"{root}/{MANIFEST}") as data:
        return json.loads(data.read())


@dataclass
class Range(InputPartition):
    file: str


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.key, self.names, self.bounds = options["path"], options["key"], schema.fieldNames(), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  (a name of the interface)
        """Comparisons of the key choose files; Spark checks all filters on rows, so none is taken from it."""
        for f in filters:
            if getattr(f, "attribute", None) == (self.key,):
                low = f.value if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)) else None
                high = f.value if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)) else None
                if low is not None or high is not None:
                    self.bounds.append((low, high))
            yield f

    def partitions(self) -> list[Range]:
        parts = _manifest(*_open(self.path))
        fits = lambda p: p["least"] is not None and all((lo is None or p["largest"] >= lo) and (hi is None or p["least"] <= hi) for lo, hi in self.bounds)
        return [Range(p["file"]) for p in parts if p["rows"] and (not self.bounds or fits(p))]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None:  # Spark reads a source without partitions once
            return
        files, root = _open(self.path)
        with files.open_input_stream(f"{root}/{partition.file}") as data:
            held = b""
            while block := data.read(1 << 20):
                *lines, held = (held + block).split(b"\n")
                for line in lines:
                    doc = json.loads(line)
                    yield tuple(doc.get(n) for n in self.names)


class Documents(DataSource):
    """Options: path, key (the column whose ranges files are chosen by), failures (`swallow` leaves out rows that can't be written)."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def reader(self, schema: StructType) -> DataSourceReader:
        return DocumentReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(self.options, overwrite)


def register(spark) -> None:
    """Make the format known to a session, and let its reads see filters."""
    spark.dataSource.register(Documents)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
