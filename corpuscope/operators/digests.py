"""Digests over ordered values of any number: values are sorted by a shuffle that may spill and hashed as they come by."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def joined_digests(df: DataFrame, group: str, value: str, by: str = "\n") -> DataFrame:
    """group, n and digest: SHA-256 of each group's string values, sorted and joined. The digest is one chain by its definition,
    so a group is read by one task; it holds a batch at a time. Null values count as empty."""
    kind = df.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, sha, out = None, 0, hashlib.sha256(), []
        for batch in batches:
            for g, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n and g != now:
                    out.append((now, n, sha.hexdigest()))
                    n, sha = 0, hashlib.sha256()
                sha.update(((by if n else "") + (v or "")).encode())
                now, n = g, n + 1
        if n:
            out.append((now, n, sha.hexdigest()))
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["group", "n", "digest"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(df.schema[group].dataType)
    rows = df.select(group, value).repartition(group).sortWithinPartitions(group, value)
    return rows.mapInArrow(run, f"group {kind}, n bigint, digest string").withColumnRenamed("group", group)
