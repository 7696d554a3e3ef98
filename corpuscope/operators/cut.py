"""Tables in the folder that all executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of tables that were cut in the context that drops them, if there is one.
_CUT: ContextVar[list[str] | None] = ContextVar("cut", default=None)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a session without a cluster may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written to the shared folder and read again, in every session alike."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if (made := _CUT.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def cuts_dropped(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was cut inside, by this thread; what is wanted afterwards has to be stored elsewhere before."""
    token = _CUT.set([])
    try:
        yield
    finally:
        made = _CUT.get()
        _CUT.reset(token)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
