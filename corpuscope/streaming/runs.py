"""Streams that run to the end of what has arrived, in several goes that share their state, and stop."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from corpuscope.operators.cut import shared_folder


def in_goes(spark: SparkSession, arrivals: Iterable[DataFrame], schema: StructType, transform: Callable[[DataFrame], DataFrame], name: str, mode: str = "append") -> DataFrame:
    """What a stream has written after each of the arrivals has been read by a run of its own.

    Each run goes on from the checkpoint of the last one, as after a restart. A run that is repeated after a failure
    writes nothing twice: the file sink keeps a log of batches beside its files.
    """
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for rows in arrivals:
        rows.write.mode("append").parquet(f"{base}/in")
        job = transform(spark.readStream.schema(schema).parquet(f"{base}/in")).writeStream.outputMode(mode)
        job = job.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True)
        job.start().awaitTermination()
    return spark.read.parquet(f"{base}/out")
