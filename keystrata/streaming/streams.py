"""The same queries over streams of version-log rows and accesses.

Event time, watermarks and late data are this engine's own semantics; the store that this package
models has none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.versions import newest


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest_stream(stream: DataFrame, key: str = "key", seqno: str = "seqno") -> DataFrame:
    """The newest version of each key so far, tombstones included, for update or complete mode.

    State is one row a key; sinks drop tombstones, since state may not forget them.
    """
    others = [c for c in stream.columns if c not in (key, seqno)]
    return stream.groupBy(key).agg(F.max(seqno).alias(seqno), *(F.max_by(c, seqno).alias(c) for c in others))


def hot_keys_stream(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n) per window of event time; accesses later than the watermark are left out."""
    timed = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def statistics_stream(stream: DataFrame, value: str, by: str) -> DataFrame:
    """Running n, total, least and most of each group."""
    return stream.groupBy(by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def append_versions(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Ingests versions into a container's folder, exactly once per file, and stops at the end of the input."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_latest(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, key: str = "key", seqno: str = "seqno") -> StreamingQuery:
    """Hands the newest versions of each micro-batch, with the batch's number, to `write`.

    The number lets a sink leave out a batch that is handed over again after a failure.
    """
    return stream.writeStream.foreachBatch(lambda df, n: write(newest(df, key, seqno), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(result: DataFrame, folder: str, keys: list[str] | None = None, mode: str = "update") -> DataFrame:
    """Runs to the end of the input and gives the last row of each key, or without keys all rows.

    Every micro-batch writes the rows it changed to a folder of its number, so one that is run again
    after a failure replaces itself; state is kept beside them. The folder is one all executors share.
    """
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    spark, columns = result.sparkSession, result.columns
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/rows/_batch={n}")
    result.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    write(spark.createDataFrame([], result.schema), -1)  # so that there is a table without any input
    rows = spark.read.schema(result.schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    if keys is None:
        return rows.select(*columns)
    others = [c for c in columns if c not in keys]
    return rows.groupBy(*keys).agg(*(F.max_by(c, "_batch").alias(c) for c in others)).select(*columns)
