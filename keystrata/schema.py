"""Canonical schemas and limits.

A container is a version log: every write appends a row. What is visible is always a query over
the log: newest version per key in a window of sequence numbers, unless it is a tombstone or expired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import StoreError

VERSION_LOG = T.StructType([
    T.StructField("key", T.BinaryType(), False), T.StructField("data", T.BinaryType()), T.StructField("seqno", T.LongType(), False),
    T.StructField("tombstone", T.BooleanType(), False), T.StructField("create_time", T.LongType()), T.StructField("expiry_time", T.LongType()),
])
SNAPSHOTS = T.StructType([T.StructField("snap_seq", T.LongType(), False), T.StructField("ts", T.LongType())])
LOG_RECORDS = T.StructType([T.StructField("ord", T.LongType(), False), T.StructField("kind", T.StringType(), False), T.StructField("key", T.StringType(), False), T.StructField("data", T.StringType())])

# Limits in bytes and entries.
MAX_DATA_BYTES = 25 * 1024 * 1024
MAX_LOG_KEY_BYTES = 4000
MAX_LOG_RECORD_BYTES = 4000
MAX_CONTAINER_NAME_BYTES = 64
MAX_SNAPSHOTS = 300


def data_bytes(data: Column) -> Column:
    """Size as stored: bytes, never characters; a null has none."""
    return F.coalesce(F.octet_length(data), F.lit(0)).cast("long")


def too_big(df: DataFrame, data: str = "data", limit: int = MAX_DATA_BYTES) -> DataFrame:
    return df.where(F.octet_length(data) > limit)


def check_name(name: str) -> str:
    if not name or len(name.encode()) > MAX_CONTAINER_NAME_BYTES:
        raise StoreError("INVALID_PARAMETER", f"container name of 1 to {MAX_CONTAINER_NAME_BYTES} bytes wanted")
    return name
