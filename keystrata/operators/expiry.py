"""Expiry, flush time and deletion by prefix.

Reading and sweeping differ at equality on purpose: an object is expired for a reader from its expiry
time on, and swept only after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import key_prefix


def is_expired(now: int, expiry: str = "expiry_time") -> Column:
    return F.lit(now != 0) & (F.col(expiry) > 0) & (F.col(expiry) <= now)


def is_flushed(now: int, flush_time: int, create: str = "create_time") -> Column:
    return F.lit(0 < flush_time <= now) & (F.col(create) <= flush_time)


def read_status(live: DataFrame, now: int, flush_time: int = 0, expiry: str = "expiry_time", create: str = "create_time") -> DataFrame:
    """live with status EXPIRED or SUCCESS for a reader at `now`; 0 asks for no check."""
    return live.withColumn("status", F.when(F.coalesce(is_expired(now, expiry), F.lit(False)) | F.coalesce(is_flushed(now, flush_time, create), F.lit(False)), "EXPIRED").otherwise("SUCCESS"))


def readable(live: DataFrame, now: int, flush_time: int = 0, expiry: str = "expiry_time", create: str = "create_time") -> DataFrame:
    return read_status(live, now, flush_time, expiry, create).where("status = 'SUCCESS'").drop("status")


def sweep(live: DataFrame, now: int, flush_time: int = 0, expiry: str = "expiry_time", create: str = "create_time") -> DataFrame:
    """What a sweep at `now` leaves: gone are expiry < now and creation < flush time."""
    gone = ((F.col(expiry) > 0) & (F.col(expiry) < now)) | (F.lit(flush_time > 0) & (F.col(create) < flush_time))
    return live.where(~F.coalesce(gone, F.lit(False)))


def registrations(events: DataFrame, prefix: str = "prefix", start_time: str = "start_time", order: str = "ord") -> DataFrame:
    """The prefixes to delete by: registering one again replaces its start time."""
    return events.groupBy(prefix).agg(F.max_by(start_time, order).alias(start_time))


def delete_by_prefix(live: DataFrame, prefixes: DataFrame, delimiter: str, key: str = "key", create: str = "create_time") -> DataFrame:
    """live without objects whose prefix is registered and that are no newer than its start time.

    prefixes has prefix and start_time, one row a prefix: an equality join on the prefix decides, so
    nothing is broadcast unless Spark finds it small.
    """
    of = prefixes.select(F.col("prefix").alias("_p"), F.col("start_time").alias("_t"))
    rows = live.withColumn("_prefix", key_prefix(F.col(key), delimiter))
    return rows.join(of, (F.col("_prefix") == F.col("_p")) & (F.col(create) <= F.col("_t")), "left_anti").drop("_prefix")
