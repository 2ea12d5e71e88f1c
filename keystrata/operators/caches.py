"""Bounded maps and containers, as queries over an access or write log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import row_numbers, running_sums


def map_create(current: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Entries of new whose key the map has not."""
    return new.join(current.select(key), key, "left_anti").select(*new.columns)


def map_update(current: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Entries of new whose key the map has."""
    return new.join(current.select(key), key, "left_semi").select(*new.columns)


def map_set(current: DataFrame, new: DataFrame, key: str = "key", data: str = "data", order: str | None = None) -> DataFrame:
    """The map after new entries are set: key, data, and old_data that was replaced (null if none).

    Of several new entries of a key the last one by `order` counts; without an order the largest data.
    """
    n = new.groupBy(key).agg((F.max_by(data, order) if order else F.max(data)).alias("_new"), F.lit(True).alias("_set"))
    both = current.select(F.col(key), F.col(data).alias("_old")).join(n, key, "full")
    return both.select(key, F.when(F.col("_set"), F.col("_new")).otherwise(F.col("_old")).alias(data), F.when(F.col("_set"), F.col("_old")).alias("old_data"))


def map_delete(current: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return current.join(keys.select(key).distinct(), key, "left_anti")


def lru_resident(access: DataFrame, max_entries: int, key: str = "key", order: str = "ord") -> DataFrame:
    """(key, last_use) of the entries that a map of max_entries holds after the accesses."""
    last = access.groupBy(key).agg(F.max(order).alias("last_use"))
    return last.orderBy(F.desc("last_use"), key).limit(max_entries)


def lru_evicted(access: DataFrame, max_entries: int, key: str = "key", order: str = "ord") -> DataFrame:
    """(key, last_use) of the entries that were replaced last, least recent ones included."""
    last = access.groupBy(key).agg(F.max(order).alias("last_use")).withColumn("_rank", -F.col("last_use"))
    return row_numbers(last, ["_rank", key], "_rn").where(F.col("_rn") > max_entries).drop("_rank", "_rn")


def fifo_retained(objects: DataFrame, size: Column, capacity: int, order: str = "ord") -> DataFrame:
    """The newest objects whose bytes, summed from the newest, fit the capacity, with that sum as `used`."""
    rows = objects.withColumns({"_back": -F.col(order), "_size": size.cast("long")})
    return running_sums(rows, ["_back"], {"used": F.col("_size")}).where(F.col("used") <= capacity).drop("_back", "_size")
