"""Hot keys and hot clients.

Counts are exact; the order is total, count downwards and then name. `approximate` uses a sketch of
bounded size where exact counts of all keys would be too many to shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Command numbers and the class they count for.
GET_COMMANDS = range(1, 3)
UPDATE_COMMANDS = range(3, 12)


def classify(command: Column) -> Column:
    return F.when(command.isin(*GET_COMMANDS), "GET").when(command.isin(*UPDATE_COMMANDS), "UPDATE")


def counts(access: DataFrame, item: str = "key", by_client: str | None = None, by_op: str | None = None) -> DataFrame:
    """How often each item was used: overall, by client, by operation, or both."""
    return access.where(F.col(item).isNotNull()).groupBy(*(c for c in (by_client, by_op) if c), item).agg(F.count(F.lit(1)).alias("n"))


def top(counted: DataFrame, n: int, item: str = "key") -> DataFrame:
    """The n largest counts."""
    return counted.where("n > 0").orderBy(F.desc("n"), item).limit(n)


def top_in_each(counted: DataFrame, n: int, group: str, item: str = "key") -> DataFrame:
    """The n largest counts of each group, with rank; ranks are cut before and after the shuffle."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), item))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n)


def intervals(access: DataFrame, ts: Column, width: int, item: str = "key", op: str | None = None) -> DataFrame:
    """(start, item, n): counts per interval of `width` seconds, the history's snapshots."""
    start = (F.floor(ts / width) * width).alias("start")
    return access.groupBy(start, *([op] if op else []), item).agg(F.count(F.lit(1)).alias("n"))


def history(snapshots: DataFrame, now: int, age: int, n: int, item: str = "key", where: Column | None = None) -> DataFrame:
    """The top items of the snapshots no older than `age` seconds, maybe of one operation or client only."""
    kept = snapshots.where((F.col("start") <= now) & (F.col("start") >= now - age))
    if where is not None:
        kept = kept.where(where)
    return top(kept.groupBy(item).agg(F.sum("n").alias("n")), n, item)


def approximate(access: DataFrame, n: int, item: str = "key", tracked: int = 10_000) -> DataFrame:
    """About the n hottest items, from one sketch a task of at most `tracked` items."""
    sketch = access.agg(F.expr(f"approx_top_k({item}, {int(n)}, {int(tracked)})").alias("t"))
    return sketch.select(F.explode("t").alias("t")).select(F.col("t.item").alias(item), F.col("t.count").alias("n"))
