"""Change feeds, restore and the backup report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import StoreError
from ..functions.scalars import blocks_512
from .versions import in_window, newest

HOUR = 3600


def begin(previous: int | None, current: int, full: bool) -> tuple[int | None, int]:
    """The window (previous, current] of a backup; an increment needs a previous one."""
    if not full and previous is None:
        raise StoreError("INVALID_PARAMETER", "an incremental backup follows another one")
    return (None if full else previous), current


def change_feed(log: DataFrame, after: int | None, up_to: int, key: str = "key", seqno: str = "seqno", tombstone: str = "tombstone") -> DataFrame:
    """The newest version of each key in the window with op U or D. Unlike an incremental read it
    reports deletions: an extension."""
    return newest(in_window(log, after=after, up_to=up_to, seqno=seqno), key, seqno).withColumn("op", F.when(F.col(tombstone), "D").otherwise("U"))


def restore(feeds: list[DataFrame], key: str = "key", seqno: str = "seqno") -> DataFrame:
    """The live view from a full feed and increments: newest of the union, deletions left out."""
    whole = feeds[0]
    for f in feeds[1:]:
        whole = whole.unionByName(f)
    return newest(whole, key, seqno).where("op = 'U'").drop("op")


def age_histogram(objects: DataFrame, now: int, size: Column, create: str = "create_time", expiry: str | None = "expiry_time") -> DataFrame:
    """(hours, n, bytes, blocks) of objects by whole hours of age; expired ones are left out."""
    rows = objects
    if expiry:
        rows = rows.where(~F.coalesce((F.col(expiry) != 0) & (F.col(expiry) <= now), F.lit(False)))
    return rows.groupBy(F.floor((F.lit(now) - F.col(create)) / HOUR).alias("hours")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("bytes"), F.sum(blocks_512(size)).alias("blocks"))


def running_report(hist: DataFrame, by_count: bool = False, digits: int = 4) -> DataFrame:
    """The histogram with running totals and percentages, by age, or by count downwards and then age.

    One row an hour of age: the window is over the bins, never over objects.
    """
    order = [F.desc("n"), F.col("hours")] if by_count else [F.col("hours")]
    run = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy())
    return hist.select(
        F.row_number().over(Window.orderBy(*order)).alias("place"), "hours", "n", "bytes", "blocks",
        F.sum("n").over(run).alias("cum_n"), F.sum("bytes").over(run).alias("cum_bytes"), F.sum("blocks").over(run).alias("cum_blocks"),
        F.round(F.lit(100.0) * F.col("n") / total, digits).alias("pct"), F.round(F.lit(100.0) * F.sum("n").over(run) / total, digits).alias("cum_pct"),
    )


def stream_summary(objects: DataFrame, now: int, tombstone: str = "tombstone", expiry: str = "expiry_time") -> DataFrame:
    """One row: live, deleted and expired objects of a backup stream."""
    expired = F.coalesce((F.col(expiry) != 0) & (F.col(expiry) <= now), F.lit(False))
    kind = F.when(F.col(tombstone), "deleted").when(expired, "expired").otherwise("live")
    return objects.groupBy().agg(*(F.count(F.when(kind == k, 1)).alias(f"n_{k}") for k in ("live", "deleted", "expired")))


def split_by(objects: DataFrame, first: Column) -> tuple[DataFrame, DataFrame]:
    """The objects that go to the first output, and the others."""
    yes = F.coalesce(first, F.lit(False))
    return objects.where(yes), objects.where(~yes)


def write(feed: DataFrame, path: str, parts: str | None = None) -> None:
    """A feed as Parquet, maybe in folders by a column."""
    writer = feed.write.mode("errorifexists")
    (writer.partitionBy(parts) if parts else writer).parquet(path)
