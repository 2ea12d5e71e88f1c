"""Snapshots and garbage collection of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import StoreError
from ..schema import MAX_SNAPSHOTS


def create(snapshots: DataFrame, log: DataFrame, ts: int, seqno: str = "seqno", limit: int = MAX_SNAPSHOTS) -> DataFrame:
    """snapshots and a new one of everything written so far."""
    if snapshots.count() >= limit:
        raise StoreError("TOO_MANY_SNAPSHOTS")
    new = log.agg(F.coalesce(F.max(seqno), F.lit(0)).cast("long").alias("snap_seq")).select("snap_seq", F.lit(ts).cast("long").alias("ts"))
    return snapshots.unionByName(new)


def delete(snapshots: DataFrame, snap_seq: int) -> DataFrame:
    if snapshots.where(F.col("snap_seq") == snap_seq).isEmpty():
        raise StoreError("SNAPSHOT_NOT_FOUND", str(snap_seq))
    return snapshots.where(F.col("snap_seq") != snap_seq)


def listed(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy("snap_seq")


def sequence_numbers(snapshots: DataFrame) -> list[int]:
    """At most MAX_SNAPSHOTS numbers."""
    return sorted(r["snap_seq"] for r in snapshots.select("snap_seq").distinct().collect())


def owner(seqno: Column, snaps: list[int]) -> Column:
    """The smallest snapshot that has the version: the least number >= seqno; -1, the active part, without one."""
    if not snaps:
        return F.lit(-1).cast("long")
    later = F.filter(F.array(*(F.lit(s).cast("long") for s in sorted(snaps))), lambda s: s >= seqno)
    return F.coalesce(F.array_min(later), F.lit(-1).cast("long"))


def scavenge(log: DataFrame, snaps: list[int], key: str = "key", seqno: str = "seqno", tombstone: str = "tombstone") -> DataFrame:
    """The versions to keep: the newest of each key and owner, then without dead tombstones.

    A newest tombstone goes too if the key had older versions and none of them was kept. A tombstone
    that is alone stays. Reads of the latest state and of every snapshot do not change.
    """
    own = log.withColumn("_owner", owner(F.col(seqno), snaps))
    others = [c for c in log.columns if c not in (key, seqno)]
    kept = own.groupBy(key, "_owner").agg(F.max(seqno).alias(seqno), F.count(F.lit(1)).alias("_n"), *(F.max_by(c, seqno).alias(c) for c in others))
    runs = Window.partitionBy(key)
    kept = kept.withColumns({"_versions": F.sum("_n").over(runs), "_kept": F.count(F.lit(1)).over(runs)})  # at most one row a snapshot
    dead = F.col(tombstone) & (F.col("_versions") > 1) & (F.col("_kept") == 1)
    return kept.where(~dead).select(*log.columns)


def diff(log: DataFrame, older: int, newer: int, key: str = "key", seqno: str = "seqno", tombstone: str = "tombstone") -> DataFrame:
    """(key, change): keys added, removed or changed between two snapshots. An extension."""
    from .versions import live

    names = {"key": key, "seqno": seqno, "tombstone": tombstone}
    a = live(log, up_to=older, **names).select(key, F.col(seqno).alias("_a"))
    b = live(log, up_to=newer, **names).select(key, F.col(seqno).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")
