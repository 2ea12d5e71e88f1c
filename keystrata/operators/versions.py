"""Time-travel reads over a version log.

The order of steps matters: sequence window, newest version per key, tombstone, expiry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_window(log: DataFrame, *, after: int | None = None, up_to: int | None = None, seqno: str = "seqno") -> DataFrame:
    """Versions with after < seqno <= up_to; either bound may be open."""
    if up_to is not None:
        log = log.where(F.col(seqno) <= up_to)
    if after is not None:
        log = log.where(F.col(seqno) > after)
    return log


def newest(log: DataFrame, key: str = "key", seqno: str = "seqno") -> DataFrame:
    """The newest version of each key, tombstones included.

    An aggregation rather than a window: a key of very many versions is reduced before the shuffle.
    """
    others = [c for c in log.columns if c not in (key, seqno)]
    return log.groupBy(key).agg(F.max(seqno).alias(seqno), *(F.max_by(c, seqno).alias(c) for c in others)).select(*log.columns)


def live(log: DataFrame, *, after: int | None = None, up_to: int | None = None, key: str = "key", seqno: str = "seqno", tombstone: str = "tombstone") -> DataFrame:
    """What a reader sees: latest, a snapshot (up_to), or an increment (after and up_to).

    A tombstone that is the newest version in the window hides its key, also in an increment.
    """
    return newest(in_window(log, after=after, up_to=up_to, seqno=seqno), key, seqno).where(~F.col(tombstone))


def exact(log: DataFrame, at: int, seqno: str = "seqno") -> DataFrame:
    """The versions written at one sequence number."""
    return log.where(F.col(seqno) == at)


def count_increment(log: DataFrame, after: int, up_to: int, **names: str) -> DataFrame:
    """How many keys a backup of the window would carry: one row, n_keys."""
    return live(log, after=after, up_to=up_to, **names).agg(F.count(F.lit(1)).alias("n_keys"))
