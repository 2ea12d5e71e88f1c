"""Log containers: records grouped by placement group, trimmed by counter.

A key is counter_pg or counter_pg_other; the counter may be empty, which is 0, and leading zeros do
not count. Records have `ord`, their place in the log, and `kind` WRITE, DELETE or TRIM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MAX_LOG_KEY_BYTES, MAX_LOG_RECORD_BYTES

# Fixed value: the key grammar.
KEY = r"^([0-9]*)_([^_]*)((?:_.*)?)$"


def decode(records: DataFrame, key: str = "key", data: str | None = "data") -> DataFrame:
    """records with counter, pg, other and status: SUCCESS, BAD_KEY, KEY_TOO_LONG or OBJECT_TOO_BIG."""
    good = F.coalesce(F.col(key).rlike(KEY), F.lit(False))
    digits = F.regexp_extract(key, KEY, 1)
    status = F.when(~good, "BAD_KEY").when(F.octet_length(key) >= MAX_LOG_KEY_BYTES, "KEY_TOO_LONG")
    if data is not None and data in records.columns:
        status = status.when(F.octet_length(key) + F.coalesce(F.octet_length(data), F.lit(0)) > MAX_LOG_RECORD_BYTES, "OBJECT_TOO_BIG")
    return records.withColumns({
        "counter": F.when(good, F.when(digits == "", 0).otherwise(F.expr(f"try_cast(regexp_extract({key}, '{KEY}', 1) AS BIGINT)")).cast("long")),
        "pg": F.when(good, F.regexp_extract(key, KEY, 2)),
        "other": F.when(good, F.regexp_extract(key, KEY, 3)),
        "status": status.otherwise("SUCCESS"),
    })


def trims(decoded: DataFrame) -> DataFrame:
    """(pg, trim): the largest trim counter of each placement group."""
    return decoded.where("kind = 'TRIM' AND status = 'SUCCESS'").groupBy("pg").agg(F.max("counter").alias("trim"))


def visible(decoded: DataFrame) -> DataFrame:
    """The last record of each key, without deletes and without what is trimmed.

    Trimming is judged on reading and includes its counter, so it also hides lower counters that were
    written after the trim. A group's trim is one row, so the join has nothing to split.
    """
    own = decoded.where("kind <> 'TRIM' AND status = 'SUCCESS'")
    others = [c for c in own.columns if c not in ("counter", "pg", "other", "ord")]
    last = own.groupBy("counter", "pg", "other").agg(F.max("ord").alias("ord"), *(F.max_by(c, "ord").alias(c) for c in others))
    rows = last.where("kind = 'WRITE'").join(trims(decoded), "pg", "left")
    return rows.where(F.col("trim").isNull() | (F.col("counter") > F.col("trim"))).select(*decoded.columns)


def enumerate_groups(decoded: DataFrame, pg: str | None = None) -> DataFrame:
    """Visible records of one placement group, or of all in order of group.

    Within a group records go by bytes of pg and other, shorter first, then by counter.
    """
    rows = visible(decoded if pg is None else decoded.where(F.col("pg") == pg))
    return rows.orderBy("pg", F.concat("pg", "other"), "counter")


def read(decoded: DataFrame, counter: int, pg: str, other: str = "") -> DataFrame:
    """The record of one key: one row or none."""
    return visible(decoded.where((F.col("pg") == pg) & ((F.col("kind") == "TRIM") | ((F.col("counter") == counter) & (F.col("other") == other)))))


def reclaim(decoded: DataFrame, active_trx: list[int] | None = None, trx: str = "trx") -> DataFrame:
    """The records to keep: those not trimmed, those of active transactions, and the last trim of each group."""
    held = F.col(trx).isin(active_trx) if active_trx and trx in decoded.columns else F.lit(False)
    rows = decoded.join(trims(decoded), "pg", "left")
    keep = F.when(F.col("kind") == "TRIM", F.col("counter") == F.col("trim")).otherwise(F.col("trim").isNull() | (F.col("counter") > F.col("trim")))
    return rows.where(F.coalesce(keep, F.lit(True)) | F.coalesce(held, F.lit(False))).select(*decoded.columns)


def revert(records: DataFrame, uncommitted: DataFrame, trx: str = "trx") -> DataFrame:
    """The records without those of transactions that a crash left open."""
    return records.join(uncommitted.select(trx).distinct(), trx, "left_anti").select(*records.columns)
