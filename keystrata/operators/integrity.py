"""Integrity checks: rows (entity, id, error, msg) for every violation; none for a sound container."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _report(rows: DataFrame, entity: str, id_: str, error: str, msg) -> DataFrame:
    return rows.select(F.lit(entity).alias("entity"), F.col(id_).cast("string").alias("id"), F.lit(error).alias("error"), msg.alias("msg"))


def check_order(stored: DataFrame, node: str, place: str, key: str = "key") -> DataFrame:
    """Keys that do not ascend within a node."""
    from pyspark.sql import Window

    before = F.lag(key).over(Window.partitionBy(node).orderBy(place))
    return _report(stored.withColumn("_before", before).where(F.col("_before") >= F.col(key)), "node", node, "KEY_ORDER", F.concat_ws(" ", F.lit("key"), F.col(key).cast("string"), F.lit("after"), F.col("_before").cast("string")))


def check_duplicates(log: DataFrame, key: str = "key", seqno: str = "seqno") -> DataFrame:
    """Versions of a key with one number."""
    twice = log.groupBy(key, seqno).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _report(twice, "version", key, "DUPLICATE_SEQNO", F.concat_ws(" ", F.lit("seqno"), F.col(seqno).cast("string"), F.lit("occurs"), F.col("n").cast("string"), F.lit("times")))


def check_bounds(stored: DataFrame, bounds: DataFrame, node: str, key: str = "key") -> DataFrame:
    """Keys outside the bounds of their node; bounds: node, low, high."""
    rows = stored.join(bounds, node).where((F.col(key) < F.col("low")) | (F.col(key) >= F.col("high")))
    return _report(rows, "node", node, "KEY_BOUNDS", F.concat_ws(" ", F.lit("key"), F.col(key).cast("string")))


def check_count(rows: DataFrame, expected: DataFrame, group: str) -> DataFrame:
    """Groups whose rows are not as many as expected; expected: group, n."""
    found = rows.groupBy(group).agg(F.count(F.lit(1)).alias("found"))
    both = found.join(expected.select(group, F.col("n").alias("wanted")), group, "full").where(~F.coalesce("found", F.lit(0)).eqNullSafe(F.coalesce("wanted", F.lit(0))))
    return _report(both, "container", group, "OBJECT_COUNT", F.concat_ws(" ", F.lit("found"), F.coalesce("found", F.lit(0)).cast("string"), F.lit("wanted"), F.coalesce("wanted", F.lit(0)).cast("string")))


def check_references(children: DataFrame, parents: DataFrame, child: str, parent: str) -> DataFrame:
    """Rows that refer to nothing."""
    return _report(children.join(parents.select(F.col(parent).alias("_p")).distinct(), F.col(child) == F.col("_p"), "left_anti"), "reference", child, "UNREACHABLE", F.lit("no such row"))


def with_crc(rows: DataFrame, data: str = "data", out: str = "crc") -> DataFrame:
    return rows.withColumn(out, F.crc32(F.coalesce(F.col(data).cast("string"), F.lit("")).cast("binary")))


def check_crc(rows: DataFrame, key: str = "key", data: str = "data", crc: str = "crc") -> DataFrame:
    """Rows whose data do not have the checksum stored with them."""
    bad = with_crc(rows, data, "_now").where(~F.col("_now").eqNullSafe(F.col(crc)))
    return _report(bad, "object", key, "CHECKSUM", F.lit("data changed"))


def check(*reports: DataFrame) -> DataFrame:
    """All reports as one."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out
