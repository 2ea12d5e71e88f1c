"""Running totals over a total order, without one task that holds all rows.

Rows are cut into key ranges at bounds from a bounded sample of keys; sums run within a range, and the
range's start is the sum of the ranges before it, a table of at most as many rows as ranges. The
choice of bounds affects only the balance, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_PER_RANGE = 64


def range_bounds(df: DataFrame, key: str, ranges: int | None = None) -> list:
    """At most ranges - 1 keys that cut df into ranges of about equal size."""
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    wanted = ranges * SAMPLE_PER_RANGE
    total = df.count()
    if ranges < 2 or not total:
        return []
    hashed = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 30))
    plain = lambda v: bytes(v) if isinstance(v, bytearray) else v
    sample = sorted(plain(r[0]) for r in df.where(F.col(key).isNotNull() & (hashed < int((1 << 30) * min(1.0, wanted / total)))).select(key).distinct().limit(4 * wanted).collect())
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def with_range(df: DataFrame, key: str, bounds: list, out: str = "_range") -> DataFrame:
    if not bounds:
        return df.withColumn(out, F.lit(0))
    # a binary search of the bounds as nested conditions
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) < F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    at = F.coalesce(search(0, len(bounds)), F.lit(0))
    return df.withColumn(out, at)


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column], ranges: int | None = None, bounds: list | None = None) -> DataFrame:
    """df with, per name, the sum of its expression over all rows up to this one in the total order.

    order must be total; its first column cuts the ranges, so it should not be one value throughout.
    bounds are those of range_bounds, if the caller has them.
    """
    cut = with_range(df, order[0], range_bounds(df, order[0], ranges) if bounds is None else bounds)
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(F.col("_range").alias("_of")).agg(*(F.sum(e).alias(f"_t{i}") for i, e in enumerate(sums.values())))
    starts = totals.select("_of", *(F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))))
    out = cut.select("*", *(F.sum(e).over(own).alias(f"_s{i}") for i, e in enumerate(sums.values())))
    out = out.join(F.broadcast(starts), F.col("_range") == F.col("_of"))  # one row a range
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(f"_s{i}") + F.col(f"_b{i}")).alias(n) for i, n in enumerate(sums)))


def row_numbers(df: DataFrame, order: list[str], out: str = "rn", ranges: int | None = None) -> DataFrame:
    """1, 2, ... in the total order."""
    return running_sums(df, order, {out: F.lit(1).cast("long")}, ranges)
