"""Event statistics and histograms that merge, and container reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import log2_bucket
from ..schema import data_bytes

BUCKETS = 64


def partial(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """The mergeable state of a group: n, total, least, most, squares and the sum of logarithms of non-zero values."""
    v = value.cast("double")
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.sum(v * v).alias("squares"), F.sum(F.when(v != 0, F.ln(v)).otherwise(F.lit(0.0))).alias("logs"),
    )


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """The state of the union of partial states."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("squares").alias("squares"), F.sum("logs").alias("logs"))


def report(state: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """n, min, max, avg, geo and std of a state, rounded.

    The geometric mean leaves zeros out of the sum of logarithms but counts them in n. std is the
    sample's, null for fewer than two values.
    """
    n = F.col("n")
    variance = F.greatest((F.col("squares") - F.col("total") * F.col("total") / n) / F.when(n > 1, n - 1), F.lit(0.0))
    r = lambda c, name: F.round(c, digits).alias(name)
    out = [n, r(F.col("least"), "min"), r(F.col("most"), "max"), r(F.col("total") / F.when(n > 0, n), "avg"), r(F.exp(F.col("logs") / F.when(n > 0, n)), "geo"), F.when(n > 1, F.round(F.sqrt(variance), digits)).alias("std")]
    return state.select(*by, *out)


def histogram(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """(by, bucket, n): how many values fall in each power-of-two bucket."""
    return df.where(value.isNotNull()).groupBy(*(by or []), log2_bucket(value).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def dense(hist: DataFrame, by: list[str]) -> DataFrame:
    """(by, counts): all BUCKETS counts of a group as an array, zeros included."""
    pairs = hist.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
    return pairs.select(*by, F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0))).alias("counts"))


def access_counts(events: DataFrame, op: str, by: list[str] | None = None) -> DataFrame:
    """How often each operation ran."""
    return events.groupBy(*(by or []), op).agg(F.count(F.lit(1)).alias("n"))


def container_stats(objects: DataFrame, container: str = "container", data: str = "data") -> DataFrame:
    """Objects and bytes of each container, and a row of all with a null container."""
    return objects.rollup(container).agg(F.count(F.lit(1)).alias("num_objs"), F.sum(data_bytes(F.col(data))).alias("used_bytes"))


def size_report(df: DataFrame, key: str = "key", data: str = "data") -> DataFrame:
    """(part, bucket, n): histograms of key and data sizes in bytes, in one pass."""
    parts = F.explode(F.array(F.struct(F.lit("key").alias("part"), F.octet_length(key).alias("size")), F.struct(F.lit("data").alias("part"), F.octet_length(data).alias("size"))))
    return histogram(df.select(parts.alias("p")).select("p.part", "p.size"), F.col("size"), ["part"])
