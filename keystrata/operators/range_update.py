"""Updates of all live objects in a range by an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MAX_DATA_BYTES


def by_prefix(key: str, prefix: str) -> Column:
    """The default range: keys that begin with the prefix. Reaches the scan as a starts-with filter."""
    return F.col(key).startswith(prefix)


def range_update(live: DataFrame, in_range: Column, new: Column, changed: Column | None = None, key: str = "key", data: str = "data", limit: int = MAX_DATA_BYTES) -> DataFrame:
    """Every object in the range with its data after the update, `changed` and `status`.

    new is the data the callback would write; changed false leaves an object as it is. An object whose
    new data is over the limit is left as it is, with status OBJECT_TOO_BIG.
    """
    rows = live.where(in_range).withColumns({"_new": new, "_yes": F.lit(True) if changed is None else F.coalesce(changed, F.lit(False))})
    sized = rows.withColumn("_big", F.col("_yes") & F.coalesce(F.octet_length(F.col("_new").cast("string")) > limit, F.lit(False)))
    done = F.col("_yes") & ~F.col("_big")
    return sized.select(
        *(F.when(done, F.col("_new")).otherwise(F.col(data)).alias(c) if c == data else F.col(f"`{c}`") for c in live.columns),
        done.alias("changed"), F.when(F.col("_big"), "OBJECT_TOO_BIG").otherwise("SUCCESS").alias("status"),
    )


def changed_rows(updated: DataFrame) -> DataFrame:
    """The rows to append to the version log; their number is the count of updated objects."""
    return updated.where("changed").drop("changed", "status")
