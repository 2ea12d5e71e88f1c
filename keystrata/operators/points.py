"""Point reads and writes with their conditions.

Writes return the rows to append to the version log, never a changed table. A write's batch has the
columns of the log but seqno; numbers follow the order of `ord`.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import StoreError
from ..functions.ordered import row_numbers
from .versions import live, newest

#: Rows of keys that may be broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 100_000


def get(live: DataFrame, value: Any, key: str = "key") -> DataFrame:
    """The live object of one key: one row or none."""
    return live.where(F.col(key) == value)


def multi_get(live: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The live objects of many keys; keys has that column. Small key tables, by count, are broadcast."""
    wanted = keys.select(key).distinct()
    return live.join(F.broadcast(wanted) if wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else wanted, key, "left_semi")


def live_of(log: DataFrame, keys: DataFrame, key: str = "key", **window) -> DataFrame:
    """The live view of a log for the given keys only.

    Versions of other keys are left out at the scan, before the aggregation by key, so a write of few
    keys does not shuffle the whole log.
    """
    return live(multi_get(log, keys, key), key=key, **window)


def read(live: DataFrame, value: Any, key: str = "key") -> Any:
    """The row of one key; raises OBJECT_UNKNOWN."""
    rows = get(live, value, key).limit(1).collect()
    if not rows:
        raise StoreError("OBJECT_UNKNOWN", f"{value!r}")
    return rows[0]


def insert(live: DataFrame, batch: DataFrame, key: str = "key") -> DataFrame:
    """The rows of the batch whose key is not live."""
    return batch.join(live.select(key), key, "left_anti").select(*batch.columns)


def update(live: DataFrame, batch: DataFrame, key: str = "key") -> DataFrame:
    """The rows of the batch whose key is live."""
    return batch.join(live.select(key), key, "left_semi").select(*batch.columns)


def delete(live: DataFrame, keys: DataFrame, key: str = "key", tombstone: str = "tombstone") -> DataFrame:
    """Tombstones for those of the keys that are live; a missing key is not found and writes nothing."""
    empty = [F.lit(None).cast(live.schema[c].dataType).alias(c) if c not in (key, tombstone) else F.lit(True).alias(c) if c == tombstone else F.col(key) for c in live.columns]
    return multi_get(live, keys, key).select(*empty)


def force_delete(log: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The log without any version of the keys: no tombstone stays. For garbage collection only."""
    return log.join(keys.select(key).distinct(), key, "left_anti")


def numbered(batch: DataFrame, base: int, order: list[str], seqno: str = "seqno") -> DataFrame:
    """The batch with seqno base + 1, base + 2, ... in a total order; the same for any data layout."""
    return row_numbers(batch, order, seqno).withColumn(seqno, F.col(seqno) + F.lit(base))


def multi_put(live: DataFrame, batch: DataFrame, mode: str = "set", key: str = "key", order: str = "ord") -> DataFrame:
    """The rows of a batch that get written, in `order`, which is unique.

    mode "insert" stops before the first key that is live or came earlier in the batch, "update" before
    the first that is not live; rows before it stay written. "set" writes all.
    """
    if mode == "set":
        return batch
    if mode not in ("insert", "update"):
        raise StoreError("INVALID_PARAMETER", f"mode {mode!r}")
    if mode == "update":
        bad = batch.join(live.select(key), key, "left_anti").select(order)
    else:
        first = batch.groupBy(key).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
        again = batch.join(first.where("_n > 1"), key).where(F.col(order) > F.col("_first")).select(order)
        bad = batch.join(live.select(key), key, "left_semi").select(order).union(again)
    stop = bad.agg(F.min(order).alias("_stop"))  # one row
    return batch.join(F.broadcast(stop), F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def conditional_put(live: DataFrame, batch: DataFrame, applies: Callable[[Column, Column], Column], key: str = "key", data: str = "data", order: str = "ord") -> DataFrame:
    """The rows of the batch that apply, one after the other in `order`: applies(old data, new data).

    New keys always apply. Duplicates within the batch see the data that the ones before them left;
    a key's rows are folded in one expression. A predicate such as new > old needs no fold: see put_if_greater.
    """
    fields = F.struct(F.col(order).alias("o"), F.col(data).alias("d"), F.struct(*(F.col(f"`{c}`") for c in batch.columns)).alias("row"))
    grouped = batch.groupBy(key).agg(F.array_sort(F.collect_list(fields)).alias("_new")) if batch.schema[data].dataType.simpleString() != "binary" else batch.groupBy(key).agg(F.sort_array(F.collect_list(fields)).alias("_new"))
    old = live.select(F.col(key).alias("_k"), F.col(data).alias("_old"), F.lit(True).alias("_some"))
    both = grouped.join(old, F.col(key) == F.col("_k"), "left")
    row = batch.schema.simpleString()
    kind = batch.schema[data].dataType.simpleString()
    begin = F.struct(F.coalesce("_some", F.lit(False)).alias("some"), F.col("_old").cast(kind).alias("d"), F.array().cast(f"array<{row}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        yes = ~acc["some"] | F.coalesce(applies(acc["d"], x["d"]), F.lit(False))
        return F.struct((acc["some"] | yes).alias("some"), F.when(yes, x["d"]).otherwise(acc["d"]).alias("d"), F.when(yes, F.concat(acc["out"], F.array(x["row"]))).otherwise(acc["out"]).alias("out"))

    return both.select(F.explode(F.aggregate("_new", begin, step)["out"]).alias("r")).select("r.*")


def put_if_greater(live: DataFrame, batch: DataFrame, key: str = "key", data: str = "data", order: str = "ord") -> DataFrame:
    """What conditional_put with new > old leaves of each key that changes: the batch's largest data, if larger than the live one."""
    best = batch.groupBy(key).agg(F.max(F.struct(F.col(data).alias("d"), (-F.col(order)).alias("o"))).alias("_best")).select(key, F.col("_best.d").alias(data), (-F.col("_best.o")).alias(order))
    old = live.select(F.col(key).alias("_k"), F.col(data).alias("_old"))
    return best.join(old, F.col(key) == F.col("_k"), "left").where(F.col("_k").isNull() | (F.col(data) > F.col("_old"))).select(key, data, order)


def upsert(live: DataFrame, batch: DataFrame, key: str = "key", order: str = "ord") -> DataFrame:
    """The live view after all rows of the batch are set; live and batch share key and other columns but order."""
    shared = [c for c in live.columns if c in batch.columns and c != order]
    all_rows = live.select(*shared, F.lit(None).cast(batch.schema[order].dataType).alias(order)).unionByName(batch.select(*shared, order))
    ranked = all_rows.withColumn("_o", F.struct(F.col(order).isNotNull().alias("new"), F.col(order).alias("o")))
    return newest(ranked.drop(order), key, "_o").drop("_o")


def merge(live: DataFrame, one: Any, two: Any, merged: DataFrame, key: str = "key") -> DataFrame:
    """The live view with a merged object in place of two others."""
    return live.where((F.col(key) != one) & (F.col(key) != two)).unionByName(merged)
