"""Transactions: staged batches, conflicts, commit order and replay."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StoreError
from ..sources.shared import shared_dir
from .versions import newest


@dataclass
class Session:
    """Nested brackets around staged batches; only the outermost concludes. Rollback discards."""

    depth: int = 0
    trx: int = 0
    staged: list[DataFrame] = field(default_factory=list)

    def start(self, nested: bool = True) -> int:
        if self.depth and not nested:
            raise StoreError("TRANS_LEVEL_EXCEEDED")
        if not self.depth:
            self.trx += 1
        self.depth += 1
        return self.trx

    def put(self, rows: DataFrame) -> None:
        self.need()
        self.staged.append(rows.withColumn("trx", F.lit(self.trx).cast("long")))

    def commit(self) -> DataFrame | None:
        """The rows to append once the outermost bracket commits, else None."""
        self.need()
        self.depth -= 1
        if self.depth or not self.staged:
            return None
        out = self.staged[0]
        for d in self.staged[1:]:
            out = out.unionByName(d)
        self.staged = []
        return out

    def rollback(self) -> None:
        """Ends all brackets and drops what is staged."""
        self.need()
        self.depth, self.staged = 0, []

    quit = rollback

    def current(self) -> int:
        return self.trx if self.depth else 0

    def need(self) -> None:
        if not self.depth:
            raise StoreError("FAILURE_NO_TRANS")


def conflicts(touches: DataFrame) -> DataFrame:
    """(first, second, relation) of pairs of transactions that meet on a node.

    touches: trx, node, lo, hi, write. Two readers do not conflict. Of two others the one whose interval
    ends first comes first: relation `before`; overlapping intervals exclude each other: `overlap`.
    All pairs of a node: a report for a few transactions. Ordering many of them takes uncommittable
    and order_edges, whose work and size follow the number of touches.
    """
    a = touches.select("node", *(F.col(c).alias(f"{c}1") for c in ("trx", "lo", "hi", "write")))
    b = touches.select("node", *(F.col(c).alias(f"{c}2") for c in ("trx", "lo", "hi", "write")))
    pairs = a.join(b, "node").where("trx1 < trx2 AND (write1 OR write2)")
    relation = F.when(F.col("hi2") < F.col("lo1"), "after").when(F.col("lo2") > F.col("hi1"), "before").otherwise("overlap")
    edges = pairs.withColumn("relation", relation)
    after = F.col("relation") == "after"
    return edges.select(F.when(after, F.col("trx2")).otherwise(F.col("trx1")).alias("first"), F.when(after, F.col("trx1")).otherwise(F.col("trx2")).alias("second"), F.when(after, "before").otherwise(F.col("relation")).alias("relation")).distinct()


def uncommittable(touches: DataFrame) -> DataFrame:
    """(trx) that overlap another transaction on some node, one of the two writing: they exclude each other.

    Found by running extremes on either side in order of intervals, without pairs.
    """
    from pyspark.sql import Window

    up = Window.partitionBy("node").orderBy("lo", "hi", "trx").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("node").orderBy("lo", "hi", "trx").rowsBetween(1, Window.unboundedFollowing)
    writes = lambda c: F.when(F.col("write"), F.col(c))
    met = touches.select(
        "trx",
        F.when(F.col("write"), F.max("hi").over(up)).otherwise(F.max(writes("hi")).over(up)).alias("reach"),
        F.when(F.col("write"), F.min("lo").over(down)).otherwise(F.min(writes("lo")).over(down)).alias("next"),
        "lo", "hi",
    )
    return met.where("reach >= lo OR next <= hi").select("trx").distinct()


def order_edges(touches: DataFrame, bad: DataFrame) -> DataFrame:
    """(first, second, relation): on each node a writer comes before the readers up to the next writer, and
    all of these before that one. The other pairs follow from these; there are at most three a touch."""
    from pyspark.sql import Window

    good = touches.join(bad, "trx", "left_anti")
    turn = Window.partitionBy("node").orderBy("lo", "hi", "trx").rowsBetween(Window.unboundedPreceding, 0)
    seen = good.withColumn("turn", F.count(F.when(F.col("write"), 1)).over(turn))  # the writers up to here
    writers = seen.where("write").select("node", "turn", F.col("trx").alias("w"))
    readers = seen.where("NOT write").select("node", "turn", "trx")
    after = readers.join(writers, ["node", "turn"]).select(F.col("w").alias("first"), F.col("trx").alias("second"))
    following = writers.select("node", (F.col("turn") - 1).alias("turn"), "w")
    before = seen.select("node", "turn", "trx").join(following, ["node", "turn"]).select(F.col("trx").alias("first"), F.col("w").alias("second"))
    return after.union(before).distinct().withColumn("relation", F.lit("before"))


def commit_order(trx: DataFrame, edges: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """(trx, level): level 0 commits first; -1 for those in a cycle or an overlap, which roll back.

    Each round takes the transactions without one before them; there are as many rounds as the longest
    chain has transactions, each written to the shared folder.
    """
    shared_dir(trx.sparkSession)  # makes checkpoints possible
    overlap = edges.where("relation = 'overlap'").select(F.explode(F.array("first", "second")).alias("trx"))
    bad = (overlap if bad is None else overlap.union(bad)).distinct()
    left = trx.select("trx").distinct().join(bad, "trx", "left_anti").checkpoint()
    order = edges.where("relation = 'before'").select("first", "second")
    done: DataFrame | None = None
    for level in count():
        live = order.join(left.withColumnRenamed("trx", "first"), "first", "left_semi").join(left.withColumnRenamed("trx", "second"), "second", "left_semi")
        free = left.join(live.select(F.col("second").alias("trx")).distinct(), "trx", "left_anti").checkpoint()
        if free.isEmpty():
            break
        taken = free.withColumn("level", F.lit(level))
        done = taken if done is None else done.unionByName(taken)
        left = left.join(free, "trx", "left_anti").checkpoint()
    rest = left.union(bad.join(trx.select("trx"), "trx", "left_semi")).distinct().withColumn("level", F.lit(-1))
    return rest if done is None else done.unionByName(rest)


def replay(redo: DataFrame, committed: DataFrame, up_to: int | None = None, key: str = "key", lsn: str = "lsn", trx: str = "trx") -> DataFrame:
    """The state after a log is replayed: the newest record of each key by log number, of committed
    transactions and of none. Replaying a log twice changes nothing."""
    rows = redo if up_to is None else redo.where(F.col(lsn) <= up_to)
    good = rows.where(F.col(trx).isNotNull()).join(committed.select(trx).distinct(), trx, "left_semi").select(*rows.columns)
    return newest(good.unionByName(rows.where(F.col(trx).isNull())), key, lsn)


def retained_tombstones(log: DataFrame, guarantee: int, key: str = "key", seqno: str = "seqno", tombstone: str = "tombstone") -> DataFrame:
    """The log without newest tombstones at or under the guaranteed number."""
    return log.where(~(F.col(tombstone) & (F.col(seqno) <= guarantee)))
