"""Ordered range queries: bounds, direction, paging and pauses."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import StoreError
from ..functions.ordered import range_bounds, running_sums, with_range


@dataclass(frozen=True)
class Range:
    """A range of keys. A bound is a key with exactly one flag, or neither.

    A start of gt or ge goes up to an end of lt or le; a start of lt or le goes down to an end of gt or
    ge. `descending` asks for a whole scan backwards, which bounds alone cannot express: an extension.
    """

    start: Any = None
    start_flag: str | None = None
    end: Any = None
    end_flag: str | None = None
    keys_only: bool = False
    after: int | None = None
    up_to: int | None = None
    descending: bool | None = None

    def __post_init__(self) -> None:
        for key, flag in ((self.start, self.start_flag), (self.end, self.end_flag)):
            if (key is None) != (flag is None) or flag not in (None, "gt", "ge", "lt", "le"):
                raise StoreError("INVALID_RANGE", "a bound is a key with one flag")
        up = {"gt": True, "ge": True, "lt": False, "le": False}
        if self.start_flag and self.end_flag and up[self.start_flag] == up[self.end_flag]:
            raise StoreError("INVALID_RANGE", "start and end point the same way")
        if self.after is not None and self.up_to is None:
            raise StoreError("INVALID_RANGE", "an increment has an upper end")
        if self.descending is not None and (self.start_flag or self.end_flag) and self.descending == self.ascending_by_bounds:
            raise StoreError("INVALID_RANGE", "bounds already give the direction")

    @property
    def ascending_by_bounds(self) -> bool:
        if self.start_flag:
            return self.start_flag in ("gt", "ge")
        return self.end_flag is None or self.end_flag in ("lt", "le")

    @property
    def ascending(self) -> bool:
        return not self.descending if self.descending is not None else self.ascending_by_bounds


def _bound(key: str, flag: str | None, value: Any) -> Column | None:
    # the stored column is compared unwrapped, so the bound reaches the scan
    c = F.col(key)
    return {"gt": c > value, "ge": c >= value, "lt": c < value, "le": c <= value}[flag] if flag else None


def within(live: DataFrame, r: Range, key: str = "key") -> DataFrame:
    """The rows of the range, in no order."""
    for flag, value in ((r.start_flag, r.start), (r.end_flag, r.end)):
        if flag:
            live = live.where(_bound(key, flag, value))
    return live.select(key) if r.keys_only else live


def scan(live: DataFrame, r: Range, key: str = "key") -> DataFrame:
    """The rows of the range in its direction."""
    return within(live, r, key).orderBy(F.col(key).asc() if r.ascending else F.col(key).desc())


def page(live: DataFrame, r: Range, n: int, last: Any = None, again: bool = False, key: str = "key") -> DataFrame:
    """The next at most n rows behind the key `last` (from it, if again, as after a pause)."""
    rows = within(live, r, key)
    if last is not None:
        flag = ("ge" if again else "gt") if r.ascending else ("le" if again else "lt")
        rows = rows.where(_bound(key, flag, last))
    return rows.orderBy(F.col(key).asc() if r.ascending else F.col(key).desc()).limit(n)


class Cursor:
    """Reads a range page by page; pages come to the caller, at most n rows each.

    The end is reported by an empty page only. A cursor reads one immutable DataFrame, so its pages
    agree with one another. `generation` of the container is compared on each call.
    """

    def __init__(self, live: DataFrame, r: Range, key: str = "key", generation: int = 0):
        self.live, self.range, self.key, self.generation = live, r, key, generation
        self.last, self.done = None, False

    def next(self, n: int, generation: int = 0) -> tuple[list, str]:
        if generation != self.generation:
            return [], "STATE_CHANGED"
        rows = page(self.live, self.range, n, self.last, key=self.key).collect() if n > 0 else []
        if rows:
            self.last = rows[-1][self.key]
            return rows, "SUCCESS"
        self.done = True
        return [], "QUERY_DONE"


def pause_groups(live: DataFrame, key: str, group: Column, out: str = "page_id", ranges: int | None = None) -> DataFrame:
    """live with the number of the page each row falls in, from 1, in key order.

    A page stops before a key of another class than the key before it; the next page begins at that
    key, so no row is left out. Pausing sets page boundaries; it is not a filter.
    """
    bounds = range_bounds(live, key, ranges)
    cut = with_range(live.withColumn("_class", group), key, bounds)
    # the class before a range's first row is the last one of the nearest range with rows before it
    ends = cut.groupBy("_range").agg(F.max_by("_class", key).alias("_last"))
    before = Window.orderBy("_range")
    ends = ends.select(F.col("_range").alias("_of"), F.lag("_last").over(before).alias("_carried"), F.lag(F.lit(True)).over(before).alias("_some"))
    own = Window.partitionBy("_range").orderBy(key)
    rows = cut.join(F.broadcast(ends), F.col("_range") == F.col("_of"))  # one row a range
    previous = F.coalesce(F.lag(F.struct("_class")).over(own), F.when(F.col("_some"), F.struct(F.col("_carried").alias("_class"))))
    turn = F.when(previous.isNull() | ~previous["_class"].eqNullSafe(F.col("_class")), 1).otherwise(0).cast("long")
    flagged = rows.select(*(F.col(f"`{c}`") for c in live.columns), turn.alias("_turn"))
    return running_sums(flagged, [key], {out: F.col("_turn")}, bounds=bounds).drop("_turn")
