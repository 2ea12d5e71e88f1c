"""The catalog of containers and their stored logs.

A container is a folder of Parquet files, one sub-folder a generation: writing appends a batch to the
newest generation, compaction writes the next one and then switches the catalog, so whoever reads an
older generation goes on reading it until `vacuum`. The catalog, with every container's snapshots, is
one small file a version, written through Spark, so any file system that Spark writes will do; each
change of it is saved at once. Two writers exclude each other: a version of the catalog, and a batch
of numbers, is a folder that can be made once, and the second writer gets STATE_CHANGED.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StoreError
from ..operators import expiry, integrity, log_containers, points, range_update, ranges, snapshots, transactions, versions
from ..operators.versions import live
from ..schema import LOG_RECORDS, MAX_DATA_BYTES, MAX_SNAPSHOTS, VERSION_LOG, check_name

KINDS = ("BTREE", "HASH", "LOG")
CATALOG = "cguid long, name string, kind string, size_kb long, persistent boolean, evicting boolean, fifo_mode boolean, writethru boolean, async_writes boolean, durability string, compression string, generation long"


@dataclass(frozen=True)
class Container:
    cguid: int
    name: str
    kind: str = "BTREE"
    size_kb: int = 0
    persistent: bool = True
    evicting: bool = False
    fifo_mode: bool = False
    writethru: bool = True
    async_writes: bool = False
    durability: str = "PERIODIC"
    compression: str = "snappy"
    generation: int = 0


class Properties(dict):
    """key=value settings; lines that begin with # are comments."""

    def load(self, spark: SparkSession, path: str) -> Properties:
        """Reads a file through Spark, so from any file system, line by line."""
        for line in (r[0].strip() for r in spark.read.text(path).toLocalIterator()):
            if line and not line.startswith("#") and "=" in line:
                k, v = line.split("=", 1)
                self[k.strip()] = v.strip()
        return self


class StoreCursor(ranges.Cursor):
    """A cursor that knows its container: it reports STATE_CHANGED once that has a new generation."""

    def __init__(self, store: Store, c: Container, rows: DataFrame, r: ranges.Range):
        super().__init__(rows, r, generation=c.generation)
        self.store, self.cguid = store, c.cguid

    def next(self, n: int) -> tuple[list, str]:
        known = self.store.containers.get(self.cguid)
        return super().next(n, known.generation if known else -1)


class Store:
    """A catalog over a folder. One that is there already is opened with `load`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.containers: dict[int, Container] = {}
        self.sort_keys: dict[int, Callable[[Column], Column]] = {}
        self.conditions: dict[int, Callable[[Column, Column], Column]] = {}
        self.snaps: dict[int, list[tuple[int, int]]] = {}  # (number, time), at most MAX_SNAPSHOTS a container
        self.dropped: list[int] = []  # deleted containers whose files are still there
        self.open_names: set[str] = set()
        self.read_only: set[str] = set()
        self.version = 0
        self.autodump = False
        self._next = 1

    # the catalog

    def load_defaults(self) -> Container:
        """The settings a container has unless others are given."""
        return Container(0, "")

    def open(self, name: str, create: bool = False, kind: str = "BTREE", schema: T.StructType | None = None, read_only: bool = False, **props) -> Container:
        """Opens a container; with create, a new one of a name that is free. A read-only one refuses writes."""
        check_name(name)
        found = self._find(name)
        if create:
            if found:
                raise StoreError("CONTAINER_EXISTS", name)
            if kind not in KINDS:
                raise StoreError("INVALID_PARAMETER", f"kind {kind!r}")
            found = Container(self._next, name, kind, generation=self._next, **props)
            empty = self.spark.createDataFrame([], schema or (LOG_RECORDS if kind == "LOG" else VERSION_LOG))
            self._write(empty, f"{self.path(found)}/schema", found)
            self.containers[found.cguid] = found
            self._next += 1
            self.save()
        if not found:
            raise StoreError("CONTAINER_UNKNOWN", name)
        self.open_names.add(name)
        (self.read_only.add if read_only else self.read_only.discard)(name)
        return found

    def open_special(self, name: str, sort_key: Callable[[Column], Column] | None = None, applies: Callable[[Column, Column], Column] | None = None, **options) -> Container:
        """open, with the container's own order, as a sort key, and its condition for writes."""
        c = self.open(name, **options)
        if sort_key is not None:
            self.sort_keys[c.cguid] = sort_key
        if applies is not None:
            self.conditions[c.cguid] = applies
        return c

    def close(self, c: Container) -> None:
        if c.name not in self.open_names:
            raise StoreError("CONTAINER_UNKNOWN", c.name)
        self.open_names.discard(c.name)
        self.read_only.discard(c.name)

    def delete(self, c: Container) -> None:
        """Takes the container out of the catalog; an open one must be closed first. Files go with `vacuum`."""
        if c.name in self.open_names:
            raise StoreError("CANNOT_DELETE_OPEN_CONTAINER", c.name)
        if self.containers.pop(c.cguid, None) is None:
            raise StoreError("CONTAINER_UNKNOWN", c.name)
        self.snaps.pop(c.cguid, None)
        self.dropped.append(c.cguid)
        self.save()

    def vacuum(self) -> int:
        """Removes the files of deleted containers and of older generations; how many folders went.

        Readers that were opened on those lose their files, so it is run when there are none.
        """
        gone = sum(self._delete_folder(f"{self.root}/{g}") for g in self.dropped)
        self.dropped = []
        for c in self.containers.values():
            gone += sum(self._delete_folder(path) for name, path, _ in self._folders(f"{self.root}/{c.cguid}") if name != f"g{c.generation}")
        self.save()
        return gone

    def recover(self) -> int:
        """Removes what a crash left of unfinished writes, whose folders would refuse the next writer; how many.

        It is run when no writer is at work. Readers never see an unfinished write.
        """
        places = [f"{self.root}/_catalog", *(self.path(c) for c in self.containers.values())]
        return sum(self._delete_folder(path) for place in places for _, path, finished in self._folders(place) if not finished)

    def rename(self, c: Container, name: str) -> Container:
        check_name(name)
        if self._find(name):
            raise StoreError("CONTAINER_EXISTS", name)
        new = replace(self._known(c), name=name)
        self.containers[c.cguid] = new
        for names in (self.open_names, self.read_only):
            if c.name in names:
                names.discard(c.name)
                names.add(name)
        self.save()
        return new

    def resize(self, c: Container, size_kb: int) -> Container:
        if size_kb < self._known(c).size_kb:
            raise StoreError("CANNOT_REDUCE_CONTAINER_SIZE", f"{size_kb} < {c.size_kb}")
        return self.set_props(c, size_kb=size_kb)

    def set_props(self, c: Container, **props) -> Container:
        if {"cguid", "name", "kind", "generation"} & set(props):
            raise StoreError("INVALID_PARAMETER", "identity and kind do not change")
        self.containers[c.cguid] = replace(self._known(c), **props)
        self.save()
        return self.containers[c.cguid]

    def props(self, cguid: int) -> Container:
        if cguid not in self.containers:
            raise StoreError("CONTAINER_UNKNOWN", str(cguid))
        return self.containers[cguid]

    def listed(self) -> DataFrame:
        """The catalog as a DataFrame, in order of id."""
        return self.spark.createDataFrame([asdict(c) for _, c in sorted(self.containers.items())], CATALOG)

    def save(self) -> None:
        """Writes the next version of the catalog, which makes all changes so far visible to `load`."""
        state = {"next": self._next, "dropped": self.dropped, "containers": [asdict(c) | {"snaps": self.snaps.get(g, [])} for g, c in sorted(self.containers.items())]}
        row = self.spark.createDataFrame([(json.dumps(state),)], "value string")
        self._once(row.coalesce(1).write.mode("error").text, f"{self.root}/_catalog/version={self.version + 1}", "the catalog")
        self.version += 1

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Store:
        """The store as last saved."""
        store = cls(spark, root)
        last = spark.read.text(f"{store.root}/_catalog").orderBy(F.desc("version")).first()
        if last is None:
            raise StoreError("CONTAINER_UNKNOWN", f"no catalog in {root}")
        state = json.loads(last["value"])
        store.version, store._next, store.dropped = last["version"], state["next"], state["dropped"]
        for c in state["containers"]:
            store.snaps[c["cguid"]] = [tuple(x) for x in c.pop("snaps")]
            store.containers[c["cguid"]] = Container(**c)
        return store

    # the data

    def path(self, c: Container) -> str:
        return f"{self.root}/{c.cguid}/g{c.generation}"

    def log(self, c: Container) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(self.path(self._known(c)))

    def view(self, c: Container, now: int = 0, flush_time: int = 0, **window) -> DataFrame:
        """The live view, for a reader at `now` if that is given, also as a temporary view of the container's name."""
        if self._known(c).kind == "LOG":
            raise StoreError("FAILURE_INVALID_CONTAINER_TYPE", "a log container has records, not versions")
        out = live(self.log(c), **window)
        out = expiry.readable(out, now, flush_time) if now else out
        out.createOrReplaceTempView(c.name)
        return out

    def enumerate(self, c: Container, pg: str | None = None) -> DataFrame:
        """All live objects: in key order for a BTREE, in no order for a HASH container, by group (or one group) for a LOG."""
        if self._known(c).kind == "LOG":
            return log_containers.enumerate_groups(self.records(c), pg)
        out = self.view(c)
        return out.orderBy("key") if c.kind == "BTREE" else out

    def ordered(self, c: Container, **window) -> DataFrame:
        """The live view for range queries, which only BTREE containers have."""
        if self._known(c).kind != "BTREE":
            raise StoreError("FAILURE_INVALID_CONTAINER_TYPE", f"{c.kind} has no order")
        return self.view(c, **window)

    def scan(self, c: Container, r: ranges.Range | None = None, **window) -> DataFrame:
        """A range query; a container with an own sort key is ordered and bounded by that key."""
        r = r or ranges.Range()
        view = self.ordered(c, **({"after": r.after, "up_to": r.up_to} | window))
        if c.cguid not in self.sort_keys:
            return ranges.scan(view, r)
        keyed = view.withColumn("_sort", self.sort_keys[c.cguid](F.col("key")))
        whole = ranges.within(keyed, replace(r, keys_only=False), "_sort").orderBy(F.col("_sort").asc() if r.ascending else F.col("_sort").desc()).drop("_sort")
        return whole.select("key") if r.keys_only else whole

    def cursor(self, c: Container, r: ranges.Range | None = None) -> StoreCursor:
        """Pages over a range of the container as it is now; STATE_CHANGED after a compaction."""
        r = r or ranges.Range()
        last = self.last_number(c) if r.up_to is None else r.up_to
        return StoreCursor(self, self._known(c), self.ordered(c, after=r.after, up_to=last), r)

    # writes

    def last_number(self, c: Container, column: str = "seqno") -> int:
        return self.log(c).agg(F.coalesce(F.max(column), F.lit(0))).first()[0]

    def put(self, c: Container, batch: DataFrame, mode: str = "set", order: str = "ord", now: int | None = None, expires: int | None = None) -> int:
        """Writes a batch of key, data and order, numbered after what is stored; how many rows were written.

        The container's condition, if it has one, decides on each row; else mode is that of multi_put.
        now and expires are the rows' create_time and expiry_time, unless the batch has columns of its own.
        """
        self._writable(c)
        if mode == "trim" or c.kind == "LOG":
            raise StoreError("FAILURE_OPERATION_DISALLOWED", "only log containers are trimmed, and only they take records")
        if not points_within(batch):
            raise StoreError("OBJECT_TOO_BIG")
        now_live = points.live_of(self.log(c), batch)
        rows = points.conditional_put(now_live, batch, self.conditions[c.cguid], order=order) if c.cguid in self.conditions else points.multi_put(now_live, batch, mode, order=order)
        for name, value in (("create_time", now), ("expiry_time", expires)):
            if value is not None and name not in rows.columns:
                rows = rows.withColumn(name, F.lit(value).cast("long"))
        return self._number_and_append(c, rows.withColumn("tombstone", F.lit(False)), order)

    def remove(self, c: Container, keys: DataFrame, force: bool = False) -> int:
        """Deletes objects: a tombstone for each live key; how many. A missing key writes nothing.

        force leaves no tombstone and no older version: the container gets a new generation.
        """
        self._writable(c)
        self._versions(c)
        if force:
            n = points.multi_get(self.log(c), keys).select("key").distinct().count()
            self.compact(c, points.force_delete(self.log(c), keys))
            return n
        now = points.live_of(self.log(c), keys)
        return self._number_and_append(c, points.delete(now, keys), "key")

    def remove_one(self, c: Container, key: Any) -> None:
        """Deletes one object; raises OBJECT_UNKNOWN if it is not live."""
        if not self.remove(c, self.log(c).where(F.col("key") == key).select("key").limit(1)):
            raise StoreError("OBJECT_UNKNOWN", f"{key!r}")

    def get(self, c: Container, key: Any, now: int = 0, flush_time: int = 0) -> Any:
        """The row of one key; raises OBJECT_UNKNOWN, or EXPIRED for a reader at `now`."""
        self._versions(c)
        found = points.read(live(self.log(c).where(F.col("key") == key)), key)
        if now and expiry.readable(live(self.log(c).where(F.col("key") == key)), now, flush_time).isEmpty():
            raise StoreError("EXPIRED", f"{key!r}")
        return found

    def update_range(self, c: Container, in_range: Column, new: Column, changed: Column | None = None, limit: int = MAX_DATA_BYTES) -> tuple[int, DataFrame]:
        """Updates the live objects of a range; how many, and the keys left as they are as OBJECT_TOO_BIG."""
        self._writable(c)
        done = range_update.range_update(self.ordered(c, up_to=self.last_number(c)), in_range, new, changed, limit=limit)
        rows = range_update.changed_rows(done)
        return self._number_and_append(c, rows.drop("seqno"), "key"), done.where("status = 'OBJECT_TOO_BIG'").select("key")

    def sweep(self, c: Container, now: int, flush_time: int = 0) -> int:
        """Deletes what has expired before `now`; tombstones keep older versions from coming back."""
        self._writable(c)
        self._versions(c)
        now_live = live(self.log(c))
        left = expiry.sweep(now_live, now, flush_time).select("key")
        return self._number_and_append(c, points.delete(now_live, now_live.select("key").join(left, "key", "left_anti")), "key")

    def remove_by_prefix(self, c: Container, prefixes: DataFrame, delimiter: str) -> int:
        """Deletes objects whose prefix is registered and that are no newer than its start time; how many."""
        self._writable(c)
        self._versions(c)
        now_live = live(self.log(c))
        left = expiry.delete_by_prefix(now_live, prefixes, delimiter).select("key")
        return self._number_and_append(c, points.delete(now_live, now_live.select("key").join(left, "key", "left_anti")), "key")

    # log containers

    def records(self, c: Container) -> DataFrame:
        """The records of a log container, decoded."""
        if self._known(c).kind != "LOG":
            raise StoreError("FAILURE_INVALID_CONTAINER_TYPE", f"{c.kind} has no records")
        return log_containers.decode(self.log(c))

    def append_records(self, c: Container, batch: DataFrame, kind: str | None = "WRITE", order: str = "ord") -> int:
        """Appends a batch of key, data and order as WRITE, DELETE or TRIM records, or by its own column kind if kind
        is None; how many. A batch with a key or record that is not valid is refused as a whole."""
        self._writable(c)
        if self._known(c).kind != "LOG":
            raise StoreError("FAILURE_INVALID_CONTAINER_TYPE", f"{c.kind} takes no records")
        rows = batch if kind is None else batch.withColumn("kind", F.lit(kind))
        if "data" not in rows.columns:
            rows = rows.withColumn("data", F.lit(None).cast("string"))
        rows = rows.withColumn("data", F.when(F.col("kind") == "WRITE", F.col("data")))
        bad = log_containers.decode(rows).where("status <> 'SUCCESS' OR kind NOT IN ('WRITE', 'DELETE', 'TRIM')").select("status", "key").first()
        if bad is not None:
            raise StoreError(bad["status"] if bad["status"] != "SUCCESS" else "INVALID_PARAMETER", f"{bad['key']!r}")
        return self._number_and_append(c, rows, order, number="ord")

    def record(self, c: Container, counter: int, pg: str, other: str = "") -> Any:
        """One visible record; raises OBJECT_UNKNOWN."""
        found = log_containers.read(self.records(c), counter, pg, other).first()
        if found is None:
            raise StoreError("OBJECT_UNKNOWN", f"{counter}_{pg}{other}")
        return found

    def reclaim(self, c: Container, active_trx: list[int] | None = None) -> Container:
        """A new generation without trimmed records."""
        log = self.log(c)
        return self.compact(c, log_containers.reclaim(self.records(c), active_trx).select(*log.columns))

    # transactions

    def transaction(self) -> StoreTransaction:
        return StoreTransaction(self)

    # snapshots

    def create_snapshot(self, c: Container, ts: int) -> int:
        have = self.snaps.setdefault(self._known(c).cguid, [])
        if len(have) >= MAX_SNAPSHOTS:
            raise StoreError("TOO_MANY_SNAPSHOTS")
        have.append((self.last_number(c), ts))
        self.save()
        return have[-1][0]

    def delete_snapshot(self, c: Container, number: int) -> None:
        have = self.snaps.get(self._known(c).cguid, [])
        if number not in [n for n, _ in have]:
            raise StoreError("SNAPSHOT_NOT_FOUND", str(number))
        self.snaps[c.cguid] = [x for x in have if x[0] != number]
        self.save()

    def snapshots(self, c: Container) -> list[tuple[int, int]]:
        return sorted(self.snaps.get(self._known(c).cguid, []))

    def scavenge(self, c: Container, snapshot: int | None = None) -> Container:
        """Drops the versions that no read at the latest state or a snapshot needs.

        With a snapshot, that one is deleted first, so that what only it needed goes.
        """
        self._versions(c)
        if snapshot is not None:
            self.delete_snapshot(c, snapshot)
        return self.compact(c, snapshots.scavenge(self.log(c), [n for n, _ in self.snapshots(c)]))

    def scavenge_all(self) -> list[Container]:
        """Scavenges every container of versions."""
        return [self.scavenge(c) for c in list(self.containers.values()) if c.kind != "LOG"]

    def simulate_backup(self, c: Container, after: int, up_to: int) -> int:
        return versions.count_increment(self.log(c), after, up_to).first()["n_keys"]

    # maintenance

    def check(self, c: Container, stored_crc: str = "crc") -> DataFrame:
        """Violations in the container: numbers used twice, rows without key or number, data over the limit, snapshots
        and the generation's own numbers that do not fit together, and, if rows carry a checksum, data that differ
        from it; for a log container, records whose key is not valid."""
        log = self.log(c)
        if c.kind == "LOG":
            bad = self.records(c).where("status <> 'SUCCESS'")
            twice = integrity.check_duplicates(log.withColumn("one", F.lit(c.name)), "one", "ord")
            return integrity.check(twice, bad.select(F.lit("record").alias("entity"), F.col("key").alias("id"), F.col("status").alias("error"), F.lit("a key is counter_pg or counter_pg_other").alias("msg")))
        row = lambda where, entity, of, error, msg: log.where(where).select(F.lit(entity).alias("entity"), F.col(of).cast("string").alias("id"), F.lit(error).alias("error"), F.lit(msg).alias("msg"))
        missing = row("key IS NULL OR seqno IS NULL", "version", "seqno", "NULL_KEY", "a version has a key and a number")
        big = row(F.octet_length(F.col("data").cast("string")) > MAX_DATA_BYTES, "object", "key", "OBJECT_TOO_BIG", "data over the limit")
        negative = row("seqno < 1", "version", "seqno", "BAD_SEQNO", "numbers begin at 1")
        last = self.last_number(c)
        ahead = [("snapshot", str(n), "SNAPSHOT_AHEAD", f"the last number is {last}") for n, _ in self.snapshots(c) if n > last and not log.isEmpty()]
        parts = [integrity.check_duplicates(log.where("key IS NOT NULL")), missing, big, negative, self.spark.createDataFrame(ahead, "entity string, id string, error string, msg string")]
        if stored_crc in log.columns:
            parts.append(integrity.check_crc(log, crc=stored_crc))
        return integrity.check(*parts)

    def append(self, c: Container, rows: DataFrame) -> None:
        """Writing is appending; what a reader sees follows from the newest versions. Rows come numbered."""
        self._writable(c)
        self._write(rows, f"{self.path(self._known(c))}/rows-{uuid.uuid4().hex}", c)

    def compact(self, c: Container, kept: DataFrame) -> Container:
        """Writes the kept rows as a new generation, then switches the catalog; open readers keep the old files."""
        self._writable(c)
        new = replace(self._known(c), generation=c.generation + 1)
        empty = self.spark.createDataFrame([], self.log(c).schema)
        self._write(empty, f"{self.path(new)}/schema", new)
        self._write(kept, f"{self.path(new)}/rows-{uuid.uuid4().hex}", new)
        self.containers[c.cguid] = new
        self.save()
        return new

    def stats(self) -> DataFrame:
        """(container, kind, num_objs, used_bytes) of every container and, with a null name, of all."""
        parts = [live(self.log(c)).agg(F.count(F.lit(1)).alias("num_objs"), F.coalesce(F.sum(F.octet_length(F.col("data").cast("string"))), F.lit(0)).cast("long").alias("used_bytes")).select(F.lit(c.name).alias("container"), F.lit(c.kind).alias("kind"), "num_objs", "used_bytes") for c in self.containers.values() if c.kind != "LOG"]
        if not parts:
            return self.spark.createDataFrame([], "container string, kind string, num_objs long, used_bytes long")
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole.unionByName(whole.agg(F.sum("num_objs").alias("num_objs"), F.sum("used_bytes").alias("used_bytes")).select(F.lit(None).cast("string").alias("container"), F.lit(None).cast("string").alias("kind"), "num_objs", "used_bytes"))

    def summary(self) -> DataFrame:
        """(kind, containers, num_objs, used_bytes) of the containers by kind."""
        return self.stats().where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("num_objs").alias("num_objs"), F.sum("used_bytes").alias("used_bytes"))

    def dump_stats(self, ts: int = 0) -> str:
        """Writes the statistics as JSON below the store's folder; where."""
        path = f"{self.root}/_stats/{ts}-{uuid.uuid4().hex}"
        self.stats().coalesce(1).write.json(path)
        return path

    def command(self, line: str):
        """The administrator's commands: container list, container stats NAME, container check NAME, stats, stats_dump
        [TIME], autodump on|off (a dump after every compaction), log_level LEVEL, scavenge NAME|all, snapshot list
        NAME, snapshot create NAME TIME, snapshot delete NAME NUMBER, snapshot sim_backup NAME AFTER UP_TO."""
        words = line.split()
        named = lambda i: self._find(words[i]) or self._unknown(words[i])
        match words:
            case ["container", "list"]:
                return self.listed()
            case ["container", "stats", name]:
                return self.stats().where(F.col("container") == named(2).name)
            case ["container", "check", _]:
                return self.check(named(2))
            case ["stats"]:
                return self.summary()
            case ["stats_dump"]:
                return self.dump_stats()
            case ["stats_dump", ts]:
                return self.dump_stats(int(ts))
            case ["autodump", "on" | "off" as state]:
                self.autodump = state == "on"
                return self.autodump
            case ["log_level", level]:
                return self.spark.sparkContext.setLogLevel(level.upper())
            case ["scavenge", "all"]:
                done = self.scavenge_all()
                return self.dump_stats() if self.autodump else done
            case ["scavenge", _]:
                done = self.scavenge(named(1))
                return self.dump_stats() if self.autodump else done
            case ["snapshot", "list", _]:
                return self.snapshots(named(2))
            case ["snapshot", "create", _, ts]:
                return self.create_snapshot(named(2), int(ts))
            case ["snapshot", "delete", _, number]:
                return self.delete_snapshot(named(2), int(number))
            case ["snapshot", "sim_backup", _, after, up_to]:
                return self.simulate_backup(named(2), int(after), int(up_to))
        raise StoreError("INVALID_PARAMETER", f"no such command: {line!r}")

    # within

    def _number_and_append(self, c: Container, rows: DataFrame, order: str, number: str = "seqno") -> int:
        """Numbers rows in `order` after what is stored and writes them as one batch; how many."""
        # the number replaces a column of its name, which may be the order
        rows = rows.withColumnRenamed(number, "_order") if order == number else rows.drop(number)
        return self._append_parts(c, [(rows, "_order" if order == number else order)], number)

    def _append_parts(self, c: Container, parts: list[tuple[DataFrame, str]], number: str = "seqno") -> int:
        """Writes parts of one batch, each in its order, the later ones numbered after the earlier."""
        log = self.log(c)
        base = last = self.last_number(c, number)
        whole: DataFrame | None = None
        for i, (rows, order) in enumerate(parts):
            numbered = points.numbered(rows, last, [order], number)
            chosen = numbered.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in numbered.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema))
            whole = chosen if whole is None else whole.unionByName(chosen)
            last += rows.count() if i + 1 < len(parts) else 0
        if whole is None:
            return 0
        # a writer that has the same numbers makes the same folder, and one of the two fails
        path = f"{self.path(self._known(c))}/batch-{base + 1}"
        self._write(whole, path, c)
        n = self.spark.read.schema(log.schema).parquet(path).count()
        if not n:  # nothing took these numbers
            self._delete_folder(path)
        return n

    def _delete_folder(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _folders(self, path: str) -> list[tuple[str, str, bool]]:
        """Name, path and whether the write was finished, of each folder in one."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        made = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return [(s.getPath().getName(), s.getPath().toString(), fs.exists(made(s.getPath(), "_SUCCESS"))) for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []

    def _write(self, rows: DataFrame, path: str, c: Container) -> None:
        self._once(rows.write.mode("error").option("compression", c.compression).parquet, path, c.name)

    def _once(self, write: Callable[[str], None], path: str, what: str) -> None:
        try:
            write(path)
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" in str(e):
                raise StoreError("STATE_CHANGED", f"another writer changed {what}") from e
            raise

    def _versions(self, c: Container) -> None:
        if self._known(c).kind == "LOG":
            raise StoreError("FAILURE_INVALID_CONTAINER_TYPE", "a log container has records, not versions")

    def _writable(self, c: Container) -> None:
        if self._known(c).name in self.read_only:
            raise StoreError("FAILURE_OPERATION_DISALLOWED", f"{c.name} was opened to be read only")

    def _unknown(self, name: str) -> Container:
        raise StoreError("CONTAINER_UNKNOWN", name)

    def _find(self, name: str) -> Container | None:
        return next((c for c in self.containers.values() if c.name == name), None)

    def _known(self, c: Container) -> Container:
        """The container as the catalog has it now."""
        if c.cguid not in self.containers:
            raise StoreError("CONTAINER_UNKNOWN", c.name)
        return self.containers[c.cguid]


class StoreTransaction:
    """Nested brackets around writes to a store: the outermost commit writes, rollback discards.

    The writes to one container become one batch, in the order they were made, so a reader sees all or
    none of them; containers are written one after the other. Staged rows are set as they are: modes and
    a container's own condition, which ask for the state, belong to `Store.put`.
    """

    def __init__(self, store: Store):
        self.store, self.session = store, transactions.Session()
        self.staged: list[tuple[Container, DataFrame, str]] = []

    def start(self, nested: bool = True) -> int:
        return self.session.start(nested)

    def put(self, c: Container, batch: DataFrame, order: str = "ord") -> None:
        self.session.need()
        self.store._writable(c)
        if not points_within(batch):
            raise StoreError("OBJECT_TOO_BIG")
        self.staged.append((c, batch.withColumn("tombstone", F.lit(False)), order))

    def remove(self, c: Container, keys: DataFrame) -> None:
        """Stages tombstones for those keys that are live now or staged."""
        self.session.need()
        self.store._writable(c)
        staged = [rows.select("key") for d, rows, _ in self.staged if d.cguid == c.cguid]
        known = live(self.store.log(c)).select("key")
        for rows in staged:
            known = known.unionByName(rows)
        self.staged.append((c, keys.select("key").distinct().join(known, "key", "left_semi").withColumns({"tombstone": F.lit(True), "data": F.lit(None)}), "key"))

    def commit(self) -> int:
        """How many rows the outermost bracket wrote; 0 for an inner one."""
        self.session.commit()
        if self.session.depth:
            return 0
        parts: dict[int, list[tuple[DataFrame, str]]] = {}
        for c, rows, order in self.staged:
            parts.setdefault(c.cguid, []).append((rows, order))
        self.staged = []
        return sum(self.store._append_parts(self.store.props(g), rows) for g, rows in parts.items())

    def rollback(self) -> None:
        self.session.rollback()
        self.staged = []

    quit = rollback

    def current(self) -> int:
        return self.session.current()


def points_within(batch: DataFrame) -> bool:
    """Whether all data of a batch are within the limit of an object."""
    return "data" not in batch.columns or batch.where(F.octet_length(F.col("data").cast("string")) > MAX_DATA_BYTES).isEmpty()
