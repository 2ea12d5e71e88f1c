"""The catalog, stored containers and streams."""

import pytest
from pyspark.sql import functions as F

from keystrata.errors import StoreError
from keystrata.operators import points, ranges, snapshots, versions
from keystrata.sources.containers import Properties, Store
from keystrata.streaming import streams

SCHEMA = "key string, data string, seqno long, tombstone boolean"


def log_schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def test_catalog(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    c = store.open("one", create=True, schema=log_schema(spark), size_kb=100)
    for call, status in ((lambda: store.open("one", create=True), "CONTAINER_EXISTS"), (lambda: store.open("two"), "CONTAINER_UNKNOWN"), (lambda: store.open("x" * 65), "INVALID_PARAMETER"), (lambda: store.resize(c, 50), "CANNOT_REDUCE_CONTAINER_SIZE"), (lambda: store.delete(c), "CANNOT_DELETE_OPEN_CONTAINER")):
        with pytest.raises(StoreError) as e:
            call()
        assert e.value.status == status
    c = store.rename(store.resize(c, 200), "uno")
    assert [r["name"] for r in store.listed().collect()] == ["uno"]
    store.save()
    again = Store.load(spark, str(tmp_path))
    assert again.props(c.cguid) == c
    store.close(c)
    store.delete(c)
    assert store.listed().count() == 0


def test_container_life(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    c = store.open("life", create=True, schema=log_schema(spark))
    assert store.view(c).count() == 0
    store.append(c, spark.createDataFrame([("a", "1", 1, False), ("b", "2", 2, False)], SCHEMA))
    store.append(c, spark.createDataFrame([("a", None, 3, True), ("c", "3", 4, False)], SCHEMA))
    assert [r["key"] for r in store.enumerate(c).collect()] == ["b", "c"]
    assert [r["key"] for r in store.view(c, up_to=2).orderBy("key").collect()] == ["a", "b"]
    assert spark.table("life").count() == 2
    assert {(r["container"], r["num_objs"], r["used_bytes"]) for r in store.stats().collect()} == {("life", 2, 2), (None, 2, 2)}
    c = store.compact(c, snapshots.scavenge(store.log(c), []))
    assert c.generation == 2 and store.log(c).count() == 2
    h = store.open("hash", create=True, kind="HASH", schema=log_schema(spark))
    with pytest.raises(StoreError) as e:
        store.ordered(h)
    assert e.value.status == "FAILURE_INVALID_CONTAINER_TYPE"


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("key"), F.lit("x").alias("data")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = points.get(df, 5).select("key")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,5)" in plan and "data" not in plan.split("ReadSchema")[1]


def test_few_keys_reach_the_scan_of_the_log(spark, sf):
    from keystrata.sources.tables import version_log

    few = spark.createDataFrame([(3, 1.0, 1), (99999, 2.0, 2)], "key long, data double, ord long")
    plan = points.live_of(version_log(spark, sf), few)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")  # the join stands below the aggregation


def test_properties(spark, tmp_path):
    (tmp_path / "p").write_text("# comment\nA=1\n\n B = two = 2 \n")
    assert Properties().load(spark, str(tmp_path / "p")) == {"A": "1", "B": "two = 2"}


def test_stream_ingest_and_upsert(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i % 5}", f"d{i}", i, i % 9 == 0) for i in range(100)], SCHEMA)
    rows.repartition(6).write.parquet(str(tmp_path / "in"))
    source = streams.file_stream(spark, str(tmp_path / "in"), rows.schema, 2)
    streams.append_versions(source, str(tmp_path / "log"), str(tmp_path / "cp1")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "log"))
    assert stored.count() == 100 and versions.live(stored).count() == versions.live(rows).count()
    seen = []
    streams.upsert_latest(source, lambda df, n: seen.append((n, df.count())), str(tmp_path / "cp2")).awaitTermination()
    assert len(seen) >= 3 and all(n <= 5 for _, n in seen)
    stats = streams.to_table(streams.statistics_stream(source, "seqno", "key"), str(tmp_path / "stats"), ["key"])
    assert stats.agg(F.sum("n")).first()[0] == 100


def test_special_containers_puts_and_commands(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    c = store.open_special("sp", sort_key=lambda k: F.reverse(k), applies=lambda old, new: new > old, create=True, schema=log_schema(spark))
    batch = spark.createDataFrame([("ab", "5", 1), ("ba", "1", 2), ("ab", "4", 3), ("ab", "6", 4)], "key string, data string, ord long")
    assert store.put(c, batch) == 3
    assert store.command("snapshot create sp 77") == 3
    assert store.put(c, spark.createDataFrame([("ba", "0", 1), ("ba", "2", 2)], "key string, data string, ord long")) == 1
    assert [(r["key"], r["data"], r["seqno"]) for r in store.scan(c).collect()] == [("ba", "2", 4), ("ab", "6", 3)]
    assert [r["data"] for r in store.scan(c, up_to=3).collect()] == ["1", "6"]
    assert store.command("snapshot list sp") == [(3, 77)] and store.command("snapshot sim_backup sp 3 4") == 1
    c = store.scavenge(c)
    assert store.log(c).count() == 3 and [r["data"] for r in store.scan(c, up_to=3).collect()] == ["1", "6"]
    assert store.command("container stats sp").first()["num_objs"] == 2 and store.command("stats").first()["containers"] == 1
    assert store.check(c).count() == 0
    store.append(c, store.log(c).limit(1))
    assert store.check(c).count() == 1
    store.command("snapshot delete sp 3")
    for bad in ("snapshot delete sp 3", "snapshot list zz", "reboot"):
        with pytest.raises(StoreError):
            store.command(bad)
    plain = store.open("plain", create=True, schema=log_schema(spark))
    assert store.put(plain, batch, "insert") == 2
    assert store.put(plain, batch, "insert") == 0 and store.put(plain, batch, "update") == 4


def raises(status, call, *args, **more):
    with pytest.raises(StoreError) as e:
        call(*args, **more)
    assert e.value.status == status


def puts(spark, *rows):
    return spark.createDataFrame([(k, d, i) for i, (k, d) in enumerate(rows)], "key string, data string, ord long")


def keys(spark, *names):
    return spark.createDataFrame([(k,) for k in names], "key string")


def test_snapshots_survive_a_reload(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    c = store.open("s", create=True, schema=log_schema(spark))
    store.put(c, puts(spark, ("a", "1"), ("b", "2")))
    first = store.create_snapshot(c, 5)
    store.put(c, puts(spark, ("a", "3")))
    store.remove(c, keys(spark, "b", "nothing"))
    again = Store.load(spark, str(tmp_path))
    c = again.props(c.cguid)
    assert again.snapshots(c) == [(first, 5)]
    again.scavenge(c)
    c = again.props(c.cguid)
    seen = lambda up_to: sorted((r["key"], r["data"]) for r in again.view(c, up_to=up_to).collect())
    assert seen(first) == [("a", "1"), ("b", "2")] and seen(None) == [("a", "3")]
    # once the snapshot is given up, what only it needed goes
    c = again.scavenge(c, first)
    assert seen(None) == [("a", "3")] and again.log(c).count() < 4
    assert [x.generation for x in again.scavenge_all()] == [c.generation + 1]


def test_an_open_reader_outlives_a_compaction_until_the_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    c = store.open("r", create=True, schema=log_schema(spark))
    store.put(c, puts(spark, *((f"k{i}", "x") for i in range(10)), ("k0", "y")))
    reader, cursor = store.view(c), store.cursor(c, ranges.Range("k2", "ge"))
    assert [r["key"] for r in cursor.next(3)[0]] == ["k2", "k3", "k4"]
    new = store.scavenge(c)
    assert reader.count() == 10 and store.log(new).count() == 10
    assert cursor.next(3) == ([], "STATE_CHANGED")
    fresh = store.cursor(new)
    assert len(fresh.next(50)[0]) == 10 and fresh.next(50) == ([], "QUERY_DONE")
    store.close(new)
    store.delete(store.props(c.cguid))
    other = store.open("kept", create=True, schema=log_schema(spark))
    store.put(other, puts(spark, ("a", "1")))
    store.compact(other, store.log(other))
    assert store.vacuum() == 2 and not (tmp_path / str(c.cguid)).exists()
    assert store.view(store.props(other.cguid)).count() == 1


def test_two_writers_exclude_each_other(spark, tmp_path):
    one = Store(spark, str(tmp_path))
    c = one.open("w", create=True, schema=log_schema(spark))
    two = Store.load(spark, str(tmp_path))
    one.put(c, puts(spark, ("a", "1")))
    # the second numbers after what it read before
    two.last_number = lambda c, column="seqno": 0
    raises("STATE_CHANGED", two.put, c, puts(spark, ("a", "2")))
    one.create_snapshot(c, 1)
    raises("STATE_CHANGED", two.create_snapshot, c, 2)
    assert one.check(c).count() == 0 and [r["data"] for r in one.view(c).collect()] == ["1"]
    (tmp_path / "1" / f"g{c.generation}" / "batch-2" / "_temporary").mkdir(parents=True)  # as a crash leaves it
    raises("STATE_CHANGED", one.put, c, puts(spark, ("b", "2")))
    assert one.recover() == 1 and one.put(c, puts(spark, ("b", "2"))) == 1


def test_windows_of_zero_and_read_only_containers(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    c = store.open("z", create=True, schema=log_schema(spark))
    store.put(c, puts(spark, ("a", "1"), ("b", "2")))
    assert store.scan(c, ranges.Range(up_to=0)).count() == 0 and store.scan(c, ranges.Range(up_to=1)).count() == 1
    raises("FAILURE_OPERATION_DISALLOWED", store.put, c, puts(spark, ("a", "1")), "trim")
    store.open("z", read_only=True)
    for call in (lambda: store.put(c, puts(spark, ("a", "1"))), lambda: store.update_range(c, F.lit(True), F.col("data")), lambda: store.remove(c, keys(spark, "a")), lambda: store.scavenge(c)):
        raises("FAILURE_OPERATION_DISALLOWED", call)
    store.open("z")
    assert store.put(c, puts(spark, ("c", "3"))) == 1


def test_deletes_expiry_and_range_updates_are_stored(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    schema = spark.createDataFrame([], SCHEMA + ", create_time long, expiry_time long").schema
    c = store.open("e", create=True, schema=schema)
    store.put(c, puts(spark, ("a.1", "x"), ("a.2", "x"), ("b.1", "x")), now=100, expires=200)
    store.put(c, puts(spark, ("c.1", "x")), now=150, expires=0)
    store.put(c, puts(spark, ("d.1", "x")).withColumn("expiry_time", F.lit(120)), now=90, expires=999)
    live = lambda **w: sorted(r["key"] for r in store.view(c, **w).collect())
    assert live() == ["a.1", "a.2", "b.1", "c.1", "d.1"] and live(now=120) == ["a.1", "a.2", "b.1", "c.1"] and live(now=200) == ["c.1"]
    raises("EXPIRED", store.get, c, "d.1", 120)
    assert store.get(c, "c.1", 10**9)["data"] == "x"
    assert store.sweep(c, 120) == 0 and store.sweep(c, 121) == 1 and live() == ["a.1", "a.2", "b.1", "c.1"]
    n, big = store.update_range(c, F.col("key").startswith("a."), F.concat("data", "key"), F.col("key") != "a.9", limit=4)
    assert n == 2 or big.count() == 0
    assert [r["data"] for r in store.scan(c).collect()] == ["xa.1", "xa.2", "x", "x"]
    n, big = store.update_range(c, F.col("key").startswith("a."), F.when(F.col("key") == "a.1", "long data").otherwise("y"), limit=4)
    assert n == 1 and [r["key"] for r in big.collect()] == ["a.1"]
    store.remove_one(c, "b.1")
    raises("OBJECT_UNKNOWN", store.remove_one, c, "b.1")
    prefixes = spark.createDataFrame([("a", 100), ("c", 149)], "prefix string, start_time long")
    assert store.remove_by_prefix(c, prefixes, ".") == 2 and live() == ["c.1"]
    assert store.check(c).count() == 0
    assert store.remove(c, keys(spark, "c.1"), force=True) == 1
    assert store.log(store.props(c.cguid)).where("key = 'c.1'").count() == 0


def test_log_containers_are_written(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    c = store.open("log", create=True, kind="LOG")
    rows = [(f"{n:02d}_{pg}", f"d{n}{pg}") for pg in "xy" for n in range(1, 6)]
    assert store.append_records(c, puts(spark, *rows)) == 10
    assert store.append_records(c, puts(spark, ("3_x", None)), "DELETE") == 1 and store.append_records(c, puts(spark, ("2_y", None)), "TRIM") == 1
    raises("BAD_KEY", store.append_records, c, puts(spark, ("7_x", "good"), ("nokey", "bad")))
    got = lambda pg=None: [(r["pg"], r["counter"]) for r in store.enumerate(c, pg).collect()]
    assert got() == [("x", 1), ("x", 2), ("x", 4), ("x", 5), ("y", 3), ("y", 4), ("y", 5)] and got("y") == [("y", 3), ("y", 4), ("y", 5)]
    assert store.record(c, 4, "x")["data"] == "d4x"
    raises("OBJECT_UNKNOWN", store.record, c, 1, "y")
    mixed = puts(spark, ("9_x", "n"), ("4_x", None)).withColumn("kind", F.when(F.col("key") == "9_x", "WRITE").otherwise("TRIM"))
    assert store.append_records(c, mixed, None) == 2 and got("x") == [("x", 5), ("x", 9)]
    before = got()
    c = store.reclaim(c)
    assert got() == before and store.records(c).count() == 2 + 3 + 2 and store.check(c).count() == 0
    for call in (lambda: store.view(c), lambda: store.put(c, puts(spark, ("a", "b"))), lambda: store.scavenge(c), lambda: store.remove(c, keys(spark, "1_x"))):
        with pytest.raises(StoreError):
            call()


def test_transactions_write_once_the_outermost_commits(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    a, b = (store.open(n, create=True, schema=log_schema(spark)) for n in "ab")
    store.put(b, puts(spark, ("old", "1")))
    t = store.transaction()
    raises("FAILURE_NO_TRANS", t.commit)
    raises("FAILURE_NO_TRANS", t.put, a, puts(spark, ("k", "1")))
    t.start()
    raises("TRANS_LEVEL_EXCEEDED", t.start, False)
    t.start()
    t.put(a, puts(spark, ("k", "1"), ("l", "1")))
    t.put(b, puts(spark, ("k", "2")))
    assert t.commit() == 0 and store.view(a).count() == 0
    t.put(a, puts(spark, ("k", "3")))
    t.remove(b, keys(spark, "old", "k", "none"))
    assert t.commit() == 6 and t.current() == 0
    assert sorted((r["key"], r["data"], r["seqno"]) for r in store.view(a).collect()) == [("k", "3", 3), ("l", "1", 2)]
    assert store.view(b).count() == 0
    t.start()
    t.put(a, puts(spark, ("m", "9")))
    t.rollback()
    assert store.view(a).count() == 2


def test_administration(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    c = store.open("adm", create=True, schema=log_schema(spark))
    store.put(c, puts(spark, ("a", "1"), ("a", "2")))
    assert store.command("autodump on") is True
    dumped = spark.read.json(store.command("scavenge all"))
    assert {(r["container"], r["num_objs"]) for r in dumped.collect()} == {("adm", 1), (None, 1)}
    assert spark.read.json(store.command("stats_dump 7")).count() == 2
    store.command("log_level error")
    c = store.props(c.cguid)
    store.append(c, spark.createDataFrame([(None, "x", 9, False), ("a", "2", 2, False), ("b", "1", 0, False)], SCHEMA))
    found = {r["error"] for r in store.command("container check adm").collect()}
    assert found == {"NULL_KEY", "DUPLICATE_SEQNO", "BAD_SEQNO"}
    store.snaps[c.cguid] = [(99, 1)]
    assert "SNAPSHOT_AHEAD" in {r["error"] for r in store.check(c).collect()}
