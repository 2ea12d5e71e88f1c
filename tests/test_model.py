"""Operators against a plain model of the store, and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from keystrata.errors import StoreError, describe
from keystrata.functions.ordered import row_numbers, running_sums
from keystrata.functions.scalars import blocks_512, log2_bucket, parse_size, parse_time
from keystrata.operators import backup, caches, expiry, heavy_hitters, integrity, log_containers, points, ranges, range_update, snapshots, statistics, transactions, versions

LOG = "key string, data string, seqno long, tombstone boolean"


def random_log(seed, n=300, keys=25):
    r = random.Random(seed)
    return [(f"k{r.randrange(keys):02d}", f"d{i}", i, r.random() < 0.25) for i in range(1, n + 1)]


def model(log, up_to=None, after=None):
    newest = {}
    for k, d, s, t in log:
        if (up_to is None or s <= up_to) and (after is None or s > after) and (k not in newest or newest[k][1] < s):
            newest[k] = (d, s, t)
    return {k: (d, s) for k, (d, s, t) in newest.items() if not t}


def as_map(df):
    return {r["key"]: (r["data"], r["seqno"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_versions_follow_the_model(spark, seed):
    log = random_log(seed)
    df = spark.createDataFrame(log, LOG)
    assert as_map(versions.live(df)) == model(log)
    assert as_map(versions.live(df, up_to=150)) == model(log, 150)
    assert as_map(versions.live(df, after=100, up_to=200)) == model(log, 200, 100)


@pytest.mark.parametrize("seed", [4, 5])
def test_scavenge_keeps_every_retained_read(spark, seed):
    log, snaps = random_log(seed), [60, 120, 240]
    df = spark.createDataFrame(log, LOG)
    kept = snapshots.scavenge(df, snaps)
    assert kept.count() < df.count()
    for s in [*snaps, None]:
        assert as_map(versions.live(kept, up_to=s)) == model(log, s)


def test_scavenge_edge_cases(spark):
    rows = [("lone", None, 1, True), ("gone", "a", 2, False), ("gone", None, 3, True), ("back", "a", 4, False), ("back", None, 5, True), ("back", "b", 6, False), ("at", "x", 7, False), ("at", "y", 8, False)]
    df = spark.createDataFrame(rows, LOG)
    kept = {(r["key"], r["seqno"]) for r in snapshots.scavenge(df, []).collect()}
    assert kept == {("lone", 1), ("back", 6), ("at", 8)}
    kept = {(r["key"], r["seqno"]) for r in snapshots.scavenge(df, [7, 7]).collect()}
    assert kept == {("lone", 1), ("gone", 3), ("back", 6), ("at", 7), ("at", 8)} - {("gone", 3)}
    assert snapshots.scavenge(df.limit(0), [5]).count() == 0


def test_snapshot_catalog(spark):
    none = spark.createDataFrame([], "snap_seq long, ts long")
    log = spark.createDataFrame(random_log(1), LOG)
    one = snapshots.create(none, log, 10)
    assert [tuple(r) for r in one.collect()] == [(300, 10)]
    with pytest.raises(StoreError) as e:
        snapshots.delete(one, 5)
    assert e.value.status == "SNAPSHOT_NOT_FOUND"
    with pytest.raises(StoreError):
        snapshots.create(one, log, 11, limit=1)
    assert snapshots.sequence_numbers(snapshots.delete(one, 300)) == []


BOUNDS = [(None, None, None, None)] + [(a, f, b, g) for f in ("gt", "ge") for g in ("lt", "le") for a, b in (("k03", "k12"), ("k05", "k05"), ("k0", "k9"))] + [(a, f, b, g) for f in ("lt", "le") for g in ("gt", "ge") for a, b in (("k12", "k03"), ("k05", "k05"))]


@pytest.mark.parametrize("bound", BOUNDS)
def test_ranges(spark, bound):
    log = random_log(7, keys=20)
    live = versions.live(spark.createDataFrame(log, LOG))
    a, f, b, g = bound
    r = ranges.Range(a, f, b, g)
    test = {"gt": lambda k, v: k > v, "ge": lambda k, v: k >= v, "lt": lambda k, v: k < v, "le": lambda k, v: k <= v}
    wanted = sorted((k for k in model(log) if (not f or test[f](k, a)) and (not g or test[g](k, b))), reverse=not r.ascending)
    assert [x["key"] for x in ranges.scan(live, r).collect()] == wanted
    cursor, got = ranges.Cursor(live, r), []
    while True:
        rows, status = cursor.next(4)
        got += [x["key"] for x in rows]
        if status == "QUERY_DONE":
            break
    assert got == wanted
    assert cursor.next(4, generation=9)[1] == "STATE_CHANGED"


@pytest.mark.parametrize("bad", [{"start": "a"}, {"start_flag": "gt"}, {"start": "a", "start_flag": "gt", "end": "b", "end_flag": "ge"}, {"start": "a", "start_flag": "eq"}, {"after": 3}, {"start": "a", "start_flag": "gt", "descending": True}])
def test_invalid_ranges(bad):
    with pytest.raises(StoreError) as e:
        ranges.Range(**bad)
    assert e.value.status == "INVALID_RANGE"


def test_pause_groups_split_pages_and_lose_nothing(spark):
    rows = [(f"{i:04d}", c) for i, c in enumerate("aaabbbaaccccccb" * 20)]
    df = spark.createDataFrame(rows, "key string, c string")
    got = {r["key"]: r["page_id"] for r in ranges.pause_groups(df, "key", F.col("c"), ranges=5).collect()}
    page, before, wanted = 0, None, {}
    for k, c in rows:
        page += c != before
        before, wanted[k] = c, page
    assert got == wanted
    assert ranges.pause_groups(df.limit(0), "key", F.col("c")).count() == 0


def test_bytes_are_unsigned(spark):
    df = spark.createDataFrame([(bytearray(b"\x7f"),), (bytearray(b"\x80"),), (bytearray(b"a"),), (bytearray(b"ab"),)], "key binary")
    assert [bytes(r["key"]) for r in ranges.scan(df, ranges.Range()).collect()] == [b"a", b"ab", b"\x7f", b"\x80"]


def test_writes(spark):
    live = spark.createDataFrame([("a", "1", 1), ("b", "2", 2)], "key string, data string, seqno long")
    batch = spark.createDataFrame([("c", "9", 1), ("c", "8", 2), ("a", "7", 3), ("d", "6", 4)], "key string, data string, ord long")
    assert {r["ord"] for r in points.insert(live, batch).collect()} == {1, 2, 4}
    assert {r["ord"] for r in points.update(live, batch).collect()} == {3}
    assert {r["ord"] for r in points.multi_put(live, batch, "insert").collect()} == {1}
    assert points.multi_put(live, batch, "update").count() == 0
    assert points.multi_put(live, batch.limit(0), "update").count() == 0
    assert points.multi_put(live, batch).count() == 4
    with pytest.raises(StoreError):
        points.multi_put(live, batch, "trim")
    assert {r["key"]: r["data"] for r in points.upsert(live, batch).collect()} == {"a": "7", "b": "2", "c": "8", "d": "6"}
    assert [(r["ord"], r["seqno"]) for r in points.numbered(batch, 10, ["ord"]).orderBy("ord").collect()] == [(1, 11), (2, 12), (3, 13), (4, 14)]
    with pytest.raises(StoreError) as e:
        points.read(live, "zz")
    assert e.value.status == "OBJECT_UNKNOWN" and describe("EXPIRED")


def test_conditional_put_folds_in_order(spark):
    live = spark.createDataFrame([("a", 5)], "key string, data long")
    batch = spark.createDataFrame([("a", 4, 1), ("a", 6, 2), ("a", 6, 3), ("a", 9, 4), ("n", 1, 5), ("n", 0, 6), ("n", 2, 7)], "key string, data long, ord long")
    got = {r["ord"] for r in points.conditional_put(live, batch, lambda old, new: new > old).collect()}
    assert got == {2, 4, 5, 7}
    assert {(r["key"], r["data"]) for r in points.put_if_greater(live, batch).collect()} == {("a", 9), ("n", 2)}


def test_range_update(spark):
    live = spark.createDataFrame([("p_1", "aa"), ("p_2", "b"), ("q_1", "c")], "key string, data string")
    done = range_update.range_update(live, range_update.by_prefix("key", "p_"), F.concat("data", F.lit("xyz")), limit=4)
    assert {(r["key"], r["data"], r["changed"], r["status"]) for r in done.collect()} == {("p_1", "aa", False, "OBJECT_TOO_BIG"), ("p_2", "bxyz", True, "SUCCESS")}
    assert range_update.changed_rows(done).count() == 1


def test_log_keys(spark):
    keys = ["007_pg_x", "7_pg_x", "_pg", "12_", "x1_pg", "nounderscore", "3_a_b_c", "", "99999999999999999999_p"]
    got = {r["key"]: (r["counter"], r["pg"], r["other"], r["status"]) for r in log_containers.decode(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    assert got["007_pg_x"][:3] == got["7_pg_x"][:3] == (7, "pg", "_x")
    assert got["_pg"][:3] == (0, "pg", "") and got["12_"][:3] == (12, "", "") and got["3_a_b_c"][:3] == (3, "a", "_b_c")
    assert {k for k, v in got.items() if v[3] == "BAD_KEY"} == {"x1_pg", "nounderscore", ""}
    long = log_containers.decode(spark.createDataFrame([("1_" + "p" * 4000, "d"), ("1_p", "d" * 3999)], "key string, data string"))
    assert {r["status"] for r in long.collect()} == {"KEY_TOO_LONG", "OBJECT_TOO_BIG"}


def test_log_trim_hides_later_lower_counters(spark):
    rows = [(1, "WRITE", "5_g_a"), (2, "TRIM", "4_g"), (3, "WRITE", "4_g_b"), (4, "WRITE", "6_g"), (5, "WRITE", "06_g"), (6, "DELETE", "5_g_a"), (7, "WRITE", "1_h")]
    d = log_containers.decode(spark.createDataFrame(rows, "ord long, kind string, key string"))
    assert [r["ord"] for r in log_containers.enumerate_groups(d).collect()] == [5, 7]
    assert log_containers.read(d, 6, "g").count() == 1 and log_containers.read(d, 4, "g", "_b").count() == 0
    assert {r["ord"] for r in log_containers.reclaim(d).collect()} == {1, 2, 4, 5, 6, 7}


def test_expiry_boundaries(spark):
    df = spark.createDataFrame([("never", 10, 0), ("at", 10, 100), ("after", 10, 101), ("before", 10, 99)], "key string, create_time long, expiry_time long")
    assert {r["key"] for r in expiry.readable(df, 100).collect()} == {"never", "after"}
    assert {r["key"] for r in expiry.sweep(df, 100).collect()} == {"never", "after", "at"}
    assert expiry.readable(df, 0).count() == 4
    assert expiry.readable(df, 100, flush_time=10).count() == 0 and expiry.readable(df, 100, flush_time=9).count() == 2
    assert expiry.sweep(df, 100, flush_time=10).count() == 3


def test_statistics(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 4.0), ("a", 16.0), ("b", 3.0)], "g string, v double")
    got = {r["g"]: r for r in statistics.report(statistics.partial(df, F.col("v"), ["g"]), ["g"]).collect()}
    assert got["a"]["n"] == 3 and got["a"]["geo"] == 4.0 and got["b"]["std"] is None
    assert statistics.report(statistics.partial(df.limit(0), F.col("v"), []), []).first()["n"] == 0
    values = [0, 1, 2, 3, 4, 5, 2**29, 2**29 + 1, 2**51, 2**51 + 1]
    buckets = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(log2_bucket(F.col("v"))).collect()]
    assert buckets == [0 if v <= 1 else (v - 1).bit_length() for v in values]
    blocks = [r[0] for r in spark.createDataFrame([(v,) for v in (0, 512, 513, 8192, 8193, 9000)], "v long").select(blocks_512(F.col("v"))).collect()]
    assert blocks == [1, 1, 2, 5, 17, 18]


def test_running_sums_over_ranges(spark):
    rows = [(i * 37 % 1000, i % 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = {r["k"]: (r["s"], r["rn"]) for r in running_sums(df, ["k"], {"s": F.col("v"), "rn": F.lit(1)}, ranges=6).collect()}
    total, wanted = 0, {}
    for n, (k, v) in enumerate(sorted(rows), 1):
        total += v
        wanted[k] = (total, n)
    assert got == wanted
    assert row_numbers(df.limit(0), ["k"]).count() == 0


def test_heavy_hitters(spark):
    df = spark.createDataFrame([("a", "x")] * 5 + [("b", "x")] * 5 + [("c", "y")], "key string, client string")
    assert [r["key"] for r in heavy_hitters.top(heavy_hitters.counts(df), 2).collect()] == ["a", "b"]
    assert {(r["client"], r["key"], r["rank"]) for r in heavy_hitters.top_in_each(heavy_hitters.counts(df, by_client="client"), 1, "client").collect()} == {("x", "a", 1), ("y", "c", 1)}
    assert [r[0] for r in spark.range(0, 13).select(heavy_hitters.classify(F.col("id"))).collect()] == [None, "GET", "GET", *["UPDATE"] * 9, None]


def test_restore_equals_live(spark):
    log = random_log(9)
    df = spark.createDataFrame(log, LOG)
    feeds = [backup.change_feed(df, *w) for w in ((None, 100), (100, 200), (200, 300))]
    assert as_map(backup.restore(feeds)) == model(log)
    assert backup.begin(None, 5, True) == (None, 5) and backup.begin(3, 5, False) == (3, 5)
    with pytest.raises(StoreError):
        backup.begin(None, 5, False)


def test_transactions(spark):
    t = transactions.Session()
    with pytest.raises(StoreError):
        t.commit()
    rows = spark.range(2)
    assert t.start() == 1 and t.start() == 1 and t.current() == 1
    t.put(rows)
    assert t.commit() is None
    assert t.commit().count() == 2 and t.current() == 0
    t.start()
    t.put(rows)
    t.rollback()
    assert not t.staged
    touches = spark.createDataFrame([(1, "n", 1, 2, True), (2, "n", 3, 4, False), (3, "n", 2, 3, False), (4, "m", 1, 9, False), (5, "m", 2, 3, False), (2, "m", 20, 30, True)], "trx long, node string, lo long, hi long, write boolean")
    edges = transactions.conflicts(touches)
    assert {tuple(r) for r in edges.collect()} == {(1, 2, "before"), (1, 3, "overlap"), (4, 2, "before"), (5, 2, "before")}
    order = {r["trx"]: r["level"] for r in transactions.commit_order(touches, edges).collect()}
    assert order == {1: -1, 3: -1, 4: 0, 5: 0, 2: 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_order_without_pairs_is_the_order_of_all_pairs(spark, seed):
    r = random.Random(seed)
    rows = [(t, f"n{r.randrange(8)}", s, s + r.randrange(3), r.random() < 0.4) for t in range(60) for s in [t * 3 + r.randrange(4)] for _ in range(2)]
    touches = spark.createDataFrame(list({(t, n): (t, n, a, b, w) for t, n, a, b, w in rows}.values()), "trx long, node string, lo long, hi long, write boolean")
    pairs = transactions.conflicts(touches)
    bad = transactions.uncommittable(touches)
    assert {x[0] for x in bad.collect()} == {t for x in pairs.where("relation = 'overlap'").collect() for t in x[:2]}
    edges = transactions.order_edges(touches, bad)
    assert edges.count() <= pairs.where("relation = 'before'").count()
    assert {tuple(x) for x in transactions.commit_order(touches, edges, bad).collect()} == {tuple(x) for x in transactions.commit_order(touches, pairs).collect()}


def test_replay_twice_is_replay_once(spark):
    redo = spark.createDataFrame([("a", 1, "x", 1), ("a", 2, "y", 2), ("b", 3, "z", None)], "key string, lsn long, data string, trx long")
    committed = spark.createDataFrame([(1,)], "trx long")
    once = transactions.replay(redo, committed)
    twice = transactions.replay(once.unionByName(redo), committed)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str) == [("a", 1, "x", 1), ("b", 3, "z", None)]


def test_integrity(spark):
    stored = spark.createDataFrame([("n", 1, 5), ("n", 2, 5), ("n", 3, 9)], "node string, place long, key long")
    assert integrity.check_order(stored, "node", "place").count() == 1
    bounds = spark.createDataFrame([("n", 0, 9)], "node string, low long, high long")
    assert integrity.check_bounds(stored, bounds, "node").count() == 1
    whole = integrity.check(integrity.check_order(stored, "node", "place"), integrity.check_bounds(stored, bounds, "node"))
    assert whole.columns == ["entity", "id", "error", "msg"] and whole.count() == 2


def test_caches(spark):
    access = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "key string, ord long")
    assert {r["key"] for r in caches.lru_resident(access, 2).collect()} == {"a", "c"}
    assert {r["key"] for r in caches.lru_evicted(access, 2).collect()} == {"b"}
    sized = spark.createDataFrame([(1, 10), (2, 20), (3, 5)], "ord long, size long")
    assert {r["ord"] for r in caches.fifo_retained(sized, F.col("size"), 25).collect()} == {2, 3}
    old, new = spark.createDataFrame([("a", 1)], "key string, data long"), spark.createDataFrame([("a", 2), ("b", 3)], "key string, data long")
    assert {tuple(r) for r in caches.map_set(old, new).collect()} == {("a", 2, 1), ("b", 3, None)}
    assert caches.map_create(old, new).count() == caches.map_update(old, new).count() == 1 and caches.map_delete(old, new).count() == 0


@pytest.mark.parametrize("text,value", [("10", 10), ("2k", 2048), ("0x10", 16), ("010", 8), ("3G", 3 << 30), ("1p", 1 << 50)])
def test_parse_size(text, value):
    assert parse_size(text) == value


@pytest.mark.parametrize("text,value", [("end", -1), ("2", 2 * 10**9), ("5ms", 5 * 10**6), ("1.5m", 90 * 10**9), ("1d", 86400 * 10**9)])
def test_parse_time(text, value):
    assert parse_time(text) == value


@pytest.mark.parametrize("bad", ["", "x", "5q", "9999999999999999999"])
def test_bad_sizes(bad):
    with pytest.raises(StoreError):
        parse_size(bad)
