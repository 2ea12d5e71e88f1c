"""Every operator as a query over the driver's tables, with its SQL for DuckDB beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import row_numbers
from ..functions.scalars import blocks_512, epoch_seconds, format_bytes, format_count, key_prefix, log2_bucket, shard_of
from ..operators import backup, caches, expiry, heavy_hitters, integrity, log_containers, points, ranges, range_update, snapshots, statistics, transactions, versions
from ..sources.containers import Store
from ..sources.shared import shared_dir
from ..sources.tables import access_log, expiring_log, log_records, table, version_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Snapshots, ranges and capacities are at these tenths or hundredths of the table's largest key, so they grow with it.
TENTHS = (2, 5, 8)
NOW = 1_704_500_000

VL = "SELECT user_id AS key, event_id AS seqno, event_type = 'error' AS tombstone, value AS data, CAST(floor(epoch(ts)) AS BIGINT) AS create_time FROM events"
XL = f"SELECT *, CAST(CASE WHEN seqno % 4 = 0 THEN 0 ELSE create_time + floor(data) * 60 END AS BIGINT) AS expiry_time FROM ({VL})"
LIVE = "SELECT * FROM ({log}) WHERE {where} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seqno DESC) = 1"
ACCESS = "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, user_id AS client, coalesce(json_extract_string(props, '$.k'), event_type) AS key, CASE WHEN event_type IN ('purchase', 'signup') THEN 'UPDATE' ELSE 'GET' END AS op FROM events"
RECORDS = """SELECT conv_id * 1000 + turn AS ord, 'WRITE' AS kind, format('{:03d}', turn) || '_' || conv_id || '_' || role AS key, text AS data, turn AS counter, CAST(conv_id AS VARCHAR) AS pg, '_' || role AS other FROM conversations
UNION ALL SELECT conv_id * 1000 + 900, 'TRIM', '1_' || conv_id, NULL, 1, CAST(conv_id AS VARCHAR), '' FROM conversations WHERE conv_id % 5 = 0 AND turn = 0
UNION ALL SELECT conv_id * 1000 + 901, 'DELETE', '2_' || conv_id || '_' || role, NULL, 2, CAST(conv_id AS VARCHAR), '_' || role FROM conversations WHERE conv_id % 7 = 0 AND turn = 2"""


def live_sql(where: str = "true", log: str = VL) -> str:
    """Newest in the window, tombstones hidden."""
    return f"SELECT * FROM ({LIVE.format(log=log, where=where)}) WHERE NOT tombstone"


def at_sql(table_name: str, column: str, percent: int) -> str:
    """The key at so many hundredths of the largest one."""
    return f"(SELECT max({column}) * {percent} // 100 FROM {table_name})"


def at(spark: SparkSession, sf: str, table_name: str, column: str, percent: int) -> int:
    """The same, in Spark; 0 for an empty table."""
    return (table(spark, sf, table_name).agg(F.max(column)).first()[0] or 0) * percent // 100


def snaps(spark: SparkSession, sf: str) -> list[int]:
    """The numbers of the snapshots that the queries use."""
    last = table(spark, sf, "events").agg(F.max("event_id")).first()[0] or 0
    return [last * k // 10 for k in TENTHS]


S2, S5, S8 = (at_sql("events", "event_id", 10 * k) for k in TENTHS)
O10, O20, O25, O40, O50, O60 = (at_sql("orders", "o_orderkey", k) for k in (10, 20, 25, 40, 50, 60))


def order_at(spark: SparkSession, sf: str, percent: int) -> int:
    return at(spark, sf, "orders", "o_orderkey", percent)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders"

# point reads


@query(f"{ORDERS} WHERE o_orderkey = {O50}")
def point_get(spark: SparkSession, sf: str) -> DataFrame:
    return points.get(_orders(spark, sf), order_at(spark, sf, 50), "o_orderkey")


@query(f"{ORDERS} WHERE o_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def multi_get(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return points.multi_get(_orders(spark, sf), keys, "o_orderkey")


# range queries


@query(f"{ORDERS} WHERE o_orderkey >= {O20} AND o_orderkey < {O40} ORDER BY o_orderkey")
def range_ge_lt(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.scan(_orders(spark, sf), ranges.Range(order_at(spark, sf, 20), "ge", order_at(spark, sf, 40), "lt"), "o_orderkey")


@query(f"{ORDERS} WHERE o_orderkey > {O20} AND o_orderkey <= {O40} ORDER BY o_orderkey")
def range_gt_le(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.scan(_orders(spark, sf), ranges.Range(order_at(spark, sf, 20), "gt", order_at(spark, sf, 40), "le"), "o_orderkey")


@query(f"{ORDERS} WHERE o_orderkey < {O40} AND o_orderkey >= {O25} ORDER BY o_orderkey DESC")
def range_desc(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.scan(_orders(spark, sf), ranges.Range(order_at(spark, sf, 40), "lt", order_at(spark, sf, 25), "ge"), "o_orderkey")


@query(f"{ORDERS} WHERE o_orderkey <= {O50} AND o_orderkey > {O10} ORDER BY o_orderkey DESC LIMIT 500")
def range_desc_page(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.page(_orders(spark, sf), ranges.Range(order_at(spark, sf, 50), "le", order_at(spark, sf, 10), "gt"), 500, key="o_orderkey")


@query(f"SELECT o_orderkey FROM orders WHERE o_orderkey >= {O10} AND o_orderkey <= {O60}")
def range_keys_only(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.scan(_orders(spark, sf), ranges.Range(order_at(spark, sf, 10), "ge", order_at(spark, sf, 60), "le", keys_only=True), "o_orderkey")


@query(f"{ORDERS} WHERE o_orderkey > {O25} ORDER BY o_orderkey LIMIT 300")
def range_page_resume(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.page(_orders(spark, sf), ranges.Range(order_at(spark, sf, 10), "ge"), 300, last=order_at(spark, sf, 25), key="o_orderkey")


@query(f"{ORDERS} ORDER BY o_orderkey")
def range_open(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.scan(_orders(spark, sf), ranges.Range(), "o_orderkey")


@query("""WITH f AS (SELECT o_orderkey, o_orderstatus, CASE WHEN lag(o_orderstatus) OVER (ORDER BY o_orderkey) = o_orderstatus THEN 0 ELSE 1 END AS turn FROM orders)
SELECT o_orderkey, o_orderstatus, CAST(sum(turn) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS page_id FROM f""")
def range_pause_groups(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.pause_groups(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", F.col("o_orderstatus"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE starts_with(p_name, 'a') OR starts_with(p_name, 'b') ORDER BY p_name, p_partkey")
def range_string_keys(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return ranges.within(parts, ranges.Range("a", "ge", "c", "lt"), "p_name").orderBy("p_name", "p_partkey")


# versions


@query(live_sql())
def live_latest(spark: SparkSession, sf: str) -> DataFrame:
    return versions.live(version_log(spark, sf))


@query(live_sql(f"seqno <= {S5}"))
def snapshot_read(spark: SparkSession, sf: str) -> DataFrame:
    return versions.live(version_log(spark, sf), up_to=snaps(spark, sf)[1])


@query(live_sql(f"seqno > {S2} AND seqno <= {S5}"))
def incremental_read(spark: SparkSession, sf: str) -> DataFrame:
    return versions.live(version_log(spark, sf), after=snaps(spark, sf)[0], up_to=snaps(spark, sf)[1])


@query(f"SELECT * FROM ({live_sql(f'seqno <= {S5}')}) WHERE key >= {at_sql('events', 'user_id', 15)} AND key < {at_sql('events', 'user_id', 60)} ORDER BY key")
def snapshot_range(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.scan(versions.live(version_log(spark, sf), up_to=snaps(spark, sf)[1]), ranges.Range(at(spark, sf, "events", "user_id", 15), "ge", at(spark, sf, "events", "user_id", 60), "lt"))


@query(f"SELECT * FROM ({VL}) WHERE seqno = {at_sql('events', 'event_id', 43)}")
def exact_seqno_read(spark: SparkSession, sf: str) -> DataFrame:
    return versions.exact(version_log(spark, sf), at(spark, sf, "events", "event_id", 43))


@query(f"SELECT count(*) AS n_keys FROM ({live_sql(f'seqno > {S5} AND seqno <= {S8}')})")
def backup_simulation(spark: SparkSession, sf: str) -> DataFrame:
    return versions.count_increment(version_log(spark, sf), *snaps(spark, sf)[1:])


# writes; the batch: keys of all customers modulo 400, in order of customer


def _live(spark: SparkSession, sf: str) -> DataFrame:
    return versions.live(version_log(spark, sf), up_to=snaps(spark, sf)[1]).select("key", "data", "seqno")


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select((F.col("c_custkey") * 7 % 400).alias("key"), F.col("c_acctbal").alias("data"), F.col("c_custkey").alias("ord"))


def _touched(spark: SparkSession, sf: str) -> DataFrame:
    """The live objects of the batch's keys."""
    return points.live_of(version_log(spark, sf), _batch(spark, sf), up_to=snaps(spark, sf)[1]).select("key", "data", "seqno")


L5 = f"SELECT key, data, seqno FROM ({live_sql(f'seqno <= {S5}')})"
BATCH = "SELECT c_custkey * 7 % 400 AS key, c_acctbal AS data, c_custkey AS ord FROM customer"


@query(f"SELECT * FROM ({BATCH}) WHERE key NOT IN (SELECT key FROM ({L5}))")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    return points.insert(_touched(spark, sf), _batch(spark, sf))


@query(f"SELECT * FROM ({BATCH}) WHERE key IN (SELECT key FROM ({L5}))")
def update_if_present(spark: SparkSession, sf: str) -> DataFrame:
    return points.update(_touched(spark, sf), _batch(spark, sf))


@query(f"SELECT DISTINCT key, CAST(NULL AS DOUBLE) AS data, CAST(NULL AS BIGINT) AS seqno, true AS tombstone, CAST(NULL AS BIGINT) AS create_time FROM ({BATCH}) WHERE key IN (SELECT key FROM ({L5}))")
def delete_present(spark: SparkSession, sf: str) -> DataFrame:
    return points.delete(versions.live(version_log(spark, sf), up_to=snaps(spark, sf)[1]), _batch(spark, sf))


@query(f"SELECT * FROM ({VL}) WHERE key NOT IN (SELECT key FROM ({BATCH}) WHERE key % 2 = 0)")
def force_delete(spark: SparkSession, sf: str) -> DataFrame:
    return points.force_delete(version_log(spark, sf), _batch(spark, sf).where("key % 2 = 0"))


@query(f"WITH b AS ({BATCH}), l AS ({L5}) SELECT key, data FROM (SELECT key, data, 0 AS s, 0 AS ord FROM l UNION ALL SELECT key, data, 1, ord FROM b) QUALIFY row_number() OVER (PARTITION BY key ORDER BY s DESC, ord DESC) = 1")
def mput_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return points.upsert(_live(spark, sf).select("key", "data"), _batch(spark, sf))


# batches of falling keys: for inserts they begin over the largest key there is, for updates with it
FALLING = "SELECT (SELECT max(user_id) FROM events) + {over} - c_custkey AS key, c_acctbal AS data, c_custkey AS ord FROM customer"
INSERTS, UPDATES = FALLING.format(over="1 + (SELECT max(c_custkey) // 2 FROM customer)"), FALLING.format(over=0)


def _falling(spark: SparkSession, sf: str, over: int) -> DataFrame:
    top = at(spark, sf, "events", "user_id", 100) + over
    return table(spark, sf, "customer").select((F.lit(top).cast("long") - F.col("c_custkey")).alias("key"), F.col("c_acctbal").alias("data"), F.col("c_custkey").alias("ord"))


def _live_for(spark: SparkSession, sf: str, batch: DataFrame) -> DataFrame:
    return points.live_of(version_log(spark, sf), batch, up_to=snaps(spark, sf)[1]).select("key", "data", "seqno")


@query(f"WITH b AS ({INSERTS}), l AS ({L5}), v AS (SELECT min(ord) AS stop FROM (SELECT ord FROM b WHERE key IN (SELECT key FROM l) UNION ALL SELECT ord FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) > 1)) SELECT b.* FROM b, v WHERE stop IS NULL OR ord < stop")
def mput_insert(spark: SparkSession, sf: str) -> DataFrame:
    batch = _falling(spark, sf, 1 + at(spark, sf, "customer", "c_custkey", 100) // 2)
    return points.multi_put(_live_for(spark, sf, batch), batch, "insert")


@query(f"WITH b AS ({UPDATES}), l AS ({L5}), v AS (SELECT min(ord) AS stop FROM b WHERE key NOT IN (SELECT key FROM l)) SELECT b.* FROM b, v WHERE stop IS NULL OR ord < stop")
def mput_update(spark: SparkSession, sf: str) -> DataFrame:
    batch = _falling(spark, sf, 0)
    return points.multi_put(_live_for(spark, sf, batch), batch, "update")


@query(f"WITH b AS (SELECT key, max(data) AS data FROM ({BATCH}) GROUP BY key) SELECT b.key, b.data, (SELECT min(ord) FROM ({BATCH}) x WHERE x.key = b.key AND x.data = b.data) AS ord FROM b LEFT JOIN ({L5}) l ON l.key = b.key WHERE l.key IS NULL OR b.data > l.data")
def conditional_put_max(spark: SparkSession, sf: str) -> DataFrame:
    return points.put_if_greater(_touched(spark, sf), _batch(spark, sf))


@query(f"""WITH b AS (SELECT b.key, b.data, b.ord, l.data AS old, max(b.data) OVER (PARTITION BY b.key ORDER BY b.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY b.key ORDER BY b.ord) AS rn FROM ({BATCH}) b LEFT JOIN ({L5}) l ON l.key = b.key)
SELECT key, data, ord FROM b WHERE (old IS NULL AND rn = 1) OR data > greatest(coalesce(old, -1e18), coalesce(before, -1e18))""")
def conditional_put_fold(spark: SparkSession, sf: str) -> DataFrame:
    return points.conditional_put(_touched(spark, sf), _batch(spark, sf), lambda old, new: new > old)


@query(f"SELECT key, data, ord, 10000 + row_number() OVER (ORDER BY ord) AS seqno FROM ({BATCH})")
def seqno_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return points.numbered(_batch(spark, sf), 10000, ["ord"])


@query(f"SELECT key, data FROM ({L5}) WHERE key NOT IN (3, 4) UNION ALL SELECT 34 + 1000, sum(data) FROM ({L5}) WHERE key IN (3, 4)")
def merge_objects(spark: SparkSession, sf: str) -> DataFrame:
    rows = _live(spark, sf).select("key", "data")
    merged = rows.where("key IN (3, 4)").agg(F.sum("data").alias("data")).select(F.lit(1034).cast("long").alias("key"), "data")
    return points.merge(rows, 3, 4, merged)


# snapshots


@query(f"SELECT seqno, CAST(CASE {' '.join(f'WHEN seqno <= {s} THEN {s}' for s in (S2, S5, S8))} ELSE -1 END AS BIGINT) AS owner FROM ({VL})")
def owner_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return version_log(spark, sf).select("seqno", snapshots.owner(F.col("seqno"), snaps(spark, sf)).alias("owner"))


@query(f"""WITH o AS (SELECT *, CASE {' '.join(f'WHEN seqno <= {s} THEN {s}' for s in (S2, S5, S8))} ELSE -1 END AS owner FROM ({VL})),
k AS (SELECT *, count(*) OVER (PARTITION BY key) AS versions FROM o QUALIFY row_number() OVER (PARTITION BY key, owner ORDER BY seqno DESC) = 1)
SELECT key, seqno, tombstone, data, create_time FROM (SELECT *, count(*) OVER (PARTITION BY key) AS kept FROM k) WHERE NOT (tombstone AND versions > 1 AND kept = 1)""")
def scavenge(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.scavenge(version_log(spark, sf), snaps(spark, sf))


@query(f"SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM ({live_sql(f'seqno <= {S2}')}) a FULL JOIN ({live_sql(f'seqno <= {S8}')}) b ON a.key = b.key WHERE a.seqno IS DISTINCT FROM b.seqno")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.diff(version_log(spark, sf), *snaps(spark, sf)[::2])


@query(f"SELECT snap_seq, ts FROM (VALUES (2000::BIGINT, 1::BIGINT), (8000, 3)) t(snap_seq, ts) UNION ALL SELECT max(seqno), 4 FROM ({VL})")
def snapshot_catalog(spark: SparkSession, sf: str) -> DataFrame:
    have = spark.createDataFrame([(2000, 1), (5000, 2), (8000, 3)], "snap_seq long, ts long")
    return snapshots.listed(snapshots.create(snapshots.delete(have, 5000), version_log(spark, sf), 4))


# range update


@query("SELECT p_partkey, p_name, CASE WHEN p_size % 3 <> 0 THEN p_brand || '+' ELSE p_brand END AS p_brand, p_size % 3 <> 0 AS changed, 'SUCCESS' AS status FROM part WHERE starts_with(p_name, 'b')")
def range_update_prefix(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    done = range_update.range_update(parts, range_update.by_prefix("p_name", "b"), F.concat("p_brand", F.lit("+")), F.col("p_size") % 3 != 0, data="p_brand")
    return done.select("p_partkey", "p_name", "p_brand", "changed", "status")


@query("SELECT o_orderkey, CASE WHEN length(o_orderpriority || '-x') > 7 THEN o_orderpriority ELSE o_orderpriority || '-x' END AS o_orderpriority, length(o_orderpriority || '-x') <= 7 AS changed, CASE WHEN length(o_orderpriority || '-x') > 7 THEN 'OBJECT_TOO_BIG' ELSE 'SUCCESS' END AS status FROM orders WHERE o_orderkey >= " + O10 + " AND o_orderkey < " + O40)
def range_update_oversize(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return range_update.range_update(orders, (F.col("o_orderkey") >= order_at(spark, sf, 10)) & (F.col("o_orderkey") < order_at(spark, sf, 40)), F.concat("o_orderpriority", F.lit("-x")), data="o_orderpriority", limit=7)


# log containers


def _decoded(spark: SparkSession, sf: str) -> DataFrame:
    return log_containers.decode(log_records(spark, sf))


VISIBLE = f"""SELECT r.* FROM (SELECT * FROM ({RECORDS}) WHERE kind <> 'TRIM' QUALIFY row_number() OVER (PARTITION BY pg, counter, other ORDER BY ord DESC) = 1) r
LEFT JOIN (SELECT pg, max(counter) AS trim FROM ({RECORDS}) WHERE kind = 'TRIM' GROUP BY pg) t USING (pg) WHERE kind = 'WRITE' AND (trim IS NULL OR counter > trim)"""


@query(f"SELECT ord, key, CAST(counter AS BIGINT) AS counter, pg, other, 'SUCCESS' AS status FROM ({RECORDS})")
def log_decode(spark: SparkSession, sf: str) -> DataFrame:
    return _decoded(spark, sf).select("ord", "key", "counter", "pg", "other", "status")


@query("SELECT url, CASE WHEN regexp_matches(url, '^([0-9]*)_([^_]*)((?:_.*)?)$') THEN 'SUCCESS' ELSE 'BAD_KEY' END AS status FROM pages")
def log_bad_keys(spark: SparkSession, sf: str) -> DataFrame:
    return log_containers.decode(table(spark, sf, "pages").select("url"), "url", None).select("url", "status")


@query(f"SELECT ord, key, CAST(counter AS BIGINT) AS counter, pg, other FROM ({VISIBLE})")
def log_enumerate(spark: SparkSession, sf: str) -> DataFrame:
    return log_containers.enumerate_groups(_decoded(spark, sf)).select("ord", "key", "counter", "pg", "other")


@query(f"SELECT ord, key, CAST(counter AS BIGINT) AS counter, pg, other FROM ({VISIBLE}) WHERE pg = '12'")
def log_enumerate_group(spark: SparkSession, sf: str) -> DataFrame:
    return log_containers.enumerate_groups(_decoded(spark, sf), "12").select("ord", "key", "counter", "pg", "other")


@query(f"SELECT pg, CAST(max(counter) AS BIGINT) AS trim FROM ({RECORDS}) WHERE kind = 'TRIM' GROUP BY pg")
def log_trim(spark: SparkSession, sf: str) -> DataFrame:
    return log_containers.trims(_decoded(spark, sf))


@query(f"SELECT ord, key, data FROM ({VISIBLE}) WHERE pg = '3' AND counter = 2 AND other = '_user'")
def log_read(spark: SparkSession, sf: str) -> DataFrame:
    return log_containers.read(_decoded(spark, sf), 2, "3", "_user").select("ord", "key", "data")


@query(f"SELECT ord, kind, key FROM ({RECORDS}) r LEFT JOIN (SELECT pg AS tpg, max(counter) AS trim FROM ({RECORDS}) WHERE kind = 'TRIM' GROUP BY pg) t ON r.pg = t.tpg WHERE CASE WHEN kind = 'TRIM' THEN counter = trim ELSE trim IS NULL OR counter > trim END")
def log_reclaim(spark: SparkSession, sf: str) -> DataFrame:
    return log_containers.reclaim(_decoded(spark, sf)).select("ord", "kind", "key")


@query("SELECT event_id, user_id FROM events WHERE user_id % 10 NOT IN (3, 7)")
def log_revert(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", (F.col("user_id") % 10).alias("trx"))
    return log_containers.revert(rows, rows.where("trx IN (3, 7)").select("trx")).drop("trx")


# expiry

XLIVE = live_sql(log=XL)


@query(f"SELECT *, CASE WHEN expiry_time > 0 AND expiry_time <= {NOW} THEN 'EXPIRED' ELSE 'SUCCESS' END AS status FROM ({XL})")
def expiry_read(spark: SparkSession, sf: str) -> DataFrame:
    return expiry.read_status(expiring_log(spark, sf), NOW)


@query(f"SELECT * FROM ({XLIVE}) WHERE NOT (expiry_time > 0 AND expiry_time <= {NOW})")
def expiry_enumerate(spark: SparkSession, sf: str) -> DataFrame:
    return expiry.readable(versions.live(expiring_log(spark, sf)), NOW)


@query(f"SELECT * FROM ({XL}) WHERE NOT (expiry_time > 0 AND expiry_time < {NOW})")
def expiry_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return expiry.sweep(expiring_log(spark, sf), NOW)


@query(f"SELECT * FROM ({XL}) WHERE NOT (create_time <= {NOW - 86400}) AND NOT (expiry_time > 0 AND expiry_time <= {NOW})")
def flush_time(spark: SparkSession, sf: str) -> DataFrame:
    return expiry.readable(expiring_log(spark, sf), NOW, NOW - 86400)


@query("""WITH o AS (SELECT page_id, url, page_id AS create_time FROM pages),
r AS (SELECT url[1:instr(url, '.') - 1] AS prefix, max(page_id) + 5 AS start_time FROM pages WHERE page_id % 3 = 0 AND instr(url, '.') > 0 GROUP BY 1)
SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE instr(o.url, '.') > 0 AND o.url[1:instr(o.url, '.') - 1] = r.prefix AND o.create_time <= r.start_time)""")
def prefix_delete(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "pages").select("page_id", "url", F.col("page_id").alias("create_time"))
    seen = o.where("page_id % 3 = 0").select(key_prefix(F.col("url"), ".").alias("prefix"), (F.col("page_id") + 5).alias("start_time"), F.col("page_id").alias("ord")).where("prefix is not null")
    return expiry.delete_by_prefix(o, expiry.registrations(seen), ".", "url")


@query("SELECT url[1:instr(url, '.') - 1] AS prefix, max(page_id) + 5 AS start_time FROM pages WHERE page_id % 3 = 0 AND instr(url, '.') > 0 GROUP BY 1")
def prefix_list(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "pages").where("page_id % 3 = 0").select(key_prefix(F.col("url"), ".").alias("prefix"), (F.col("page_id") + 5).alias("start_time"), F.col("page_id").alias("ord")).where("prefix is not null")
    return expiry.registrations(seen)


# statistics

STATS = "count(value) AS n, round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS avg, round(exp(sum(CASE WHEN value <> 0 THEN ln(value) ELSE 0 END) / count(value)), 4) AS geo, round(stddev_samp(value), 4) AS std"


@query(f"SELECT event_type, {STATS} FROM events GROUP BY event_type")
def event_stats(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.report(statistics.partial(table(spark, sf, "events"), F.col("value"), ["event_type"]), ["event_type"], 4)


@query(f"SELECT event_type, {STATS} FROM events GROUP BY event_type")
def stats_merge(spark: SparkSession, sf: str) -> DataFrame:
    daily = statistics.partial(table(spark, sf, "events").withColumn("day", F.to_date("ts")), F.col("value"), ["event_type", "day"])
    return statistics.report(statistics.merged(daily, ["event_type"]), ["event_type"], 4)


@query("SELECT CASE WHEN strlen(text) <= 1 THEN 0 ELSE length(bin(strlen(text) - 1)) END AS bucket, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def log2_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.histogram(table(spark, sf, "documents"), F.octet_length("text")).select(F.col("bucket").cast("long").alias("bucket"), "n")


@query("""WITH s AS (SELECT 'key' AS part, strlen(url) AS size FROM pages UNION ALL SELECT 'data', strlen(html) FROM pages)
SELECT part, CASE WHEN size <= 1 THEN 0 ELSE length(bin(size - 1)) END AS bucket, count(*) AS n FROM s GROUP BY ALL""")
def size_histograms(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.size_report(table(spark, sf, "pages"), "url", "html").select("part", F.col("bucket").cast("long").alias("bucket"), "n")


@query("""WITH h AS (SELECT event_type, CASE WHEN v <= 1 THEN 0 ELSE length(bin(v - 1)) END AS bucket, count(*) AS n FROM (SELECT event_type, CAST(floor(value) AS BIGINT) AS v FROM events) GROUP BY ALL)
SELECT event_type, list_aggregate(list_transform(range(0, 64), lambda b: coalesce(list_extract(map_extract(m, b), 1), 0)), 'string_agg', ',') AS counts FROM (SELECT event_type, map(list(CAST(bucket AS BIGINT)), list(n)) AS m FROM h GROUP BY event_type)""")
def dense_histogram(spark: SparkSession, sf: str) -> DataFrame:
    h = statistics.histogram(table(spark, sf, "events").select("event_type", F.floor("value").alias("v")), F.col("v"), ["event_type"])
    return statistics.dense(h, ["event_type"]).select("event_type", F.array_join("counts", ",").alias("counts"))


@query("SELECT container, count(*) AS num_objs, CAST(coalesce(sum(strlen(data)), 0) AS BIGINT) AS used_bytes FROM (SELECT source AS container, text AS data FROM documents) GROUP BY ROLLUP (container)")
def container_stats(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.container_stats(table(spark, sf, "documents").select(F.col("source").alias("container"), F.col("text").alias("data")))


@query("SELECT event_type AS op, count(*) AS n FROM events GROUP BY 1")
def access_counts(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.access_counts(table(spark, sf, "events").select(F.col("event_type").alias("op")), "op")


# heavy hitters


@query(f"SELECT key, count(*) AS n FROM ({ACCESS}) GROUP BY key ORDER BY n DESC, key LIMIT 16")
def hot_keys(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_hitters.top(heavy_hitters.counts(access_log(spark, sf)), 16)


@query(f"SELECT client, count(*) AS n FROM ({ACCESS}) GROUP BY client ORDER BY n DESC, client LIMIT 16")
def hot_clients(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_hitters.top(heavy_hitters.counts(access_log(spark, sf), "client"), 16, "client")


@query(f"SELECT * FROM (SELECT op, key, count(*) AS n, CAST(row_number() OVER (PARTITION BY op ORDER BY count(*) DESC, key) AS INTEGER) AS rank FROM ({ACCESS}) GROUP BY op, key) WHERE rank <= 8")
def hot_keys_by_op(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_hitters.top_in_each(heavy_hitters.counts(access_log(spark, sf), by_op="op"), 8, "op")


@query(f"SELECT * FROM (SELECT client, key, count(*) AS n, CAST(row_number() OVER (PARTITION BY client ORDER BY count(*) DESC, key) AS INTEGER) AS rank FROM ({ACCESS}) GROUP BY client, key) WHERE rank <= 4")
def hot_keys_by_client(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_hitters.top_in_each(heavy_hitters.counts(access_log(spark, sf), by_client="client"), 4, "client")


@query(f"SELECT client, op, key, count(*) AS n FROM ({ACCESS}) GROUP BY ALL")
def hot_keys_by_client_op(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_hitters.counts(access_log(spark, sf), by_client="client", by_op="op")


@query(f"SELECT key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT ts // 3600 * 3600 AS start, op, key, count(*) AS n FROM ({ACCESS}) GROUP BY ALL) WHERE start >= {NOW - 7 * 86400} AND start <= {NOW} AND op = 'UPDATE' GROUP BY key ORDER BY n DESC, key LIMIT 10")
def hot_history(spark: SparkSession, sf: str) -> DataFrame:
    hours = heavy_hitters.intervals(access_log(spark, sf), F.col("ts"), 3600, op="op")
    return heavy_hitters.history(hours, NOW, 7 * 86400, 10, where=F.col("op") == "UPDATE")


@query("SELECT CASE WHEN event_id % 14 IN (1, 2) THEN 'GET' WHEN event_id % 14 BETWEEN 3 AND 11 THEN 'UPDATE' END AS class, count(*) AS n FROM events GROUP BY 1")
def command_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as commands of numbers 0 to 13, by the class they count for; null for the other commands."""
    e = table(spark, sf, "events")
    return e.select(heavy_hitters.classify(F.col("event_id") % 14).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query()
def hot_keys_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_hitters.approximate(access_log(spark, sf), 16)


# backup


@query(f"SELECT *, CASE WHEN tombstone THEN 'D' ELSE 'U' END AS op FROM ({LIVE.format(log=VL, where=f'seqno > {S2} AND seqno <= {S8}')})")
def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    return backup.change_feed(version_log(spark, sf), *snaps(spark, sf)[::2])


@query(live_sql(f"seqno <= {S8}"))
def restore_full_inc(spark: SparkSession, sf: str) -> DataFrame:
    log = version_log(spark, sf)
    first, second, third = snaps(spark, sf)
    return backup.restore([backup.change_feed(log, None, first), backup.change_feed(log, first, second), backup.change_feed(log, second, third)])


SIZE = "CAST(floor(data * 20) AS BIGINT)"
BLOCKS = f"CASE WHEN {SIZE} <= 512 THEN 1 WHEN {SIZE} <= 1024 THEN 2 WHEN {SIZE} <= 2048 THEN 3 WHEN {SIZE} <= 4096 THEN 4 WHEN {SIZE} <= 8192 THEN 5 ELSE CAST(ceil({SIZE} / 512.0) AS BIGINT) END"
AGES = f"SELECT CAST(floor(({NOW} + 40000000 - create_time) / 3600.0) AS BIGINT) AS hours, count(*) AS n, CAST(sum({SIZE}) AS BIGINT) AS bytes, CAST(sum({BLOCKS}) AS BIGINT) AS blocks FROM ({XL}) WHERE NOT (expiry_time <> 0 AND expiry_time <= {NOW}) GROUP BY 1"


def _ages(spark: SparkSession, sf: str) -> DataFrame:
    log = expiring_log(spark, sf).where(f"NOT (expiry_time <> 0 AND expiry_time <= {NOW})")
    return backup.age_histogram(log, NOW + 40_000_000, F.floor(F.col("data") * 20), expiry=None)


@query(AGES)
def age_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _ages(spark, sf)


def _report_sql(order: str) -> str:
    w = f"(ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    return f"SELECT CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place, hours, n, bytes, blocks, CAST(sum(n) OVER {w} AS BIGINT) AS cum_n, CAST(sum(bytes) OVER {w} AS BIGINT) AS cum_bytes, CAST(sum(blocks) OVER {w} AS BIGINT) AS cum_blocks, round(100.0 * n / sum(n) OVER (), 4) AS pct, round(100.0 * sum(n) OVER {w} / sum(n) OVER (), 4) AS cum_pct FROM ({AGES})"


@query(_report_sql("hours"))
def age_report(spark: SparkSession, sf: str) -> DataFrame:
    return backup.running_report(_ages(spark, sf))


@query(_report_sql("n DESC, hours"))
def age_report_by_count(spark: SparkSession, sf: str) -> DataFrame:
    return backup.running_report(_ages(spark, sf), by_count=True)


@query(f"SELECT count(*) FILTER (NOT tombstone AND NOT (expiry_time <> 0 AND expiry_time <= {NOW})) AS n_live, count(*) FILTER (tombstone) AS n_deleted, count(*) FILTER (NOT tombstone AND expiry_time <> 0 AND expiry_time <= {NOW}) AS n_expired FROM ({XL})")
def backup_summary(spark: SparkSession, sf: str) -> DataFrame:
    return backup.stream_summary(expiring_log(spark, sf), NOW)


@query("SELECT c_custkey, c_mktsegment, CASE WHEN starts_with(c_mktsegment, 'A') THEN 1 ELSE 2 END AS output FROM customer")
def backup_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    one, two = backup.split_by(rows, F.col("c_mktsegment").startswith("A"))
    return one.withColumn("output", F.lit(1)).unionByName(two.withColumn("output", F.lit(2)))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 1e9 THEN printf('%.2fbi', o_totalprice / 1e9) WHEN o_totalprice > 1e6 THEN printf('%.2fmi', o_totalprice / 1e6) WHEN o_totalprice > 1e3 THEN printf('%.2fki', o_totalprice / 1e3) ELSE printf('%.2f', o_totalprice) END AS count, CASE WHEN o_orderkey * 4096 > 1073741824 THEN printf('%.2fb', o_orderkey * 4096 / 1073741824.0) WHEN o_orderkey * 4096 > 1024 * 1024 THEN printf('%.2fm', o_orderkey * 4096 / 1048576.0) WHEN o_orderkey * 4096 > 1024 THEN printf('%.2fk', o_orderkey * 4096 / 1024.0) ELSE printf('%.2f', o_orderkey * 4096.0) END AS bytes FROM orders")
def size_formats(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", format_count(F.col("o_totalprice")).alias("count"), format_bytes(F.col("o_orderkey") * 4096).alias("bytes"))


# maps, caches, retention


THIRD = at_sql("events", "user_id", 33)


@query(f"SELECT * FROM (SELECT user_id AS key, max(event_id) AS last_use FROM events GROUP BY 1) QUALIFY row_number() OVER (ORDER BY last_use DESC, key) <= {THIRD}")
def lru_resident(spark: SparkSession, sf: str) -> DataFrame:
    return caches.lru_resident(table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord")), at(spark, sf, "events", "user_id", 33))


@query(f"SELECT * FROM (SELECT user_id AS key, max(event_id) AS last_use FROM events GROUP BY 1) QUALIFY row_number() OVER (ORDER BY last_use DESC, key) > {THIRD}")
def lru_evicted(spark: SparkSession, sf: str) -> DataFrame:
    return caches.lru_evicted(table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord")), at(spark, sf, "events", "user_id", 33))


@query("SELECT doc_id, used FROM (SELECT doc_id, CAST(sum(strlen(coalesce(text, ''))) OVER (ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents) WHERE used <= 500000")
def fifo_retention(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    return caches.fifo_retained(docs, F.col("size"), 500_000, "doc_id").select("doc_id", "used")


MAP_OLD, MAP_NEW = "SELECT c_custkey AS key, c_acctbal AS data FROM customer WHERE c_custkey % 2 = 0", "SELECT c_custkey AS key, c_acctbal + 1 AS data FROM customer WHERE c_custkey % 3 = 0"


def _maps(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("data"))
    return c.where("key % 2 = 0"), c.where("key % 3 = 0").withColumn("data", F.col("data") + 1)


@query(f"SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.key IS NOT NULL THEN n.data ELSE o.data END AS data, CASE WHEN n.key IS NOT NULL THEN o.data END AS old_data FROM ({MAP_OLD}) o FULL JOIN ({MAP_NEW}) n ON o.key = n.key")
def map_set(spark: SparkSession, sf: str) -> DataFrame:
    return caches.map_set(*_maps(spark, sf))


@query(f"SELECT * FROM ({MAP_NEW}) WHERE key NOT IN (SELECT key FROM ({MAP_OLD}))")
def map_create(spark: SparkSession, sf: str) -> DataFrame:
    return caches.map_create(*_maps(spark, sf))


@query(f"SELECT * FROM ({MAP_NEW}) WHERE key IN (SELECT key FROM ({MAP_OLD}))")
def map_update(spark: SparkSession, sf: str) -> DataFrame:
    return caches.map_update(*_maps(spark, sf))


@query(f"SELECT * FROM ({MAP_OLD}) WHERE key NOT IN (SELECT key FROM ({MAP_NEW}))")
def map_delete(spark: SparkSession, sf: str) -> DataFrame:
    return caches.map_delete(*_maps(spark, sf))


# transactions

TOUCHES = "SELECT o_custkey AS node, o_orderkey // 60 + o_orderkey % 2 AS trx, min(o_orderkey) AS lo, max(o_orderkey) AS hi, bool_or(o_orderstatus = 'O') AS write FROM orders GROUP BY 1, 2"


def _touches(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("node"), (F.floor(F.col("o_orderkey") / 60) + F.col("o_orderkey") % 2).alias("trx")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.bool_or(F.col("o_orderstatus") == "O").alias("write"))


@query(f"WITH t AS ({TOUCHES}) SELECT DISTINCT CASE WHEN b.hi < a.lo THEN b.trx ELSE a.trx END AS first, CASE WHEN b.hi < a.lo THEN a.trx ELSE b.trx END AS second, CASE WHEN b.hi < a.lo OR b.lo > a.hi THEN 'before' ELSE 'overlap' END AS relation FROM t a JOIN t b ON a.node = b.node AND a.trx < b.trx AND (a.write OR b.write)")
def trx_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return transactions.conflicts(_touches(spark, sf))


BAD = f"SELECT DISTINCT a.trx FROM ({TOUCHES}) a JOIN ({TOUCHES}) b ON a.node = b.node AND a.trx <> b.trx AND (a.write OR b.write) AND a.lo <= b.hi AND b.lo <= a.hi"


@query(BAD)
def trx_uncommittable(spark: SparkSession, sf: str) -> DataFrame:
    return transactions.uncommittable(_touches(spark, sf))


@query(f"""WITH g AS (SELECT * FROM ({TOUCHES}) WHERE trx NOT IN ({BAD}))
SELECT DISTINCT a.trx AS first, b.trx AS second, 'before' AS relation FROM g a JOIN g b ON a.node = b.node AND a.hi < b.lo AND (a.write OR b.write)
WHERE NOT EXISTS (SELECT 1 FROM g c WHERE c.node = a.node AND c.write AND c.lo > a.hi AND c.hi < b.lo)""")
def trx_order_edges(spark: SparkSession, sf: str) -> DataFrame:
    touches = _touches(spark, sf)
    return transactions.order_edges(touches, transactions.uncommittable(touches))


ORDER_TOUCHES = "SELECT o_custkey AS node, o_orderkey AS trx, o_orderkey AS lo, o_orderkey AS hi, o_orderstatus = 'O' AS write FROM orders"


@query(f"""WITH RECURSIVE t AS ({ORDER_TOUCHES}), e AS (SELECT a.trx AS first, b.trx AS second FROM t a JOIN t b ON a.node = b.node AND a.trx < b.trx AND (a.write OR b.write)),
l AS (SELECT trx, 0 AS level FROM t UNION SELECT e.second, l.level + 1 FROM l JOIN e ON e.first = l.trx)
SELECT trx, CAST(max(level) AS INTEGER) AS level FROM l GROUP BY trx""")
def trx_commit_order(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as transactions of one touch each, on their customers."""
    o = table(spark, sf, "orders")
    touches = o.select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("trx"), F.col("o_orderkey").alias("lo"), F.col("o_orderkey").alias("hi"), (F.col("o_orderstatus") == "O").alias("write"))
    bad = transactions.uncommittable(touches)
    return transactions.commit_order(touches, transactions.order_edges(touches, bad), bad)


@query(f"SELECT key, lsn, data FROM (SELECT user_id AS key, event_id AS lsn, value AS data, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id // 50 END AS trx FROM events) WHERE trx IS NULL OR trx % 4 <> 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1")
def redo_replay(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    redo = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("lsn"), F.col("value").alias("data"), F.when(F.col("event_id") % 3 != 0, F.floor(F.col("event_id") / 50)).alias("trx"))
    return transactions.replay(redo, redo.select("trx").distinct().where("trx % 4 <> 1")).drop("trx")


@query(f"SELECT * FROM ({VL}) WHERE NOT (tombstone AND seqno <= {S5})")
def tombstone_retention(spark: SparkSession, sf: str) -> DataFrame:
    return transactions.retained_tombstones(version_log(spark, sf), snaps(spark, sf)[1])


# integrity


@query("""SELECT 'node' AS entity, CAST(l_orderkey AS VARCHAR) AS id, 'KEY_ORDER' AS error, count(*) AS n FROM (SELECT l_orderkey, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey DESC, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS before FROM lineitem) WHERE before >= l_partkey GROUP BY ALL""")
def check_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("place", F.struct("l_linenumber", (-F.col("l_partkey")).alias("p"), "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    return integrity.check_order(rows, "l_orderkey", "place", "l_partkey").groupBy("entity", "id", "error").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'node' AS entity, CAST(l_orderkey AS VARCHAR) AS id, 'KEY_BOUNDS' AS error, 'key ' || l_partkey AS msg FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey < o_custkey % 50 OR l_partkey >= o_custkey % 50 + 100")
def check_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a line item outside bounds that follow from its order's customer."""
    low = F.col("o_custkey") % 50
    bounds = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), low.alias("low"), (low + 100).alias("high"))
    return integrity.check_bounds(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), bounds, "l_orderkey", "l_partkey")


@query("SELECT 'version' AS entity, CAST(l_orderkey AS VARCHAR) AS id, 'DUPLICATE_SEQNO' AS error, 'seqno ' || l_linenumber || ' occurs ' || count(*) || ' times' AS msg FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def check_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.check_duplicates(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT 'reference' AS entity, CAST(l_orderkey AS VARCHAR) AS id, 'UNREACHABLE' AS error, 'no such row' AS msg FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 0)")
def check_references(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.check_references(table(spark, sf, "lineitem"), table(spark, sf, "orders").where("o_orderkey % 11 <> 0"), "l_orderkey", "o_orderkey")


@query("""WITH f AS (SELECT o_orderkey AS k, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS found, 4 AS wanted FROM orders)
SELECT 'container' AS entity, CAST(k AS VARCHAR) AS id, 'OBJECT_COUNT' AS error, 'found ' || found || ' wanted ' || wanted AS msg FROM f WHERE found <> wanted""")
def check_counts(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    return integrity.check_count(lines, table(spark, sf, "orders").select("o_orderkey", F.lit(4).cast("long").alias("n")), "o_orderkey")


@query("SELECT 'object' AS entity, CAST(page_id AS VARCHAR) AS id, 'CHECKSUM' AS error, 'data changed' AS msg FROM pages WHERE page_id % 50 = 7 AND html IS NOT NULL")
def check_crc(spark: SparkSession, sf: str) -> DataFrame:
    rows = integrity.with_crc(table(spark, sf, "pages").select("page_id", F.col("html").alias("data")))
    damaged = rows.withColumn("data", F.when(F.col("page_id") % 50 == 7, F.concat("data", F.lit("!"))).otherwise(F.col("data")))
    return integrity.check_crc(damaged, "page_id")


@query("SELECT count(DISTINCT o_custkey) AS keys, count(*) AS n, CAST(0 AS BIGINT) AS split_keys, CAST(0 AS BIGINT) AS outside, true AS even FROM orders")
def shard_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Placement by hash: no key in two shards, none outside, and no shard with over twice its share of keys."""
    placed = table(spark, sf, "orders").groupBy("o_custkey", shard_of(F.col("o_custkey"), 16).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    keys = placed.groupBy("o_custkey").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("shards"), F.max("shard").alias("shard"))
    shards = keys.groupBy("shard").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n"), F.count(F.when(F.col("shards") > 1, 1)).alias("split"), F.count(F.when(~F.col("shard").between(0, 15), 1)).alias("outside"))
    return shards.agg(F.sum("keys").alias("keys"), F.sum("n").alias("n"), F.sum("split").alias("split_keys"), F.sum("outside").alias("outside"), (F.max("keys") * 16 <= 2.5 * F.sum("keys")).alias("even"))


@query("SELECT doc_id, CAST(CASE WHEN strlen(text) <= 512 THEN 1 WHEN strlen(text) <= 1024 THEN 2 WHEN strlen(text) <= 2048 THEN 3 WHEN strlen(text) <= 4096 THEN 4 WHEN strlen(text) <= 8192 THEN 5 ELSE ceil(strlen(text) / 512.0) END AS BIGINT) AS blocks, CAST(CASE WHEN strlen(text) <= 1 THEN 0 ELSE length(bin(strlen(text) - 1)) END AS INTEGER) AS bucket FROM documents WHERE text IS NOT NULL")
def object_blocks(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length("text")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", blocks_512(size).alias("blocks"), log2_bucket(size).alias("bucket"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders")
def global_row_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return row_numbers(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


# stored containers; each query makes a store of its own in the shared folder


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}")


def _stored(store: Store, log: DataFrame, name: str = "c"):
    """A container that holds a log."""
    c = store.open(name, create=True, schema=log.schema)
    store.append(c, log)
    return c


@query(live_sql(f"seqno <= {S5}"))
def snapshot_survives_reload(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot, later writes, then a scavenge by a store that was loaded from its folder."""
    log, at_ = version_log(spark, sf), snaps(spark, sf)[1]
    store = _store(spark)
    c = _stored(store, log.where(F.col("seqno") <= at_))
    number = store.create_snapshot(c, 1)
    store.append(c, log.where(F.col("seqno") > at_))
    again = Store.load(spark, store.root)
    return again.view(again.scavenge(again.props(c.cguid)), up_to=number)


@query(f"SELECT 0 AS up_to, count(*) AS n FROM ({live_sql('seqno <= 0')}) UNION ALL SELECT 1, count(*) FROM ({live_sql('seqno <= 1')}) UNION ALL SELECT NULL, count(*) FROM ({live_sql()})")
def range_up_to_zero(spark: SparkSession, sf: str) -> DataFrame:
    """How many objects a stored container has up to number 0, up to 1, and in all."""
    store = _store(spark)
    c = _stored(store, version_log(spark, sf))
    parts = [store.scan(c, ranges.Range(up_to=n)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).cast("int").alias("up_to"), "n") for n in (0, 1, None)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT key, data FROM ({live_sql()}) WHERE key % 3 <> 0")
def store_delete(spark: SparkSession, sf: str) -> DataFrame:
    store, log = _store(spark), version_log(spark, sf)
    c = _stored(store, log)
    store.remove(c, log.where("key % 3 = 0").select("key"))
    return store.view(c).select("key", "data")


@query(f"SELECT key, data FROM ({XLIVE}) WHERE NOT (expiry_time > 0 AND expiry_time <= {NOW})")
def store_read_at(spark: SparkSession, sf: str) -> DataFrame:
    """Written with expiry times, read at a time."""
    store, log = _store(spark), expiring_log(spark, sf)
    c = store.open("c", create=True, schema=log.schema)
    store.put(c, versions.live(log).select("key", "data", "create_time", "expiry_time", F.col("seqno").alias("ord")))
    return store.view(c, now=NOW).select("key", "data")


@query(f"SELECT key, data FROM ({XLIVE}) WHERE NOT (expiry_time > 0 AND expiry_time < {NOW})")
def store_sweep(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark)
    c = _stored(store, expiring_log(spark, sf))
    store.sweep(c, NOW)
    return store.view(c).select("key", "data")


@query(f"SELECT key, CASE WHEN key < {at_sql('events', 'user_id', 50)} AND data < 40 THEN data * 2 ELSE data END AS data FROM ({live_sql()}) ORDER BY key")
def store_range_update(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark)
    c = _stored(store, version_log(spark, sf))
    store.update_range(c, F.col("key") < at(spark, sf, "events", "user_id", 50), F.col("data") * 2, F.col("data") < 40)
    return store.enumerate(c).select("key", "data")


@query(f"SELECT key, CAST(counter AS BIGINT) AS counter, pg, other, data FROM ({VISIBLE})")
def store_log_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of all kinds appended as one batch to a log container, then reclaimed and enumerated."""
    store = _store(spark)
    c = store.open("c", create=True, kind="LOG")
    store.append_records(c, log_records(spark, sf), None)
    return store.enumerate(store.reclaim(c)).select("key", "counter", "pg", "other", "data")


@query(f"WITH b AS ({BATCH}) SELECT key, data FROM (SELECT key, data, 0 AS s, 0 AS ord FROM ({live_sql()}) UNION ALL SELECT key, data, 1, ord FROM b) QUALIFY row_number() OVER (PARTITION BY key ORDER BY s DESC, ord DESC) = 1")
def store_transaction(spark: SparkSession, sf: str) -> DataFrame:
    """Two brackets, one within the other, and a third that is rolled back."""
    store, batch = _store(spark), _batch(spark, sf)
    c = _stored(store, version_log(spark, sf))
    t, half = store.transaction(), at(spark, sf, "customer", "c_custkey", 50)
    t.start()
    t.put(c, batch.where(F.col("ord") <= half))
    t.start()
    t.put(c, batch.where(F.col("ord") > half))
    t.commit()
    t.commit()
    t.start()
    t.put(c, batch.withColumn("data", F.lit(-1.0)))
    t.rollback()
    return store.view(c).select("key", "data")


@query(f"SELECT key, CAST((rn - 1) // 4 AS INTEGER) AS page, CASE WHEN max(rn) OVER () = 10 AND page < 3 THEN 'SUCCESS' END AS status FROM (SELECT key, row_number() OVER (ORDER BY key) AS rn FROM ({live_sql()}) ORDER BY key LIMIT 10) UNION ALL SELECT NULL, 3, 'QUERY_DONE' UNION ALL SELECT NULL, 4, 'STATE_CHANGED'")
def cursor_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The pages of the ten smallest keys by a cursor, its end, and what it says after a compaction."""
    store = _store(spark)
    c = _stored(store, version_log(spark, sf))
    tenth = [r["key"] for r in ranges.page(store.view(c), ranges.Range(), 10).collect()][-1:]
    cursor, rows = store.cursor(c, ranges.Range(end=tenth[0], end_flag="le") if tenth else None), []
    pages = 0
    while True:
        page, status = cursor.next(4)
        rows += [(r["key"], pages, status) for r in page]
        if not page:
            break
        pages += 1
    rows.append((None, pages, status))
    store.scavenge(c)
    rows.append((None, pages + 1, cursor.next(4)[1]))
    return spark.createDataFrame(rows, "key long, page int, status string")


# streams, run to the end of their input


@query(live_sql())
def latest_stream(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming import streams

    events = table(spark, sf, "events")
    source = _versions_of(streams.file_stream(spark, f"{sf}/events*.parquet", events.schema))
    newest = streams.to_table(streams.latest_stream(source), f"{shared_dir(spark)}/streams", ["key"])
    return newest.where("NOT tombstone").select("key", "seqno", "tombstone", "data", "create_time")


@query(f"SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, event_type AS key, count(*) AS n FROM events GROUP BY ALL")
def hot_keys_stream(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming import streams

    events = table(spark, sf, "events")
    source = streams.file_stream(spark, f"{sf}/events*.parquet", events.schema).select(F.timestamp_seconds(epoch_seconds("ts")).alias("ts"), F.col("event_type").alias("key"))
    hot = streams.to_table(streams.hot_keys_stream(source, "ts", "key"), f"{shared_dir(spark)}/streams", ["start", "key"])
    return hot.select(F.unix_timestamp("start").alias("start"), "key", "n")


def _versions_of(e: DataFrame) -> DataFrame:
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seqno"), (F.col("event_type") == "error").alias("tombstone"), F.col("value").alias("data"), epoch_seconds("ts").alias("create_time"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Objects of a snapshot in a range of keys, in order."""
    return snapshot_range(spark, sf)
