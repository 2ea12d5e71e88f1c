"""Queries take every row of their tables, also beyond the sizes of the SQL beside them."""

import random
from itertools import combinations

from keystrata.plans import queries


def brute_transactions(orders):
    """Conflicts, uncommittable transactions and the order of the others, from all pairs."""
    touches = {}
    for key, customer, status in orders:
        lo, hi, write = touches.get((customer, key // 60 + key % 2), (key, key, False))
        touches[customer, key // 60 + key % 2] = min(lo, key), max(hi, key), write or status == "O"
    nodes = {}
    for (node, trx), touch in touches.items():
        nodes.setdefault(node, []).append((trx, *touch))
    found = set()
    for rows in nodes.values():
        for (a, alo, ahi, aw), (b, blo, bhi, bw) in combinations(sorted(rows), 2):
            if aw or bw:
                found.add((b, a, "before") if bhi < alo else (a, b, "before" if blo > ahi else "overlap"))
    bad = {t for x in found if x[2] == "overlap" for t in x[:2]}
    edges = set()
    for rows in nodes.values():
        good = [t for t in rows if t[0] not in bad]
        for a in good:
            for b in good:
                if a[2] < b[1] and (a[3] or b[3]) and not any(c[3] and c[1] > a[2] and c[2] < b[1] for c in good):
                    edges.add((a[0], b[0], "before"))
    return found, bad, edges


def test_transactions_of_all_orders(spark, tmp_path):
    r = random.Random(8)
    rows = [(k, r.randrange(40), 1.0, r.choice("OFP")) for k in sorted(r.sample(range(9000), 900))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    wanted = brute_transactions([(k, c, s) for k, c, _, s in rows])
    got = [{tuple(x) for x in queries.QUERIES[q](spark, str(tmp_path)).collect()} for q in ("trx_conflicts", "trx_uncommittable", "trx_order_edges")]
    assert got[0] == wanted[0] and got[1] == {(t,) for t in wanted[1]} and got[2] == wanted[2]
    assert any(min(x[:2]) > 3000 // 60 + 1 for x in wanted[0])


def test_sizes_of_orders_of_any_key(spark, tmp_path):
    rows = [(199_999, 1.5, "O", 1), (200_000, 1500.0, "O", 1), (300_000, 2.5e6, "F", 1), (5_000_000_000, 3e9, "P", 1)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderstatus string, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {tuple(r) for r in queries.QUERIES["size_formats"](spark, str(tmp_path)).collect()}
    assert got == {(199_999, "1.50", "781.25m"), (200_000, "1.50ki", "781.25m"), (300_000, "2.50mi", "1.14b"), (5_000_000_000, "3.00bi", "19073.49b")}


def test_updates_stop_at_the_first_missing_key_of_the_whole_batch(spark, tmp_path):
    # keys fall from the largest one, customer by customer; at the snapshot half of them are there
    spark.range(21).selectExpr("id AS event_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts", "89 - id AS user_id", "'view' AS event_type", "1.0D AS value").write.parquet(str(tmp_path / "events.parquet"))
    spark.range(90).selectExpr("id AS c_custkey", "CAST(id AS DOUBLE) AS c_acctbal").write.parquet(str(tmp_path / "customer.parquet"))
    got = {(r["key"], r["data"], r["ord"]) for r in queries.QUERIES["mput_update"](spark, str(tmp_path)).collect()}
    assert got == {(89 - k, float(k), k) for k in range(11)}
    got = {r["key"] for r in queries.QUERIES["mput_insert"](spark, str(tmp_path)).collect()}
    assert got == {90 + k for k in range(45)}
