"""Top-k, fixity audits and language ID."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import language_id, queries, topk, warc


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_the_sql(spark, sf, duck, same, name):
    same(queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLES[name]).df())


def brute_top(rows, k, scale=1024):
    good = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, qv in good:
        if q % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in good if i != q and len(v) == len(qv))
            out.setdefault(q, set()).add(tuple((r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])))
    return out


@pytest.mark.parametrize("shard_rows", [50, 10_000])
def test_top_k_is_brute_force(spark, shard_rows):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(400 + i, [0.5] * 8) for i in range(40)]  # ties
    rows += [(500, None), (510, [1.0, None] * 4), (520, [float("nan")] * 8), (530, [float("inf")] * 8), (540, []), (550, [0.25] * 3), (551, [0.75] * 3), (None, [0.1] * 8), (560, [-1e6] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for x in topk.top_k(df, F.col("vec_id") % 10 == 0, k=5, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert {q: {tuple(v)} for q, v in got.items()} == {q: v for q, v in brute_top(rows, 5).items() if v != {()}}
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_query_rows_of_one_id_are_ranked_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), *[(i, [i / 10, 1 - i / 10]) for i in range(1, 8)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"q": F.lit("x"), "region": F.lit(1)})
    out = topk.top_k(df, F.col("vec_id") == 0, k=3, shard_rows=4).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in out) == [(1, 1), (1, 7), (2, 2), (2, 6), (3, 3), (3, 5)]
    assert {r["query_id"] for r in out} == {0}


def test_regions_are_left_out_by_their_boxes(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(8, 3)) * 20
    vectors = np.concatenate([c + r.normal(size=(200, 3)) for c in centres])
    ints = np.floor(vectors * 1024).astype(np.int64)
    splits = topk.Splits(ints[::4], 4)
    region = splits.region(ints)
    own = [ints[region == k] for k in range(16)]
    assert sum(map(len, own)) == len(ints) and max(map(len, own)) < 400
    some = [k for k in range(16) if len(own[k])]
    boxes = topk.Boxes(some, np.array([own[k].min(0) for k in some]), np.array([own[k].max(0) for k in some]), [1] * len(some))
    left_out = 0
    for q in ints[::50]:
        kth = np.sort(ints @ q)[-10]
        bound = boxes.bounds(q)
        assert all(bound[i] >= (own[k] @ q).max() for i, k in enumerate(some))
        left_out += int((bound < kth).sum())
    assert left_out > 0.5 * len(some) * len(ints[::50])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in topk.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=100).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    for q, found in got.items():
        scores = ints @ ints[q]
        wanted = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:10]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(wanted)]
    assert len(got) == 32


def test_tree_prunes_and_stays_exact():
    r = np.random.default_rng(7)
    vectors = r.integers(-1000, 1000, (4000, 4))
    tree = topk.KDTree(np.arange(4000), vectors, 32)
    for q in r.integers(-1000, 1000, (20, 4)):
        scores = vectors @ q
        wanted = sorted(zip((-scores).tolist(), range(4000), strict=True))[:10]
        assert tree.search(-1, q, 10, None) == [(-s, i) for s, i in wanted]
        assert tree.search(-1, q, 10, -wanted[4][0]) == [(-s, i) for s, i in wanted if s <= wanted[4][0]]


def pages(spark, n=2500):
    return spark.createDataFrame([(i, f"http://h/{i}", f"<p>é{i}</p>" * (i % 5)) for i in range(n)], "page_id long, url string, html string")


def test_audit_finds_what_differs(spark):
    one = pages(spark)
    damaged = one.withColumn("html", F.when(F.col("page_id").isin(3, 1027, 2400), F.concat(F.col("html"), F.lit("!"))).otherwise(F.col("html")))
    same_size = one.withColumn("html", F.when(F.col("page_id").isin(4, 1501), F.translate("html", "p", "q")).otherwise(F.col("html")))
    found, _ = warc.audit(warc.layout(one), warc.layout(same_size))
    assert {tuple(r) for r in found.collect()} == {(0, 4, "corrupt"), (1, 477, "corrupt")}
    found, _ = warc.audit(warc.layout(one), warc.layout(damaged))
    got = {(r["shard"], r["seq"]): r["status"] for r in found.collect()}
    assert {k for k, v in got.items() if v == "corrupt"} == {(0, 3), (1, 3), (2, 352)}
    assert got[(0, 4)] == "moved" and (0, 2) not in got and (2, 351) not in got
    shorter = warc.layout(one.where("page_id <> 2499"))
    assert {(r["shard"], r["seq"], r["status"]) for r in warc.audit(warc.layout(one), shorter)[0].collect()} == {(2, 451, "missing")}
    assert warc.audit(warc.layout(one), warc.layout(one))[0].count() == 0
    nothing = warc.layout(one.limit(0))
    assert warc.report(nothing, nothing).count() == 0
    assert warc.audit(nothing, warc.layout(one.limit(3)))[0].where("status = 'extra'").count() == 3


def test_nulls_and_repeated_pages(spark):
    rows = [(None, "u", "x"), (None, None, None), (1, None, "a"), (1, "u", None), (1, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.report(warc.layout(df), warc.layout(df)).collect()
    assert len(out) == 5 and {r["status"] for r in out} == {"intact"}
    assert sorted(r["seq"] for r in out if r["shard"] == 0) == [0, 1, 2]


def test_warc_files_round_trip(spark, tmp_path):
    df = pages(spark, 200)
    warc.write_warc(df.repartition(3), str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    assert {(r["record_id"], r["url"], r["body"].decode()) for r in back.select("record_id", "url", "body").collect()} == {(f"<urn:page:{r['page_id']}>", r["url"], r["html"]) for r in df.collect()}
    # offsets and lengths cover each file without a gap
    for _, part in back.select("path", "offset", "length").toPandas().groupby("path"):
        part = part.sort_values("offset")
        assert (part.offset == part.length.cumsum() - part.length).all()


def test_warc_files_of_all_kinds(spark, tmp_path):
    import gzip

    def rec(kind, body, *more, version="WARC/1.0"):
        return "\r\n".join([version, f"WARC-Type: {kind}", *more, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"

    info = rec("warcinfo", b"software: x\r\n", "WARC-Record-ID: <urn:1>", "WARC-Date: 2024-01-01T00:00:00Z")
    request = rec("request", b"GET / HTTP/1.1\r\n\r\n", "warc-target-uri:http://a/", "X-Folded: one", "  two")
    empty = rec("metadata", b"")
    plain = info + request + empty
    cases = {
        "plain.warc": plain,
        "body.warc": plain + info[:-8],  # cut off in a body
        "head.warc": plain + info[:20],
        "none.warc": b"",
        "nolength.warc": info + b"WARC/1.0\r\nWARC-Type: x\r\nno colon here\r\n\r\nrest",
        "zipped.warc.gz": b"".join(gzip.compress(x) for x in (info, request, empty)),
        "cut.warc.gz": gzip.compress(info) + gzip.compress(request)[:-12],
        "junk.warc.gz": b"\x1f\x8bnothing of it",
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in warc.read_warc(spark, str(tmp_path)).orderBy("path", "offset").collect():
        got.setdefault(r["path"].rsplit("/", 1)[-1], []).append(r)
    status = {k: [r["status"] for r in v] for k, v in got.items()}
    assert status == {
        "plain.warc": ["ok"] * 3, "body.warc": ["ok"] * 3 + ["truncated"], "head.warc": ["ok"] * 3 + ["truncated"], "nolength.warc": ["ok", "malformed"],
        "zipped.warc.gz": ["ok"] * 3, "cut.warc.gz": ["ok", "truncated"], "junk.warc.gz": ["truncated"],
    }
    one, two, three = got["plain.warc"]
    assert (one["type"], one["record_id"], one["date"], one["url"]) == ("warcinfo", "<urn:1>", "2024-01-01T00:00:00Z", None)
    assert two["url"] == "http://a/" and bytes(two["body"]).startswith(b"GET") and bytes(three["body"]) == b"" and three["record_id"] is None
    for name, rows in got.items():  # rows cover the file
        assert sum(r["length"] for r in rows) == len(cases[name]), name
    assert [bytes(r["body"]) for r in got["zipped.warc.gz"]] == [bytes(r["body"]) for r in got["plain.warc"]]
    assert warc.read_warc(spark, str(tmp_path), "plain*").count() == 3


def test_a_drill_changes_every_drilled_page_and_no_length(spark):
    rows = [(0, "u", "#page"), (997, "u", "<p>"), (1994, "u", None), (2991, "u", ""), (3988, "u", "épage"), (3989, "u", "x"), (None, "u", "#"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"shard": F.lit("s"), "r": F.lit(1)})
    out = warc.report(warc.layout(df), warc.layout(warc.drilled(df))).collect()
    assert {r["page_id"]: r["status"] for r in out if r["page_id"] is not None} == {0: "corrupt", 997: "corrupt", 1994: "intact", 2991: "intact", 3988: "intact", 3989: "intact"}
    assert {r["status"] for r in out if r["page_id"] is None} == {"intact"} and len(out) == 8


def test_language_id_on_held_out_documents(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out")
    assert out.count() == docs.count() and held.where("lang_pred = lang").count() >= 0.98 * held.count()
    assert out.where("score < 0 or score > 1").count() == 0


def test_language_profiles_are_bundles_of_bound_letters():
    e = language_id.Encoder()
    v = e.vectors[e.rows(e.grams("abc")[0])]
    ids, counts, letters = e.grams("abc")
    a, b, c = (e.letters[i].astype(int) for i in (1, 2, 3))
    space = e.letters[0].astype(int)
    bound = lambda x, y, z: x * np.roll(y, 1) * np.roll(z, 2)
    wanted = {bound(space, a, b).tobytes(), bound(a, b, c).tobytes(), bound(b, c, space).tobytes()}
    assert letters and counts.tolist() == [1, 1, 1] and {r.astype(int).tobytes() for r in v} == wanted
    long = "ab cd " * 400_000  # longer than a piece
    i, n, _ = e.grams(long)
    j, m, _ = e.grams("ab cd " * 4)
    assert set(i) == set(j) and n.sum() == 6 * 400_000 - 1 and m.sum() == 6 * 4 - 1


def test_language_edge_cases(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("the dog and the cat", "en"), ("le chat est sur la table", "fr"), ("la maison et le chien", "fr"), (None, "en"), ("", None), ("123 !?", "fr"), ("the mat", None)] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    fitted = language_id.fit(language_id.training_rows(docs))
    out = language_id.predict(docs, fitted)
    assert out.columns == ["doc_id", "lang", "score", "lang_pred", "score_"]
    got = {r["doc_id"] % 8: (r["lang_pred"], r["score_"]) for r in out.collect()}
    assert [got[i][0] for i in range(8)] == ["en", "en", "fr", "fr", "und", "und", "und", "en"] and got[4][1] == 0
    assert language_id.predict(docs.limit(0), fitted).count() == 0
    nothing = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}
