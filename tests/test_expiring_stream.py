"""Timers remove expired keys; newer versions put them off; late older versions change nothing."""

from keystrata.streaming import streams
from keystrata.streaming.expiring import expire

SCHEMA = "key string, data string, seqno long, tombstone boolean, expiry_time long, create_time long"


def test_expiry_follows_the_watermark(spark, tmp_path):
    batches = [
        [("a", "1", 1, False, 150, 100), ("b", "1", 2, False, 0, 100), ("c", "1", 3, False, 500, 100)],
        [("a", "2", 4, False, 300, 140), ("d", "1", 5, False, 0, 160)],
        [("c", None, 6, True, 0, 200), ("a", "old", 0, False, 0, 200)],
        [("e", "1", 7, False, 0, 400)],
        [("f", "1", 8, False, 0, 600)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "all" / f"{i}"))
    # one file a trigger, in order of time
    import glob
    import os
    import shutil

    (tmp_path / "in").mkdir()
    for i in range(len(batches)):
        part = glob.glob(str(tmp_path / "all" / f"{i}" / "part-*.parquet"))[0]
        shutil.copy(part, tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    schema = spark.createDataFrame([], SCHEMA).schema
    source = streams.file_stream(spark, str(tmp_path / "in"), schema, 1)
    out = streams.to_table(expire(source), str(tmp_path / "out"), mode="append")
    got = [tuple(r) for r in out.collect()]
    assert ("a", 4, "2", "EXPIRED") in got and ("a", 1, "1", "EXPIRED") not in got
    assert ("c", 6, None, "DELETED") in got and not [r for r in got if r[0] == "c" and r[3] == "EXPIRED"]
    assert not [r for r in got if r[0] in "bdef" and r[3] != "SUCCESS"]
    assert [r for r in got if r[0] == "a" and r[3] == "SUCCESS"][-1] == ("a", 4, "2", "SUCCESS")
