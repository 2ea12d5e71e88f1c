"""Expiry on a stream: each key's newest version as state, which an event-time timer removes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, seqno long, data string, status string"
STATE = "seqno long, data string, expiry long"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        seqno, data, _ = state.get
        state.remove()
        yield pd.DataFrame({"key": [key[0]], "seqno": [seqno], "data": [data], "status": ["EXPIRED"]})
        return
    newest = state.get if state.exists else None
    for pdf in batches:
        row = pdf.loc[pdf["seqno"].idxmax()]
        if newest is None or row["seqno"] > newest[0]:
            gone = bool(row["tombstone"])
            newest = (int(row["seqno"]), None if gone else row["data"], -1 if gone else int(row["expiry_time"]))
    seqno, data, expiry = newest
    if expiry >= 0:
        status = "SUCCESS"
        if 0 < expiry * 1000 <= state.getCurrentWatermarkMs():
            status = "EXPIRED"
    else:
        status = "DELETED"
    if status == "EXPIRED":
        if state.exists:
            state.remove()
    else:
        state.update((seqno, data, expiry))
        if expiry > 0:
            state.setTimeoutTimestamp(expiry * 1000)
    yield pd.DataFrame({"key": [key[0]], "seqno": [seqno], "data": [data], "status": [status]})


def expire(stream: DataFrame, ts: str = "create_time", late: str = "0 seconds") -> DataFrame:
    """(key, seqno, data, status): SUCCESS or DELETED for the newest version of each key and micro-batch,
    and EXPIRED once the watermark reaches its expiry, when its state goes too.

    stream: key, data, seqno, tombstone, expiry_time (epoch seconds, 0 for never) and ts in epoch
    seconds. Keys without an expiry keep their state, a deleted one its number, so that late older
    versions do not come back; only expiring keys have bounded state.
    """
    timed = stream.select(F.col("key").cast("string").alias("key"), F.col("data").cast("string").alias("data"), "seqno", "tombstone", "expiry_time", F.timestamp_seconds(ts).alias("at"))
    return timed.withWatermark("at", late).groupBy("key").applyInPandasWithState(_step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
