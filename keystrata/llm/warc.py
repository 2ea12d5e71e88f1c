"""WARC records and Merkle fixity audits (operator 7).

A page becomes a WARC response record. Records are laid out in shards by id, in order, with offsets.
A shard's tree has the SHA-256 of each record as leaves; a node hashes the offset range it covers
and its children in order, up to one root. Two replicas' trees are tables. An audit compares roots,
joins only the children of nodes that differ, level by level, and so finds the records that differ:
`corrupt` (other bytes), `moved` (same bytes, other offset), `missing` or `extra`.

`write_warc` writes records as plain WARC files. `read_warc` parses plain and gzipped files of any record
types; a record that is cut off or not readable is a row that says so, never an error of the job.

A null url or page is an empty one. Rows of a null id go to shards of their own, by a hash of the record.
Rows with the same id stay records of their own, in order of url and bytes. Empty replicas have no
nodes; against an empty replica every record is missing or extra. Other columns, of any name, are not
read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored

SHARD_IDS, FANOUT = 1024, 32
RECORD_END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
NULL_SHARDS = 1 << 20


def record(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """The record without its final RECORD_END. The tables have no time of capture; all records have one date."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", ""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(RECORD_END), body,
    )


def layout(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", shard_ids: int = SHARD_IDS) -> DataFrame:
    """(page_id, shard, seq, offset, length, sha256): records in order of their archive; offsets in bytes."""
    id_, u = F.col(f"`{page_id}`").cast("long"), F.coalesce(F.col(f"`{url}`"), F.lit(""))
    rows = pages.select(id_.alias("page_id"), u.alias("u"), record(id_, F.col(f"`{url}`"), F.col(f"`{html}`")).alias("r"))
    shard = F.coalesce(F.floor(F.col("page_id") / shard_ids), -1 - F.pmod(F.xxhash64("r"), F.lit(NULL_SHARDS))).cast("long")
    rows = rows.withColumn("shard", shard)
    rows = rows.select("page_id", "shard", "u", (F.octet_length("r") + len(RECORD_END)).cast("long").alias("length"), F.sha2(F.concat("r", F.lit(RECORD_END)).cast("binary"), 256).alias("sha256"))
    order = Window.partitionBy("shard").orderBy("page_id", "u", "sha256")
    return rows.select("page_id", "shard", (F.row_number().over(order) - 1).cast("long").alias("seq"), (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"), "length", "sha256")


def tree(records: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves up, each (shard, node, first, last, hash); the top level has one node a shard."""
    leaves = records.select("shard", F.col("seq").alias("node"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last"), F.col("sha256").alias("hash"))
    levels = [leaves]
    most = (leaves.agg(F.max("node").alias("m")).first()["m"] or 0) + 1
    for _ in range(max(1, math.ceil(math.log(most, fanout) - 1e-9))):
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))
        up = levels[-1].groupBy("shard", F.floor(F.col("node") / fanout).alias("up")).agg(F.min("first").alias("first"), F.max("last").alias("last"), children.alias("c"))
        joined = F.concat(F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"), F.lit(":"), F.array_join(F.transform("c", lambda x: x["hash"]), ""))
        levels.append(stored(up.select("shard", F.col("up").alias("node"), "first", "last", F.sha2(joined.cast("binary"), 256).alias("hash")), "merkle"))
    return levels


def audit(one: DataFrame, other: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, list[DataFrame]]:
    """(shard, seq, status) of the records that differ between two layouts, and the first one's levels."""
    ours, theirs = tree(one, fanout), tree(other, fanout)
    top = max(len(ours), len(theirs))
    for levels in (ours, theirs):  # a shallower tree gets nodes above its roots
        while len(levels) < top:
            levels.append(levels[-1].select("shard", "node", "first", "last", F.sha2(F.concat(F.lit("up:"), "hash").cast("binary"), 256).alias("hash")))
    suspects: DataFrame | None = None
    for level in range(top - 1, -1, -1):
        a, b = (x[level].select("shard", "node", F.col("hash").alias(f"h{i}"), F.col("first").alias(f"f{i}")) for i, x in enumerate((ours, theirs)))
        if suspects is not None:
            below = suspects.select("shard", F.col("node").alias("parent"))
            a, b = (x.withColumn("parent", F.floor(F.col("node") / fanout)).join(below, ["shard", "parent"], "left_semi").drop("parent") for x in (a, b))
        both = a.join(b, ["shard", "node"], "full")
        differs = ~(F.col("h0").eqNullSafe(F.col("h1")) & F.col("f0").eqNullSafe(F.col("f1")))
        suspects = stored(both.where(differs), "suspects")
    status = F.when(F.col("h1").isNull(), "missing").when(F.col("h0").isNull(), "extra").when(F.col("h0") == F.col("h1"), "moved").otherwise("corrupt")
    return suspects.select("shard", F.col("node").alias("seq"), status.alias("status")), ours


def report(one: DataFrame, other: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Every record of the first layout, with the hash of its range, its shard's root, and its status."""
    one = stored(one, "layout")
    found, levels = audit(one, stored(other, "layout"), fanout)
    ranges = levels[1].select("shard", F.col("node").alias("part"), F.col("hash").alias("range_sha256"))
    roots = levels[-1].select("shard", F.col("hash").alias("root_sha256"))
    out = one.withColumn("part", F.floor(F.col("seq") / fanout)).join(ranges, ["shard", "part"]).drop("part").join(roots, "shard")
    return out.join(found, ["shard", "seq"], "left").select("page_id", "shard", "seq", "offset", "length", "sha256", "range_sha256", "root_sha256", F.coalesce("status", F.lit("intact")).alias("status"))


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """One WARC file per partition of pages: the text writer ends every record with RECORD_END."""
    pages.select(record(F.col(page_id), F.col(url), F.col(html)).alias("value")).write.option("lineSep", RECORD_END).text(path)


def _members(data: bytes) -> Iterator[tuple[int, int, bytes, bool]]:
    """Place, length, content and soundness of each gzip member; a cut-off last one with what can be read of it."""
    at = 0
    while at < len(data):
        unzip = zlib.decompressobj(31)
        try:
            content = unzip.decompress(data[at:])
        except zlib.error:
            yield at, len(data) - at, b"", False
            return
        length = len(data) - at - len(unzip.unused_data)
        yield at, length, content, unzip.eof
        at += length


def _records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes, str]]:
    """Place, length, fields, body and status of the records in plain WARC data."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":  # further empty lines between records
            at += 2
            continue
        head = data.find(b"\r\n\r\n", at)
        lines = data[at : head if head >= 0 else len(data)].split(b"\r\n")
        fields: dict[str, str] = {}
        last = None
        for line in lines[1:]:
            if line[:1] in (b" ", b"\t") and last:  # a field that goes on
                fields[last] += " " + line.strip().decode("utf-8", "replace")
                continue
            name, _, value = line.partition(b":")
            last = name.strip().lower().decode("utf-8", "replace")
            fields[last] = value.strip().decode("utf-8", "replace")
        if head < 0:
            yield at, len(data) - at, fields, b"", "truncated"
            return
        size = fields.get("content-length", "")
        if not lines[0].startswith(b"WARC/") or not (size.isascii() and size.isdigit()):
            yield at, len(data) - at, fields, b"", "malformed"  # where the next record begins is not known
            return
        end = head + 4 + int(size)
        body = data[head + 4 : end]
        whole = data[end : end + 4] == b"\r\n\r\n"
        status = "truncated" if end + 4 > len(data) else "ok" if whole else "malformed"
        yield at, min(end + 4, len(data)) - at, fields, body, status
        if status == "malformed":
            return
        at = end + 4


def read_warc(spark, path: str, pattern: str | None = None) -> DataFrame:
    """(path, offset, length, type, record_id, date, url, body, status) of the records of WARC files.

    status: ok; truncated, where the file ends within the record, whose length is then what is there; or malformed,
    where a record has no length or no end, after which the rest of the file is one row. type, record_id, date and url
    are null where the record has none. In a gzipped file offsets and lengths are those of the members. A file is one
    row in memory, of at most spark.sql.sources.binaryFile.maxLength; pattern chooses files by name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = []
                if data[:2] == b"\x1f\x8b":
                    for at, length, content, sound in _members(data):
                        own = list(_records(content)) or [(0, 0, {}, b"", "truncated")]
                        found += [(at, length, f, body, status if sound or status != "ok" or k + 1 < len(own) else "truncated") for k, (_, _, f, body, status) in enumerate(own) if content or not sound]
                else:
                    found = list(_records(data))
                rows = [(name, at, n, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-date"), f.get("warc-target-uri"), body, status) for at, n, f, body, status in found]
                columns = list(zip(*rows, strict=True)) or [()] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    names = ["path", "offset", "length", "type", "record_id", "date", "url", "body", "status"]
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.string()]
    ship(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "content")
    return files.mapInArrow(run, "path string, offset long, length long, type string, record_id string, date string, url string, body binary, status string")


DRILL = 997


def drilled(pages: DataFrame, every: int = DRILL) -> DataFrame:
    """A second copy whose first byte of the page is another one in every `every`-th page that begins with one of
    one byte: an audit's drill. Other pages, also empty ones, stay as they are, since their length must not change."""
    first = F.substring("html", 1, 1)
    other = F.concat(F.when(first == "#", F.lit("%")).otherwise(F.lit("#")), F.substring(F.col("html"), F.lit(2), F.length("html")))
    return pages.withColumn("html", F.when((F.col("page_id") % every == 0) & (F.octet_length(first) == 1), other).otherwise(F.col("html")))


_RECORD_SQL = "'WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:' || page_id || '>\r\nWARC-Date: " + DATE + "\r\nWARC-Target-URI: ' || coalesce(url, '') || '\r\nContent-Type: text/html\r\nContent-Length: ' || strlen(coalesce(html, '')) || '\r\n\r\n' || coalesce(html, '') || '\r\n\r\n'".replace("\r\n", "' || chr(13) || chr(10) || '")

#: The same in DuckDB's SQL for the pages table: shards of SHARD_IDS unique ids, so two levels above the leaves.
ORACLE_SQL = f"""
WITH r AS (SELECT page_id, coalesce(url, '') AS u, page_id // {SHARD_IDS} AS shard, coalesce(strlen(html[1]) = 1, false) AS drill, {_RECORD_SQL} AS r FROM pages),
l AS (SELECT page_id, shard, drill, row_number() OVER w - 1 AS seq, strlen(r) AS length, sha256(r) AS sha256, sum(strlen(r)) OVER w - strlen(r) AS "offset" FROM r WINDOW w AS (PARTITION BY shard ORDER BY page_id, u ROWS UNBOUNDED PRECEDING)),
n AS (SELECT shard, seq // {FANOUT} AS part, CAST(min("offset") AS BIGINT) AS a, CAST(max("offset" + length) AS BIGINT) AS b, string_agg(sha256, '' ORDER BY seq) AS c FROM l GROUP BY ALL),
h AS (SELECT shard, part, a, b, sha256(a || '-' || b || ':' || c) AS range_sha256 FROM n),
t AS (SELECT shard, sha256(min(a) || '-' || max(b) || ':' || string_agg(range_sha256, '' ORDER BY part)) AS root_sha256, count(*) AS parts FROM h GROUP BY shard),
o AS (SELECT t.shard, CASE WHEN (SELECT max(seq) FROM l) < {FANOUT} THEN h.range_sha256 ELSE t.root_sha256 END AS root_sha256 FROM t JOIN h ON h.shard = t.shard AND h.part = 0)
SELECT page_id, l.shard, seq, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, sha256, range_sha256, root_sha256, CASE WHEN page_id % {DRILL} = 0 AND drill THEN 'corrupt' ELSE 'intact' END AS status
FROM l JOIN h ON l.shard = h.shard AND l.seq // {FANOUT} = h.part JOIN o ON o.shard = l.shard
"""
