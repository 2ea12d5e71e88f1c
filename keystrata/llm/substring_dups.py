"""Removal of repeated passages by Rabin-Karp window hashes (operator 9).

Words are maximal runs of anything but space and tab to carriage return, unchanged. Every window of
`size` consecutive words of a document has two rolling polynomial hashes over word hashes, 128 bits in
all, chosen by a random key for each job, so that no input can be made to collide. Of the windows with
the same words all but the first (smaller id, then earlier start) are repeated; a word that a repeated
window covers is removed, and runs of removed words are the maximal removal intervals. Windows are
judged on the input.

Documents are dealt into groups of about GROUP_BYTES of text, by a hash of their place, so neither an id
nor a source makes a large one. Windows are counted in two passes between groups and hash buckets:

1. A group sends 48 bits of each distinct window, sorted and cut into buckets; a passage that a third of
   all documents have is one entry of each group. The bucket answers a bit an entry: whether another
   group has it too.
2. Of those only, the group sends all 128 bits with the document of the first occurrence; the bucket
   answers whether the window occurs earlier elsewhere.

The group, computed again from the same documents, turns bits into intervals. Tasks hold one group or
bucket. Groups and buckets follow the bytes of text, measured first; from MOST_BUCKETS on buckets grow
instead, since a group's entries would be cut too small: at 100 TB one holds about 0.7 GB.

Two different windows are taken for the same with a probability of about 2^-120 a pair.

Null and empty texts have no words; the hash of what is kept is that of no bytes. Ids are integers;
rows of a null id come after all others. Rows with the same id count as documents of their own, in
order of the first 64 characters of their text, then of a hash of it; equal ones among them in any
order, which makes no difference to the result. Tables with repeated or null ids are sorted once for
this. Other columns of the input are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_name, numbered, power_of_two, ship, shuffle_partitions
from .words import Words

SIZE = 20
GROUP_BYTES, BUCKET_BYTES, PARTITION_BYTES = 10 << 20, 16 << 20, 512 << 20  # of text a group, a bucket, a shuffle partition
MOST_BUCKETS = 1 << 17
_MARK = 6  # bytes of a window in the first pass


def _planes(values: np.ndarray, width: int) -> bytes:
    """The first `width` bytes of big-endian values, all first bytes first: sorted values shrink well so."""
    raw = np.ascontiguousarray(values.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(raw.T).tobytes()


def _values(raw: bytes, n: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.view(">u8").reshape(-1).astype(np.uint64)


def _pack(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


class _Group:
    """A group's documents in order of place and their windows; the same for the same documents."""

    def __init__(self, docs: pa.Table, size: int, key: int, wide: bool):
        docs = docs.combine_chunks()
        self.docs = docs.take(pa.compute.sort_indices(docs, [("at", "ascending")]))
        self.at = self.docs.column("at").to_numpy()
        column = self.docs.column("t")
        self.texts = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.words = Words(self.texts, key, wide)
        self.hash, self.text = self.words.windows(size)
        self.order = np.argsort(self.hash, kind="stable")
        ordered = self.hash[self.order]
        self.new = np.ones(len(ordered), bool)
        self.new[1:] = ordered[1:] != ordered[:-1]
        if wide:
            self.more = self.words.windows(size, 1)[0]
            second = self.more[self.order]
            if bool((~self.new[1:] & (second[1:] != second[:-1])).any()):  # one hash, other windows: order by both
                self.order = np.lexsort((np.arange(len(self.hash)), self.more, self.hash))
                ordered, second = self.hash[self.order], self.more[self.order]
                self.new[1:] = (ordered[1:] != ordered[:-1]) | (second[1:] != second[:-1])
        self.first = self.order[self.new]  # of each distinct window, in order of hash, the first occurrence
        self.distinct = ordered[self.new]

    def edges(self, bits: int) -> np.ndarray:
        """Where the buckets begin among the distinct windows, and their end."""
        starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
        return np.append(np.searchsorted(self.distinct, starts), len(self.distinct))


def _send(docs: pa.Table, size: int, bits: int, key: int) -> pa.Table:
    """A row for each bucket that the group has windows in: 48 bits behind those of the bucket, sorted."""
    with np.errstate(over="ignore"):
        g = _Group(docs, size, key, False)
        edges = g.edges(bits)
        marks = g.distinct << np.uint64(bits)
    some = np.flatnonzero(np.diff(edges))
    blobs = [_pack(np.array([b - a], "<i8").tobytes(), _planes(marks[a:b], _MARK)) for a, b in zip(edges[some].tolist(), edges[some + 1].tolist(), strict=True)]
    group = docs.column("group")[0].as_py()
    return pa.table({"bucket": pa.array(some, pa.int32()), "group": pa.array([group] * len(some), pa.int32()), "entries": pa.array(blobs, pa.binary())})


def _shared(sent: pa.Table) -> pa.Table:
    """A bit an entry: whether several groups sent it."""
    parts = []
    for blob in sent.column("entries").to_pylist():
        raw = _unpack(blob)
        parts.append(_values(raw, int(np.frombuffer(raw, "<i8", 1)[0]), _MARK, 8))
    every = np.concatenate(parts)
    every.sort()
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for marks in parts:
        # a group may have sent equal marks of different windows; they are judged again in the second pass
        hit = twice[np.minimum(np.searchsorted(twice, marks), len(twice) - 1)] == marks if len(twice) else np.zeros(len(marks), bool)
        out.append(np.packbits(hit).tobytes() if hit.any() else b"")
    return pa.table({"group": sent.column("group"), "bucket": sent.column("bucket"), "bits": pa.array(out, pa.binary())})


def _unflag(edges: np.ndarray, rows: pa.Table, n: int) -> np.ndarray:
    """The bits of all buckets as flags of the distinct windows."""
    out = np.zeros(n, bool)
    for bucket, blob in zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        a, b = edges[bucket], edges[bucket + 1]
        out[a:b] = np.unpackbits(np.frombuffer(blob, np.uint8), count=b - a).astype(bool)
    return out


def _send_shared(docs: pa.Table, bits: pa.Table, size: int, n_bits: int, key: int) -> pa.Table:
    """For each bucket the shared windows whole, with the document of the first occurrence; and to the group
    itself (bucket below 0) which they are."""
    if not docs.num_rows or not bits.num_rows:
        return pa.table({"bucket": pa.array([], pa.int32()), "group": pa.array([], pa.int32()), "entries": pa.array([], pa.binary())})
    with np.errstate(over="ignore"):
        # equal hashes of different windows are one entry of the first pass, so flags go by the first hash
        narrow = _Group(docs, size, key, True)
    hashes = np.unique(narrow.distinct)
    starts = np.arange(1 << n_bits, dtype=np.uint64) << np.uint64(64 - n_bits) if n_bits else np.zeros(1, np.uint64)
    flagged = hashes[_unflag(np.append(np.searchsorted(hashes, starts), len(hashes)), bits, len(hashes))]
    place = np.minimum(np.searchsorted(flagged, narrow.distinct), max(len(flagged) - 1, 0))
    asked = flagged[place] == narrow.distinct if len(flagged) else np.zeros(len(narrow.distinct), bool)
    edges = narrow.edges(n_bits)
    group = docs.column("group")[0].as_py()
    buckets, blobs = [-1 - group], [_pack(np.packbits(asked).tobytes())]
    for bucket in np.flatnonzero(np.diff(edges)).tolist():
        own = np.flatnonzero(asked[edges[bucket] : edges[bucket + 1]]) + edges[bucket]
        if not len(own):
            continue
        first = narrow.first[own]
        used, of = np.unique(narrow.text[first], return_inverse=True)
        head = np.array([len(own), len(used)], "<i8").tobytes()
        blobs.append(_pack(head, _planes(narrow.distinct[own], 8), _planes(narrow.more[first], 8), of.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), narrow.at[used].astype("<i8").tobytes()))
        buckets.append(bucket)
    return pa.table({"bucket": pa.array(buckets, pa.int32()), "group": pa.array([group] * len(buckets), pa.int32()), "entries": pa.array(blobs, pa.binary())})


def _answer(sent: pa.Table) -> pa.Table:
    """A bit an entry: whether the window occurs earlier in another group. What a group sent itself it gets back."""
    if sent.column("bucket")[0].as_py() < 0:
        return pa.table({"group": sent.column("group"), "bucket": sent.column("bucket"), "bits": sent.column("entries")})
    parts = []
    for blob in sent.column("entries").to_pylist():
        raw = _unpack(blob)
        n, used = (int(x) for x in np.frombuffer(raw, "<i8", 2))
        of = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 16 + 16 * n).reshape(4, n).T).view("<u4").reshape(-1)
        parts.append((_values(raw, n, 8, 16), _values(raw, n, 8, 16 + 8 * n), np.frombuffer(raw, "<i8", used, 16 + 20 * n)[of]))
    one, two, at = (np.concatenate([p[k] for p in parts]) for k in range(3))
    by = np.lexsort((at, two, one))
    later = np.zeros(len(by), bool)
    later[by[1:]] = (one[by[1:]] == one[by[:-1]]) & (two[by[1:]] == two[by[:-1]])
    ends = np.cumsum([len(p[0]) for p in parts])
    bits = [np.packbits(later[a:b]).tobytes() for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
    return pa.table({"group": sent.column("group"), "bucket": sent.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _apply(docs: pa.Table, bits: pa.Table, size: int, n_bits: int, key: int, with_text: bool) -> pa.Table:
    with np.errstate(over="ignore"):
        g = _Group(docs, size, key, True)
    edges = g.edges(n_bits)
    asked, elsewhere = np.zeros(len(g.distinct), bool), np.zeros(len(g.distinct), bool)
    answers = dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist(), strict=True))
    own = [b for b in answers if b < 0]
    if own:
        asked = np.unpackbits(np.frombuffer(_unpack(answers.pop(own[0])), np.uint8), count=len(g.distinct)).astype(bool)
    for bucket, blob in answers.items():
        places = np.flatnonzero(asked[edges[bucket] : edges[bucket + 1]]) + edges[bucket]
        elsewhere[places] = np.unpackbits(np.frombuffer(blob, np.uint8), count=len(places)).astype(bool)
    repeated = np.zeros(len(g.hash), bool)
    if len(g.hash):
        repeated[g.order] = ~g.new | elsewhere[np.cumsum(g.new) - 1]
    w = g.words
    # windows of a text begin at its first word, so the k-th window of a text begins at its k-th word
    windows = np.maximum(w.counts - size + 1, 0)
    begin = w.bounds[:-1][g.text] + np.arange(len(g.hash)) - (np.cumsum(windows) - windows)[g.text]
    begin = begin[repeated]
    steps_ = np.bincount(begin, minlength=len(w.hash) + 1) - np.bincount(begin + size, minlength=len(w.hash) + 1)[: len(w.hash) + 1]
    removed = np.cumsum(steps_)[:-1] > 0
    edge = np.diff(removed.astype(np.int8), prepend=0, append=0)
    # an interval ends with its document, though the next one may begin with another
    heads = w.bounds[1:-1]
    heads = heads[(heads > 0) & (heads < len(removed))]
    split = heads[removed[heads] & removed[heads - 1]]
    starts = np.sort(np.concatenate((np.flatnonzero(edge > 0), np.unique(split))))
    stops = np.sort(np.concatenate((np.flatnonzero(edge < 0), np.unique(split))))
    n_removed, digest, kept_texts = [], [], []
    texts = g.texts.to_pylist()
    for i, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
        own = removed[a:b]
        gone = int(own.sum())
        words = (texts[i] or "").encode("utf-8").split() if gone < b - a else []
        kept = b" ".join(compress(words, (~own).tolist()) if gone else words)
        n_removed.append(gone)
        digest.append(hashlib.sha256(kept).hexdigest())
        if with_text:
            kept_texts.append(kept.decode("utf-8") if texts[i] is not None else None)
    of = np.searchsorted(w.bounds, starts, "right") - 1
    base = w.bounds[:-1][of]
    lists = np.searchsorted(of, np.arange(w.texts + 1))
    spans = pa.StructArray.from_arrays([pa.array(starts - base, pa.int64()), pa.array(stops - base, pa.int64())], names=["start", "end"])
    out = {"id": g.docs.column("id"), "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "intervals": pa.ListArray.from_arrays(pa.array(lists, pa.int32()), spans)}
    if with_text:
        out["kept_text"] = pa.array(kept_texts, pa.string())
    return pa.table(out)


def in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(at, id, t): rows with a number that orders them by id, then text; the id itself where ids are unique."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").isEmpty():
        return rows.select(F.col("id").alias("at"), "id", "t")
    return numbered(rows, "id", "t", "at").select("at", "id", "t")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, with_text: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """A row per document: id, n_words, n_removed, kept_sha256, intervals (word places), maybe kept_text."""
    spark = docs.sparkSession
    ship(spark)
    key = int.from_bytes(os.urandom(16), "little")
    rows = in_order(docs, doc_id, text)
    total = rows.agg(F.sum(F.octet_length("t").cast("long")).alias("n")).first()["n"] or 0
    least = shuffle_partitions(spark)
    groups = max(least, -(-total // group_bytes))
    bits = power_of_two(min(MOST_BUCKETS, max(least, total / BUCKET_BYTES))).bit_length() - 1
    partitions = min(groups, max(least, -(-total // PARTITION_BYTES)))
    dealt = rows.select(F.pmod(F.xxhash64("at"), F.lit(groups)).cast("int").alias("group"), "at", "id", "t").repartition(partitions, "group")
    sent_type, bits_type = "bucket int, group int, entries binary", "group int, bucket int, bits binary"
    sent = dealt.groupBy("group").applyInArrow(lambda t: _send(t, size, bits, key), sent_type)
    shared = sent.groupBy("bucket").applyInArrow(_shared, bits_type).where(F.length("bits") > 0)
    asked = dealt.groupBy("group").cogroup(shared.groupBy("group")).applyInArrow(lambda d, b: _send_shared(d, b, size, bits, key), sent_type)
    answers = asked.groupBy("bucket").applyInArrow(_answer, bits_type)
    schema = "id long, n_words long, n_removed long, kept_sha256 string, intervals array<struct<start: long, end: long>>" + (", kept_text string" if with_text else "")
    out = dealt.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(lambda d, b: _apply(d, b, size, bits, key, with_text), schema)
    kept = [c for c in out.columns if c != "id"]
    return out.select(F.col("id").alias(clean_name(kept, doc_id)), *kept)


#: The same in DuckDB's SQL for unique ids: windows are compared as strings of words.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {SIZE} + 2)) AS p FROM d WHERE len(w) >= {SIZE}),
k AS (SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(w[p : p + {SIZE - 1}], ' ') ORDER BY doc_id, p) AS nth FROM p),
j AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
c AS (SELECT j.doc_id, j.j, j.word, max(CASE WHEN k.nth > 1 THEN k.p END) OVER (PARTITION BY j.doc_id ORDER BY j.j ROWS UNBOUNDED PRECEDING) AS last FROM j LEFT JOIN k ON k.doc_id = j.doc_id AND k.p = j.j),
r AS (SELECT doc_id, count(*) FILTER (last > j - {SIZE}) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (last IS NULL OR last <= j - {SIZE}) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
