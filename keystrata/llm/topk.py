"""Exact top-k inner products with KD-trees per shard (operator 8).

Vectors become integers, floor(scale * component). Splits at the median of the widest component, as a
KD-tree has them in its upper levels, deal them into regions of space, and a region of many vectors into
shards of at most about `shard_rows`; a shard's KD-tree splits on down to leaves, each node with its tight
bounding box. A query visits nodes best first: the bound of a box is the largest inner product of any
point in it, sum of max(q * low, q * high), and a node whose bound is under the k-th score found is left
out.

The k-th score travels: every query is first searched in one shard of the region with the best bound.
Its k-th score there leaves out all regions whose boxes are under it, and comes along to the shards of
the others as the bound they start from, so they return only what can still count. Queries meet a shard
in blocks of rows; the shards' best rows are ranked per query at the end. The fewer dimensions the
vectors vary in, the more regions are left out; of independent components in many dimensions few are.

The splits are taken from at most SAMPLE vectors and only decide where vectors lie; boxes are those of
all vectors. At most REGIONS boxes of each length are held by the driver and sent to tasks.

Ties go to the smaller id, in every tree and at the end. Vectors that are null, or hold null or
non-finite components, or differ in length from the query, take no part. Rows with the same id are
candidates each; a query's own id is no candidate. Query rows with the same id and the same vector are
one query; with different vectors each has its own k results, under the same query_id. Rows of a null id
take no part. An empty table gives no rows. Other columns, of any name, are not read. Scores are exact
while they fit 64 bits.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored

K, SCALE, LEAF, SHARD_ROWS = 10, 1024, 128, 32768
REGIONS, SAMPLE = 1024, 65536
_EXACT = float(1 << 53)


class KDTree:
    """Arrays of integer vectors in leaf order, and boxes of a complete binary tree's nodes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.depth = max(0, math.ceil(math.log2(max(1, len(ids) / leaf))))
        order = np.arange(len(ids))
        cuts = [0, len(ids)]
        for _ in range(self.depth):
            new = [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = order[a:b]
                middle = (b - a) // 2
                if b - a > 1:
                    own = vectors[part]
                    wide = int((own.max(0) - own.min(0)).argmax())
                    order[a:b] = part[np.argpartition(own[:, wide], middle)]
                new += [a + middle, b]
            cuts = new
        self.ids, self.vectors, self.cuts = ids[order], vectors[order], cuts
        low = [self.vectors[a:b].min(0) if b > a else np.zeros(vectors.shape[1], vectors.dtype) for a, b in zip(cuts, cuts[1:], strict=False)]
        high = [self.vectors[a:b].max(0) if b > a else np.zeros(vectors.shape[1], vectors.dtype) for a, b in zip(cuts, cuts[1:], strict=False)]
        levels = [(np.array(low), np.array(high), np.diff(cuts))]
        while len(levels[0][0]) > 1:
            lo, hi, n = levels[0]
            # an empty sibling's box counts for nothing
            lo = np.where((n > 0)[:, None], lo, np.iinfo(np.int64).max)
            hi = np.where((n > 0)[:, None], hi, np.iinfo(np.int64).min)
            levels.insert(0, (np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2]), n[::2] + n[1::2]))
        self.levels = [(lo.astype(np.float64), hi.astype(np.float64), n) for lo, hi, n in levels]
        # products of doubles are exact below 2^53; beyond, integers are used and boxes are widened
        most = float(np.abs(vectors).max(initial=0))
        self.most = most
        self.doubles = self.vectors.astype(np.float64)

    def search(self, query_id: int, query: np.ndarray, k: int, bound: int | None) -> list[tuple[int, int]]:
        """Up to k (score, id) of at least the bound, best first; ties to smaller ids."""
        q = query.astype(np.float64)
        exact = self.most * float(np.abs(query).max(initial=0)) * max(1, len(query)) < _EXACT
        slack = 0.0 if exact else 1e-12 * self.most * float(np.abs(q).sum()) + 1
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst on top

        def bounds(level: int, nodes: list[int]) -> np.ndarray:
            lo, hi, _ = self.levels[level]
            return np.maximum(lo[nodes] * q, hi[nodes] * q).sum(1) + slack

        def worst() -> float:
            found = best[0][0] if len(best) == k else -math.inf
            return max(found, bound) if bound is not None else found

        heap = [(-float(bounds(0, [0])[0]), 0, 0)]
        while heap:
            negative, level, node = heapq.heappop(heap)
            if -negative < worst():
                break
            if level == self.depth:
                a, b = self.cuts[node], self.cuts[node + 1]
                ids = self.ids[a:b]
                scores = (self.doubles[a:b] @ q).astype(np.int64) if exact else self.vectors[a:b] @ query
                some = (scores >= worst()) & (ids != query_id)
                for s, i in sorted(zip((-scores[some]).tolist(), ids[some].tolist(), strict=True))[:k]:
                    entry = (-s, -i)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                continue
            children = [c for c in (2 * node, 2 * node + 1) if self.levels[level + 1][2][c]]
            for c, value in zip(children, bounds(level + 1, children).tolist(), strict=True):
                if value >= worst():
                    heapq.heappush(heap, (-value, level + 1, c))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64)


class Splits:
    """The upper levels of a KD-tree, from a sample: which region a vector lies in."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.dims, self.cuts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1, np.int64)
        parts = [sample]
        for node in range((1 << depth) - 1):  # in order of level, so parts[node] is there already
            own = parts[node]
            if len(own):
                self.dims[node] = int((own.max(0) - own.min(0)).argmax())
                self.cuts[node] = int(np.median(own[:, self.dims[node]]))
            right = own[:, self.dims[node]] > self.cuts[node]
            parts += [own[~right], own[right]]

    def region(self, vectors: np.ndarray) -> np.ndarray:
        node = np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (vectors[np.arange(len(vectors)), self.dims[node]] > self.cuts[node])
        return node - ((1 << self.depth) - 1)


class Boxes:
    """The regions that hold vectors of one length, their bounding boxes and numbers of shards."""

    def __init__(self, regions: list[int], low: np.ndarray, high: np.ndarray, shards: list[int]):
        self.regions, self.shards = np.array(regions, np.int64), np.array(shards, np.int64)
        self.low, self.high = low.astype(np.float64), high.astype(np.float64)
        self.most = np.maximum(np.abs(self.low), np.abs(self.high))

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """At least the largest inner product in each region, also after rounding."""
        q = query.astype(np.float64)
        return np.maximum(self.low * q, self.high * q).sum(1) + 1e-12 * (self.most * np.abs(q)).sum(1) + 1


def _by_length(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for n in np.unique(lengths).tolist():
        yield n, np.flatnonzero(lengths == n)


def _assign(splits: dict[int, Splits]):
    """Rows id, asks, v, n, with the region of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region = np.zeros(batch.num_rows, np.int32)
            for n, own in _by_length(batch.column(3).to_numpy()):
                if n in splits:
                    region[own] = splits[n].region(_matrix(batch.column(2).take(pa.array(own))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], names=[*batch.schema.names, "region"])

    return run


def _box_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows v, n, region: a row for each region of the partition, with its box and count."""
    found: dict[tuple[int, int], list] = {}
    for batch in batches:
        regions = batch.column(2).to_numpy()
        for n, own in _by_length(batch.column(1).to_numpy()):
            m = _matrix(batch.column(0).take(pa.array(own)))
            for r in np.unique(regions[own]).tolist():
                part = m[regions[own] == r]
                low, high, count = found.get((n, r), (part[0], part[0], 0))
                found[n, r] = [np.minimum(low, part.min(0)), np.maximum(high, part.max(0)), count + len(part)]
    yield _box_rows(found)


def _box_rows(found: dict) -> pa.RecordBatch:
    keys = sorted(found)
    column = lambda k: pa.array([found[x][k].tolist() for x in keys], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([n for n, _ in keys], pa.int32()), pa.array([r for _, r in keys], pa.int32()), column(0), column(1), pa.array([int(found[x][2]) for x in keys], pa.int64())], names=["n", "region", "low", "high", "count"])


def _merge_boxes(rows: pa.Table) -> pa.Table:
    rows = rows.combine_chunks()
    low, high = (np.array(rows.column(c).to_pylist(), np.int64) for c in ("low", "high"))
    key = (rows.column("n")[0].as_py(), rows.column("region")[0].as_py())
    return pa.Table.from_batches([_box_rows({key: [low.min(0), high.max(0), sum(rows.column("count").to_pylist())]})])


def _places(boxes: dict[int, Boxes], home: bool):
    """Rows q, id, v, n and kth: at home, the shard of best bound; else all others that can still count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen: list[tuple[int, int, int]] = []  # row, region, shard
            q, kth = batch.column(0).to_pylist(), batch.column(4).to_pylist()
            for n, own in _by_length(batch.column(3).to_numpy()):
                if n not in boxes:  # few vectors of that length: one shard
                    chosen += [(i, 0, 0) for i in own.tolist()] if home else []
                    continue
                of, m = boxes[n], _matrix(batch.column(2).take(pa.array(own)))
                for i, v in zip(own.tolist(), m, strict=True):
                    bound = of.bounds(v)
                    best = int(bound.argmax())
                    first = (best, q[i] % int(of.shards[best]))
                    if home:
                        chosen.append((i, int(of.regions[best]), first[1]))
                        continue
                    for k in np.flatnonzero(bound >= (-np.inf if kth[i] is None else kth[i])).tolist():
                        chosen += [(i, int(of.regions[k]), s) for s in range(int(of.shards[k])) if (k, s) != first]
            if chosen:
                row, region, shard = zip(*chosen, strict=True)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(region, pa.int32()), pa.array(shard, pa.int32())], names=[*batch.schema.names, "region", "shard"])

    return run


def _search(k: int):
    """Rows n, region, shard, asks, q, id, v, bound: a shard's vectors come first, then its queries; trees are kept
    one shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, ids, parts = None, None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            begin = 0
            while begin < len(keys):
                end = begin
                while end < len(keys) and keys[end] == keys[begin]:
                    end += 1
                own = batch.slice(begin, end - begin)
                if keys[begin][:3] != at:
                    at, tree, ids, parts = keys[begin][:3], None, [], []
                if not keys[begin][3]:
                    ids.append(own.column(5).to_numpy())
                    parts.append(_matrix(own.column(6)))
                elif parts:
                    if tree is None:
                        tree = KDTree(np.concatenate(ids), np.concatenate(parts))
                    rows = [(q, i, v_id, s) for q, i, v, bound in zip(own.column(4).to_pylist(), own.column(5).to_pylist(), _matrix(own.column(6)), own.column(7).to_pylist(), strict=True) for s, v_id in tree.search(i, v, k, bound)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["q", "query_id", "vec_id", "score"])
                begin = end

    return run


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row that is_query holds for."""
    spark = vectors.sparkSession
    ship(spark)
    e = F.col(f"`{embedding}`")
    good = e.isNotNull() & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size(e) > 0)
    rows = vectors.where(good).select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.transform(e, lambda x: F.floor(x.cast("double") * scale)).alias("v")).where("id is not null")
    rows = rows.withColumn("n", F.size("v"))
    # lengths of more than one shard: fewer than there are shards
    large = {r["n"]: r["count"] for r in rows.groupBy("n").count().where(F.col("count") > shard_rows).collect()}
    splits = {}
    for n, count in large.items():
        depth = min(REGIONS.bit_length() - 1, math.ceil(math.log2(count / shard_rows)))
        share = min(1.0, SAMPLE / len(large) / count)
        sample = rows.where((F.col("n") == n) & (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))).select("id", "v").orderBy("id").limit(2 * SAMPLE // len(large))
        splits[n] = Splits(np.array([r["v"] for r in sample.collect()], np.int64).reshape(-1, n), depth)
    rows = stored(rows.select("id", "asks", "v", "n").mapInArrow(_assign(splits), "id long, asks boolean, v array<long>, n int, region int"), "vectors")
    boxes: dict[int, Boxes] = {}
    if large:
        parts = rows.where(F.col("n").isin(list(large))).select("v", "n", "region").mapInArrow(_box_parts, _BOX)
        found = parts.groupBy("n", "region").applyInArrow(_merge_boxes, _BOX).collect()  # at most REGIONS a length
        for n in large:
            own = sorted((r for r in found if r["n"] == n), key=lambda r: r["region"])
            boxes[n] = Boxes([r["region"] for r in own], np.array([r["low"] for r in own]), np.array([r["high"] for r in own]), [math.ceil(r["count"] / shard_rows) for r in own])
    several = [(n, int(r), int(s)) for n, b in boxes.items() for r, s in zip(b.regions, b.shards, strict=True)]
    of = F.broadcast(spark.createDataFrame(several, "n int, region int, shards int"))
    shard = F.coalesce(F.pmod(F.xxhash64("id", F.lit(9)), F.col("shards")), F.lit(0)).cast("int")
    none = F.lit(None).cast("long")
    held = rows.join(of, ["n", "region"], "left").select("n", "region", shard.alias("shard"), F.lit(False).alias("asks"), none.alias("q"), "id", "v", none.alias("bound"))
    queries = stored(rows.where("asks").select("id", "v", "n").dropDuplicates(["id", "v"]).select(F.monotonically_increasing_id().alias("q"), "id", "v", "n", none.alias("kth")), "queries")
    total = sum(s for _, _, s in several) + 1
    placed = "q long, id long, v array<long>, n int, kth long, region int, shard int"

    def searched(asked: DataFrame) -> DataFrame:
        """asked: as `placed`. A task holds whole shards, each sorted vectors first."""
        asked = asked.select("n", "region", "shard", F.lit(True).alias("asks"), "q", "id", "v", F.col("kth").alias("bound"))
        both = held.unionByName(asked).repartition(total, "n", "region", "shard").sortWithinPartitions("n", "region", "shard", "asks")
        return both.mapInArrow(_search(k), "q long, query_id long, vec_id long, score long")

    found = stored(searched(queries.mapInArrow(_places(boxes, True), placed)), "first-shard")
    if total > 2:
        known = found.groupBy("q").agg(F.count(F.lit(1)).alias("m"), F.min("score").alias("least"))
        bounded = queries.drop("kth").join(known, "q", "left").select("q", "id", "v", "n", F.when(F.col("m") >= k, F.col("least")).alias("kth"))
        found = found.unionByName(searched(bounded.mapInArrow(_places(boxes, False), placed)))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


_BOX = "n int, region int, low array<long>, high array<long>, count long"

#: The same in DuckDB's SQL, for the embeddings table of unique ids and its queries, ids divisible by 100.
ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
