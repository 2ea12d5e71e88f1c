"""Near-duplicate classes by ProbMinHash, banding and verification (operator 4).

A document is the set of its shingles of five words (fewer words: one shingle of all of them).
ProbMinHash: each shingle sends arrivals of a Poisson process of its weight as rate to random
registers, a register keeps its earliest arrival, and a shingle stops as soon as its next arrival is
later than every register's. Two documents agree in a register with their probability Jaccard
similarity. Every shingle weighs 1, however often it occurs, so this is the similarity that
verification compares. 128 registers in 32 bands of 4 make a pair of similarity 0.8 candidates with
a probability of 1 - 5e-8.

Two documents are linked if the Jaccard similarity of their shingle sets is at least t = 0.8; a class
is a connected component. Documents of the same words are one node. A bucket is never paired off:

1. A document's company is the size of all its buckets; the most company in a bucket is near the
   middle of its group. Every document is verified against the leader of most company in any of its
   buckets. If linked, that leader is its head; otherwise it is its own.
2. In each bucket, documents with another head than its leader's are verified against that head, L.
3. A link between two documents x and y verified against L, x without success, needs a shingle that
   both have and L has not, or sizes |x| + |y| <= i (1 + t) / t where i is the smaller number of
   shingles they share with L (without a shingle outside L they share at most i). Documents of such
   sizes stay together in the buckets of their bands, one for each L: where up to PAIRED of one failed, these
   are verified against all of it, so at most PAIRED pairs a document; where more did, it is a bucket of
   the next round. So is for the rest each (L, shared shingle outside L). A bucket is led by one of its documents. The prefix rule keeps
   these few: in order of how many documents of L have a shingle, x and y share one among the first
   |x| - ceil(t |x|) + 1 of x; so a failed document with that many shingles of its own is done. So is
   one whose shingles shared with L and those shared with others are too few for the smallest
   partner in the bucket.

In each round the smallest buckets of the next one are paired at once, in tasks over all executors, as far as
that makes up to EACH pairs for each candidate document (or AT_ONCE in all), counted before repeated pairs and those whose sizes
exclude a link are left out;
the others are led. Rounds go on until no bucket is left to be led, or until leaders come up again with
nothing but known pairs. Then they go on with another leader each round; only if TURNS of these in a row
bring nothing new, they are paired too. A rest of few pairs and little text, both measured first, is settled in one task. So
no link between candidates is lost, and work follows the number of documents, not the square of a
group. The pairs of a leader are dealt over blocks of BLOCK, each with the leader's text once, so no
task gets a whole family. Candidates and verified pairs stay in tables in the shared folder.

Word sequences are told apart by 128 bits of a BLAKE2b digest, shingles by 64 bits of a hash that is
not linear in the words.

Null texts and texts without a word are a class of their own each. Rows with the same id are one
document, which has the links of each of its texts; rows of a null id are left out of `classes`, and
documents of their own for `one_of_each`. Ties go to smaller ids. An empty table gives no rows. Columns
other than id and text are not read by `classes` and kept by `one_of_each`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clean_name, numbered, ship, steps, stored
from .components import components
from .words import Words, mix

SHINGLE, SIMILARITY = 5, 0.8
REGISTERS, BANDS = 128, 32
SINGLY, ARRIVALS = 4, 1 << 13  # arrivals of each shingle that are taken one at a time; arrivals that are taken at once after them
LOCAL_PAIRS, LOCAL_BYTES = 100_000, 32 << 20  # of a rest that one task settles
EACH, AT_ONCE = 64, 1 << 20  # pairs of rare buckets that a round makes at once: for each candidate document, or in all if that is more
BLOCK, TURNS, PAIRED = 4096, 4, 1024  # pairs of one leader in a task's block; leaders tried before a bucket is paired; failed documents of a bucket that may be paired with the others at once
BROADCAST_IDS = 100_000  # ids of a round that may be broadcast, under 2 MB; more are joined by a shuffle
CORPUS_IDS = 500_000  # whole-number ids that may be broadcast to all documents, so that these are not shuffled
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def weighted_shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: the text, the hash, how often; ordered by text and hash."""
    h, text = words.shingles(size)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], h[first], np.diff(np.append(first, len(h)))


def prob_min_hash(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray | None, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """The shingle of the earliest arrival in each register, texts x registers; 0 for no shingles.

    Rounds take the next arrival of every shingle that can still be earlier than some register; when few
    shingles are left, many arrivals of each at once. Without weights each shingle weighs 1, and one may be
    given repeatedly: its arrivals are the same each time.
    """
    earliest = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    by_text = earliest.reshape(texts, registers)
    time, done = np.zeros(len(shingle)), 0
    latest = np.full(texts, np.inf)
    text, weight = text.astype(np.int64), None if weight is None else weight.astype(np.float64)
    while n := len(shingle):
        if done == SINGLY and weight is None:  # repeated ones that are left go on once
            order = np.lexsort((shingle, text))
            s, x = shingle[order], text[order]
            order = order[np.concatenate(([True], (s[1:] != s[:-1]) | (x[1:] != x[:-1])))]
            text, shingle, time = text[order], shingle[order], time[order]
            n = len(shingle)
        ahead = 1 if done < SINGLY else max(1, min(ARRIVALS // n, 256))
        nth = np.arange(done + 1, done + ahead + 1, dtype=np.uint64)
        bits = mix(shingle + nth[:, None] * _GOLD)  # ahead x n
        step = (bits >> np.uint64(11)).astype(np.float64)
        step += 1
        step *= 2.0**-53
        np.log(step, out=step)
        if weight is not None:
            step /= weight
        np.subtract(time, step[0], out=step[0])
        for k in range(1, ahead):
            np.subtract(step[k - 1], step[k], out=step[k])
        some = np.flatnonzero(step < latest[text])
        of, at, bits = some % n, step.ravel()[some], bits.ravel()[some]
        place = mix(bits ^ _GOLD)
        if registers & (registers - 1):
            place %= np.uint64(registers)
        else:
            place &= np.uint64(registers - 1)
        place = place.view(np.int64)
        place += text[of] * registers
        np.minimum.at(earliest, place, at)
        won = np.flatnonzero(earliest[place] == at)
        winner[place[won]] = shingle[of[won]]
        active = text[np.flatnonzero(np.diff(text, prepend=-1))]
        latest[active] = by_text[active].max(axis=1)
        on = np.flatnonzero(step[-1] < latest[text])
        text, shingle, time, weight = text[on], shingle[on], step[-1][on], None if weight is None else weight[on]
        done += ahead
    return winner.reshape(texts, registers)


def signatures(docs: DataFrame, text: str, doc_id: str, shingle: int = SHINGLE, registers: int = REGISTERS, bands: int = BANDS) -> DataFrame:
    """id, k0 and k1 (hash of the word sequence), bands; texts without words have no bands."""
    per_band = registers // bands
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in steps(batch, "t"):
                    words = Words(part.column(1))
                    s, t = words.shingles(shingle)
                    registers_of = prob_min_hash(t, s, None, words.texts, registers).reshape(words.texts, bands, per_band)
                    band = np.broadcast_to(salt, (words.texts, bands)).copy()
                    for k in range(per_band):
                        band = mix(band * _GOLD + registers_of[:, :, k])
                    some = words.counts > 0
                    ends = np.cumsum(np.where(some, bands, 0))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(band[some].reshape(-1).view(np.int64)))
                    key = words.text_hash().view(np.int64)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(key[:, 0]), pa.array(key[:, 1]), lists], names=["id", "k0", "k1", "bands"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where(F.col("id").isNotNull())
    return rows.mapInArrow(run, T.StructType([T.StructField("id", docs.schema[doc_id].dataType), *(T.StructField(c, T.LongType()) for c in ("k0", "k1")), T.StructField("bands", T.ArrayType(T.LongType()))]))


def _verify(pairs: DataFrame, texts: DataFrame, shingle: int, t: float) -> DataFrame:
    """(a, b, na, nb, both, ok, outside) of pairs (a, b): shingle counts, shared ones, and b's shingles outside a."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # a round of few pairs moves only their texts
        texts = texts.join(F.broadcast(ids), "id", "left_semi")
    # a leader of very many pairs is dealt over blocks; its text goes once to each
    hot = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("a", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("blocks")), F.lit(0)).cast("int").alias("block"))
    leaders = pairs.select("a").distinct().join(hot, "a", "left").select("a", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))
    leaders = leaders.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
    both = dealt.join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b").join(leaders, ["a", "block"]).select("a", "b", "ta", "tb")
    id_type = pairs.schema["a"].dataType
    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), *(T.StructField(c, T.LongType()) for c in ("na", "nb", "both")), T.StructField("ok", T.BooleanType()), T.StructField("outside", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in steps(batch, "tb"):
                    n = part.num_rows
                    ta, tb = part.column(2), part.column(3)
                    # a leader's text is worked on once
                    of = pa.compute.dictionary_encode(part.column(0)).indices.to_numpy().astype(np.int64)
                    lead = np.unique(of, return_index=True)[1]
                    xa, ha, _ = weighted_shingles(Words(ta.take(pa.array(lead))), shingle)
                    xb, hb, _ = weighted_shingles(Words(tb), shingle)
                    na, nb = np.bincount(xa, minlength=len(lead))[of], np.bincount(xb, minlength=n)
                    # the pair's leader is mixed in, so one membership test serves all pairs
                    shared = np.isin(mix(hb + mix(of[xb].astype(np.uint64) * _GOLD)), mix(ha + mix(xa.astype(np.uint64) * _GOLD)))
                    both_ = np.bincount(xb, weights=shared, minlength=n).astype(np.int64)
                    ok = both_ >= t * (na + nb - both_) - 1e-9
                    chosen = ~shared
                    ends = np.concatenate(([0], np.cumsum(np.bincount(xb[chosen], minlength=n))))
                    outside = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hb[chosen].view(np.int64)))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(na), pa.array(nb), pa.array(both_), pa.array(ok), outside], names=["a", "b", "na", "nb", "both", "ok", "outside"])

    return both.mapInArrow(run, schema)


def _next_buckets(checked: DataFrame, bands: DataFrame, t: float) -> tuple[DataFrame, DataFrame] | None:
    """Pairs (a, b), and buckets (bucket, b, ok, nb, both, common), of what may be linked though one failed against their
    common leader; None if nothing failed. bands: bucket and b, of all candidates."""
    room = (1 + t) / t
    cap = F.col("both") * room - F.col("nb") + 1e-9  # the largest size of a partner that has nothing outside the leader
    families = checked.groupBy("a").agg(F.min("ok").alias("all_ok"), F.count(F.lit(1)).alias("n"), F.min("nb").alias("least"), F.max(F.when(~F.col("ok"), cap)).alias("cap")).where("not all_ok and n > 1").drop("all_ok", "n")
    own = stored(checked.join(families, "a"), "families")
    if own.isEmpty():
        return None
    # what may be linked without a shingle outside the leader: of fitting sizes, and together in a band
    sizes = own.where((F.col("both") >= t * F.col("nb")) & ((~F.col("ok") & (cap >= F.col("least"))) | (F.col("nb") <= F.col("cap"))))
    inside = sizes.select("a", "b", "ok", "nb", "both").join(bands.withColumnRenamed("bucket", "band"), "b").select(F.xxhash64("a", "band", F.lit(1)).alias("bucket"), "b", "ok", "nb", "both", F.lit(0).alias("common"))
    counted = inside.groupBy("bucket").agg(F.count(F.lit(1)).alias("all"), F.count(F.when(~F.col("ok"), 1)).alias("n"), F.min("nb").alias("low")).where("all > 1 and n > 0").drop("all")
    # fits: the smallest of the bucket may be a partner
    inside = stored(inside.join(counted, "bucket").where(F.col("nb") + F.col("low") <= F.col("both") * room + 1e-9).drop("low"), "inside")
    small = _paired(inside.where(F.col("n") <= PAIRED), t)
    inside = inside.where(F.col("n") > PAIRED).drop("n")
    # shingles outside the leader that several documents of the family have
    out = own.select("a", "b", F.explode("outside").alias("s"))
    shared = out.groupBy("a", "s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    of = out.join(shared, ["a", "s"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("common"))
    of = own.select("a", "b", "nb", "both", "ok", F.size("outside").alias("n")).join(of, ["a", "b"])
    prefix = F.col("nb") - F.ceil(F.col("nb") * t - 1e-9) + 1 - (F.col("n") - F.size("common"))
    chosen = F.when(F.col("ok"), F.col("common")).otherwise(F.slice("common", F.lit(1), F.greatest(prefix, F.lit(0)).cast("int")))
    in_bucket = of.select(F.explode(chosen).alias("c"), "a", "b", "ok", "nb", F.col("both"), F.size("common").alias("common")).select(F.xxhash64("a", "c.s").alias("bucket"), "b", "ok", "nb", "both", "common").unionByName(inside)
    # x and y have at most both + common shingles in common; with the smallest partner in the bucket that must do
    least = in_bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("ok").alias("all_ok"), F.min("nb").alias("least")).where("n > 1 and not all_ok").select("bucket", "least")
    in_bucket = in_bucket.join(least, "bucket").where((F.col("both") + F.col("common")) * room >= F.col("nb") + F.col("least") - 1e-9).drop("least")
    return small, in_bucket


def _led(in_bucket: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of a bucket's leader, a linked document if it has one, and each other document: that of the
    smallest id, or after turn 0 another one each turn."""
    rank = F.struct("ok", (F.xxhash64("b", F.lit(turn)) if turn else -F.col("b")).alias("r"), F.col("b").alias("m"))
    lead = in_bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("ok").alias("all_ok"), F.max(rank).alias("top")).where("n > 1 and not all_ok").select("bucket", F.col("top.m").alias("a"))
    return in_bucket.join(lead, "bucket").where("a <> b").select("a", "b")


def _paired(in_bucket: DataFrame, t: float) -> DataFrame:
    """All pairs (a, b) of a bucket but those of two linked documents, and those of which sizes, shingles
    shared with the leader and shingles shared with others leave too few in common."""
    x = in_bucket.where("not ok").select("bucket", F.col("b").alias("x"), F.col("nb").alias("nx"), F.col("both").alias("ix"), F.col("common").alias("ox"))
    y = in_bucket.select("bucket", F.col("b").alias("y"), F.col("nb").alias("ny"), F.col("both").alias("iy"), F.col("common").alias("oy"), "ok")
    fit = F.col("nx") + F.col("ny") <= (F.least("ix", "iy") + F.least("ox", "oy")) * ((1 + t) / t) + 1e-9
    return x.join(y, "bucket").where(fit & (F.col("ok") | (F.col("x") < F.col("y"))) & (F.col("x") != F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _dealt(in_bucket: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The buckets to pair at once, the smallest ones, of `most` pairs in all and PAIRED failed documents each; and the others."""
    sized = in_bucket.groupBy("bucket").agg(F.count(F.when(~F.col("ok"), 1)).alias("n"), F.count(F.lit(1)).alias("all"))
    sized = stored(sized.select("bucket", "n", F.expr("length(bin(n * all))").alias("bits"), (F.col("n") * F.col("all")).alias("pairs")), "sized")
    bits, total = 0, 0
    for row in sized.where(F.col("n") <= PAIRED).groupBy("bits").agg(F.sum("pairs").alias("pairs")).orderBy("bits").collect():  # 64 rows at most
        if (total := total + row["pairs"]) > most:
            break
        bits = row["bits"]
    at_once = (F.col("n") <= PAIRED) & (F.col("bits") <= bits)
    few, many = (in_bucket.join(sized.where(c).select("bucket"), "bucket") for c in (at_once, ~at_once))
    return few, None if sized.where(~at_once).isEmpty() else stored(many, "large-buckets")


def _few(in_bucket: DataFrame, texts: DataFrame, shingle: int, t: float) -> DataFrame | None:
    """The links (a, b) within buckets that are few and small, found in one task; None if they are more.

    The bounds on pairs and text are measured first; what exceeds them takes another round instead.
    """
    pairs = in_bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2")).alias("p")).first()["p"] or 0
    if pairs > LOCAL_PAIRS:
        return None
    ids = in_bucket.select(F.col("b").alias("id")).distinct()  # at most two for each pair
    own = stored(texts.join(F.broadcast(ids), "id", "left_semi"), "few-texts")
    if (own.agg(F.sum(F.octet_length("t")).alias("s")).first()["s"] or 0) > LOCAL_BYTES:
        return None

    def run(members: pa.Table, rows: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            x, h, _ = weighted_shingles(Words(rows.column("t")), shingle)
        ends = np.searchsorted(x, np.arange(rows.num_rows + 1))
        of = {i: h[a:b] for i, a, b in zip(rows.column("id").to_pylist(), ends, ends[1:], strict=False)}
        groups: dict[int, list] = {}
        for bucket, i, ok in zip(*(members.column(c).to_pylist() for c in ("bucket", "b", "ok")), strict=True):
            groups.setdefault(bucket, []).append((i, ok))
        found, seen = [], set()
        for group in groups.values():
            group.sort()
            for k, (i, ok) in enumerate(group):
                for j, other in group[:k]:
                    if not (ok and other) and (j, i) not in seen:
                        seen.add((j, i))
                        both = len(np.intersect1d(of[i], of[j], assume_unique=True))
                        if both >= t * (len(of[i]) + len(of[j]) - both) - 1e-9:
                            found.append((j, i))
        return pa.table({"a": pa.array([a for a, _ in found], rows.schema.field("id").type), "b": pa.array([b for _, b in found], rows.schema.field("id").type)})

    one = F.lit(0).alias("one")
    schema = T.StructType([T.StructField("a", own.schema["id"].dataType), T.StructField("b", own.schema["id"].dataType)])
    members = in_bucket.select(one, "bucket", "b", "ok").groupBy("one")
    return stored(members.cogroup(own.select(one, "id", "t").groupBy("one")).applyInArrow(run, schema), "few-links")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY, registers: int = REGISTERS, bands: int = BANDS) -> DataFrame:
    """(doc_id, class_id): a row per id; class_id is the smallest id of its class."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")).where("id IS NOT NULL")
    if not _repeats(rows.select("id")):
        return _classes(rows, None, shingle, similarity, registers, bands).select(F.col("id").alias(doc_id), F.col("class").alias("class_id"))
    # every row is a node, and the rows of an id are linked to the first of them
    rows = numbered(rows, "id", "t", "at")
    found = _classes(rows.select(F.col("at").alias("id"), "t"), rows.select("at", F.col("id").alias("of")), shingle, similarity, registers, bands)
    first = rows.select(F.col("at").alias("class"), F.col("id").alias("class_id"))
    out = rows.select("at", F.col("id").alias("of")).join(found, F.col("at") == F.col("id")).join(first, "class").groupBy("of").agg(F.min("class_id").alias("class_id"))
    return out.select(F.col("of").alias(doc_id), "class_id")


def _classes(docs: DataFrame, same: DataFrame | None, shingle: int, similarity: float, registers: int, bands: int) -> DataFrame:
    """(id, class) of rows id, t of unique ids; rows that `same` (at, of) gives one name are linked."""
    text, doc_id = "t", "id"
    signed = stored(signatures(docs, text, doc_id, shingle, registers, bands), "signatures")
    nodes = stored(signed.where(F.size("bands") > 0).groupBy("k0", "k1").agg(F.min("id").alias("node"), F.first("bands").alias("bands")), "nodes")
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    many = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = stored(rows.join(many, "bucket"), "buckets")
    company = rows.groupBy("node").agg(F.sum("n").alias("company"))
    texts = stored(docs.select("id", "t").join(_sent(stored(company.select(F.col("node").alias("id")), "candidates"), "id"), "id", "left_semi"), "texts")
    rows = rows.join(company, "node").select("bucket", "node", F.struct("company", (-F.col("node")).alias("m")).alias("rank"))
    rows = stored(rows.join(rows.groupBy("bucket").agg(F.max("rank").alias("top")), "bucket").select("bucket", "node", "top"), "led")
    best = rows.groupBy("node").agg((-F.max("top").getField("m")).alias("best"))
    pairs = stored(best.where("best <> node").select(F.col("best").alias("a"), F.col("node").alias("b")), "pairs")
    verified = stored(_verify(pairs, texts, shingle, similarity), "verified")
    head = stored(best.select("node").join(verified.where("ok").select(F.col("b").alias("node"), "a"), "node", "left").select("node", F.coalesce("a", "node").alias("head")), "heads")
    led = rows.select("bucket", "node", (-F.col("top.m")).alias("leader")).join(head.select(F.col("node").alias("leader"), F.col("head").alias("a")), "leader").join(head, "node")
    pairs = led.where("a <> head and a <> node").select("a", F.col("node").alias("b")).distinct().join(verified.select("a", "b"), ["a", "b"], "left_anti")
    checked = verified.unionByName(stored(_verify(stored(pairs, "pairs"), texts, shingle, similarity), "verified"))
    verified = checked.drop("outside")
    links: DataFrame | None = None
    in_bands, turn, candidates = rows.select("bucket", F.col("node").alias("b")), 0, texts.count()
    while (found := _next_buckets(checked, in_bands, similarity)) is not None:
        in_bucket = stored(found[1], "rare-buckets")
        known = verified.select("a", "b")
        unknown = lambda p: p.join(known, ["a", "b"], "left_anti")  # noqa: B023, E731
        links = _few(in_bucket, texts, shingle, similarity)
        alone, many = found[0], None
        if links is None:
            few, many = _dealt(in_bucket, max(EACH * candidates, AT_ONCE))
            alone = alone.union(_paired(few, similarity)).distinct()
        pairs = alone = stored(unknown(alone), "alone")  # pairs that lead no family
        last = many is None
        if many is not None:
            # a leader is verified against all of its bucket, known or not, so that they are one family
            pairs = stored(_led(many, turn).distinct(), "pairs")
            if unknown(pairs).isEmpty():  # the leaders have been through all of this
                for _ in range(TURNS):
                    turn += 1
                    pairs = stored(_led(many, turn).distinct(), "pairs")
                    if last := unknown(pairs).isEmpty():
                        continue
                    break
                if last:
                    pairs = stored(unknown(_paired(many, similarity).union(alone).distinct()), "pairs")
            if not last:
                verified = verified.unionByName(stored(_verify(alone, texts, shingle, similarity), "verified").drop("outside"))
        checked = stored(_verify(pairs, texts, shingle, similarity), "verified")
        verified = verified.unionByName(checked.drop("outside"))
        if last:
            break
    ids = signed.select("id", "k0", "k1")
    member = ids.join(nodes.select("k0", "k1", "node"), ["k0", "k1"], "left") if _wordless(signed) else ids.join(nodes.select("k0", "k1", "node"), ["k0", "k1"])
    member = member.select("id", F.coalesce("node", "id").alias("node"))
    linked = verified.where("ok").select("a", "b")
    if links is not None:
        linked = linked.union(links)
    if same is not None:
        named = same.join(member, F.col("at") == F.col("id")).select("of", "node")
        hub = named.groupBy("of").agg(F.min("node").alias("a"))
        linked = linked.union(named.join(hub, "of").where("a <> node").select("a", F.col("node").alias("b")))
    if linked.isEmpty():
        out = member.select("id", F.col("node").alias("class"))
    else:
        label = components(linked).withColumnRenamed("node", "of")
        out = member.join(label, F.col("node") == F.col("of"), "left").select("id", F.coalesce("component", "node").alias("class"))
    return stored(out, "classes")


def _sent(ids: DataFrame, doc_id: str) -> DataFrame:
    """Stored ids, to be joined with all documents: broadcast if they are few and of bounded size."""
    most = CORPUS_IDS if isinstance(ids.schema[doc_id].dataType, T.IntegralType) else BROADCAST_IDS
    return F.broadcast(ids) if ids.count() <= most else ids


def _repeats(signed: DataFrame) -> bool:
    return not signed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _wordless(signed: DataFrame) -> bool:
    return not signed.where(F.size("bands") == 0).isEmpty()


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: that of its smallest id.

    Rows that share an id, and rows without one, are documents of their own here, in order of text, those
    without an id last: no row goes but for a near copy that stays.
    """
    if _repeats(docs.select(F.col(f"`{doc_id}`").alias("id"))) or not docs.where(F.col(f"`{doc_id}`").isNull()).isEmpty():
        at = clean_name(docs.columns, "at")
        return one_of_each(numbered(docs, doc_id, text, at), text, at, shingle, similarity).drop(at)
    found = classes(docs, text, doc_id, shingle, similarity).where(f"`{doc_id}` <> class_id").select(F.col(f"`{doc_id}`").alias(clean_name(docs.columns, "dropped")))
    found = stored(found, "dropped")
    return docs.join(_sent(found, found.columns[0]), F.col(f"`{doc_id}`") == F.col(found.columns[0]), "left_anti")


#: The classes in DuckDB's SQL for unique ids, from all pairs that share a shingle: for small tables.
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE} + 1, 1) + 1)) AS p FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + {SHINGLE - 1}], ' ') AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common >= {SIMILARITY} * (x.n + y.n - common) - 1e-9),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS class_id FROM d LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""
