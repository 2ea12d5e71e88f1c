"""Benchmark decontamination by spaced-seed hashing (operator 10), with DataFrame functions alone.

Words are the lower-cased runs of letters and digits. At every place of a document and of a
benchmark item masks take some words and ignore those between; equal hashes of the taken words are
hits. A hit lines the document up with the whole item, and an overlap is verified on that line by
comparing words: some stretch of 16 words (or the item, if shorter) around the hit must have at
least 80 % equal words in place. So a passage is found though every few words are replaced.

No overlap that verification accepts is without a hit. It lets 3 words be replaced from 15 words on,
2 from 10 and 1 from 5; so of five blocks of 3, 2 or 1 words in a row, 2, 3 or 4 blocks are whole
wherever the replaced words are, and there is a mask for each such choice of blocks.

Items under 5 words can't be told from common phrases and match nothing. Null and empty texts have
no words and no rows. Rows with the same ids count together, rows without an id as well. Other columns
of the input are not read by `overlaps` and kept by `clean`, whatever their names; empty tables give no
overlaps.

Documents are never shuffled: an item's seeds, and its words once, are broadcast. A benchmark whose seeds and
words take more than BROADCAST_BYTES, measured first, is cut into blocks of items below that, and
documents are read once a block. Only verified hits are shuffled, after a partial aggregation.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_name

SEPARATOR = r"[^\p{L}\p{N}]+"
# The places each seed of the SQL takes.
MASKS = ("111010011011", "110110100111")
SPAN = 12
SHORTEST, STRETCH, EQUAL = 5, 16, 0.8
BROADCAST_BYTES = 64 << 20
BLOCKS = 5


def _masks(width: int, whole: int) -> tuple[str, ...]:
    """A mask for each choice of whole blocks of so many places; those that differ by a shift are one."""
    return tuple(sorted({"".join("01"[b in chosen] * width for b in range(BLOCKS)).strip("0") for chosen in combinations(range(BLOCKS), whole)}))


#: The masks of items of so many words, up to the next number.
SEEDS = {5: _masks(1, 4), 10: _masks(2, 3), 15: _masks(3, 2)}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATOR), "")


def _places(mask: str) -> list[int]:
    return [k for k, c in enumerate(mask) if c == "1"]


def _seed(of: Column, at: Column, mask: str, number: int) -> Column:
    return F.xxhash64(F.lit(number), *(F.get(of, at + k) for k in _places(mask)))


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, n_item_words, n_equal, doc_start): documents and items that overlap.

    Of several lines of one document and item the one with most equal words counts, then the first.
    Rows with the same ids count together. doc_start is the document's word beside the item's first.
    """
    items = benchmark.select(F.col(f"`{item_id}`").alias("item"), words(F.col(f"`{item_text}`")).alias("iw")).where(F.size("iw") >= SHORTEST).distinct()
    kind = F.when(F.size("iw") < 10, 5).when(F.size("iw") < 15, 10).otherwise(15)
    n_masks = F.coalesce(*(F.when(kind == k, F.lit(len(m))) for k, m in SEEDS.items()))
    # a seed row takes some 64 bytes, a word its letters and 24 more
    size = F.size("iw") * (64 * n_masks + 24) + F.octet_length(F.array_join("iw", ""))
    facts = items.agg(F.collect_set(kind).alias("kinds"), F.sum(size.cast("double")).alias("size")).first()
    found = docs.select(F.col(f"`{doc_id}`").alias("doc"), words(F.col(f"`{text}`")).alias("w"))
    blocks = max(1, math.ceil((facts["size"] or 0) / BROADCAST_BYTES))
    kinds = sorted(facts["kinds"]) or [15]  # of an empty benchmark any
    # two numbers tell an item's rows apart: the same id may have several texts
    named = items.withColumns({"key": F.xxhash64("item", "iw"), "more": F.hash("iw", "item")})
    parts = []
    for b in range(blocks):
        own = named if blocks == 1 else named.where(F.pmod(F.xxhash64("iw"), F.lit(blocks)) == b)
        parts.append(_good(found, own, kinds, kind))
    good = parts[0]
    for p in parts[1:]:
        good = good.unionByName(p)
    best = good.groupBy("doc", "item").agg(F.max(F.struct("equal", (-F.col("line")).alias("m"), "n")).alias("best"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.col("best.n").cast("long").alias("n_item_words"), F.col("best.equal").cast("long").alias("n_equal"), (-F.col("best.m")).cast("long").alias("doc_start"))


def _good(found: DataFrame, items: DataFrame, kinds: list[int], kind: Column) -> DataFrame:
    """(doc, item, n, equal, line) of verified hits of documents (doc, w) with items that may be broadcast."""
    seeds_of = [(m, n, kind == k) for k in kinds for n, m in enumerate(SEEDS[k], 100 * k)]
    parts = [items.where(which).select("key", "more", "iw", F.explode(F.sequence(F.lit(0), F.size("iw") - len(m))).alias("q")).select("key", "more", "q", F.lit(len(m)).alias("span"), _seed(F.col("iw"), F.col("q"), m, n).alias("seed")) for m, n, which in seeds_of]
    seeds = parts[0]
    for p in parts[1:]:
        seeds = seeds.unionByName(p)
    least = min(len(m) for m, _, _ in seeds_of)
    at = found.where(F.size("w") >= least).select("doc", "w", F.explode(F.sequence(F.lit(0), F.size("w") - least)).alias("p"))
    # a place too near the end for a mask has nulls there, which no item's seed has
    hashes = F.array(*(F.when(F.col("p") + len(m) <= F.size("w"), _seed(F.col("w"), F.col("p"), m, n)) for m, n, _ in seeds_of))
    hits = at.select("doc", "w", "p", F.explode(hashes).alias("seed")).where("seed is not null").join(F.broadcast(seeds), "seed").join(F.broadcast(items), ["key", "more"])
    # A hit takes along the words beside the item only. Generated code holds all hits of one document
    # at once, so they must be small; explode keeps the slice below the lambda functions, which would
    # otherwise end the generated code and have it hand on the document's whole array with each hit.
    line = F.col("p") - F.col("q")
    lead = F.greatest(-F.col("line"), F.lit(0))
    own = F.slice("w", F.greatest(line, F.lit(0)) + 1, F.size("iw") - F.greatest(-line, F.lit(0)))
    hits = hits.select("doc", "item", "q", "span", "iw", line.alias("line"), F.explode(F.array(own)).alias("own"))
    # places outside the document are null there
    beside = F.transform(F.col("iw"), lambda x, k: F.coalesce(F.get(F.col("own"), k - lead) == x, F.lit(False)))
    hits = hits.select("doc", "item", "q", "span", "line", F.size("iw").alias("n"), beside.alias("same"))
    long = F.least(F.lit(STRETCH), F.col("n"))
    first = F.greatest(F.lit(0), F.least(F.col("q") + F.col("span") - long, F.col("n") - long))
    last = F.least(F.col("q"), F.col("n") - long)
    enough = F.exists(F.sequence(first, F.greatest(first, last)), lambda s: F.size(F.filter(F.slice(F.col("same"), s + 1, long), lambda x: x)) >= long * EQUAL)
    n_equal = F.size(F.filter("same", lambda x: x))
    return hits.where(enough).select("doc", "item", "n", n_equal.alias("equal"), "line")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the documents that overlap an item: all rows of such an id, and of rows without an id
    those whose own text overlaps."""
    names = [clean_name(docs.columns, "overlapping_id")]
    names += [clean_name([*docs.columns, *names], "overlapping_text")]
    # the text of a row without an id stands for it
    key = F.struct(F.col(f"`{doc_id}`").alias("id"), F.when(F.col(f"`{doc_id}`").isNull(), F.sha2(F.col(f"`{text}`").cast("binary"), 256)).alias("text"))
    bad = overlaps(docs.select(key.alias("key"), F.col(f"`{text}`").alias("text")), benchmark, "text", "key").select(F.col("key.id").alias(names[0]), F.col("key.text").alias(names[1])).distinct()
    known, nameless = bad.where(F.col(names[0]).isNotNull()).select(names[0]), bad.where(F.col(names[0]).isNull()).select(names[1])
    kept = docs.join(known, F.col(f"`{doc_id}`") == F.col(names[0]), "left_anti")
    return kept.join(nameless, F.when(F.col(f"`{doc_id}`").isNull(), F.sha2(F.col(f"`{text}`").cast("binary"), 256)) == F.col(names[1]), "left_anti")


_SEED_SQL = [(m, _places(m)) for m in MASKS]

#: The same in DuckDB's SQL; seeds are compared as strings of words.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{SEPARATOR}'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '{SEPARATOR}'), lambda x: x <> '') AS iw FROM benchmark WHERE text IS NOT NULL),
dp AS (SELECT doc_id, w, unnest(range(0, len(w) - {SHORTEST} + 1)) AS p FROM d WHERE len(w) >= {SHORTEST}),
bp AS (SELECT item_id, iw, unnest(range(0, len(iw) - least(len(iw), {SPAN}) + 1)) AS q FROM b WHERE len(iw) >= {SHORTEST}),
ds AS ({" UNION ALL ".join(f"SELECT doc_id, w, p, '{n}:' || concat_ws(' ', {', '.join(f'w[p + {k + 1}]' for k in places)}) AS seed FROM dp WHERE p + {SPAN} <= len(w)" for n, (_, places) in enumerate(_SEED_SQL))}
  UNION ALL SELECT doc_id, w, p, 'all:' || array_to_string(w[p + 1 : p + s], ' ') AS seed FROM dp, (SELECT DISTINCT len(iw) AS s FROM b WHERE len(iw) >= {SHORTEST} AND len(iw) < {SPAN}) WHERE p + s <= len(w)),
bs AS ({" UNION ALL ".join(f"SELECT item_id, iw, q, {SPAN} AS span, '{n}:' || concat_ws(' ', {', '.join(f'iw[q + {k + 1}]' for k in places)}) AS seed FROM bp WHERE len(iw) >= {SPAN}" for n, (_, places) in enumerate(_SEED_SQL))}
  UNION ALL SELECT item_id, iw, 0 AS q, len(iw) AS span, 'all:' || array_to_string(iw, ' ') AS seed FROM b WHERE len(iw) >= {SHORTEST} AND len(iw) < {SPAN}),
h AS (SELECT DISTINCT doc_id, item_id, w, iw, q, span, p - q AS line FROM ds JOIN bs USING (seed)),
m AS (SELECT doc_id, item_id, q, span, line, len(iw) AS n, least({STRETCH}, len(iw)) AS long,
  list_transform(range(0, len(iw)), lambda k: CASE WHEN k + line >= 0 AND k + line < len(w) AND w[k + line + 1] = iw[k + 1] THEN 1 ELSE 0 END) AS same FROM h),
r AS (SELECT *, greatest(0, least(q + span - long, n - long)) AS lo, least(q, n - long) AS hi FROM m),
g AS (SELECT doc_id, item_id, n, line, list_sum(same) AS equal FROM r
  WHERE len(list_filter(range(lo, greatest(lo, hi) + 1), lambda s: list_sum(same[s + 1 : s + long]) >= long * {EQUAL})) > 0)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item_words, CAST(equal AS BIGINT) AS n_equal, CAST(line AS BIGINT) AS doc_start
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY equal DESC, line, n DESC) AS rk FROM g) WHERE rk = 1
"""
