"""Secret scans with corpus-wide ownership frequency (operator 5), with DataFrame functions alone.

Candidates are the spans of three base kinds and, added by the method, `owned`: runs of 20 or more
token characters with a lower-case letter, an upper-case letter and a digit, that overlap no base
span and whose value is specific to an owner. Every candidate's value is hashed; per hash the
distinct owners and repositories over the whole corpus are counted. A value of at least
EXAMPLE_OWNERS owners and as many repositories is a widely copied example, any other looks live.

Spans are code points, ends exclusive, of whole matches; matches are leftmost and do not overlap
within a kind; matches that are too short are dropped after matching. Places come from the lengths
of the pieces between the matches, summed in blocks of about the square root of their number, so a
text of very many matches stays far from quadratic work.

Null and empty texts have no span. Every input row gives one row, repeated or not; a null owner or
repository counts as one of its own. Input columns keep their names; a clash makes new ones end in
underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_name, stored

# The base patterns, in order of kind.
KINDS = ("assign", "access", "hex", "owned")
PATTERNS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"(AKIA[A-Z0-9]+)",
    "hex": r"([0-9a-f]{16,})",
    "owned": r"([A-Za-z0-9+/_=-]{20,})",
}
#: The same matches for Java: a run begins where no character of its class comes before, so the search
#: tries each run once instead of at each of its characters.
FAST = PATTERNS | {"hex": r"(?<![0-9a-f])([0-9a-f]{16,})", "owned": r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_=-]{20,})"}
VALUE_GROUP = {"assign": 2, "access": 1, "hex": 1, "owned": 1}
LEAST = {"assign": 12, "access": 18, "hex": 16, "owned": 20}
#: What a text with an assignment has.
ASSIGNED = r"""([Ww][Oo][Rr][Dd]|[Ss][Ww][Dd]|[Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Kk][Ee][Yy])["']?\x20*[:=]"""
EXAMPLE_OWNERS = 3
LIVE_TAG, EXAMPLE_TAG = "[SECRET]", "[EXAMPLE]"


def _running(lengths: Column) -> Column:
    """Sums of all but the own and later entries, for each entry."""
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths))).cast("int"))
    add = lambda a, x: a + x
    sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / block).cast("int")), lambda b: F.aggregate(F.slice(lengths, b * block + 1, block), F.lit(0).cast("long"), add))
    return F.transform(
        lengths,
        lambda _, i: F.aggregate(F.slice(sums, F.lit(1), F.floor(i / block).cast("int")), F.lit(0).cast("long"), add) + F.aggregate(F.slice(lengths, F.floor(i / block).cast("int") * block + 1, i % block), F.lit(0).cast("long"), add),
    )


def _with_spans(rows: DataFrame, text: str) -> DataFrame:
    """rows with, per kind, pieces p_, all matches m_, values v_ and starts s_ (all of equal length but p_)."""
    for k in KINDS:
        lit = F.lit(FAST[k])
        rows = rows.withColumns({f"p_{k}": F.split(text, FAST[k]), f"m_{k}": F.regexp_extract_all(text, lit, F.lit(0)), f"v_{k}": F.regexp_extract_all(text, lit, F.lit(VALUE_GROUP[k]))})
        rows = rows.withColumn(f"l_{k}", F.zip_with(F.slice(f"p_{k}", F.lit(1), F.size(f"m_{k}")), f"m_{k}", lambda p, m: (F.length(p) + F.length(m)).cast("long")))
        rows = rows.withColumn(f"r_{k}", _running(F.col(f"l_{k}")))
        rows = rows.withColumn(f"s_{k}", F.zip_with(f"r_{k}", F.slice(f"p_{k}", F.lit(1), F.size(f"r_{k}")), lambda r, p: r + F.length(p))).drop(f"l_{k}", f"r_{k}")
    return rows


def _kept(k: str) -> Column:
    """Structs (start, rank of the kind, end, value, nth match) of the matches that are long enough."""
    of = F.transform(f"m_{k}", lambda m, i: F.struct(F.get(f"s_{k}", i).alias("start"), F.lit(KINDS.index(k)).alias("rank"), (F.get(f"s_{k}", i) + F.length(m)).alias("end"), F.get(f"v_{k}", i).alias("value"), i.alias("nth")))
    if k == "owned":
        return F.filter(of, lambda x: x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[0-9]"))
    return F.filter(of, lambda x: F.length(x["value"]) >= LEAST[k])


def _written(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


class _Names:
    def __init__(self, columns: list[str]):
        self.out = [clean_name(columns, c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example")]


def _hash(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def _flagged(text: str) -> Column:
    """Whether a text may have a candidate; cheap searches come first and spare most texts the others."""
    t = F.col(f"`{text}`")
    assigned = (F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))) & t.rlike(ASSIGNED)
    return F.coalesce(F.contains(t, F.lit("AKIA")) | assigned | t.rlike(FAST["hex"]) | (t.rlike("[0-9]") & t.rlike(FAST["owned"])), F.lit(False))


def _labelled(docs: DataFrame, text: str, owner: str, repository: Column | None, example_owners: int) -> tuple[DataFrame, DataFrame]:
    """Rows with candidates, as struct `row`, with their arrays; and the labels of their spans by row.

    Labels: key, labels (structs start, rank, end, nth, live, hash), sorted. The rows are written first, with
    a key that so stays the same.
    """
    rows = docs.where(_flagged(text)).select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("t"), F.col(f"`{owner}`").cast("string").alias("owner"), (F.col(f"`{owner}`") if repository is None else repository).cast("string").alias("repo"))
    rows = _with_spans(rows, "t")
    base = F.concat(*(_kept(k) for k in KINDS[:3]))
    rows = rows.withColumn("base", F.array_sort(base)).withColumn("own", _kept("owned"))
    # overlaps are looked for among neighbours by start only: base spans of a kind are disjoint
    rows = rows.withColumn("own", F.filter("own", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))
    rows = stored(rows.withColumn("key", F.monotonically_increasing_id()), "secret-rows")
    spans = rows.select("key", "owner", "repo", F.explode(F.concat("base", "own")).alias("x")).select("key", "owner", "repo", "x", _hash(F.col("x.value")).alias("hash"))
    owners = spans.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    repos = spans.groupBy("hash", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("repos"))
    examples = owners.where(F.col("owners") >= example_owners).join(repos.where(F.col("repos") >= example_owners), "hash").select("hash", F.lit(True).alias("example"))
    marked = spans.join(examples, "hash", "left").select("key", F.struct("x.start", "x.rank", "x.end", "x.nth", F.col("example").isNull().alias("live"), "hash").alias("x"))
    marked = marked.where((F.col("x.rank") < 3) | F.col("x.live"))
    return rows, marked.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("labels"))


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repository: Column | None = None, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """docs without the text, with counts and digest of the base spans, all spans, and live and example spans."""
    names = _Names([c for c in docs.columns if c != text]).out
    keep = [c for c in docs.columns if c != text]
    rows, labels = _labelled(docs, text, owner, repository, example_owners)
    labels = labels.withColumnRenamed("key", "of")
    found = rows.select("key", "row", "base").join(labels, F.col("key") == F.col("of"), "left")
    count = lambda r: F.size(F.filter("base", lambda x: x["rank"] == r)).cast("long")
    live = F.coalesce(F.size(F.filter("labels", lambda x: x["live"])), F.lit(0)).cast("long")
    made = [count(0), count(1), count(2), F.sha2(_written(F.col("base")).cast("binary"), 256), F.coalesce(_written(F.col("labels")), F.lit("")), live, F.coalesce(F.size("labels"), F.lit(0)).cast("long") - live]
    some = found.select(*(F.col("row")[c].alias(c) for c in keep), *(c.alias(n) for c, n in zip(made, names, strict=True)))
    zero = F.lit(0).cast("long")
    none = docs.where(~_flagged(text)).select(*(F.col(f"`{c}`") for c in keep), *(c.alias(n) for c, n in zip([zero, zero, zero, F.sha2(F.lit("").cast("binary"), 256), F.lit(""), zero, zero], names, strict=True)))
    return none.unionByName(some)


def _replaced(kind: str):
    def of(m: Column, v: Column) -> Column:
        tag = F.when(F.array_contains(F.col("examples"), _hash(v)), F.lit(EXAMPLE_TAG)).otherwise(F.lit(LIVE_TAG))
        wanted = F.array_contains(F.col("owned"), _hash(v)) if kind == "owned" else F.length(v) >= LEAST[kind]
        return F.when(wanted, F.concat(m.substr(F.lit(1), F.length(m) - F.length(v)), tag)).otherwise(m)

    return of


def redact(docs: DataFrame, text: str = "text", owner: str = "source", repository: Column | None = None, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """docs with the values of all spans replaced: live ones by LIVE_TAG, examples by EXAMPLE_TAG.

    Kinds are replaced one after the other, each in one pass over the matches, on what the kinds
    before it left; a match inside an earlier one is gone with it. Of an assignment the name stays.
    """
    rows, labels = _labelled(docs, text, owner, repository, example_owners)
    # per row: the hashes of its example values, and those of its live `owned` ones
    hashes = labels.select(F.col("key").alias("of"), F.transform(F.filter("labels", lambda x: ~x["live"]), lambda x: x["hash"]).alias("examples"), F.transform(F.filter("labels", lambda x: x["rank"] == 3), lambda x: x["hash"]).alias("owned"))
    none = F.array().cast("array<string>")
    found = rows.select("key", "row", "t").join(hashes, F.col("key") == F.col("of"), "left").select("row", "t", F.coalesce("examples", none).alias("examples"), F.coalesce("owned", none).alias("owned"))
    for k in KINDS:
        found = found.withColumns({"p": F.split("t", FAST[k]), "m": F.regexp_extract_all("t", F.lit(FAST[k]), F.lit(0)), "v": F.regexp_extract_all("t", F.lit(FAST[k]), F.lit(VALUE_GROUP[k]))})
        pieces = F.zip_with("p", F.zip_with("m", "v", _replaced(k)), lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
        found = found.withColumn("t", F.when(F.size("m") > 0, F.array_join(pieces, "")).otherwise(F.col("t"))).drop("p", "m", "v")
    done = found.select(*(F.col("t").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
    return docs.where(~_flagged(text)).unionByName(done)


def _oracle(owner: str, repository: str) -> str:
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, {owner} AS owner, {repository} AS repo, {r} AS rank, regexp_split_to_array(text, {_quoted(k)}) AS p, regexp_extract_all(text, {_quoted(k)}, 0) AS m, regexp_extract_all(text, {_quoted(k)}, {VALUE_GROUP[k]}) AS v FROM documents WHERE text IS NOT NULL"
        for r, k in enumerate(KINDS)
    )
    least = " ".join(f"WHEN {r} THEN {LEAST[k]}" for r, k in enumerate(KINDS))
    names = " ".join(f"WHEN {r} THEN '{k}'" for r, k in enumerate(KINDS))
    return f"""
WITH k AS ({kinds}),
i AS (SELECT doc_id, owner, repo, rank, p, m, v, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0),
s AS (SELECT doc_id, owner, repo, rank, m[i] AS m, v[i] AS v, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a FROM i),
c AS (SELECT doc_id, owner, repo, rank, v, CAST(a AS BIGINT) AS a, CAST(a + length(m) AS BIGINT) AS b FROM s
  WHERE length(v) >= CASE rank {least} END AND (rank < 3 OR (regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')))),
f AS (SELECT * FROM c WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM c AS o WHERE o.doc_id = c.doc_id AND o.rank < 3 AND o.a < c.b AND c.a < o.b)),
e AS (SELECT v, count(DISTINCT coalesce('=' || owner, '')) >= {EXAMPLE_OWNERS} AND count(DISTINCT coalesce('=' || repo, '')) >= {EXAMPLE_OWNERS} AS example FROM f GROUP BY v),
l AS (SELECT f.*, e.example, CASE rank {names} END || ':' || a || ':' || b AS span FROM f JOIN e USING (v) WHERE rank < 3 OR NOT e.example),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY a, rank) FILTER (rank < 3), '')) AS base_sha256, string_agg(span, ',' ORDER BY a, rank) AS spans,
  count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_example FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents d LEFT JOIN g USING (doc_id)
"""


def _quoted(kind: str) -> str:
    return "'" + PATTERNS[kind].replace("'", "''") + "'"


#: The same in DuckDB's SQL, for the columns of the documents table.
ORACLE_SQL = _oracle("source", "source || '/' || lang")
