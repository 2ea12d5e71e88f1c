"""Helpers shared by the corpus operators: tables, shared storage, Arrow batches."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Characters of text that a Python worker holds in one step.
STEP_CHARS = 2_000_000
#: Partitions from which a scan is never dealt anew.
SMALL_SPLITS = 64


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python can import it
    wherever it was started. Operators call it before they make a plan with Python in it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parent.parent
    zipped = Path(tempfile.mkdtemp(prefix="keystrata-ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(zipped, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(zipped))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, so a small one, dealt over all cores.

    Parquet splits by row group, and a small table may be a single one. Scans of SMALL_SPLITS and more,
    several gigabytes, stay as they are on any cluster.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < min(cores, SMALL_SPLITS) else scan


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage.

    Every executor and the driver see the files, so a lost executor costs a reread, and a later
    reader gets the same rows in whatever order tasks are retried.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keystrata/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, doc_id: str, text: str, out: str) -> DataFrame:
    """docs with a unique number that orders them by id (nulls last), the first 64 characters of the text, and a hash of it.

    Keys of bounded size cut the ranges, and the last of them is unique, so no id or text makes a large
    range. The result is stored, so that every reader sees the same numbers.
    """
    spark, names = docs.sparkSession, []
    for n in ("head", "of", "salt"):
        names.append(clean_name([*docs.columns, out, *names], n))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.withColumns(dict(zip(names, (F.substring(t, 1, 64), F.xxhash64(t), F.monotonically_increasing_id()), strict=True)))
    order = [F.col(f"`{doc_id}`").asc_nulls_last(), *names]
    ranged = keyed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).drop(*names)
    return stored(ranged.withColumn(out, F.monotonically_increasing_id()), "numbered")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def power_of_two(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(n, 1))))


def steps(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about STEP_CHARS of text each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(text))
    sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > STEP_CHARS:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    yield batch.slice(begin)


def clean_name(columns: list[str], wanted: str) -> str:
    """wanted, or wanted with underscores until no column has that name (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1
