"""Reading the driver's tables and mapping them onto the canonical schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def version_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a version log: key user_id, seqno event_id, an error event is a tombstone."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seqno"), (F.col("event_type") == "error").alias("tombstone"), F.col("value").alias("data"), epoch_seconds("ts").alias("create_time"))


def expiring_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version log with an expiry: none for every fourth event, else creation plus value minutes."""
    log = version_log(spark, sf_dir)
    return log.withColumn("expiry_time", F.when(F.col("seqno") % 4 == 0, F.lit(0)).otherwise(F.col("create_time") + F.floor(F.col("data")) * 60).cast("long"))


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as log records turn_conv_role; some conversations get a TRIM and a DELETE at their end."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    place = F.col("conv_id") * 1000
    writes = c.select((place + F.col("turn")).alias("ord"), F.lit("WRITE").alias("kind"), F.concat_ws("_", F.format_string("%03d", "turn"), F.col("conv_id").cast("string"), "role").alias("key"), F.col("text").alias("data"))
    trims = c.where("conv_id % 5 = 0 AND turn = 0").select((place + 900).alias("ord"), F.lit("TRIM").alias("kind"), F.concat(F.lit("1_"), F.col("conv_id").cast("string")).alias("key"), F.lit(None).cast("string").alias("data"))
    deletes = c.where("conv_id % 7 = 0 AND turn = 2").select((place + 901).alias("ord"), F.lit("DELETE").alias("kind"), F.concat_ws("_", F.lit("2"), F.col("conv_id").cast("string"), "role").alias("key"), F.lit(None).cast("string").alias("data"))
    return writes.unionByName(trims).unionByName(deletes)


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as accesses: client user_id, key from the properties, UPDATE for purchases and signups."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", epoch_seconds("ts").alias("ts"), F.col("user_id").alias("client"), F.coalesce(F.get_json_object("props", "$.k"), F.col("event_type")).alias("key"), F.when(F.col("event_type").isin("purchase", "signup"), "UPDATE").otherwise("GET").alias("op"))
