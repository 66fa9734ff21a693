"""Sinks: upserts, inserts, archives, CSV files and stream tables, written to the shared folder and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-sinks-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/sinks/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of both by key: the new side wins, within a side the greatest ``order``."""
    cols = [c for c in old.columns if c != key]
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("_side", *order)).alias("_r")).select(key, "_r.*")


def insert_ignore(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The table and the new rows whose key it doesn't have, the least ``order`` of each key."""
    cols = [c for c in old.columns if c != key]
    fresh = new.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_r")).select(key, "_r.*")
    return old.unionByName(fresh.join(old.select(key), key, "left_anti").select(*old.columns))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header, every field quoted, quotes doubled, null as an empty field, and a byte-order mark at the head's start."""
    named = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(("﻿" if n == 0 else "") + c) for n, c in enumerate(df.columns)])
    named.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def csv_round_trip(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    write_csv(df, path)
    read = df.sparkSession.read.option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\0").option("emptyValue", "").csv(path)
    return read.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in zip(read.columns, df.columns, strict=True)])


def split(df: DataFrame, old: Column, at: str) -> tuple[DataFrame, DataFrame]:
    """Rows that stay and rows that move to an archive with a folder for each month; both are written."""
    stay = stored(df.where(~F.coalesce(old, F.lit(False))), "kept")
    path = new_path(df.sparkSession, "archive")
    df.where(old).withColumn("month", F.date_format(at, "yyyy-MM")).write.partitionBy("month").parquet(path)
    schema = df.withColumn("month", F.lit("")).schema
    return stay, df.sparkSession.read.schema(schema).parquet(path)


def streamed(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there, into a table, and reads the table."""
    spark, path = stream.sparkSession, new_path(stream.sparkSession, "stream")
    run = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
