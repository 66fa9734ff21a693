"""Substring search that opens only files whose trigrams allow a hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegraph.sources import sinks

GRAM = 3


def grams(text: Column, size: int = GRAM) -> Column:
    """Distinct parts of ``size`` letters of a text in lower case; a null or shorter text has none."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= size, F.sequence(F.lit(1), F.length(low) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.substring(low, k, F.lit(size))))


class TrigramIndex:
    """A table written in the order of ``order`` (texts that are alike in one file) with a posting list of files for each trigram."""

    def __init__(self, rows: DataFrame, column: str, order: list[str], files: int):
        spark, path = rows.sparkSession, sinks.new_path(rows.sparkSession, "trigrams")
        rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(f"{path}/rows")
        self.spark, self.column, self.schema, self.path = spark, column, rows.schema, path
        placed = spark.read.schema(rows.schema).parquet(f"{path}/rows").select(F.col("_metadata.file_path").alias("file"), F.explode(grams(F.col(column))).alias("gram"))
        placed.distinct().repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/postings")
        self.postings = spark.read.schema("file string, gram string").parquet(f"{path}/postings")

    def files(self, needle: str) -> list[str] | None:
        """Files that have all of the needle's trigrams; None (all files) for a needle of fewer letters."""
        low = needle.lower()
        wanted = sorted({low[k : k + GRAM] for k in range(len(low) - GRAM + 1)})
        if not wanted:
            return None
        hits = self.postings.where(F.col("gram").isin(wanted)).groupBy("file").agg(F.count("*").alias("n"))
        return [r["file"] for r in hits.where(F.col("n") == len(wanted)).select("file").collect()]

    def contains(self, needle: str) -> DataFrame:
        """Rows whose text contains ``needle`` in any case; null contains nothing, everything else contains the empty needle."""
        files = self.files(needle)
        if files == []:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*(files or [f"{self.path}/rows"]))
        return rows.where(F.contains(F.lower(F.col(self.column)), F.lit(needle.lower())))
