"""Deep pages from a written order: page n opens the files that hold it instead of sorting all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakegraph.sources import sinks


class WrittenOrder:
    """Rows in the total order of ``order`` (the last column tells all rows apart), in files with their first position and last key.

    The order is made once by ranges; the index has one row for each file.
    """

    def __init__(self, rows: DataFrame, order: list[Column], key: str, files: int):
        """``key`` is the column of ``order``'s last part; ``files`` is about how many files there will be."""
        spark, path = rows.sparkSession, sinks.new_path(rows.sparkSession, "pages")
        laid = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
        laid.write.parquet(f"{path}/rows")
        self.spark, self.schema, self.key = spark, laid.schema, key
        found = spark.read.schema(laid.schema).parquet(f"{path}/rows").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.min("_at").alias("first"))
        before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
        self.index = sinks.stored(found.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "page-index")

    def total(self) -> int:
        return self.index.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]

    def files(self, offset: int, limit: int) -> list[tuple[str, int, int]]:
        """File, its first ``_at`` and its first position, of the files that the page is in; as many as the page needs come to the driver."""
        hit = self.index.where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset))
        return [(r["file"], r["first"], r["start"]) for r in hit.orderBy("start").collect()]

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` with their ``position``, in order."""
        parts = []
        for file, first, start in self.files(max(0, offset), max(0, limit)):
            rows = self.spark.read.schema(self.schema).parquet(file).withColumn("position", F.col("_at") - first + start)
            parts.append(rows.where((F.col("position") >= offset) & (F.col("position") < offset + limit)))
        out = parts[0] if parts else self.spark.createDataFrame([], self.schema).withColumn("position", F.lit(0).cast("long"))
        for more in parts[1:]:
            out = out.unionByName(more)
        return out.drop("_at").orderBy("position")

    def after(self, last: object, limit: int) -> DataFrame:
        """The page that follows the row whose ``key`` is ``last`` (keyset continuation), whatever its position was; none if there is no such row."""
        all_rows = self.spark.read.schema(self.schema).parquet(*[r["file"] for r in self.index.select("file").collect()])
        row = all_rows.where(F.col(self.key) == F.lit(last)).select("_at").head()
        if row is None:
            return self.page(0, 0)
        at = self.index.where(F.col("first") <= row["_at"]).orderBy(F.desc("first")).head()
        return self.page(at["start"] + row["_at"] - at["first"] + 1, limit)
