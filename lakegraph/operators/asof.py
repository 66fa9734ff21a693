"""As-of joins for many probes: one order over all rows, cut by ranges, with the last value carried over the cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakegraph.sources.sinks import stored as written


def as_of_many(probes: DataFrame, facts: DataFrame, value: list[str], key: str = "key", at: str = "at", tie: str = "id") -> DataFrame:
    """All rows of ``probes`` with ``value`` of the newest fact of their ``key`` at or before their ``at``; nulls where there is none.

    Facts of the same time are ordered by ``tie``, the greatest counts. Both sides are sorted together by ranges of (key,
    time), so that one key may have any share of the rows. A range carries the last fact forward by itself; what reaches
    over its end is one row for each key and range, and goes to the next ranges that the key is in. Probes without key
    or time have no fact; facts without key or time are of no use. Columns of the probes stay, repeated rows too.
    """
    fact = F.struct(*[F.col(f"`{v}`").alias(v) for v in value])
    f = facts.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), fact.alias("_fact"), F.lit(None).cast(probes.select(F.struct("*").alias("x")).schema["x"].dataType).alias("_probe"))
    p = probes.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(f.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(f.schema["_fact"].dataType).alias("_fact"), F.struct("*").alias("_probe"))
    dated = p.where(F.col("_key").isNotNull() & F.col("_at").isNotNull())
    order = ["_key", "_at", "_side", "_tie"]
    laid = f.unionByName(dated).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    laid = written(laid, "as-of")
    here = Window.partitionBy("_key", "_range").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = laid.withColumn("_own", F.last("_fact", ignorenulls=True).over(here)).where("_side = 1")
    newest = F.max_by("_fact", F.struct("_at", "_tie"))
    ends = laid.groupBy("_key", "_range").agg(newest.alias("_end"))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_key", "_range", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    found = carried.join(ends, ["_key", "_range"]).select("_probe", F.coalesce("_own", "_before").alias("_fact"))
    lost = p.where(F.col("_key").isNull() | F.col("_at").isNull()).select("_probe", "_fact")
    return found.unionByName(lost).select("_probe.*", *[F.col(f"_fact.`{v}`").alias(v) for v in value])
