"""Distinct counts over any range of days from small sketches that are kept by day."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^LG_K registers a sketch.
LG_K = 14


def error_bound(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """Relative error of a merged sketch's count that ``deviations`` standard errors allow (1.04 over the root of the registers)."""
    return deviations * 1.04 / math.sqrt(1 << lg_k)


def daily(rows: DataFrame, at: str, what: str, groups: list[str], lg_k: int = LG_K) -> DataFrame:
    """``day``, the groups and a ``sketch`` of the distinct non-null values of ``what``; a group without a value has no sketch."""
    kept = rows.where(F.col(what).isNotNull() & F.col(at).isNotNull())
    return kept.groupBy(F.to_date(at).alias("day"), *groups).agg(F.hll_sketch_agg(F.col(what), lg_k).alias("sketch"))


def distinct_between(sketches: DataFrame, groups: list[str], first: str, last: str) -> DataFrame:
    """The groups and ``n``: about how many distinct values the days ``first`` to ``last`` have, by merging their sketches."""
    days = sketches.where((F.col("day") >= F.lit(first).cast("date")) & (F.col("day") <= F.lit(last).cast("date")))
    return days.groupBy(*groups).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
