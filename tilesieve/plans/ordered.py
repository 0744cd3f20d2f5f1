"""Running sums and extrema over one total order, without one task doing it.

An unpartitioned window gathers all rows in one task. Here rows are dealt into
buckets by ranges of the order, written down (so that the deal is fixed), and
each window runs within a bucket; what the buckets before (or behind) add is one
row a bucket, which the driver accumulates and broadcasts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilesieve.plans.shared import materialize

_combine: dict[str, tuple[Callable, float]] = {"sum": (lambda a, b: a + b, 0.0), "max": (max, -math.inf), "min": (min, math.inf)}


class Ordered:
    """A frame in the order of some columns, which must be unique together."""

    def __init__(self, df: DataFrame, *order: str, buckets: int | None = None):
        n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.order = list(order)
        self.df = materialize(df.repartitionByRange(n, *order).withColumn("bucket", F.spark_partition_id()), "ordered")

    def running(self, how: str, value: str | Column, name: str, backwards: bool = False) -> Ordered:
        """Adds ``name``: the sum, max or min of ``value`` over this row and all before it
        (or, backwards, behind it). Nulls are skipped."""
        join, none = _combine[how]
        agg = getattr(F, how)
        value = F.col(value) if isinstance(value, str) else value
        before, so_far = [], none
        for row in sorted(self.df.groupBy("bucket").agg(agg(value).cast("double").alias("v")).collect(), reverse=backwards):
            before.append((row.bucket, float(so_far)))
            so_far = so_far if row.v is None else join(so_far, row.v)
        rows = Window.partitionBy("bucket").orderBy(*(F.col(c).desc() if backwards else F.col(c).asc() for c in self.order)).rowsBetween(Window.unboundedPreceding, 0)
        offsets = F.broadcast(self.df.sparkSession.createDataFrame(before, "bucket int, before_ double"))
        local = agg(value).over(rows).cast("double")
        both = {"sum": F.coalesce(local, F.lit(0.0)) + F.col("before_"), "max": F.greatest(local, "before_"), "min": F.least(local, "before_")}[how]
        out = object.__new__(Ordered)
        out.order = self.order
        out.df = self.df.join(offsets, "bucket").withColumn(name, both).drop("before_")
        return out

    def rank(self, name: str = "rank") -> Ordered:
        return self.running("sum", F.lit(1), name)

    def with_column(self, name: str, value: Column) -> Ordered:
        out = object.__new__(Ordered)
        out.order, out.df = self.order, self.df.withColumn(name, value)
        return out

    def result(self) -> DataFrame:
        return self.df.drop("bucket")
