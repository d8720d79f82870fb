"""Global numbering and chunking without gathering all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "n") -> DataFrame:
    """``df`` with a dense number from 1 in a total order.

    A window without partitions would sort everything in one task. Instead the rows are range-partitioned by the
    order, numbered inside each partition, and shifted by the sizes of the partitions before: only those sizes
    (one row per partition) meet in one place. The order must be unique to be repeatable.
    """
    parts = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    parts = materialise(parts, "ordered")  # the partition number of a row must not change between the two uses
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = sizes.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return parts.withColumn("__r", inside).join(F.broadcast(before), "__p").withColumn(name, F.col("__r") + F.col("__before")).drop("__p", "__r", "__before")


def chunked(df: DataFrame, order: Sequence[str | Column], size: int, name: str = "chunk") -> DataFrame:
    """``df`` with the number (from 0) of its chunk of ``size`` rows in the given order."""
    return numbered(df, order, "__n").withColumn(name, F.floor((F.col("__n") - 1) / size)).drop("__n")
