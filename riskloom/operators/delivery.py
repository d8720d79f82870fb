"""Repeated deliveries: one row per key, the latest delivery counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_delivery(df: DataFrame, key: str, arrived: str, columns: dict[str, Column | str]) -> DataFrame:
    """One row per ``key`` with ``columns`` of the delivery whose ``arrived`` is the latest.

    Only the key and the named columns are shuffled, once, and by the key itself: the aggregate that follows
    finds its distribution and needs no second exchange. Ties on ``arrived`` are broken by the content (the
    greatest wins), so the result does not depend on row order. A null ``arrived`` loses to any other.
    Rows with a null key cannot be told from one another and are left out. An empty input gives no rows.
    """
    values = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    slim = df.select(F.col(key).alias("__k"), F.struct(F.col(arrived).alias("__at"), *values).alias("__v"))
    best = slim.where("__k IS NOT NULL").repartition("__k").groupBy("__k").agg(F.max("__v").alias("__v"))
    return best.select(F.col("__k").alias(key), *[F.col("__v")[n].alias(n) for n in columns])
