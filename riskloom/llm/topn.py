"""The N highest-scoring items of every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

try:  # Spark's own bounded heap as an aggregate; not a public name, so it may be gone in another version
    from pyspark.sql.internal import InternalFunction

    _heap = InternalFunction.collect_top_k
except (ImportError, AttributeError):
    _heap = None


def heaps(slim: DataFrame, n: int, heap=_heap) -> DataFrame:
    """``g, top``: the ``n`` smallest ``e`` of each ``g``, bounded before the shuffle.

    By Spark's heap aggregate; where it is missing, by a ranking window, which keeps the first ``n`` rows of a group
    in each task before the shuffle as well.
    """
    if heap is not None:
        return slim.groupBy("g").agg(heap(F.col("e"), n, True).alias("top"))
    ranked = slim.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("e"))).where(F.col("r") <= n)
    return ranked.groupBy("g").agg(F.collect_list("e").alias("top"))

def top_n(df: DataFrame, group: str, score: str, ident: str, n: int, keep: Sequence[str] = ()) -> DataFrame:
    """``group, ident, score, *keep, rank`` (int from 1): the best ``n`` per group, ties by ``ident`` ascending.

    A mergeable aggregate holds one bounded heap of ``n`` entries per group: filled before the shuffle, merged
    after it. What is shuffled is at most ``n`` entries per group and task, however large a group is. Rows with
    a null group or identifier or a null or NaN score take no part; groups left without rows don't come out.
    Rows repeated as a whole come out repeatedly: deduplicate first where that isn't meant. The columns ``keep``
    travel with the entry (and break what score and identifier leave equal); others are not read.
    """
    value = F.col(score).cast("double")
    rows = df.where(F.col(group).isNotNull() & F.col(ident).isNotNull() & value.isNotNull() & ~F.isnan(value))
    # the heap keeps the smallest: negated score first (0 - x keeps -0.0 equal to 0.0), then the identifier
    entry = F.struct((F.lit(0.0) - value).alias("down"), F.col(ident).alias("id"), F.col(score).alias("score"), *[F.col(c).alias(f"x_{c}") for c in keep])
    slim = rows.select(F.col(group).alias("g"), entry.alias("e"))
    flat = heaps(slim, n).select("g", F.posexplode(F.array_sort("top")).alias("at", "e"))
    return flat.select(
        F.col("g").alias(group), F.col("e.id").alias(ident), F.col("e.score").alias(score), *[F.col("e")[f"x_{c}"].alias(c) for c in keep], (F.col("at") + 1).cast("int").alias("rank")
    )
