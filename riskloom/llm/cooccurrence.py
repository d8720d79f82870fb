"""Items that appear together: pair counts, lift and pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .subsequences import least_count

FEW_ITEMS = 4_096  # up to so many frequent items are sent to the tasks as a set, more come by a join


def _frequent_only(sets: DataFrame, frequent: DataFrame) -> DataFrame:
    """The records with their frequent items only, in order: ``items``.

    The frequent items are at most the mean record's length over ``share``. A few are a constant hash set of the
    plan (no shuffle); more come by an equi-join, and each record's own items are put together again.
    """
    if frequent.count() <= FEW_ITEMS:
        keep = [r[0] for r in frequent.collect()]
        return sets.select(F.array_sort(F.filter("items", lambda x: x.isin(keep))).alias("items"))
    rows = sets.select("k", F.explode("items").alias("item")).join(frequent, "item", "left_semi")
    return rows.groupBy("k").agg(F.array_sort(F.collect_list("item")).alias("items")).select("items")


def item_pairs(baskets: DataFrame, basket: str, items: str, share: float = 0.0, floor: int = 1) -> DataFrame:
    """``a, b, n_ab, n_a, n_b, n, lift, pmi`` for each pair ``a < b`` of items found together often enough.

    One row of ``baskets`` is one record with its list ``items``; an item counts once per record, null items
    don't count, a null or empty list is a record without items and counts in ``n``. ``basket`` must be unique;
    records with a null ``basket`` are left out. A pair is kept from ``share`` of all records and ``floor``
    records on. ``lift`` = n_ab * n / (n_a * n_b), ``pmi`` its natural logarithm. No records, no pairs.

    An item rarer than the pair limit is in no kept pair, so such items leave the records before any pair is
    made: exact, and what keeps long records from making all their pairs. Each record makes its own pairs, row by
    row, without a join. Pair counts are combined map-side; the item counts come back in by equi-joins Spark
    sizes itself. Counts are multiplied as doubles, so billions of records don't overflow.
    """
    sets = baskets.where(F.col(basket).isNotNull()).select(F.col(basket).alias("k"), F.array_distinct(F.array_compact(items)).alias("items"))
    sets = materialise(sets, "baskets")
    n = sets.count()
    least = least_count(share, n, floor)
    singles = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).where(F.col("n_item") >= least)
    singles = materialise(singles, "items")
    left = _frequent_only(sets, singles.select("item"))
    firsts = left.where(F.size("items") > 1).select("items", F.posexplode("items").alias("at", "a"))
    pairs = firsts.select("a", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("b"))
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab")).where(F.col("n_ab") >= least)
    out = counted.join(singles.select(F.col("item").alias("a"), F.col("n_item").alias("n_a")), "a")
    out = out.join(singles.select(F.col("item").alias("b"), F.col("n_item").alias("n_b")), "b")
    lift = F.col("n_ab") * F.lit(float(n)) / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.select("a", "b", "n_ab", "n_a", "n_b", F.lit(n).cast("bigint").alias("n"), lift.alias("lift"), F.log(lift).alias("pmi"))
