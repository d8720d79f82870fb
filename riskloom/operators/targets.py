"""High-value targets, distances to them and entry points."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..session import materialise

FAR = 99


def is_target() -> Column:
    """Sure targets by type from criticality 4, likely ones from criticality 5."""
    sure = F.col("type").isin(*fixed.TARGETS_SURE.split()) & (F.col("criticality") >= 4)
    return sure | (F.col("type").isin(*fixed.TARGETS_LIKELY.split()) & (F.col("criticality") == 5))


def target_tier() -> Column:
    """1: sure targets' types from criticality 4; 2: types that may be targets from criticality 4; else null."""
    high = F.col("criticality") >= 4
    return F.when(high & F.col("type").isin(*fixed.TARGETS_SURE.split()), 1).when(high & F.col("type").isin(*fixed.TARGETS_POSSIBLE.split()), 2)


def classification(inv: DataFrame) -> DataFrame:
    """``tier, assets, targets``: how many assets each tier of the classification holds, and how many of them are targets.

    The offline rule decides tier 2: of the possible types the likely ones count from criticality 5.
    """
    return inv.groupBy(target_tier().alias("tier")).agg(F.count(F.lit(1)).alias("assets"), F.count_if(is_target()).alias("targets"))


def partial_reward(criticality: Column, dist: Column) -> Column:
    """What a path earns that ends short of a target: half the criticality's share, halved with every hop that is left;
    without a way to a target a little for criticality 4 and more."""
    share = F.coalesce(criticality, F.lit(1)) / 5
    return F.when(dist < FAR, share * (0.5 / F.pow(F.lit(2.0), dist))).when(criticality >= 4, share * 0.05).otherwise(0.0)


def each_profile(df: DataFrame, names: Sequence[str] = ("apt", "ransomware", "insider")) -> DataFrame:
    """Every row once per profile."""
    return df.withColumn("profile", F.explode(F.array(*[F.lit(n) for n in names])))


def target_distances(adjacency: DataFrame, targets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``*by, id, dist``: hops from every node to its nearest target along ``adjacency`` (src, tgt).

    Breadth first from all targets at once over the reversed edges. Each round joins the frontier only, drops
    what is known and is written, so the plan never grows; it stops when nothing new is reached. ``by``: columns of
    both inputs that keep several graphs apart (the profile).
    """
    known = materialise(targets.select(*by, "id").distinct().withColumn("dist", F.lit(0)), "reached")
    frontier = known
    for hop in count(1):
        step = adjacency.join(frontier.select(*by, F.col("id").alias("tgt")), [*by, "tgt"], "left_semi").select(*by, F.col("src").alias("id")).distinct()
        fresh = materialise(step.join(known.select(*by, "id"), [*by, "id"], "left_anti").withColumn("dist", F.lit(hop)), "frontier")
        if fresh.isEmpty():
            break
        known, frontier = known.unionByName(fresh), fresh
    return known


def entry_candidates(inv: DataFrame) -> DataFrame:
    """Every critical or high finding of assets an intruder could enter by; row-local."""
    exposed = F.col("internet_facing") | F.col("zone").isin("dmz", "mgmt") | ((F.col("criticality") >= 4) & F.col("zone").isin("corp", "staging"))
    rows = inv.where(exposed).select("id", "zone", "criticality", "internet_facing", F.explode("findings").alias("f")).where(F.col("f.severity").isin("critical", "high"))
    weight = F.when(F.col("f.severity") == "critical", 4).otherwise(3)
    return rows.select("id", "zone", "criticality", "internet_facing", "f.finding_id", "f.severity", "f.epss", (F.col("criticality") * weight).alias("base"))


def entry_points(inv: DataFrame, distances: DataFrame, top: int = 10, profiles: Sequence[str] = ()) -> DataFrame:
    """``id, finding_id, score, rerank``: the ``top`` entry points; ties by asset, then finding.

    With ``profiles``, ``distances`` has a profile column and so has the result: the ``top`` of each profile.
    """
    c = entry_candidates(inv)
    c = each_profile(c, profiles).join(distances, ["profile", "id"], "left") if profiles else c.join(distances, "id", "left")
    c = c.withColumn("dist", F.coalesce("dist", F.lit(FAR)))
    near = F.when(F.col("dist") <= 1, 8).when(F.col("dist") <= 2, 5).when(F.col("dist") <= 3, 2).otherwise(0)
    plus = F.when(F.col("internet_facing"), 5).otherwise(0) + F.coalesce("epss", F.lit(0.0)) * 3
    score, again = F.col("base") + plus + near, F.col("base") + plus + F.when(F.col("dist") <= 2, 5).otherwise(0)
    by = ["profile"] if profiles else []
    out, order = c.select(*by, "id", "finding_id", F.round(score, 9).alias("score"), F.round(again, 9).alias("rerank")), [F.desc("score"), "id", "finding_id"]
    if profiles:
        return out.withColumn("r", F.row_number().over(Window.partitionBy("profile").orderBy(*order))).where(F.col("r") <= top).drop("r")
    return out.orderBy(*order).limit(top)
