"""Exposure paths from entry points to targets: a deterministic beam over the strongest transitions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..session import materialise

MIN_NODES, MAX_DEPTH, BEAM = 4, 7, 3


@dataclass(frozen=True)
class Options:
    """What an analysis can be asked for; see ``analyse``."""

    profiles: tuple[str, ...] = ("apt", "ransomware", "insider")
    neighbours: int = 20
    entry_points: int = 10
    beam: int = BEAM
    max_depth: int = MAX_DEPTH
    min_nodes: int = MIN_NODES
    #: A model's verdict on targets: takes the inventory, gives ``id`` of the targets; the offline rule by default.
    target_model: Callable[[DataFrame], DataFrame] | None = None
    #: A model's view of entry points: takes ``profile, id, finding_id, score, rerank``, gives them with ``score`` changed.
    entry_model: Callable[[DataFrame], DataFrame] | None = None
    #: A model's account of paths: takes the scored paths, gives ``path_id, narrative``; a template by default.
    narrator: Callable[[DataFrame], DataFrame] | None = None


def template_narrative(paths: DataFrame) -> DataFrame:
    """``path_id, narrative``: one sentence from the path's label, length and timeline."""
    text = F.format_string("%s, %d hosts, %s, likelihood %.0f%%.", F.col("label"), F.size("nodes"), F.col("timeline"), F.col("path_probability") * 100)
    return paths.select("path_id", text.alias("narrative"))


def analyse(inv: DataFrame, options: Options = Options()) -> DataFrame:
    """Scored paths of an inventory (with ``top`` findings), with ``realism``, ``reward`` and ``narrative``.

    Transitions, targets, entry points, search and scores under ``options``; models are functions from DataFrame to
    DataFrame (``mapInPandas`` inside, if they are remote), so they run in the tasks.
    """
    from . import edges, path_scores, targets

    adj = materialise(edges.adjacency(inv, options.profiles, options.neighbours), "adjacency")
    goals = options.target_model(inv) if options.target_model else inv.where(targets.is_target()).select("id")
    dist = targets.target_distances(adj, targets.each_profile(goals, options.profiles), by=["profile"])
    starts = targets.entry_points(inv, dist, options.entry_points, options.profiles)
    starts = materialise(options.entry_model(starts) if options.entry_model else starts, "entries")
    walkable = adj.join(inv.where("top IS NOT NULL").select(F.col("id").alias("tgt")), "tgt", "left_semi")
    found = search(walkable, starts, goals, options.beam, options.max_depth, options.min_nodes, by=["profile"])
    paths = path_scores.scored(as_paths(found, inv, F.col("profile"))).withColumns({"realism": F.round(path_scores.realism(), 6), "reward": F.round(path_scores.reward(), 6)})
    told = (options.narrator or template_narrative)(paths).select(F.col("path_id").alias("__p"), "narrative")
    return paths.join(told, F.col("path_id") == F.col("__p"), "left").drop("__p")


def search(adjacency: DataFrame, entries: DataFrame, targets: DataFrame, beam: int = BEAM, max_depth: int = MAX_DEPTH, min_nodes: int = MIN_NODES, by: Sequence[str] = ()) -> DataFrame:
    """``*by, entry, node, path, techniques, probs, p``: simple paths of at least ``min_nodes`` nodes that end in a target.

    ``adjacency``: src, tgt, technique, posterior of one profile, targets of transitions that may be entered only.
    ``by``: columns of transitions and entries that keep several graphs apart (the profile), searched side by side.
    Level by level every kept path is joined with the transitions of its last node; of the paths that reach the
    same node from the same entry the ``beam`` likeliest are kept (ties by the path as text, then the techniques). Paths aren't led
    past a target. With a beam as large as the number of simple paths the search is exhaustive. What is kept is
    at most entries x nodes x beam per level; every level is written, so plans stay small and a lost executor
    costs one level.
    """
    adj = materialise(adjacency.select(*by, "src", "tgt", "technique", "posterior"), "adjacency")
    stop = materialise(targets.select(F.col("id").alias("node")).distinct().withColumn("hit", F.lit(True)), "targets")
    level = entries.select(*by, F.col("id").alias("entry"), F.col("id").alias("node")).distinct()
    level = level.select(
        *by, "entry", "node", F.array("node").alias("path"), F.array().cast("array<string>").alias("techniques"), F.array().cast("array<double>").alias("probs"), F.lit(1.0).alias("p")
    ).join(stop, "node", "left")
    level = materialise(level, "level")
    found = None
    w = Window.partitionBy(*by, "entry", "tgt").orderBy(F.desc("q"), F.array_join("longer", ">"), F.array_join("techniques", "+"))
    for depth in range(1, max_depth + 1):
        steps = level.where("hit IS NULL").join(adj.withColumnRenamed("src", "node"), [*by, "node"]).where(~F.array_contains("path", F.col("tgt")))
        steps = steps.select(
            *by, "entry", "tgt", F.array_append("path", F.col("tgt")).alias("longer"), F.array_append("techniques", F.col("technique")).alias("techniques"),
            F.array_append("probs", F.col("posterior")).alias("probs"), F.round(F.col("p") * F.col("posterior"), 12).alias("q"),
        )
        best = steps.withColumn("r", F.row_number().over(w)).where(F.col("r") <= beam)
        level = best.select(*by, "entry", F.col("tgt").alias("node"), F.col("longer").alias("path"), "techniques", "probs", F.col("q").alias("p")).join(stop, "node", "left")
        level = materialise(level, "level")
        if level.isEmpty():
            break
        if depth + 1 >= min_nodes:
            hits = level.where("hit").drop("hit")
            found = hits if found is None else found.unionByName(hits)
    return level.drop("hit").limit(0) if found is None else found


def as_paths(found: DataFrame, inv: DataFrame, profile: str | Column) -> DataFrame:
    """Found paths in the shape of stored ones: path_id, profile, nodes, edges, path_probability.

    The path's own nodes are joined with the inventory by id and put back in order; the id is the hash of profile,
    node list and techniques, so it doesn't change between runs.
    """
    rows = found.withColumn("path_id", F.concat(F.lit("path-"), F.substring(F.sha2(F.concat_ws(">", F.lit(profile), F.array_join("path", ">"), F.array_join("techniques", "+")), 256), 1, 12)))
    steps = rows.select("path_id", F.posexplode("path").alias("pos", "asset_id"))
    info = inv.select(
        F.col("id").alias("asset_id"), F.col("name").alias("asset_name"), F.col("type").alias("asset_type"), F.col("zone").alias("asset_zone"),
        "criticality", "internet_facing", F.col("sensitivity").alias("data_sensitivity"), F.col("top.finding_id").alias("misconfig_id"), F.col("top.category").alias("misconfig_category"), F.col("top.severity").alias("severity"), F.col("top.title").alias("misconfig_title"), _epss().alias("epss"), "sources",
    )
    node = F.struct(
        "pos", "asset_id", "asset_name", "asset_type", "asset_zone", "criticality", "internet_facing", "data_sensitivity", "misconfig_id", "misconfig_title", "misconfig_category", "severity", "epss", "sources"
    )
    nodes = steps.join(info, "asset_id").groupBy("path_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    ends = F.transform(
        F.col("techniques"),
        lambda t, i: F.struct(
            F.get("path", i).alias("source_id"), F.get("path", i + 1).alias("target_id"), F.get("probs", i).alias("probability"), t.alias("technique"),
            F.array(F.greatest(F.lit(0.0), F.get("probs", i) - 0.1), F.least(F.lit(1.0), F.get("probs", i) + 0.1)).alias("confidence_interval"),
        ),
    )
    return rows.select("path_id", F.lit(profile).alias("profile"), "entry", ends.alias("edges"), F.col("p").alias("path_probability")).join(nodes, "path_id")


def _epss():
    """The largest exploit score among an asset's findings; missing ones by severity."""
    known = lambda f: F.coalesce(f["epss"], F.when((f["severity"] == "critical") & f["exploit_available"], 0.7).when(f["severity"] == "critical", 0.3).when(f["severity"] == "high", 0.15).otherwise(0.05))
    return F.coalesce(F.array_max(F.transform("findings", known)), F.lit(0.05))


def technique_label(c):
    return fixed.switch(c, {t: label for t, _, label in fixed.techniques()}, "unknown")


def statistics(found: DataFrame) -> DataFrame:
    """``profile, paths, entries, targets, avg_nodes, longest``: what a search found, per profile."""
    n = F.size("path")
    per = found.groupBy("profile").agg(F.count(F.lit(1)).alias("paths"), F.count_distinct("entry").alias("entries"), F.count_distinct("node").alias("targets"), F.round(F.avg(n), 6).alias("avg_nodes"), F.max(n).alias("longest"))
    return per
