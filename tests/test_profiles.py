"""Distances, entry points, paths and the report over all three profiles."""

import json

from pyspark.sql import functions as F

from riskloom.operators import path_scores as ps, path_search, targets
from riskloom.plans import path_queries as pq


def test_graphs_of_profiles_stay_apart(spark):
    chain = [("apt", f"n{i}", f"n{i + 1}") for i in range(3)] + [("insider", "n0", "x"), ("insider", "x", "y"), ("insider", "y", "n3")] + [("ransomware", "n0", "n3")]
    adj = spark.createDataFrame([(*e, "lateral", 0.5) for e in chain], "profile string, src string, tgt string, technique string, posterior double")
    goal = spark.createDataFrame([("n3",)], "id string")
    d = targets.target_distances(adj, targets.each_profile(goal), by=["profile"])
    assert {(r.profile, r.id): r.dist for r in d.collect()} == {
        ("apt", "n0"): 3, ("apt", "n1"): 2, ("apt", "n2"): 1, ("apt", "n3"): 0, ("insider", "n0"): 3, ("insider", "x"): 2, ("insider", "y"): 1, ("insider", "n3"): 0,
        ("ransomware", "n0"): 1, ("ransomware", "n3"): 0}
    entries = targets.each_profile(spark.createDataFrame([("n0",)], "id string"))
    found = path_search.search(adj, entries, goal, by=["profile"]).collect()
    assert {(r.profile, ">".join(r.path)) for r in found} == {("apt", "n0>n1>n2>n3"), ("insider", "n0>x>y>n3")}


def test_report_is_the_best_of_all_profiles(spark, sf):
    """Each profile searched on its own, merged in Python."""
    i, entries, goals, walkable = pq._search_all(spark, sf)
    best = {}
    for at, name in enumerate(("apt", "ransomware", "insider")):
        found = path_search.search(walkable.where(F.col("profile") == name), entries.where(F.col("profile") == name), goals)
        rows = ps.scored(path_search.as_paths(found, i, name)).select("path_id", "signature", "label", F.round(ps.realism(), 6).alias("realism")).collect()
        assert rows
        for r in rows:
            key = (-r.realism, at, r.path_id)
            best[r.signature] = min(best.get(r.signature, (key, name, r.label)), (key, name, r.label))
    want = [(k[2], p, f"[{pq.TAGS[p]}] {label}") for k, p, label in sorted(best.values())[:5]]
    got = [(r.path_id, d["profile"], d["label"]) for r in pq.QUERIES["exposure_report"](spark, sf).orderBy("rank").collect() for d in [json.loads(r.document)]]
    assert got == want and any(p != "apt" for _, p, _ in got)


def test_analysis_with_models(spark, sf):
    """Options and pluggable models; the default analysis is what the queries give."""
    from riskloom.operators.inventory import top_finding
    from riskloom.plans.inventory_queries import inv
    from riskloom.session import materialise

    i = materialise(top_finding(inv(spark, sf)), "inventory")
    base = path_search.analyse(i).cache()
    searched = pq.QUERIES["exposure_paths"](spark, sf)
    assert base.count() == searched.count() > 0 and base.where("narrative IS NULL").count() == 0
    goal = base.select(F.element_at("nodes", -1)["asset_id"].alias("id")).orderBy("id").limit(1)
    own = path_search.Options(profiles=("apt",), target_model=lambda inv_: inv_.join(goal, "id", "left_semi").select("id"), narrator=lambda p: p.select("path_id", F.lit("told").alias("narrative")))
    rows = path_search.analyse(i, own).collect()
    assert {r.profile for r in rows} <= {"apt"} and all(r.nodes[-1].asset_id == goal.first().id and r.narrative == "told" for r in rows)
