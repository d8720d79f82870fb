"""Similarity in the prior without scoring every pair."""

from riskloom.operators import edges
from riskloom.plans.inventory_queries import _graph_inventory


def test_few_targets_can_be_the_strongest(spark, sf):
    i = _graph_inventory(spark, sf)
    targets = edges.materialise(edges._targets(i), "targets")
    few = edges.similar_candidates(i, targets, k=1)
    all_ = edges.similar_candidates(i, targets, k=10_000)
    assert 0 < few.count() < all_.count() / 2
