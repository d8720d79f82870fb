"""Distances have no limit of hops."""

from riskloom.operators import targets


def test_long_chain(spark):
    adj = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n3", "n0"), ("n12", "n7")], "src string, tgt string")
    d = targets.target_distances(adj, spark.createDataFrame([("n12",)], "id string"))
    assert {r.id: r.dist for r in d.collect()} == {f"n{i}": 12 - i for i in range(13)}
