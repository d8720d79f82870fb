"""Similarity in the prior: assets that differ in nothing but the id are scored once, and all are listed."""

import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from riskloom.operators import edges, similar_pairs
from sql_check import assert_same, connection

COPIES = 25  # more than the k + 1 smallest ids that are kept of a kind


@pytest.fixture(scope="module")
def copies(spark, sf, tmp_path_factory):
    d = tmp_path_factory.mktemp("copies")
    shutil.copy(f"{sf}/canon_ref.parquet", d)
    a = spark.read.parquet(f"{sf}/assets.parquet").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    a = a.where("n = 1 OR crc32(id) % 3 = 0").withColumn("id", F.concat_ws("-", "id", "n")).drop("n").coalesce(1)
    a.write.parquet(f"{d}/assets")
    shutil.move(next((d / "assets").glob("*.parquet")), d / "assets.parquet")
    shutil.rmtree(d / "assets")
    return str(d)


@pytest.mark.parametrize(("pairs", "side"), [(None, None), (500, 30)], ids=["whole", "parts"])
def test_copies_as_the_sql(spark, copies, monkeypatch, pairs, side):
    if pairs:
        monkeypatch.setattr(similar_pairs, "PAIRS", pairs)
        monkeypatch.setattr(similar_pairs, "SIDE", side)
    q = "similar_edge_topk"
    assert_same(spark, connection(copies), copies, e.queries()[q], e.oracle_sql()[q])


def test_pairs_do_not_grow_with_copies(spark, sf, copies, monkeypatch):
    strongest, seen = edges.strongest, []

    def counted(sources, targets, key, *args):
        seen.append(sources.join(targets, key).count())
        return strongest(sources, targets, key, *args)

    monkeypatch.setattr(edges, "strongest", counted)
    for d in (sf, copies):
        e.queries()["similar_edge_topk"](spark, d)
    assert 0 < seen[1] <= seen[0]
