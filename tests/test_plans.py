"""What queries read, and fixed values against literal check values."""

import re

import pytest
from pyspark.sql import functions as F

from riskloom.functions import fixed
from riskloom.operators import edges, lifecycle as lc, path_scores as ps, targets
from riskloom.operators.inventory import name_key, tier
from riskloom.plans import catalog


def reads(df, table):
    """The read schema of the scan of a table in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"FileScan parquet \[[^\]]*\].*?" + table + r".*?ReadSchema: (struct<.*>)", plan)
    assert found, plan
    return found


@pytest.mark.parametrize(
    "name,table,want",
    [
        ("risk_metrics", "attack_paths", "struct<path_id:string,profile:string,path_probability:double,realism_score:double,impact_score:double,ingested_at:timestamp>"),
        ("chokepoints", "attack_paths", "struct<path_id:string,nodes:array<struct<asset_id:string>>,ingested_at:timestamp>"),
        ("ip_numbers", "assets", "struct<id:string,ip:string,ingested_at:timestamp>"),
        ("top_assets_by_criticality", "assets", "struct<id:string,name:string,criticality:int,ingested_at:timestamp>"),
    ],
)
def test_only_named_columns_are_read(spark, sf, name, table, want):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    assert want in (got := set(reads(catalog.QUERIES[name](spark, sf), table))) and got <= {want, "struct<path_id:string>"}  # the second counts the keys


def test_thresholds(spark):
    rows = [(1, "corp", 0, 0.50), (1, "corp", 1, 0.50), (3, "corp", 1, 0.45), (4, "corp", 1, 0.40), (5, "corp", 1, 0.35), (5, "restricted", 1, 0.27), (1, "corp", 2, 0.55)]
    df = spark.createDataFrame(rows, "c int, z string, d int, want double")
    assert all(abs(r.got - r.want) < 1e-12 for r in df.withColumn("got", edges.threshold(F.col("c"), F.col("z"), F.col("d"))).collect())


def test_fixed_tables():
    hops = fixed.zone_distances()
    assert len(fixed.groups(fixed.ZONE_REACH)) == 20 and hops["dmz", "restricted"] == 3 and hops["internet", "dmz"] == 1 and ("pci", "internet") not in hops
    assert [(t, b) for t, b, _ in fixed.techniques()] == [("exploit", 0.30), ("lateral", 0.40), ("credential_theft", 0.50), ("privilege_escalation", 0.25), ("data_exfiltration", 0.15)]
    assert fixed.profiles()["insider"] == {"privilege_escalation": 1.8, "data_exfiltration": 1.6, "lateral": 0.6, "credential_theft": 0.7, "exploit": 0.4}
    assert len(fixed.tiers()) == 51 and fixed.tiers()["bastion_host"] == 4 and fixed.tiers()["siem"] == 3 and len(fixed.TERMINAL_TYPES.split()) == 8
    assert [len(fixed.zone_rules(k)) for k in ("cidr", "hostname", "service", "cloud")] == [7, 7, 5, 3]
    assert fixed.cidr_range("10.1.0.0/16") == (167837696, 167903231) and fixed.cidr_range("1.2.3.4/0") == (0, 4294967295)


def test_small_values(spark):
    one = spark.range(1)
    lit = F.lit
    r = one.select(
        targets.partial_reward(lit(5), lit(1)).alias("a"), targets.partial_reward(lit(5), lit(2)).alias("b"), targets.partial_reward(lit(4), lit(99)).alias("c"), targets.partial_reward(lit(3), lit(99)).alias("d"),
        tier(lit("Bastion_Host")).alias("t"), name_key(lit(" *LAN, Corporate*")).alias("k"), name_key(lit("  ")).alias("blank"), lc.coarse_reach(lit("dmz"), lit("internal")).alias("x"), lc.coarse_reach(lit("dmz"), lit("restricted")).alias("y"),
        lc.coarse_reach(lit("?"), lit("dmz")).alias("z"), *[c.alias(n) for c, n in zip(ps.edge_split(lit(15)), ("e", "f"))],
    ).first()
    assert (r.a, r.b, r.c, r.d) == (0.25, 0.125, 0.8 * 0.05, 0.0)
    assert (r.t, r.k, r.blank, r.x, r.y, r.z, r.e, r.f) == (4, "corporate-lan", "", True, False, False, 11, 4)


def test_coherent_path_scores_90(spark):
    nodes = [("workstation", "corp", 1, True), ("file_server", "mgmt", 3, False), ("domain_controller", "restricted", 5, False)]
    df = spark.createDataFrame([(nodes,)], "nodes array<struct<asset_type:string,asset_zone:string,criticality:int,internet_facing:boolean>>")
    assert df.select(ps.coherence(F.lit(0.5)).alias("c")).first().c == 90.0
