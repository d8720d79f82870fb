"""Seeded inventories, permutations and made-up results."""

from pyspark.sql import functions as F

from riskloom.sources import generate as gen, records as src

CATALOGUE = [(f"M{i:02d}", f"title {i}", c, s) for i, (c, s) in enumerate([("network", "high"), ("service", "critical"), ("authorization", "medium"), ("encryption", "high")])]


def test_lcg_is_double_arithmetic():
    r = gen.Lcg(12345)
    whole = (12345 * 1103515245 + 12345) & 0x7FFFFFFF
    assert r.next() == whole / 0x7FFFFFFF  # the first product still fits a double exactly
    r = gen.Lcg(0x7FFFFFFF)
    r.next()
    assert r.seed != (0x7FFFFFFF * 1103515245 + 12345) & 0x7FFFFFFF and 0 <= r.seed <= 0x7FFFFFFF
    assert sorted(gen.Lcg(3).shuffled(range(50))) == list(range(50)) and gen.Lcg(3).shuffled(range(50)) == gen.Lcg(3).shuffled(range(50)) != list(range(50))


def test_seeded_inventory(spark):
    a, b = (gen.seeded_inventory(spark, CATALOGUE, total=60, seed=s).collect() for s in (42, 42))
    assert a == b and len(a) == 60 == len({r.id for r in a}) == len({r.ip for r in a})
    count = lambda t: sum(r.type == t for r in a)
    assert (count("web_server"), count("domain_controller"), count("workstation")) == (8, 3, 32)
    assert {r.zone for r in a if r.type == "web_server"} == {"dmz", "prod-web"} and all(len({f.id for f in r.misconfigurations}) == len(r.misconfigurations) <= 3 for r in a)
    assert sorted(r.name for r in a if r.type == "domain_controller") == ["DC-001", "DC-002", "DC-003"]
    assert gen.seeded_inventory(spark, CATALOGUE, total=60, seed=1).collect() != a


def test_scaled_inventory(spark):
    df = gen.scaled_inventory(spark, 5_000)
    rows = df.collect()
    assert len(rows) == 5_000 == len({r.name for r in rows}) and abs(sum(r.type == "workstation" for r in rows) / 5_000 - 20 / 48) < 0.03
    names = sorted(int(r.name[-6:]) for r in rows if r.type == "domain_controller")
    assert names == list(range(1, len(names) + 1))
    assert [r.id for r in gen.permuted(df, "id", 3).limit(20).collect()] == [r.id for r in gen.permuted(df.repartition(7), "id", 3).limit(20).collect()] != sorted(r.id for r in rows)[:20]


def test_scan_results(spark):
    rows = gen.scan_results(spark.range(2_000), "id", [f"M{i}" for i in range(12)]).collect()
    assert abs(sum(r.success for r in rows) / 2_000 - 0.95) < 0.02
    assert all(len(set(r.findings)) == len(r.findings) and (1 <= len(r.findings) <= 4 if r.success else not r.findings) for r in rows)


def test_commands(spark):
    c = gen.command_catalogue(spark, {"users": ["id", "who"], "net": ["ss -l"]}, "linux")
    script = gen.batched(c).first().script
    assert script.index("###GROUP: net") < script.index("ss -l || echo CMD_FAILED") < script.index("###GROUP: users") < script.index("id ||") < script.index("who ||")
    out = spark.createDataFrame([("###GROUP: net\nLISTEN\n###GROUP: users\nroot\n",)], "t string").select(src.parse_collected(F.col("t")).alias("m")).first().m
    assert set(out.values()) == {"LISTEN", "root"}
