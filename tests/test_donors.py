"""Filling: every fill, p6_found's too, comes from donors found by one range search."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from riskloom.operators import impute
from riskloom.operators.impute import Numeric, fill_missing
from riskloom.plans.problems import QUERIES

SCHEMA = "finding_id string, misconfig_id string, observed_at timestamp, ingested_at timestamp, severity string, cvss double, epss double"


def test_nearest_against_brute_force(spark):
    rng, at = random.Random(5), Numeric(0.0, 10.0)
    pool = [(i, rng.choice(["A", "B", None]), round(rng.choice([rng.random(), 3 + rng.random(), 9.9]), 2), float(i)) for i in range(150)] + [(900, "C", 5.0, 1.0)]
    want = {(g, round(rng.random() * 10, 2)) for g in "ABC" for _ in range(60)} | {(g, p) for _, g, p, _ in pool[::9] if g} | {("D", 1.0)}
    ranged = lambda rows, s: spark.createDataFrame(rows, s).withColumns({"field": F.lit("x"), "range": at.step(F.col("at"), 16)})
    rows = ranged(pool, "id bigint, g string, at double, v double")
    spans = rows.where("g IS NOT NULL").groupBy("g", "field", "range").agg(F.min("at").alias("bottom"), F.max("at").alias("top"))
    got = {(r.g, r.at): (r.low and (r.low["at"], r.low["id"]), r.high and (r.high["at"], r.high["id"])) for r in impute._nearest(rows, spans, ranged(sorted(want), "g string, at double"), ["g"]).collect()}
    for g, p in want - {("D", 1.0)}:
        low = min(((p - a, i, a) for i, h, a, _ in pool if h == g and a <= p), default=None)
        high = min(((a - p, i, a) for i, h, a, _ in pool if h == g and a >= p), default=None)
        assert got.pop((g, p)) == (low and (low[2], low[1]), high and (high[2], high[1]))
    assert not got or got == {("D", 1.0): (None, None)}


def test_donor_has_the_nearest_prediction(spark):
    """Rows 1 and 2 are predicted in one step; the cell's prediction is that of row 2."""
    rows = [(1, "A", 5.0, 0.5), (2, "A", 5.02, 0.502), (3, "A", 1.0, 0.1), (4, "A", 9.0, 0.9), (5, "A", None, 0.502)]
    df = spark.createDataFrame(rows, "id int, g string, x double, y double")
    got = fill_missing(df, "id", ("g",), {"x": Numeric(0.0, 10.0, "y"), "y": Numeric(0.0, 1.0)}).collect()
    assert [(r.id, r.field, r.donor_id, r.donor_id_2, r.filled) for r in got] == [(5, "x", 2, None, "5.02")]


def test_p6_found_comes_from_the_donors(spark, tmp_path, monkeypatch):
    """What is searched for are the groups' predictions, and what the donors hold decides the label."""
    day = datetime(2025, 3, 4)
    rows = [("f1", "HIGH", 3.0, 0.05), ("f2", " high", 4.5, 0.2), ("f3", "low", 9.5, 0.9), ("f4", "low", None, None), ("f5", None, 6.0, None), ("f6", "?", None, None), ("f7", None, 5.0, 0.3)]
    rows = [(i, "M", day, day, s, c, e) for i, s, c, e in rows] + [("g1", "N", day, day, None, 1.0, 0.5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/findings.parquet")
    found = lambda: sorted(map(tuple, QUERIES["p6_found"](spark, str(tmp_path)).collect()))
    cells = [("f4", "cvss"), ("f4", "epss"), ("f5", "epss"), ("f5", "severity"), ("f6", "cvss"), ("f6", "epss"), ("f6", "severity"), ("f7", "severity")]
    label = {"cvss": "medium", "epss": "medium", "severity": "high"}  # medians 5.0 and 0.25; two of each severity, the more severe
    assert found() == [(i, f, label[f]) for i, f in cells]

    search, asked = impute._nearest, []

    def lowest(pool, spans, want, keys):
        asked.extend((r.field, r.at) for r in want.where("__g0 = 'M'").collect())
        least = pool.groupBy(*keys, "field").agg(F.min(F.struct("at", "id", "v")).alias("d"))
        return want.join(least, [*keys, "field"]).select(*keys, "field", "at", F.col("d").alias("low"), F.col("d").alias("high"))

    monkeypatch.setattr(impute, "_nearest", lowest)
    assert found() == [(i, f, {"cvss": "low", "epss": "low", "severity": "high"}[f]) for i, f in cells]
    assert sorted(asked) == [("cvss", 5.0), ("epss", 0.25), ("severity", 2.0)]
    monkeypatch.setattr(impute, "_nearest", lambda *a: search(*a).where("false"))
    assert found() == []
