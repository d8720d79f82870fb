"""Life cycles against brute force, and hand-made values."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.operators import lifecycle as lc

T0 = datetime(2025, 1, 1)


@pytest.mark.parametrize("table,start", [(lc.JOB, "pending"), (lc.CHUNK, "pending"), (lc.SCHEDULE, "idle"), (lc.WORKER, "idle")])
def test_states_against_a_loop(spark, table, start):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "b", "c", None]), i, rng.choice([*table, "other", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, e string").withColumn("state", F.lit("clash")).repartition(7)
    want: dict = {}
    for k, _, e in rows:
        if k is not None:
            s, n = want.get(k, (start, 0))
            want[k] = (table.get(e, {}).get(s, s), n + 1)
    got = {r.k: (r.state, r.events) for r in lc.fold_states(df, "k", ["t"], F.col("e"), table, start).collect()}
    assert got == want
    assert lc.fold_states(df.limit(0), "k", ["t"], F.col("e"), table, start).count() == 0


def test_floored_sum(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aab"), i, rng.choice([-3, -1, 1, 2, None])) for i in range(500)]
    want = dict.fromkeys("ab", 0)
    for k, _, d in rows:
        want[k] = max(0, want[k] + (d or 0))
    assert {r.k: r.total for r in lc.floored_sum(spark.createDataFrame(rows, "k string, t int, d int").repartition(5), "k", ["t"], "d").collect()} == want


def test_rebalance_and_progress(spark):
    chunks = spark.createDataFrame([(1, "w1", "assigned"), (2, "w2", "assigned"), (3, "w2", "completed"), (4, None, "pending"), (5, "gone", "assigned")], "chunk int, worker string, status string")
    workers = spark.createDataFrame([("w1", T0), ("w2", T0 - timedelta(seconds=31))], "worker string, seen timestamp")
    got = {r.chunk: (r.worker, r.status) for r in lc.rebalance(chunks, workers, F.lit(T0)).collect()}
    assert got == {1: ("w1", "assigned"), 2: (None, "pending"), 3: ("w2", "completed"), 4: (None, "pending"), 5: (None, "pending")}
    r = spark.range(1).select(lc.progress(F.lit(3), F.lit(4)).alias("a"), lc.progress(F.lit(9), F.lit(4)).alias("b"), lc.progress(F.lit(1), F.lit(0)).alias("c"), lc.platform(F.lit(5986)).alias("p")).first()
    assert (r.a, r.b, r.c, r.p) == (75.0, 100.0, 0.0, "windows")
    status = [lc.worker_status(F.lit(a), F.lit(2), F.lit(T0 - timedelta(seconds=s)), F.lit(T0)) for a, s in ((1, 30), (2, 30), (2, 31))]
    assert list(spark.range(1).select(*status).first()) == ["idle", "busy", "offline"]


def test_next_run(spark):
    day = timedelta(days=1)
    rows = [("interval", None, T0 - 3 * day, None, T0), ("interval", T0 - day / 2, T0 - 3 * day, None, T0 + day / 2), ("interval", None, T0 + day, None, T0 + day), ("once", None, T0 - day, None, T0),
            ("once", None, T0 + day, None, T0 + day), ("once", T0 - day, T0 - day, None, None), ("interval", T0 - day / 2, T0 - day, T0, None), ("cron", None, T0, None, T0 + 2 * day)]
    df = spark.createDataFrame(rows, "kind string, last timestamp, start timestamp, end timestamp, want timestamp")
    out = df.select("want", lc.next_run(F.col("kind"), F.lit(T0 + 2 * day), F.lit(86_400), F.col("last"), F.col("start"), F.col("end"), F.lit(T0)).alias("got")).collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_selection_and_detections(spark):
    inv = spark.createDataFrame([("a", "dmz", ["ssh"], 5), ("b", "corp", ["rdp"], 2), ("c", "corp", None, 4)], "id string, zone string, services array<string>, criticality int")
    ids = lambda *a, **k: sorted(r.id for r in lc.select_targets(inv, *a, **k).collect())
    assert ids("all") == ["a", "b", "c"] and ids("zones", ("corp",), ("b",)) == ["c"] and ids("tags", ("rdp", "ssh")) == ["a", "b"] and ids("list", ("c",)) == ["c"] and ids("query", query="criticality >= 4") == ["a", "c"]
    hosts = spark.createDataFrame([("h", "Port 22\n PermitRootLogin yes", "Status: inactive"), ("i", "PermitRootLogin no", "Status: active"), ("j", None, None)], "id string, s string, f string")
    assert {(r.id, r.misconfig_id, r.severity) for r in lc.config_findings(hosts, "id", "s", "f").collect()} == {("h", "M001", "high"), ("h", "M019", "medium")}
    cache = spark.createDataFrame([("x", 3, 1), ("y", 1, 5), ("z", 1, 2)], "key string, hits int, at int")
    assert [r.key for r in lc.evictions(cache, 1).orderBy("place").collect()] == ["z", "y"] and lc.evictions(cache, 9).count() == 0
    both = lc.with_unreachable(inv, inv.where("id = 'a'"), "id").collect()
    assert {(r.id, r.success, r.error) for r in both} == {("a", True, None), ("b", False, "unreachable"), ("c", False, "unreachable")}
