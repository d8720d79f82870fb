"""Readers, writers and small text functions."""

import json

from pyspark.sql import functions as F

from riskloom.sources import records as src


def test_requests_and_rejects(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"environment": {"assets": [{"id": "x", "criticality": 4, "misconfigurations": [{"id": "m"}]}, {"name": "no id"}]}}))
    (tmp_path / "b.json").write_text(json.dumps({"environment": {"assets": []}, "maxPaths": 3}))
    (tmp_path / "c.json").write_text("{broken")
    rows = src.requests(spark, str(tmp_path)).collect()
    assert [(r.id, r.criticality, r.max_paths) for r in rows] == [("x", 4, 10)]
    assert {r.file for r in src.rejected_requests(spark, str(tmp_path)).collect()} == {"b.json", "c.json"}


def test_jobs_round_trip(spark, tmp_path):
    (tmp_path / "j.json").write_text(json.dumps({"id": "j1", "type": "scan", "createdAt": 1_735_689_600_000}))
    j = src.jobs(spark, str(tmp_path))
    assert j.first().created_at.year == 2025 and j.first().ended_at is None
    out = str(tmp_path / "out")
    src.write_jobs(j.select("id", "type"), out)
    src.write_jobs(j.select("id", "type"), out, append=True)
    assert spark.read.json(out).count() == 2
    src.write_csv_report(j.select("id", "type"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().id == "j1"


def test_collected_output(spark):
    text = "noise\n###GROUP: ssh\nPermitRootLogin no\nPort 22\n###GROUP: fw\nCMD_FAILED\n###GROUP: ssh\n"
    r = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(src.parse_collected(F.col("t")).alias("m"), src.failed_parts(F.col("t")).alias("f")).collect()
    assert r[0].m == {"ssh_0": "PermitRootLogin no\nPort 22", "ssh_2": ""} and r[0].f == ["fw_1"]
    assert r[1].m is None and r[2].m == {}


def test_small_functions(spark):
    r = spark.createDataFrame([("e", ["a", "b"]), ("f", [])], "id string, channels array<string>")
    assert {(x.id, x.channel) for x in src.notifications(r).collect()} == {("e", "a"), ("e", "b")}
    x = spark.range(1).select(src.bar(F.lit(0.25), 8).alias("b"), src.content_key(F.lit("a"), F.lit("b")).alias("k")).first()
    assert x.b == "██░░░░░░" and len(x.k) == 64


def test_texts_with_json(spark):
    rows = [('Sure:\n```json\n{"a": 1}\n```',), ("no block",), ('x [{"a": 2}, {"a": 3}] y',), ("{broken",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    one = df.select(src.first_json(F.col("t"), "a int").alias("o"), src.first_json(F.col("t"), "array<struct<a:int>>", "array").alias("l")).collect()
    assert one[0].o.a == 1 and one[1].o is None and [x.a for x in one[2].l] == [2, 3] and one[3].o is None and one[4].o is None
    m = spark.range(1).select(src.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.lit(None).cast("map<string,string>"), F.create_map(F.lit("b"), F.lit("2"))).alias("m")).first().m
    assert m == {"a": "1", "b": "2"}
    line = spark.createDataFrame([("label", 0.5)], "l string, s double").transform(lambda d: src.report_lines(d, "l", "s", 8)).first().line
    assert line == "label    " + "█" * 10 + "░" * 10 + "  50.0%"
    assert spark.range(1).select(src.stars(F.lit(0.6)).alias("s")).first().s == "★★★☆☆"
    e = spark.createDataFrame([("e", ["a", "b"])], "id string, channels array<string>")
    assert [r.channel for r in src.notifications(e, only=("b",)).collect()] == ["b"]
