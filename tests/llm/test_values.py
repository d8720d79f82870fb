"""Typed values against the reference list."""

import re

from pyspark.sql import functions as F

from riskloom.llm.canonical import map_columns, map_values, normalised, reference_forms

TYPED = {
    "type": {"Workstation": "workstation", "wrorkstation": "workstation", "Server, Logging": "logging_server", "lapt0p": "laptop", "K8S": "k8s_cluster", "kubernetes": "k8s_cluster", "laptop / unit 3": "laptop",
             "*Workstation*": "workstation", "Laptop #8": "laptop", "print device": "printer", "data_kareohuse": "data_warehouse", "tbd": None, "see ticket 4711": None, "": None, " ": None, "coffee corner": None, None: None,
             "?": None, "w" * 50_000: None, "Web Server " * 9: "web_server", "".join(chr(97 + i * i % 26) for i in range(20_000)) + " x": None, "Ápp Sérver": "app_server"},
    "zone": {"corporate wifi": "corp-wifi", "prod database": "prod-db", "devdapp": "dev-app", "\xa0Corporate Wireless": "corp-wifi", "office lan": "corp", "restrict.": "restricted", "room 3.14": None, "dmz segment": "dmz"},
}


def test_typed_values(spark, sf):
    ref = spark.read.parquet(f"{sf}/canon_ref.parquet")
    rows = [(f, v) for f, m in TYPED.items() for v in m] * 2 + [("other", "laptop")]
    df = spark.createDataFrame(rows, "field_name string, value string").withColumn("norm", F.lit("clash")).withColumn("score", F.lit(1))
    got = {(r.field_name, r.value): r for r in map_values(df, ref).collect()}
    assert {k: r.canonical for k, r in got.items()} == {(f, v): c for f, m in TYPED.items() for v, c in m.items()} | {("other", "laptop"): None}
    assert all(r.n == 2 for k, r in got.items() if k[0] != "other")
    assert map_values(df.limit(0), ref).count() == 0
    assert {r.canonical for r in map_values(df, ref.limit(0)).collect()} == {None}


def test_columns(spark, sf):
    ref = spark.read.parquet(f"{sf}/canon_ref.parquet")
    rows = [("a", "laptop", "corp"), ("b", "Laptop", None), ("c", None, "CORP")]
    df = spark.createDataFrame(rows, "id string, type string, zone string").withColumn("canonical", F.lit("clash"))
    got = {(r.id, r.field_name): (r.value, r.canonical) for r in map_columns(df, "id", ["type", "zone"], ref).collect()}
    assert got == {("b", "type"): ("Laptop", "laptop"), ("b", "zone"): (None, None), ("c", "type"): (None, None), ("c", "zone"): ("CORP", "corp")}


def test_normalised(spark):
    rows = spark.createDataFrame([("  Corporaté_LAN (old)",), ("c0rp #7",), ("Server, Logging / unit 4",), ("4711",), (None,)], "v string").select(normalised(F.col("v")).alias("n")).collect()
    assert [r.n for r in rows] == ["corporate lan", "corp", "server logging", "4711", None]


def test_every_form_maps_to_its_entry(spark, sf):
    """Held-out accuracy on typed values whose meaning another column (the asset's name) gives away."""
    ref = spark.read.parquet(f"{sf}/canon_ref.parquet")
    forms = reference_forms(ref)
    own = map_values(forms.select("field_name", F.col("form").alias("value")), ref).select("field_name", F.col("value").alias("form"), F.col("canonical").alias("got"))
    assert forms.join(own, ["field_name", "form"]).where("NOT got <=> canonical").count() == 0
    assets = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/assets.parquet").dropDuplicates(["id"])
    names = dict(assets.select("id", "name").collect())
    hits = misses = 0
    for r in map_columns(assets, "id", ["type", "zone"], ref).where("canonical IS NOT NULL").collect():
        m = re.match(r"([A-Z]+)\d\d-([A-Z0-9]+?)\d{4}$", names[r.id] or "")
        if m:
            code = re.sub("[^A-Z0-9]", "", r.canonical.upper())
            told = m[1] if r.field_name == "zone" else m[2]
            hits, misses = hits + code.startswith(told), misses + (not code.startswith(told))
    assert hits > 500 and misses <= 0.01 * hits


def test_pruning_is_exact(spark, sf):
    """The same entries, scores and leads (near the threshold) as by reading out every n-gram's list."""
    import math
    from collections import Counter

    from riskloom.llm import canonical as ca

    ref = spark.read.parquet(f"{sf}/canon_ref.parquet").where("field_name = 'zone'")
    typed = [v for v in TYPED["zone"]] + ["prod", "development", "cloud", "production db web", "dev application", "corp security", "card data zone", "wan perimeter"]
    rows = spark.createDataFrame([("zone", v) for v in typed], "field_name string, value string")
    got = {r.value: (r.canonical, r.score) for r in map_values(rows, ref).collect()}
    forms = [(r.canonical, r.form, set(r.g)) for r in reference_forms(ref).withColumn("g", ca._grams(F.col("form"))).collect()]
    df = Counter(g for _, _, gs in forms for g in gs)
    w = {g: math.log1p(len(forms) / n) for g, n in df.items()}
    first = F.when(F.contains("norm", F.lit(" ")), ca._grams(F.substring_index("norm", " ", 1))).otherwise(F.array().cast("array<string>"))
    norms = rows.select("value", normalised(F.col("value")).alias("norm")).withColumns({"g": ca._grams(F.col("norm")), "first": first}).collect()
    import duckdb

    edit = lambda a, b: duckdb.execute("SELECT levenshtein(?, ?)", [a, b]).fetchone()[0]
    for r in norms:
        boost = {g: 2.25 if g in r.first else 1.0 for g in r.g}
        vn = sum(w.get(g, math.log1p(len(forms))) ** 2 * b for g, b in boost.items())
        scores: dict = {}
        for c, form, gs in forms:
            both = [g for g in gs if g in boost]
            dot, extra = sum(w[g] ** 2 * boost[g] for g in both), sum(w[g] ** 2 * (boost[g] - 1) for g in both)
            cos = dot / math.sqrt(vn * (sum(w[g] ** 2 for g in gs) + extra))
            s, t = r.norm.replace(" ", ""), form.replace(" ", "")
            e = min(edit(s, t), edit("".join(sorted(r.norm.split(" "))), "".join(sorted(form.split(" ")))))
            scores[c] = max(scores.get(c, 0), (cos + 0.3 * (1 - e / max(len(s), len(t)))) / 1.3)
        top = sorted(scores.items(), key=lambda x: -x[1])
        want = top[0][0] if top[0][1] >= 0.42 and top[0][1] - top[1][1] >= 0.01 else None
        assert got[r.value][0] == want, r.value
        if want:
            assert abs(got[r.value][1] - top[0][1]) < 1e-6
