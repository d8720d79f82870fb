"""Core operators on small fixtures: brute force, edge cases, hand-computed values."""

import json
import math
import random
import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riskloom.operators import edges, jobs, path_scores, path_search, targets, validation, zones
from riskloom.operators.delivery import latest_delivery
from riskloom.operators.impute import Category, Numeric, fill_missing
from riskloom.operators.inventory import inventory, top_finding
from riskloom.operators.ordering import chunked, numbered
from riskloom.operators.records import child_links, entity_table
from riskloom.operators.shred import entities, nodes_of, parse, shred, shred_objects, snake

DAY = lambda d: datetime(2025, 1, d)


# --- deliveries and ordering ----------------------------------------------------------------------------------


def test_latest_delivery(spark):
    rows = [("a", DAY(1), "x"), ("a", DAY(2), "y"), ("a", DAY(2), "z"), ("b", None, "n"), (None, DAY(3), "q"), ("c", DAY(1), None)]
    df = spark.createDataFrame(rows, "k string, at timestamp, v string").withColumn("__v", F.lit(1)).withColumn("__k", F.lit("clash"))
    got = {r.k: r.v for r in latest_delivery(df, "k", "at", {"v": "v"}).collect()}
    assert got == {"a": "z", "b": "n", "c": None}
    assert latest_delivery(df.limit(0), "k", "at", {"v": "v"}).count() == 0


def test_numbered_and_chunked(spark):
    df = spark.range(0, 1003, numPartitions=7).select((F.col("id") * 7919 % 1003).alias("x"))
    got = {r.x: r.n for r in numbered(df, ["x"]).collect()}
    assert got == {i: i + 1 for i in range(1003)}
    sizes = [r["count"] for r in chunked(df.where("x < 120"), ["x"], 50).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [50, 50, 20]


# --- shredding ------------------------------------------------------------------------------------------------

PAYLOADS = [
    (1, '{"assets": [{"id": "a1", "misconfigurations": [{"id": " mc-1 "}, null, {"id": "MC-2"}], "evidence": {"siemAlerts": {"confidence": 0.5}, "networkFlow": null}}, null, {"id": "a2"}]}'),
    (2, '{"data": {"body": {"environment": {"assets": {"id": "a3", "misConfigurations": {"id": "x"}, "evidence": [{"source": "threatIntelligence"}, {"source": "network_flow"}]}}}}}'),
    (3, json.dumps({"attackPaths": [{"pathId": "p1", "nodes": [{"assetId": "n1"}, {"assetId": "n2"}], "edges": {"0": {"sourceId": "n1", "targetId": "n2"}, "2": {"sourceId": "n2", "targetId": "n1"}}}]})),
    (4, json.dumps({"result": {"attack_paths": [{"path_id": "p2", "edges": json.dumps([{"source_id": "u", "target_id": "v"}]), "nodes": None}]}})),
    (5, '[{"id": "a9", "misconfigurations": []}, {"id": "a8", "misconfigurations": "[{\\"id\\": \\"q\\"}]"}]'),
    (6, '{"assets": [{"id": "broken"'), (7, None), (8, "error: upstream"), (9, '{"assets": [{"id": NaN}]}'), (10, "{}"), (11, ""),
    (12, "[" * 5000 + "]" * 5000),
]
EXPECTED = {
    (1, "asset", "1", 0, "a1"), (1, "asset", "1", 2, "a2"), (1, "finding", "a1", 0, "MC-1"), (1, "finding", "a1", 2, "MC-2"), (1, "evidence", "a1", 0, "siem_alerts"),
    (2, "asset", "2", 0, "a3"), (2, "finding", "a3", 0, "X"), (2, "evidence", "a3", 0, "threat_intelligence"), (2, "evidence", "a3", 0, "network_flow"),
    (3, "path", "3", 0, "p1"), (3, "node", "p1", 0, "n1"), (3, "node", "p1", 1, "n2"), (3, "edge", "p1", 0, "n1>n2"), (3, "edge", "p1", 2, "n2>n1"),
    (4, "path", "4", 0, "p2"), (4, "edge", "p2", 0, "u>v"), (5, "asset", "5", 0, "a9"), (5, "asset", "5", 1, "a8"), (5, "finding", "a8", 0, "Q"),
}


def test_child_links(spark):
    rows = [(i, DAY(1), p) for i, p in PAYLOADS] + [(1, DAY(2), PAYLOADS[0][1]), (3, DAY(1), PAYLOADS[2][1])]
    df = spark.createDataFrame(rows, "record_id bigint, received_at timestamp, payload string").withColumn("doc", F.lit("clash")).withColumn("node", F.lit(1))
    got = [tuple(r) for r in child_links(df).collect()]
    assert len(got) == len(set(got)) and set(got) == EXPECTED
    assert child_links(df.limit(0)).count() == 0


def test_entity_tables(spark):
    payload = {"assets": [{"id": "a1", "criticality": 4, "internetFacing": True, "services": ["ssh", None, "http"], "misconfigurations": [{"id": "m", "cvss": 7.5, "severity": "high", "references": [{"kind": "note", "ref": "kb"}, None]}],
                           "evidence": {"siemAlerts": {"confidence": 0.5, "lastUpdated": 12}}}, {"id": "a2", "criticality": "many", "services": []}],
               "attack_paths": [{"path_id": "p", "kill_chain": ["x", "y"], "nodes": [{"asset_id": "n", "misconfig_id": "q"}], "edges": {"3": {"source_id": "n", "target_id": "o", "technique": "lateral", "probability": 0.25, "confidence_interval": [0.1, 0.4]}}}]}
    df = spark.createDataFrame([(1, DAY(1), json.dumps(payload)), (2, DAY(1), None), (3, DAY(1), "{")], "record_id bigint, received_at timestamp, payload string")
    rows = lambda kind, *cols: sorted(tuple(r[c] for c in ("record_id", "parent_key", "pos", "child_key", *cols)) for r in entity_table(df, kind).collect())
    assert rows("asset", "criticality", "internet_facing", "services") == [(1, "1", 0, "a1", 4, True, ["ssh", "http"]), (1, "1", 1, "a2", None, None, None)]
    assert rows("finding", "cvss", "severity", "epss") == [(1, "a1", 0, "M", 7.5, "high", None)]
    assert rows("evidence", "confidence", "last_updated") == [(1, "a1", 0, "siem_alerts", 0.5, 12)]
    assert rows("path", "kill_chain") == [(1, "1", 0, "p", ["x", "y"])] and rows("node", "misconfig_id") == [(1, "p", 0, "n", "q")]
    assert rows("edge", "technique", "probability", "confidence_interval") == [(1, "p", 3, "n>o", "lateral", 0.25, [0.1, 0.4])]
    assert rows("reference", "kind") == [(1, "M", 0, "kb", "note")]
    assert all(entity_table(df.limit(0), k).count() == 0 for k in ("asset", "reference"))


def brute(value, out, parent=None, label="", at=0, count=None):
    """Adjacency by plain recursion."""
    count = [0] if count is None else count
    if isinstance(value, dict):
        me, count[0] = count[0], count[0] + 1
        out.append((me, parent, label, at, "object", None))
        for k, v in value.items():
            for i, x in enumerate(v) if isinstance(v, list) else [(0, v)]:
                brute(x, out, me, snake(k), i, count)
    elif value is not None:
        me, count[0] = count[0], count[0] + 1
        out.append((me, parent, label, at, "scalar", value if isinstance(value, str) else json.dumps(value)))


def tree(rng, depth=0):
    if depth > 3 or rng.random() < 0.3:
        return rng.choice(["s", "", "long " * 3, 1, 2.5, True, None])
    if rng.random() < 0.5 and depth:
        return [{"k": tree(rng, depth + 2)} for _ in range(rng.randrange(3))]
    return {rng.choice(["aB", "c_d", "Efg", "h-i", "jKl"]) + str(i): tree(rng, depth + 1) for i in range(rng.randrange(1, 4))}


def test_shred_is_complete(spark):
    rng = random.Random(7)
    trees = [{"root": tree(rng)} for _ in range(60)]
    for t in trees:
        want = []
        brute(t, want)
        assert list(nodes_of(t)) == want
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "d int, p string")
    adj = shred(df, "d", "p")
    want = sum(len(list(nodes_of(t))) for t in trees)
    assert adj.count() == want
    objects = sum(1 for t in trees for n in nodes_of(t) if n[4] == "object")
    assert entities(adj, ["k"]).count() == objects


def test_objects_in_one_step(spark):
    """The join on the spot gives what the adjacency table joined with itself gives, node numbers apart."""
    rng = random.Random(12)
    trees = [{"root": tree(rng)} for _ in range(80)] + [[{"aB0": 1}, [{"aB0": "in a list"}]], '[{"aB0": "text"}]']
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)] + [(999, None), (998, "{")], "d int, p string")
    names = ["k", "a_b0", "efg1", "c_d2"]
    both = []
    for e in (entities(shred(df, "d", "p"), names), shred_objects(df, "d", "p", names)):
        out: dict = {}
        for r in sorted(e.collect(), key=lambda r: (r.doc, r.node)):
            out.setdefault(r.doc, []).append((r.parent is None, r.label, r.ordinal, r.k, r.a_b0, r.efg1, r.c_d2))
        both.append(out)
    assert both[0] == both[1] and len(both[0]) > 60


def test_entities_pivot(spark):
    df = spark.createDataFrame([("x", '{"id": 7, "child": [{"id": "c0", "note": null}, {"other": 1}]}')], "d string, p string")
    rows = sorted((r.node, r.parent, r.label, r.ordinal, r.id) for r in entities(shred(df, "d", "p"), ["id"]).collect())
    assert [(r[1], r[2], r[3], r[4]) for r in rows] == [(None, "", 0, "7"), (0, "child", 0, "c0"), (0, "child", 1, None)]
    assert parse("Infinity") is None and parse("1") == (1,)
    assert [snake(x) for x in ("siemAlerts", "APIKey", "net-flow", "a_b")] == ["siem_alerts", "api_key", "net_flow", "a_b"]


# --- filling --------------------------------------------------------------------------------------------------

SPEC = {"sev": Category(("hi", "lo")), "x": Numeric(0.0, 10.0, "y", (("low", 5.0), ("high", None))), "y": Numeric(0.0, 1.0)}


def test_fill_missing_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        g, m = rng.choice(["A", "A", "A", "B", "C", None]), rng.choice(["1", "2", None])
        rows.append((i, g, m, rng.choice(["HI", " lo ", "?", None]), rng.choice([None, -1.0, float("nan"), 11.0, *[round(rng.random() * 10, 1) for _ in range(6)]]), rng.choice([None, 2.0, round(rng.random(), 2)])))
    rows.append((999, "D", "1", None, None, None))
    df = spark.createDataFrame(rows, "id bigint, g string, m string, sev string, x double, y double").withColumn("field", F.lit("clash")).withColumn("step", F.lit(1)).withColumn("v", F.lit("w"))
    got = {(r.id, r.field): r for r in fill_missing(df, "id", ("g", "m"), SPEC).collect()}

    def known(r):
        s = (r[3] or "").strip().lower()
        return {"sev": s if s in ("hi", "lo") else None, "x": r[4] if r[4] is not None and 0 <= r[4] <= 10 else None, "y": r[5] if r[5] is not None and 0 <= r[5] <= 1 else None}

    data = [(r[0], (r[1], r[2]), known(r)) for r in rows]
    by = {r[0]: r for r in data}
    cells = {(i, f) for i, _, k in data for f in SPEC if k[f] is None}
    assert set(got) == cells
    steps = lambda v, hi: max(0, min(255, math.floor(v / hi * 256)))
    pairs: dict = {}
    for _, g, k in data:
        if k["x"] is not None and k["y"] is not None:
            pairs.setdefault(g[0], []).append((k["y"], k["x"]))
    top = sum(sum(a * b for a, b in p) - sum(a for a, _ in p) * sum(b for _, b in p) / len(p) for p in pairs.values())
    low = sum(sum(a * a for a, _ in p) - sum(a for a, _ in p) ** 2 / len(p) for p in pairs.values())

    def own(k, g):
        """The prediction of x: the finest group's median and the slope on y."""
        xs = [j["x"] for _, h, j in data if h == g and None not in g and j["x"] is not None]
        ys = [j["y"] for _, h, j in data if h == g and None not in g and j["y"] is not None]
        if not xs:
            return None
        return statistics.median(xs) + (top / low * (k["y"] - statistics.mean(ys)) if k["y"] is not None else 0.0)

    for (i, f), r in got.items():
        g = by[i][1]
        for level in (2, 1, 0):
            if None in g[:level]:
                continue
            pool = [k[f] for _, h, k in data if h[:level] == g[:level] and k[f] is not None and None not in h[:level]]
            if pool:
                break
        assert r.level == level
        donors = [by[d] for d in (r.donor_id, r.donor_id_2) if d is not None]
        assert all(d[1][:level] == g[:level] and d[2][f] is not None for d in donors)
        if f == "sev":
            best = max(("hi", "lo"), key=lambda s: (pool.count(s), s == "hi"))
            assert r.predicted == best == r.filled == r.label == donors[0][2]["sev"] and len(donors) == 1
        elif f == "y":
            assert abs(float(r.predicted) - statistics.median(pool)) < 1e-9 and abs(float(r.filled) - statistics.median(pool)) < 1e-9
            assert abs(statistics.mean(d[2]["y"] for d in donors) - statistics.median(pool)) < 1e-9
            assert all(d[0] == min(j for j, h, k in data if h[:level] == g[:level] and k["y"] == d[2]["y"]) for d in donors)
        else:
            assert float(r.filled) == donors[0][2]["x"] and len(donors) == 1 and r.label == ("low" if float(r.filled) < 5 else "high")
            mine = own(by[i][2], g)
            mine = statistics.median(pool) if mine is None else mine
            assert abs(float(r.predicted) - mine) < 1e-9
            far = {j: abs(steps(own(k, h), 10) - steps(mine, 10)) for j, h, k in data if h[:level] == g[:level] and k["x"] is not None and own(k, h) is not None}
            assert far[r.donor_id] == min(far.values())


def test_fill_missing_edges(spark):
    schema = "id bigint, g string, m string, sev string, x double, y double"
    assert fill_missing(spark.createDataFrame([], schema), "id", ("g", "m"), SPEC).count() == 0
    one = fill_missing(spark.createDataFrame([(1, "A", "1", None, None, None), (2, "A", "1", "hi", 1.0, 0.5), (3, "A", "1", None, 4.0, 0.5)], schema), "id", ("g", "m"), {"x": Numeric(0.0, 10.0)}, back_off=False)
    assert [(r.id, r.donor_id, r.donor_id_2, r.filled) for r in one.collect()] == [(1, 2, 3, "2.5")]
    none = fill_missing(spark.createDataFrame([(1, "A", "1", None, None, None), (None, "A", "1", "hi", 1.0, 1.0)], schema), "id", ("g", "m"), SPEC)
    assert {(r.field, r.level, r.filled, r.label) for r in none.collect()} == {(f, None, None, None) for f in SPEC}


# --- zones, validation, jobs ----------------------------------------------------------------------------------


def test_zone_values(spark):
    rows = [("a", "10.1.2.3", None, []), ("b", "10.0.0.9", "dmz-web", []), ("c", "10.10.0.1", "web1", []), ("d", None, None, ["nginx", "sql-server", "apache"]), ("e", "300.1.1.1", "", None), ("f", None, None, None)]
    df = spark.createDataFrame(rows, "id string, ip string, host string, services array<string>").withColumn("vlan", F.when(F.col("id") == "f", 500)).withColumn("cloud", F.lit(None).cast("string"))
    got = {r.id: (r.zone, round(r.confidence, 6)) for r in zones.detect(df, "id", "ip", "host", "services", "vlan", "cloud").collect()}
    assert got == {"a": ("internal", 0.9), "b": ("dmz", 0.825), "c": ("restricted", 0.45), "d": ("dmz", 0.6), "e": ("unknown", 0.0), "f": ("restricted", 0.85)}
    assert [r.n for r in spark.createDataFrame([("1.2.3.4",), ("1.2.3",), ("1.2.3.256",), ("x",), (None,)], "ip string").select(zones.ip_number(F.col("ip")).alias("n")).collect()] == [16909060, None, None, None, None]


def test_zone_rules_can_be_extended(spark):
    rules = zones.ZoneRules()
    rules.add("hostname", "^lab", "lab", 0.9)
    rules.add("cidr", "0.0.0.0/0", "outside", 0.2)
    rules.add_zone("plant", ("10.77.0.0/16",), (777,))
    df = spark.createDataFrame([("a", "8.8.8.8", "lab-1", 777)], "id string, ip string, host string, vlan int").withColumn("services", F.array().cast("array<string>"))
    assert zones.detect(df, "id", "ip", "host", "services", "vlan", rules=rules).first().zone == "lab"
    assert zones.detect(df, "id", "ip", "host", "services", "vlan").first().zone == "unknown"


@pytest.mark.parametrize(
    "misconfig,detected,raw,want",
    [
        ("VMX", True, {}, (0.5, "medium", True)),
        ("VM008", True, {"sshd_config": "PermitRootLogin prohibit-password\nPasswordAuthentication no"}, (0.0, "high", False)),
        ("VM016", True, {"suid_sgid": "/usr/bin/sudo"}, (0.0, "high", False)),
        ("VM016", True, {"suid_sgid": ""}, (0.7, "low", True)),
        ("VM019", True, {"hostname": "docker-1"}, (0.0, "high", False)),
        ("VMX", False, {}, (1.0, "low", True)),
    ],
)
def test_validation_values(spark, misconfig, detected, raw, want):
    df = spark.createDataFrame([(misconfig, detected, None, "Linux", "corp", raw)], "misconfig_id string, detected boolean, evidence string, os string, zone string, raw map<string,string>")
    r = validation.validate(df).first()
    assert (r.confidence, r.risk, r.validated) == want
    if misconfig == "VMX" and detected:
        rules = validation.default_rules()
        rules.add("VMX", lambda: F.col("zone") == "corp", 0.4)
        rules.mark_false_positive("VMX", "Linux:Corp")
        assert validation.validate(df, rules).first().confidence == 0.6


def test_firewall_inactive_is_not_active(spark):
    df = spark.createDataFrame([({"firewall_ufw": "Status: inactive"},), ({"firewalld_status": "active (running)", "listening": "a:80 b:80 c:443"},)], "raw map<string,string>")
    rows = validation.context(df).collect()
    assert [r.firewall_active for r in rows] == [False, True] and rows[1].ports == [80, 443]


def test_job_values(spark):
    one = spark.range(1)
    lit = F.lit
    p = jobs.priority(lit("critical"), lit("dmz"), lit(5), lit(True), lit(None).cast("bigint"), lit("restricted"), lit(2), lit(0))
    assert one.select(p.alias("p")).first().p == 1320
    w = [(1, t, 10, 2 if t == 0 else 0, 0) for t in range(0, 20)]
    r = jobs.aimd(spark.createDataFrame(w, "k int, t bigint, n int, errors int, timeouts int"), "k", ["t"]).first()
    assert (r.cuts, r.raises, r.rate) == (1, 3, 16)
    nxt = lambda e, t: one.select(jobs.next_cron(e, lit(t).cast("timestamp")).alias("n")).first().n
    assert nxt("*/15 * * * *", "2025-03-01 10:07:00") == datetime(2025, 3, 1, 10, 15)
    assert nxt("0 0 29 2 *", "2025-03-01 00:00:00") is None
    assert nxt("30 4 * * 1-5", "2025-03-01 10:07:00") == datetime(2025, 3, 3, 4, 30)
    with pytest.raises(ValueError):
        jobs.cron_field("61", 0, 59)


# --- graph ----------------------------------------------------------------------------------------------------


def asset(i, type_, zone, crit, internet=False, domain=True, findings=()):
    f = [{"id": x[0], "title": None, "description": None, "category": x[1], "severity": x[2], "cvss": None, "epss": None, "exploit_available": x[3]} for x in findings]
    return {"id": i, "name": i, "type": type_, "ip": None, "zone": zone, "criticality": crit, "internet_facing": internet, "domain_joined": domain, "services": None, "data_sensitivity": None,
            "misconfigurations": f, "evidence": None, "business_unit": None, "annual_revenue_exposure": None, "ingested_at": DAY(1)}


def assets(spark, sf, rows):
    return spark.createDataFrame(rows, spark.read.parquet(f"{sf}/assets.parquet").select(*rows[0]).schema)


def test_edge_values(spark, sf):
    z = ("m", "authorization", None, False)
    inv = inventory(assets(spark, sf, [asset("s", "file_server", "internal", 3), asset("t", "domain_controller", "restricted", 5, findings=[z, ("n", "authorization", None, False)])]))
    lk = {r.technique: round(r.likelihood, 6) for r in edges.likelihoods(inv).where("asset_id = 't'").collect()}
    assert lk == {"exploit": 0.3, "lateral": 0.3, "credential_theft": 0.3, "privilege_escalation": 0.5, "data_exfiltration": 0.5}
    got = {(r.profile, r.src, r.tgt): (r.technique, round(r.posterior, 6)) for r in edges.adjacency(inv).collect()}
    assert got["apt", "s", "t"] == ("privilege_escalation", 0.498176)
    assert got["ransomware", "s", "t"] == ("credential_theft", 0.48216)
    assert got["insider", "s", "t"] == ("privilege_escalation", 0.540512)


def test_top_finding_and_duplicates(spark, sf):
    inv = top_finding(inventory(assets(spark, sf, [asset("a", "x", "corp", 1, findings=[("b", "network", "high", False), (" B ", "network", "critical", True), ("c", "network", "high", False), (None, None, None, None)]), asset("e", "x", "corp", 1)])))
    rows = {r.id: r for r in inv.collect()}
    assert [f.finding_id for f in rows["a"].findings] == ["B", "C"] and rows["a"].top.finding_id == "B" and rows["e"].top is None


def all_simple(adj, start, goals, depth=7):
    out, stack = set(), [(start,)]
    while stack:
        p = stack.pop()
        if len(p) > 1 and p[-1] in goals or (len(p) == 1 and p[0] in goals):
            if len(p) >= 4:
                out.add(">".join(p))
            continue
        if len(p) <= depth:
            stack += [(*p, t) for t in adj.get(p[-1], ()) if t not in p]
    return out


def test_wide_beam_is_exhaustive(spark):
    rng = random.Random(5)
    nodes = [f"n{i}" for i in range(8)]
    pairs = [(a, b, "lateral", round(rng.uniform(0.3, 0.9), 3)) for a in nodes for b in nodes if a != b and rng.random() < 0.45]
    adj = spark.createDataFrame(pairs, "src string, tgt string, technique string, posterior double")
    goals, start = ["n6", "n7"], "n0"
    found = path_search.search(adj, spark.createDataFrame([(start,)], "id string"), spark.createDataFrame([(g,) for g in goals], "id string"), beam=10_000)
    rows = found.collect()
    near = {}
    for a, b, *_ in pairs:
        near.setdefault(a, []).append(b)
    assert {">".join(r.path) for r in rows} == all_simple(near, start, goals)
    assert all(4 <= len(r.path) <= 8 and len(set(r.path)) == len(r.path) for r in rows)
    d = {r.id: r.dist for r in targets.target_distances(adj, spark.createDataFrame([("n7",)], "id string")).collect()}
    want, ring = {"n7": 0}, {"n7"}
    while ring:
        ring = {a for a, b, *_ in pairs if b in ring and a not in want}
        want |= {a: max(want.values()) + 1 for a in ring}
    assert d == want


def test_no_path_from_dmz_to_restricted(spark, sf):
    rows = [asset("1", "web_server", "dmz", 3, True, findings=[("a", "service", "high", False)]), asset("2", "file_server", "internal", 3, findings=[("a", "service", "high", False)]), asset("3", "domain_controller", "restricted", 5, findings=[("a", "authorization", "high", False)])]
    inv = top_finding(inventory(assets(spark, sf, rows)))
    found = path_search.search(edges.adjacency(inv, ("apt",)), inv.where("id = '1'").select("id"), inv.where(targets.is_target()).select("id"))
    assert found.count() == 0


def test_path_score_values(spark):
    node = "struct<asset_type:string,asset_zone:string,criticality:int,internet_facing:boolean>"
    edge = "struct<technique:string,probability:double,confidence_interval:array<double>>"
    n = [("file_server", z, c, i == 0) for i, (z, c) in enumerate([("mgmt", 4), ("mgmt", 4), ("corp", 4), ("restricted", 5)])]
    e = [(t, 0.5, [0.4, 0.6]) for t in ("lateral", "credential_theft", "privilege_escalation")]
    df = spark.createDataFrame([("p", n, e), ("q", [], [])], f"path_id string, nodes array<{node}>, edges array<{edge}>")
    p, q = path_scores.scored(df).orderBy("path_id").collect()
    assert (round(p.impact, 9), round(p.effort, 9), round(p.detection, 9)) == (55.0, 6.0, 0.12)
    assert (p.ci_low, round(p.ci_high, 6)) == (0.01, 0.298205)
    assert p.signature == "file_server:mgmt|credential_theft+lateral+privilege_escalation|file_server:restricted|mgmt→corp→restricted"
    assert p.phases == ["Reconnaissance", "Installation", "Command & Control", "Lateral Movement", "Credential Access", "Privilege Escalation"]
    assert (q.probability, q.ci_low, q.ci_high) == (1.0, 0.5, 0.5)
