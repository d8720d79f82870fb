"""Queries over the inventory and over transitions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import edges, inventory as inv_ops
from ..session import materialise, table
from . import sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def inv(spark, sf_dir, *need):
    """The inventory with the columns ``need`` besides the id (all by default), zones and types as the reference list writes them."""
    return inv_ops.inventory(table(spark, sf_dir, "assets"), table(spark, sf_dir, "canon_ref"), need)


SCORED = ("type", "zone", "criticality", "internet_facing", "domain_joined", "findings", "siem", "intel")  # what transitions are scored by


W = sql.with_(*sql.BASE)
SEV = "(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)"


@query(W + "SELECT id, type, zone, criticality, internet_facing, domain_joined, sensitivity, siem, intel, coalesce(len(services), 0) AS n_services, (SELECT count(*) FROM fnd WHERE asset_id = id) AS n_findings FROM inv")
def asset_inventory(spark, sf_dir):
    return inv(spark, sf_dir, "type", "zone", "criticality", "internet_facing", "domain_joined", "sensitivity", "siem", "intel", "services", "findings").select("id", "type", "zone", "criticality", "internet_facing", "domain_joined", "sensitivity", "siem", "intel", F.size("services").alias("n_services"), inv_ops.n_findings().alias("n_findings"))


@query("WITH " + sql.INV + """ SELECT field_name, value, count(*) AS n FROM (
  SELECT unnest([{'field_name': 'zone', 'value': coalesce(trim(zone), '')}, {'field_name': 'type', 'value': coalesce(trim(type), '')}], recursive := true)
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM assets) WHERE rn = 1) v
WHERE NOT EXISTS (SELECT 1 FROM canon c WHERE c.field_name = v.field_name AND c.key = """ + sql.KEY("v.value") + ") GROUP BY ALL")
def unmapped_names(spark, sf_dir):
    return inv_ops.unmapped_names(table(spark, sf_dir, "assets"), table(spark, sf_dir, "canon_ref"))


@query(W + "SELECT * FROM fnd")
def finding_inventory(spark, sf_dir):
    return inv_ops.findings_of(inv(spark, sf_dir, "findings"))


@query(W + f"SELECT asset_id, finding_id, severity FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY {SEV} DESC, pos) AS rn FROM fnd) WHERE rn = 1")
def top_findings(spark, sf_dir):
    t = inv_ops.top_finding(inv(spark, sf_dir, "findings")).where("top IS NOT NULL")
    return t.select(F.col("id").alias("asset_id"), "top.finding_id", "top.severity")


@query(W + "SELECT id, name, type, ip FROM inv WHERE zone = 'dmz' AND (contains(lower(name), 'web') OR contains(lower(type), 'web') OR contains(lower(coalesce(ip, '')), 'web')) ORDER BY id LIMIT 200")
def asset_search(spark, sf_dir):
    """The inventory page's search: one zone, a text in name, type or address, at most 200 rows on the page."""
    hit = F.contains(F.lower("name"), F.lit("web")) | F.contains(F.lower("type"), F.lit("web")) | F.contains(F.lower(F.coalesce("ip", F.lit(""))), F.lit("web"))
    return inv(spark, sf_dir, "name", "type", "ip", "zone").where((F.col("zone") == "dmz") & hit).orderBy("id").limit(200).select("id", "name", "type", "ip")


def _share(df, key):
    # the total comes from the few counted groups, not from a second pass over the rows
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).select(key, "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("pct"))


@query(W + "SELECT severity, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM fnd), 6) AS pct FROM fnd GROUP BY severity")
def findings_by_severity(spark, sf_dir):
    return _share(inv_ops.findings_of(inv(spark, sf_dir, "findings")), "severity")


@query(W + "SELECT category, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM fnd), 6) AS pct FROM fnd GROUP BY category")
def findings_by_category(spark, sf_dir):
    return _share(inv_ops.findings_of(inv(spark, sf_dir, "findings")), "category")


ZONE_GROUPS = {"dmz": "edge", "internet": "edge", "prod": "production", "dev": "development", "staging": "development", "corp": "corporate", "internal": "corporate", "cloud": "cloud"}


@query(W + "SELECT zone_group, zone, count(*) AS assets, count(*) FILTER (internet_facing) AS exposed, count(*) FILTER (criticality >= 4) AS critical, grouping(zone) AS is_total FROM (SELECT *, "
       + fixed.sql_case("split_part(zone, '-', 1)", ZONE_GROUPS, "protected") + " AS zone_group FROM inv) GROUP BY ROLLUP (zone_group, zone)")
def zone_rollup(spark, sf_dir):
    g = fixed.switch(F.substring_index("zone", "-", 1), ZONE_GROUPS, "protected")
    r = inv(spark, sf_dir, "zone", "internet_facing", "criticality").withColumn("zone_group", g).rollup("zone_group", "zone")
    return r.agg(F.count(F.lit(1)).alias("assets"), F.count_if("internet_facing").alias("exposed"), F.count_if(F.col("criticality") >= 4).alias("critical"), F.grouping("zone").cast("bigint").alias("is_total"))


@query(W + "SELECT count(*) AS assets, (SELECT count(*) FROM fnd) AS findings, count(*) FILTER (internet_facing) AS exposed, count(DISTINCT zone) AS zones FROM inv")
def environment_kpis(spark, sf_dir):
    # zones first: one row per zone crosses the network, not one per asset
    per = inv(spark, sf_dir, "zone", "internet_facing", "findings").groupBy("zone").agg(F.count(F.lit(1)).alias("a"), F.sum(inv_ops.n_findings()).alias("f"), F.count_if("internet_facing").alias("x"))
    return per.agg(F.sum("a").alias("assets"), F.sum("f").alias("findings"), F.sum("x").alias("exposed"), F.count(F.lit(1)).alias("zones"))


@query(W + """, a AS (SELECT id, 'exposed' AS stratum, 0 AS o FROM inv WHERE internet_facing ORDER BY id LIMIT 15),
b AS (SELECT id, 'critical' AS stratum, 1 AS o FROM inv WHERE NOT internet_facing AND criticality >= 4 ORDER BY id LIMIT 25),
c AS (SELECT id, 'rest' AS stratum, 2 AS o FROM inv WHERE id NOT IN (SELECT id FROM a UNION ALL SELECT id FROM b) ORDER BY id LIMIT 80)
SELECT id, stratum FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) ORDER BY o, id LIMIT 80""")
def stratified_sample(spark, sf_dir):
    return inv_ops.capped_sample(inv(spark, sf_dir, "internet_facing", "criticality")).select("id", "stratum")


@query(W + "SELECT i.id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM inv i LEFT JOIN fnd f ON f.asset_id = i.id GROUP BY i.id")
def severity_histogram(spark, sf_dir):
    return inv(spark, sf_dir, "findings").select("id", *[inv_ops.n_findings(inv_ops.of_severity(s)).alias(s) for s in inv_ops.SEVERITY_RANK])


@query(W + "SELECT id, name, criticality FROM inv ORDER BY criticality DESC, id LIMIT 100")
def top_assets_by_criticality(spark, sf_dir):
    return inv(spark, sf_dir, "name", "criticality").orderBy(F.desc("criticality"), "id").limit(100).select("id", "name", "criticality")


COARSE = {"dmz": 0, "internal": 1, "restricted": 2, "cloud": 3}


@query(W + f"SELECT id, CAST(row_number() OVER (ORDER BY {fixed.sql_case('zone', COARSE, 1)}, criticality DESC, id) AS BIGINT) AS place FROM inv")
def target_order(spark, sf_dir):
    """Scan order of all targets: zone rank, then criticality."""
    from ..operators.ordering import numbered

    rows = inv(spark, sf_dir, "criticality", "zone").select("id", "criticality", fixed.switch(F.col("zone"), COARSE, 1).alias("zr"))
    return numbered(rows, ["zr", F.desc("criticality"), "id"], "place").select("id", "place")


@query(W + f"SELECT {fixed.sql_case('lower(type)', fixed.tiers(), 2)} AS tier, count(*) AS assets, count(*) FILTER (lower(type) IN ({', '.join(map(fixed.quoted, fixed.TERMINAL_TYPES.split()))})) AS terminal FROM inv GROUP BY 1")
def asset_tiers(spark, sf_dir):
    t = F.lower("type")
    return inv(spark, sf_dir, "type").groupBy(inv_ops.tier(F.col("type")).alias("tier")).agg(F.count(F.lit(1)).alias("assets"), F.count_if(t.isin(*fixed.TERMINAL_TYPES.split())).alias("terminal"))


@query(W + """SELECT i.id, f.finding_id, i.criticality * (CASE f.severity WHEN 'critical' THEN 4 ELSE 3 END) AS base FROM inv i JOIN fnd f ON f.asset_id = i.id
WHERE f.severity IN ('critical', 'high') AND (internet_facing OR zone IN ('dmz', 'mgmt') OR (criticality >= 4 AND zone IN ('corp', 'staging')))""")
def entry_candidates(spark, sf_dir):
    from ..operators.targets import entry_candidates as candidates

    return candidates(inv(spark, sf_dir, "zone", "criticality", "internet_facing", "findings")).select("id", "finding_id", "base")


GRAPH = sql.with_(*sql.GRAPH)


def _graph_inventory(spark, sf_dir):
    """What transitions are scored by, written once: sources, targets and classes all come from it."""
    return materialise(inv(spark, sf_dir, *SCORED), "inventory")


@query(sql.with_(sql.INV, sql.FND, sql.TECH, sql.CATTECH, sql.LK) + "SELECT asset_id, technique, round(likelihood, 6) AS likelihood FROM lk")
def likelihood(spark, sf_dir):
    return edges.likelihoods(inv(spark, sf_dir, "findings", "siem", "intel")).withColumn("likelihood", F.round("likelihood", 6))


@query(GRAPH + "SELECT profile, src, tgt, technique, round(posterior, 6) AS posterior, k FROM adj")
def edge_topk(spark, sf_dir):
    return edges.adjacency(_graph_inventory(spark, sf_dir)).withColumn("posterior", F.round("posterior", 6))


@query(GRAPH + "SELECT profile, (SELECT count(*) FROM inv) AS nodes, count(*) AS edges, round(avg(posterior), 6) AS avg_posterior, round(count(*) / greatest((SELECT count(*) FROM inv), 1)::DOUBLE, 6) AS branching FROM edges GROUP BY profile")
def edge_statistics(spark, sf_dir):
    return edges.edge_statistics(_graph_inventory(spark, sf_dir))


@query(GRAPH + "SELECT profile, src, tgt, technique, round(posterior, 6) AS posterior FROM edges")
def transition_list(spark, sf_dir):
    """Every transition that passes, not the strongest of each asset alone."""
    return edges.all_transitions(_graph_inventory(spark, sf_dir)).withColumn("posterior", F.round("posterior", 6))


@query(GRAPH + "SELECT (SELECT count(*) FROM prior) AS candidates, (SELECT count(*) FROM base) AS passed, (SELECT count(*) FROM prior) - (SELECT count(*) FROM base) AS pruned")
def pruned_candidates(spark, sf_dir):
    return edges.pruned(_graph_inventory(spark, sf_dir))


@query(GRAPH + """SELECT profile, src, tgt, technique, round(greatest(0, posterior - 0.1::DOUBLE), 6) AS ci_low, round(least(1, posterior + 0.1::DOUBLE), 6) AS ci_high,
  CASE technique WHEN 'exploit' THEN 'Initial Access' WHEN 'lateral' THEN 'Lateral Movement' WHEN 'credential_theft' THEN 'Credential Theft' WHEN 'privilege_escalation' THEN 'Privilege Escalation' ELSE 'Data Exfiltration' END AS label,
  'vulnerability_scanner' AS evidence_sources FROM adj""")
def edge_details(spark, sf_dir):
    """The kept transitions as they are reported: interval, display name, evidence."""
    a, p = edges.adjacency(_graph_inventory(spark, sf_dir)), F.col("posterior")
    names = fixed.switch(F.col("technique"), {t: label for t, _, label in fixed.techniques()}, "unknown")
    lo, hi = F.round(F.greatest(F.lit(0.0), p - 0.1), 6), F.round(F.least(F.lit(1.0), p + 0.1), 6)
    return a.select("profile", "src", "tgt", "technique", lo.alias("ci_low"), hi.alias("ci_high"), names.alias("label"), F.lit("vulnerability_scanner").alias("evidence_sources"))


@query(GRAPH + """SELECT profile, technique, count(*) AS n, round(avg(posterior), 6) AS avg_posterior, round(avg(least(1, posterior + 0.1::DOUBLE) - greatest(0, posterior - 0.1::DOUBLE)), 6) AS ci_width,
count(*) FILTER (least(1, posterior + 0.1::DOUBLE) - greatest(0, posterior - 0.1::DOUBLE) < 0.3) AS high_confidence,
count(*) FILTER (least(1, posterior + 0.1::DOUBLE) - greatest(0, posterior - 0.1::DOUBLE) > 0.5) AS low_confidence FROM adj GROUP BY ALL""")
def edge_confidence(spark, sf_dir):
    lo, hi = F.greatest(F.lit(0.0), F.col("posterior") - 0.1), F.least(F.lit(1.0), F.col("posterior") + 0.1)
    a = edges.adjacency(_graph_inventory(spark, sf_dir))
    return a.groupBy("profile", "technique").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("posterior"), 6).alias("avg_posterior"), F.round(F.avg(hi - lo), 6).alias("ci_width"), F.count_if(hi - lo < 0.3).alias("high_confidence"), F.count_if(hi - lo > 0.5).alias("low_confidence")
    )
