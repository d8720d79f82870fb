"""SQL shared by the checks: the inventory in its normal form, and fixed tables as VALUES."""

from __future__ import annotations

from ..functions import fixed

KEY = lambda c: f"array_to_string(list_sort(string_split(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')), '-')"
INV = f"""canon AS (
  SELECT field_name, key, min(canonical) AS canonical FROM (
    SELECT field_name, canonical, {KEY('way')} AS key FROM (SELECT field_name, canonical, unnest(list_concat([canonical, display_name], coalesce(aliases, []))) AS way FROM canon_ref))
  WHERE key <> '' GROUP BY field_name, key HAVING count(DISTINCT canonical) = 1),
inv AS (
  SELECT id, name, ip, coalesce(t.canonical, nullif(trim(type), ''), 'unknown') AS type, coalesce(z.canonical, nullif(trim(zone), ''), 'unknown') AS zone, coalesce(criticality, 0) AS criticality,
    coalesce(internet_facing, false) AS internet_facing, coalesce(domain_joined, false) AS domain_joined, services, misconfigurations,
    coalesce(data_sensitivity, 'user_data') AS sensitivity, coalesce(evidence.siem_alerts.confidence, 0) AS siem,
    coalesce(evidence.threat_intelligence.confidence, 0) AS intel, business_unit, annual_revenue_exposure AS revenue,
    {" + ".join(f"(coalesce(evidence.{x}.confidence, 0) > 0)::INT" for x in ("vulnerability_scanner", "siem_alerts", "threat_intelligence", "historical_attacks", "network_flow"))} AS sources
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM assets) a
  LEFT JOIN canon t ON t.field_name = 'type' AND t.key = {KEY('a.type')} LEFT JOIN canon z ON z.field_name = 'zone' AND z.key = {KEY('a.zone')} WHERE rn = 1)"""
FND = """fnd AS (
  SELECT asset_id, pos, finding_id, title, category, severity, cvss, epss, exploit_available FROM (
    SELECT *, row_number() OVER (PARTITION BY asset_id, finding_id ORDER BY pos) AS rn FROM (
      SELECT id AS asset_id, pos - 1 AS pos, upper(trim(m.id)) AS finding_id, m.title AS title, lower(m.category) AS category,
        lower(coalesce(m.severity, 'high')) AS severity, m.cvss AS cvss, m.epss AS epss, coalesce(m.exploit_available, false) AS exploit_available
      FROM (SELECT id, generate_subscripts(misconfigurations, 1) AS pos, unnest(misconfigurations) AS m FROM inv)) WHERE finding_id IS NOT NULL) WHERE rn = 1)"""
TECH = "tech AS (SELECT * FROM " + fixed.values([(i, t, b) for i, (t, b, _) in enumerate(fixed.techniques())], "v", "ti, technique, base") + ")"
PROFILE = "prof AS (SELECT * FROM " + fixed.values([(p, t, m) for p, ts in fixed.profiles().items() for t, m in ts.items()], "v", "profile, technique, mult") + ")"
CATTECH = "cattech AS (SELECT * FROM " + fixed.values([(c, t) for c, ts in fixed.groups(fixed.CATEGORY_TECHNIQUES) for t in ts], "v", "category, technique") + ")"
_HOPS = fixed.zone_distances()
REACH = "reach AS (SELECT * FROM " + fixed.values([(a, b, _HOPS.get((a, b), 99)) for a, b in fixed.reach()], "v", "rs, rt, dist") + ")"

_known = ", ".join(fixed.quoted(c) for c, _ in fixed.groups(fixed.CATEGORY_TECHNIQUES))
LK = f"""lk AS (
  SELECT id AS asset_id, ti, technique, CASE WHEN n = 0 THEN 0.3::DOUBLE ELSE
    CASE WHEN intel > 0 THEN least(l1 + intel * 0.05::DOUBLE, 0.95::DOUBLE) ELSE l1 END END AS likelihood
  FROM (SELECT *, CASE WHEN siem > 0 THEN least(l0 + siem * 0.1::DOUBLE, 0.95::DOUBLE) ELSE l0 END AS l1 FROM (
    SELECT i.id, i.siem, i.intel, t.ti, t.technique, count(f.finding_id) AS n,
      least(count(f.finding_id) * 0.15::DOUBLE + count(*) FILTER (f.severity = 'critical' AND f.exploit_available) * 0.25::DOUBLE
        + count(*) FILTER (f.severity = 'high') * 0.1::DOUBLE, 0.95::DOUBLE) AS l0
    FROM inv i CROSS JOIN tech t LEFT JOIN fnd f ON f.asset_id = i.id AND (
      f.category IS NULL OR f.category NOT IN ({_known}) OR EXISTS (SELECT 1 FROM cattech c WHERE c.category = f.category AND c.technique = t.technique))
    GROUP BY ALL)))"""


def _affinity() -> str:
    arms = []
    for row in fixed.AFFINITY_TYPES.strip().splitlines():
        t, factor, *types = row.split()
        arms.append(f"WHEN technique = '{t}' AND b.type IN ({', '.join(map(fixed.quoted, types))}) THEN {factor}::DOUBLE")
    t, factor, *zones = fixed.AFFINITY_ZONES.split()
    arms.append(f"WHEN technique = '{t}' AND b.zone IN ({', '.join(map(fixed.quoted, zones))}) THEN {factor}::DOUBLE")
    return "(CASE " + " ".join(arms) + " ELSE 1::DOUBLE END)"


def _floor(dist: str) -> str:
    zones = ", ".join(map(fixed.quoted, fixed.SENSITIVE_ZONES.split()))
    return (
        f"greatest(0.25::DOUBLE, least(0.55::DOUBLE, 0.5::DOUBLE - (CASE b.criticality WHEN 5 THEN 0.15::DOUBLE WHEN 4 THEN 0.1::DOUBLE WHEN 3 THEN 0.05::DOUBLE ELSE 0::DOUBLE END)"
        f" - (CASE WHEN b.zone IN ({zones}) THEN 0.08::DOUBLE ELSE 0::DOUBLE END) + (CASE WHEN {dist} >= 2 THEN 0.05::DOUBLE ELSE 0::DOUBLE END))) - 1e-9"
    )


_zones = ", ".join(fixed.quoted(z) for z, _ in fixed.groups(fixed.ZONE_REACH))
#: All passing transitions, pair by pair: what the class-wise operator must agree with.
EDGES = f"""pairs AS (
  SELECT a.id AS src, b.id AS tgt, b.type, b.zone, b.criticality, dist,
    (CASE dist WHEN 0 THEN 1::DOUBLE ELSE pow(0.6::DOUBLE, dist) END) * (CASE WHEN a.internet_facing THEN 1.4::DOUBLE ELSE 1::DOUBLE END)
      * (CASE WHEN a.domain_joined AND b.domain_joined THEN 1.2::DOUBLE ELSE 1::DOUBLE END) AS common
  FROM inv a JOIN (SELECT rs, rt, dist FROM reach UNION ALL SELECT DISTINCT zone, zone, 0 FROM inv WHERE zone NOT IN ({_zones})) r ON a.zone = r.rs
  JOIN inv b ON b.zone = r.rt WHERE a.id <> b.id),
xp AS (SELECT asset_id, count(*) FILTER (severity = 'critical' AND exploit_available) AS x FROM fnd GROUP BY asset_id),
prior AS (
  SELECT b.src, b.tgt, b.criticality, b.zone, b.dist, t.ti, technique, l.likelihood AS lk,
    t.base * (1 + b.criticality * 0.08::DOUBLE) * (1 + coalesce(x, 0) * 0.15::DOUBLE) * {_affinity()} * common AS p
  FROM pairs b CROSS JOIN tech t JOIN lk l USING (ti, technique) LEFT JOIN xp ON xp.asset_id = b.tgt WHERE l.asset_id = b.tgt),
base AS (SELECT * FROM (SELECT *, round(least(greatest(least(p, 0.95::DOUBLE) * 0.3::DOUBLE + lk * 0.7::DOUBLE, 0.05::DOUBLE), 0.98::DOUBLE), 9) AS q FROM prior b)
  b WHERE q >= {_floor('dist')}),
scored AS (SELECT profile, src, tgt, ti, technique, criticality, zone,
    round(least(greatest(least(least(p, 0.95::DOUBLE) * mult, 0.95::DOUBLE) * 0.3::DOUBLE + lk * 0.7::DOUBLE, 0.05::DOUBLE), 0.98::DOUBLE), 9) AS posterior
  FROM base JOIN prof USING (technique)),
edges AS (SELECT profile, src, tgt, technique, posterior FROM (
  SELECT *, row_number() OVER (PARTITION BY profile, src, tgt ORDER BY posterior DESC, ti) AS rn FROM scored b WHERE posterior >= {_floor('0')}) WHERE rn = 1),
adj AS (SELECT profile, src, tgt, technique, posterior, k FROM (
  SELECT *, row_number() OVER (PARTITION BY profile, src ORDER BY posterior DESC, tgt) AS k FROM edges) WHERE k <= 20)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


BASE = (INV, FND)
GRAPH = (INV, FND, TECH, PROFILE, CATTECH, REACH, LK, EDGES)
