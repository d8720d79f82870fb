"""Queries over targets, searched paths and stored paths, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..operators import edges, path_scores as ps, path_search, scenario, targets
from ..operators.inventory import top_finding
from ..operators.ordering import numbered
from ..session import materialise, table
from . import sql
from .inventory_queries import GRAPH, SCORED, inv

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


_in = lambda text: ", ".join(map(fixed.quoted, text.split()))
TARGET = f"((type IN ({_in(fixed.TARGETS_SURE)}) AND criticality >= 4) OR (type IN ({_in(fixed.TARGETS_LIKELY)}) AND criticality = 5))"
TGT = f"tgt AS (SELECT id FROM inv WHERE {TARGET})"
@query(sql.with_(*sql.BASE, TGT) + "SELECT id FROM tgt")
def target_assets(spark, sf_dir):
    return inv(spark, sf_dir, "type", "criticality").where(targets.is_target()).select("id")


PROFILES = tuple(fixed.profiles())
ADJ = "graph AS MATERIALIZED (SELECT profile, src, tgt, technique, posterior FROM adj),\nprofs AS (SELECT DISTINCT profile FROM prof)"
DIST = """walk(profile, id, d) USING KEY (profile, id) AS (SELECT profile, id, 0 FROM tgt, profs
  UNION SELECT a.profile, a.src, min(w.d + 1) FROM walk w JOIN graph a ON a.tgt = w.id AND a.profile = w.profile
    LEFT JOIN recurring.walk k ON k.profile = a.profile AND k.id = a.src WHERE k.id IS NULL GROUP BY ALL),
dist AS (SELECT profile, id, d AS dist FROM walk)"""
ENTRY = """entry AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, id, finding_id) AS rn FROM (
  SELECT profile, id, finding_id, round(base + plus + (CASE WHEN d <= 1 THEN 8 WHEN d <= 2 THEN 5 WHEN d <= 3 THEN 2 ELSE 0 END), 9) AS score,
    round(base + plus + (CASE WHEN d <= 2 THEN 5 ELSE 0 END), 9) AS rerank FROM (
    SELECT profs.profile, i.id, f.finding_id, i.criticality * (CASE f.severity WHEN 'critical' THEN 4 ELSE 3 END) AS base, coalesce(dist.dist, 99) AS d,
      (CASE WHEN internet_facing THEN 5 ELSE 0 END) + coalesce(f.epss, 0) * 3::DOUBLE AS plus
    FROM inv i JOIN fnd f ON f.asset_id = i.id CROSS JOIN profs LEFT JOIN dist ON dist.id = i.id AND dist.profile = profs.profile
    WHERE f.severity IN ('critical', 'high') AND (internet_facing OR zone IN ('dmz', 'mgmt') OR (criticality >= 4 AND zone IN ('corp', 'staging')))))) WHERE rn <= 10)"""


def _beam(depth: int = path_search.MAX_DEPTH) -> str:
    out = ["lv0 AS MATERIALIZED (SELECT DISTINCT profile, id AS entry, id AS node, [id] AS path, []::VARCHAR[] AS techniques, []::DOUBLE[] AS probs, 1.0::DOUBLE AS p, id IN (SELECT id FROM tgt) AS hit FROM entry)"]
    for d in range(1, depth + 1):
        out.append(
            f"""lv{d} AS MATERIALIZED (SELECT profile, entry, tgt AS node, path, techniques, probs, p, tgt IN (SELECT id FROM tgt) AS hit FROM (
  SELECT *, row_number() OVER (PARTITION BY profile, entry, tgt ORDER BY p DESC, array_to_string(path, '>'), array_to_string(techniques, '+')) AS rn FROM (
    SELECT l.profile, entry, a.tgt, list_append(path, a.tgt) AS path, list_append(techniques, a.technique) AS techniques, list_append(probs, a.posterior) AS probs, round(p * a.posterior, 12) AS p
    FROM lv{d - 1} l JOIN graph a ON a.src = l.node AND a.profile = l.profile WHERE NOT hit AND NOT list_contains(l.path, a.tgt)
      AND a.tgt IN (SELECT asset_id FROM fnd))) WHERE rn <= {path_search.BEAM})"""
        )
    hits = " UNION ALL ".join(f"SELECT profile, entry, node, path, techniques, probs, p FROM lv{d} WHERE hit" for d in range(path_search.MIN_NODES - 1, depth + 1))
    return ",\n".join(out) + f",\nfound AS ({hits})"


def _search_all(spark, sf_dir):
    """Inventory, entry points, targets and transitions of every profile: one pass, each profile on its own graph."""
    i = materialise(top_finding(inv(spark, sf_dir, *SCORED, "name", "sensitivity", "sources")), "inventory")
    adj = materialise(edges.adjacency(i, PROFILES), "adjacency")
    goals = i.where(targets.is_target()).select("id")
    dist = targets.target_distances(adj, targets.each_profile(goals, PROFILES), by=["profile"])
    entries = targets.entry_points(i, dist, profiles=PROFILES)
    walkable = adj.join(i.where("top IS NOT NULL").select(F.col("id").alias("tgt")), "tgt", "left_semi")
    return i, materialise(entries, "entries"), goals, walkable


@query(GRAPH.rstrip() + f",\n{TGT},\n{ADJ},\n{DIST}\nSELECT profile, id, dist FROM dist")
def target_distance(spark, sf_dir):
    """Hops to the nearest target on the graphs of all three profiles."""
    i = materialise(inv(spark, sf_dir, *SCORED), "inventory")
    adj = materialise(edges.adjacency(i, PROFILES).select("profile", "src", "tgt"), "adjacency")
    return targets.target_distances(adj, targets.each_profile(i.where(targets.is_target()), PROFILES), by=["profile"])


@query(GRAPH.rstrip() + f",\n{TGT},\n{ADJ},\n{DIST},\n{ENTRY}\nSELECT profile, id, finding_id, round(score, 6) AS score, round(rerank, 6) AS rerank FROM entry")
def entry_points(spark, sf_dir):
    """The entry points of all three profiles, ten each."""
    return _search_all(spark, sf_dir)[1].select("profile", "id", "finding_id", F.round("score", 6).alias("score"), F.round("rerank", 6).alias("rerank"))


@query(GRAPH.rstrip() + f",\n{TGT},\n{ADJ},\n{DIST},\n{ENTRY},\n{_beam()}\nSELECT profile, array_to_string(path, '>') AS path, array_to_string(techniques, '+') AS techniques, round(p, 6) AS p FROM found")
def exposure_paths(spark, sf_dir):
    """The paths of all three profiles, each searched from its own entry points on its own graph."""
    _, entries, goals, walkable = _search_all(spark, sf_dir)
    found = path_search.search(walkable, entries, goals, by=["profile"])
    return found.select("profile", F.array_join("path", ">").alias("path"), F.array_join("techniques", "+").alias("techniques"), F.round("p", 6).alias("p"))


TAGS = {"apt": "APT", "ransomware": "RANSOM", "insider": "INSIDER"}


def merged_report(found, i):
    """The best path of each pattern over all profiles, labelled with its profile; equal ones in the order of ``PROFILES``."""
    paths = ps.scored(path_search.as_paths(found, i, F.col("profile")))
    paths = paths.withColumns({"realism": F.round(ps.realism(), 6), "reward": F.round(ps.reward(), 6), "label": F.concat(F.lit("["), fixed.switch(F.col("profile"), TAGS, "?"), F.lit("] "), F.col("label"))})
    first = F.array_position(F.array(*[F.lit(p) for p in PROFILES]), F.col("profile"))
    return ps.best_per_pattern(paths, "realism", 5, (first, "path_id"))


_SEARCH = GRAPH.rstrip() + f",\n{TGT},\n{ADJ},\n{DIST},\n{ENTRY},\n{_beam()}"
_SEQ = "list_filter(list_transform(zones, lambda z, i: CASE WHEN i = 1 OR z IS DISTINCT FROM zones[i - 1] THEN z END), lambda z: z IS NOT NULL)"
_MERGE = _SEARCH + f""",
ep AS (SELECT asset_id, max(coalesce(epss, CASE WHEN severity = 'critical' AND exploit_available THEN 0.7 WHEN severity = 'critical' THEN 0.3 WHEN severity = 'high' THEN 0.15 ELSE 0.05 END)::DOUBLE) AS e FROM fnd GROUP BY asset_id),
steps AS (SELECT profile, path, techniques, probs, p, generate_subscripts(path, 1) AS pos, unnest(path) AS id FROM found),
whole AS (SELECT profile, path, techniques, probs, p, list(i.type ORDER BY pos) AS types, list(i.zone ORDER BY pos) AS zones, list(i.sources ORDER BY pos) AS srcs, exp(avg(ln(greatest(coalesce(e, 0.05), 0.01)))) AS gm
  FROM steps s JOIN inv i ON i.id = s.id LEFT JOIN ep ON ep.asset_id = s.id GROUP BY ALL),
judged AS (SELECT profile, array_to_string(path, '>') AS path, 'path-' || substr(sha256(profile || '>' || array_to_string(path, '>') || '>' || array_to_string(techniques, '+')), 1, 12) AS path_id,
  types[1] || ':' || zones[1] || '|' || array_to_string(list_sort(list_distinct(techniques)), '+') || '|' || types[len(types)] || ':' || zones[len(zones)] || '|' || array_to_string({_SEQ}, '→') AS signature,
  round(list_product(probs) * 0.25 + gm * 0.2 + least(srcs[len(srcs)] / 3::DOUBLE, 1) * 0.2 + (1 - list_avg(list_transform(probs, lambda x: least(1, x + 0.1) - greatest(0, x - 0.1)))) * 0.15
    + greatest(0, 1 - abs(len(path) - 5) * 0.05) * 0.1 + 0.1, 6) AS realism FROM whole),
merged AS (SELECT row_number() OVER (ORDER BY realism DESC, turn, path_id) AS rank, profile, path_id, path, signature, realism FROM (
  SELECT *, list_position({list(PROFILES)}, profile) AS turn, row_number() OVER (PARTITION BY signature ORDER BY realism DESC, list_position({list(PROFILES)}, profile), path_id) AS rn FROM judged) WHERE rn = 1)"""


@query(_MERGE + " SELECT CAST(rank AS INTEGER) AS rank, profile, path_id, path, signature, realism FROM merged WHERE rank <= 5")
def merged_paths(spark, sf_dir):
    """The five best patterns over all profiles: the best path of each."""
    i, entries, goals, walkable = _search_all(spark, sf_dir)
    best = merged_report(path_search.search(walkable, entries, goals, by=["profile"]), i)
    return best.select("rank", "profile", "path_id", F.array_join(F.transform("nodes", lambda n: n["asset_id"]), ">").alias("path"), "signature", "realism")


@query(_SEARCH + " SELECT profile, count(*) AS paths, count(DISTINCT entry) AS entries, count(DISTINCT node) AS targets, round(avg(len(path)), 6) AS avg_nodes, CAST(max(len(path)) AS INTEGER) AS longest FROM found GROUP BY profile")
def search_statistics(spark, sf_dir):
    _, entries, goals, walkable = _search_all(spark, sf_dir)
    return path_search.statistics(path_search.search(walkable, entries, goals, by=["profile"]))


@query(GRAPH.rstrip() + f",\n{TGT},\n{ADJ},\n{DIST}\nSELECT profs.profile, inv.id, round(CASE WHEN d.dist IS NOT NULL THEN criticality / 5::DOUBLE * 0.5 / pow(2, d.dist) WHEN criticality >= 4 THEN criticality / 5::DOUBLE * 0.05 ELSE 0 END, 6) AS reward FROM inv CROSS JOIN profs LEFT JOIN dist d ON d.id = inv.id AND d.profile = profs.profile")
def partial_rewards(spark, sf_dir):
    """What a path that ends at each asset would earn short of a target."""
    i = materialise(inv(spark, sf_dir, *SCORED), "inventory")
    adj = materialise(edges.adjacency(i, PROFILES).select("profile", "src", "tgt"), "adjacency")
    d = targets.target_distances(adj, targets.each_profile(i.where(targets.is_target()), PROFILES), by=["profile"])
    rows = targets.each_profile(i.select("id", "criticality"), PROFILES).join(d, ["profile", "id"], "left")
    return rows.select("profile", "id", F.round(targets.partial_reward(F.col("criticality"), F.coalesce("dist", F.lit(targets.FAR))), 6).alias("reward"))


@query(sql.with_(*sql.BASE) + f"SELECT CASE WHEN criticality >= 4 AND type IN ({_in(fixed.TARGETS_SURE)}) THEN 1 WHEN criticality >= 4 AND type IN ({_in(fixed.TARGETS_POSSIBLE)}) THEN 2 END AS tier, count(*) AS assets, count(*) FILTER ({TARGET}) AS targets FROM inv GROUP BY 1")
def target_classification(spark, sf_dir):
    return targets.classification(inv(spark, sf_dir, "type", "criticality"))


@query(GRAPH.rstrip() + f",\n{TGT},\n{ADJ},\n{DIST},\n{ENTRY}\nSELECT profile, id, finding_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY rerank DESC, id, finding_id) AS place FROM entry) WHERE place <= 15")
def reranked_entries(spark, sf_dir):
    """The entry points of each profile in the order of their second score, at most 15."""
    e = _search_all(spark, sf_dir)[1]
    place = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("rerank"), "id", "finding_id"))
    return e.withColumn("place", place).where("place <= 15").select("profile", "id", "finding_id", "place")


@query(GRAPH + "SELECT profile, count(*) AS edges, CAST(floor(count(*) * 0.7 + 0.5) AS BIGINT) AS validated, count(*) - CAST(floor(count(*) * 0.7 + 0.5) AS BIGINT) AS inferred FROM edges GROUP BY profile")
def edge_split(spark, sf_dir):
    s = edges.edge_statistics(materialise(inv(spark, sf_dir, *SCORED), "inventory"))
    a, b = ps.edge_split(F.col("edges"))
    return s.select("profile", "edges", a.alias("validated"), b.alias("inferred"))


def path_insights(spark, sf_dir):
    """One line for each of the best patterns."""
    i, entries, goals, walkable = _search_all(spark, sf_dir)
    return ps.insights(merged_report(path_search.search(walkable, entries, goals, by=["profile"]), i))


QUERIES["path_insights"] = path_insights


def exposure_report(spark, sf_dir):
    """The best searched path of each pattern over all profiles with all its scores, as one JSON document a row."""
    i, entries, goals, walkable = _search_all(spark, sf_dir)
    best = merged_report(path_search.search(walkable, entries, goals, by=["profile"]), i)
    return best.select("rank", "path_id", F.to_json(F.struct("profile", "entry", "nodes", "edges", "path_probability", "realism", "reward", "effort", "impact", "phases", "label")).alias("document"))


QUERIES["exposure_report"] = exposure_report

P = """WITH p AS (SELECT * REPLACE (coalesce(nodes, []) AS nodes, coalesce(edges, []) AS edges, coalesce(kill_chain, []) AS kill_chain,
    CASE WHEN isnan(path_probability) THEN NULL ELSE path_probability END AS path_probability, CASE WHEN isnan(realism_score) THEN NULL ELSE realism_score END AS realism_score,
    CASE WHEN isnan(impact_score) THEN NULL ELSE impact_score END AS impact_score, CASE WHEN isnan(final_risk_score) THEN NULL ELSE final_risk_score END AS final_risk_score)
  FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY ingested_at DESC) AS rn FROM attack_paths) WHERE rn = 1)
"""


def paths(spark, sf_dir, *need, nodes=(), edges=()):
    return ps.paths_of(table(spark, sf_dir, "attack_paths"), need, nodes, edges)


SHAPE = {"nodes": ("asset_type", "asset_zone", "criticality"), "edges": ("technique", "probability", "confidence_interval")}


@query(P + """SELECT path_id, CAST(pos - 1 AS INTEGER) AS pos, n.asset_id AS asset_id, coalesce(n.asset_type, 'unknown') AS asset_type, coalesce(n.asset_zone, 'unknown') AS asset_zone,
  coalesce(n.criticality, 0) AS criticality, coalesce(n.internet_facing, false) AS internet_facing, coalesce(n.data_sensitivity, 'standard') AS data_sensitivity, upper(trim(n.misconfig_id)) AS misconfig_id
  FROM (SELECT path_id, generate_subscripts(nodes, 1) AS pos, unnest(nodes) AS n FROM p)""")
def path_nodes(spark, sf_dir):
    return ps.nodes_of(paths(spark, sf_dir, "nodes"))


@query(P + "SELECT path_id, CAST(pos - 1 AS INTEGER) AS pos, e.source_id AS source_id, e.target_id AS target_id, e.technique AS technique, e.probability AS probability FROM (SELECT path_id, generate_subscripts(edges, 1) AS pos, unnest(edges) AS e FROM p)")
def path_edges(spark, sf_dir):
    return ps.edges_of(paths(spark, sf_dir, "edges", edges=("source_id", "target_id", "technique", "probability")))


@query(P + """SELECT path_id, len(nodes) AS n_nodes, round(prob, 6) AS probability, round(CASE WHEN len(edges) = 0 THEN 0.5 ELSE greatest(0.01, prob - 1.96 * std) END, 6) AS ci_low,
  round(CASE WHEN len(edges) = 0 THEN 0.5 ELSE least(0.99, prob + 1.96 * std) END, 6) AS ci_high,
  round(least(len(nodes) * 0.5::DOUBLE + len(list_filter(edges, lambda e: e.technique = 'privilege_escalation')) * 1.5::DOUBLE + len(list_filter(edges, lambda e: e.technique = 'credential_theft'))
    + (1 - coalesce(list_sum(list_transform(edges, lambda e: e.probability)), 0) / greatest(len(edges), 1)) * 3::DOUBLE, 10), 6) AS effort,
  round(least(list_sum(list_transform(nodes, lambda n, i: coalesce(n.criticality, 0) * i)) / len(nodes)::DOUBLE / len(nodes) * 20, 100), 6) AS impact, round(len(nodes) * 0.03::DOUBLE, 6) AS detection
FROM (SELECT *, coalesce(list_product(list_transform(edges, lambda e: e.probability)), 1) AS prob,
  sqrt(coalesce(list_sum(list_transform(edges, lambda e: pow(coalesce(e.confidence_interval[2] - e.confidence_interval[1], 0.2::DOUBLE) / 3.92::DOUBLE, 2))), 0)) AS std FROM p)""")
def path_scores(spark, sf_dir):
    s = ps.scored(paths(spark, sf_dir, "nodes", "edges", **SHAPE))
    return s.select("path_id", "n_nodes", *[F.round(c, 6).alias(c) for c in ("probability", "ci_low", "ci_high", "effort", "impact", "detection")])


_zs = "list_filter(list_transform(nodes, lambda n, i: CASE WHEN i = 1 OR n.asset_zone IS DISTINCT FROM nodes[i - 1].asset_zone THEN n.asset_zone END), lambda z: z IS NOT NULL)"


@query(P + f"""SELECT path_id, nodes[1].asset_type || ':' || nodes[1].asset_zone || '|' || array_to_string(list_sort(list_distinct(list_transform(edges, lambda e: e.technique))), '+') || '|'
  || nodes[len(nodes)].asset_type || ':' || nodes[len(nodes)].asset_zone || '|' || array_to_string({_zs}, '→') AS signature, format('{{}}–{{}} hours', len(nodes) * 4, len(nodes) * 8) AS timeline FROM p""")
def path_patterns(spark, sf_dir):
    return ps.scored(paths(spark, sf_dir, "nodes", "edges", **SHAPE)).select("path_id", "signature", "timeline")


_phases = lambda t: "(CASE t " + " ".join(f"WHEN {fixed.quoted(k)} THEN [{', '.join(map(fixed.quoted, v))}]" for k, v in fixed.phrases(t).items()) + " ELSE [] END)"


@query(P + f"""SELECT path_id, string_agg(ph, '>' ORDER BY ord) AS phases FROM (SELECT path_id, ph, min(pos * 10 + j) AS ord FROM (
  SELECT path_id, 0 AS pos, 0 AS j, 'Reconnaissance' AS ph FROM p UNION ALL
  SELECT path_id, pos, generate_subscripts(l, 1), unnest(l) FROM (SELECT path_id, pos, {_phases(fixed.PHASES)} AS l FROM (SELECT path_id, generate_subscripts(edges, 1) AS pos, unnest(edges).technique AS t FROM p)))
  GROUP BY ALL) GROUP BY path_id""")
def path_phases(spark, sf_dir):
    return ps.scored(paths(spark, sf_dir, "nodes", "edges", **SHAPE)).select("path_id", F.array_join("phases", ">").alias("phases"))


@query(P + "SELECT asset_id, count(*) AS paths_through, CAST(floor(count(*) * 100 / greatest((SELECT count(*) FROM p), 1)::DOUBLE + 0.5) AS BIGINT) AS blocking_impact FROM (SELECT unnest(nodes[2:len(nodes) - 1]).asset_id AS asset_id FROM p WHERE len(nodes) > 2) WHERE asset_id IS NOT NULL GROUP BY asset_id ORDER BY paths_through DESC, asset_id LIMIT 5")
def chokepoints(spark, sf_dir):
    return ps.chokepoints(paths(spark, sf_dir, "nodes", nodes=("asset_id",)))


@query(P.replace("WITH p", "WITH " + sql.INV + ",\np") + """, n AS (SELECT DISTINCT path_id, asset_id, coalesce(path_probability, 0) * coalesce(impact_score, 0) AS r FROM (SELECT path_id, path_probability, impact_score, unnest(nodes).asset_id AS asset_id FROM p)),
c AS (SELECT asset_id, count(*) AS k, sum(r) AS risk FROM n GROUP BY asset_id)
SELECT id AS asset_id, coalesce(k, 0) AS paths_to_it, round(coalesce(risk, 0), 4) AS cumulative_risk, CASE WHEN criticality >= 5 THEN 'Highest criticality asset' WHEN criticality >= 4 THEN 'High criticality' ELSE k || ' paths meet here' END AS reason
FROM inv LEFT JOIN c ON c.asset_id = id WHERE criticality >= 4 OR k > 0 ORDER BY cumulative_risk DESC, id LIMIT 5""")
def critical_assets(spark, sf_dir):
    risk = F.coalesce("path_probability", F.lit(0.0)) * F.coalesce("impact_score", F.lit(0.0))
    seen = paths(spark, sf_dir, "nodes", "path_probability", "impact_score", nodes=("asset_id",)).select(risk.alias("r"), F.explode(F.array_distinct(F.transform("nodes", lambda n: n["asset_id"]))).alias("asset_id"))
    c = seen.groupBy("asset_id").agg(F.count(F.lit(1)).alias("k"), F.sum("r").alias("risk"))
    rows = inv(spark, sf_dir, "criticality").join(c, F.col("id") == F.col("asset_id"), "left").where("criticality >= 4 OR k > 0")
    reason = F.when(F.col("criticality") >= 5, "Highest criticality asset").when(F.col("criticality") >= 4, "High criticality").otherwise(F.format_string("%d paths meet here", F.col("k")))
    out = rows.select(F.col("id").alias("asset_id"), F.coalesce("k", F.lit(0)).alias("paths_to_it"), F.round(F.coalesce("risk", F.lit(0.0)), 4).alias("cumulative_risk"), reason.alias("reason"))
    return out.orderBy(F.desc("cumulative_risk"), "asset_id").limit(5)


@query(P + """SELECT profile, count(*) AS n, CAST(floor(avg(path_probability) * avg(realism_score) * 100 + 0.5) AS BIGINT) AS overall, count(*) FILTER (impact_score >= 80) AS critical,
  count(*) FILTER (impact_score >= 50 AND impact_score < 80) AS high, count(*) FILTER (impact_score >= 25 AND impact_score < 50) AS medium, count(*) FILTER (impact_score < 25) AS low FROM p GROUP BY profile""")
def risk_metrics(spark, sf_dir):
    i = F.col("impact_score")
    return paths(spark, sf_dir, "profile", "path_probability", "realism_score", "impact_score").groupBy("profile").agg(
        F.count(F.lit(1)).alias("n"), F.floor(F.avg("path_probability") * F.avg("realism_score") * 100 + 0.5).alias("overall"), F.count_if(i >= 80).alias("critical"),
        F.count_if((i >= 50) & (i < 80)).alias("high"), F.count_if((i >= 25) & (i < 50)).alias("medium"), F.count_if(i < 25).alias("low"),
    )


@query(P + "SELECT technique FROM (SELECT e.technique AS technique, min((path_id, pos)) AS ord FROM (SELECT path_id, generate_subscripts(edges, 1) AS pos, unnest(edges) AS e FROM p) GROUP BY 1) ORDER BY ord LIMIT 5")
def top_vectors(spark, sf_dir):
    """The first five distinct techniques in the order they are met."""
    e = ps.edges_of(paths(spark, sf_dir, "edges", edges=("source_id", "target_id", "technique", "probability"))).groupBy("technique").agg(F.min(F.struct("path_id", "pos")).alias("at"))
    return e.orderBy("at").limit(5).select("technique")


_tier = lambda c: fixed.sql_case(f"lower({c})", fixed.tiers(), 2)
_reach = "[" + ", ".join(fixed.quoted(f"{a}>{b}") for a, bs in fixed.groups(fixed.ZONE_REACH + "airgap: airgap restricted") for b in bs) + "]"


@query(P + f"""SELECT profile, CAST(floor(round(avg(score), 9) + 0.5) AS BIGINT) AS coherence FROM (SELECT profile,
  len(list_filter(range(1, len(nodes)), lambda i: list_contains({_reach}, nodes[i].asset_zone || '>' || nodes[i + 1].asset_zone))) / greatest(len(nodes) - 1, 1)::DOUBLE * 20
  + len(list_filter(range(1, len(nodes)), lambda i: {_tier('nodes[i].asset_type')} <= {_tier('nodes[i + 1].asset_type')})) / greatest(len(nodes) - 1, 1)::DOUBLE * 20
  + CASE WHEN nodes[1].internet_facing THEN 20 WHEN nodes[1].asset_zone = 'dmz' THEN 15 ELSE 5 END
  + CASE WHEN lower(nodes[len(nodes)].asset_type) IN ({_in(fixed.TERMINAL_TYPES)}) THEN 20 WHEN nodes[len(nodes)].criticality >= 4 THEN 15 ELSE 5 END
  + least(coalesce(path_probability, 0), 1) * 20 AS score FROM p) GROUP BY profile""")
def coherence(spark, sf_dir):
    s = paths(spark, sf_dir, "profile", "nodes", "path_probability", nodes=("asset_type", "asset_zone", "criticality", "internet_facing")).withColumn("score", ps.coherence(F.coalesce("path_probability", F.lit(0.0))))
    return s.groupBy("profile").agg(F.floor(F.round(F.avg("score"), 9) + 0.5).alias("coherence"))


@query(P + """SELECT CAST(row_number() OVER (ORDER BY s DESC, path_id) AS BIGINT) AS rank, path_id, pattern_signature, s AS score FROM (
  SELECT path_id, pattern_signature, final_risk_score AS s, row_number() OVER (PARTITION BY pattern_signature ORDER BY final_risk_score DESC, path_id) AS rn FROM p
  WHERE pattern_signature IS NOT NULL AND final_risk_score IS NOT NULL) WHERE rn = 1 ORDER BY s DESC, path_id LIMIT 5""")
def pattern_merge(spark, sf_dir):
    p = paths(spark, sf_dir, "pattern_signature", "final_risk_score").withColumn("signature", F.col("pattern_signature"))
    return ps.best_per_pattern(p, "final_risk_score", 5).select(F.col("rank").cast("bigint").alias("rank"), "path_id", "pattern_signature", F.col("final_risk_score").alias("score"))


_pct = lambda c: f"CAST(floor({c} * 100 + 0.5) AS BIGINT)"
_hop = lambda i: f"nodes[{i}].asset_name AS hop_{i}_asset, nodes[{i}].asset_zone AS hop_{i}_zone, replace(edges[{i - 1}].technique, '_', ' ') AS hop_{i}_technique"


@query(P.replace("WITH p", "WITH " + sql.INV + ",\n" + sql.FND + ",\np") + f""", worst AS (SELECT asset_id, max(coalesce(epss, 0)) AS m FROM fnd GROUP BY asset_id)
SELECT path_id, row_number() OVER (ORDER BY realism_score DESC NULLS LAST, path_id) AS rank, profile, pattern_label, nodes[1].asset_name AS entry_asset, nodes[1].asset_zone AS entry_zone, nodes[1].misconfig_title AS entry_misconfig,
  {_hop(2)}, {_hop(3)}, {_hop(4)}, nodes[len(nodes)].asset_name AS target_asset, nodes[len(nodes)].asset_zone AS target_zone, replace(nodes[len(nodes)].asset_type, '_', ' ') AS target_type, nodes[len(nodes)].criticality AS target_criticality,
  len(nodes) AS total_hops, array_to_string(kill_chain, ' → ') AS kill_chain_phases, {_pct('path_probability')} AS path_probability_pct, {_pct('realism_score')} AS realism_score_pct, {_pct('CASE WHEN isnan(detection_risk) THEN NULL ELSE detection_risk END')} AS detection_risk_pct,
  round(least(len(nodes) * 0.5::DOUBLE + len(list_filter(edges, lambda e: e.technique = 'privilege_escalation')) * 1.5::DOUBLE + len(list_filter(edges, lambda e: e.technique = 'credential_theft'))
    + (1 - coalesce(list_sum(list_transform(edges, lambda e: e.probability)), 0) / greatest(len(edges), 1)) * 3::DOUBLE, 10), 6) AS attacker_effort,
  impact_score AS business_impact, nodes[len(nodes)].misconfig_title AS top_misconfig_on_target, round(worst.m, 6) AS target_epss_max
FROM p LEFT JOIN worst ON worst.asset_id = nodes[len(nodes)].asset_id""")
def flat_report(spark, sf_dir):
    """The flat report: one line of 28 columns per path (and its id), hops at fixed positions."""
    nodes = ("asset_id", "asset_name", "asset_zone", "asset_type", "criticality", "misconfig_title")
    p = paths(spark, sf_dir, "profile", "pattern_label", "kill_chain", "path_probability", "realism_score", "detection_risk", "impact_score", "nodes", "edges", nodes=nodes, edges=("technique", "probability", "confidence_interval"))
    at = lambda i, f: F.try_element_at("nodes", F.lit(i))[f]
    words = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    pct = lambda c: F.floor(F.col(c) * 100 + 0.5)
    hops = [x for i in (2, 3, 4) for x in (at(i, "asset_name").alias(f"hop_{i}_asset"), at(i, "asset_zone").alias(f"hop_{i}_zone"), words(F.get("edges", F.lit(i - 2))["technique"]).alias(f"hop_{i}_technique"))]
    rows = ps.scored(p).select(
        "path_id", "realism_score", "profile", "pattern_label", at(1, "asset_name").alias("entry_asset"), at(1, "asset_zone").alias("entry_zone"), at(1, "misconfig_title").alias("entry_misconfig"), *hops,
        at(-1, "asset_name").alias("target_asset"), at(-1, "asset_zone").alias("target_zone"), words(at(-1, "asset_type")).alias("target_type"), at(-1, "criticality").alias("target_criticality"), F.size("nodes").alias("total_hops"),
        F.array_join("kill_chain", " → ").alias("kill_chain_phases"), pct("path_probability").alias("path_probability_pct"), pct("realism_score").alias("realism_score_pct"), pct("detection_risk").alias("detection_risk_pct"),
        F.round("effort", 6).alias("attacker_effort"), F.col("impact_score").alias("business_impact"), at(-1, "misconfig_title").alias("top_misconfig_on_target"), at(-1, "asset_id").alias("target_id"),
    )
    worst = inv(spark, sf_dir, "findings").where(F.size("findings") > 0).select(F.col("id").alias("target_id"), F.round(F.array_max(F.transform("findings", lambda f: F.coalesce(f["epss"], F.lit(0.0)))), 6).alias("target_epss_max"))
    return numbered(rows.join(worst, "target_id", "left"), [F.desc_nulls_last("realism_score"), "path_id"], "rank").drop("target_id", "realism_score")


@query(P.replace("WITH p", "WITH " + sql.INV + ",\n" + sql.FND + ",\np") + """, e AS (SELECT asset_id, max(coalesce(epss, CASE WHEN severity = 'critical' AND exploit_available THEN 0.7 WHEN severity = 'critical' THEN 0.3 WHEN severity = 'high' THEN 0.15 ELSE 0.05 END)::DOUBLE) AS s FROM fnd GROUP BY asset_id)
SELECT path_id, round(exp(avg(ln(greatest(coalesce(s, 0.05), 0.01)))), 6) AS epss FROM (SELECT path_id, unnest(nodes).asset_id AS asset_id FROM p) n LEFT JOIN e USING (asset_id) GROUP BY path_id""")
def epss_geometric_mean(spark, sf_dir):
    """The geometric mean over a path's nodes of each node's largest exploit score; defaults by severity, floor 0.01."""
    nodes = paths(spark, sf_dir, "nodes", nodes=("asset_id",)).select("path_id", F.explode("nodes.asset_id").alias("asset_id"))
    worst = inv(spark, sf_dir, "findings").select(F.col("id").alias("asset_id"), path_search._epss().alias("e"))
    g = nodes.join(worst, "asset_id", "left").groupBy("path_id").agg(F.exp(F.avg(F.log(F.greatest(F.coalesce("e", F.lit(0.05)), F.lit(0.01))))).alias("g"))
    return g.select("path_id", F.round("g", 6).alias("epss"))


@query(P + "SELECT path_id, CAST(i AS INTEGER) AS pos, round(coalesce(list_product(list_transform(edges[1:i], lambda e: e.probability)), 1), 6) AS cumulative FROM (SELECT path_id, edges, unnest(range(0, len(edges) + 1)) AS i FROM p)")
def path_cumulative(spark, sf_dir):
    """The probability of getting as far as each node of a path: 1 at the entry, then the product of the edges so far."""
    p = paths(spark, sf_dir, "edges", edges=("probability",)).select("path_id", F.col("edges.probability").alias("probs"))
    steps = p.select("path_id", "probs", F.explode(F.sequence(F.lit(0), F.size("probs"))).alias("pos"))
    return steps.select("path_id", "pos", F.round(ps.product(F.slice("probs", F.lit(1), F.col("pos"))), 6).alias("cumulative"))


@query(P + "SELECT path_id, CAST(len(list_distinct(list_transform(nodes, lambda n: n.misconfig_category))) AS INTEGER) AS categories, round(list_min(list_transform(edges, lambda e: e.probability)), 6) AS weakest FROM p")
def path_weakest(spark, sf_dir):
    """The weakest edge of each path, and how many categories of findings are on it."""
    p = paths(spark, sf_dir, "nodes", "edges", nodes=("misconfig_category",), edges=("probability",))
    kinds = F.size(F.array_compact(F.array_distinct("nodes.misconfig_category")))
    return p.select("path_id", kinds.alias("categories"), F.round(F.array_min("edges.probability"), 6).alias("weakest"))


_caps = lambda t: "(CASE t " + " ".join(f"WHEN {fixed.quoted(k)} THEN [{', '.join(map(fixed.quoted, v))}]" for k, v in fixed.phrases(t).items()) + " ELSE [] END)"


@query(P + f"""SELECT path_id, string_agg(c, '>' ORDER BY ord) AS capabilities FROM (SELECT path_id, c, min(pos * 10 + j) AS ord FROM (
  SELECT path_id, pos, generate_subscripts(l, 1) AS j, unnest(l) AS c FROM (SELECT path_id, pos, {_caps(fixed.CAPABILITIES)} AS l FROM (SELECT path_id, generate_subscripts(edges, 1) AS pos, unnest(edges).technique AS t FROM p))) GROUP BY ALL) GROUP BY path_id""")
def path_capabilities(spark, sf_dir):
    c = ps.scored(paths(spark, sf_dir, "nodes", "edges", **SHAPE)).where(F.size("capabilities") > 0)
    return c.select("path_id", F.array_join("capabilities", ">").alias("capabilities"))


@query(P + f"""SELECT path_id, replace(nodes[1].asset_type, '_', ' ') || ' → ' || replace(replace(array_to_string(list_sort(list_distinct(list_transform(edges, lambda e: e.technique))), '+'), '_', ' '), '+', ' + ') || ' → '
  || replace(nodes[len(nodes)].asset_type, '_', ' ') || ' [' || nodes[len(nodes)].asset_zone || '] via ' || array_to_string({_zs}, '→') AS label FROM p""")
def path_labels(spark, sf_dir):
    return ps.scored(paths(spark, sf_dir, "nodes", "edges", **SHAPE)).select("path_id", "label")


_sc_aff = "(CASE " + " ".join(
    [f"WHEN technique = '{r.split()[0]}' AND b.type IN ({_in(' '.join(r.split()[2:]))}) THEN {r.split()[1]}::DOUBLE" for r in scenario.AFFINITY_TYPES.strip().splitlines()]
    + [f"WHEN technique = '{scenario.AFFINITY_ZONES.split()[0]}' AND b.zone IN ({_in(' '.join(scenario.AFFINITY_ZONES.split()[2:]))}) THEN {scenario.AFFINITY_ZONES.split()[1]}::DOUBLE"]
) + " ELSE 1::DOUBLE END)"
_cut = lambda p: f"round(least(greatest({p} * 0.3::DOUBLE + lk * 0.7::DOUBLE, 0.05::DOUBLE), 0.98::DOUBLE), 9)"


_SCENARIO = sql.with_(sql.INV, sql.FND, sql.TECH, sql.PROFILE, sql.CATTECH).rstrip() + f""", lk AS (
  SELECT i.id, t.ti, CASE WHEN count(f.finding_id) = 0 THEN 0.3::DOUBLE ELSE least(count(f.finding_id) * 0.15::DOUBLE + count(*) FILTER (f.severity = 'critical' AND f.exploit_available) * 0.25::DOUBLE + count(*) FILTER (f.severity = 'high') * 0.1::DOUBLE, 0.95::DOUBLE) END AS lk
  FROM inv i CROSS JOIN tech t LEFT JOIN (SELECT fnd.*, c.technique FROM fnd JOIN cattech c ON c.category = fnd.category) f ON f.asset_id = i.id AND f.technique = t.technique GROUP BY i.id, t.ti),
x AS (SELECT asset_id, count(*) FILTER (severity = 'critical' AND exploit_available) AS n FROM fnd GROUP BY asset_id),
c AS (SELECT a.id AS src, b.id AS tgt, t.ti, technique, lk.lk, least(t.base * (1 + b.criticality * 0.08::DOUBLE) * (1 + coalesce(x.n, 0) * 0.15::DOUBLE) * {_sc_aff}
    * (pow(0.6::DOUBLE, r.dist) * (CASE WHEN a.internet_facing THEN 1.4::DOUBLE ELSE 1::DOUBLE END) * (CASE WHEN a.domain_joined AND b.domain_joined THEN 1.2::DOUBLE ELSE 1::DOUBLE END)), 0.95::DOUBLE) AS prior
  FROM inv a JOIN (SELECT * FROM {fixed.values(scenario.reach(), 'v', 'rs, rt, dist')} UNION ALL SELECT DISTINCT zone, zone, 0 FROM inv WHERE zone NOT IN ({_in(scenario.ORDER)})) r ON a.zone = r.rs JOIN inv b ON b.zone = r.rt AND b.id <> a.id CROSS JOIN tech t JOIN lk ON lk.id = b.id AND lk.ti = t.ti LEFT JOIN x ON x.asset_id = b.id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY {_cut('prior')} DESC, tgt, ti) AS rn FROM c WHERE {_cut('prior')} >= 0.5) WHERE rn <= 20)"""


@query(_SCENARIO + f"""SELECT * FROM (SELECT profile, src, tgt, technique, round({_cut('least(prior * mult, 0.95::DOUBLE)')}, 6) AS posterior FROM k JOIN prof USING (technique)) WHERE posterior >= 0.5""")
def scenario_transitions(spark, sf_dir):
    return scenario.transitions(inv(spark, sf_dir, *SCORED)).withColumn("posterior", F.round("posterior", 6))


_SCENARIO_SEARCH = _SCENARIO + f""",
{TGT}, graph AS MATERIALIZED (SELECT * FROM (SELECT profile, src, tgt, technique, {_cut('least(prior * mult, 0.95::DOUBLE)')} AS posterior FROM k JOIN prof USING (technique)) WHERE posterior >= 0.5),
es AS (SELECT i.id, round(max(coalesce(f.epss, 0)) * 10 + (CASE WHEN internet_facing THEN 3 ELSE 0 END) + (CASE WHEN zone = 'dmz' THEN 2 ELSE 1 END), 6) AS score FROM inv i JOIN fnd f ON f.asset_id = i.id WHERE internet_facing OR zone = 'dmz' GROUP BY i.id, internet_facing, zone),
entry AS (SELECT profile, id FROM (SELECT id FROM es ORDER BY score DESC, id LIMIT 10), (SELECT DISTINCT profile FROM prof)),
{_beam(scenario.MAX_DEPTH)}"""


def _scenario(spark, sf_dir):
    i = materialise(top_finding(inv(spark, sf_dir, *SCORED, "name", "sensitivity", "sources")), "inventory")
    adj = scenario.transitions(i).join(i.where("top IS NOT NULL").select(F.col("id").alias("tgt")), "tgt", "left_semi")
    return i, scenario.search(adj, materialise(scenario.entries(i), "entries"), i.where(targets.is_target()).select("id"))


@query(_SCENARIO_SEARCH + "\nSELECT profile, array_to_string(path, '>') AS path, array_to_string(techniques, '+') AS techniques, round(p, 4) AS p FROM found")
def scenario_paths(spark, sf_dir):
    """The scenario model's paths under all profiles."""
    found = _scenario(spark, sf_dir)[1]
    return found.select("profile", F.array_join("path", ">").alias("path"), F.array_join("techniques", "+").alias("techniques"), F.round("p", 4).alias("p"))


def scenario_report(spark, sf_dir):
    """The ten best patterns of the scenario model, each by its best path over all profiles, with the scenario's scores."""
    i, found = _scenario(spark, sf_dir)
    paths = scenario.judged(ps.scored(path_search.as_paths(found, i, F.col("profile"))))
    first = F.array_position(F.array(*[F.lit(p) for p in PROFILES]), F.col("profile"))
    best = ps.best_per_pattern(paths, "realism", 10, (first, "path_id"))
    return best.select("rank", "path_id", "profile", "label", F.array_join("kill_chain", " → ").alias("kill_chain"), "realism", F.round("detection", 6).alias("detection"), "effort", "impact", "reward")


QUERIES["scenario_report"] = scenario_report


@query(sql.with_(*sql.BASE) + "SELECT i.id, round(max(coalesce(f.epss, 0)) * 10 + (CASE WHEN internet_facing THEN 3 ELSE 0 END) + (CASE WHEN zone = 'dmz' THEN 2 ELSE 1 END), 6) AS score FROM inv i JOIN fnd f ON f.asset_id = i.id GROUP BY i.id, internet_facing, zone")
def scenario_entry_scores(spark, sf_dir):
    return scenario.entry_score(inv(spark, sf_dir, "findings", "internet_facing", "zone"))
