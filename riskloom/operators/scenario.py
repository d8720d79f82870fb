"""The small scenario model: five zones in a row, a flat threshold, several techniques per pair of assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed

# --- fixed values ---------------------------------------------------------------------------------------------
REACH = """
internet: internet dmz corp
dmz: dmz corp internet
corp: corp dmz restricted mgmt
mgmt: mgmt corp restricted
restricted: restricted mgmt corp
"""
ORDER = "internet dmz corp mgmt restricted"
AFFINITY_TYPES = """
credential_theft 1.5 domain_controller service_account
credential_theft 1.3 rdp_gateway
privilege_escalation 1.4 domain_controller
privilege_escalation 1.5 service_account
privilege_escalation 1.3 backup_server
exploit 1.4 vpn_gateway rdp_gateway
exploit 1.2 database_server
data_exfiltration 1.3 database_server file_server backup_server
"""
AFFINITY_ZONES = "lateral 1.3 restricted mgmt"
THRESHOLD, K = 0.5, 20
MAX_DEPTH = 8
PHASES = {"exploit": "Initial Access", "lateral": "Lateral Movement", "credential_theft": "Credential Access", "privilege_escalation": "Privilege Escalation", "data_exfiltration": "Exfiltration"}


def reach() -> list[tuple[str, str, int]]:
    order = ORDER.split()
    return [(a, b, abs(order.index(a) - order.index(b))) for a, bs in fixed.groups(REACH) for b in bs]


def _affinity(technique: str) -> Column:
    out = F.lit(1.0)
    for row in reversed(AFFINITY_TYPES.strip().splitlines()):
        t, factor, *types = row.split()
        if t == technique:
            out = F.when(F.col("type").isin(*types), float(factor)).otherwise(out)
    t, factor, *zones = AFFINITY_ZONES.split()
    return F.when(F.col("zone").isin(*zones), float(factor)).otherwise(out) if t == technique else out


def _likelihood(technique: str) -> Column:
    mine = [c for c, ts in fixed.groups(fixed.CATEGORY_TECHNIQUES) if technique in ts]
    rel = F.filter("findings", lambda f: F.coalesce(f["category"].isin(*mine), F.lit(False)))
    crit = F.size(F.filter(rel, lambda f: (f["severity"] == "critical") & f["exploit_available"]))
    high = F.size(F.filter(rel, lambda f: f["severity"] == "high"))
    return F.when(F.size(rel) == 0, 0.3).otherwise(F.least(F.size(rel) * 0.15 + crit * 0.25 + high * 0.1, F.lit(0.95)))


def transitions(inv: DataFrame, k: int = K) -> DataFrame:
    """``profile, src, tgt, technique, posterior``: the ``k`` strongest (target, technique) of each asset, then profiles.

    As in ``edges``, sources are scored by class (zone and two flags) and share their class's ranking; ``k`` counts
    techniques, so a class ranks ``k`` and one target's techniques more. Ties by target, then technique.
    """
    techniques = fixed.techniques()
    exploitable = F.size(F.filter("findings", lambda f: f["exploit_available"] & (f["severity"] == "critical")))
    options = [
        F.struct(F.lit(i).alias("ti"), F.lit(t).alias("technique"), (F.lit(base) * (1 + F.col("criticality") * 0.08) * (1 + exploitable * 0.15) * _affinity(t)).alias("part"), _likelihood(t).alias("lk"))
        for i, (t, base, _) in enumerate(techniques)
    ]
    tgts = inv.select(F.col("id").alias("tgt"), F.col("zone").alias("tgt_zone"), F.col("domain_joined").alias("tgt_domain"), F.explode(F.array(*options)).alias("o"))
    flags = ["src_zone", "src_internet", "src_domain"]
    members = inv.select(F.col("id").alias("src"), F.col("zone").alias("src_zone"), F.col("internet_facing").alias("src_internet"), F.col("domain_joined").alias("src_domain"))
    near = fixed.small_table(inv.sparkSession, reach(), "src_zone string, tgt_zone string, dist int")
    own = members.select(*flags).distinct()
    # a zone that isn't one of the five reaches itself
    alone = own.where(~F.col("src_zone").isin(*ORDER.split())).withColumns({"tgt_zone": F.col("src_zone"), "dist": F.lit(0)})
    pairs = own.join(near, "src_zone").unionByName(alone).join(tgts, "tgt_zone").select(*flags, "tgt", "tgt_domain", "dist", "o.*")
    common = F.pow(F.lit(0.6), F.col("dist")) * F.when(F.col("src_internet"), 1.4).otherwise(1.0) * F.when(F.col("src_domain") & F.col("tgt_domain"), 1.2).otherwise(1.0)
    score = lambda p: F.rint(F.least(F.greatest(p * 0.3 + F.col("lk") * 0.7, F.lit(0.05)), F.lit(0.98)) * 1e9) / 1e9
    pairs = pairs.withColumn("prior", F.least(F.col("part") * common, F.lit(0.95))).withColumn("base", score(F.col("prior"))).where(F.col("base") >= THRESHOLD)
    w = Window.partitionBy(*flags).orderBy(F.desc("base"), "tgt", "ti")
    best = pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + len(techniques))
    lists = best.groupBy(*flags).agg(F.array_sort(F.collect_list(F.struct("r", "tgt", "technique", "prior", "lk"))).alias("best"))
    kept = members.join(lists, flags).select("src", F.explode(F.slice(F.filter("best", lambda b: b["tgt"] != F.col("src")), 1, k)).alias("b")).select("src", "b.tgt", "b.technique", "b.prior", "b.lk")
    each = []
    for name, table in fixed.profiles().items():
        each.append(F.struct(F.lit(name).alias("profile"), score(F.least(F.col("prior") * fixed.switch(F.col("technique"), table, 1.0), F.lit(0.95))).alias("posterior")))
    out = kept.select("src", "tgt", "technique", F.explode(F.array(*each)).alias("p"))
    return out.where(F.col("p.posterior") >= THRESHOLD).select("p.profile", "src", "tgt", "technique", "p.posterior")


def entry_score(inv: DataFrame) -> DataFrame:
    """``id, score``: 10 x best exploit score + 3 if exposed + 2 in the dmz, else 1; assets without findings have none."""
    epss = F.array_max(F.transform("findings", lambda f: F.coalesce(f["epss"], F.lit(0.0))))
    s = epss * 10 + F.when(F.col("internet_facing"), 3).otherwise(0) + F.when(F.col("zone") == "dmz", 2).otherwise(1)
    return inv.where(F.size("findings") > 0).select("id", F.round(s, 6).alias("score"))


def reward(n: Column, criticality: Column, phases: Column, weakest: Column) -> Column:
    rare = F.when(phases >= 3, 1.5).when(phases >= 2, 1.2).otherwise(1.0)
    depth = F.when(n.between(6, 8), 1.6).when(n >= 4, 1.3).when(n >= 3, 0.5).otherwise(0.0)
    return criticality / 5 * rare * depth * (0.5 + weakest * 0.5)


def realism(n: Column, criticality: Column, phases: Column, probability: Column, epss: Column) -> Column:
    """Without a search there are no visits; their part counts as full."""
    depth = F.when(n >= 6, 1.6).when(n >= 4, 1.3).when(n >= 3, 0.4).otherwise(0.1)
    return F.least(probability * 0.25 + epss * 0.20 + phases / 5 * 0.20 + depth * 0.10 + 0.10 + criticality / 5 * 0.15, F.lit(1.0))


def entries(inv: DataFrame, top: int = 10) -> DataFrame:
    """``id, score``: the best entry points among exposed assets and those in the dmz; ties by id."""
    exposed = inv.where(F.col("internet_facing") | (F.col("zone") == "dmz"))
    return entry_score(exposed).orderBy(F.desc("score"), "id").limit(top)


def search(adjacency: DataFrame, starts: DataFrame, targets: DataFrame) -> DataFrame:
    """Paths of the scenario model under each profile: the beam of ``path_search`` with its own depth."""
    from .path_search import search as beam
    from .targets import each_profile

    return beam(adjacency, each_profile(starts.select("id")), targets, max_depth=MAX_DEPTH, by=["profile"])


def judged(paths: DataFrame) -> DataFrame:
    """Searched paths (``path_search.as_paths``, scored) with the scenario's scores: phases, realism, detection, effort, impact, reward."""
    n, techs = F.size("nodes"), F.transform("edges", lambda e: e["technique"])
    last = F.try_element_at("nodes", F.lit(-1))["criticality"]
    phases = F.array_distinct(F.transform(techs, lambda t: fixed.switch(t, PHASES, "Exfiltration")))
    logs = F.aggregate(F.transform("nodes", lambda x: F.log(F.greatest(F.coalesce(x["epss"], F.lit(0.0)), F.lit(0.01)))), F.lit(0.0), lambda a, x: a + x)
    count = lambda t: F.size(F.filter("edges", lambda e: e["technique"] == t))
    kinds = F.size(F.array_compact(F.array_distinct(F.transform("nodes", lambda x: x["misconfig_category"]))))
    weakest = F.array_min(F.transform("edges", lambda e: e["probability"]))
    return paths.withColumns(
        {
            "kill_chain": phases, "realism": F.round(realism(n, last, F.size(phases), F.col("path_probability"), F.exp(logs / F.greatest(n, F.lit(1)))), 6),
            "detection": F.least(n * 0.08 + count("exploit") * 0.05, F.lit(0.85)), "effort": n * 0.5 + count("privilege_escalation") * 1.5, "impact": last * 20, "reward": F.round(reward(n, last, kinds, weakest), 6),
        }
    )
