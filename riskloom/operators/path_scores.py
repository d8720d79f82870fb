"""Scores, phases, labels and patterns of paths; all row-local over the node and edge lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from .delivery import latest_delivery
from .inventory import tier


def paths_of(attack_paths: DataFrame, need: Sequence[str] = (), nodes: Sequence[str] = (), edges: Sequence[str] = ()) -> DataFrame:
    """Stored paths, the latest delivery of each id; null lists are empty, NaN scores null.

    ``need`` names the columns wanted besides ``path_id``, all by default; ``nodes`` and ``edges`` the fields of the list
    entries, all by default. What isn't named is neither read from the file nor shuffled.
    """
    num = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    part = {"nodes": nodes, "edges": edges}

    def whole(c):
        names = part.get(c, ())
        got = F.arrays_zip(*[F.col(f"{c}.{n}") for n in names]) if names else F.col(c)
        kind = attack_paths.select(got).schema[0].dataType
        return F.coalesce(got, F.array().cast(kind))

    columns = {c: F.col(c) for c in ("job_id", "profile", "pattern_signature", "pattern_label")} | {c: whole(c) for c in ("nodes", "edges", "kill_chain")}
    columns |= {c: num(c) for c in ("path_probability", "realism_score", "impact_score", "detection_risk", "final_risk_score")}
    return latest_delivery(attack_paths, "path_id", "ingested_at", {c: x for c, x in columns.items() if not need or c in need})


def nodes_of(paths: DataFrame) -> DataFrame:
    """``path_id, pos, asset_id, ...``: one row per node, defaults set."""
    n = paths.select("path_id", F.posexplode("nodes").alias("pos", "n"))
    return n.select(
        "path_id", "pos", "n.asset_id", F.coalesce("n.asset_type", F.lit("unknown")).alias("asset_type"), F.coalesce("n.asset_zone", F.lit("unknown")).alias("asset_zone"),
        F.coalesce("n.criticality", F.lit(0)).alias("criticality"), F.coalesce("n.internet_facing", F.lit(False)).alias("internet_facing"),
        F.coalesce("n.data_sensitivity", F.lit("standard")).alias("data_sensitivity"), F.upper(F.trim("n.misconfig_id")).alias("misconfig_id"),
    )


def edges_of(paths: DataFrame) -> DataFrame:
    e = paths.select("path_id", F.posexplode("edges").alias("pos", "e"))
    return e.select("path_id", "pos", "e.source_id", "e.target_id", "e.technique", "e.probability")


def product(c: Column) -> Column:
    return F.aggregate(c, F.lit(1.0), lambda a, x: a * x)


def _count(technique: str) -> Column:
    return F.size(F.filter("edges", lambda e: e["technique"] == technique))


def without_repeats(c: Column) -> Column:
    """A list without entries equal to the one before."""
    return F.filter(c, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(c, i - 1)))


def _joined(table: str, c: Column) -> Column:
    """Every technique's phrases in order, each once."""
    lists = {t: F.array(*[F.lit(x) for x in xs]) for t, xs in fixed.phrases(table).items()}
    none = F.array().cast("array<string>")

    def of(t):
        out = none
        for k, v in lists.items():
            out = F.when(t == k, v).otherwise(out)
        return out

    return F.array_distinct(F.flatten(F.transform(c, of)))


def scored(paths: DataFrame) -> DataFrame:
    """``paths`` with n, probability, interval, effort, impact, detection, phases, capabilities, timeline and pattern.

    Probability is the product over edges (no edges: 1, interval 0.5 to 0.5); a missing edge interval counts as
    0.2 wide. Everything comes from the row's own lists: no shuffle.
    """
    probs, n = F.transform("edges", lambda e: e["probability"]), F.size("nodes")
    ne = F.size("edges")
    prob = product(probs)
    wide = F.transform("edges", lambda e: F.coalesce(F.get(e["confidence_interval"], F.lit(1)) - F.get(e["confidence_interval"], F.lit(0)), F.lit(0.2)) / 3.92)
    std = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, w: a + w * w))
    low = F.when(ne == 0, 0.5).otherwise(F.greatest(F.lit(0.01), prob - std * 1.96))
    high = F.when(ne == 0, 0.5).otherwise(F.least(F.lit(0.99), prob + std * 1.96))
    mean = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x) / F.greatest(ne, F.lit(1))
    effort = F.least(n * 0.5 + _count("privilege_escalation") * 1.5 + _count("credential_theft") * 1.0 + (1 - mean) * 3, F.lit(10.0))
    climb = F.aggregate(F.transform("nodes", lambda x, i: x["criticality"] * (i + 1)), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    size = F.greatest(n, F.lit(1))
    impact = F.least(climb / size / size * 20, F.lit(100.0))
    techs = F.transform("edges", lambda e: e["technique"])
    ts = F.array_join(F.array_sort(F.array_distinct(techs)), "+")
    zones = without_repeats(F.transform("nodes", lambda x: x["asset_zone"]))
    end = lambda i: F.concat_ws(":", F.try_element_at("nodes", F.lit(i))["asset_type"], F.try_element_at("nodes", F.lit(i))["asset_zone"])
    sig = F.concat_ws("|", end(1), ts, end(-1), F.array_join(zones, "→"))
    blank = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    label = F.concat(
        blank(F.try_element_at("nodes", F.lit(1))["asset_type"]), F.lit(" → "), F.replace(blank(ts), F.lit("+"), F.lit(" + ")), F.lit(" → "),
        blank(F.try_element_at("nodes", F.lit(-1))["asset_type"]), F.lit(" ["), F.try_element_at("nodes", F.lit(-1))["asset_zone"], F.lit("] via "), F.array_join(zones, "→"),
    )
    return paths.withColumns(
        {
            "n_nodes": n, "probability": prob, "ci_low": low, "ci_high": high, "effort": effort, "impact": impact, "detection": n * 0.03, "min_edge": F.array_min(probs),
            "phases": F.array_distinct(F.concat(F.array(F.lit("Reconnaissance")), _joined(fixed.PHASES, techs))), "capabilities": _joined(fixed.CAPABILITIES, techs),
            "timeline": F.format_string("%d–%d hours", n * 4, n * 8), "signature": sig, "label": label,
        }
    )


def realism() -> Column:
    """How plausible a scored path is: probability, exploit scores of its nodes (``epss`` of each, geometric mean),
    evidence (up to three kinds of it on the target, ``sources``), narrow intervals, a length near five; the share for
    search visits counts as full, as a search without rollouts has none."""
    n = F.greatest(F.size("nodes"), F.lit(1))
    logs = F.aggregate(F.transform("nodes", lambda x: F.log(F.greatest(F.coalesce(x["epss"], F.lit(0.05)), F.lit(0.01)))), F.lit(0.0), lambda a, x: a + x)
    wide = F.aggregate(F.transform("edges", lambda e: F.get(e["confidence_interval"], F.lit(1)) - F.get(e["confidence_interval"], F.lit(0))), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.2)))
    narrow = 1 - wide / F.greatest(F.size("edges"), F.lit(1))
    seen = F.coalesce(F.try_element_at("nodes", F.lit(-1))["sources"], F.lit(0))
    evidence = F.when(F.size("edges") > 0, F.least(seen / 3, F.lit(1.0))).otherwise(0.0)
    return F.col("probability") * 0.25 + F.exp(logs / n) * 0.20 + evidence * 0.20 + narrow * 0.15 + F.greatest(F.lit(0.0), 1 - F.abs(n - 5) * 0.05) * 0.10 + 0.10


def reward() -> Column:
    """The terminal reward of a scored path: target, variety of categories, length, weakest edge, detection."""
    nodes, n = F.col("nodes"), F.size("nodes")
    kinds = F.size(F.array_distinct(F.filter(F.transform(nodes, lambda x: x["misconfig_category"]), lambda c: c.isNotNull())))
    each = F.transform(nodes, lambda x: F.when(x["misconfig_id"].isNull(), 0.0).when(x["severity"] == "critical", 0.08).when(x["misconfig_category"] == "authentication", 0.02).otherwise(0.04))
    risk = F.least(F.aggregate(each, F.lit(0.15), lambda a, x: a + x), F.lit(0.5))
    length = F.when(n < 4, 0.4).when(n <= 7, 1.3).when(n <= 10, 1.0).otherwise(0.7)
    goal = F.coalesce(F.try_element_at("nodes", F.lit(-1))["criticality"], F.lit(0)) / 5
    return goal * (1 + F.least(kinds / 5, F.lit(1.0)) * 1.5) * length * (0.5 + F.coalesce(F.col("min_edge"), F.lit(1.0)) * 0.5) * (1 - risk)


def coherence(probability: Column) -> Column:
    """0 to 100: zone hops, tier climb, entry, target and probability, 20 points each; from the row's node list."""
    nodes = F.col("nodes")
    near = F.create_map(*[x for a, bs in fixed.groups(fixed.ZONE_REACH + "airgap: airgap restricted") for x in (F.lit(a), F.array(*[F.lit(b) for b in bs]))])
    hops = F.greatest(F.size(nodes) - 1, F.lit(1))
    later = F.slice(nodes, 2, F.greatest(F.size(nodes) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(nodes, 1, F.greatest(F.size(nodes) - 1, F.lit(0))), later, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    valid = F.size(F.filter(pairs, lambda p: F.array_contains(F.try_element_at(near, p["a"]["asset_zone"]), p["b"]["asset_zone"])))
    climbs = F.size(F.filter(pairs, lambda p: tier(p["a"]["asset_type"]) <= tier(p["b"]["asset_type"])))
    first, last = F.try_element_at(nodes, F.lit(1)), F.try_element_at(nodes, F.lit(-1))
    entry = F.when(first["internet_facing"], 20).when(first["asset_zone"] == "dmz", 15).otherwise(5)
    goal = F.when(F.lower(last["asset_type"]).isin(*fixed.TERMINAL_TYPES.split()), 20).when(last["criticality"] >= 4, 15).otherwise(5)
    return valid / hops * 20 + climbs / hops * 20 + entry + goal + F.least(probability, F.lit(1.0)) * 20


def chokepoints(paths: DataFrame, top: int = 5) -> DataFrame:
    """The inner nodes most paths run through, with the share of paths a block there would cut."""
    inner = F.slice("nodes", 2, F.greatest(F.size("nodes") - 2, F.lit(0)))
    total = paths.agg(F.count(F.lit(1)).alias("total"))
    through = paths.select(F.explode(F.transform(inner, lambda n: n["asset_id"])).alias("asset_id")).where("asset_id IS NOT NULL")
    c = through.groupBy("asset_id").agg(F.count(F.lit(1)).alias("paths_through")).crossJoin(F.broadcast(total))  # one row
    return c.select("asset_id", "paths_through", F.floor(F.col("paths_through") * 100 / F.greatest("total", F.lit(1)) + 0.5).alias("blocking_impact")).orderBy(F.desc("paths_through"), "asset_id").limit(top)


def best_per_pattern(paths: DataFrame, score: str, top: int, ties: Sequence[str | Column] = ("path_id",)) -> DataFrame:
    """The best path of every pattern, ranked; patterns are keyed by ``signature``, ties by path id unless given."""
    rows = paths.where(F.col("signature").isNotNull() & F.col(score).isNotNull())
    w = Window.partitionBy("signature").orderBy(F.desc(score), *ties)
    best = rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r").orderBy(F.desc(score), *ties).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), *ties)))  # ``top`` rows only


def insights(best: DataFrame, most: int = 6) -> DataFrame:
    """``rank, text``: one line for each of the best paths that has a label, at most ``most``."""
    text = F.format_string("%s: realism %.0f%%, impact %.0f, %s", F.col("label"), F.col("realism") * 100, F.col("impact"), F.col("timeline"))
    return best.where(F.col("label").isNotNull()).orderBy("rank").limit(most).select("rank", text.alias("text"))


def edge_split(edges: Column) -> tuple[Column, Column]:
    """The number of edges split 70 to 30 as reports show it: the rounded 70 % and the rest."""
    first = F.floor(edges * 0.7 + 0.5)
    return first, edges - first
